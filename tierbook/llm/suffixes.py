"""Suffix order and common prefixes of a shard by external induced sorting.

The suffixes that start a rising run after a falling one (S*) are named by sorting the tuples of symbols up to the next of
them; the string of names is ordered by doubling where it fits the memory given, else by the same procedure one level down,
its names spelled in bytes so that buckets stay few (and by doubling all the same where that spelling is no shorter than the text).  The order of the S* suffixes, with their common prefixes, then induces
that of all others: bucket after bucket is taken from a priority queue, and every suffix found puts the one before it into
the queue of its first symbol, together with the common prefix it has with the last one put there (one more than the least
common prefix between their sources).  The key of a queue is the first symbol and the order of arrival, so a bucket is a
file to append to; queues that outgrow the memory given are written to the scratch folder of the task and removed with it.

Symbols are bytes 1 to 254; 0 ends a text.  Common prefixes are counted up to ``cap``, which the callers need no further.
"""

from __future__ import annotations

import os
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np

DIGITS = 250


class Buckets:
    """First-in first-out queues of (position, common prefix), one per symbol, on disk beyond ``memory`` bytes."""

    def __init__(self, folder: str, name: str, memory: int):
        self.folder, self.name, self.memory, self.held = Path(folder), name, memory, 0
        self.chunks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        self.filed: set[int] = set()
        self.known: set[int] = set()

    def push(self, symbol: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.chunks[symbol].append((positions, prefixes))
        self.known.add(symbol)
        self.held += positions.nbytes + prefixes.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        for symbol, parts in self.chunks.items():
            for kind, index in (("p", 0), ("c", 1)):
                with (self.folder / f"{self.name}-{symbol}-{kind}").open("ab") as out:
                    for part in parts:
                        out.write(np.ascontiguousarray(part[index]).tobytes())
            self.filed.add(symbol)
        self.chunks.clear()
        self.held = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        positions, prefixes = [], []
        if symbol in self.filed:
            for kind, out, width in (("p", positions, np.int64), ("c", prefixes, np.int16)):
                path = self.folder / f"{self.name}-{symbol}-{kind}"
                out.append(np.fromfile(path, width))
                path.unlink()
            self.filed.discard(symbol)
        for p, c in self.chunks.pop(symbol, []):
            positions.append(p)
            prefixes.append(c)
            self.held -= p.nbytes + c.nbytes
        if not positions:
            return np.zeros(0, np.int64), np.zeros(0, np.int16)
        return np.concatenate(positions), np.concatenate(prefixes)


def run_lengths(text: np.ndarray) -> np.ndarray:
    """Equal symbols from each position on."""
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, len(text))
    lengths = np.diff(ends, prepend=0)
    return np.repeat(ends, lengths) - np.arange(len(text))


def least_between(values: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """min(values[after + 1 .. upto]) for each query, level by level of a sparse table."""
    out = np.zeros(len(after), values.dtype)
    if not len(after):
        return out
    level = np.frexp((upto - after).astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max()) + 1):
        if k:
            table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(table[after[here] + 1], table[upto[here] + 1 - (1 << k)])
    return out


class Scan:
    """One pass of induction; ``sign`` 1 goes up through the buckets (falling suffixes), -1 down (rising ones)."""

    def __init__(self, text: np.ndarray, run: np.ndarray, queue: Buckets, cap: int, sign: int):
        self.text, self.run, self.queue, self.cap, self.sign = text, run, queue, cap, sign

    def seam(self, left: int, right: int) -> int:
        return min(self.cap, int(self.run[left]), int(self.run[right]))

    def own(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes of the bucket, in order of the scan, with those they put into their own bucket."""
        positions, prefixes = self.queue.pop(symbol)
        all_p, all_c = [positions], [prefixes]
        while len(positions):
            before = positions - 1
            rank = np.flatnonzero(before >= 0)
            rank = rank[self.text[before[rank]] == symbol]
            if not len(rank):
                break
            found = before[rank]
            common = np.zeros(len(found), np.int16)
            common[0] = self.seam(int(positions[-1]), int(found[0]))
            common[1:] = np.minimum(least_between(prefixes, rank[:-1], rank[1:]) + 1, self.cap)
            positions, prefixes = found, common
            all_p.append(found)
            all_c.append(common)
        return np.concatenate(all_p), np.concatenate(all_c)

    def put(self, symbol: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """What stands before these suffixes goes to the buckets still ahead."""
        before = positions - 1
        rank = np.flatnonzero(before >= 0)
        first = self.text[before[rank]]
        ahead = first > symbol if self.sign > 0 else first < symbol
        rank, first = rank[ahead], first[ahead]
        if not len(rank):
            return
        order = np.argsort(first, kind="stable")
        rank, first = rank[order], first[order]
        common = np.zeros(len(rank), np.int16)
        same = np.flatnonzero(first[1:] == first[:-1])
        common[same + 1] = np.minimum(least_between(prefixes, rank[same], rank[same + 1]) + 1, self.cap)
        cuts = np.append(np.flatnonzero(np.append(True, first[1:] != first[:-1])), len(first))
        found = before[rank]
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            d = int(first[s])
            common[s] = d in self.queue.known
            self.queue.push(d, found[s:e], common[s:e])


def refined(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks of the active members split by key, in place; returns those that still share a rank.

    A rank is the number of members in smaller groups, so all members of a group must be active together.
    """
    # one plain sort of the keys, another of (rank, place of the key): far faster than a stable sort of pairs
    order = np.argsort(key)
    sorted_ = key[order]
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(np.append(False, sorted_[1:] != sorted_[:-1]))
    order = np.argsort(rank[active] << 32 | place)
    at, k = active[order], key[order]
    old = rank[at]
    fresh = np.append(True, (old[1:] != old[:-1]) | (k[1:] != k[:-1]))
    index = np.arange(len(at))
    group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), index, 0))
    first = np.maximum.accumulate(np.where(fresh, index, 0))
    rank[at] = old + first - group
    alone = fresh & np.append(fresh[1:], True)
    return at[~alone]


def rising(text: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Whether a suffix is smaller than the one after it."""
    end = np.arange(len(text)) + run
    return (end < len(text)) & (text < text[np.minimum(end, len(text) - 1)])


def star_names(text: np.ndarray, up: np.ndarray, stars: np.ndarray) -> tuple[np.ndarray, bool]:
    """Order-keeping names of the tuples from each S* position to the next, and whether some are equal."""
    # four symbols with their kinds in one number, put together in place
    symbol = np.append(text.astype(np.uint16) << 1 | up, np.zeros(3, np.uint16)) + np.uint16(1)
    symbol[len(text) :] = 0
    four = np.zeros(len(text) + 1, np.uint64)
    for k in range(4):
        four[:-1] |= symbol[k : k + len(text)].astype(np.uint64) << np.uint64(48 - 16 * k)
    length = np.diff(np.append(stars, len(text))) + 1
    rank, active, done = np.zeros(len(stars), np.int64), np.arange(len(stars)), 0
    same = np.zeros(0, np.int64)
    while len(active):
        left = np.clip(length[active] - done, 0, 4).astype(np.uint64)
        keep = np.where(left > 0, ~np.uint64(0) << (np.uint64(64) - np.uint64(16) * np.maximum(left, np.uint64(1))), np.uint64(0))
        shared = refined(rank, active, four[np.minimum(stars[active] + done, len(text))] & keep)
        done += 4
        longer = length[shared] > done
        same, active = np.concatenate([same, shared[~longer]]), shared[longer]
    return rank, len(same) > 0


def doubled(names: np.ndarray) -> np.ndarray:
    """Positions in suffix order of a string of order-keeping names."""
    n, rank = len(names), names.copy()
    order = np.argsort(rank)
    fresh = np.append(True, rank[order][1:] != rank[order][:-1])
    active, width = order[~(fresh & np.append(fresh[1:], True))], 1
    while len(active):
        after = active + width
        key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        active, width = refined(rank, active, key), width * 2
    return np.argsort(rank)


def spelled(names: np.ndarray) -> tuple[np.ndarray, int]:
    """Names as digits of equal number, and that number."""
    width = 1
    while DIGITS**width <= int(names.max()):
        width += 1
    out = np.empty(len(names) * width, np.uint8)
    for k in range(width):
        out[k::width] = names // DIGITS ** (width - 1 - k) % DIGITS + 1
    return out, width


def star_order(text: np.ndarray, up: np.ndarray, stars: np.ndarray, folder: str, memory: int) -> np.ndarray:
    names, equal = star_names(text, up, stars)
    if not equal:
        return stars[np.argsort(names)]
    if len(stars) * 64 <= memory:
        return stars[doubled(names)]
    below, width = spelled(names)
    if len(below) >= len(text):  # a level down would be no smaller
        return stars[doubled(names)]
    order = np.concatenate([p for p, _ in buckets_down(below, 1, folder, memory)][::-1])
    return stars[order[order % width == 0] // width]


def common_prefixes(text: np.ndarray, left: np.ndarray, right: np.ndarray, cap: int) -> np.ndarray:
    """Equal symbols from two positions on, compared eight at a time."""
    n = len(text)
    padded = np.append(text, np.zeros(cap + 16, np.uint8))
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the eight symbols from each position on
    out, active = np.minimum(cap, n - np.maximum(left, right)), np.arange(len(left))
    for done in range(0, cap, 8):
        if not len(active):
            break
        differ = words[left[active] + done] ^ words[right[active] + done]
        some = np.flatnonzero(differ)
        lowest = differ[some] & (~differ[some] + np.uint64(1))
        at = active[some]
        out[at] = np.minimum(out[at], done + (np.frexp(lowest.astype(np.float64))[1] - 1) // 8)
        active = active[differ == 0]
    return out.astype(np.int16)


def buckets_down(text: np.ndarray, cap: int, folder: str, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes by first symbol, last symbol first: positions in order, and the common prefix of each with the one before
    it in the bucket (0 for the first).  With ``cap`` 1 only the order counts."""
    n = len(text)
    run = run_lengths(text)
    up = rising(text, run)
    stars = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    with tempfile.TemporaryDirectory(dir=folder) as scratch:
        if len(stars):
            stars = star_order(text, up, stars, folder, memory)
        shared = np.zeros(len(stars), np.int16)
        if cap > 1 and len(stars) > 1:
            for s in range(1, len(stars), 1 << 18):
                e = min(len(stars), s + (1 << 18))
                shared[s:e] = common_prefixes(text, stars[s - 1 : e - 1], stars[s:e], cap)
        symbols = np.flatnonzero(np.bincount(text, minlength=1))
        cuts = np.searchsorted(text[stars], np.append(symbols, symbols[-1] + 1)) if len(stars) else np.zeros(len(symbols) + 1, int)
        falling = Buckets(scratch, "found", memory)
        scan = Scan(text, run, Buckets(scratch, "up", memory), cap, 1)
        scan.queue.push(int(text[-1]), np.array([n - 1]), np.zeros(1, np.int16))
        for k, c in enumerate(symbols.tolist()):
            positions, prefixes = scan.own(c)
            falling.push(c, positions, prefixes)
            seeds, common = stars[cuts[k] : cuts[k + 1]], shared[cuts[k] : cuts[k + 1]].copy()
            if len(seeds):
                common[0] = scan.seam(int(positions[-1]), int(seeds[0])) if len(positions) else 0
            scan.put(c, np.concatenate([positions, seeds]), np.concatenate([prefixes, common]))
        scan = Scan(text, run, Buckets(scratch, "down", memory), cap, -1)
        for c in symbols[::-1].tolist():
            high, high_c = scan.own(c)
            low, low_c = falling.pop(c)
            seam = scan.seam(int(high[-1]), int(low[-1])) if len(high) and len(low) else 0
            back = np.append(seam, low_c[:0:-1]).astype(np.int16) if len(low) else low_c
            scan.put(c, np.concatenate([high, low[::-1]]), np.concatenate([high_c, back]))
            up_c = np.append(seam, high_c[:0:-1]).astype(np.int16) if len(high) else high_c
            common = np.concatenate([low_c, up_c])
            common[:1] = 0
            yield np.concatenate([low, high[::-1]]), common


def scratch_folder() -> str:
    """Where Spark itself spills on this machine."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or tempfile.gettempdir()


def repeated_starts(text: np.ndarray, length: int, memory: int = 256 << 20) -> np.ndarray:
    """Mask of the positions whose next ``length`` symbols also start elsewhere in the text."""
    mask = np.zeros(len(text), bool)
    if not len(text):
        return mask
    for positions, common in buckets_down(text, length, scratch_folder(), memory):
        equal = np.flatnonzero(common >= length)
        mask[positions[equal]] = True
        mask[positions[equal - 1]] = True
    return mask

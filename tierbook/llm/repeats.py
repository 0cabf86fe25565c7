"""Removal of every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else.

Every string of that length is owned by the 64-byte gram of least hash in it (the first of equals), so equal strings have
equal owners, wherever they are.  Neighbouring strings with the same owner form a segment.  Owners that occur once are
dropped; equal segments of an owner are counted and kept once; an owner with one distinct segment needs no comparison.  The
segments of all other owners are dealt to shards by owner, and the suffix order with common prefixes of each shard
(suffixes.py) tells which strings start more than once.  Strings with different owners are never equal, so no shard needs
another.

An owner with more than ``crowd`` distinct segments (a passage that many documents share, each with its own surroundings) would
make one shard grow with the table.  Its segments are cut into narrower ones, of at most 16, then 4, then 1 neighbouring strings that
stand alike around the owner, each owned by the bytes that all of them share (185, 197, 200 bytes).  What lies inside the
passage becomes equal and is kept once, what reaches out of it gets an owner of its own, and the rest goes to the shards as before.

Strings are judged on the input, inside one document; overlaps and repeats within the document count.  Null text is empty.
A document is known by its id and the hash of its text: rows that repeat both get the same spans (and repeat each other), a
null id is no obstacle.  Other columns are passed on untouched; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tierbook.llm.common import stored
from tierbook.llm.suffixes import repeated_starts

LENGTH = 200
#: A power of two from 16 on; short grams recur by chance and make work, long ones make more segments.
GRAM = 64
#: Positions handled at a time; a position fits the low bits of a packed minimum.
SLICE = 1 << 20
LOW = np.uint64(SLICE - 1)
#: About 100 bytes of memory are needed for each byte of a shard.
SHARD_BYTES = 1_500_000
#: Bytes of queues and names that a shard keeps in memory.  A full shard needs 15 MB for its queues, so it spills (once or twice) and recurses (twice).
MEMORY = 7 << 20
CROWD = 1000
#: Neighbouring strings of the segments of a crowded owner, level by level.
WIDTHS = (16, 4, 1)
#: A side of a join is broadcast while it holds at most this many entries (about 30 bytes each); beyond, both are shuffled.
BROADCAST_ENTRIES = 1_000_000
#: Fixed odd multipliers of the gram hash (digits of the golden ratio and of the square root of two).
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0x6A09E667F3BCC909))


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * MIX[0]
    h ^= h >> np.uint64(29)
    h += right * MIX[1]
    h ^= h >> np.uint64(32)
    h *= MIX[0]
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position: of eight bytes, then of twice as many until all are in."""
    n = len(data) - 7
    h = np.empty(n, np.uint64)
    for k in range(8):
        m = len(h[k::8])
        h[k::8] = np.frombuffer(data[k : k + 8 * m].tobytes(), "<u8")
    width = 8
    while width < GRAM:
        h, width = mixed(h[:-width], h[width:]), 2 * width
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First string, number of strings and owner's hash of each segment; documents lie between bounds, one after another."""
    total = len(data)
    if total < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.zeros(total + 1, np.int32)
    long = np.diff(bounds) >= length
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - length + 1, -1)
    inside = np.cumsum(inside)[:total] > 0
    width, step = length - GRAM + 1, SLICE - length
    lows, counts, keys = [], [], []
    for begin in range(0, total - length + 1, step):
        part = data[begin : begin + step + length - 1]
        valid = inside[begin : begin + len(part) - length + 1]
        if not valid.any():
            continue
        h = gram_hashes(part)
        owner = sliding_least(h & ~LOW | np.arange(len(h), dtype=np.uint64), width) & LOW
        change = np.append(True, (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1]))
        first = np.flatnonzero(change)
        size = np.diff(np.append(first, len(owner)))
        used = valid[first]
        first, size = first[used], size[used]
        lows.append(first + begin)
        counts.append(size)
        keys.append(h[owner[first].astype(np.int64)])
    if not lows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(lows), np.concatenate(counts), np.concatenate(keys)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where its values begin and end."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _owners(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = segments(*_bytes(batch.column(0)), length)[2]
            if len(keys):
                yield pa.record_batch([pa.array(keys.view(np.int64))], ["key"])

    return run


def _segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = _bytes(batch.column(2))
            first, count, keys = segments(data, bounds, length)
            if not len(first):
                continue
            row = np.searchsorted(bounds, first, "right") - 1
            raw = memoryview(data.tobytes())
            ends = first + count + length - 1
            prints = np.fromiter((xxh3_64_intdigest(raw[s:e]) for s, e in zip(first.tolist(), ends.tolist(), strict=True)), np.uint64, len(first))
            doc, mark = (np.asarray(batch.column(k))[row] for k in range(2))
            yield pa.record_batch(
                [pa.array(v) for v in (doc, mark, keys.view(np.int64), prints.view(np.int64), first - bounds[row], count)],
                ["doc", "mark", "key", "print", "low", "n"],
            )

    return run


SEGMENT = "doc long, mark long, key long, print long, low long, n long"
CLASS = ["key", "print", "n"]
#: A segment's first string and number of strings in one number: a segment has fewer strings than LENGTH.
PLACE = (1 << 16) - 1


def _known(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"))


def _sized(df: DataFrame, entries: str, limit: int) -> DataFrame:
    held = df.agg(F.sum(F.size(entries) + 1)).first()[0] or 0
    return F.broadcast(df) if held <= limit else df


def _cut_out(length: int):
    """Bytes of the wanted segments of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                raw, rows = text.as_py(), wanted.as_py()
                sizes = [r["place"] & PLACE for r in rows]
                texts = [raw[r["place"] >> 16 : (r["place"] >> 16) + n + length - 1] for r, n in zip(rows, sizes, strict=True)]
                yield pa.record_batch(
                    [*(pa.array([r[c] for r in rows], pa.int64()) for c in ("key", "print")), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary())],
                    [*CLASS, "bytes"],
                )

    return run


RANGE = "key long, print long, n long, begin long, stop long"


def ranges_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _shard(length: int, memory: int):
    """Ranges of repeated strings in the segments of a shard."""

    def run(group: pa.Table) -> pa.Table:
        data, bounds = _bytes(group["bytes"].combine_chunks())
        segment_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        # 0 parts the segments; UTF-8 has no byte 255, so every byte can be raised by one
        text = np.zeros(len(data) + len(bounds) - 1, np.uint8)
        place = np.arange(len(data)) + segment_of
        text[place] = data + 1
        # what equals across the end of a segment is no string of it, nor is what starts with the mark between two
        whole = np.zeros(len(text), bool)
        whole[place] = np.arange(len(data)) <= np.repeat(bounds[1:] - length, np.diff(bounds))
        mask = repeated_starts(text, length, memory) & whole
        begin, stop = ranges_of(mask)
        base = bounds[:-1] + np.arange(len(bounds) - 1)
        row = np.searchsorted(base, begin, "right") - 1
        columns = [pa.array(group[c].to_numpy()[row]) for c in CLASS]
        return pa.table([*columns, pa.array(begin - base[row]), pa.array(stop - base[row])], [*CLASS, "begin", "stop"])

    return run


PIECE = RANGE.replace("begin long, stop long", "begin long") + ", p_key long, p_print long, p_n long, bytes binary, at long"


def _narrowed(length: int, width: int):
    """The segments cut into runs of strings whose owner stands in the same ``width`` places of them; ``p_`` names the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in PIECE.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key, print_, n, raw, at in zip(*(batch.column(c).to_pylist() for c in (*CLASS, "bytes", "at")), strict=True):
                if at is None:  # the first gram with the owner's hash
                    at = int(np.flatnonzero(gram_hashes(np.frombuffer(raw, np.uint8)).view(np.int64) == key)[0])
                # a string begins up to ``at`` bytes before the owner
                for near in range((at - n + 1) // width * width, at + 1, width):
                    begin, end = max(0, at - near - width + 1), min(n, at - near + 1)
                    text = raw[begin : end + length - 1]
                    core = raw[at - near : at - near - width + 1 + length]
                    owner = xxh3_64_intdigest(core, (key + near) % (1 << 64))
                    hashes = np.array([owner, xxh3_64_intdigest(text)], np.uint64).view(np.int64).tolist()
                    for column, value in zip(out, (*hashes, end - begin, begin, key, print_, n, text, at - begin), strict=True):
                        column.append(value)
            kinds = [pa.int64()] * 7 + [pa.binary(), pa.int64()]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)

    return run


def _in_shards(segments_: DataFrame, length: int, shard_bytes: int, memory: int) -> DataFrame:
    """Ranges of the repeated strings, by the suffix order of shards that hold whole owners."""
    total = segments_.agg(F.sum(F.col("n") + length)).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    dealt = segments_.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), *CLASS, "bytes")
    return dealt.groupBy("shard").applyInArrow(_shard(length, memory), RANGE)


def _compared(segments_: DataFrame, length: int, crowd: int, shard_bytes: int, memory: int, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Ranges of the repeated strings of distinct segments (CLASS, distinct: those of their owner, bytes, at)."""
    ranges = stored(_in_shards(segments_.where(F.col("distinct") <= crowd), length, shard_bytes, memory), "ranges")
    crowded = segments_.where(F.col("distinct") > crowd)
    if not widths or crowded.isEmpty():
        return ranges
    pieces = stored(crowded.mapInArrow(_narrowed(length, widths[0]), PIECE), "pieces")
    classes = pieces.groupBy(*CLASS).agg(F.count("*").alias("copies"), F.first("bytes").alias("bytes"), F.first("at").alias("at"))
    classes = stored(classes, "classes")
    several = classes.groupBy("key").count().withColumnRenamed("count", "distinct").where("distinct > 1")
    finer = _compared(stored(classes.join(several, "key"), "compared"), length, crowd, shard_bytes, memory, widths[1:])
    found = _settled(classes, finer)
    back = pieces.withColumnRenamed("begin", "from").join(found, CLASS)
    place = [(F.col("from") + F.col(c)).alias(c) for c in ("begin", "stop")]
    return ranges.union(back.select(*[F.col(f"p_{c}").alias(c) for c in CLASS], *place))


def _settled(classes: DataFrame, ranges: DataFrame) -> DataFrame:
    """All strings of a class with copies are repeated; of the others those found."""
    whole = classes.where("copies > 1").select(*CLASS, F.lit(0).cast("long").alias("begin"), F.col("n").alias("stop"))
    return whole.union(ranges.join(classes.where("copies = 1").select(*CLASS), CLASS, "left_semi"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD,
                    shard_bytes: int = SHARD_BYTES, broadcast_entries: int = BROADCAST_ENTRIES, memory: int = MEMORY) -> DataFrame:
    """doc, mark and ranges, the strings that also start elsewhere as (begin, stop) of their starts, in order and apart."""
    known = _known(docs, id_col, text_col)
    owners = known.select("text").mapInArrow(_owners(length), "key long").groupBy("key").count().where("count > 1")
    segs = known.mapInArrow(_segments(length), SEGMENT).join(stored(owners.select("key"), "owners"), "key", "left_semi")
    segs = stored(segs, "segments")
    classes = segs.groupBy(*CLASS).agg(F.count("*").alias("copies"), F.first("doc").alias("doc"), F.first("mark").alias("mark"), F.first("low").alias("low"))
    classes = stored(classes, "classes")
    several = classes.groupBy("key").count().where("count > 1").withColumnRenamed("count", "distinct")
    compared = stored(classes.join(several, "key"), "compared")
    wanted = compared.groupBy("doc", "mark").agg(F.collect_set(F.struct("key", "print", F.shiftleft("low", 16).bitwiseOR(F.col("n")).alias("place"))).alias("wanted"))
    texts = known.join(_sized(stored(wanted, "wanted"), "wanted", broadcast_entries), ["doc", "mark"]).select("text", "wanted")
    texts = texts.mapInArrow(_cut_out(length), "key long, print long, n long, bytes binary")
    # rows that repeat a document hand out its segments again; a class counts once
    texts = texts.groupBy(*CLASS).agg(F.first("bytes").alias("bytes")).join(several, "key")
    texts = stored(texts.withColumn("at", F.lit(None).cast("long")), "texts")
    found = stored(_settled(classes, _compared(texts, length, crowd, shard_bytes, memory)), "found")
    spans = segs.join(found, CLASS).select("doc", "mark", (F.col("low") + F.col("begin")).alias("begin"), (F.col("low") + F.col("stop")).alias("stop"))
    # a set, as rows that repeat a document bring its spans again
    spans = spans.groupBy("doc", "mark").agg(F.sort_array(F.collect_set(F.struct("begin", "stop"))).alias("ranges"))
    last = F.struct(F.lit(0).cast("long").alias("begin"), F.lit(0).cast("long").alias("stop"))
    kind = "struct<done:array<struct<begin:bigint,stop:bigint>>,open:struct<begin:bigint,stop:bigint>>"
    joined = F.aggregate(
        "ranges", F.struct(F.array().alias("done"), last.alias("open")).cast(kind),
        lambda acc, r: F.when(
            r["begin"] <= acc["open"]["stop"],
            F.struct(acc["done"].alias("done"), F.struct(acc["open"]["begin"].alias("begin"), F.greatest(acc["open"]["stop"], r["stop"]).alias("stop")).alias("open")),
        ).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), r.alias("open"))).cast(kind),
        lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda r: r["stop"] > r["begin"]),
    )
    return spans.select("doc", "mark", joined.alias("ranges"))


def removed_runs(begin: np.ndarray, stop: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by strings that start in [begin, stop)."""
    if not len(begin):
        return begin, stop
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(stop[order] + length - 1)
    new = np.append(True, begin[1:] > end[:-1])
    first = np.flatnonzero(new)
    return begin[first], end[np.append(first[1:], len(end)) - 1]


def with_removals(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD,
                  shard_bytes: int = SHARD_BYTES, broadcast_entries: int = BROADCAST_ENTRIES, memory: int = MEMORY) -> DataFrame:
    """All columns of docs but the text in ``row``, and n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining text).

    Cutting bytes can part a character; what is left of it becomes the replacement character in ``kept``, while the digest
    is that of the remaining bytes.
    """
    ranges = stored(repeated_ranges(docs, length, id_col, text_col, crowd, shard_bytes, broadcast_entries, memory), "removals")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"),
    )
    joined = rows.join(_sized(ranges, "ranges", broadcast_entries), ["doc", "mark"], "left").select("row", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for raw, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                pairs = np.array([(r["begin"], r["stop"]) for r in ranges or ()], np.int64).reshape(-1, 2)
                begin, end = removed_runs(pairs[:, 0], pairs[:, 1], length)
                at, kept = 0, []
                for s, e in zip(begin.tolist(), end.tolist(), strict=True):
                    kept.append(raw[at:s])
                    at = e
                rest = b"".join([*kept, raw[at:]])
                values = (len(raw), int((end - begin).sum()), len(begin), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace"))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([batch.column(0), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], ["row", *NEW])

    schema = joined.select("row").schema
    for name, kind in zip(NEW, ("long", "long", "long", "string", "string"), strict=True):
        schema = schema.add(name, kind)
    return joined.mapInArrow(run, schema)


NEW = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def field(name: str) -> Column:
    return F.col("row")[name].alias(name)


def cut_documents(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the remaining text; every row stays."""
    out = with_removals(docs, length, id_col, text_col)
    return out.select(*[F.col("kept").alias(c) if c == text_col else field(c) for c in docs.columns])

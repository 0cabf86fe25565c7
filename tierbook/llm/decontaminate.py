"""Words of documents that lie inside windows of benchmark items, found through an FM-index per shard of documents.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one window.  Words that no item
of the block holds are one symbol that matches nothing; stretches of known words that are shorter than the shortest window
cannot hold one and are not indexed.  Every task indexes its documents shard by shard, searches all windows backwards at
once, locates the rows found and merges the word ranges.

Items are searched in blocks of bounded size, each sent to the tasks; every block is another pass over the documents that
carries on what the passes before it found.  Null texts have no words.  Items that share an id count as one, a null item_id
is the empty string.  Repeated documents each get the same result.  Other columns are passed on; empty tables are fine.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tierbook.llm.common import WORD, lowered, words_of
from tierbook.llm.fmindex import Index

WINDOW = 10
#: Words of documents indexed together in a task.
SHARD_WORDS = 1_500_000
#: Bytes of item text searched in one pass.
BLOCK_BYTES = 8_000_000
FOUND = "n_words long, hits array<struct<begin:long,stop:long>>, items array<string>"


class Windows:
    """The distinct windows of a block of items, by length, with the items that hold each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.numbers: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            for s in range(max(1, len(ids) - window + 1) if ids else 0):
                seen.setdefault(tuple(ids[s : s + window]), set()).add(item)
        self.names = sorted({item for held in seen.values() for item in held})
        place = {name: k for k, name in enumerate(self.names)}
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for w in seen:
            by_length.setdefault(len(w), []).append(w)
        self.groups, lists, self.lengths = [], [], []
        for length, group in sorted(by_length.items()):
            self.groups.append(np.array(group, np.int64))
            lists += [sorted(place[x] for x in seen[w]) for w in group]
            self.lengths += [length] * len(group)
        self.lengths = np.array(self.lengths, np.int64)
        self.items = np.array([k for x in lists for k in x], np.int64)
        self.cuts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0


def expanded(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first[k], first[k] + 1, ... for each k, and the k of each."""
    owner = np.repeat(np.arange(len(first)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + first[owner], owner


def occurrences(ids: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first word, and window, of every occurrence; ids parts documents by 0."""
    none = np.zeros(0, np.int64)
    if not windows.shortest or not len(ids):
        return none, none
    edge = np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]]))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = stop - begin >= windows.shortest
    begin, size = begin[long], (stop - begin)[long]
    if not len(begin):
        return none, none
    place, stretch = expanded(begin, size)
    slot = np.arange(len(place)) + stretch
    text, origin = np.zeros(len(place) + len(begin), np.int64), np.zeros(len(place) + len(begin), np.int64)
    text[slot], origin[slot] = ids[place], place
    index, found, which, base = Index(text, len(windows.numbers)), [], [], 0
    for group in windows.groups:
        low, high = index.search(group)
        rows, pattern = expanded(low, high - low)
        found.append(origin[index.locate(rows)])
        which.append(pattern + base)
        base += len(group)
    return np.concatenate(found), np.concatenate(which)


def _shard(words: list[np.ndarray], windows: Windows) -> Iterator[tuple[list[tuple[int, int]], list[str]]]:
    """Merged word ranges and items of each document of a shard."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    ids = np.zeros(int(sizes.sum()), np.int64)
    for s, w in zip(starts.tolist(), words, strict=True):
        ids[s : s + len(w)] = w
    place, which = occurrences(ids, windows)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + windows.lengths[which], -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8)]))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(starts, begin, "right") - 1
    begin, stop = begin - starts[doc], stop - starts[doc]
    pair = np.unique((np.searchsorted(starts, place, "right") - 1) * max(1, len(windows.lengths)) + which)
    held_by, window = np.divmod(pair, max(1, len(windows.lengths)))
    at, owner = expanded(windows.cuts[window], windows.cuts[window + 1] - windows.cuts[window])
    held = np.unique(held_by[owner] * max(1, len(windows.names)) + windows.items[at])
    item_doc, item = np.divmod(held, max(1, len(windows.names)))
    every = np.arange(len(words) + 1)
    range_cut, item_cut = np.searchsorted(doc, every), np.searchsorted(item_doc, every)
    for k in range(len(words)):
        spans = slice(range_cut[k], range_cut[k + 1])
        names = [windows.names[i] for i in item[item_cut[k] : item_cut[k + 1]].tolist()]
        yield list(zip(begin[spans].tolist(), stop[spans].tolist(), strict=True)), names


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, stop in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((begin, stop))
    return out


def _pass(shared, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        numbers = windows.numbers
        held: list[pa.RecordBatch] = []
        words: list[np.ndarray] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            results = _shard(words, windows)
            at = 0
            for batch in held:
                hits, items = [], []
                for old_hits, old_items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    ranges, names = next(results)
                    if old_hits:
                        ranges = merged(ranges + [(r["begin"], r["stop"]) for r in old_hits])
                    hits.append([{"begin": b, "stop": s} for b, s in ranges])
                    items.append(old_items + names)
                counts = pa.array([len(w) for w in words[at : at + batch.num_rows]], pa.int64())
                at += batch.num_rows
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))
                yield pa.record_batch(
                    [batch.column(0), batch.column(1), counts, pa.array(hits, kind), pa.array(items, pa.list_(pa.string()))],
                    ["row", "text", "n_words", "hits", "items"],
                )

        for batch in batches:
            held.append(batch)
            for text in batch.column(1):
                found = WORD.findall(lowered(text.as_py()))
                words.append(np.fromiter((numbers.get(w, 0) for w in found), np.int32, len(found)))
                total += len(found)
            if total >= shard_words:
                yield from flush()
                held.clear()
                words.clear()
                total = 0
        if held:
            yield from flush()

    return run


def found_in(docs: DataFrame, items: DataFrame, row_columns: list[str], window: int = WINDOW, shard_words: int = SHARD_WORDS,
             block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
             then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, then_schema: StructType | None = None) -> DataFrame:
    """row (the columns asked for), text, n_words, hits (merged word ranges) and items (ids of the items found).

    ``then`` goes on with the batches of the last pass in the same task.
    """
    spark = docs.sparkSession
    bench = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    out = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in row_columns]).alias("row"), F.col(text_col).alias("text"),
        F.array().cast("array<struct<begin:long,stop:long>>").alias("hits"), F.array().cast("array<string>").alias("items"),
    )
    schema = StructType(out.select("row", "text").schema.fields + StructType.fromDDL(FOUND).fields)
    for k in range(blocks):
        # a block holds about block_bytes of text, whatever the number of items
        block = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(Windows([tuple(r) for r in block], window))
        step, last = _pass(shared, shard_words), k == blocks - 1
        if last and then is not None:
            step, schema = _followed(step, then), then_schema
        out = out.select("row", "text", "hits", "items").mapInArrow(step, schema)
    return out


def _followed(first, second):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from second(first(batches))

    return run


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    found = found_in(docs, items, [id_col], **options)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, r: acc + r["stop"] - r["begin"])
    names = F.array_sort(F.array_distinct("items"))
    return found.select(
        F.col("row")[id_col].alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_words(text: str, hits: list[dict]) -> str:
    """The text without the word ranges; what stood between the first and the last word of a range goes with it."""
    raw = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in WORD.finditer(raw.lower())]
    kept, at = [], 0
    for r in hits:
        kept.append(raw[at : spans[r["begin"]][0]])
        at = spans[r["stop"] - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with the words inside benchmark windows cut out; every row stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)
            texts = [without_words(t, h) if h else t for t, h in pairs]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["row", "cut"])

    others = [c for c in docs.columns if c != text_col]
    kind = StructType([docs.schema[c] for c in others])
    schema = StructType().add("row", kind, False).add("cut", "string")
    out = found_in(docs, items, others, text_col=text_col, then=run, then_schema=schema, **options)
    return out.select(*[F.col("cut").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])

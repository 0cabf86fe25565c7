"""Packing of documents with their lexical neighbours, by a sharded BM25 index.

Every id of a document lies in exactly one piece.  A document of more than one window gives as many full windows as it holds; what is left
of it, and every shorter document, is filled into windows together with documents like it: a seed asks the inverted index of its
shard, the unused neighbours follow in the order of their BM25 scores as long as they fit, and the best one that does not fit is
cut to fill the rest of the window; what remains of it is the next seed.  Neighbours of neighbours follow where a seed has too few, the
next document of the shard where nothing is alike.  So no window is padded, but for the last one of a shard; that one is dealt into
sequences of powers of two, which need no padding either.

Terms are the ids of the vocabulary, over the whole document.  Document counts of terms, the number of documents and their mean length are those
of the whole table (per task first, then added up; one row per term reaches the driver, bounded by the vocabulary), so scores in
all shards are alike.  Terms in more than half of the documents weigh nothing.  A seed asks with its ``QUERY_TERMS`` weightiest terms.

Shards: documents go by their weightiest term among those that ``least`` documents hold.  The driver sees one count per term; terms
with few documents share a shard, those with many are spread over several by row number, so no shard gets more than about
twice ``shard_rows`` pieces, each shorter than a window, whatever the key or the number of copies.

Null text is empty: one piece with the end mark alone.  A null doc_id is carried along; repeated rows are packed as often as they occur.
Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierbook.llm.common import stored
from tierbook.llm.gains import slices
from tierbook.llm.wordids import default_vocabulary, encoder

CAPACITY = 4096
END = 2
SHARD_ROWS = 2048
QUERY_TERMS = 64
#: Best-scored unused documents looked at for one seed.
WIDTH = 256
K1, B = 1.2, 0.75
#: Ids are below this; two more places hold the number of documents and of ids.
TERMS = 1 << 16
#: Pieces whose terms are counted at once.
ROWS = 256

PIECES = ("row long, doc_id long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, ids binary, terms binary, counts binary")
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
KINDS = [pa.int64()] * 7 + [pa.binary()] * 3


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4"))


def tokenised(docs: DataFrame, capacity: int, end: int, vocabulary: str | None) -> DataFrame:
    """A row for each full window of docs(doc_id, text), with sequence_id; one for what is left of each document, with its ids (and the
    terms of the whole document if that was cut); and rows of counts, how many documents of some task hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary or default_vocabulary())
        base, row, full = TaskContext.get().partitionId() << 34, 0, 0
        counts = np.zeros(TERMS + 2, np.int64)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                out: list[list] = [[] for _ in KINDS]

                def add(*values) -> None:
                    for column, value in zip(out, values, strict=True):  # noqa: B023
                        column.append(value)

                ids, starts = encode(texts)
                for k, doc in enumerate(batch.column(0).slice(at, len(texts)).to_pylist()):
                    own = np.append(ids[starts[k] : starts[k + 1]], np.uint16(end))
                    n, cut = len(own), len(own) // capacity * capacity
                    terms, times = np.unique(own, return_counts=True)
                    counts[terms] += 1
                    counts[TERMS:] += (1, n)
                    row += 1
                    for start in range(0, cut, capacity):
                        full += 1
                        add(base + row, doc, n, start, capacity, checksum(own[start : start + capacity]), -(base + full), None, None, None)
                    if cut < n:
                        whole = np.concatenate([terms.astype("<u4"), times.astype("<u4")]).tobytes() if cut else None
                        add(base + row, doc, n, cut, n - cut, None, None, own[cut:].astype("<u2").tobytes(), whole, None)
                yield pa.record_batch([pa.array(v, t) for v, t in zip(out, KINDS, strict=True)], PIECES.replace(" long", "").replace(" binary", "").split(", "))
        if counts[TERMS]:
            last = [[None]] * 9 + [[counts.astype("<i8").tobytes()]]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(last, KINDS, strict=True)], PIECES.replace(" long", "").replace(" binary", "").split(", "))

    return docs.mapInArrow(run, PIECES)


def document_counts(pieces: DataFrame) -> np.ndarray:
    """How many documents hold each term; the last two places are the number of documents and of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 2, np.int64)
        for batch in batches:
            for counts in batch.column(0):
                total += np.frombuffer(counts.as_buffer(), "<i8")
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], ["term", "n"])

    parts = pieces.where("counts is not null").select("counts").mapInArrow(run, "term long, n long")
    out = np.zeros(TERMS + 2, np.int64)
    for term, n in parts.groupBy("term").agg(F.sum("n")).collect():  # at most one row per term
        out[term] = n
    return out


class Weights:
    """BM25 over the whole table."""

    def __init__(self, counts: np.ndarray):
        n = max(1, int(counts[TERMS]))
        self.held = counts[:TERMS]
        self.idf = np.maximum(0, np.log((n - self.held + 0.5) / (self.held + 0.5))).astype(np.float32)
        self.mean = max(1.0, counts[TERMS + 1] / n)

    def of(self, terms: np.ndarray, times: np.ndarray, tokens: int) -> np.ndarray:
        damped = times + K1 * (1 - B + B * tokens / self.mean)
        return self.idf[terms] * (times * (K1 + 1) / damped).astype(np.float32)


def terms_of(ids: np.ndarray, whole: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if whole is None:
        return np.unique(ids, return_counts=True)
    both = np.frombuffer(whole, "<u4")
    return both[: len(both) // 2], both[len(both) // 2 :]


def weightiest(batch: pa.RecordBatch, weights: Weights, asked: np.ndarray) -> np.ndarray:
    """The weightiest term of each piece among those asked for (of equal ones the first), TERMS if none weighs.  Terms of all pieces are
    counted at once, as numbers of piece and term."""
    out = np.full(batch.num_rows, TERMS, np.int64)
    parts, places, times = [], [], []
    for k, (ids, whole) in enumerate(zip(batch.column("ids"), batch.column("terms"), strict=True)):
        if whole.is_valid:
            terms, n = terms_of(np.zeros(0, np.uint16), whole.as_py())
            places.append(terms[asked[terms]] + np.uint32(k * TERMS))
            times.append(n[asked[terms]])
        else:
            terms = np.frombuffer(ids.as_buffer(), "<u2")
            parts.append(terms[asked[terms]] + np.uint32(k * TERMS))
    if parts:
        found, n = np.unique(np.concatenate(parts), return_counts=True)
        places.append(found)
        times.append(n)
    place = np.concatenate(places) if places else np.zeros(0, np.uint32)
    if not len(place):
        return out
    order = np.argsort(place)
    piece, term, n = place[order] // TERMS, place[order] % TERMS, np.concatenate(times)[order].astype(np.int64)
    weight = weights.of(term, n, batch.column("doc_tokens").to_numpy()[piece])
    begins = np.flatnonzero(np.diff(piece.astype(np.int64), prepend=-1))
    best = np.repeat(np.maximum.reduceat(weight, begins), np.diff(np.append(begins, len(piece))))
    top = np.flatnonzero((weight == best) & (weight > 0))[::-1]
    out[piece[top]] = term[top]  # backwards, so that the first stays
    return out


def deal(counts: dict[int, int], shard_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard of each key, and over how many shards it is spread.  Key TERMS stands for none."""
    first, spread = np.zeros(TERMS + 1, np.int64), np.ones(TERMS + 1, np.int64)
    shard, filled = 0, 0
    for key, n in sorted(counts.items()):
        if n > shard_rows:
            shard += filled > 0
            first[key], spread[key] = shard, -(-n // shard_rows)
            shard, filled = shard + int(spread[key]), 0
            continue
        if filled + n > shard_rows:
            shard, filled = shard + 1, 0
        first[key], filled = shard, filled + n
    return first, spread


def sharded(pieces: DataFrame, counts: np.ndarray, shard_rows: int) -> DataFrame:
    """The unfinished pieces with their key and shard."""
    open_ = pieces.where("ids is not null").select("row", "doc_id", "doc_tokens", "start", "ids", "terms")
    shared = pieces.sparkSession.sparkContext.broadcast(counts)
    least = min(shard_rows, int(counts[TERMS])) // 16

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        """The weightiest term of each piece among those that enough documents hold (of equal ones the first), TERMS if none weighs."""
        weights = Weights(shared.value)
        asked = (weights.held >= least) & (weights.idf > 0)
        return np.concatenate([weightiest(batch.slice(at, ROWS), weights, asked) for at in range(0, batch.num_rows, ROWS)] or [np.zeros(0, np.int64)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            found.update(keys(batch).tolist())
        yield pa.record_batch([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["key", "n"])

    per_key = open_.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n"))
    dealt = pieces.sparkSession.sparkContext.broadcast(deal({k: n for k, n in per_key.collect()}, shard_rows))  # noqa: C416

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, spread = dealt.value
        for batch in batches:
            key = keys(batch)
            # neighbouring row numbers go to different shards of their key
            shard = first[key] + batch.column("row").to_numpy() % spread[key]
            yield pa.record_batch([*batch.columns, pa.array(key), pa.array(shard)], [*batch.schema.names, "key", "shard"])

    return open_.mapInArrow(place, "row long, doc_id long, doc_tokens long, start long, ids binary, terms binary, key long, shard long")


class Index:
    """Inverted index of one shard: for each term the documents that hold it, with their weights."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors = vectors
        term = np.concatenate([t for t, _ in vectors]).astype(np.uint16)
        doc = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], np.concatenate([w for _, w in vectors])[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=TERMS))])

    def neighbours(self, doc: int, unused: np.ndarray, terms: int, width: int) -> np.ndarray:
        """Unused documents with a positive score, best first."""
        asked, weight = self.vectors[doc]
        if len(asked) > terms:
            asked = asked[np.argpartition(-weight, terms)[:terms]]
        if not len(asked):
            return np.zeros(0, np.int64)
        lists = [slice(self.at[t], self.at[t + 1]) for t in asked.tolist()]
        hits, gained = np.concatenate([self.doc[x] for x in lists]), np.concatenate([self.weight[x] for x in lists])
        scores = np.bincount(hits, gained, len(unused)) * unused
        found = np.flatnonzero(scores)
        if len(found) > width:
            found = found[np.argpartition(-scores[found], width)[:width]]
        return found[np.argsort(-scores[found], kind="stable")]


def windows(lengths: list[int], index: Index, capacity: int, terms: int = QUERY_TERMS, width: int = WIDTH) -> Iterator[list[tuple[int, int, int]]]:
    """Segments (document, start, length) of each window in turn; all but the last fill it."""
    n = len(lengths)
    begun, unused = [0] * n, np.ones(n, bool)
    following, seed = 0, None

    def take(doc: int, room: int) -> tuple[int, int, int]:
        start = begun[doc]
        size = min(room, lengths[doc] - start)
        begun[doc] += size
        unused[doc] = begun[doc] < lengths[doc]
        return doc, start, size

    while True:
        window, room, asking = [], capacity, []
        while room:
            if seed is None and not asking:  # nothing alike is left: go on in the order of the shard
                while following < n and not unused[following]:
                    following += 1
                if following == n:
                    break
                seed = following
            if seed is not None:
                window.append(take(seed, room))
                room -= window[-1][2]
                asking, seed = [seed], None
            doc, large = asking.pop(0), None
            for other in index.neighbours(doc, unused, terms, width).tolist() if room else ():
                if lengths[other] - begun[other] <= room:
                    window.append(take(other, room))
                    room -= window[-1][2]
                    asking.append(other)
                    if not room:
                        break
                elif large is None:
                    large = other
            if room and large is not None:
                window.append(take(large, room))
                room = 0
        if not window:
            return
        yield window
        last = window[-1][0]
        seed = last if unused[last] else None


def powers(window: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The segments dealt into sequences whose lengths are the powers of two of the whole."""
    left, segments = sum(s[2] for s in window), list(reversed(window))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        part = []
        while room:
            doc, start, size = segments.pop()
            now = min(size, room)
            part.append((doc, start, now))
            if now < size:
                segments.append((doc, start + now, size - now))
            room -= now
        yield part


def _pack_shard(shared, capacity: int, terms: int, width: int):
    def run(group: pa.Table) -> pa.Table:
        weights = Weights(shared.value)
        group = group.sort_by([("key", "ascending"), ("row", "ascending")])
        ids = [np.frombuffer(x.as_buffer(), "<u2") for x in group["ids"]]
        docs, tokens, first = (group[c].to_pylist() for c in ("doc_id", "doc_tokens", "start"))
        vectors = []
        for own, whole, n in zip(ids, group["terms"], tokens, strict=True):
            held, times = terms_of(own, whole.as_py())
            weight = weights.of(held, times, n)
            vectors.append((held[weight > 0], weight[weight > 0]))
        base, sequence = group["shard"][0].as_py() << 24, 0
        out: list[list] = [[] for _ in range(7)]
        for window in windows([len(x) for x in ids], Index(vectors), capacity, terms, width):
            whole = sum(s[2] for s in window) == capacity
            for part in [window] if whole else powers(window):
                offset = 0
                for doc, start, size in part:
                    values = (docs[doc], first[doc] + start, size, checksum(ids[doc][start : start + size]), tokens[doc], base + sequence, offset)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    offset += size
                sequence += 1
        return pa.table([pa.array(v, pa.int64()) for v in out], PACKED.replace(" long", "").split(", "))

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None, shard_rows: int = SHARD_ROWS,
           terms: int = QUERY_TERMS, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stored(tokenised(rows, capacity, end, vocabulary), "pieces")
    counts = document_counts(pieces)
    shared = pieces.sparkSession.sparkContext.broadcast(counts)
    filled = sharded(pieces, counts, shard_rows).groupBy("shard").applyInArrow(_pack_shard(shared, capacity, terms, width), PACKED)
    full = pieces.where("sequence_id is not null").withColumn("offset", F.lit(0).cast("long"))
    return full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").union(filled)

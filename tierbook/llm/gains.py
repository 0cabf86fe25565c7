"""Importance resampling towards a target distribution by gains of hashed word n-grams.

Features are all runs of one to three consecutive words of a text, repeats counted; a feature's bucket is the CRC-32 of its
UTF-8 bytes (words joined by one space) modulo ``buckets``.  With S features in all documents, s of them in a bucket, and T and t
for the target texts, the gain of a bucket is floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))).  A document weighs the
sum of the gains of its features; its score is the weight plus Gumbel noise from a hash of its id, and the highest scores among the
documents of at least ``least_words`` words are drawn.

In a task: ascii_lower, split_pattern_regex, list_flatten and dictionary_encode give the words of a batch as dictionary indices;
shifted indices are pairs, distinct pairs get the CRC-32 of their text from those of their parts, shifted again they give the
runs of three; take spreads buckets and gains over all places and sums over segments give the weights.  Texts are read
twice, once for the bucket counts (added up per task, at most ``buckets`` rows each) and once for the weights.

Null or empty texts have no features and weight 0.  A null doc_id is hashed as an empty string and comes last among equals.
Repeated rows count, and may be drawn, as often as they occur; equal scores go by doc_id, then by the number of features.  Other
columns are ignored.  An empty table gives no rows; without target texts T and t are 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierbook.llm.common import by_batch, stored
from tierbook.llm.order import numbered

#: Everything that is no digit, no ASCII letter and inside ASCII; letters are lower-cased before.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Text handled at a time inside a task, in bytes; one text is never split.
SLICE = 4_000_000


def _shifts(most: int) -> np.ndarray:
    """[n, k, b]: what byte b in place k of a CRC register turns into when n zero bytes follow."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    out = np.empty((most + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(most):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ step[out[n] & np.uint32(255)]
    return out


SHIFTS = _shifts(64)


def appended(first: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings after one another, from the CRCs of both and the length of the second."""
    reg, left, most = first.copy(), length.copy(), len(SHIFTS) - 1
    while True:
        now = np.minimum(left, most)
        reg = (SHIFTS[now, 0, reg & np.uint32(255)] ^ SHIFTS[now, 1, (reg >> np.uint32(8)) & np.uint32(255)]
               ^ SHIFTS[now, 2, (reg >> np.uint32(16)) & np.uint32(255)] ^ SHIFTS[now, 3, reg >> np.uint32(24)])
        left = left - now
        if not left.any():
            return reg ^ tail


def slices(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of runs of at most ``most`` bytes (SLICE by default), or of one text."""
    most = most or SLICE
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
        yield at, texts.slice(at, end - at)
        at = end


def grams(texts: pa.Array, longest: int = LONGEST) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of words of each text, and for each n-gram length the row and the CRC-32 of every n-gram, in row order."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    row, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    full = pc.greater(pc.binary_length(words), 0)
    row, words = pc.filter(row, full).to_numpy(), pc.filter(words, full).dictionary_encode()
    index, each = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
    raw = [w.encode() for w in each]
    alone = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in raw), np.uint32, len(raw))
    length = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    out = [(row, alone.take(index))]
    # ids of the n-grams that start at each place, and the CRC of each id
    ids, crcs = index, alone
    for n in range(2, longest + 1):
        if len(index) < n:
            out.append((row[:0], crcs[:0]))
            continue
        whole = row[: 1 - n] == row[n - 1 :]
        both = pa.array(ids[: len(index) - n + 1] * max(1, len(each)) + index[n - 1 :]).dictionary_encode()
        pairs = both.dictionary.to_numpy()
        head, tail = pairs // max(1, len(each)), pairs % max(1, len(each))
        ids, crcs = both.indices.to_numpy().astype(np.int64), appended(crcs.take(head), spaced.take(tail), length.take(tail))
        out.append((row[: 1 - n][whole], crcs.take(ids[whole])))
    return np.bincount(row, minlength=len(texts)), out


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features in each bucket over the column ``text``; a task adds up before it hands anything on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, some in slices(batch.column(0)):
                for _, crcs in grams(some, longest)[1]:
                    counts += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.collect():  # at most one row per bucket
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    n = len(raw)
    return np.floor(1000 * np.log((target + 1) * float(raw.sum() + n) / ((raw + 1) * float(target.sum() + n)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        gain, n = shared.value, batch.num_rows
        words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
        for at, some in slices(batch.column(1)):
            counted, found = grams(some, longest)
            words[at : at + len(some)] = counted
            for row, crcs in found:
                sums = np.concatenate([[0], np.cumsum(gain.take(crcs % np.uint32(len(gain))))])
                ends = np.searchsorted(row, np.arange(len(some) + 1))
                features[at : at + len(some)] += np.diff(ends)
                weight[at : at + len(some)] += np.diff(sums[ends])
        return pa.record_batch([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return by_batch(docs.select("doc_id", "text"), "doc_id long, n_words long, n_features long, weight long", rows)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED,
              longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where not drawn) of every document; ``target`` has the column ``text``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gain = gains(bucket_counts(rows, buckets, longest), bucket_counts(target, buckets, longest))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000.0 * F.log(-F.log(uniform)))
    found = weighed(rows, gain, longest).select("*", (F.col("weight") + noise).cast("long").alias("score"))
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "weights")
    long = F.col("n_words") >= least_words
    drawn = found.where(long).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("row")]
    placed = numbered(found.where(long), order).withColumn("rank", F.when(F.col("position") < drawn, F.col("position") + 1))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return placed.select(*columns, "rank").union(found.where(~long).select(*columns, F.lit(None).cast("long").alias("rank")))

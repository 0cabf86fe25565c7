"""Quality selection by importance resampling.

Two generative models over hashed word n-grams, one of target texts and one of all texts, give every document the log ratio
of its likelihoods.  Documents are drawn without replacement by Gumbel top-k: the ratio plus Gumbel noise, the k largest
kept.  Both models count every n-gram of all their documents in tasks; only the bucket totals meet.

Tokens are words (A-Z lower-cased) and runs of other marks; features are tokens and neighbouring pairs.  The ratio is divided
by the number of features (``mean``), so that long texts are not favoured for their length alone, and weighed by
``sharpness``.  The noise comes from a hash of doc_id and text with a seed: runs agree, and repeated rows get equal keys.

Null or empty texts have no features and ratio 0.  Rows without doc_id are selected like others.  Equal keys at the border
are all kept.  Without target texts all ratios are 0.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierbook.llm.common import by_batch, lowered, stored

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\s]+")
BUCKETS = 65_536
SHARPNESS = 200.0
SEED = 42
#: Ids of target documents are broadcast up to this many (16 bytes each); beyond, texts are shuffled by id.
BROADCAST_IDS = 2_000_000
#: Share of the documents drawn.
FRACTION = 0.5
#: Added to every bucket of both models.
SMOOTHING = 1.0


class Hashes(dict):
    """Hash of each token, remembered up to a bounded number."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[token] = zlib.crc32(token)
        return value


def features(text: str | None, hashes: Hashes, buckets: int) -> np.ndarray:
    """Buckets of the tokens and of their neighbouring pairs."""
    tokens = TOKEN.findall(lowered(text))
    one = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
    two ^= two >> np.uint64(29)
    return np.concatenate([one, two]).astype(np.uint64) % np.uint64(buckets)


def totals(docs: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in the column ``text``; a task adds up before it hands anything on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = Hashes(), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts += np.bincount(features(text.as_py(), hashes, buckets), minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.collect():  # at most one row per bucket
        out[bucket] = n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(target))

    def model(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * len(counts)))

    return model(target) - model(raw)


def weighted(docs: DataFrame, ratio: np.ndarray, seed: int = SEED, sharpness: float = SHARPNESS) -> DataFrame:
    """doc_id, log_weight (mean log ratio) and key (weight plus Gumbel noise)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    hashes = Hashes()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights = []
        for text in batch.column(1):
            found = features(text.as_py(), hashes, len(shared.value))
            weights.append(float(shared.value[found].mean()) if len(found) else 0.0)
        return pa.record_batch([batch.column(0), batch.column(2), pa.array(weights, pa.float64())], ["doc_id", "mark", "log_weight"])

    mark = F.xxhash64("doc_id", "text", F.lit(seed))
    found = by_batch(docs.select("doc_id", "text", mark), "doc_id long, mark long, log_weight double", rows)
    # 53 bits of the hash as a number inside (0, 1)
    uniform = (F.shiftrightunsigned("mark", 11).cast("double") + 0.5) / float(1 << 53)
    gumbel = -F.log(-F.log(uniform))
    return found.select("doc_id", "log_weight", (F.col("log_weight") * sharpness + gumbel).alias("key"))


def threshold(keys: DataFrame, k: int, bins: int = 4096, few: int = 20_000) -> float:
    """The k-th largest key, by counts in ever finer bins; only bin counts and at last a few keys reach the driver."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            return low
        binned = inside.groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1)).alias("bin"))
        counts = {r["bin"]: r for r in binned.agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        for b in sorted(counts, reverse=True):
            if counts[b]["n"] >= k:
                break
            k -= counts[b]["n"]
        low, high = counts[b]["low"], counts[b]["high"]
        if counts[b]["n"] <= few:
            kept = keys.where((F.col("key") >= low) & (F.col("key") <= high)).select("key").collect()
            return sorted((r[0] for r in kept), reverse=True)[k - 1]


def select(docs: DataFrame, target: DataFrame, fraction: float = FRACTION, buckets: int = BUCKETS, seed: int = SEED,
           sharpness: float = SHARPNESS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight, key and selected for every document; ``target`` has the column ``text``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ratio = log_ratio(totals(target, buckets), totals(rows, buckets))
    found = stored(weighted(rows, ratio, seed, sharpness), "weights")
    k = round(found.count() * fraction)
    if not k:
        return found.withColumn("selected", F.lit(False))
    return found.withColumn("selected", F.col("key") >= threshold(found, k))


def texts_of(docs: DataFrame, ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """The texts of the documents whose doc_id is in ``ids``."""
    ids = stored(ids.select("doc_id").distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= limit else ids, "doc_id", "left_semi").select("text")

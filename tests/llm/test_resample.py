import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tierbook.llm import resample


def test_models_and_sample_against_plain_counts(spark):
    rows = [(k, f"the good text number {k} , with words") for k in range(60)] + [(100 + k, f"junk !!! junk {k} $$$ junk") for k in range(60)]
    rows += [(300, None), (301, ""), (None, "the good text"), (7, rows[7][1])]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, key double").repartition(3)
    target = docs.where("doc_id < 60").select("text")
    buckets = 512

    def grams(text):
        one = [zlib.crc32(t) for t in re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\s]+", (text or "").encode().lower())]
        out = list(one)
        for a, b in zip(one, one[1:], strict=False):
            h = (a * 0x9E3779B97F4A7C15 + b) % 2**64
            out.append(h ^ h >> 29)
        return [h % buckets for h in out]

    def counts(texts):
        return np.bincount([g for t in texts for g in grams(t)], minlength=buckets)

    raw, good = counts(t for _, t in rows), counts(t for i, t in rows if i is not None and i < 60)
    assert resample.totals(docs, buckets).tolist() == raw.tolist()
    assert resample.totals(target, buckets).tolist() == good.tolist()
    ratio = np.log((good + 1) / (good.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    found = resample.select(docs, target, 0.5, buckets).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is not None:
            g = grams(dict(rows)[r["doc_id"]])
            assert math.isclose(r["log_weight"], ratio[g].mean() if g else 0.0, abs_tol=1e-12)
    k = round(len(rows) / 2)
    assert sorted((r["key"] for r in found), reverse=True)[:k] == sorted((r["key"] for r in found if r["selected"]), reverse=True)[:k]
    chosen = {r["doc_id"] for r in found if r["selected"]}
    assert len(chosen & set(range(60))) >= 55 and not chosen & set(range(100, 160))
    assert resample.select(docs.limit(0), target).collect() == []
    assert all(r["log_weight"] == 0 for r in resample.select(docs, target.limit(0)).collect())


def test_gumbel_keys_draw_in_proportion(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("text"))
    ratio = np.zeros(16)
    ratio[zlib.crc32(b"a") % 16] = math.log(3) / resample.SHARPNESS
    top = resample.weighted(docs, ratio).orderBy(F.col("key").desc()).limit(400)
    share = top.where("doc_id % 2 = 0").count() / 400
    assert abs(share - 0.75) < 0.08


def test_threshold_is_exact_whatever_the_bins(spark):
    rng = np.random.default_rng(0)
    keys = [float(x) for x in np.concatenate([rng.normal(size=500), rng.normal(size=500) * 1e6, [3.0] * 300])]
    frame = spark.createDataFrame([(x,) for x in keys], "key double")
    for k in (1, 2, 300, 700, 1300):
        assert resample.threshold(frame, k, bins=8, few=5) == sorted(keys, reverse=True)[k - 1]


def test_target_texts_by_either_join(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    ids = spark.createDataFrame([(2,), (2,), (None,), (9,)], "doc_id long")
    for limit in (0, 10):
        assert sorted(r[0] for r in resample.texts_of(docs, ids, limit).collect()) == ["b", "c"]

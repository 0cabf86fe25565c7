"""Gains, weights, scores and the draw against plain counts of whole texts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tierbook.llm import gains


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(text):
    w = words(text)
    return [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def plain(rows, target, percent, buckets):
    raw, good = [0] * buckets, [0] * buckets
    for counts, texts in ((raw, [t for _, t in rows]), (good, target)):
        for text in texts:
            for f in features(text):
                counts[zlib.crc32(f.encode()) % buckets] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(raw) + buckets) / ((s + 1) * (sum(good) + buckets)))) for s, t in zip(raw, good, strict=True)]
    out = []
    for doc, text in rows:
        found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(words(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    long = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = long[: percent * len(long) // 100]
    return out, drawn


def corpus():
    rng = random.Random(5)
    some = ["alpha", "Beta", "gamma", "été", "Ünder", "x1", "9", "日本", "a" * 90, "b" * 300]
    rows = [(k, rng.choice([" ", "-", "\n\t", "__"]).join(rng.choices(some, k=rng.randrange(0, 60)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, "!!! ..."), (None, rows[0][1]), (None, rows[7][1]), (7, rows[7][1]), (7, rows[8][1]), (203, "one"), (204, "one two"), (205, "\x00a\x7fb ")]
    rows += [(300 + k, rows[3][1]) for k in range(20)] + [(400, "Alpha " * 30_000)]
    return rows


@pytest.mark.parametrize("slice_bytes", [300, gains.SLICE])
def test_against_plain_counts(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(gains, "SLICE", slice_bytes)
    rows, target = corpus(), ["beta gamma gamma", None, "", "alpha été x1 x1"]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, score int").repartition(3)
    found = gains.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=30, buckets=500).collect()
    every, drawn = plain(rows, target, 30, 500)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in found), key=key) == sorted(every, key=key)
    assert [tuple(r)[:5] for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, len(drawn) + 1))


def test_crc_of_joined_strings():
    rng = np.random.default_rng(1)
    a, b = [rng.bytes(n) for n in (0, 1, 5, 70, 1000)], [rng.bytes(n) for n in (1, 64, 65, 5000, 128)]
    crc = lambda items: np.array([zlib.crc32(x) for x in items], np.uint32)
    assert gains.appended(crc(a), crc(b), np.array([len(x) for x in b])).tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]


def test_slices_cover_all_rows():
    texts = pa.array(["a" * 5, None, "", "b" * 50, "c", None])
    for most in (1, 5, 6, 100):
        parts = list(gains.slices(texts, most))
        assert sum((p.to_pylist() for _, p in parts), []) == texts.to_pylist()
        assert [at for at, _ in parts] == np.cumsum([0] + [len(p) for _, p in parts])[:-1].tolist()


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert gains.resampled(docs.limit(0), docs.select("text")).collect() == []
    assert gains.resampled(docs, docs.select("text").limit(0), percent=100).collect()[0]["rank"] == 1
    assert gains.resampled(docs.selectExpr("doc_id", "cast(null as string) as text"), docs.select("text")).collect()[0]["weight"] == 0

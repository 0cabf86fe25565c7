"""Bucketed window helpers against brute force, with one key that holds most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tierbook.operators import forwarding as W
from tierbook.operators import ordered as O
from tierbook.operators import transfer as T


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    stamps = [rng.randrange(0, 40_000) for _ in range(400)] + [100, 100, 100, 90_000]
    return [("hot" if i % 3 else f"k{i % 5}", ts, i) for i, ts in enumerate(stamps)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, ts bigint, n bigint")


def by_key(rows):
    out = {}
    for key, ts, n in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(key, []).append((ts, n))
    return out


def test_numbered(frame, rows):
    got = {(r.key, r.n): r.rn for r in O.numbered(frame, ["key"], ["ts", "n"], O.split_by(F.col("ts"), 500)).collect()}
    want = {(k, n): i for k, items in by_key(rows).items() for i, (_, n) in enumerate(items, 1)}
    assert got == want


def test_previous(frame, rows):
    got = {(r.key, r.n): r.prev for r in O.previous(frame, ["key"], "ts", O.split_by(F.col("ts"), 500), tie=["n"]).collect()}
    want = {}
    for key, items in by_key(rows).items():
        before = None
        for ts, n in items:
            want[key, n] = before
            before = ts
    assert got == want


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("gap", [50, 300, 5000])
def test_sessions(frame, rows, gap, closed):
    got = {(r.key, r.n): r.session_start for r in O.sessions(frame, ["key"], "ts", gap, 500, closed).collect()}
    want = {}
    for key, items in by_key(rows).items():
        start = before = None
        for ts, n in items:
            if before is None or (ts - before > gap if closed else ts - before >= gap):
                start = ts
            want[key, n], before = start, ts
    assert got == want


def test_allocate_ids(spark):
    frame = spark.range(1000).select(F.concat(F.lit("name"), F.col("id").cast("string")).alias("name"))
    ids = sorted(r.id for r in O.allocate_ids(frame, ["name"], F.lit(11), 16).collect())
    assert ids == list(range(11, 1011))


def test_incoming_counters_follow_the_fold(spark):
    rng = random.Random(3)
    rows = [(1, t, s, s if rng.random() < 0.8 else None, rng.random() < 0.5, rng.randrange(1, 12), s * 10)
            for t in range(6) for s in range(1, rng.randrange(3, 15))]
    frame = spark.createDataFrame(
        rows, "box_id bigint, transaction_id bigint, sequence bigint, image_id bigint, added boolean, total bigint, ts_ms bigint")
    got = {r.transaction_id: (r.received, r.added, r.total, r.members) for r in T.incoming_progress(frame).collect()}
    want = {}
    for row in rows:
        received, added, _, members = want.get(row[1], (0, 0, 0, 0))
        want[row[1]] = (min(row[5], received + 1), min(row[5], added + 1) if row[4] else added, row[5],
                        members + (row[3] is not None))
    assert got == want


def test_throttle(spark):
    frame = spark.createDataFrame([(1, 100_000), (1, 110_000), (1, 130_000), (2, 130_000)], "box bigint, ts bigint")
    got = {(r.box, r.ts) for r in T.throttle_failures(frame, ["box"], "ts", 15_000, 20_000).collect()}
    assert got == {(1, 100_000), (1, 130_000), (2, 130_000)}


def test_finalise(spark):
    rules = spark.createDataFrame(
        [(1, "box", 1, True), (2, "box", 1, False), (3, "box", 2, False)],
        "rule_id bigint, sourcetype string, sourceid bigint, keep_images boolean")

    def run(states):
        flagged = spark.createDataFrame(states, "rule_id bigint, session_start bigint, delivered boolean")
        return {(r.rule_id, r.session_start, r.action) for r in W.finalise(flagged, rules).collect()}

    assert run([(1, 0, True), (2, 0, False)]) == {(1, 0, "remove")}
    assert run([(1, 0, True), (2, 0, True)]) == {(1, 0, "remove"), (2, 0, "delete")}
    assert run([(1, 0, False), (2, 0, True), (3, 0, True), (9, 0, True)]) == {(3, 0, "delete")}


def test_incoming_status_and_outgoing_progress(spark):
    totals = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "transaction_id bigint, total bigint")
    sent = spark.createDataFrame([(1,), (1,), (1,), (2,)], "transaction_id bigint")
    got = {r.transaction_id: (r.sent_count, r.status) for r in T.outgoing_progress(totals, sent).collect()}
    assert got == {1: (2, "FINISHED"), 2: (1, "PROCESSING"), 3: (0, "WAITING")}


def test_width_follows_the_fullest_bucket(spark):
    burst = spark.range(5000).selectExpr("'hot' as k", "86400000 + id * 3 as ts").union(spark.range(50).selectExpr("'cold'", "id * 40000000"))
    width = O.fitting_width(burst, ["k"], "ts", 86_400_000, rows=200)
    fullest = burst.groupBy("k", O.split_by(F.col("ts"), width)).count().agg(F.max("count")).first()[0]
    assert fullest <= 200 and width >= 100
    assert O.fitting_width(burst, ["k"], "ts", 86_400_000) == 86_400_000 == O.fitting_width(burst.limit(0), ["k"], "ts", 86_400_000)
    same = [{tuple(r) for r in O.sessions(burst, ["k"], "ts", 1000, w).collect()} for w in (width, 86_400_000)]
    assert same[0] == same[1]

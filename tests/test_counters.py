"""Keyed state against the batch operator: changing totals, repeated numbers, timers, several triggers and a restart."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tierbook.operators import transfer as T
from tierbook.streaming import counters as C
from tierbook.streaming import jobs as J

KIND = "box_id long, transaction_id long, sequence long, image_id long, added boolean, total long, ts_ms long"


def rows_of(seed: int, n: int = 400) -> list[tuple]:
    rng = random.Random(seed)
    out = [(rng.randrange(2), rng.randrange(12), rng.choice([rng.randrange(9), rng.randrange(3000)]), rng.choice([None, k]), rng.random() < 0.6, rng.randrange(1, 25), 100 * k)
           for k in range(n)]
    return [(box, tx, seq, image, added, total, ts - (ts % 7000 if tx < 3 else 0)) for box, tx, seq, image, added, total, ts in out]


def twin(spark, rows, timeout):
    """The batch operator, and the timeout at the latest arrival."""
    events = spark.createDataFrame(rows, KIND)
    moved = events.groupBy(*C.KEY).agg(F.max("ts_ms").alias("updated"))
    state = T.time_out(T.incoming_progress(events).join(moved, C.KEY), max(r[-1] for r in rows), timeout)
    return sorted(tuple(r) for r in state.select(*C.KEY, "received", "added", "total", "sequences", "members", "status", "updated").collect())


def test_equals_the_batch_operator_over_triggers_and_a_restart(spark, tmp_path):
    rows = sorted(rows_of(1), key=lambda r: (r[-1], r[2]))
    # arrivals of one time share a trigger
    cuts = sorted({next(k for k in range(c, len(rows)) if rows[k][-1] != rows[k - 1][-1]) for c in (60, 130, 210, 300, 350)})
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    folder, work = str(tmp_path / "in"), str(tmp_path / "job")
    timeout = 4000

    def go(new):
        for k, part in new:
            random.Random(k).shuffle(part)
            spark.createDataFrame(part, KIND).coalesce(1).write.parquet(f"{folder}/{k:03d}")
        C.run(J.watch_files(spark, folder, spark.createDataFrame([], KIND).schema, max_files=1), work, timeout)

    numbered = list(enumerate(parts))
    go(numbered[:4])
    go(numbered[4:])
    deltas = J.read_deltas(spark, work)
    found = sorted(tuple(r) for r in C.current(deltas).select(*C.KEY, "received", "added", "total", "sequences", "members", "status", "updated_ms").collect())
    assert found == twin(spark, rows, timeout)
    assert {r[7] for r in found} >= {"FINISHED", "WAITING"}
    # versions count up without a gap, over the restart too
    per = deltas.groupBy(*C.KEY).agg(F.max("version").alias("last"), F.count("*").alias("n"), F.count_distinct("version").alias("d")).collect()
    assert all(r["last"] == r["n"] == r["d"] for r in per)
    # whoever moved again after it waited is in process or finished again
    steps = [(*r[:2], r["version"], r["status"]) for r in deltas.orderBy(*C.KEY, "version").collect()]
    assert any(a[:2] == b[:2] and a[3] == "WAITING" and b[3] != "WAITING" for a, b in zip(steps, steps[1:], strict=False))


def test_capped_count_is_that_of_row_by_row():
    rng = np.random.default_rng(3)
    for _ in range(200):
        totals, count = rng.integers(0, 9, rng.integers(0, 30)), int(rng.integers(0, 9))
        plain = count
        for t in totals:
            plain = min(plain + 1, int(t))
        assert C.capped(count, totals) == plain


def test_bitmaps_count_numbers_once_and_keep_the_last_member():
    seen = held = b""
    numbers, members, plain = 0, 0, {}
    rng = np.random.default_rng(4)
    for _ in range(50):
        places, member = rng.integers(0, 40, 12), rng.random(12) < 0.5
        seen, held, more, kept = C.marked(seen, held, places, member)
        numbers, members = numbers + more, members + kept
        plain |= dict(zip(places.tolist(), member.tolist(), strict=True))
        assert (numbers, members) == (len(plain), sum(plain.values()))

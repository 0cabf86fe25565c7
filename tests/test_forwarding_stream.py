"""The forwarding streams against their batch twins, over several triggers and a restart."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F

from tierbook.operators import forwarding as W
from tierbook.streaming import forwarding as S
from tierbook.streaming import jobs as J

IDLE, DELAY = 30_000, 5_000
CAME = "event_id long, image_id long, ts timestamp, sourcetype string, sourceid long"
SENT = "destinationtype string, destinationid long, image_id long, ts timestamp"


def when(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)


def test_members_and_deliveries_equal_the_batch_twins(spark, tmp_path):
    rng = random.Random(6)
    rules = spark.createDataFrame(
        [(1, "box", 1, "scu", 7, True), (2, "box", 1, "box", 8, False), (3, "scp", 2, "scu", 7, False), (4, "scp", 3, "scu", 9, True)],
        "rule_id long, sourcetype string, sourceid long, destinationtype string, destinationid long, keep_images boolean")
    ms, came = 1_000_000, []
    for k in range(600):
        ms += rng.choice([0, 100, 4_000, 20_000, 31_000] if k % 9 else [90_000])
        came.append((k, rng.randrange(40), ms, *rng.choice([("box", 1)] * 6 + [("scp", 2), ("scp", 3), ("user", 1)])))
    sent = [(*rng.choice([("scu", 7), ("box", 8), ("scu", 9)]), rng.randrange(60), when(1_000_000 + 90_000 * k)) for k in range(60)]
    work = str(tmp_path / "job")

    def put(folder, number, rows, kind):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / folder / f"{number:03d}"))

    def go():
        read = lambda folder, kind: J.watch_files(spark, str(tmp_path / folder), spark.createDataFrame([], kind).schema, 1)
        S.run(read("came", CAME), read("sent", SENT), rules, work, f"{IDLE} milliseconds", f"{DELAY} milliseconds")

    for number in range(3):
        put("came", number, [(k, i, when(t), *s) for k, i, t, *s in came[number * 150 : number * 150 + 150]], CAME)
        put("sent", number, sent[number * 20 : number * 20 + 20], SENT)
    go()
    put("came", 3, [(k, i, when(t), *s) for k, i, t, *s in came[450:]], CAME)
    go()

    now = max(t for _, _, t, *_ in came) - DELAY
    arrivals = spark.createDataFrame([(k, i, t, *s) for k, i, t, *s in came], "event_id long, image_id long, ts_ms long, sourcetype string, sourceid long")
    whole = W.batches(W.match_rules(arrivals, rules), IDLE - 1)  # a stream closes a session at the idle time itself
    closed = W.transactions(whole).where(F.col("updated") + IDLE <= now).select(*W.KEY)
    members = whole.join(closed, W.KEY, "left_semi")
    found = S.current_members(J.read_deltas(spark, f"{work}/members"))
    got = sorted((r["rule_id"], r["session_start"], r["image_id"], r["arrivals"]) for r in found.collect())
    want_members = sorted((r["rule_id"], r["session_start"], r["image_id"], r["arrivals"]) for r in members.collect())
    assert got == want_members, (set(got) - set(want_members), set(want_members) - set(got))
    assert len(got) > 100 and J.read_deltas(spark, f"{work}/members").select("batch").distinct().count() > 2

    hits = W.for_destination(rules, members, spark.createDataFrame(sent, SENT))
    want = {(r["rule_id"], r["session_start"]) for r in hits.collect()}
    changes = J.read_deltas(spark, f"{work}/hits")
    assert {tuple(r) for r in S.delivered(changes).select(*W.KEY).collect()} == want and want
    state = W.flags(W.transactions(found), S.delivered(changes), now + IDLE, IDLE)
    twin = W.flags(W.transactions(members), hits, now + IDLE, IDLE)
    ends = [sorted(tuple(r) for r in W.finalise(x, rules).collect()) for x in (state, twin)]
    assert ends[0] == ends[1] and ends[0]


def test_an_earlier_transaction_takes_a_report_over(spark, tmp_path):
    kind = "destinationtype string, destinationid long, image_id long, session_start long, rule_id long, updated long"
    for number, start in enumerate((300, 200, 250)):
        spark.createDataFrame([("box", 1, 5, start, 10 + number, start + 9), ("box", 1, 6, start, 10 + number, start + 9)], kind).coalesce(1).write.parquet(str(tmp_path / "placed" / f"{number}"))
    spark.createDataFrame([("box", 1, 5, when(100)), ("box", 1, 7, when(100))], SENT).coalesce(1).write.parquet(str(tmp_path / "sent" / "0"))
    read = lambda folder, schema: J.watch_files(spark, str(tmp_path / folder), spark.createDataFrame([], schema).schema, 1)
    S.prepared(spark)
    stream = S.deliveries(read("placed", kind), read("sent", SENT))
    J.run_batches(stream, str(tmp_path / "job"), J.delta_writer(str(tmp_path / "job"), lambda batch: batch))
    changes = J.read_deltas(spark, str(tmp_path / "job"))
    assert [(r["session_start"], r["change"]) for r in changes.orderBy("batch", "change").collect()] == [(300, 1), (300, -1), (200, 1)]
    assert [tuple(r) for r in S.delivered(changes).collect()] == [(11, 200)]


class _Held(dict):
    getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.pop  # noqa: N815

    def iterator(self):
        return iter(list(self.items()))


class _Handle:
    def __init__(self):
        self.timers, self.held = [], _Held()

    def getMapState(self, *_):  # noqa: N802
        return self.held

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)


class _Now(int):
    def getCurrentWatermarkInMs(self):  # noqa: N802
        return int(self)


def test_the_images_of_a_part_are_one_group_and_go_when_due():
    job, handle = S.Deliveries(timedelta(milliseconds=100)), _Handle()
    job.init(handle)
    columns = ["image_id", "known", "session_start", "rule_id", "ts_ms"]

    def come(*rows):
        found = job.handleInputRows(("box", 1, 0), iter([pd.DataFrame(rows, columns=columns)]), None)
        return sorted(tuple(map(int, r)) for out in found for r in out[["image_id", "session_start", "rule_id", "change"]].itertuples(index=False))

    none = float("nan")
    assert come((5, True, 300, 2, 10), (5, True, none, none, 20), (6, True, 300, 2, 30), (7, True, none, none, 40), (0, False, 9, 9, 50)) == [(5, 300, 2, 1)]
    assert come((7, True, 400, 3, 60), (5, True, 200, 1, 70), (0, True, none, none, 80)) == [(5, 200, 1, 1), (5, 300, 2, -1), (7, 400, 3, 1)]
    assert handle.timers == [120] and len(handle.held) == 5
    handle.timers.clear()
    list(job.handleExpiredTimer(("box", 1, 0), _Now(135), None))
    assert {i for i, _ in handle.held} == {5, 7, 0} and len(handle.held) == 4 and handle.timers == [150]

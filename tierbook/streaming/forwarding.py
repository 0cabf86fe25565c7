"""The life of forwarding transactions as streams: fresh, en route, delivered, and who their members are.

Arrivals that match a rule form sessions by inactivity.  Which sessions there are is a count per rule, merged inside every input
partition before the shuffle; who belongs to them is kept in keyed state that is spread over ``parts`` of every rule, so a rule that takes
most of the arrivals does not meet in one task.  When the watermark has closed a session, each part is told, hands out the images of
that time and forgets them: state is that of open sessions, however long they last.

Deliveries are kept by destination and image, in ``parts`` of every destination.  A report delivers the first transaction of its destination that holds the image; reports
and members may come in any order, and an earlier transaction that closes later takes the report over, which is written as a change of
-1 and +1.  The state of an image is one value; a timer drops it ``keep`` after its last change in event time.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tierbook.operators.forwarding import KEY, match_rules
from tierbook.streaming import jobs as J
from tierbook.streaming.counters import prepared

PARTS = 32
MEMBERS = "rule_id long, session_start long, updated long, image_id long, arrivals long"
HITS = "rule_id long, session_start long, image_id long, change long"
TARGET = ["destinationtype", "destinationid", "image_id"]


class Members(StatefulProcessor):
    """Arrivals of one part of a rule, held until their session closes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "ts_ms long, image_id long", "arrivals long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new, closed = [], []
        for part in rows:
            new.append(part.loc[part["updated"].isna(), ["ts_ms", "image_id"]])
            closed.append(part.loc[part["updated"].notna(), ["ts_ms", "updated"]])
        counts = pd.concat(new).astype("int64").value_counts()
        for place, n in counts.items():
            before = self.held.getValue(tuple(int(x) for x in place)) if self.held.containsKey(tuple(int(x) for x in place)) else (0,)
            self.held.updateValue(tuple(int(x) for x in place), (before[0] + int(n),))
        ends = pd.concat(closed).astype("int64").sort_values("ts_ms")
        if not len(ends):
            return
        kept = pd.DataFrame([(*place, n[0]) for place, n in self.held.iterator()], columns=["ts_ms", "image_id", "arrivals"])
        # closed sessions of a rule do not overlap
        at = ends["ts_ms"].searchsorted(kept["ts_ms"], side="right") - 1
        inside = (at >= 0) & (kept["ts_ms"].to_numpy() <= ends["updated"].to_numpy()[at])
        gone = kept[inside].assign(session_start=ends["ts_ms"].to_numpy()[at[inside]], updated=ends["updated"].to_numpy()[at[inside]])
        for ts, image in zip(gone["ts_ms"], gone["image_id"], strict=True):
            self.held.removeKey((int(ts), int(image)))
        out = gone.groupby(["session_start", "updated", "image_id"], as_index=False)["arrivals"].sum()
        if len(out):
            yield out.assign(rule_id=key[0])[[c.split()[0] for c in MEMBERS.split(", ")]]

    def close(self) -> None:
        pass


class Deliveries(StatefulProcessor):
    """The first transaction of a destination that holds an image, and whether it was reported; for one part of the images of a destination,
    so a group is a batch of many images and not a call for each.  One timer drops those that are due and waits for the next."""

    def __init__(self, keep: timedelta):
        self.keep_ms = int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.images = handle.getMapState("images", "image_id long, known boolean", "session_start long, rule_id long, reported boolean, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        image = ["image_id", "known"]
        came = pd.concat(list(rows))
        held = came.dropna(subset=["session_start"]).astype({"session_start": "int64", "rule_id": "int64"})
        first = held.sort_values(["session_start", "rule_id"]).drop_duplicates(image)
        first = {(int(i), bool(k)): (int(s), int(r)) for i, k, s, r in zip(first["image_id"], first["known"], first["session_start"], first["rule_id"], strict=True)}
        met = came.assign(reported=came["session_start"].isna()).groupby(image, as_index=False).agg(last=("ts_ms", "max"), reported=("reported", "any"))
        out, due = [], None
        for i, known, latest, now in zip(met["image_id"].tolist(), met["known"].tolist(), met["last"].tolist(), met["reported"].tolist(), strict=True):
            at = (int(i), bool(known))
            start, rule, reported, last = self.images.getValue(at) or (None, None, False, 0)
            best, last, now = (start, rule), max(last, int(latest)), bool(now or reported)
            if at in first:
                best = first[at] if start is None else min(best, first[at])
            best = tuple(None if x is None else int(x) for x in best)
            self.images.updateValue(at, (*best, now, last))
            due = last if due is None else min(due, last)
            if best[0] is not None and now and (best != (start, rule) or not reported):
                if reported and start is not None:
                    out.append((rule, start, *at, -1))
                out.append((best[1], best[0], *at, 1))
        timers = [int(t) for t in self.handle.listTimers()]
        if not timers or due + self.keep_ms < min(timers):
            self.handle.registerTimer(due + self.keep_ms)
        if out:
            yield pd.DataFrame(out, columns=["rule_id", "session_start", *image, "change"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        left = [(at, held[3] + self.keep_ms) for at, held in self.images.iterator()]
        for at, due in left:
            if due <= now:
                self.images.removeKey(at)
        later = [due for _, due in left if due > now]
        if later:
            self.handle.registerTimer(min(later))
        yield from ()

    def close(self) -> None:
        pass


def members(stream: DataFrame, rules: DataFrame, idle: str, delay: str, parts: int = PARTS) -> DataFrame:
    """Members of the transactions that the watermark has closed; ``stream`` has image_id, ts, sourcetype and sourceid."""
    matched = match_rules(stream.withWatermark("ts", delay), rules.select("rule_id", "sourcetype", "sourceid"))
    ended = matched.groupBy(F.session_window("ts", idle), "rule_id").agg(F.max("ts").alias("last"))
    ended = ended.select("rule_id", F.unix_millis("session_window.start").alias("ts_ms"), F.unix_millis("last").alias("updated"))
    every = ended.select("rule_id", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")).alias("part"), "ts_ms", F.lit(None).cast("long").alias("image_id"), "updated")
    came = matched.select("rule_id", F.pmod(F.xxhash64("image_id"), F.lit(parts)).cast("long").alias("part"), F.unix_millis("ts").alias("ts_ms"), "image_id",
                          F.lit(None).cast("long").alias("updated"))
    return came.unionByName(every).groupBy("rule_id", "part").transformWithStateInPandas(
        statefulProcessor=Members(), outputStructType=MEMBERS, outputMode="Append", timeMode="None")


def deliveries(placed: DataFrame, reports: DataFrame, late: str = "1 day", keep: timedelta = timedelta(days=30), parts: int = PARTS) -> DataFrame:
    """Changes of who was delivered, from members with their destination and from reports (destination, image, ts).

    Either may come ``late`` after the latest of its kind; ``keep`` after the last of a key a report finds nothing to deliver.
    """
    none = F.lit(None).cast("long")
    held = placed.select(*TARGET, "session_start", "rule_id", F.timestamp_millis("updated").alias("ts"))
    both = held.unionByName(reports.select(*TARGET, none.alias("session_start"), none.alias("rule_id"), "ts")).withWatermark("ts", late)
    # a null in a column would make its numbers floating
    timed = both.select(*TARGET[:2], F.pmod(F.xxhash64("image_id"), F.lit(parts)).cast("long").alias("part"), F.coalesce("image_id", F.lit(0)).alias("image_id"),
                        F.col("image_id").isNotNull().alias("known"), "session_start", "rule_id", F.unix_millis("ts").alias("ts_ms"), "ts")
    changes = timed.groupBy(*TARGET[:2], "part").transformWithStateInPandas(
        statefulProcessor=Deliveries(keep), outputStructType=HITS.replace("change", "known boolean, change"), outputMode="Append", timeMode="EventTime")
    return changes.select("rule_id", "session_start", F.when(F.col("known"), F.col("image_id")).alias("image_id"), "change")


def run(arrivals: DataFrame, reports: DataFrame, rules: DataFrame, work: str, idle: str, delay: str) -> None:
    """Both streams over everything available: members as deltas, which the second stream reads together with the reports."""
    spark = prepared(arrivals.sparkSession)
    J.run_batches(members(arrivals, rules, idle, delay), f"{work}/members", J.delta_writer(f"{work}/members", lambda batch: batch))
    closed = spark.readStream.schema(MEMBERS).option("recursiveFileLookup", "true").parquet(f"{work}/members/delta")
    placed = closed.join(rules.select("rule_id", "destinationtype", "destinationid"), "rule_id")
    J.run_batches(deliveries(placed, reports), f"{work}/hits", J.delta_writer(f"{work}/hits", lambda batch: batch))


def current_members(deltas: DataFrame) -> DataFrame:
    return deltas.select(*KEY, "image_id", "arrivals", F.col("updated").alias("last_ts"))


def delivered(deltas: DataFrame) -> DataFrame:
    """Transactions with a report that is still theirs."""
    return deltas.groupBy(*KEY, "image_id").agg(F.sum("change").alias("n")).where("n > 0").select(*KEY).distinct()

"""Forwarding: arrivals meet rules, matching arrivals batch up by inactivity, batches are sent, delivered, finalised.

A transaction is identified by its rule and the time of its first arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierbook.operators.ordered import fitting_width, sessions

IDLE_MS = 30_000
KEY = ["rule_id", "session_start"]


def match_rules(arrivals: DataFrame, rules: DataFrame) -> DataFrame:
    return arrivals.join(rules, ["sourcetype", "sourceid"])


def batches(matched: DataFrame, idle_ms: int = IDLE_MS, width_ms: int | None = None) -> DataFrame:
    """Members of the transactions: (rule, start, image) once per image, with first and last arrival.

    Windows run inside buckets of ``width_ms``, by default a day, or less where a burst of one rule fills a day too much for one task.
    """
    if width_ms is None:
        width_ms = fitting_width(matched, ["rule_id"], "ts_ms", 86_400_000)
    placed = sessions(matched.select("rule_id", "image_id", "ts_ms"), ["rule_id"], "ts_ms", idle_ms, width_ms, closed=True)
    return placed.groupBy(*KEY, "image_id").agg(F.count(F.lit(1)).alias("arrivals"), F.max("ts_ms").alias("last_ts"))


def transactions(members: DataFrame) -> DataFrame:
    return members.groupBy(*KEY).agg(
        F.max("last_ts").alias("updated"), F.sum("arrivals").alias("arrivals"), F.count(F.lit(1)).alias("images"))


def expired(batch: DataFrame, now_ms: int, idle_ms: int = IDLE_MS) -> DataFrame:
    return batch.filter(F.col("updated") < now_ms - idle_ms)


def for_destination(rules: DataFrame, members: DataFrame, sent: DataFrame) -> DataFrame:
    """First transaction of a destination that holds the reported image, per distinct report."""
    where = ["destinationtype", "destinationid", "image_id"]
    placed = members.select(*KEY, "image_id").join(rules.select("rule_id", "destinationtype", "destinationid"), "rule_id")
    hits = placed.join(sent.select(*where).distinct(), where)
    return hits.groupBy(*where).agg(F.min(F.struct("session_start", "rule_id")).alias("t")).select(
        *where, F.col("t.rule_id").alias("rule_id"), F.col("t.session_start").alias("session_start"))


def flags(batch: DataFrame, delivered: DataFrame, now_ms: int, idle_ms: int = IDLE_MS) -> DataFrame:
    """Transactions with their state: expired ones are on the way until a report delivers them."""
    done = delivered.select(*KEY).distinct().withColumn("__done", F.lit(True))
    marked = batch.join(done, KEY, "left").withColumn("delivered", F.coalesce("__done", F.lit(False)))
    sent = F.col("updated") < now_ms - idle_ms
    return marked.withColumn("enroute", sent & ~F.col("delivered")).drop("__done")


def finalise(flagged: DataFrame, rules: DataFrame) -> DataFrame:
    """Delivered transactions to close.  ``remove`` keeps the images; ``delete`` drops them, but only once no transaction
    of the same source is undelivered.  Transactions of removed rules are skipped."""
    source = ["sourcetype", "sourceid"]
    known = flagged.join(rules, "rule_id")
    waiting = known.filter(~F.col("delivered")).select(*source).distinct()
    done = known.filter("delivered")
    remove = done.filter("keep_images").select(*KEY, F.lit("remove").alias("action"))
    delete = done.filter("NOT keep_images").join(waiting, source, "left_anti").select(*KEY, F.lit("delete").alias("action"))
    return remove.unionByName(delete)


def images_to_delete(closed: DataFrame, members: DataFrame) -> DataFrame:
    """Images of the transactions that end with ``delete``, each once."""
    gone = closed.filter(F.col("action") == "delete").select(*KEY)
    return members.join(gone, KEY, "left_semi").select("image_id").distinct()


def route(flagged: DataFrame, rules: DataFrame, failed: DataFrame) -> DataFrame:
    """Send transactions to the sink of their destination type; a failed network destination makes them fresh again."""
    down = failed.select("destinationid").distinct().withColumn("__down", F.lit(True))
    routed = flagged.filter("enroute").join(rules, "rule_id").join(down, "destinationid", "left")
    sink = F.when(F.col("destinationtype").isin("box", "scu"), F.col("destinationtype")).otherwise(F.lit("unknown"))
    reset = (F.col("destinationtype") == "scu") & F.coalesce("__down", F.lit(False))
    return routed.select(*KEY, sink.alias("sink"), (~reset).alias("enroute"))

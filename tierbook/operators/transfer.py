"""Transfers between peers: outgoing and incoming transactions, their members, counters and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierbook.operators.ordered import numbered, previous, split_by

RANK_SPAN = 65_536  # most rows of one key inside one window task, for order values without duplicates
TIMEOUT_MS = 15_000
RETRY_MS = 15_000


def create_outgoing(requests: DataFrame, values: DataFrame) -> dict[str, DataFrame]:
    """One transaction per request group with numbered images and their attribute values.

    ``requests`` is (transaction_id, box_id, image_id), ``values`` (transaction_id, image_id, tag_path, value): the same image
    may be sent with other values in another transaction.
    """
    transactions = requests.groupBy("transaction_id", "box_id").agg(F.count(F.lit(1)).alias("total")).select(
        "transaction_id", "box_id", "total", F.lit(0).cast("bigint").alias("sent_count"), F.lit("WAITING").alias("status")
    )
    images = numbered(
        requests.select("transaction_id", "image_id"), ["transaction_id"], ["image_id"],
        split_by(F.col("image_id"), RANK_SPAN), "sequence",
    ).withColumn("sent", F.lit(False))
    tag_values = images.select("transaction_id", "image_id", "sequence").join(values, ["transaction_id", "image_id"])
    return {"transactions": transactions, "images": images, "values": tag_values}


def pending(transactions: DataFrame, images: DataFrame) -> DataFrame:
    """Unsent images of transactions that have not failed."""
    live = transactions.filter(F.col("status") != "FAILED").select(
        F.col("id").alias("transaction_id"), "box_id", "created", "sent_count")
    return images.filter(~F.col("sent")).join(live, "transaction_id")


def next_batch(transactions: DataFrame, images: DataFrame, n: int) -> DataFrame:
    """Next ``n`` images of every box, oldest transaction first.

    The rank filter becomes a group limit before the shuffle: every task sends at most ``n`` rows per box.
    """
    order = Window.partitionBy("box_id").orderBy("created", "sequence", "transaction_id")
    return pending(transactions, images).withColumn("rank", F.row_number().over(order).cast("bigint")).filter(
        F.col("rank") <= n)


def sent_index(transactions: DataFrame, images: DataFrame) -> DataFrame:
    """Position each pending image will have among the sent ones of its transaction."""
    rows = numbered(pending(transactions, images), ["transaction_id"], ["sequence"], split_by(F.col("sequence"), RANK_SPAN))
    return rows.withColumn("index", F.col("sent_count") + F.col("rn")).drop("rn")


def outgoing_progress(totals: DataFrame, sent: DataFrame) -> DataFrame:
    """``sent`` has one row per reported delivery; a repeated report counts again, capped at the total."""
    counted = sent.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("reports"))
    done = F.least(F.col("total"), F.coalesce("reports", F.lit(0).cast("bigint")))
    status = F.when(F.col("reports").isNull(), "WAITING").when(done >= F.col("total"), "FINISHED").otherwise("PROCESSING")
    return totals.join(counted, "transaction_id", "left").select(
        "transaction_id", "total", done.alias("sent_count"), status.alias("status"))


def incoming_progress(events: DataFrame, width_ms: int = 60_000) -> DataFrame:
    """Counters per incoming transaction from its received rows, in order of arrival (``ts_ms``, then ``sequence``).

    Every row counts one up and caps at the total it names, so the count after n rows is the smallest of n and, over all
    rows k, total(k) + n - k.  With row numbers this is one minimum, which combines on the map side; row numbers come from
    the bucketed window, so one huge transaction spreads over many tasks.
    """
    key = ["box_id", "transaction_id"]
    bucket, order = split_by(F.col("ts_ms"), width_ms), ["ts_ms", "sequence"]
    ranked = numbered(events, key, order, bucket, "k")
    added = numbered(events.filter("added").select(*key, "sequence", "ts_ms", "total"), key, order, bucket, "k")

    def capped(count: Column) -> Column:
        return F.least(count, count + F.min(F.col("total") - F.col("k")))

    received = ranked.groupBy(*key).agg(
        capped(F.count(F.lit(1))).alias("received"), F.max_by("total", "k").alias("total"))
    new = added.groupBy(*key).agg(capped(F.count(F.lit(1))).alias("added"))
    # one member per sequence number, rejected images have none
    per_sequence = events.groupBy(*key, "sequence").agg(F.max_by("image_id", "ts_ms").alias("image_id"))
    members = per_sequence.groupBy(*key).agg(
        F.count(F.lit(1)).alias("sequences"), F.count("image_id").alias("members"))
    status = F.when(F.col("received") >= F.col("total"), "FINISHED").otherwise("PROCESSING")
    return received.join(members, key).join(new, key, "left").select(
        *key, "received", F.coalesce("added", F.lit(0).cast("bigint")).alias("added"), "total", "sequences", "members",
        status.alias("status"))


def set_status(transactions: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the requested status; FINISHED also completes the received count."""
    joined = transactions.join(changes.withColumnRenamed("status", "__status"), "transaction_id", "left")
    finished = F.col("__status") == "FINISHED"
    return joined.withColumns(
        {
            "received": F.when(finished, F.col("total")).otherwise(F.col("received")),
            "status": F.coalesce("__status", "status"),
        }
    ).select(*transactions.columns)


def time_out(transactions: DataFrame, now_ms: int, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """Transactions in process that did not move for too long go back to waiting."""
    idle = (F.col("status") == "PROCESSING") & (F.lit(now_ms) - F.col("updated") > timeout_ms)
    return transactions.withColumn("status", F.when(idle, "WAITING").otherwise(F.col("status")))


def online_peers(polls: DataFrame, now_ms: int, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    return polls.groupBy("peer").agg(F.max("ts_ms").alias("last_poll")).withColumn(
        "online", F.lit(now_ms) - F.col("last_poll") < timeout_ms)


def triage(code: Column) -> Column:
    """What a response code means for the image: passed, ignored (rejected or removed), or a failed batch."""
    return F.when(code.between(200, 299), "pass").when(code.isin(400, 404), "ignore").otherwise("fail")


def throttle_failures(failures: DataFrame, keys: list[str], ts: str, retry_ms: int = RETRY_MS, width_ms: int = 86_400_000,
                      tie: list[str] | None = None) -> DataFrame:
    """Report a failure only if the previous one of the same peer is more than 1.2 retry intervals away."""
    rows = previous(failures, keys, ts, split_by(F.col(ts), width_ms), "__prev", tie)
    apart = F.col(ts) - F.coalesce("__prev", F.lit(0))
    return rows.filter(apart > int(retry_ms * 1.2)).drop("__prev")


def reconcile(requested: DataFrame, found: DataFrame) -> DataFrame:
    """Per destination: images asked for, and how many of them could not be found."""
    marked = requested.join(found.toDF("image_id").distinct().withColumn("__found", F.lit(1)), "image_id", "left")
    return marked.groupBy("box_id").agg(
        F.count(F.lit(1)).alias("requested"), F.sum(F.when(F.col("__found").isNull(), 1).otherwise(0)).alias("missing"))


def recent(transactions: DataFrame, start: int = 0, count: int = 20) -> DataFrame:
    return transactions.orderBy(F.col("updated").desc(), F.col("id").desc()).offset(start).limit(count)

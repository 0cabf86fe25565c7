"""Ordered computations per key that survive a hot key.

A plain window over ``partitionBy(key)`` sorts all rows of a key in one task.  Here the order column is cut into
buckets: rows are windowed inside ``(key, bucket)``, every bucket is reduced to one row, a second window runs over those
reduced rows only, and the carry of the earlier buckets is joined back.  Bucket numbers are computed from the order value
itself, so a lost executor recomputes the same split.  Both windows and the reduction share one shuffle on
``(key, bucket)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET = "__bucket"


def split_by(order: Column, width: int) -> Column:
    return F.floor(order / F.lit(width)).cast("bigint")


def _placed(frame: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    return frame.withColumn(BUCKET, bucket).repartition(*keys, BUCKET)


def _carry(frame: DataFrame, keys: list[str], reduced: Column, over_earlier) -> DataFrame:
    """One row per (key, bucket) with an aggregate over all earlier buckets of the key."""
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return (
        frame.groupBy(*keys, BUCKET)
        .agg(reduced.alias("__part"))
        .select(*keys, BUCKET, over_earlier(F.col("__part")).over(earlier).alias("__carry"))
    )


def _with_carry(frame: DataFrame, keys: list[str], carry: DataFrame) -> DataFrame:
    return frame.join(carry, [*keys, BUCKET], "left")


def numbered(frame: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "rn") -> DataFrame:
    """``row_number`` per key.  ``bucket`` must not decrease along ``order``."""
    rows = _placed(frame, keys, bucket)
    carry = _carry(rows, keys, F.count(F.lit(1)), F.sum)
    inside = F.row_number().over(Window.partitionBy(*keys, BUCKET).orderBy(*order))
    return (
        _with_carry(rows.withColumn("__rn", inside), keys, carry)
        .withColumn(name, (F.col("__rn") + F.coalesce("__carry", F.lit(0))).cast("bigint"))
        .drop("__rn", "__carry", BUCKET)
    )


def previous(frame: DataFrame, keys: list[str], order: str, bucket: Column, name: str = "prev",
             tie: list[str] | None = None) -> DataFrame:
    """The order value of the preceding row of the key, null for the first row."""
    rows = _placed(frame, keys, bucket)
    carry = _carry(rows, keys, F.max(order), F.max)
    inside = F.lag(order).over(Window.partitionBy(*keys, BUCKET).orderBy(order, *(tie or [])))
    return (
        _with_carry(rows.withColumn("__lag", inside), keys, carry)
        .withColumn(name, F.coalesce("__lag", "__carry"))
        .drop("__lag", "__carry", BUCKET)
    )


def running_max(frame: DataFrame, keys: list[str], order: str, value: Column, bucket: Column, name: str) -> DataFrame:
    """Largest ``value`` over all rows of the key with an order value up to the own one."""
    rows = _placed(frame.withColumn("__value", value), keys, bucket)
    carry = _carry(rows, keys, F.max("__value"), F.max)
    window = Window.partitionBy(*keys, BUCKET).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    return (
        _with_carry(rows.withColumn("__max", F.max("__value").over(window)), keys, carry)
        .withColumn(name, F.greatest("__max", "__carry"))
        .drop("__value", "__max", "__carry", BUCKET)
    )


def fitting_width(frame: DataFrame, keys: list[str], ts: str, widest: int, rows: int = 65_536) -> int:
    """A bucket width under which the fullest bucket of the fullest key holds about ``rows`` timestamps, at most ``widest``.

    Narrowed as long as the fullest bucket is too full and narrower ones still part it; counts combine before their shuffle, and any
    width gives the same sessions.
    """
    times = frame.select(*keys, ts).distinct()
    width = widest
    while width > 1:
        full = times.groupBy(*keys, split_by(F.col(ts), width).alias(BUCKET)).count().agg(F.max("count")).first()[0] or 0
        if full <= rows:
            break
        width = max(1, width // (2 * -(-full // rows)))
    return width


def sessions(frame: DataFrame, keys: list[str], ts: str, gap: int, width: int, closed: bool = False) -> DataFrame:
    """Add ``session_start``: a new session begins when the gap to the previous row reaches ``gap``.

    With ``closed`` a gap of exactly ``gap`` still belongs to the session.  All rows with one timestamp share a session,
    so the timestamps are first reduced to distinct values on the map side; the hot key only carries as many rows as it
    has distinct timestamps.
    """
    marks = previous(frame.select(*keys, ts).distinct(), keys, ts, split_by(F.col(ts), width), "__prev")
    apart = F.col(ts) - F.col("__prev")
    new = F.col("__prev").isNull() | ((apart > gap) if closed else (apart >= gap))
    starts = running_max(
        marks.withColumn("__new", new), keys, ts, F.when(F.col("__new"), F.col(ts)), split_by(F.col(ts), width),
        "session_start",
    ).select(*keys, ts, "session_start")
    return frame.join(starts, [*keys, ts])


def allocate_ids(frame: DataFrame, keys: list[str], first: Column, buckets: int | None = None) -> DataFrame:
    """Dense surrogate ids for rows with unique natural keys, counted from ``first``.

    Unique keys hash evenly, so no bucket is hot, and the offsets window runs over ``buckets`` rows only: a few for each
    shuffle partition, a number that is set to fit the data.
    """
    buckets = buckets or 16 * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = frame.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets))).repartition(BUCKET)
    offsets = (
        rows.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("__n"))
        .select(
            BUCKET,
            (F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy(BUCKET)) - F.col("__n")).alias("__offset"),
        )
    )
    inside = F.row_number().over(Window.partitionBy(BUCKET).orderBy(*keys))
    return (
        rows.withColumn("__rn", inside)
        .join(offsets, BUCKET)
        .withColumn("id", (first + F.col("__offset") + F.col("__rn") - 1).cast("bigint"))
        .drop("__rn", "__offset", BUCKET)
    )

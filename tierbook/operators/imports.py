"""Import sessions: accepted and rejected files, counters, members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def import_source(name: Column, session_id: Column) -> Column:
    return F.struct(F.lit("import").alias("source_type"), name.alias("source_name"), session_id.alias("source_id"))


def session_counters(log: DataFrame) -> DataFrame:
    """Per session: imported counts every accepted file, added only the first time an image appears.

    The first aggregation is per (session, image), which spreads one huge session over all tasks; the second one adds up
    pre-reduced rows.
    """
    accepted = F.when(~F.col("rejected"), 1).otherwise(0)
    per_image = log.groupBy("session_id", "image_id").agg(
        F.sum(accepted).alias("ok"), F.sum(1 - accepted).alias("bad"), F.max("ts_ms").alias("ts_ms")
    )
    return per_image.groupBy("session_id").agg(
        F.sum("ok").alias("imported"),
        F.sum(F.when(F.col("ok") > 0, 1).otherwise(0)).alias("added"),
        F.sum("bad").alias("rejected"),
        F.max("ts_ms").alias("last_updated"),
    )


def session_images(log: DataFrame, images: DataFrame) -> DataFrame:
    members = log.filter(~F.col("rejected")).select("session_id", "image_id").distinct()
    return members.join(images.withColumnRenamed("id", "image_id"), "image_id")

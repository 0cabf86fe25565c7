"""Event log: newest-first pages, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recent(log: DataFrame, start: int = 0, count: int = 20) -> DataFrame:
    return log.orderBy(F.col("created").desc(), F.col("id").desc()).offset(start).limit(count)


def remove_entries(log: DataFrame, ids: DataFrame) -> DataFrame:
    return log.join(ids.toDF("id").distinct(), "id", "left_anti").select(*log.columns)


def clear(log: DataFrame) -> DataFrame:
    return log.limit(0)

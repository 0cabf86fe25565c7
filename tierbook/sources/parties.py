"""Who sends and who receives: catalogues of sources and destinations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _party(frame: DataFrame, kind: str, prefix: str) -> DataFrame:
    return frame.select(
        F.lit(kind).alias(f"{prefix}type"), F.col("name").alias(f"{prefix}name"), F.col("id").alias(f"{prefix}id")
    )


def source_catalogue(users: DataFrame, boxes: DataFrame, scps: DataFrame, directories: DataFrame,
                     imports: DataFrame) -> DataFrame:
    parts = {"user": users, "box": boxes, "scp": scps, "directory": directories, "import": imports}
    return reduce(DataFrame.unionByName, [_party(f, kind, "source") for kind, f in parts.items()])


def destination_catalogue(boxes: DataFrame, scus: DataFrame) -> DataFrame:
    return _party(boxes, "box", "destination").unionByName(_party(scus, "scu", "destination"))

"""Global positions of rows without gathering them: range partitions, rows counted per partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierbook.llm.common import stored


def numbered(frame: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """The rows with their position (from 0) in the order, written to the shared folder.

    Rows are dealt by ranges of the order and sorted inside them; the driver sees one count per partition.  Rows that are equal
    in all of ``order`` land in one task, so end it with something that tells rows apart where many may be equal.
    """
    dealt = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    kept = stored(dealt.withColumns({"_part": F.spark_partition_id(), "_within": within}), "ordered")
    first, before = [], 0
    for part, rows in sorted(kept.groupBy("_part").count().collect()):
        first.append((part, before))
        before += rows
    if not first:
        return kept.drop("_part", "_within").withColumn(name, F.lit(0).cast("long"))
    starts = frame.sparkSession.createDataFrame(first, "_part int, _first long")
    return kept.join(F.broadcast(starts), "_part").withColumn(name, F.col("_first") + F.col("_within")).drop("_part", "_first", "_within")

"""Ingest and delete that read and write what they touch: level tables by id, and a count of children for every parent.

Counts are a table of sums: what comes or goes adds or takes away, without a look at the other children.  A delete reads the rows it
deletes, the counts of their parents, and goes on with those parents whose count has come to nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierbook import schema as S
from tierbook.operators.query import Catalogue
from tierbook.session import materialise
from tierbook.sources.versioned import Versioned

UPWARDS = ["image", "series", "study", "patient"]


class Hierarchy:
    """Four level tables and the counts of their children, below one folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.levels = {name: Versioned(spark, f"{path}/{name}", ["id"], buckets) for name in UPWARDS}
        self.counts = Versioned(spark, f"{path}/counts", ["level", "id"], buckets, how="sum")

    def create(self, cat: Catalogue) -> Hierarchy:
        counts = None
        for name in UPWARDS:
            frame = cat.level(name).select(*S.LEVELS[name].columns)
            self.levels[name].create(frame)
            if S.LEVELS[name].parent:
                rows = self._children(name, frame, 1)
                counts = rows if counts is None else counts.unionByName(rows)
        self.counts.create(counts)
        return self

    @staticmethod
    def _children(name: str, rows: DataFrame, sign: int) -> DataFrame:
        level = S.LEVELS[name]
        return rows.groupBy(F.col(level.ref).alias("id")).agg((sign * F.count(F.lit(1))).alias("n")).select(F.lit(level.parent).alias("level"), "id", "n")

    def insert(self, name: str, rows: DataFrame) -> None:
        """Rows with distinct ids, new ones or replacements; a replaced row may have moved to another parent."""
        level, rows = self.levels[name], materialise(rows.select(*S.LEVELS[name].columns), f"insert-{name}")
        if S.LEVELS[name].parent:
            old = level.lookup(rows)
            change = self._children(name, rows, 1).unionByName(self._children(name, old, -1)).groupBy("level", "id").agg(F.sum("n").alias("n")).where("n <> 0")
            change = materialise(change, "counts")  # before the rows it was counted from are replaced
            self.counts.merge(change)
        level.merge(rows)

    def delete(self, image_ids: DataFrame) -> dict[str, DataFrame]:
        """Deletes images and every parent that lost its last child; returns the ids per level."""
        deleted, doomed = {}, image_ids.toDF("id").distinct()
        for name in UPWARDS:
            rows = materialise(self.levels[name].lookup(doomed), f"delete-{name}")
            deleted[name] = rows.select("id")
            if rows.isEmpty():
                doomed = rows.select("id")
                continue
            self.levels[name].merge(rows.limit(0), delete=rows)
            if S.LEVELS[name].parent:
                less = self._children(name, rows, -1)
                self.counts.merge(less)
                left = self.counts.lookup(less)
                doomed = materialise(less.join(left, ["level", "id"], "left_anti").select("id"), "emptied")
        return deleted

    def catalogue(self) -> Catalogue:
        return Catalogue(**{name: table.read() for name, table in self.levels.items()})

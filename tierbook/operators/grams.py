"""Text search through an index of three-character grams.

Every text is lower-cased and begins with a mark, so that the beginnings of texts have grams of their own; a posting says which row and
column holds a gram.  Postings lie in folders by a hash of the gram, sorted by it, and a small table counts them.  A filter takes the
grams between its live wildcards, reads the postings of the rarest few, intersects them, and holds the candidates against the filter itself,
so the rows are those of the scan.  A filter with no whole gram is a scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierbook.operators.query import text_filter

SIZE = 3
BEGIN = "\x02"
#: Lists of postings that are intersected; the candidates are verified anyway.
LISTS = 4
COUNTS, POSTINGS = "gram string, n long", "gram string, place int, id long, bucket int"


def grams_of(value: str, prefix: bool) -> list[str]:
    """Grams that every hit of a filter holds.  Letters outside ASCII are left out: their lower case is the engine's to tell."""
    parts = re.split("[%_]", value.lower())
    if prefix:
        parts[0] = BEGIN + parts[0]
    found = [part[k : k + SIZE] for part in parts for k in range(len(part) - SIZE + 1)]
    return list(dict.fromkeys(g for g in found if g.isascii()))


class GramIndex:
    """Index of some text columns of rows with an id."""

    def __init__(self, spark: SparkSession, path: str, columns: list[str], buckets: int = 64):
        self.spark, self.path, self.columns, self.buckets = spark, path, columns, buckets

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def build(self, frame: DataFrame) -> GramIndex:
        texts = [F.struct(F.lit(i).alias("place"), F.concat(F.lit(BEGIN), F.lower(F.col(c).cast("string"))).alias("text")) for i, c in enumerate(self.columns)]
        rows = frame.select("id", F.explode(F.array(*texts)).alias("t")).select("id", "t.*").where(f"length(text) >= {SIZE}")
        every = F.expr(f"array_distinct(transform(sequence(1, length(text) - {SIZE - 1}), i -> substring(text, i, {SIZE})))")
        rows = rows.select(F.explode(every).alias("gram"), "place", F.col("id").cast("long").alias("id")).withColumn("bucket", self._bucket(F.col("gram")))
        # the id spreads a gram that most rows hold
        dealt = rows.repartitionByRange("bucket", "gram", "id").sortWithinPartitions("bucket", "gram")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/postings")
        counts = self._postings().groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{self.path}/counts")
        return self

    def _postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def list_of(self, gram: str) -> DataFrame:
        """(place, id) of a gram, from its folder."""
        here = (F.col("bucket") == self._bucket(F.lit(gram))) & (F.col("gram") == gram)
        return self._postings().where(here).select("place", "id")

    def search(self, frame: DataFrame, value: str, prefix: bool = False) -> DataFrame:
        """The rows of the indexed frame that ``text_filter`` finds."""
        grams = grams_of(value, prefix)
        if not grams:
            return text_filter(frame, self.columns, value, prefix)
        counts = self.spark.read.schema(COUNTS).parquet(f"{self.path}/counts").where(F.col("gram").isin(grams))
        rare = sorted((r["n"], r["gram"]) for r in counts.collect())  # at most one row per gram of the filter
        if len(rare) < len(grams):
            return frame.limit(0)
        hits = self.list_of(rare[0][1])
        for _, gram in rare[1:LISTS]:
            hits = hits.join(self.list_of(gram), ["place", "id"], "left_semi")
        return text_filter(frame.join(hits.select("id").distinct(), "id", "left_semi"), self.columns, value, prefix)

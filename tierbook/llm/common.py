"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierbook.session import configure, work_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows of text handed to a Python worker at a time; texts can be very long.
ARROW_ROWS = "256"

#: Digits, ASCII letters and everything outside ASCII.  On UTF-8 bytes this equals the character class on code points.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators count on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lost executors cost no recomputation, lineage ends."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lowered(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased; bytes.lower touches ASCII letters only.  Null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(lowered(text))


def by_batch(df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def _stars(edges: DataFrame) -> bool:
    """Whether each u of edges(u, v) occurs once and no v is a u."""
    ends = edges.select("u", F.lit(1).alias("n")).union(edges.select(F.col("v").alias("u"), F.lit(0)).distinct())
    counts = ends.groupBy("u").agg(F.sum("n").alias("up"), F.min("n").alias("low"))
    return counts.where("up > 1 or (up = 1 and low = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b) of long ids: rows (node, component), component the smallest node reachable.

    Alternating large-star and small-star steps, until only stars are left: every node has one edge, to a centre that has none upwards.
    Each step is written to the shared folder.  Stars are joined on their centre, a plain equality join that adaptive
    execution splits when one centre holds many edges.
    """
    cur = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges"
    )
    while not _stars(cur):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct()
        )
        cur = stored(small, "edges")
    linked = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return linked.union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

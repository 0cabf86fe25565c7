"""A corpus pipeline of five stages over the documents table.

Toxic documents go, one document of each group of near duplicates stays, repeated passages are cut out, benchmark passages
are cut out, and what is left is packed into sequences.  Each stage works on everything that its predecessor kept; its result
is written as a table in the shared folder and read again, so a lost executor costs one stage at most.

The first four stages return the columns of their input (and only those rows or texts that stay), the last one the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierbook.llm import decontaminate, packing, repeats, simhash, toxicity
from tierbook.llm.common import prepare, stored, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where a stage has changed it."""
    return docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not reject; it is trained on the labelled ones among them."""
    prepare(spark)
    found = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.where("score < 0.5").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of texts whose SimHash fingerprints (three-word shingles) link at three bits or fewer, that with the smallest id."""
    prepare(spark)
    return simhash.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once; every document stays."""
    prepare(spark)
    return _counted(repeats.cut_documents(docs))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that lie in windows of benchmark items; every document stays."""
    prepare(spark)
    return _counted(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", cut_benchmark),
    ("packing", pack),
]

#: SQL has no trained classifier and no byte-level tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot partition even if that costs one more shuffle further up
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows that lie sorted by their group are aggregated in that order: no hash table, no second sort where groups are many
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    # column files hold rows in a fraction of the memory they take: a side is broadcast by that size, or the driver would hold it whole
    "spark.sql.sources.fileCompressionFactor": "16.0",
    # merge session windows inside each input partition before they are shuffled
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # the JVM interprets methods of more than 8000 bytes; wide steps, as the spread of all elements, run in smaller ones instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

#: Where a session does not say otherwise.  Shuffled bytes are packed: joined to tasks of 64 MB, rows are sorted in some ten times that and spill.
DEFAULTS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings every plan of this package counts on."""
    for key, value in SQL_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "tierbook", cores: str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for sinks and stream checkpoints below ``spark.checkpoint.dir``.

    All executors must see the folder, so a cluster has to name it.  Only a local session, where driver and
    executors share one machine, falls back to a temporary folder.
    """
    return f"{_root(spark)}/{label}-{uuid.uuid4().hex}"


def job_dir(spark: SparkSession, job: str) -> str:
    """The folder of a job that goes on where it stopped: the same for every run under this name."""
    return f"{_root(spark)}/jobs/{job}"


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = os.path.join(tempfile.gettempdir(), "tierbook")
    return root.rstrip("/")


def materialise(frame: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read again: computed once, whatever reads them, and safe from lost executors."""
    spark = frame.sparkSession
    path = work_dir(spark, label)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)

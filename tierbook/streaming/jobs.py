"""Structured Streaming jobs.

State and output of a job live below the folder it is given: under ``session.job_dir`` a restarted query goes on from its
checkpoint.  Sinks of
``foreachBatch`` jobs write one folder per batch id and overwrite it, which makes a replayed batch harmless.  Merged tables
are kept as append-only deltas that are resolved on read: writing a batch costs what the batch weighs; reclassification also reads the series it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tierbook.operators.forwarding import match_rules
from tierbook.operators.maintain import latest

Batch = Callable[[DataFrame, int], None]


def watch_files(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Files below a path: those present first, then new ones.  A changed file must arrive under a new name; ``take_changes`` takes it under any."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(path)


def take_changes(spark: SparkSession, path: str, schema, work: str, handle: Batch, max_files: int | None = None) -> int:
    """Hands every file below a path to ``handle`` once for each state it is found in: a file that is written anew under its old name
    arrives again, which a file stream would never notice.

    What was taken is kept as (path, time, size) in one folder per batch id, written after the batch; a run that fails takes the same files
    again under the same id.  Listing reads no contents.  The rows carry ``file_path`` and ``file_time``.  Returns the number of batches.
    """
    state = "path string, modificationTime timestamp, length long"
    seen = spark.read.schema(state).option("recursiveFileLookup", "true")
    done = 0
    while True:
        here = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        here = here.select("path", "modificationTime", "length")
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{work}/taken")
        fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        taken = [f.getPath().getName() for f in fs.listStatus(fs_path)] if fs.exists(fs_path) else []
        numbers = [int(n) for n in taken if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{work}/taken/{n}/_SUCCESS"))]
        if numbers:
            here = here.join(seen.parquet(*[f"{work}/taken/{n}" for n in numbers]), ["path", "modificationTime", "length"], "left_anti")
        batch = here.orderBy("modificationTime", "path")
        batch = (batch.limit(max_files) if max_files else batch).collect()  # names of files, as any listing
        if not batch:
            return done
        number = max(numbers, default=-1) + 1
        rows = spark.read.schema(schema).parquet(*[r["path"] for r in batch])
        handle(rows.select("*", "_metadata.file_path", F.col("_metadata.file_modification_time").alias("file_time")), number)
        spark.createDataFrame(batch, state).coalesce(1).write.mode("overwrite").parquet(f"{work}/taken/{number}")
        done += 1


def run_to_files(stream: DataFrame, work: str, partition_by: list[str] | None = None) -> str:
    """Append sink, run over everything available."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    out = f"{work}/out"
    _finish(writer.option("path", out).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start())
    return out


def run_batches(stream: DataFrame, work: str, handle: Batch, mode: str = "append") -> None:
    writer = stream.writeStream.outputMode(mode).foreachBatch(handle)
    _finish(writer.option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start())


def _finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def delta_writer(work: str, shape: Callable[[DataFrame], DataFrame]) -> Batch:
    """Write ``shape(batch)`` to the folder of its batch id."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").option("compression", "zstd").parquet(f"{work}/delta/batch={batch_id}")

    return handle


def fan_out(work: str, shapes: dict[str, Callable[[DataFrame], DataFrame]]) -> Batch:
    """Several reactions to one stream of events, each with its own delta folder."""
    handlers = [delta_writer(f"{work}/{name}", shape) for name, shape in shapes.items()]

    def handle(batch: DataFrame, batch_id: int) -> None:
        for one in handlers:
            one(batch, batch_id)

    return handle


def read_deltas(spark: SparkSession, work: str) -> DataFrame:
    """All deltas with their batch number."""
    return spark.read.parquet(f"{work}/delta").withColumn("batch", F.col("batch").cast("bigint"))


# -- ingest ----------------------------------------------------------------------------------------------------


def ingest_upsert(stream: DataFrame, work: str, keys: list[str], props: list[str], order: str) -> None:
    """Each batch is reduced to its last write per natural key and appended as a delta."""
    def shape(batch: DataFrame) -> DataFrame:
        kept = batch.groupBy(*keys).agg(F.max_by(F.struct(*props, order), F.col(order)).alias("__row"))
        return kept.select(*keys, "__row.*")

    run_batches(stream, work, delta_writer(work, shape))


def resolve(deltas: DataFrame, keys: list[str], props: list[str], order: Column) -> DataFrame:
    """Current table: last write per key over base and deltas."""
    return latest(deltas, keys, props, order)


def compact(deltas: DataFrame, keys: list[str], props: list[str], order: str, path: str) -> None:
    """Fold deltas into a new base at another path; readers switch over when it is complete."""
    kept = deltas.groupBy(*keys).agg(F.max_by(F.struct(*props, order), F.col(order)).alias("__row"))
    kept.select(*keys, "__row.*").write.mode("errorifexists").option("compression", "zstd").parquet(path)


# -- arrivals --------------------------------------------------------------------------------------------------


def react_to_arrivals(stream: DataFrame, work: str, classify: Callable[[DataFrame], DataFrame], rules: DataFrame) -> None:
    """Arrivals drive classification (folder ``types``) and forwarding (folder ``forward``).

    The series touched by a batch are reclassified, each once; ``classify`` maps (series_id) to (series_id, type_id).  One row
    per series and batch is kept, also when no type is left, so an older result is replaced, not added to.
    """
    def shape(batch: DataFrame) -> DataFrame:
        touched = batch.select("series_id").distinct()
        types = classify(touched).groupBy("series_id").agg(F.array_sort(F.collect_set("type_id")).alias("types"))
        return touched.join(types, "series_id", "left")

    def queued(batch: DataFrame) -> DataFrame:
        return match_rules(batch, rules).select("rule_id", "image_id").distinct()

    run_batches(stream, work, fan_out(work, {"types": shape, "forward": queued}))


def react_to_deletions(stream: DataFrame, work: str) -> None:
    """Deleted image ids as deltas; keys, members and links are resolved against them with an anti join on read."""
    run_batches(stream, work, delta_writer(work, lambda batch: batch.select("image_id").distinct()))


def current_types(deltas: DataFrame) -> DataFrame:
    newest = deltas.groupBy("series_id").agg(F.max_by("types", "batch").alias("types"))
    return newest.select("series_id", F.explode("types").alias("type_id"))


def distinct_arrivals(stream: DataFrame, key: str, ts: str, within: str) -> DataFrame:
    """First arrival per key inside the watermark."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def forwarding_sessions(stream: DataFrame, rules: DataFrame, idle: str, delay: str) -> DataFrame:
    """Closed transactions per rule.  Sessions are merged inside every input partition before the shuffle, so a rule that
    takes most of the arrivals sends few rows to its task."""
    matched = stream.withWatermark("ts", delay).join(rules, ["sourcetype", "sourceid"])
    return matched.groupBy(F.session_window("ts", idle), "rule_id").agg(
        F.count(F.lit(1)).alias("arrivals"), F.max("ts").alias("updated")
    ).select("rule_id", F.col("session_window.start").alias("started"), "updated", "arrivals")


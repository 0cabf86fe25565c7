"""Streams over several triggers and across a restart."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierbook.session import job_dir, work_dir
from tierbook.streaming import jobs as J

SCHEMA = "k string, v long, arrival long"


def put(spark, folder, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in{number}")


def test_upserts_go_on_from_the_checkpoint_and_compact(spark, tmp_path):
    folder, work = str(tmp_path / "arrivals"), str(tmp_path / "job")
    parts = [[("a", 1, 1), ("b", 1, 2)], [("a", 2, 5)], [("a", 3, 4), ("c", 1, 6)]]
    for number, rows in enumerate(parts):
        put(spark, folder, number, rows)

    def run():
        stream = J.watch_files(spark, folder, spark.createDataFrame([], SCHEMA).schema, max_files=1)
        J.ingest_upsert(stream, work, ["k"], ["v"], "arrival")
        return J.read_deltas(spark, work)

    first = run()
    assert first.select("batch").distinct().count() == 3
    assert {r["k"]: r["v"] for r in J.resolve(first, ["k"], ["v"], F.col("arrival")).collect()} == {"a": 2, "b": 1, "c": 1}
    J.compact(first, ["k"], ["v"], "arrival", f"{work}/base")
    put(spark, folder, 3, [("b", 9, 9)])
    second = run()
    assert second.select("batch").distinct().count() == 4
    late = second.filter("batch > 2").select("k", "v", "arrival")
    current = J.resolve(spark.read.parquet(f"{work}/base").unionByName(late), ["k"], ["v"], F.col("arrival"))
    assert {r["k"]: r["v"] for r in current.collect()} == {"a": 2, "b": 9, "c": 1}


def test_job_folders_are_stable_and_work_folders_fresh(spark):
    assert job_dir(spark, "a") == job_dir(spark, "a") != job_dir(spark, "b")
    assert work_dir(spark, "a") != work_dir(spark, "a")


def test_a_changed_file_arrives_again_once(spark, tmp_path):
    import shutil

    folder, work = tmp_path / "watched", str(tmp_path / "job")

    def put(name, rows):
        staged = tmp_path / f"staged-{name}-{len(rows)}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(staged))
        (folder / "deep").mkdir(parents=True, exist_ok=True)
        shutil.copyfile(next(staged.glob("*.parquet")), folder / "deep" / f"{name}.parquet")

    def run(limit=None, handle=None):
        return J.take_changes(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, work, handle or J.delta_writer(work, lambda batch: batch), limit)

    def found():
        return sorted((r["k"], r["v"], r["batch"]) for r in J.read_deltas(spark, work).collect())

    put("a", [("a", 1, 1)])
    put("b", [("b", 1, 1)])
    assert run(limit=1) == 2 and run() == 0
    put("a", [("a", 2, 2), ("a", 3, 2)])

    def lost(batch, number):
        raise RuntimeError("lost")

    try:
        run(handle=lost)
    except RuntimeError:
        pass
    assert len(found()) == 2
    assert run() == 1 and run() == 0
    assert [(k, v) for k, v, _ in found()] == [("a", 1), ("a", 2), ("a", 3), ("b", 1)] and {b for _, v, b in found() if v > 1} == {2}

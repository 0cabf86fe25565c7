"""What goes to the driver, and what goes through a shuffle, at the size it has in memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierbook import schema as S
from tierbook.operators import maintain as M
from tierbook.session import materialise


def test_well_packed_tables_are_not_broadcast(spark):
    texts = [F.lit(f"text {k}").alias(f"t{k}") for k in range(30)]
    stored = materialise(spark.range(400_000).select(F.xxhash64("id").alias("id"), *texts), "packed")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "500k")
        plan = spark.range(10_000_000).join(stored.select("id"), "id", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # 400 000 ids are 3 MB and more in a hash table, whatever share of the file they are taken for
    assert "BroadcastHashJoin" not in plan


def arrivals(spark):
    """Two series of one study with repeated images, one of another patient; the last write of each level lies on different rows."""
    props = list(dict.fromkeys(p for lv in S.LEVELS.values() for p in lv.props))
    rows = []
    for n, (patient, study, series, image) in enumerate([("a", "s", "x", "1"), ("a", "s", "x", "2"), ("a", "s", "y", "1"), ("a", "s", "x", "1"), ("b", "s", "x", "1"),
                                                         (None, "s", "x", "1"), ("a", None, "x", "1"), ("a", "s", "y", "1"), ("a", "s", "x", "2")]):
        keys = {"patientName": patient, "patientID": "7", "studyInstanceUID": study, "seriesInstanceUID": series, "sopInstanceUID": image}
        rows.append((*[keys.get(p, f"{p}{n}") for p in props], "box", f"box{n}", n, (n * 4) % 9))
    return spark.createDataFrame(rows, ", ".join(f"{p} string" for p in props) + ", sourcetype string, sourcename string, sourceid long, ord long").repartition(3)


def test_series_are_read_out_of_the_reduced_images(spark):
    batch = arrivals(spark)
    rolled = M._last_writes(batch.withColumn("__order", F.struct("ord")))
    for name in S.LEVELS:
        columns = [*M.key_path(name), *M.own_props(name)]
        want = M.latest(batch, M.key_path(name), M.own_props(name), F.col("ord"))
        assert sorted(map(str, rolled[name].select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    sources = M.latest(batch, M.key_path("series"), list(M.SOURCE), F.col("ord"))
    columns = [*M.key_path("series"), *M.SOURCE]
    assert sorted(map(str, rolled["series"].select(*columns).collect())) == sorted(map(str, sources.select(*columns).collect()))
    # nothing is shuffled once more to roll images up to series
    assert "Exchange" not in rolled["series"]._jdf.queryExecution().executedPlan().toString()


def test_an_empty_catalogue_is_met_without_a_shuffle(spark):
    empty = M.empty_catalogue(spark)
    plan = spark.range(5).join(empty.image.select("id", "sopInstanceUID"), "id", "left")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    got = M.ingest(empty, arrivals(spark).where("patientName is not null and studyInstanceUID is not null"), F.col("ord"))
    assert sorted(r["id"] for r in got.catalogue.image.collect()) == [1, 2, 3, 4]
    assert got.added.count() == 4 and got.added.where("patient_added and study_added and series_added and image_added").count() == 4


def test_images_are_replaced_with_one_shuffle_of_their_rows(spark, tmp_path, monkeypatch):
    from tierbook.plans import deidentify
    from tierbook.plans.fixtures import Fixtures

    seen = {}
    monkeypatch.setattr(deidentify.M, "level_changes", lambda before, after: seen.update(before=before, after=after) or before)
    deidentify.deid_replace(Fixtures(spark, "/root/testdata/sf0.001"))
    plan = seen["after"]._jdf.queryExecution().executedPlan().toString()
    # elements are neither gathered by image to be worked on nor to be read as levels; arrivals were reduced once, before
    assert plan.count("Exchange hashpartitioning(image_id") == 1 and "lineitem.parquet" not in plan
    assert "lineitem.parquet" not in seen["before"]._jdf.queryExecution().executedPlan().toString()


def test_rows_without_an_image_id_are_not_replaced(spark, tmp_path):
    from tierbook.plans import deidentify
    from tierbook.plans.fixtures import Fixtures

    spark.createDataFrame([(1, "N", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(5, "C", 1, "B")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("select k o_orderkey, 5L o_custkey, s o_orderstatus, timestamp'1998-01-01' o_orderdate, '1' o_orderpriority from values (7L, 'F'), (8L, 'O') as t(k, s)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("select o l_orderkey, 2L l_partkey, 3L l_suppkey, k l_linenumber, 1d l_quantity, 2d l_extendedprice, 'A' l_returnflag, 'F' l_linestatus, "
              "timestamp'1998-02-01' l_shipdate from values (7L, 1), (7L, 1), (7L, null), (8L, 2) as t(o, k)").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = sorted((r["level"], r["status"]) for r in deidentify.deid_replace(Fixtures(spark, str(tmp_path))).collect())
    # the two rows of series 7 go, what was put in place of the one with an id comes; patient and study stay for series 8
    assert found == sorted([("patient", "kept"), ("patient", "added"), ("study", "kept"), ("study", "added"), ("series", "kept"), ("series", "deleted"), ("series", "added"),
                            ("image", "kept"), ("image", "deleted"), ("image", "deleted"), ("image", "added")])


def test_tasks_are_joined_to_no_more_than_they_can_sort(spark):
    from tierbook.session import DEFAULTS, configure

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    assert spark.conf.get(key) == DEFAULTS[key] == "16m"
    try:
        spark.conf.set(key, "8m")
        assert configure(spark).conf.get(key) == "8m"  # a session's own size stays
    finally:
        spark.conf.set(key, DEFAULTS[key])

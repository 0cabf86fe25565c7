"""What is expensive to derive is derived once, and what there is most of meets one join."""

from __future__ import annotations

from tierbook.operators import maintain as M
from tierbook.operators import query as Q
from tierbook.plans.fixtures import Fixtures
from tierbook.plans.maintenance import wide_arrivals


def counted(frame):
    """The frame, and how many rows of it were derived."""
    seen = frame.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return frame.mapInArrow(count, frame.schema), seen


def test_deep_page_derives_rows_for_ranks_and_for_the_page(spark):
    rows, seen = counted(spark.range(3000).selectExpr("id", "cast(id % 7 as string) as name"))
    got = Q.page_by_rank(rows, "name", False, 1500, 10, few=60, splits=8).collect()
    plain = spark.range(3000).selectExpr("id", "cast(id % 7 as string) as name")
    assert got == Q.page(plain, "name", False, 1500, 10).collect()
    assert seen.value == 2 * 3000


def test_level_changes_derive_both_sets_once(spark):
    columns = M.key_path("image")
    make = [("p", "1", "st", "se", f"so{k}") for k in range(4)]
    before, n_before = counted(spark.createDataFrame([*make, make[0], ("p", None, "st", "se", "x")], columns))
    after, n_after = counted(spark.createDataFrame([*make[1:], ("p", "1", "st", "new", "y")], columns))
    found = {(r["level"], r["natural_key"]): r["status"] for r in M.level_changes(before, after).collect()}
    assert found == {
        ("patient", "p|1"): "kept", ("patient", "p"): "deleted", ("study", "p|1|st"): "kept", ("study", "p|st"): "deleted",
        ("series", "p|1|st|se"): "kept", ("series", "p|st|se"): "deleted", ("series", "p|1|st|new"): "added",
        ("image", "p|1|st|se|so0"): "deleted", **{("image", f"p|1|st|se|so{k}"): "kept" for k in (1, 2, 3)},
        ("image", "p|st|se|x"): "deleted", ("image", "p|1|st|new|y"): "added"}
    assert (n_before.value, n_after.value) == (6, 4)


def test_arrivals_meet_one_join(spark, tmp_path):
    spark.createDataFrame([(1, "N", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(5, "C", 1, "B")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("select 7L o_orderkey, 5L o_custkey, 'F' o_orderstatus, timestamp'1998-01-01' o_orderdate, '1' o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("select 7L l_orderkey, 2L l_partkey, 3L l_suppkey, k l_linenumber, 1d l_quantity, 2d l_extendedprice, 'A' l_returnflag, 'F' l_linestatus, "
              "timestamp'1998-02-01' l_shipdate from values (1), (1), (2) as t(k)").write.parquet(f"{tmp_path}/lineitem.parquet")
    wide = wide_arrivals(Fixtures(spark, str(tmp_path)))
    assert sorted((r["patientName"], r["sopInstanceUID"], r["protocolName"]) for r in wide.collect()) == [("N", "SO.7.1", "P2"), ("N", "SO.7.1", "P2"), ("N", "SO.7.2", "P2")]
    above: list[tuple[int, str]] = []  # the path from the root to a line of the plan
    for line in wide._jdf.queryExecution().optimizedPlan().treeString().splitlines():
        text = line.lstrip(" :+-")
        above = [*[(d, t) for d, t in above if d < len(line) - len(text)], (len(line) - len(text), text)]
        if text.startswith("Relation") and "l_orderkey" in text:
            assert sum(t.startswith("Join") for _, t in above) == 1
            return
    raise AssertionError("no scan of arrivals")

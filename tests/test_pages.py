"""Pages by rank equal pages by offset."""

from __future__ import annotations

import random

import pytest

from tierbook.operators import query as Q


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    names = [None, "", "Zoë", "z", "é", *(f"n{k}" for k in range(40))]
    data = [(k, "hot" if k % 3 == 0 else rng.choice(names), rng.choice([None, float("inf"), 1.5, -2.0, rng.random()])) for k in range(3000)]
    return spark.createDataFrame(data, "id long, name string, size double").repartition(5).cache()


@pytest.mark.parametrize("order, ascending", [("name", True), ("name", False), ("size", True), ("size", False), ("id", True), ("id", False)])
def test_any_page(rows, order, ascending):
    for start, count in ((0, 5), (17, 30), (1200, 20), (1999, 700), (2990, 30), (4000, 5)):
        want = [tuple(r) for r in Q.page(rows, order, ascending, start, count).collect()]
        got = [tuple(r) for r in Q.page_by_rank(rows, order, ascending, start, count, few=60, splits=8).collect()]
        assert got == want, (order, ascending, start)


def test_pages_of_nothing_and_of_equal_rows(spark, rows):
    assert Q.page_by_rank(rows.limit(0), "name", True, 3).collect() == []
    same = spark.range(500).selectExpr("id", "cast(null as string) as name")
    assert [r["id"] for r in Q.page_by_rank(same, "name", False, 321, 4, few=20, splits=4).collect()] == [321, 322, 323, 324]
    one = spark.range(500).selectExpr("0L as id", "'x' as name")  # ids that repeat cannot part the rows any further
    assert len(Q.page_by_rank(one, "name", True, 321, 4, few=20).collect()) == 4

"""Searches through the gram index return what the scan returns."""

from __future__ import annotations

import random

import pytest

from tierbook.operators import grams as G
from tierbook.operators.query import text_filter

COLUMNS = ["id", "name", "place"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abAB_%\\é1 ") for _ in range(rng.randrange(0, 9)))
    data = [(k, "common " + word() if k % 3 == 0 else word(), rng.choice([None, word(), "İstanbul K ΣΑΣ"])) for k in range(900)]
    return spark.createDataFrame(data, "id long, name string, place string").repartition(3).cache()


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    return G.GramIndex(spark, str(tmp_path_factory.mktemp("grams")), COLUMNS, buckets=16).build(rows)


def test_random_filters(rows, index):
    rng = random.Random(10)
    held = [x for r in rows.collect() for x in (r["name"], r["place"]) if x and len(x) > 3]
    for k in range(24):
        text = rng.choice(held)
        at = rng.randrange(0, len(text) - 2)
        value = rng.choice([text[at : at + rng.randrange(1, 7)], text[:4].upper(), text[at : at + 2] + "%" + text[-2:], "_" + text[1:4], "absent", "", "%", "88"])
        prefix = k % 3 == 0
        got = sorted(r["id"] for r in index.search(rows, value, prefix).collect())
        assert got == sorted(r["id"] for r in text_filter(rows, COLUMNS, value, prefix).collect()), (value, prefix)


def test_a_gram_reads_one_folder_and_its_rows(index):
    plan = index.list_of("com")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(gram,com)" in plan
    assert index.list_of("com").count() > 50 * max(1, index.list_of("88").count())


def test_grams_of_filters():
    assert G.grams_of("Abcd", False) == ["abc", "bcd"] and G.grams_of("ab", True) == ["\x02ab"] and G.grams_of("ab", False) == []
    assert G.grams_of("abc%de_fgh", False) == ["abc", "fgh"] and G.grams_of("%abc", True) == ["abc"] and G.grams_of("aéb", False) == []


def test_an_empty_table(spark, rows, tmp_path):
    none = rows.limit(0)
    index = G.GramIndex(spark, str(tmp_path), COLUMNS, buckets=4).build(none)
    assert index.search(none, "abc").collect() == [] and index.search(none, "a").collect() == []

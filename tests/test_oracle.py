"""Every registered query against its SQL check on the smallest tables; the corpus operators have tests of their own."""

from __future__ import annotations

import re

import check
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)]


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, con, name):
    sql = entry.oracle_sql().get(name)
    ok, text = check.compare(spark, con, name, SF, entry.queries()[name], sql)
    assert ok, text
    assert "types differ" not in text, text


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_query_has_a_check():
    assert set(NAMES) <= set(entry.oracle_sql())

"""Key matching by path hashes against a plain search of all keys."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tierbook.operators import keys as K

SCHEMA = "id long, created long, " + ", ".join(f"{c} string" for c in (*K.REAL, *K.ANON))


def plain(requests, keys):
    out = {}
    for image, *values in requests:
        out[image] = (1, None)
        for level, depth in ((4, 5), (3, 4), (2, 3), (1, 2)):
            # a request whose series path is not whole asks for nothing
            found = [k for k in keys if None not in values[:4] and None not in values[:depth] and k[2 : 2 + depth] == values[:depth]]
            if found:
                out[image] = (level, max((k[1], k[0]) for k in found)[1])
                break
    return out


def test_deepest_level_and_newest_key(spark):
    rng = random.Random(4)

    def path():
        return [rng.choice(["Doe", "doe", "", "Ré", None]), rng.choice("12"), rng.choice(["s1", "s2", None]), rng.choice(["e1", "e2", "1e", None]), rng.choice(["o1", "o2", "o3", None])]

    keys = [[k, rng.randrange(4), *path(), *"abcde"] for k in range(120)]
    requests = [[k, *path()] for k in range(400)]
    asked = spark.createDataFrame(requests, "image_id long, " + ", ".join(f"{c} string" for c in K.REAL)).repartition(3)
    held = spark.createDataFrame(keys, SCHEMA).repartition(2)
    found = {r["image_id"]: (r["match_level"], r["key_id"]) for r in K.match_keys(asked, held).collect()}
    # equal paths: rows of one path are told apart by created, then id
    assert found == plain(requests, keys)
    assert {level for level, _ in found.values()} == {1, 2, 3, 4}
    assert {r["key_id"] for r in K.match_keys(asked, held.limit(0)).collect()} == {None}
    assert K.match_keys(asked.limit(0), held).collect() == []


def test_values_decide_where_hashes_are_equal(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *cols: F.lit(7).cast("long"))
    keys = spark.createDataFrame([[1, 1, "n", "i", "s", "e", "o", *"abcde"]], SCHEMA)
    asked = spark.createDataFrame([[1, "n", "i", "s", "e", "o"], [2, "x", "i", "s", "e", "o"], [3, "n", "i", "s", "e", "z"]], "image_id long, " + ", ".join(f"{c} string" for c in K.REAL))
    found = {r["image_id"]: r["key_id"] for r in K.match_keys(asked.where("image_id = 1"), keys).collect()}
    assert found == {1: 1}
    assert all(r["key_id"] is None for r in K.match_keys(asked.where("image_id = 2"), keys).collect())


def test_paths_are_chained(spark):
    rows = [("ab", "c", "d", "e", "f"), ("a", "bc", "d", "e", "f"), ("ab", "c", "de", "", "f"), ("ab", "c", "d", "e", None), ("ab", None, "d", "e", "f")]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in K.REAL))
    found = frame.select(*K.path_hash([F.col(c) for c in K.REAL])).collect()
    assert found[0][0] != found[1][0] and found[0][0] == found[2][0] == found[3][0]
    assert found[0][3] != found[2][3] and found[3][3] is None and found[3][2] == found[0][2] and set(found[4]) == {None}


def test_a_key_is_collected_after_its_shuffle(spark):
    keys = spark.createDataFrame([[1, 1, *"nisef", *"abcde"], [1, 2, *"nisef", *"Abcde"], [2, 1, *"nisef", *"vwxyz"], [None, 1, *"nisef", *"abcde"]], SCHEMA)
    values = spark.createDataFrame([[1, "(0008,1030)", "x", "b"], [1, "(0008,1030)", "x", "a"], [3, "(0020,0010)", "x", None]], "key_id long, tag_path string, value string, anon_value string")
    maps = K.key_maps(keys, values, "anon_value")
    plan = maps._jdf.queryExecution().executedPlan().toString()
    found = {r["key_id"]: r["pairs"] for r in maps.collect()}
    name = K.IDENTITY_PATHS[0]
    assert found[1] == dict(zip(K.IDENTITY_PATHS, "Abcde", strict=True)) | {"(0008,1030)": "a"}
    assert found[2][name] == "v" and found[3] == {"(0020,0010)": None} and set(found) == {1, 2, 3}
    # nothing is aggregated or spread below the shuffle, and one sort serves all
    above, below = plan.split("Exchange", 1)
    assert "SortAggregate" in above and "Aggregate" not in below and "Generate" not in below and above.count("Sort [") == 1


def test_requests_and_keys_go_through_one_shuffle(spark, tmp_path):
    spark.createDataFrame([[1, "n", "i", "s", "e", "o", "x"], [2, None, "i", "s", "e", "o", "y"]], "image_id long, " + ", ".join(f"{c} string" for c in (*K.REAL, "note"))).write.parquet(f"{tmp_path}/asked")
    spark.createDataFrame([[7, 1, "n", "i", "s", "e", "z", *"abcde"], [8, 2, "n", "i", "t", "e", "z", *"abcde"], [9, 3, None, "i", "s", "e", "o", *"abcde"]], SCHEMA).write.parquet(f"{tmp_path}/keys")
    matched = K.match_keys(spark.read.parquet(f"{tmp_path}/asked"), spark.read.parquet(f"{tmp_path}/keys"))
    assert sorted(tuple(r) for r in matched.select("image_id", "note", "match_level", "key_id").collect()) == [(1, "x", 3, 7), (2, "y", 1, None)]
    above: list[tuple[int, str]] = []  # the path from the root to a line of the plan
    shuffles = {}
    for line in matched._jdf.queryExecution().sparkPlan().treeString().splitlines():
        text = line.lstrip(" :+-")
        above = [*[(d, t) for d, t in above if d < len(line) - len(text)], (len(line) - len(text), text)]
        if text.startswith("FileScan"):
            shuffles[text] = ("note" in text, sum(t.startswith("Exchange") for _, t in above), any("Join" in t for _, t in above))
    # the wide rows of the requests, and the keys as they are, meet no join
    assert [n for wide, n, joined in shuffles.values() if wide] == [1] and [j for wide, _, j in shuffles.values() if wide] == [False]
    assert sum(not joined for _, _, joined in shuffles.values()) == 2


def test_keys_travel_without_their_paths(spark):
    keys = spark.createDataFrame([[1, 1, *"nisef", *"abcde"], [1, 1, "n", None, *"sef", "a", None, *"cde"]], SCHEMA)
    values = spark.createDataFrame([[1, K.IDENTITY_PATHS[0], "x", "A"], [1, None, "x", "y"], [2, "(0020,0010)", "x", None]], "key_id long, tag_path string, value string, anon_value string")
    maps = K.key_maps(keys, values.where("tag_path is not null"), "anon_value")
    below = maps._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)[1]
    found = {r["key_id"]: r["pairs"] for r in maps.collect()}
    # a stored pair of an identity path counts beside the key's own, the least value first, null before all
    assert found[1][K.IDENTITY_PATHS[0]] == "A" and found[1][K.IDENTITY_PATHS[1]] is None and found[1][K.IDENTITY_PATHS[4]] == "e" and found[2] == {"(0020,0010)": None}
    assert K.IDENTITY_PATHS[0] not in below

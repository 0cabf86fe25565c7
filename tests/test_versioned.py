"""Bucketed tables with versions, and deletion by counts, against whole-table twins."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from data import catalogue, frame
from tierbook import schema as S
from tierbook.operators import maintain as M
from tierbook.operators.refcounts import UPWARDS, Hierarchy
from tierbook.sources.versioned import Versioned


def size(path) -> int:
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_random_merges_and_deletes(spark, tmp_path):
    rng, kind = random.Random(1), "k string, j long, v string"
    table = Versioned(spark, str(tmp_path / "t"), ["k", "j"], buckets=8, fold=0.5)
    plain = {(f"k{k}", k % 3): "first" for k in range(200)}
    table.create(spark.createDataFrame([(*k, v) for k, v in plain.items()], kind))
    history = {table.manifest()["version"]: dict(plain)}
    for step in range(8):
        new = {(f"k{rng.randrange(260)}", rng.randrange(3)): rng.choice(["x", "y", None]) for _ in range(rng.randrange(1, 25))}
        gone = [k for k in rng.sample(sorted(plain), 5) if k not in new]
        table.merge(spark.createDataFrame([(*k, v) for k, v in new.items()], kind), spark.createDataFrame([*gone, ("absent", 1)], "k string, j long"))
        plain |= new
        for k in gone:
            plain.pop(k)
        found = {(r["k"], r["j"]): r["v"] for r in table.read().collect()}
        assert found == plain, step
        history[table.manifest()["version"]] = dict(plain)
        asked = rng.sample(sorted(plain), 3)
        assert {(r["k"], r["j"]) for r in table.lookup(spark.createDataFrame([*asked, ("absent", 2)], "k string, j long")).collect()} == set(asked)
    assert not table.manifest()["deltas"] or len(table.manifest()["deltas"]) < 8
    for version, rows in history.items():
        assert {(r["k"], r["j"]): r["v"] for r in table.read(version).collect()} == rows
    assert table.read().columns == ["k", "j", "v"]


def test_a_small_batch_writes_little_and_a_lookup_reads_little(spark, tmp_path):
    table = Versioned(spark, str(tmp_path / "t"), ["id"], buckets=32)
    table.create(spark.range(100_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v")))
    before = size(tmp_path)
    table.merge(spark.range(0, 100_000, 100).select("id", F.sha2(F.lit("new"), 256).alias("v")))
    assert size(tmp_path) - before < 0.05 * before
    assert table.read().where(F.col("v") == F.sha2(F.lit("new"), 256)).count() == 1000 and table.read().count() == 100_000
    few = table.lookup(spark.createDataFrame([(5,), (7,)], "id long"))
    assert few.count() == 2 and len(few.inputFiles()) <= 4 < 32 <= len(table.read().inputFiles())


def test_a_failed_run_leaves_the_old_version(spark, tmp_path):
    table = Versioned(spark, str(tmp_path / "t"), ["id"], buckets=4)
    table.create(spark.range(100).select("id", F.lit("old").alias("v")))
    broken = spark.range(50).select("id", F.when(F.col("id") < 49, "new").otherwise(F.raise_error(F.lit("lost"))).alias("v"))
    with pytest.raises(Exception, match="lost"):
        table.merge(broken)
    (tmp_path / "t" / "manifest" / "2.json").write_text('{"version": 2, "sch')  # a publisher that died on the way
    assert {r["v"] for r in table.read().collect()} == {"old"} and table.manifest()["version"] == 1
    (tmp_path / "t" / "manifest" / "2.json").write_text("")
    with pytest.raises(Exception, match="2.json"):  # nor does a second writer take a version that is taken
        table._publish(table.manifest() | {"version": 2})


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "id long, v string")
    table = Versioned(spark, str(tmp_path / "t"), ["id"], buckets=4).create(none)
    assert table.read().collect() == []
    table.merge(none)
    assert table.manifest()["version"] == 1
    table.merge(spark.createDataFrame([(1, None)], "id long, v string"))
    assert [tuple(r) for r in table.read().collect()] == [(1, None)]
    table.merge(none, delete=spark.createDataFrame([(1,)], "id long"))
    assert table.read().collect() == []


def ids(frames) -> dict[str, list[int]]:
    return {name: sorted(r["id"] for r in f.select("id").collect()) for name, f in frames.items()}


def test_deletes_by_counts_equal_whole_deletes(spark, tmp_path):
    rng = random.Random(2)
    rows = {
        "patient": [(k, f"p{k}", f"s{k}", "", "") for k in range(6)],
        "study": [(k, rng.randrange(6), f"u{k}", *[""] * 5) for k in range(14)],
        "series": [(k, rng.randrange(14), f"e{k}", *[""] * 8) for k in range(30)],
        "image": [(k, rng.randrange(30), f"o{k}", "", "") for k in range(90)],
    }
    from dataclasses import replace

    cat = replace(catalogue(spark), **{name: frame(spark, name, r) for name, r in rows.items()})
    tree = Hierarchy(spark, str(tmp_path), buckets=8).create(cat)
    number = 90
    for step in range(4):
        gone = spark.createDataFrame([(k,) for k in rng.sample(range(number), 35)] + [(9999,), (3,), (3,)], "id long")
        whole = M.cascade_delete(cat, gone)
        assert ids(tree.delete(gone)) == ids(whole.deleted), step
        assert ids({n: tree.levels[n].read() for n in UPWARDS}) == ids(whole.survivors), step
        # new images, some of known series, one in a new series, and one that moves to another series
        alive = [r["id"] for r in tree.levels["study"].read().collect()]
        kept = ids(whole.survivors)
        if not alive or len(kept["image"]) < 2:
            break
        series = (1000 + step, alive[0], f"e{1000 + step}", *[""] * 8)
        images = [(number + k, rng.choice([1000 + step, *kept["series"]]), f"o{number + k}", "", "") for k in range(20)]
        moved = (kept["image"][0], 1000 + step, "moved", "", "")
        number += 20
        tree.insert("series", frame(spark, "series", [series]))
        tree.insert("image", frame(spark, "image", [*images, moved]))
        left = {n: [tuple(r) for r in whole.survivors[n].collect()] for n in UPWARDS}
        left["series"].append(series)
        left["image"] = [r for r in left["image"] if r[0] != moved[0]] + [*images, moved]
        cat = replace(cat, **{n: frame(spark, n, r) for n, r in left.items()})
    counts = {(r["level"], r["id"]): r["n"] for r in tree.counts.read().collect()}
    for name in ("image", "series", "study"):
        ref = S.LEVELS[name].ref
        per = {(S.LEVELS[name].parent, r[ref]): r["count"] for r in tree.levels[name].read().groupBy(ref).count().collect()}
        assert {k: n for k, n in counts.items() if k[0] == S.LEVELS[name].parent} == per

from __future__ import annotations

import itertools
from dataclasses import replace

import pytest
from data import catalogue, frame
from pyspark.sql import functions as F

from tierbook.operators import maintain as M
from tierbook.operators import query as Q


@pytest.fixture(scope="module")
def cat(spark):
    return catalogue(spark)


def count(cat, level, *predicates, filters=Q.Filters()):
    return Q.run_query(cat, level, Q.Query(predicates=predicates, filters=filters)).count()


def test_property_queries(cat):
    assert count(cat, "patient", Q.Predicate("patientName", "=", "p1")) == 1
    assert count(cat, "patient", Q.Predicate("patientName", "=", "p2")) == 0
    assert count(cat, "patient", Q.Predicate("studyDate", "=", "19990102"), Q.Predicate("manufacturer", "=", "manu3")) == 1
    # both predicates hold, but never on one chain of rows
    assert count(cat, "patient", Q.Predicate("studyDate", "=", "19990101"), Q.Predicate("manufacturer", "=", "manu3")) == 0
    assert count(cat, "study", Q.Predicate("bodyPartExamined", "=", "bodypart1")) == 2
    assert count(cat, "series", Q.Predicate("manufacturer", "=", "manu3")) == 2
    assert count(cat, "image", Q.Predicate("instanceNumber", "=", "1"), Q.Predicate("studyDate", "=", "19990101")) == 2
    assert count(cat, "flat_series", Q.Predicate("patientSex", "=", "M"), Q.Predicate("protocolName", "like", "ot1")) == 2


@pytest.mark.parametrize(("sources", "expected"), [
    ((), 4), ((("box", 1),), 1), ((("box", 1), ("scp", 1)), 2), ((("scp", -1),), 0),
    ((("user", 1), ("box", 1), ("directory", 1), ("scp", 1)), 4),
])
def test_source_filters(cat, sources, expected):
    assert Q.list_flat_series(cat, filters=Q.Filters(sources=sources)).count() == expected


@pytest.mark.parametrize(("tags", "expected"), [((1, 2), 3), ((1,), 2), ((2,), 2), ((-1,), 0)])
def test_tag_filters(cat, tags, expected):
    assert Q.list_flat_series(cat, filters=Q.Filters(tag_ids=tags)).count() == expected


def test_argument_combinations_agree_with_brute_force(spark, cat):
    series = {r.id: r for r in cat.series.collect()}
    sources = {r.id: (r.sourcetype, r.sourceid) for r in cat.series_sources.collect()}
    tags = {(r.series_id, r.tag_id) for r in cat.series_tag_links.collect()}
    types = {(r.series_id, r.type_id) for r in cat.series_type_links.collect()}
    options = itertools.product([(), (("box", 1), ("user", 1))], [(), (1,), (1, 2)], [(), (2,)], [None, "manu"])
    for src, typ, tag, text in options:
        got = {r.id for r in Q.list_flat_series(cat, text, Q.Filters(src, typ, tag), "id", False).collect()}
        want = {
            i for i in series
            if (not src or sources[i] in src) and (not typ or any((i, t) in types for t in typ))
            and (not tag or any((i, t) in tags for t in tag))
        }
        assert got == want, (src, typ, tag, text)


def test_unknown_properties_are_refused(cat):
    with pytest.raises(ValueError):
        count(cat, "patient", Q.Predicate("missing", "=", "x"))
    with pytest.raises(ValueError):
        count(cat, "series", Q.Predicate("sopInstanceUID", "=", "x"))
    with pytest.raises(ValueError):
        Q.run_query(cat, "patient", Q.Query(order_by="studyDate"))
    with pytest.raises(ValueError):
        Q.Predicate("patientName", "<", "x")


def test_wildcards_quotes_and_nulls(spark):
    rows = [(1, "50% off", "a", "", ""), (2, "under_score", "b", "", ""), (3, "O'Hara", "c", "", ""),
            (4, "back\\slash", "d", "", ""), (5, None, "e", "", ""), (6, "", "f", "", "")]
    base = catalogue(spark)
    cat = replace(base, patient=frame(spark, "patient", rows))

    def ids(value):
        q = Q.Query(predicates=(Q.Predicate("patientName", "like", value),))
        return {r.id for r in Q.run_query(cat, "patient", q).collect()}

    assert ids("O'H") == {3}
    assert ids("k\\s") == {4}
    assert ids("r_s") == {2}
    assert ids("%") == {1, 2, 3, 4, 6}
    assert {r.id for r in Q.list_patients(cat, "HARA").collect()} == {3}


def test_paging(cat):
    pages = [[r.id for r in Q.run_query(cat, "series", Q.Query(s, 2, "manufacturer", False)).collect()] for s in (0, 2, 4)]
    assert pages == [[3, 4], [2, 1], []]


def test_studies_without_series_vanish_only_with_filters(spark, cat):
    extra = frame(spark, "study", [(9, 1, "stuid9", "", "", "", "", "")])
    wider = replace(cat, study=cat.study.unionByName(extra))
    assert Q.studies_for_patient(wider, 1).count() == 3
    assert Q.studies_for_patient(wider, 1, Q.Filters(sources=(("user", 1), ("directory", 1)))).count() == 2


def test_drill_down(cat):
    assert Q.images_for_study(cat, 1).count() == 4
    assert Q.images_for_study(cat, 1, Q.Filters(tag_ids=(2,))).count() == 2
    assert Q.images_for_patient(cat, 1, Q.Filters(type_ids=(2,))).count() == 4
    assert Q.images_for_series(cat, 3, "SOUID5").count() == 1


def test_cascade_delete_counts(spark, cat):
    def left(ids):
        out = M.cascade_delete(cat, spark.createDataFrame([(i,) for i in ids], "id bigint"))
        counts = tuple(out.survivors[n].count() for n in ("patient", "study", "series", "image"))
        gone = tuple(out.deleted[n].count() for n in ("patient", "study", "series", "image"))
        return counts, gone

    assert left([1]) == ((1, 2, 4, 7), (0, 0, 0, 1))
    assert left([1, 2]) == ((1, 2, 3, 6), (0, 0, 1, 2))
    assert left([1, 2, 3, 4]) == ((1, 1, 2, 4), (0, 1, 2, 4))
    assert left(range(1, 9)) == ((0, 0, 0, 0), (1, 2, 4, 8))
    assert left([99]) == ((1, 2, 4, 8), (0, 0, 0, 0))


def test_parents_that_were_empty_before_stay(spark, cat):
    extra = frame(spark, "series", [(9, 1, "seuid9", *[""] * 8)])
    wider = replace(cat, series=cat.series.unionByName(extra))
    out = M.cascade_delete(wider, spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id bigint"))
    assert {r.id for r in out.deleted["series"].collect()} == {1, 2}
    assert out.deleted["study"].count() == 0


def test_upsert(spark):
    old = spark.createDataFrame([("a", "1", "x"), ("b", "1", "y")], "k string, k2 string, v string")
    batch = spark.createDataFrame([("b", "1", "z", 1), ("b", "1", "w", 2), ("c", "1", "n", 1)],
                                  "k string, k2 string, v string, at int")
    rows = {(r.k, r.v, r.status) for r in M.upsert(old, batch, ["k", "k2"], ["v"], F.col("at")).collect()}
    assert rows == {("a", "x", "kept"), ("b", "w", "updated"), ("c", "n", "added")}


def test_long_names_are_cut_on_insert_and_lookup(spark, cat):
    name = "n" * 200
    wide = spark.createDataFrame([(name, "x", "1", "2", "3")],
                                 "patientName string, patientID string, studyInstanceUID string, seriesInstanceUID string, "
                                 "sopInstanceUID string").withColumn("patientName", F.substring("patientName", 1, 180))
    known = replace(cat, patient=frame(spark, "patient", [(7, name, "x", "", "")]))
    assert M.resolve_ids(wide, known).first().patient_id == 7


def test_tags(spark, cat):
    ask = spark.createDataFrame([(1, "Tag1"), (4, "New"), (3, "New"), (99, "Other")], "series_id bigint, name string")
    tags, links = M.add_tags(cat.series_tags, cat.series_tag_links, ask, cat.series)
    assert {(r.id, r.name) for r in tags.collect()} == {(1, "Tag1"), (2, "Tag2"), (3, "New")}
    assert {(r.series_id, r.tag_id) for r in links.collect()} == {(1, 1), (1, 2), (2, 1), (3, 2), (4, 3), (3, 3)}
    left = M.remove_links(links, spark.createDataFrame([(4, 3)], "series_id bigint, tag_id bigint"))
    assert (4, 3) not in {(r.series_id, r.tag_id) for r in left.collect()}


def test_saved_filter_text():
    assert Q.parse_source_refs("box:23,user:2") == (("box", 23), ("user", 2))
    assert Q.parse_source_refs("fax:1") == (("unknown", 1),)
    assert Q.parse_ids("2,5,11") == (2, 5, 11)
    for bad in ("box", "box:x"):
        with pytest.raises(ValueError):
            Q.parse_source_refs(bad)
    with pytest.raises(ValueError):
        Q.parse_ids("2,x")

"""Cases beyond the fixtures: whole images, arrival order, nested sequences, deep paths and pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tierbook.functions.paths import path_of_json
from tierbook.operators import query as Q
from tierbook.operators import rules as R
from tierbook.operators import transfer as T
from tierbook.operators.profile import ATTRIBUTE_OPS, Profile, read_operations
from tierbook.sources import attributes as A

ELEMENT = "image_id long, tag_path string, values array<string>"


def test_images_without_wanted_attributes_are_reported(spark):
    rows = [(1, "(0008,0016)", ["c"]), (1, "(0002,0010)", ["s"]), (2, "(0010,0010)", ["Anna"]), (3, "(0028,0008)", ["x"]), (4, "(0020,0013)", ["12"])]
    elements = spark.createDataFrame(rows, ELEMENT)
    info = {r[0]: tuple(r[1:]) for r in A.image_information(elements).collect()}
    assert info == {1: (1, 1, 0, 0), 2: (1, 1, 0, 0), 3: (1, 1, 0, 0), 4: (1, 12, 0, 0)}
    levels = {r["image_id"]: r["patientName"] for r in A.extract_levels(elements).collect()}
    assert levels == {1: "", 2: "Anna", 3: "", 4: ""}
    allowed = spark.createDataFrame([("c", "s")], "sop_class string, transfer_syntax string")
    found = {r["image_id"]: r["accepted"] for r in A.validate_contexts(A.context_rows(elements), allowed).collect()}
    assert found == {1: True, 2: False, 3: False, 4: False}


def test_incoming_totals_follow_arrival(spark):
    events = spark.createDataFrame(
        [(1, 7, 2, 20, True, 5, 1000), (1, 7, 1, 10, True, 9, 900_000)],
        "box_id long, transaction_id long, sequence long, image_id long, added boolean, total long, ts_ms long")
    row = T.incoming_progress(events).first()
    assert (row["total"], row["received"], row["added"]) == (9, 2, 2)


def test_values_belong_to_one_transaction(spark):
    requests = spark.createDataFrame([(1, 1, 5), (2, 1, 5)], "transaction_id long, box_id long, image_id long")
    values = spark.createDataFrame([(1, 5, "(0010,0010)", "x")], "transaction_id long, image_id long, tag_path string, value string")
    assert [r["transaction_id"] for r in T.create_outgoing(requests, values)["values"].collect()] == [1]


def test_rules_read_sequences_inside_sequences(spark):
    elements = spark.createDataFrame(
        [(1, "(0008,0060)", ["root"]), (1, "(0040,0275)[1].(0008,1140)[1].(0008,0060)", ["F"]), (1, "(0040,0275)[2].(0008,1140)[1].(0008,0060)", ["G"]),
         (2, "(0008,0060)", ["F"])], "series_id long, tag_path string, values array<string>")
    deep, outer = "(0040,0275)[1].(0008,1140)", "(0040,0275)"
    attributes = spark.createDataFrame([(1, "(0008,0060)", deep, "F"), (2, "(0008,0060)", outer, "root")], "rule_id long, tag string, sequence string, expected string")
    found = R.rule_values(elements, attributes, sequences=True).filter("sequence <> ''").collect()
    # the outer sequence has a first item without the attribute, so nothing is read for it
    assert sorted((r["series_id"], r["sequence"], r["value"]) for r in found) == [(1, deep, "F"), (2, outer, "F"), (2, deep, "F")]


@pytest.mark.parametrize("steps", [1, 2, 7, 8, 30])
def test_paths_of_any_depth(spark, steps):
    document, text = "", ""
    for k in range(steps):
        last = k == steps - 1
        item = "" if last else f', "item": "{k + 1}"'
        document = f'{{"tag": {0x00400275 + k}{item}' + (f', "previous": {document}' if document else "") + "}"
        text += ("." if text else "") + f"(0040,{0x0275 + k:04X})" + ("" if last else f"[{k + 1}]")
    frame = spark.createDataFrame([(document,), ("{",), ('{"item": "1"}',), (None,)], "d string")
    assert [r[0] for r in frame.select(path_of_json(F.col("d"))).collect()] == [text, None, None, None]


def test_pages_have_a_size_and_can_be_read_by_key(spark):
    frame = spark.range(100).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 5).alias("kind"))
    assert Q.page(frame, "kind", True, 30).count() == Q.PAGE_ROWS
    for ascending in (True, False):
        whole = [(r["kind"], r["id"]) for r in Q.page(frame, "kind", ascending).collect()]
        got, last = [], None
        while part := [(r["kind"], r["id"]) for r in Q.page_after(frame, "kind", ascending, last, 13).collect()]:
            got, last = got + part, part[-1]
        assert got == whole
    plan = Q.page_after(frame, "kind", True, (3, 8))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "SinglePartition" not in plan


def test_no_personal_attribute_of_the_profile_survives():
    basic = Profile(("BASIC_PROFILE",))
    for text, code in ATTRIBUTE_OPS["BASIC_PROFILE"]:
        if "x" not in text and text != "odd":
            assert basic.op_of(int(text.replace(",", ""), 16)) == code != "K"
    for tag in (0x00101005, 0x00101060, 0x00101080, 0x00102297, 0x00102152, 0x60003000, 0x00190010):
        assert basic.op_of(tag) is not None


def test_operations_from_a_file(tmp_path):
    path = tmp_path / "table.csv"
    path.write_text("option,attribute,operation\nBASIC_PROFILE,\"0010,0010\",X\nRETAIN_UIDS,\"0020,000D\",K\n")
    mine = Profile(("BASIC_PROFILE", "RETAIN_UIDS"), read_operations(str(path)))
    assert (mine.op_of(0x00100010), mine.op_of(0x0020000D), mine.op_of(0x00100020)) == ("X", "K", None)
    path.write_text("option,attribute,operation\nNO_SUCH,\"0010,0010\",X\n")
    with pytest.raises(ValueError, match="NO_SUCH"):
        read_operations(str(path))


def test_keys_match_at_the_deepest_level_and_duplicates_do_no_harm(spark):
    from tierbook.operators import keys as K

    columns = ["id long", "created long", "image_id long"] + [f"{c} string" for pair in zip(K.REAL, K.ANON, strict=True) for c in pair]

    def key(i, created, *values):
        return (i, created, i, *[x for v in values for x in (v, f"a{v}")])

    keys = spark.createDataFrame([key(1, 1, "P", "1", "st", "se", "im"), key(2, 5, "P", "1", "st", "se", "im"), key(3, 9, "P", "1", "st", "se2", "im9"),
                                  key(4, 2, "P", "1", "st3", "se3", "im3")], ", ".join(columns))
    asked = [(1, "P", "1", "st", "se", "im"), (2, "P", "1", "st", "se", "x"), (3, "P", "1", "st", "y", "x"), (4, "P", "1", "z", "y", "x"), (5, "Q", "1", "st", "se", "im")]
    requests = spark.createDataFrame(asked, "image_id long, " + ", ".join(f"{c} string" for c in K.REAL))
    found = {r["image_id"]: (r["match_level"], r["key_id"]) for r in K.match_keys(requests, keys).collect()}
    assert found == {1: (4, 2), 2: (3, 2), 3: (2, 3), 4: (1, 3), 5: (1, None)}
    values = spark.createDataFrame([(1, "(0008,1030)", "b", "ab"), (1, "(0008,1030)", "a", "aa"), (1, "(0010,0010)", "P", "aP")],
                                   "key_id long, tag_path string, value string, anon_value string")
    maps = {r["key_id"]: r["pairs"] for r in K.key_maps(keys, values, "value").collect()}
    assert maps[1]["(0008,1030)"] == "a" and len(maps[1]) == 6


def test_ingest_keeps_ids_links_levels_and_feeds_queries(spark):
    from tierbook import schema as S
    from tierbook.operators import maintain as M

    props = [p for lv in S.LEVELS.values() for p in lv.props]

    def arrivals(*rows):
        data = [tuple({"patientName": p, "patientID": "1", "studyInstanceUID": st, "seriesInstanceUID": se, "sopInstanceUID": im, "modality": mod}.get(c, "")
                      for c in props) + (src, src + "1", 1, t) for p, st, se, im, mod, src, t in rows]
        return spark.createDataFrame(data, ", ".join(f"{p} string" for p in props) + ", sourcetype string, sourcename string, sourceid long, t long")

    first = M.ingest(M.empty_catalogue(spark), arrivals(("A", "st", "se", "i1", "CT", "box", 1), ("A", "st", "se", "i2", "MR", "user", 2),
                                                        ("A", "st", "se", "i1", "CT", "box", 0)), F.col("t"))
    assert [r[2:] for r in first.added.select("image_id", "series_id", "patient_added", "study_added", "series_added", "image_added").collect()] == [(True,) * 4] * 2
    assert first.catalogue.series.first()["modality"] == "MR" and first.catalogue.series_sources.first()["sourcetype"] == "user"
    old = {r["sopInstanceUID"]: r["id"] for r in first.catalogue.image.collect()}
    second = M.ingest(first.catalogue, arrivals(("A", "st", "se", "i2", "PT", "scp", 3), ("A", "st2", "se", "i2", "NM", "box", 4), ("B", "st", "se", "i1", "CT", "box", 5)), F.col("t"))
    cat = second.catalogue
    images = [(r["sopInstanceUID"], r["id"]) for r in cat.image.collect()]
    assert len(images) == 4 == len({i for _, i in images}) and set(old.items()) <= set(images)
    assert (cat.patient.count(), cat.study.count(), cat.series.count(), cat.series_sources.count()) == (2, 3, 3, 3)
    flags = sorted(tuple(r[c] for c in ("patient_added", "study_added", "series_added", "image_added")) for r in second.added.collect())
    assert flags == [(False,) * 4, (False, True, True, True), (True,) * 4]
    found = Q.run_query(cat, "series", Q.Query(predicates=(Q.Predicate("modality", "=", "PT"),), filters=Q.Filters(sources=(("scp", 1),)))).collect()
    assert len(found) == 1


def test_images_of_closed_transactions_can_be_deleted(spark):
    from tierbook.operators import forwarding as W

    rules = spark.createDataFrame([(1, "box", 1, "scu", 5, False), (2, "box", 2, "scu", 5, False), (3, "box", 3, "scu", 5, True)],
                                  "rule_id long, sourcetype string, sourceid long, destinationtype string, destinationid long, keep_images boolean")
    members = spark.createDataFrame([(1, 0, 7, 1, 10), (1, 0, 8, 1, 11), (2, 0, 9, 1, 12), (2, 500, 9, 1, 510), (3, 0, 4, 1, 3)],
                                    "rule_id long, session_start long, image_id long, arrivals long, last_ts long")
    sent = spark.createDataFrame([("scu", 5, i) for i in (7, 9, 4)], "destinationtype string, destinationid long, image_id long")
    state = W.flags(W.transactions(members), W.for_destination(rules, members, sent), 100_000)
    closed = W.finalise(state, rules)
    # the second transaction of rule 2 is not delivered, so its source keeps all images
    assert sorted((r["rule_id"], r["action"]) for r in closed.collect()) == [(1, "delete"), (3, "remove")]
    assert sorted(r[0] for r in W.images_to_delete(closed, members).collect()) == [7, 8]

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tierbook import schema as S
from tierbook.functions.paths import path_of_json
from tierbook.functions.scalar import format_steps, path_steps
from tierbook.operators import deid as D
from tierbook.operators import keys as K
from tierbook.operators import rules as R
from tierbook.operators import tagfilter as T
from tierbook.operators.profile import Profile

BASIC = Profile(("BASIC_PROFILE",))
ELEMENT = ("image_id bigint, tag bigint, tag_path string, path_tags array<bigint>, vr string, length bigint, "
           "values array<string>")


def elements(spark, image, **values):
    """Root elements by keyword, or by path under the key ``paths``."""
    paths = {S.TAG_TEXT[k]: v for k, v in values.items() if k != "paths"} | values.get("paths", {})
    rows = [(image, S.path_numbers(p)[-1], p, S.path_numbers(p), "LO", len(v), [v]) for p, v in paths.items()]
    return spark.createDataFrame(rows, ELEMENT)


def result(frame):
    return {r.tag_path: "\\".join(r["values"]) for r in frame.collect()}


def run(frame, profile=BASIC, **options):
    return result(D.anonymise(frame, profile, D.salted("s"), **options))


def test_operations():
    assert BASIC.op_of(S.TAG["AccessionNumber"]) == "Z"
    assert BASIC.op_of(0x80030010) == "X"  # odd group above the signed range
    assert BASIC.op_of(0x60024000) == "X"
    assert BASIC.op_of(0x50021234) == "X"
    assert BASIC.op_of(S.TAG["Modality"]) is None
    kept = Profile(("BASIC_PROFILE", "RETAIN_SAFE_PRIVATE"))
    assert kept.op_of(0x70534009) == "K"
    assert kept.op_of(0x70534010) == "X"
    with pytest.raises(ValueError):
        Profile(("CLEAN_PIXEL_DATA",))
    with pytest.raises(ValueError):
        Profile(("NO_SUCH_OPTION",))
    assert Profile(("RETAIN_UIDS",)).completed().method == "Basic Profile - Retain UIDs"


def test_column_and_lookup_agree(spark):
    tags = [S.tag_number(t) for _, t, _, _ in S.DICTIONARY] + [0x80030010, 0x60003000, 0x60024000, 0x70534009, 0x70530000]
    profile = Profile(("BASIC_PROFILE", "RETAIN_UIDS", "RETAIN_SAFE_PRIVATE"))
    frame = spark.createDataFrame([(t,) for t in tags], "tag bigint")
    for row in frame.select("tag", profile.op_column().alias("op")).collect():
        assert row.op == profile.op_of(row.tag), hex(row.tag)


def test_anonymisation(spark):
    out = run(elements(spark, 1, AccessionNumber="ACC001", Modality="NM", PatientBirthDate="20040325", PatientName="Ann",
                       StudyInstanceUID="1.2.3", paths={"(8003,0010)": "private", "(6002,4000)": "34",
                                                        "(0008,1140)[1].(0008,1155)": "1.2"}))
    assert out["(0008,0050)"] == "" and out["(0010,0030)"] == ""
    assert out["(0008,0060)"] == "NM"
    assert out["(0020,000D)"].startswith("2.25.1") and out["(0010,0010)"].startswith("2.25.1")
    assert out["(0012,0062)"] == "YES" and out["(0012,0063)"] == "Basic Profile"
    assert {"(8003,0010)", "(6002,4000)", "(0008,1140)[1].(0008,1155)"}.isdisjoint(out)
    # absent identity attributes are inserted
    assert all(out[p].startswith("2.25.1") for p in K.IDENTITY_PATHS)


def test_same_input_same_pseudonym(spark):
    one = run(elements(spark, 1, PatientName="Ann", PatientID="7", StudyInstanceUID="1.2"))
    two = run(elements(spark, 2, PatientName="Ann", PatientID="7", StudyInstanceUID="1.2"))
    assert one["(0010,0010)"] == two["(0010,0010)"] and one["(0020,000D)"] == two["(0020,000D)"]
    assert one["(0020,000E)"] != two["(0020,000E)"]  # absent before, so new for each image


def test_anonymous_images_pass_unless_forced(spark):
    frame = elements(spark, 1, PatientID="12345678", PatientIdentityRemoved="yes", PatientAge="1Y")
    assert result(frame) == run(frame, force=False)
    assert run(frame)["(0010,0020)"] != "12345678"


def test_retained_characteristics(spark):
    out = run(elements(spark, 1, PatientSex="F", SmokingStatus="Y"), Profile(("BASIC_PROFILE", "RETAIN_PATIENT_CHARACTERISTICS")))
    assert out["(0010,0040)"] == "F" and out["(0010,21A0)"] == "Y"


def test_image_with_no_value_attribute_still_gets_markers(spark):
    out = run(elements(spark, 1, Modality="CT"))
    assert out["(0012,0062)"] == "YES" and out["(0008,0060)"] == "CT" and len(out) == 8


def test_custom_values_win_and_insert(spark):
    frame = elements(spark, 1, PatientName="Ann", StudyDescription="knee", ImageComments="x")
    custom = spark.createDataFrame([(1, "(0010,0010)", "Bob"), (1, "(0008,1030)", "new"), (1, "(0020,4000)", "note"),
                                    (1, "(0018,1000)", "dev")], "image_id bigint, tag_path string, value string")
    out = run(frame, custom=custom)
    assert (out["(0010,0010)"], out["(0008,1030)"], out["(0020,4000)"], out["(0018,1000)"]) == ("Bob", "new", "note", "dev")
    pairs = {r.tag_path: (r.value, r.anon_value) for r in D.anonymous_pairs(frame, BASIC, D.salted("s"), custom=custom).collect()}
    assert pairs == {"(0010,0010)": ("Ann", "Bob"), "(0008,1030)": ("knee", "new")}


KEYS = "id bigint, created bigint, image_id bigint, " + ", ".join(
    f"{c} string" for pair in zip(K.REAL, K.ANON, strict=True) for c in pair)


@pytest.fixture(scope="module")
def keys(spark):
    return spark.createDataFrame(
        [(1, 10, 1, "pn", "apn", "pid", "apid", "st", "ast", "se", "ase", "so", "aso"),
         (2, 20, 2, "pn", "apn2", "pid", "apid2", "st", "ast2", "se", "ase2", "so2", "aso2")], KEYS)


@pytest.fixture(scope="module")
def key_values(spark):
    return spark.createDataFrame([(1, "(0020,0010)", "sid", "asid")],
                                 "key_id bigint, tag_path string, value string, anon_value string")


@pytest.mark.parametrize(("values", "level", "key"), [
    (("pn", "pid", "st", "se", "so"), 4, 1), (("pn", "pid", "st", "se", "other"), 3, 2), (("pn", "pid", "st", "x", "so"), 2, 2),
    (("pn", "pid", "x", "se", "so"), 1, 2), (("x", "pid", "st", "se", "so"), 1, None),
])
def test_key_levels(spark, keys, values, level, key):
    ask = spark.createDataFrame([(5, *values)], "image_id bigint, " + ", ".join(f"{c} string" for c in K.REAL))
    row = K.match_keys(ask, keys).first()
    assert (row.match_level, row.key_id) == (level, key)


def test_harmonised_keys_reuse_values_down_to_the_level(spark, keys, key_values):
    ask = spark.createDataFrame([(5, "pn", "pid", "st", "se", "new")], "image_id bigint, " + ", ".join(f"{c} string" for c in K.REAL))
    context = K.with_key_values(K.match_keys(ask, keys), keys, key_values, "anon_value")
    pairs = spark.createDataFrame(
        [(5, "(0010,0010)", "pn", "fresh"), (5, "(0020,000E)", "se", "fresh"), (5, "(0008,0018)", "new", "fresh"),
         (5, "(0020,0010)", "sid", "fresh")], "image_id bigint, tag_path string, value string, anon_value string")
    made = {r.tag_path: (r.anon_value, r.stored) for r in K.harmonise(pairs, context).collect()}
    assert made == {"(0010,0010)": ("apn2", False), "(0020,000E)": ("ase2", False), "(0008,0018)": ("fresh", False),
                    "(0020,0010)": ("fresh", True)}
    row = K.key_rows(K.harmonise(pairs, context)).first()
    assert (row.anonPatientName, row.anonSOPInstanceUID, row.studyInstanceUID) == ("apn2", "fresh", "")


def test_reidentify(spark, keys, key_values):
    frame = elements(spark, 5, PatientName="apn", PatientID="apid", StudyInstanceUID="ast", SeriesInstanceUID="ase",
                     SOPInstanceUID="aso", PatientIdentityRemoved="YES", Modality="NM")
    ask = D.identity_of(frame)
    context = K.with_key_values(K.match_keys(ask, keys, anonymous=True), keys, key_values, "value")
    out = result(D.reidentify(frame, context))
    assert (out["(0010,0010)"], out["(0008,0018)"], out["(0020,0010)"], out["(0008,0060)"]) == ("pn", "so", "sid", "NM")


def test_purge(spark, keys, key_values):
    left, values = K.purge(keys, key_values, spark.createDataFrame([(1,)], "image_id bigint"))
    assert [r.id for r in left.collect()] == [2] and values.count() == 0


def test_paths(spark):
    good = ["(0008,0018)", "(0008,1140)[2].(0008,1155)", "(0040,0275)[*].(0008,1140)[1].(FFFE,E000)"]
    frame = spark.createDataFrame([(p,) for p in [*good, "0008,0018", "(0008,0018", ""]], "p string")
    got = [r[0] for r in frame.select(format_steps(path_steps(F.col("p")))).collect()]
    assert got == [*good, None, None, None]
    docs = ['{"name": "PatientName"}', '{"tag": 528725, "previous": {"name": "ReferencedImageSequence", "item": "*"}}',
            '{"name": "Nonsense"}', '{"item": "1"}', '{"tag": 528725, "previous": {"tag": 528704}}']
    frame = spark.createDataFrame([(d,) for d in docs], "d string")
    assert [r[0] for r in frame.select(path_of_json(F.col("d"))).collect()] == [
        "(0010,0010)", "(0008,1140)[*].(0008,1155)", None, None, "(0008,1155)"]


def test_tag_filter_rules(spark):
    paths = ["(0010,0010)", "(0008,1140)", "(0008,1140)[1].(0008,1155)", "(0008,1140)[2].(0008,1155)", "(0040,0275)[1].(0008,0050)"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")

    def kept(black, white):
        keep = ~T.dropped_by_blacklist(F.col("path"), F.array(*[F.lit(b) for b in black]).cast("array<string>")) & \
            T.kept_by_whitelist(F.col("path"), F.array(*[F.lit(w) for w in white]).cast("array<string>"))
        return [r.path for r in frame.filter(keep).collect()]

    assert kept([], []) == paths
    assert kept(["(0008,1140)[*]"], []) == [paths[0], paths[4]]
    assert kept(["(0008,1140)[2]"], []) == [paths[0], paths[1], paths[2], paths[4]]
    assert kept([], ["(0008,1140)[*].(0008,1155)"]) == paths[1:4]
    assert kept(["(0008,1140)[1]"], ["(0008,1140)[*]"]) == [paths[1], paths[3]]


def test_rules(spark):
    rules = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 4)], "type_id bigint, rule_id bigint")
    attributes = spark.createDataFrame(
        [(1, "(0008,0060)", "", "NM"), (1, "(0018,0015)", "", "HEAD"), (2, "(0008,0060)", "", "CT"), (3, "(0008,0008)", "", "")],
        "rule_id bigint, tag string, sequence string, expected string")
    data = spark.createDataFrame(
        [(1, "(0008,0060)", ["NM"]), (1, "(0018,0015)", ["HEAD"]), (2, "(0008,0060)", ["NM"]), (3, "(0008,0060)", ["CT"]),
         (3, "(0008,0008)", ["A", "B"])], "series_id bigint, tag_path string, values array<string>")
    series = spark.createDataFrame([(1,), (2,), (3,)], "series_id bigint")
    got = {(r.series_id, r.type_id) for r in R.classify(series, R.rule_values(data, attributes), rules, attributes).collect()}
    assert got == {(1, 1), (3, 1), (1, 2), (2, 2), (1, 3), (2, 3), (3, 3)}


def test_unlisted_attributes_are_reported_refused_or_removed(spark):
    from dataclasses import replace

    import pytest

    from tierbook.operators import deid as D
    from tierbook.operators.profile import Profile

    rows = [(1, "(0008,0060)", 0x00080060, [0x00080060]), (1, "(0010,0010)", 0x00100010, [0x00100010]), (1, "(4444,0002)", 0x44440002, [0x44440002]),
            (2, "(4444,0004)[1].(0008,0060)", 0x00080060, [0x44440004, 0x00080060]), (3, "(0008,0060)", 0x00080060, [0x00080060]), (3, "(0009,0001)", 0x00090001, [0x00090001])]
    elements = spark.createDataFrame(rows, "image_id long, tag_path string, tag long, path_tags array<long>")
    basic = Profile(("BASIC_PROFILE",))
    strict = replace(basic, unlisted="remove")
    assert {tuple(r) for r in D.unlisted_attributes(elements, basic).collect()} == {("(4444,0002)", 1), ("(4444,0004)[1].(0008,0060)", 1)}
    assert {r[0] for r in D.refused_images(elements, basic).collect()} == {1, 2}
    kept = lambda profile: {r["tag_path"] for r in D.remove_elements(elements, profile).collect()}
    assert kept(basic) - kept(strict) == {"(4444,0002)", "(4444,0004)[1].(0008,0060)"}
    assert "(0008,0060)" in kept(strict) and "(0008,0060)" not in kept(replace(strict, safe=frozenset()))
    assert replace(strict, options=("RETAIN_UIDS",)).completed().unlisted == "remove"
    with pytest.raises(ValueError, match="unlisted"):
        Profile(("BASIC_PROFILE",), unlisted="guess")

"""Registered queries: attribute rows, scalar functions, exports, rules, tag filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierbook import schema as S
from tierbook.functions import scalar as X
from tierbook.functions.paths import path_of_json
from tierbook.operators import query as Q
from tierbook.operators import rules as R
from tierbook.operators import tagfilter as T
from tierbook.plans import fixture_values as V
from tierbook.plans.fixtures import Fixtures
from tierbook.plans.fixtures_sql import values
from tierbook.plans.registry import query
from tierbook.sources import attributes as A
from tierbook.sources import dims, exports

_DIM = "dim AS (" + values(
    [(S.tag_number(t), t, k, vr, vm) for k, t, vr, vm in S.DICTIONARY], "tag, tag_text, keyword, vr, vm") + ")"


@query(
    "attribute_rows",
    f"WITH {_DIM} SELECT e.image_id AS image_id, e.tag_path AS tag_path, CASE WHEN e.top_tag <> e.tag THEN coalesce(p.keyword, "
    "'') || '/' ELSE '' END || coalesce(d.keyword, '') AS name_path, e.vr AS vr, CASE WHEN e.tag = 2145386512 THEN -1 ELSE "
    "e.length END AS length, CASE WHEN e.vr = 'SQ' THEN '' WHEN e.tag = 2145386512 THEN '< Fragments >' WHEN e.vr IN ('OW', "
    "'OF', 'OB', 'OD') AND e.length > 20 THEN '< Binary data >' ELSE e.val END AS value, CASE WHEN e.vr = 'SQ' THEN 0 ELSE "
    "len(string_split(e.val, '\\')) END AS multiplicity FROM fx_elements e LEFT JOIN dim d ON d.tag = e.tag LEFT JOIN dim p "
    "ON p.tag = e.top_tag",
)
def attribute_rows(fx: Fixtures):
    rows = A.attribute_rows(fx.flat_records(), F.col("tag") == S.TAG["PixelData"])
    return rows.select("image_id", "tag_path", F.array_join("name_path", "/").alias("name_path"), "vr", "length",
                       X.join_values(F.col("values")).alias("value"),
                       F.size("values").cast("bigint").alias("multiplicity"))


@query(
    "image_information",
    "SELECT image_id, CASE WHEN modality = 'F' THEN instanceNumber::BIGINT ELSE 1 END AS frames, greatest(instanceNumber::BIGINT, "
    "CASE WHEN bodyPartExamined = 'B1' THEN 4 ELSE 1 END) AS frame_index, CASE WHEN modality <> 'P' THEN 3::BIGINT ELSE 0 END AS "
    "min_pixel, CASE WHEN modality <> 'P' THEN 4095::BIGINT ELSE 0 END AS max_pixel FROM fx_flat_images",
)
def image_information(fx: Fixtures):
    return A.image_information(fx.elements())


_PROPS = [p for lv in S.LEVELS.values() for p in lv.props]


@query("extract_levels", "SELECT image_id, " + ", ".join(
    "coalesce(max(" + ("val" if p == "imageType" else "split_part(val, '\\', 1)") +
    f") FILTER (WHERE tag_path = '{S.TAG_TEXT[S.PROPERTY_KEYWORD[p]]}'), '') AS {p}" for p in _PROPS)
    + " FROM fx_elements GROUP BY image_id")
def extract_levels(fx: Fixtures):
    return A.extract_levels(fx.flat_records())


@query(
    "context_validation",
    "WITH ok AS (" + values([(c, s) for c in S.ACCEPTED_IMAGE_CLASSES for s in S.ACCEPTED_SYNTAXES], "sop_class, transfer_syntax")
    + "), per_image AS (SELECT image_id, max(val) FILTER (WHERE tag_path = '(0008,0016)') AS sop_class, max(val) FILTER (WHERE "
    "tag_path = '(0002,0010)') AS transfer_syntax FROM fx_elements GROUP BY image_id) SELECT image_id, sop_class, "
    "transfer_syntax, (sop_class, transfer_syntax) IN (SELECT (sop_class, transfer_syntax) FROM ok) AS accepted FROM per_image",
)
def context_validation(fx: Fixtures):
    return A.validate_contexts(A.context_rows(fx.elements()), dims.context_dim(fx.spark))


@query(
    "dictionary_enrich",
    f"WITH {_DIM} SELECT d.tag_text AS tag_text, d.keyword AS keyword, d.vr AS vr, d.vm AS vm, d.vr = 'SQ' AS is_sequence, "
    "count(*) AS rows_found FROM fx_elements e JOIN dim d ON d.tag = e.tag WHERE lower(d.keyword) LIKE '%se%' GROUP BY ALL",
)
def dictionary_enrich(fx: Fixtures):
    """Element rows per dictionary entry whose keyword contains a text; sequences are marked."""
    counts = fx.elements().groupBy("tag").agg(F.count(F.lit(1)).alias("rows_found"))
    found = dims.tag_dim(fx.spark).filter(F.lower("keyword").contains("se"))
    return counts.join(found, "tag").select(
        "tag_text", "keyword", "vr", "vm", (F.col("vr") == "SQ").alias("is_sequence"), "rows_found")


@query(
    "value_tags",
    "WITH v AS (" + values([(k, lv, S.TAG_TEXT[k]) for k, lv in S.MANDATORY_VALUES + S.OPTIONAL_VALUES],
                           "keyword, level, tag_text") + ") SELECT v.keyword AS keyword, v.level AS level, count(e.image_id) AS "
    "rows_found FROM v LEFT JOIN fx_elements e ON e.tag_path = v.tag_text GROUP BY ALL",
)
def value_tags(fx: Fixtures):
    """Mandatory and optional value attributes with level, and how often the catalogue holds them."""
    tags = dims.value_tag_dim(fx.spark).join(dims.tag_dim(fx.spark).select("keyword", "tag_text"), "keyword")
    counts = fx.elements().groupBy(F.col("tag_path").alias("tag_text")).agg(F.count(F.lit(1)).alias("n"))
    return tags.join(counts, "tag_text", "left").select(
        "keyword", "level", F.coalesce("n", F.lit(0).cast("bigint")).alias("rows_found"))


# -- scalar functions ------------------------------------------------------------------------------------------


@query(
    "scalar_strings",
    "SELECT c_custkey AS id, substr(repeat(c_name, 15), 1, 180) AS short_name, 'Anonymous ' || CASE WHEN c_mktsegment = "
    "'BUILDING' THEN '<unknown sex>' ELSE c_mktsegment END || ' ' || CASE WHEN c_acctbal < 0 THEN '<unknown age>' ELSE "
    "c_nationkey::VARCHAR END AS shown, md5(c_name || '|' || c_mktsegment) AS client_hash FROM customer",
)
def scalar_strings(fx: Fixtures):
    sex = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment"))
    age = F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey").cast("string"))
    return fx.table("customer").select(
        F.col("c_custkey").alias("id"),
        X.truncate_name(F.repeat("c_name", 15)).alias("short_name"),
        X.anonymous_name(sex, age).alias("shown"),
        F.md5(F.concat_ws("|", "c_name", "c_mktsegment")).alias("client_hash"),
    )


@query(
    "scalar_arrays",
    "SELECT p_partkey AS id, array_to_string(string_split(p_name, ' '), '\\') AS joined, CASE WHEN p_size > 25 THEN '' ELSE "
    "array_to_string(string_split(p_name, ' '), ',') END AS compared, len(string_split(p_brand || ',' || p_type, "
    "','))::BIGINT AS option_count, p_brand || ',' || p_type AS options FROM part",
)
def scalar_arrays(fx: Fixtures):
    words = F.split("p_name", " ")
    options = F.split(F.concat_ws(",", "p_brand", "p_type"), ",")
    return fx.table("part").select(
        F.col("p_partkey").alias("id"),
        X.join_values(words).alias("joined"),
        X.comma_values(F.when(F.col("p_size") <= 25, words)).alias("compared"),
        F.size(options).cast("bigint").alias("option_count"),
        F.array_join(options, ",").alias("options"),
    )


@query(
    "tag_mask",
    "SELECT tag, (tag & 4278255615) = 1610625024 AS overlay_data, (tag & 65536) = 65536 AS private, (tag >> 16) BETWEEN 24576 "
    "AND 24831 AS overlay_group, count(*) AS rows_found FROM fx_elements GROUP BY tag",
)
def tag_mask(fx: Fixtures):
    tag = F.col("tag")
    return fx.elements().groupBy("tag").agg(F.count(F.lit(1)).alias("rows_found")).select(
        "tag",
        X.mask_hit(tag, 0xFF00FFFF, 0x60003000).alias("overlay_data"),
        X.mask_hit(tag, 0x10000, 0x10000).alias("private"),
        X.is_overlay(tag).alias("overlay_group"),
        "rows_found",
    )


@query(
    "scalar_pseudonyms",
    "SELECT id, '2.25.1' || substr(translate(sha256('pepper|' || seriesInstanceUID), 'abcdef', '012345'), 1, 36) AS uid, "
    "substr(translate(sha256('pepper|accession|' || seriesInstanceUID), 'abcdef', '012345'), 1, 16) AS accession FROM fx_series",
)
def scalar_pseudonyms(fx: Fixtures):
    uid = F.col("seriesInstanceUID")
    return fx.series().select("id", X.pseudo_uid(uid, V.SALT).alias("uid"),
                              X.pseudo_accession(uid, V.SALT).alias("accession"))


@query(
    "tag_path_parse",
    "WITH paths AS (SELECT tag_path AS path, count(*) AS rows_found FROM fx_elements GROUP BY 1) SELECT path, path AS formatted, "
    "path AS from_json, CASE WHEN path LIKE '%.%' THEN 2::BIGINT ELSE 1 END AS depth, ('0x' || replace(substr(path, -10, 9), "
    "',', ''))::BIGINT AS leaf, regexp_extract(path, '\\[(.)\\]', 1) AS item, rows_found FROM paths UNION ALL SELECT url, NULL, "
    "NULL, NULL, NULL, NULL, count(*) FROM pages GROUP BY url",
)
def tag_path_parse(fx: Fixtures):
    """Paths of all elements, read from text and from JSON; page URLs stand for malformed input."""
    paths = fx.elements().groupBy(F.col("tag_path").alias("path"), "path_tags").agg(F.count(F.lit(1)).alias("rows_found"))
    steps = X.path_steps(F.col("path"))
    # the innermost step is named by number, the outer one by keyword
    outer = F.when(
        F.size("path_tags") > 1,
        F.struct(F.lit(None).cast("bigint").alias("tag"),
                 F.try_element_at(_keyword_map(), F.get("path_tags", F.lit(0))).alias("name"),
                 F.regexp_extract("path", r"\[(.)\]", 1).alias("item")),
    )
    document = F.to_json(F.struct(F.element_at("path_tags", -1).alias("tag"), outer.alias("previous")))
    good = paths.select("path", document.alias("document"), "rows_found")
    bad = fx.table("pages").groupBy(F.col("url").alias("path")).agg(F.count(F.lit(1)).alias("rows_found")).select(
        "path", F.lit('{"item": "1"}').alias("document"), "rows_found")
    return good.unionByName(bad).select(
        "path", X.format_steps(steps).alias("formatted"), path_of_json(F.col("document")).alias("from_json"),
        F.size(steps).cast("bigint").alias("depth"), F.element_at(steps, -1)["tag"].alias("leaf"),
        F.when(steps.isNotNull(), F.coalesce(F.get(steps, F.lit(0))["item"], F.lit(""))).alias("item"), "rows_found",
    )


def _keyword_map():
    return F.create_map(*[x for k, t, _, _ in S.DICTIONARY for x in (F.lit(S.tag_number(t)).cast("bigint"), F.lit(k))])


@query(
    "url_parts",
    "SELECT page_id, list_extract(string_split(regexp_replace(trim(url), '/$', ''), '/'), -1) AS token, "
    "coalesce(nullif(regexp_extract(url, '^([A-Za-z]*)://', 1), ''), 'http') AS protocol, regexp_extract(url, "
    "'^(?:[A-Za-z]*://)?([^:|/]+)', 1) AS host, CASE WHEN regexp_extract(url, '^(?:[A-Za-z]*://)?[^:|/]+:([0-9]+)', 1) <> '' THEN "
    "regexp_extract(url, '^(?:[A-Za-z]*://)?[^:|/]+:([0-9]+)', 1)::INT WHEN url LIKE 'https://%' THEN 443 ELSE 80 END AS port FROM pages",
)
def url_parts(fx: Fixtures):
    url = F.col("url")
    return fx.table("pages").select("page_id", X.url_token(url).alias("token"), X.url_protocol(url).alias("protocol"),
                                    X.url_host(url).alias("host"), X.url_port(url).alias("port"))


# -- exports ---------------------------------------------------------------------------------------------------


@query("export_anon_csv", "SELECT " + ", ".join(
    (f"coalesce(v.{c}, '{'(0000,0000)' if c == 'tag_path' else ''}')" if c in ("tag_path", "value", "anon_value") else f"k.{c}")
    + f' AS "{h}"' for c, h in exports.KEY_EXPORT)
    + " FROM fx_anon_keys k LEFT JOIN fx_anon_key_values v ON v.key_id = k.id")
def export_anon_csv(fx: Fixtures):
    return exports.key_export(fx.anon_key_table(), fx.anon_key_values())


@query(
    "export_manifest",
    "SELECT image_id, patient_id || '_' || patientName || '-' || patientID AS patient_folder, study_id || '_' || studyDate AS "
    "study_folder, series_id || '_' || seriesDate || '_' || modality AS series_folder, patient_id || '_' || patientName || '-' || "
    "patientID || '/' || study_id || '_' || studyDate || '/' || series_id || '_' || seriesDate || '_' || modality || '/' || "
    "image_id || '.dcm' AS entry FROM fx_flat_images",
)
def export_manifest(fx: Fixtures):
    return exports.manifest(fx.images(), Q.flat_series(fx.catalogue()))


# -- rules -----------------------------------------------------------------------------------------------------


def _involved_elements(fx: Fixtures, reps, nested: bool):
    """Element rows of the representative images only, with their series."""
    rows = V.NESTED_RULE_ATTRIBUTES if nested else V.RULE_ATTRIBUTES
    asked = {a[1] for a in rows}
    paths = [p for p, _, _ in V.ELEMENTS if p in asked or (nested and "[1]." in p)]
    images = fx.images().join(reps.select(F.col("image_id").alias("id")), "id", "left_semi")
    return fx.elements(images, paths, keep=("series_id",))


def _classified(fx: Fixtures, nested: bool):
    reps = R.representatives(fx.images())
    attributes = fx.rule_attributes(nested)
    found = R.rule_values(_involved_elements(fx, reps, nested), attributes, sequences=nested)
    return R.classify(reps, found, fx.rules(nested), attributes)


@query(
    "series_type_classify",
    "WITH reps AS (SELECT series_ref AS series_id, min(id) AS image_id FROM fx_images GROUP BY 1), el AS (SELECT r.series_id, "
    "e.tag_path, replace(e.val, '\\', ',') AS val FROM reps r JOIN fx_elements e ON e.image_id = r.image_id), judged AS (SELECT "
    "r.series_id, k.type_id, k.rule_id, bool_and(a.rule_id IS NULL OR coalesce(el.val, '') = a.expected) AS ok FROM reps r CROSS "
    "JOIN fx_rules k LEFT JOIN fx_rule_attributes a ON a.rule_id = k.rule_id LEFT JOIN el ON el.series_id = r.series_id AND "
    "el.tag_path = a.tag GROUP BY ALL) SELECT DISTINCT series_id, type_id FROM judged WHERE ok",
)
def series_type_classify(fx: Fixtures):
    """Full reclassification: the result replaces all links."""
    return _classified(fx, nested=False)


@query(
    "series_type_nested",
    "WITH reps AS (SELECT series_ref AS series_id, min(id) AS image_id FROM fx_images GROUP BY 1), el AS (SELECT r.series_id, "
    "e.tag_path, replace(e.val, '\\', ',') AS val FROM reps r JOIN fx_elements e ON e.image_id = r.image_id), judged AS (SELECT "
    "r.series_id, k.type_id, k.rule_id, bool_and(a.rule_id IS NULL OR coalesce(CASE WHEN EXISTS (SELECT 1 FROM el x WHERE "
    "x.series_id = r.series_id AND starts_with(x.tag_path, a.sequence || '[1].')) THEN inner_el.val ELSE root_el.val END, '') = "
    "a.expected) AS ok FROM reps r CROSS JOIN fx_nested_rules k LEFT JOIN fx_nested_rule_attributes a ON a.rule_id = k.rule_id "
    "LEFT JOIN el root_el ON root_el.series_id = r.series_id AND root_el.tag_path = a.tag LEFT JOIN el inner_el ON "
    "inner_el.series_id = r.series_id AND inner_el.tag_path = a.sequence || '[1].' || a.tag GROUP BY ALL) SELECT DISTINCT "
    "series_id, type_id FROM judged WHERE ok",
)
def series_type_nested(fx: Fixtures):
    return _classified(fx, nested=True)


@query(
    "series_type_info",
    "WITH a AS (SELECT DISTINCT p_type, p_size, p_brand FROM part), r AS (SELECT p_type, p_size, string_agg(p_brand, ',' ORDER BY "
    "p_brand) AS brands, count(*) AS n FROM a GROUP BY ALL) SELECT p_type AS type_name, count(*) AS rule_count, sum(n)::BIGINT AS "
    "attribute_count, string_agg(p_size || ':' || brands, ';' ORDER BY p_size) AS rules, max((SELECT max(p_brand) FROM a x WHERE "
    "x.p_type = r.p_type)) AS max_tag FROM r GROUP BY p_type",
)
def series_type_info(fx: Fixtures):
    """Types with their rules and attributes; part type, size and brand play type, rule and attribute."""
    parts = fx.table("part").select("p_type", "p_size", "p_brand").distinct()
    rules = parts.select(F.col("p_type").alias("type_id"), F.concat_ws("#", "p_type", F.format_string("%05d", "p_size")).alias(
        "rule_id")).distinct()
    attributes = parts.select(F.concat_ws("#", "p_type", F.format_string("%05d", "p_size")).alias("rule_id"),
                              F.col("p_brand").alias("tag"), F.lit("").alias("expected"))

    def shown(rule):
        size = F.split_part(rule["rule_id"], F.lit("#"), F.lit(2)).cast("int").cast("string")
        return F.concat(size, F.lit(":"), F.array_join(F.transform(rule["attributes"], lambda a: a["tag"]), ","))

    count = F.aggregate("rules", F.lit(0), lambda acc, r: acc + F.size(r["attributes"]))
    return R.type_info(rules, attributes).select(
        F.col("type_id").alias("type_name"), F.size("rules").cast("bigint").alias("rule_count"),
        count.cast("bigint").alias("attribute_count"), F.array_join(F.transform("rules", shown), ";").alias("rules"), "max_tag")


# -- tag filters -----------------------------------------------------------------------------------------------

_TRUNK = ("len(list_filter(range(1, len(string_split({short}, '.')) + 1), lambda i: NOT ({hit}))) = 0 AND "
          "len(string_split({short}, '.')) <= len(string_split({long}, '.'))")
_P, _E = "string_split(q.path, '.')[i]", "string_split(e.tag_path, '.')[i]"
_HIT = f"({_P} = {_E} OR (substr({_P}, 1, 11) = substr({_E}, 1, 11) AND (length({_P}) = 11 OR {_P} LIKE '%[*]')))"
_COVERS = _TRUNK.format(short="q.path", long="e.tag_path", hit=_HIT)
_LEADS = _TRUNK.format(short="e.tag_path", long="q.path",
                       hit=f"({_HIT} OR (length({_E}) = 11 AND substr({_P}, 1, 11) = {_E}))")
_SPECS = ("SELECT s.sourcetype, s.sourceid, f.kind, p.path FROM fx_source_tag_filters s JOIN fx_tag_filters f ON f.id = "
          "s.filter_id JOIN fx_tag_filter_paths p ON p.filter_id = f.id")


def _filter_sql(black: bool, white: bool) -> str:
    conditions = []
    if black:
        conditions.append(f"NOT EXISTS (SELECT 1 FROM specs q JOIN kinds e ON {_COVERS} WHERE q.kind = 'BLACKLIST' AND "
                          "q.sourcetype = x.sourcetype AND q.sourceid = x.sourceid AND e.tag_path = x.tag_path)")
    if white:
        conditions.append("(NOT EXISTS (SELECT 1 FROM specs q WHERE q.kind = 'WHITELIST' AND q.sourcetype = x.sourcetype AND "
                          f"q.sourceid = x.sourceid) OR EXISTS (SELECT 1 FROM specs q JOIN kinds e ON ({_COVERS}) OR ({_LEADS}) "
                          "WHERE q.kind = 'WHITELIST' AND q.sourcetype = x.sourcetype AND q.sourceid = x.sourceid AND "
                          "e.tag_path = x.tag_path))")
    return (f"WITH specs AS ({_SPECS}), kinds AS (SELECT DISTINCT tag_path FROM fx_elements), x AS (SELECT e.image_id, e.tag_path, "
            "s.sourcetype, s.sourceid FROM fx_elements e JOIN fx_series_sources s ON s.id = e.series_id), verdict AS (SELECT * FROM "
            f"(SELECT DISTINCT sourcetype, sourceid, tag_path FROM x) x WHERE {' AND '.join(conditions)}) "
            "SELECT image_id, tag_path, sourcetype, sourceid FROM x JOIN verdict USING (sourcetype, sourceid, tag_path)")


def _filtered(fx: Fixtures, blacklist: bool, whitelist: bool):
    source = fx.series_sources().select(F.col("id").alias("series_id"), "sourcetype", "sourceid")
    elements = fx.flat_records(source)
    spec = T.specs(fx.tag_filters(), fx.tag_filter_paths(), fx.source_tag_filters())
    return T.apply_filters(elements, spec, blacklist, whitelist).select("image_id", "tag_path", "sourcetype", "sourceid")


@query("tag_blacklist", _filter_sql(True, False))
def tag_blacklist(fx: Fixtures):
    return _filtered(fx, True, False)


@query("tag_whitelist", _filter_sql(False, True))
def tag_whitelist(fx: Fixtures):
    return _filtered(fx, False, True)


@query("tag_filter_combined", _filter_sql(True, True))
def tag_filter_combined(fx: Fixtures):
    return _filtered(fx, True, True)


@query(
    "filter_specs_for_source",
    "WITH n AS (SELECT sourcetype, sourceid, count(*) AS series_count FROM fx_series_sources GROUP BY ALL) SELECT s.sourcetype "
    "AS sourcetype, s.sourceid AS sourceid, f.name AS name, f.kind AS kind, coalesce((SELECT string_agg(p.path, ' ' ORDER BY "
    "p.path) FROM fx_tag_filter_paths p WHERE p.filter_id = f.id), '') AS paths, n.series_count AS series_count FROM "
    "fx_source_tag_filters s JOIN fx_tag_filters f ON f.id = s.filter_id JOIN n ON n.sourcetype = s.sourcetype AND n.sourceid = "
    "s.sourceid",
)
def filter_specs_for_source(fx: Fixtures):
    """Filters of every source that delivered a series, with the number of series they apply to."""
    used = fx.series_sources().groupBy("sourcetype", "sourceid").agg(F.count(F.lit(1)).alias("series_count"))
    spec = T.specs(fx.tag_filters(), fx.tag_filter_paths(), fx.source_tag_filters())
    return spec.join(used, T.SOURCE).select(*T.SOURCE, "name", "kind", F.array_join("paths", " ").alias("paths"), "series_count")

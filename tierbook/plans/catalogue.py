"""Registered queries: scans, predicates, level queries, joins, paging, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierbook import schema as S
from tierbook.operators import query as Q
from tierbook.operators.grams import GramIndex
from tierbook.plans import fixture_values as V
from tierbook.plans.fixtures import Fixtures
from tierbook.plans.registry import query
from tierbook.session import materialise, work_dir

P = "id, patientName, patientID, patientBirthDate, patientSex"
ST = "id, patient_ref, studyInstanceUID, studyDescription, studyDate, studyID, accessionNumber, patientAge"
SE = ("id, study_ref, seriesInstanceUID, seriesDescription, seriesDate, modality, protocolName, bodyPartExamined, "
      "manufacturer, stationName, frameOfReferenceUID")
IM = "id, series_ref, sopInstanceUID, imageType, instanceNumber"
FLAT = ("id, patient_id, study_id, patientName, patientID, patientBirthDate, patientSex, studyInstanceUID, "
        "studyDescription, studyDate, studyID, accessionNumber, patientAge, seriesInstanceUID, seriesDescription, "
        "seriesDate, modality, protocolName, bodyPartExamined, manufacturer, stationName, frameOfReferenceUID")


def cols(frame, prefix: str, names: list[str]):
    return [frame[n].alias(f"{prefix}_{n}") for n in names]


# -- scans -----------------------------------------------------------------------------------------------------


@query(
    "scan_levels",
    "SELECT 'patient' AS level, id, NULL::BIGINT AS parent, patientName AS label FROM fx_patients UNION ALL "
    "SELECT 'study', id, patient_ref, studyInstanceUID FROM fx_studies UNION ALL "
    "SELECT 'series', id, study_ref, seriesInstanceUID FROM fx_series UNION ALL "
    "SELECT 'image', id, series_ref, sopInstanceUID FROM fx_images",
)
def scan_levels(fx: Fixtures):
    cat = fx.catalogue()
    parts = []
    for name, label in (("patient", "patientName"), ("study", "studyInstanceUID"), ("series", "seriesInstanceUID"),
                        ("image", "sopInstanceUID")):
        ref = S.LEVELS[name].ref
        parent = F.col(ref) if ref else F.lit(None).cast("bigint")
        parts.append(cat.level(name).select(F.lit(name).alias("level"), "id", parent.alias("parent"),
                                            F.col(label).alias("label")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "scan_bridges",
    "SELECT 'source' AS bridge, id AS left_id, sourceid AS right_id, sourcename AS label FROM fx_series_sources "
    "UNION ALL SELECT 'tag', series_id, tag_id, '' FROM fx_series_tag_links "
    "UNION ALL SELECT 'type', series_id, type_id, '' FROM fx_series_type_links "
    "UNION ALL SELECT 'key', id, image_id, anonSOPInstanceUID FROM fx_anon_keys "
    "UNION ALL SELECT 'key value', key_id, 0, tag_path FROM fx_anon_key_values "
    "UNION ALL SELECT 'outgoing image', transaction_id, image_id, role FROM fx_outgoing_images "
    "UNION ALL SELECT 'incoming image', transaction_id, image_id, '' FROM fx_incoming_events WHERE image_id IS NOT NULL",
)
def scan_bridges(fx: Fixtures):
    def part(name, frame, left, right, label):
        return frame.select(F.lit(name).alias("bridge"), F.col(left).alias("left_id"),
                            F.lit(0).cast("bigint").alias("right_id") if right is None else F.col(right).alias("right_id"),
                            (F.lit("") if label is None else F.col(label)).alias("label"))

    frames = [
        part("source", fx.series_sources(), "id", "sourceid", "sourcename"),
        part("tag", fx.series_tag_links(), "series_id", "tag_id", None),
        part("type", fx.series_type_links(), "series_id", "type_id", None),
        part("key", fx.anon_keys(), "id", "image_id", "anonSOPInstanceUID"),
        part("key value", fx.anon_key_values(), "key_id", None, "tag_path"),
        part("outgoing image", fx.outgoing_images(), "transaction_id", "image_id", "role"),
        part("incoming image", fx.incoming_events().filter("image_id IS NOT NULL"), "transaction_id", "image_id", None),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


# -- lookups ---------------------------------------------------------------------------------------------------


@query(
    "lookup_by_id",
    "SELECT 'study' AS level, id, studyInstanceUID AS label FROM fx_studies WHERE id IN (SELECT user_id FROM events) "
    "UNION ALL SELECT 'series', id, seriesInstanceUID FROM fx_series WHERE id IN (SELECT event_id FROM events) "
    "UNION ALL SELECT 'tag', id, name FROM fx_series_tags WHERE name = 'N'",
)
def lookup_by_id(fx: Fixtures):
    """Bulk lookup of ids that arrive with the event table, plus a lookup by unique name."""
    cat, events = fx.catalogue(), fx.table("events")
    studies = Q.by_ids(cat.study, events.select("user_id"))
    series = Q.by_ids(cat.series, events.select("event_id"))
    tags = cat.series_tags.filter(F.col("name") == "N")
    return (
        studies.select(F.lit("study").alias("level"), "id", F.col("studyInstanceUID").alias("label"))
        .unionByName(series.select(F.lit("series").alias("level"), "id", F.col("seriesInstanceUID").alias("label")))
        .unionByName(tags.select(F.lit("tag").alias("level"), "id", F.col("name").alias("label")))
    )


@query(
    "lookup_natural_key",
    "SELECT a.id AS arrival_id, i.id AS image_id, s.id AS series_id, st.id AS study_id, p.id AS patient_id FROM "
    "(SELECT id, series_ref, sopInstanceUID FROM fx_arrivals) a "
    "JOIN fx_series s ON s.seriesInstanceUID = 'SE.' || a.series_ref "
    "JOIN fx_studies st ON st.id = s.study_ref JOIN fx_patients p ON p.id = st.patient_ref "
    "AND substr(p.patientName, 1, 180) = 'NATION_' || st.patient_ref "
    "JOIN fx_images i ON i.sopInstanceUID = a.sopInstanceUID AND i.series_ref = s.id",
)
def lookup_natural_key(fx: Fixtures):
    """Resolve every arrival level by level: name and id, then each UID inside its parent."""
    from tierbook.functions.scalar import truncate_name
    from tierbook.operators.maintain import resolve_ids

    cat = fx.catalogue()
    known = fx.flat_images(
        fx.arrivals().select("id", "series_ref", "sopInstanceUID", "imageType", "instanceNumber")
    ).withColumn("patientName", truncate_name(F.col("patientName")))
    wanted = known.select(F.col("image_id").alias("arrival_id"), "patientName", "patientID", "studyInstanceUID",
                          "seriesInstanceUID", "sopInstanceUID")
    return resolve_ids(wanted, cat).select("arrival_id", "image_id", "series_id", "study_id", "patient_id")


# -- predicates ------------------------------------------------------------------------------------------------


@query("query_patients_eq", f"SELECT {P} FROM fx_patients WHERE patientSex = 'M'")
def query_patients_eq(fx: Fixtures):
    return Q.run_query(fx.catalogue(), "patient", Q.Query(predicates=(Q.Predicate("patientSex", "=", "M"),)))


@query("query_patients_like", f"SELECT {P} FROM fx_patients p WHERE patientName LIKE '%ION_1%' AND EXISTS "
       "(SELECT 1 FROM fx_studies s WHERE s.patient_ref = p.id AND s.studyDescription LIKE '%B_ILD%')")
def query_patients_like(fx: Fixtures):
    like = (Q.Predicate("patientName", "like", "ION_1"), Q.Predicate("studyDescription", "like", "B_ILD"))
    return Q.run_query(fx.catalogue(), "patient", Q.Query(predicates=like))


@query("query_series_and", f"SELECT {SE} FROM fx_series WHERE modality = 'F' AND protocolName = 'P3' "
       "AND manufacturer LIKE '%2%'")
def query_series_and(fx: Fixtures):
    both = (Q.Predicate("modality", "=", "F"), Q.Predicate("protocolName", "=", "P3"),
            Q.Predicate("manufacturer", "like", "2"))
    return Q.run_query(fx.catalogue(), "series", Q.Query(predicates=both))


@query("filter_patients_text", f"SELECT {P} FROM fx_patients WHERE lower(patientName) LIKE '%n_1%' OR "
       "lower(patientID) LIKE '%n_1%' OR lower(patientBirthDate) LIKE '%n_1%' OR lower(patientSex) LIKE '%n_1%'")
def filter_patients_text(fx: Fixtures):
    return Q.list_patients(fx.catalogue(), text="N_1")


_FLAT_TEXT = " OR ".join(f"lower({c}::VARCHAR) LIKE '%{{0}}%'" for c in Q.FLAT_TEXT_COLUMNS)


@query("filter_flat_series_text", f"SELECT {FLAT} FROM fx_flat_series WHERE {_FLAT_TEXT.format('nation_1')}")
def filter_flat_series_text(fx: Fixtures):
    return Q.list_flat_series(fx.catalogue(), text="Nation_1")


@query("search_flat_series", f"SELECT {FLAT} FROM fx_flat_series WHERE {_FLAT_TEXT.format('nation_1')}")
def search_flat_series(fx: Fixtures):
    """The same filter through a gram index of the flat series."""
    flat = materialise(Q.list_flat_series(fx.catalogue()), "flat_series")
    index = GramIndex(fx.spark, work_dir(fx.spark, "grams"), Q.FLAT_TEXT_COLUMNS, buckets=16).build(flat)
    return index.search(flat, "Nation_1")


@query("images_for_series", f"SELECT {IM} FROM fx_images WHERE series_ref = 7 AND (lower(sopInstanceUID) LIKE '%f%' "
       "OR lower(imageType) LIKE '%f%' OR lower(instanceNumber) LIKE '%f%') ORDER BY instanceNumber DESC, id LIMIT 20")
def images_for_series(fx: Fixtures):
    return Q.images_for_series(fx.catalogue(), 7, "F", "instanceNumber", False, 0, 20)


@query("filter_anon_keys_prefix", "SELECT id, created, image_id, patientName, anonPatientName, patientID, anonPatientID, "
       "studyInstanceUID, anonStudyInstanceUID, seriesInstanceUID, anonSeriesInstanceUID, sopInstanceUID, "
       "anonSOPInstanceUID FROM fx_anon_keys WHERE lower(patientName) LIKE 'as2.1%' OR lower(anonPatientName) LIKE "
       "'as2.1%' OR lower(patientID) LIKE 'as2.1%' OR lower(anonPatientID) LIKE 'as2.1%' OR lower(studyInstanceUID) "
       "LIKE 'as2.1%' OR lower(anonStudyInstanceUID) LIKE 'as2.1%' OR lower(seriesInstanceUID) LIKE 'as2.1%' OR "
       "lower(anonSeriesInstanceUID) LIKE 'as2.1%' OR lower(sopInstanceUID) LIKE 'as2.1%' OR "
       "lower(anonSOPInstanceUID) LIKE 'as2.1%'")
def filter_anon_keys_prefix(fx: Fixtures):
    from tierbook.operators.keys import list_keys

    return list_keys(fx.anon_key_table(), "AS2.1")


@query("list_series_tags", "SELECT t.id AS id, t.name AS name, count(*) AS series_count FROM fx_series_tags t "
       "JOIN fx_series_tag_links l ON l.tag_id = t.id WHERE t.name LIKE '%R%' GROUP BY ALL")
def list_series_tags(fx: Fixtures):
    cat = fx.catalogue()
    named = cat.series_tags.filter(F.col("name").like("%R%"))
    used = cat.series_tag_links.groupBy(F.col("tag_id").alias("id")).agg(F.count(F.lit(1)).alias("series_count"))
    return named.join(used, "id").select("id", "name", "series_count")


@query("log_by_subject_type", "SELECT * FROM fx_log WHERE subject = 'user_7' UNION ALL SELECT * FROM fx_log WHERE "
       "entry_type = 'ERROR' UNION ALL SELECT * FROM fx_log WHERE subject = 'user_8' AND entry_type = 'WARN'")
def log_by_subject_type(fx: Fixtures):
    log = fx.log()
    return (
        log.filter(F.col("subject") == "user_7")
        .unionByName(log.filter(F.col("entry_type") == "ERROR"))
        .unionByName(log.filter((F.col("subject") == "user_8") & (F.col("entry_type") == "WARN")))
    )


ADV = Q.Filters(sources=(("box", 1), ("user", 2), ("scp", 3)), type_ids=(1, 4), tag_ids=(2, 3))
ADV_SQL = (
    "(SELECT s.id FROM fx_series s WHERE EXISTS (SELECT 1 FROM fx_series_sources x WHERE x.id = s.id AND "
    "((x.sourcetype = 'box' AND x.sourceid = 1) OR (x.sourcetype = 'user' AND x.sourceid = 2) OR "
    "(x.sourcetype = 'scp' AND x.sourceid = 3))) AND EXISTS (SELECT 1 FROM fx_series_type_links x WHERE "
    "x.series_id = s.id AND x.type_id IN (1, 4)) AND EXISTS (SELECT 1 FROM fx_series_tag_links x WHERE "
    "x.series_id = s.id AND x.tag_id IN (2, 3)))"
)


@query("query_adv_filters", f"SELECT {SE} FROM fx_series WHERE modality = 'O' AND id IN {ADV_SQL}")
def query_adv_filters(fx: Fixtures):
    q = Q.Query(predicates=(Q.Predicate("modality", "=", "O"),), filters=ADV)
    return Q.run_query(fx.catalogue(), "series", q)


_SAVED = [(1, "box:1,user:2"), (2, "scp:3"), (3, "directory"), (4, "import:x"), (5, "fax:1,import:4")]


@query(
    "saved_filters",
    "WITH saved AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{t}')" for i, t in _SAVED) + ") v(id, text)), "
    "parts AS (SELECT id AS filter_id, unnest(string_split(text, ',')) AS part FROM saved), "
    "refs AS (SELECT filter_id, CASE WHEN split_part(part, ':', 1) IN ('scp','directory','box','user','import') THEN "
    "split_part(part, ':', 1) ELSE 'unknown' END AS sourcetype, TRY_CAST(split_part(part, ':', 2) AS BIGINT) AS sourceid "
    "FROM parts), bad AS (SELECT DISTINCT filter_id FROM refs WHERE sourceid IS NULL) "
    "SELECT s.id AS filter_id, s.id NOT IN (SELECT filter_id FROM bad) AS valid, "
    "count(DISTINCT x.id) AS series_count FROM saved s LEFT JOIN refs r ON r.filter_id = s.id AND s.id NOT IN "
    "(SELECT filter_id FROM bad) LEFT JOIN fx_series_sources x ON x.sourcetype = r.sourcetype AND x.sourceid = r.sourceid "
    "GROUP BY ALL",
)
def saved_filters(fx: Fixtures):
    """A table of saved source filters, each resolved against all series; malformed ones are reported, not run."""
    from tierbook.sources.dims import constant_table

    saved = constant_table(fx.spark, _SAVED, {"filter_id": "bigint", "text": "string"})
    refs = Q.explode_source_refs(saved, "text")
    verdict = refs.groupBy("filter_id").agg(F.min("valid").alias("valid"))
    usable = refs.select("filter_id", "sourcetype", "sourceid").join(
        verdict.filter("valid"), "filter_id", "left_semi"
    ).distinct()
    per_source = fx.series_sources().groupBy("sourcetype", "sourceid").agg(F.count(F.lit(1)).alias("n"))
    hits = usable.join(per_source, ["sourcetype", "sourceid"]).groupBy("filter_id").agg(F.sum("n").alias("series_count"))
    return verdict.join(hits, "filter_id", "left").select(
        "filter_id", "valid", F.coalesce("series_count", F.lit(0).cast("bigint")).alias("series_count")
    )


# -- level queries ---------------------------------------------------------------------------------------------


@query("flat_series", f"SELECT {FLAT} FROM fx_flat_series")
def flat_series(fx: Fixtures):
    return Q.flat_series(fx.catalogue())


@query("query_patients", f"SELECT {P} FROM fx_patients WHERE id IN (SELECT st.patient_ref FROM fx_studies st JOIN "
       "fx_series s ON s.study_ref = st.id WHERE st.studyDescription = 'BUILDING' AND s.modality = 'F' AND "
       "s.protocolName LIKE '%5%') AND patientSex = 'F'")
def query_patients(fx: Fixtures):
    q = Q.Query(predicates=(
        Q.Predicate("patientSex", "=", "F"), Q.Predicate("studyDescription", "=", "BUILDING"),
        Q.Predicate("modality", "=", "F"), Q.Predicate("protocolName", "like", "5")))
    return Q.run_query(fx.catalogue(), "patient", q)


@query("query_studies", f"SELECT {ST} FROM fx_studies WHERE patient_ref IN (SELECT id FROM fx_patients WHERE "
       "patientSex = 'M') AND id IN (SELECT study_ref FROM fx_series WHERE modality = 'P' AND stationName LIKE '%S1%')")
def query_studies(fx: Fixtures):
    q = Q.Query(predicates=(Q.Predicate("patientSex", "=", "M"), Q.Predicate("modality", "=", "P"),
                            Q.Predicate("stationName", "like", "S1")))
    return Q.run_query(fx.catalogue(), "study", q)


@query("query_series", f"SELECT {SE} FROM fx_series WHERE study_ref IN (SELECT st.id FROM fx_studies st JOIN fx_patients p "
       "ON p.id = st.patient_ref WHERE p.patientName LIKE '%_2%' AND st.studyDescription = 'MACHINERY')")
def query_series(fx: Fixtures):
    q = Q.Query(predicates=(Q.Predicate("patientName", "like", "_2"), Q.Predicate("studyDescription", "=", "MACHINERY")))
    return Q.run_query(fx.catalogue(), "series", q)


@query("query_images", f"SELECT {IM} FROM fx_images i WHERE imageType = 'A\\F' AND EXISTS (SELECT 1 FROM fx_flat_series f "
       f"WHERE f.id = i.series_ref AND f.patientSex = 'M' AND f.modality = 'F') AND series_ref IN {ADV_SQL}")
def query_images(fx: Fixtures):
    q = Q.Query(predicates=(Q.Predicate("imageType", "=", "A\\F"), Q.Predicate("patientSex", "=", "M"),
                            Q.Predicate("modality", "=", "F")), filters=ADV)
    return Q.run_query(fx.catalogue(), "image", q)


@query("query_flat_series", f"SELECT {FLAT} FROM fx_flat_series WHERE patientSex = 'F' AND studyDescription = 'BUILDING' "
       "AND seriesDate LIKE '%1997%' AND id IN (SELECT series_id FROM fx_series_tag_links WHERE tag_id = 1)")
def query_flat_series(fx: Fixtures):
    q = Q.Query(predicates=(Q.Predicate("patientSex", "=", "F"), Q.Predicate("studyDescription", "=", "BUILDING"),
                            Q.Predicate("seriesDate", "like", "1997")), filters=Q.Filters(tag_ids=(1,)))
    return Q.run_query(fx.catalogue(), "flat_series", q)


@query("list_patients_adv", f"SELECT {P} FROM fx_patients WHERE (lower(patientName) LIKE '%tion%') AND id IN (SELECT "
       f"st.patient_ref FROM fx_studies st JOIN fx_series s ON s.study_ref = st.id WHERE s.id IN {ADV_SQL})")
def list_patients_adv(fx: Fixtures):
    return Q.list_patients(fx.catalogue(), "TION", ADV)


@query("list_flat_series_adv", f"SELECT {FLAT} FROM fx_flat_series WHERE ({_FLAT_TEXT.format('high')}) AND id IN {ADV_SQL}")
def list_flat_series_adv(fx: Fixtures):
    return Q.list_flat_series(fx.catalogue(), "high", ADV)


@query("studies_for_patient", f"SELECT 'all' AS listing, {ST} FROM fx_studies WHERE patient_ref = 3 UNION ALL "
       f"SELECT 'filtered', {ST} FROM fx_studies WHERE patient_ref = 3 AND id IN (SELECT study_ref FROM fx_series "
       f"WHERE id IN {ADV_SQL})")
def studies_for_patient(fx: Fixtures):
    cat = fx.catalogue()
    plain = Q.studies_for_patient(cat, 3).select(F.lit("all").alias("listing"), "*")
    return plain.unionByName(Q.studies_for_patient(cat, 3, ADV).select(F.lit("filtered").alias("listing"), "*"))


@query("series_for_study", f"SELECT 'all' AS listing, {SE} FROM fx_series WHERE study_ref = 11 UNION ALL "
       f"SELECT 'filtered', {SE} FROM fx_series WHERE study_ref = 11 AND id IN (SELECT id FROM fx_series_sources "
       "WHERE sourcetype IN ('user', 'box'))")
def series_for_study(fx: Fixtures):
    cat = fx.catalogue()
    refs = tuple((t, i) for t in ("user", "box") for i in range(7))
    plain = Q.series_for_study(cat, 11).select(F.lit("all").alias("listing"), "*")
    some = Q.series_for_study(cat, 11, Q.Filters(sources=refs)).select(F.lit("filtered").alias("listing"), "*")
    return plain.unionByName(some)


@query("images_for_study", f"SELECT {IM} FROM fx_images WHERE series_ref IN (SELECT id FROM fx_series WHERE study_ref = 11 "
       "AND id IN (SELECT series_id FROM fx_series_type_links WHERE type_id IN (2, 3)))")
def images_for_study(fx: Fixtures):
    return Q.images_for_study(fx.catalogue(), 11, Q.Filters(type_ids=(2, 3)))


@query("images_for_patient", f"SELECT {IM} FROM fx_images WHERE series_ref IN (SELECT f.id FROM fx_flat_series f WHERE "
       "f.patient_id = 3) AND series_ref IN (SELECT series_id FROM fx_series_tag_links WHERE tag_id = 3)")
def images_for_patient(fx: Fixtures):
    return Q.images_for_patient(fx.catalogue(), 3, Q.Filters(tag_ids=(3,)))


@query("tags_for_series", "SELECT l.series_id AS series_id, t.id AS tag_id, t.name AS name FROM fx_series_tag_links l JOIN "
       "fx_series_tags t ON t.id = l.tag_id")
def tags_for_series(fx: Fixtures):
    cat = fx.catalogue()
    return Q.labels_of_series(cat.series_tag_links, cat.series_tags, "tag_id")


@query("types_for_series_list", "SELECT l.series_id AS series_id, t.id AS type_id, t.name AS name FROM fx_series_type_links "
       "l JOIN fx_series_types t ON t.id = l.type_id WHERE l.series_id IN (SELECT user_id FROM events)")
def types_for_series_list(fx: Fixtures):
    cat = fx.catalogue()
    return Q.labels_of_series(cat.series_type_links, cat.series_types, "type_id", fx.table("events").select("user_id"))


# -- order and pages -------------------------------------------------------------------------------------------


@query("page_patients", f"SELECT {P} FROM fx_patients ORDER BY patientSex DESC, id LIMIT 7 OFFSET 4")
def page_patients(fx: Fixtures):
    return Q.run_query(fx.catalogue(), "patient", Q.Query(4, 7, "patientSex", False))


@query("page_deep", "SELECT id, sopInstanceUID, imageType FROM fx_images ORDER BY imageType DESC, id LIMIT 30 OFFSET 3000")
def page_deep(fx: Fixtures):
    """A page far down a column with few values."""
    return Q.page_by_rank(fx.images(), "imageType", False, 3000, 30, few=1000).select("id", "sopInstanceUID", "imageType")


@query("flat_series_ordered", f"SELECT {FLAT} FROM fx_flat_series ORDER BY studyID DESC, id LIMIT 50 OFFSET 25")
def flat_series_ordered(fx: Fixtures):
    return Q.list_flat_series(fx.catalogue(), order_by="studyID", ascending=False, start=25, count=50)


@query("log_recent", "SELECT * FROM fx_log ORDER BY created DESC, id DESC LIMIT 20 OFFSET 10")
def log_recent(fx: Fixtures):
    from tierbook.operators.log import recent

    return recent(fx.log(), 10, 20)


@query("page_dims", "SELECT 'box' AS dim, id, name FROM (SELECT * FROM fx_boxes ORDER BY id LIMIT 3 OFFSET 1) UNION ALL "
       "SELECT 'scu', id, name FROM (SELECT s_suppkey AS id, s_name AS name FROM supplier ORDER BY s_suppkey LIMIT 20) "
       "UNION ALL SELECT 'session', id, name FROM (SELECT DISTINCT session_id AS id, 'session ' || session_id AS name "
       "FROM fx_import_log ORDER BY id LIMIT 10 OFFSET 5)")
def page_dims(fx: Fixtures):
    boxes = Q.page(fx.boxes().select("id", "name"), None, True, 1, 3)
    scus = Q.page(fx.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), None, True,
                  0, 20)
    sessions = fx.import_log().select(F.col("session_id").alias("id")).distinct().select(
        "id", F.concat(F.lit("session "), F.col("id").cast("string")).alias("name"))
    return (
        boxes.select(F.lit("box").alias("dim"), "id", "name")
        .unionByName(scus.select(F.lit("scu").alias("dim"), "id", "name"))
        .unionByName(Q.page(sessions, None, True, 5, 10).select(F.lit("session").alias("dim"), "id", "name"))
    )


# -- unions ----------------------------------------------------------------------------------------------------


@query("source_catalog", "SELECT DISTINCT 'user' AS sourcetype, 'user_' || user_id AS sourcename, user_id AS sourceid FROM "
       "events UNION ALL SELECT 'box', name, id FROM fx_boxes UNION ALL SELECT 'scp', s_name, s_suppkey FROM supplier "
       "UNION ALL SELECT 'directory', n_name, n_nationkey::BIGINT FROM nation UNION ALL SELECT DISTINCT 'import', "
       "'session ' || session_id, session_id FROM fx_import_log")
def source_catalog(fx: Fixtures):
    from tierbook.sources.parties import source_catalogue

    return source_catalogue(
        users=fx.table("events").select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("name"),
                                        F.col("user_id").alias("id")).distinct(),
        boxes=fx.boxes(),
        scps=fx.table("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")),
        directories=fx.table("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("id")),
        imports=fx.import_log().select(F.col("session_id").alias("id")).distinct().select(
            F.concat(F.lit("session "), F.col("id").cast("string")).alias("name"), "id"),
    )


@query("destination_catalog", "SELECT 'box' AS destinationtype, name AS destinationname, id AS destinationid FROM fx_boxes "
       "UNION ALL SELECT 'scu', s_name, s_suppkey FROM supplier")
def destination_catalog(fx: Fixtures):
    from tierbook.sources.parties import destination_catalogue

    scus = fx.table("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return destination_catalogue(fx.boxes(), scus)

"""Registered queries: upsert, delete, labels, constraints, attribute changes, imports."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierbook import schema as S
from tierbook.operators import imports as I
from tierbook.operators import maintain as M
from tierbook.operators.refcounts import Hierarchy
from tierbook.plans.fixtures import Fixtures
from tierbook.plans.registry import query
from tierbook.session import materialise, work_dir
from tierbook.sources.versioned import Versioned

CUTOFF = "1999-01-01"
LATER = "2000-06-01"
#: For the given tables; a bucket should hold some hundred MB.
BUCKETS = 16

_WIDE = (
    "SELECT a.series_ref AS series_id, p.patientName, p.patientID, p.patientBirthDate, p.patientSex, st.studyInstanceUID, "
    "st.studyDescription, st.studyDate, st.studyID, st.accessionNumber, st.patientAge, s.seriesInstanceUID, "
    "s.seriesDescription, s.seriesDate, s.modality, 'P' || (a.l_partkey % 10) AS protocolName, s.bodyPartExamined, "
    "s.manufacturer, 'S' || (a.l_suppkey % 12) AS stationName, s.frameOfReferenceUID, a.sopInstanceUID, a.imageType, "
    "a.instanceNumber, a.l_shipdate, a.l_partkey, a.l_suppkey, a.l_extendedprice FROM fx_arrivals a JOIN fx_series s ON "
    "s.id = a.series_ref JOIN fx_studies st ON st.id = s.study_ref JOIN fx_patients p ON p.id = st.patient_ref"
)


def wide_arrivals(fx: Fixtures) -> DataFrame:
    """Arrivals with the properties of all levels.  Levels are joined from the top, so arrivals, of which there are most, meet one join."""
    series = (
        fx.series().drop("protocolName", "stationName").withColumnRenamed("id", "series_ref")
        .join(fx.studies().withColumnRenamed("id", "study_ref"), "study_ref")
        .join(fx.patients().withColumnRenamed("id", "patient_ref"), "patient_ref")
    )
    return fx.arrivals(series).drop("l_quantity").withColumns({
        "protocolName": F.concat(F.lit("P"), (F.col("l_partkey") % 10).cast("string")),
        "stationName": F.concat(F.lit("S"), (F.col("l_suppkey") % 12).cast("string")),
    })


def level_rows(levels: dict[str, DataFrame], status: bool = True) -> DataFrame:
    """All levels in one shape: level, natural key, remaining values, status."""
    out = None
    for name, frame in levels.items():
        rows = frame.select(
            F.lit(name).alias("level"),
            F.concat_ws("|", *M.key_path(name)).alias("natural_key"),
            F.concat_ws("|", *M.own_props(name)).alias("attributes"),
            *(["status"] if status else []),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _upsert_sql(status: bool = True) -> str:
    parts = []
    for name in S.LEVELS:
        keys = ", ".join(M.key_path(name))
        order = "l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, imageType DESC"
        flag = (
            f", CASE WHEN min(l_shipdate) OVER (PARTITION BY {keys}) >= DATE '{CUTOFF}' THEN 'added' "
            f"WHEN max(l_shipdate) OVER (PARTITION BY {keys}) < DATE '{CUTOFF}' THEN 'kept' ELSE 'updated' END AS status"
            if status else ""
        )
        parts.append(
            f"SELECT level, natural_key, attributes{', status' if status else ''} FROM (SELECT '{name}' AS level, "
            f"concat_ws('|', {keys}) AS natural_key, concat_ws('|', {', '.join(M.own_props(name))}) AS attributes{flag}, "
            f"row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM wide) WHERE rn = 1"
        )
    return f"WITH wide AS ({_WIDE}) " + " UNION ALL ".join(parts)


@query("ingest_upsert", _upsert_sql())
def ingest_upsert(fx: Fixtures):
    """Snapshot of everything shipped before the cutoff, merged with the later arrivals as one batch."""
    wide = wide_arrivals(fx)
    old = M.snapshot_of(wide.filter(F.col("ship_date") < F.lit(CUTOFF).cast("date")), F.col("arrival"))
    batch = wide.filter(F.col("ship_date") >= F.lit(CUTOFF).cast("date"))
    return level_rows(M.upsert_hierarchy(old, batch, F.col("arrival")))


@query("ingest_versioned", _upsert_sql(status=False))
def ingest_versioned(fx: Fixtures):
    """The same arrivals merged into versioned tables: what came before the cutoff, then one batch for each half of the later time."""
    wide = materialise(wide_arrivals(fx).withColumn("patientName", F.substring("patientName", 1, S.NAME_LIMIT)), "wide")
    day = F.col("ship_date")
    batches = [wide.filter(day < CUTOFF), wide.filter((day >= CUTOFF) & (day < LATER)), wide.filter(day >= LATER)]
    root, tables = work_dir(fx.spark, "versions"), {}
    for name in S.LEVELS:
        rows = [M.latest(batch, M.key_path(name), M.own_props(name), F.col("arrival")) for batch in batches]
        table = Versioned(fx.spark, f"{root}/{name}", M.key_path(name), BUCKETS).create(rows[0])
        for more in rows[1:]:
            table.merge(more)
        tables[name] = table.read()
    return level_rows(tables, status=False)


_KEYS5 = ", ".join(M.key_path("image"))
_LAST = "l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, imageType DESC"


def _new(level: str) -> str:
    return f"min(l_shipdate) OVER (PARTITION BY {', '.join(M.key_path(level))}) >= DATE '{CUTOFF}'"


@query(
    "ingest_catalogue",
    f"WITH wide AS ({_WIDE}), w AS (SELECT *, {', '.join(_new(n) + f' AS {n}_new' for n in S.LEVELS)}, row_number() OVER (PARTITION BY "
    f"{_KEYS5} ORDER BY {_LAST}) AS rn, first_value(['box', 'directory', 'user'][l_suppkey % 3 + 1]) OVER (PARTITION BY "
    f"{', '.join(M.key_path('series'))} ORDER BY {_LAST} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sourcetype, max(l_shipdate) OVER "
    f"(PARTITION BY {_KEYS5}) >= DATE '{CUTOFF}' AS came FROM wide) SELECT sopInstanceUID, seriesInstanceUID, studyInstanceUID, patientName, imageType, "
    "sourcetype, CASE WHEN came THEN patient_new END AS patient_added, CASE WHEN came THEN study_new END AS study_added, CASE WHEN came THEN "
    "series_new END AS series_added, CASE WHEN came THEN image_new END AS image_added, true AS known_once FROM w WHERE rn = 1",
)
def ingest_catalogue(fx: Fixtures):
    """Two ingests into an empty catalogue, the second one from the cutoff on; images with their parents found over ids."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("box", "directory", "user")]), (F.col("l_suppkey") % 3 + 1).cast("int"))
    wide = wide_arrivals(fx).withColumns({"sourcetype": kind, "sourcename": F.concat(kind, F.lit("1")), "sourceid": F.lit(1).cast("bigint")})
    late = F.col("ship_date") >= F.lit(CUTOFF).cast("date")
    first = M.ingest(M.empty_catalogue(fx.spark), wide.filter(~late), F.col("arrival"))
    last = M.ingest(first.catalogue, wide.filter(late), F.col("arrival"))
    cat = last.catalogue
    series = (
        cat.series.select(F.col("id").alias("series_ref"), "study_ref", "seriesInstanceUID")
        .join(cat.study.select(F.col("id").alias("study_ref"), "patient_ref", "studyInstanceUID"), "study_ref")
        .join(cat.patient.select(F.col("id").alias("patient_ref"), "patientName"), "patient_ref")
        .join(cat.series_sources.select(F.col("id").alias("series_ref"), "sourcetype"), "series_ref")
    )
    once = cat.image.groupBy("id").agg((F.count(F.lit(1)) == 1).alias("known_once"))
    return (
        cat.image.join(once, "id").join(last.added.withColumnRenamed("image_id", "id"), "id", "left").join(series, "series_ref")
        .select("sopInstanceUID", "seriesInstanceUID", "studyInstanceUID", "patientName", "imageType", "sourcetype", "patient_added", "study_added",
                "series_added", "image_added", "known_once")
    )


_DOOMED = ("(SELECT i.id FROM fx_images i JOIN fx_flat_series f ON f.id = i.series_ref JOIN nation n ON "
           "n.n_nationkey = f.patient_id WHERE i.imageType LIKE '%F' OR n.n_regionkey = 0)")


def doomed_images(fx: Fixtures) -> DataFrame:
    region = fx.table("nation").select(F.col("n_nationkey").cast("bigint").alias("patient_id"), "n_regionkey")
    owner = (
        fx.series().select(F.col("id").alias("series_ref"), F.col("study_ref"))
        .join(fx.studies().select(F.col("id").alias("study_ref"), F.col("patient_ref").alias("patient_id")), "study_ref")
        .join(region, "patient_id")
        .select("series_ref", "n_regionkey")
    )
    return fx.images().join(owner, "series_ref").filter(
        F.col("imageType").endswith("F") | (F.col("n_regionkey") == 0)
    ).select("id")


_CASCADE = (
    f"WITH gone AS {_DOOMED}, live_series AS (SELECT * FROM fx_series WHERE id IN (SELECT series_ref FROM fx_images)), "
    "gone_series AS (SELECT id FROM live_series WHERE id NOT IN (SELECT series_ref FROM fx_images WHERE id NOT IN "
    "(SELECT id FROM gone))), touched AS (SELECT DISTINCT study_ref AS id FROM live_series WHERE id IN (SELECT id FROM "
    "gone_series)), gone_studies AS (SELECT id FROM touched WHERE id NOT IN (SELECT study_ref FROM live_series WHERE id "
    "NOT IN (SELECT id FROM gone_series))), touched_p AS (SELECT DISTINCT patient_ref AS id FROM fx_studies WHERE id IN "
    "(SELECT id FROM gone_studies)), gone_patients AS (SELECT id FROM touched_p WHERE id NOT IN (SELECT patient_ref FROM "
    "fx_studies WHERE id NOT IN (SELECT id FROM gone_studies))) "
    "SELECT 'image' AS level, id FROM gone UNION ALL SELECT 'series', id FROM gone_series UNION ALL "
    "SELECT 'study', id FROM gone_studies UNION ALL SELECT 'patient', id FROM gone_patients"
)


def live_catalogue(fx: Fixtures):
    """The catalogue with the series that have images."""
    cat = fx.catalogue()
    used = fx.table("lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return replace(cat, series=cat.series.join(used, "id", "left_semi"))


@query(
    "cascade_delete",
    f"{_CASCADE} UNION ALL SELECT 'type link', series_id * 10 + type_id FROM fx_series_type_links WHERE series_id NOT IN (SELECT id FROM gone_series)",
)
def cascade_delete(fx: Fixtures):
    """Deleted ids per level, and the type links that survive."""
    cat = live_catalogue(fx)
    result = M.cascade_delete(cat, doomed_images(fx))
    out = None
    for name, frame in result.deleted.items():
        rows = frame.select(F.lit(name).alias("level"), "id")
        out = rows if out is None else out.unionByName(rows)
    links = M.drop_children(cat.series_type_links, "series_id", result.deleted["series"])
    return out.unionByName(links.select(F.lit("type link").alias("level"),
                                        (F.col("series_id") * 10 + F.col("type_id")).alias("id")))


@query("delete_by_counts", _CASCADE)
def delete_by_counts(fx: Fixtures):
    """The same deletion on tables by id with maintained counts of children."""
    tree = Hierarchy(fx.spark, work_dir(fx.spark, "hierarchy"), BUCKETS).create(live_catalogue(fx))
    deleted = tree.delete(doomed_images(fx))
    return reduce(DataFrame.unionByName, [frame.select(F.lit(name).alias("level"), "id") for name, frame in deleted.items()])


_TAG_REQUESTS = ("(SELECT event_id * 2 AS series_id, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'N' ELSE "
                 "event_type END AS name FROM events)")


def tag_requests(fx: Fixtures) -> DataFrame:
    kind = F.col("event_type")
    return fx.table("events").select(
        (F.col("event_id") * 2).alias("series_id"),
        F.when(kind == "click", "A").when(kind == "view", "N").otherwise(kind).alias("name"),
    )


@query(
    "tag_add",
    f"WITH req AS (SELECT DISTINCT r.* FROM {_TAG_REQUESTS} r WHERE series_id IN (SELECT id FROM fx_series)), links AS "
    "(SELECT l.series_id, t.name FROM fx_series_tag_links l JOIN fx_series_tags t ON t.id = l.tag_id UNION SELECT * FROM "
    "req) SELECT series_id, name, (SELECT count(DISTINCT name) FROM (SELECT name FROM fx_series_tags UNION SELECT name "
    "FROM req)) AS tag_count FROM links",
)
def tag_add(fx: Fixtures):
    cat = fx.catalogue()
    tags, links = M.add_tags(cat.series_tags, cat.series_tag_links, tag_requests(fx), cat.series)
    total = tags.agg(F.count_distinct("id")).scalar()
    return links.join(tags.withColumnRenamed("id", "tag_id"), "tag_id").select(
        "series_id", "name", total.alias("tag_count")
    )


@query("tag_remove", "SELECT series_id, tag_id FROM fx_series_tag_links WHERE tag_id <> 3 AND NOT (tag_id = 1 AND series_id IN "
       "(SELECT event_id FROM events WHERE event_type = 'click'))")
def tag_remove(fx: Fixtures):
    """Unlink label 1 from requested series, then drop label 3 with all its links."""
    clicks = fx.table("events").filter(F.col("event_type") == "click").select(
        F.col("event_id").alias("series_id"), F.lit(1).cast("bigint").alias("tag_id"))
    left = M.remove_links(fx.series_tag_links(), clicks)
    return M.drop_children(left, "tag_id", fx.series_tags().filter("id = 3").select("id"))


@query(
    "types_assign",
    "SELECT series_id, type_id FROM (SELECT series_id, type_id FROM fx_series_type_links UNION SELECT event_id, "
    "event_id % 6 + 1 FROM events) WHERE series_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error') AND "
    "NOT (type_id = 2 AND series_id IN (SELECT event_id FROM events WHERE event_type = 'view'))",
)
def types_assign(fx: Fixtures):
    """Assign types (duplicates ignored), remove one type from some series and all types from others."""
    events = fx.table("events").withColumn("series_id", F.col("event_id"))
    added = events.select("series_id", (F.col("event_id") % 6 + 1).alias("type_id"))
    links = M.assign_types(fx.series_type_links(), added)
    one = events.filter(F.col("event_type") == "view").select("series_id", F.lit(2).cast("bigint").alias("type_id"))
    return M.drop_children(M.remove_links(links, one), "series_id",
                           events.filter(F.col("event_type") == "error").select("series_id"))


@query(
    "fk_cascade",
    f"WITH gone AS {_DOOMED}, gone_tx AS (SELECT id FROM fx_outgoing WHERE box_id = 2) "
    "SELECT 'outgoing' AS tbl, id AS a, box_id AS b FROM fx_outgoing WHERE box_id <> 2 UNION ALL "
    "SELECT 'outgoing image', id, image_id FROM fx_outgoing_images WHERE transaction_id NOT IN (SELECT id FROM gone_tx) "
    "AND image_id NOT IN (SELECT id FROM gone) UNION ALL "
    "SELECT 'incoming image', transaction_id, image_id FROM fx_incoming_events WHERE image_id IS NOT NULL AND image_id NOT IN "
    "(SELECT id FROM gone) UNION ALL "
    "SELECT 'key value', key_id, 0 FROM fx_anon_key_values WHERE key_id NOT IN (SELECT id FROM fx_anon_keys WHERE image_id "
    "IN (SELECT id FROM gone)) UNION ALL "
    "SELECT 'import image', session_id, image_id FROM (SELECT DISTINCT session_id, image_id FROM fx_import_log WHERE NOT "
    "rejected) WHERE session_id <> 4 UNION ALL "
    "SELECT 'filter source', filter_id, sourceid FROM fx_source_tag_filters WHERE (sourcetype, sourceid) NOT IN (SELECT "
    "sourcetype, sourceid FROM fx_series_sources WHERE sourcetype = 'scp') AND filter_id <> 2 UNION ALL "
    "SELECT 'filter path', filter_id, id FROM fx_tag_filter_paths WHERE filter_id <> 2",
)
def fk_cascade(fx: Fixtures):
    """One box, one import session, one filter, all scp sources and a set of images go; everything below follows."""
    gone = doomed_images(fx)
    outgoing = fx.outgoing()
    gone_tx = outgoing.filter("box_id = 2").select("id")
    out_images = M.drop_children(M.drop_children(fx.outgoing_images(), "transaction_id", gone_tx), "image_id", gone)
    incoming = M.drop_children(fx.incoming_events().filter("image_id IS NOT NULL"), "image_id", gone)
    gone_keys = fx.anon_keys().join(gone.toDF("image_id"), "image_id", "left_semi").select("id")
    key_values = M.drop_children(fx.anon_key_values(), "key_id", gone_keys)
    sessions = fx.import_log().filter(~F.col("rejected")).select("session_id", "image_id").distinct()
    four = fx.import_log().select("session_id").filter("session_id = 4").distinct()
    lost_sources = fx.series_sources().filter(F.col("sourcetype") == "scp").select("sourcetype", "sourceid").distinct()
    associations = fx.source_tag_filters().join(lost_sources, ["sourcetype", "sourceid"], "left_anti")
    two = fx.tag_filters().filter("id = 2").select("id")

    def part(name, frame, a, b):
        right = F.lit(0).cast("bigint") if b is None else F.col(b)
        return frame.select(F.lit(name).alias("tbl"), F.col(a).alias("a"), right.alias("b"))

    return (
        part("outgoing", M.drop_children(outgoing, "id", gone_tx), "id", "box_id")
        .unionByName(part("outgoing image", out_images, "id", "image_id"))
        .unionByName(part("incoming image", incoming, "transaction_id", "image_id"))
        .unionByName(part("key value", key_values, "key_id", None))
        .unionByName(part("import image", M.drop_children(sessions, "session_id", four), "session_id", "image_id"))
        .unionByName(part("filter source", M.drop_children(associations, "filter_id", two), "filter_id", "sourceid"))
        .unionByName(part("filter path", M.drop_children(fx.tag_filter_paths(), "filter_id", two), "filter_id", "id"))
    )


@query(
    "quality_report",
    "SELECT 'image key' AS rule, count(*) AS failures FROM (SELECT series_ref, sopInstanceUID FROM fx_arrivals GROUP BY ALL "
    "HAVING count(*) > 1) UNION ALL SELECT 'series key', count(*) FROM (SELECT study_ref, seriesInstanceUID FROM fx_series "
    "GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'study key', count(*) FROM (SELECT patient_ref, studyInstanceUID "
    "FROM fx_studies GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'patient key', count(*) FROM (SELECT patientName, "
    "patientID FROM fx_patients GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'series of key image', count(*) FROM "
    "fx_outgoing_images WHERE image_id NOT IN (SELECT id FROM fx_images) UNION ALL SELECT 'image series', count(*) FROM "
    "fx_arrivals WHERE series_ref NOT IN (SELECT id FROM fx_series) UNION ALL SELECT 'series study', count(*) FROM "
    "fx_series WHERE study_ref NOT IN (SELECT id FROM fx_studies) UNION ALL SELECT 'study patient', count(*) FROM "
    "fx_studies WHERE patient_ref NOT IN (SELECT id FROM fx_patients)",
)
def quality_report(fx: Fixtures):
    cat = fx.catalogue()
    checks = {
        "image key": M.duplicate_keys(fx.arrivals(), ["series_ref", "sopInstanceUID"]),
        "series key": M.duplicate_keys(cat.series, ["study_ref", "seriesInstanceUID"]),
        "study key": M.duplicate_keys(cat.study, ["patient_ref", "studyInstanceUID"]),
        "patient key": M.duplicate_keys(cat.patient, ["patientName", "patientID"]),
        "series of key image": M.orphans(fx.outgoing_images(), "image_id", cat.image),
        "image series": M.orphans(fx.arrivals(), "series_ref", cat.series),
        "series study": M.orphans(cat.series, "study_ref", cat.study),
        "study patient": M.orphans(cat.study, "patient_ref", cat.patient),
    }
    out = None
    for name, frame in checks.items():
        row = frame.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("rule"), "failures")
        out = row if out is None else out.unionByName(row)
    return out


_SESSIONS = [("BUILDING", 3), ("MACHINERY", 5)]


@query(
    "dim_merge",
    "WITH known AS (SELECT * FROM (VALUES ('BUILDING', 3::BIGINT), ('MACHINERY', 5::BIGINT)) v(name, owner)), cand AS "
    "(SELECT c_custkey AS id, c_mktsegment AS name, c_nationkey::BIGINT AS owner FROM customer), holder AS (SELECT c.name, "
    "coalesce(max(k.owner), arg_min(c.owner, c.id)) AS owner, max(k.owner) IS NULL AS fresh, min(c.id) AS first_id FROM cand "
    "c LEFT JOIN known k ON k.name = c.name GROUP BY c.name) SELECT c.id AS id, c.name AS name, CASE WHEN h.fresh AND c.id = "
    "h.first_id THEN 'created' WHEN c.owner = h.owner THEN 'existing' ELSE 'conflict' END AS verdict FROM cand c JOIN holder "
    "h ON h.name = c.name UNION ALL SELECT o_orderkey, coalesce(e.event_type, o_orderpriority), 'renamed' FROM orders LEFT "
    "JOIN events e ON e.event_id = o_orderkey AND e.event_type = 'error'",
)
def dim_merge(fx: Fixtures):
    """Create-if-absent with conflict verdicts, and a bulk rename by id."""
    from tierbook.sources.dims import constant_table

    known = constant_table(fx.spark, _SESSIONS, {"name": "string", "owner": "bigint"})
    candidates = fx.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"),
                                             F.col("c_nationkey").cast("bigint").alias("owner"))
    created = M.create_if_absent(known, candidates, "name", "owner", "id").select("id", "name", "verdict")
    dim = fx.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))
    changes = fx.table("events").filter(F.col("event_type") == "error").select(F.col("event_id").alias("id"),
                                                                              F.col("event_type").alias("name"))
    return created.unionByName(M.update_by_id(dim, changes, ["name"]).withColumn("verdict", F.lit("renamed")))


@query("log_retention", "SELECT * FROM fx_log WHERE id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def log_retention(fx: Fixtures):
    """Remove a list of entries; clearing the log adds nothing."""
    from tierbook.operators.log import clear, remove_entries

    ids = fx.table("events").filter(F.col("event_type") == "view").select("event_id")
    return remove_entries(fx.log(), ids).unionByName(clear(fx.log()))


@query(
    "modify_attributes",
    "WITH picked AS (SELECT * FROM fx_flat_images WHERE imageType LIKE 'N%' AND modality = 'P') "
    "SELECT p.image_id AS image_id, 'Moved ' || p.patientID AS patientName, p.patientID AS patientID, p.studyInstanceUID AS "
    "studyInstanceUID, 'changed' AS studyDescription, p.seriesInstanceUID AS seriesInstanceUID, p.sopInstanceUID AS "
    "sopInstanceUID, 'note ' || p.instanceNumber AS comment, s.sourcename AS sourcename, (SELECT string_agg(t.name, ',' ORDER "
    "BY t.name) FROM fx_series_tag_links l JOIN fx_series_tags t ON t.id = l.tag_id WHERE l.series_id = p.series_id) AS tags "
    "FROM picked p JOIN fx_series_sources s ON s.id = p.series_id",
)
def modify_attributes(fx: Fixtures):
    """Change two attributes and insert one, re-extract the levels, carry source and labels over."""
    from tierbook.sources.attributes import extract_levels, pick

    flat = fx.flat_images().filter(F.col("imageType").startswith("N") & (F.col("modality") == "P"))
    picked = flat.select("image_id", "series_id", "patientID", "instanceNumber")
    moved = F.array(
        *[
            F.struct(F.lit(S.tag_number(p)).cast("bigint").alias("tag"), F.lit(p).alias("tag_path"),
                     F.lit(vr).alias("vr"), v.alias("value"))
            for p, vr, v in (
                ("(0010,0010)", "PN", F.concat(F.lit("Moved "), F.col("patientID"))),
                ("(0008,1030)", "LO", F.lit("changed")),
                ("(0032,4000)", "LT", F.concat(F.lit("note "), F.col("instanceNumber"))),
            )
        ]
    )
    changes = picked.select("image_id", F.explode(moved).alias("c")).select(
        "image_id", "c.tag", "c.tag_path", F.array("c.tag").alias("path_tags"), "c.vr",
        F.length("c.value").cast("bigint").alias("length"), F.array("c.value").alias("values"))
    wanted = fx.images().join(picked.select(F.col("image_id").alias("id")), "id", "left_semi")
    merged = M.merge_elements(fx.elements(wanted), changes)
    notes = merged.filter(F.col("tag_path") == "(0032,4000)").groupBy("image_id").agg(
        F.max(F.get("values", F.lit(0))).alias("comment"))
    labels = fx.series_tag_links().join(fx.series_tags().withColumnRenamed("id", "tag_id"), "tag_id").groupBy(
        "series_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("tags"))
    return (
        extract_levels(merged).join(notes, "image_id").join(picked.select("image_id", "series_id"), "image_id")
        .join(fx.series_sources().select(F.col("id").alias("series_id"), "sourcename"), "series_id")
        .join(labels, "series_id")
        .select("image_id", "patientName", "patientID", "studyInstanceUID", "studyDescription", "seriesInstanceUID",
                "sopInstanceUID", "comment", "sourcename", "tags")
    )


# -- imports ---------------------------------------------------------------------------------------------------


@query(
    "import_session_counters",
    "WITH ok AS (SELECT *, row_number() OVER (PARTITION BY session_id, image_id ORDER BY l_shipdate, l_partkey, l_suppkey, "
    "l_extendedprice, imageType) AS rn FROM fx_import_log WHERE NOT rejected) "
    "SELECT a.session_id AS session_id, a.imported AS imported, a.added AS added, r.rejected AS rejected, greatest(a.ts, "
    "coalesce(r.ts, 0)) AS last_updated FROM (SELECT session_id, count(*) AS imported, count(*) FILTER (WHERE rn = 1) AS "
    "added, max(ts_ms) AS ts FROM ok GROUP BY 1) a JOIN (SELECT session_id, count(*) FILTER (WHERE rejected) AS rejected, "
    "max(ts_ms) FILTER (WHERE rejected) AS ts FROM fx_import_log GROUP BY 1) r ON r.session_id = a.session_id",
)
def import_session_counters(fx: Fixtures):
    return I.session_counters(fx.import_log())


@query(
    "import_session_images",
    "SELECT DISTINCT l.session_id AS session_id, i.id AS image_id, i.series_ref AS series_ref, i.sopInstanceUID AS "
    "sopInstanceUID FROM fx_import_log l JOIN fx_images i ON i.id = l.image_id WHERE NOT l.rejected AND i.imageType LIKE '%O'",
)
def import_session_images(fx: Fixtures):
    """Images of each session that still exist; deleted ones drop out."""
    left = fx.images().filter(F.col("imageType").endswith("O"))
    return I.session_images(fx.import_log(), left).select("session_id", "image_id", "series_ref", "sopInstanceUID")

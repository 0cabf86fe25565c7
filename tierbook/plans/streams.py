"""Registered queries that run as streams over everything available and are checked against their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierbook.operators import forwarding as W
from tierbook.operators import maintain as M
from tierbook.operators import rules as R
from tierbook.plans import fixture_values as V
from tierbook.plans.attributes import _involved_elements
from tierbook.plans.fixtures import Fixtures, source_kind
from tierbook.plans.maintenance import _WIDE, level_rows, wide_arrivals
from tierbook.plans.registry import query
from tierbook.plans.transfers import _BATCH, _INCOMING, _SENT, IDLE, sent_reports
from tierbook.session import materialise, work_dir
from tierbook.streaming import counters as C
from tierbook.streaming import forwarding as L
from tierbook.streaming import jobs as J

DELAY_MS = 600_000
#: The turns of a conversation are given times within ten seconds.
STREAM_TIMEOUT_MS = 4_000


class StreamedFixtures(Fixtures):
    """The same derived tables with one table read as a file stream."""

    def __init__(self, fx: Fixtures, streamed: str):
        super().__init__(fx.spark, fx.dir)
        self.streamed = streamed

    def table(self, name: str) -> DataFrame:
        if name != self.streamed:
            return super().table(name)
        # a pattern that matches the table whether it is one file or a folder of files
        return J.watch_files(self.spark, f"{self.dir}/{name}.parque[t]", super().table(name).schema)


@query("stream_file_ingest", "SELECT id, series_ref, sopInstanceUID, imageType, instanceNumber, l_partkey FROM fx_arrivals")
def stream_file_ingest(fx: Fixtures):
    stream = StreamedFixtures(fx, "lineitem").arrivals().select(
        "id", "series_ref", "sopInstanceUID", "imageType", "instanceNumber", "l_partkey")
    return fx.spark.read.parquet(J.run_to_files(stream, work_dir(fx.spark, "files")))


@query("watch_changed_files", "SELECT event_id, user_id, event_type FROM events")
def watch_changed_files(fx: Fixtures):
    """A watched folder taken twice: files that did not change meanwhile arrive once."""
    work, schema = work_dir(fx.spark, "watch"), fx.table("events").schema
    for _ in range(2):
        J.take_changes(fx.spark, f"{fx.dir}/events.parque[t]", schema, work, J.delta_writer(work, lambda batch: batch))
    return J.read_deltas(fx.spark, work).select("event_id", "user_id", "event_type")


@query(
    "stream_ingest",
    f"WITH wide AS ({_WIDE}) SELECT level, natural_key, attributes FROM (SELECT 'image' AS level, concat_ws('|', patientName, patientID, "
    "studyInstanceUID, seriesInstanceUID, sopInstanceUID) AS natural_key, concat_ws('|', imageType, instanceNumber) AS attributes, "
    "row_number() OVER (PARTITION BY patientName, patientID, studyInstanceUID, seriesInstanceUID, sopInstanceUID ORDER BY l_shipdate DESC, "
    "l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, imageType DESC) AS rn FROM wide) WHERE rn = 1",
)
def stream_ingest(fx: Fixtures):
    """Arrivals upserted as a stream; the table resolved from base and deltas equals the batch merge."""
    work = work_dir(fx.spark, "ingest")
    stream = wide_arrivals(StreamedFixtures(fx, "lineitem"))
    keys, props = M.key_path("image"), M.own_props("image")
    J.ingest_upsert(stream, work, keys, props, "arrival")
    base = f"{work}/base"
    J.compact(J.read_deltas(fx.spark, work), keys, props, "arrival", base)
    current = J.resolve(fx.spark.read.parquet(base), keys, props, F.col("arrival"))
    return level_rows({"image": current}, status=False)


@query(
    "stream_classify",
    "WITH reps AS (SELECT series_ref AS series_id, min(id) AS image_id FROM fx_images GROUP BY 1), el AS (SELECT r.series_id, "
    "e.tag_path, replace(e.val, '\\', ',') AS val FROM reps r JOIN fx_elements e ON e.image_id = r.image_id), judged AS (SELECT "
    "r.series_id, k.type_id, k.rule_id, bool_and(a.rule_id IS NULL OR coalesce(el.val, '') = a.expected) AS ok FROM reps r CROSS "
    "JOIN fx_rules k LEFT JOIN fx_rule_attributes a ON a.rule_id = k.rule_id LEFT JOIN el ON el.series_id = r.series_id AND "
    "el.tag_path = a.tag GROUP BY ALL) SELECT DISTINCT series_id, type_id FROM judged WHERE ok",
)
def stream_classify(fx: Fixtures):
    """Image arrivals trigger reclassification of their series."""
    work = work_dir(fx.spark, "classify")

    def classify(touched: DataFrame) -> DataFrame:
        reps = R.representatives(fx.images().join(touched.withColumnRenamed("series_id", "series_ref"), "series_ref", "left_semi"))
        attributes = fx.rule_attributes()
        found = R.rule_values(_involved_elements(fx, reps, nested=False), attributes)
        return R.classify(reps, found, fx.rules(), attributes)

    key = F.col("series_ref")
    stream = StreamedFixtures(fx, "lineitem").arrivals().select(
        key.alias("series_id"), F.col("id").alias("image_id"), source_kind(key).alias("sourcetype"), (key % 7).alias("sourceid"))
    J.react_to_arrivals(stream, work, classify, fx.forwarding_rules())
    return J.current_types(J.read_deltas(fx.spark, f"{work}/types"))


@query(
    "stream_purge",
    "WITH gone AS (SELECT id FROM fx_arrivals WHERE l_quantity = 50) SELECT id AS key_id, image_id FROM fx_anon_keys WHERE image_id NOT IN "
    "(SELECT id FROM gone)",
)
def stream_purge(fx: Fixtures):
    """Images deleted as a stream (arrivals of quantity 50 stand for the deletions) take their keys with them."""
    from tierbook.operators.keys import purge

    work = work_dir(fx.spark, "purge")
    stream = StreamedFixtures(fx, "lineitem").arrivals().filter(F.col("l_quantity") == 50).select(F.col("id").alias("image_id"))
    J.react_to_deletions(stream, work)
    gone = J.read_deltas(fx.spark, work).select("image_id")
    keys, _ = purge(fx.anon_key_table(), fx.anon_key_values(), gone)
    return keys.select(F.col("id").alias("key_id"), "image_id")


@query(
    "stream_forwarding",
    f"WITH {_BATCH} SELECT rule_id, session_start AS started, updated, arrivals FROM tx WHERE updated + {IDLE} <= (SELECT max(epoch_us(ts) "
    f"// 1000) FROM events) - {DELAY_MS}",
)
def stream_forwarding(fx: Fixtures):
    """Transactions the watermark has closed."""
    stream = StreamedFixtures(fx, "events").image_added().drop("ts_ms")
    closed = J.forwarding_sessions(stream, fx.forwarding_rules().select("rule_id", "sourcetype", "sourceid"),
                                   f"{IDLE} milliseconds", f"{DELAY_MS} milliseconds")
    out = fx.spark.read.parquet(J.run_to_files(closed, work_dir(fx.spark, "forwarding")))
    return out.select("rule_id", F.unix_millis("started").alias("started"), F.unix_millis("updated").alias("updated"), "arrivals")


_ENDED = (
    f"{_BATCH}, ended AS (SELECT * FROM tx WHERE updated + {IDLE} <= (SELECT max(epoch_us(ts) // 1000) FROM events) - {DELAY_MS}), inside AS (SELECT b.* "
    f"FROM members b JOIN ended e ON e.rule_id = b.rule_id AND e.session_start = b.session_start), {_SENT}, hit AS (SELECT * FROM (SELECT b.rule_id, "
    "b.session_start, row_number() OVER (PARTITION BY x.destinationtype, x.destinationid, x.image_id ORDER BY b.session_start, b.rule_id) AS rn FROM sent x "
    "JOIN fx_forwarding_rules r ON r.destinationtype = x.destinationtype AND r.destinationid = x.destinationid JOIN inside b ON b.rule_id = r.rule_id AND "
    "b.image_id = x.image_id) WHERE rn = 1), state AS (SELECT e.*, (e.rule_id, e.session_start) IN (SELECT (rule_id, session_start) FROM hit) AS delivered "
    "FROM ended e), k AS (SELECT s.*, r.sourcetype, r.sourceid, r.keep_images FROM state s JOIN fx_forwarding_rules r ON r.rule_id = s.rule_id)"
)


@query(
    "stream_forwarding_life",
    f"WITH {_ENDED} SELECT rule_id, session_start, images, arrivals, delivered, CASE WHEN NOT delivered THEN 'enroute' WHEN keep_images THEN 'remove' WHEN NOT "
    "EXISTS (SELECT 1 FROM k o WHERE o.sourcetype = k.sourcetype AND o.sourceid = k.sourceid AND NOT o.delivered) THEN 'delete' ELSE 'waits' END AS state FROM k",
)
def stream_forwarding_life(fx: Fixtures):
    """Members, deliveries and ends of the closed transactions, from the two forwarding streams."""
    work, rules = work_dir(fx.spark, "life"), fx.forwarding_rules()
    streamed = StreamedFixtures(fx, "events")
    reports = sent_reports(streamed, "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    L.run(streamed.image_added().drop("ts_ms"), reports, rules, work, f"{IDLE} milliseconds", f"{DELAY_MS} milliseconds")
    members = L.current_members(J.read_deltas(fx.spark, f"{work}/members"))
    done = L.delivered(J.read_deltas(fx.spark, f"{work}/hits"))
    flagged = materialise(W.flags(W.transactions(members), done, V.NOW_MS, IDLE), "flags")
    ends = W.finalise(flagged, rules)
    state = F.coalesce("action", F.when(F.col("delivered"), "waits").otherwise("enroute"))
    return flagged.join(ends, W.KEY, "left").select(*W.KEY, "images", "arrivals", "delivered", state.alias("state"))


@query("stream_dedup", "SELECT DISTINCT image_id FROM fx_image_added")
def stream_dedup(fx: Fixtures):
    """Every image is handled once while it is queued; the whole table is one trigger here."""
    stream = StreamedFixtures(fx, "events").image_added().select("image_id", "ts")
    once = J.distinct_arrivals(stream, "image_id", "ts", "1 hour").select("image_id")
    return fx.spark.read.parquet(J.run_to_files(once, work_dir(fx.spark, "dedup")))


@query(
    "stream_incoming",
    f"WITH inc AS ({_INCOMING}), moved AS (SELECT box_id, transaction_id, max(ts_ms) AS updated_ms, max(max(ts_ms)) OVER () AS now_ms FROM "
    "fx_incoming_events GROUP BY 1, 2) SELECT i.box_id, i.transaction_id, received, added, total, sequences, members, CASE WHEN status = "
    f"'PROCESSING' AND now_ms - updated_ms > {STREAM_TIMEOUT_MS} THEN 'WAITING' ELSE status END AS status, updated_ms FROM inc i JOIN moved m ON "
    "m.box_id = i.box_id AND m.transaction_id = i.transaction_id",
)
def stream_incoming(fx: Fixtures):
    """Keyed counters of incoming transactions with changing totals; those that stand still go back to waiting by a timer."""
    work = work_dir(fx.spark, "incoming")
    events = StreamedFixtures(fx, "conversations").incoming_events(fx.table("conversations"))
    C.run(events, work, STREAM_TIMEOUT_MS)
    return C.current(J.read_deltas(fx.spark, work))


@query("stream_log", "SELECT id, created, entry_type, subject, message, strftime(make_timestamp(created * 1000), '%Y-%m-%d') AS day FROM fx_log")
def stream_log(fx: Fixtures):
    """Log entries appended as a stream, one folder per day."""
    log = StreamedFixtures(fx, "events").log()
    dated = log.withColumn("day", F.date_format(F.timestamp_millis("created"), "yyyy-MM-dd"))
    out = J.run_to_files(dated, work_dir(fx.spark, "log"), ["day"])
    return fx.spark.read.schema(dated.schema).parquet(out)

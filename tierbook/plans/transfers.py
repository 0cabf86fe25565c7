"""Registered queries: transfers, forwarding, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierbook.operators import forwarding as W
from tierbook.operators import transfer as T
from tierbook.operators.ordered import sessions
from tierbook.plans import fixture_values as V
from tierbook.plans.fixtures import Fixtures
from tierbook.plans.registry import query
from tierbook.session import materialise

IDLE = 2 * V.HOUR_MS
NOW = V.NOW_MS


# -- outgoing --------------------------------------------------------------------------------------------------


@query(
    "outgoing_create",
    "WITH r AS (SELECT patient_id AS transaction_id, patient_id % 5 AS box_id, image_id, imageType FROM fx_flat_images), n AS (SELECT "
    "*, row_number() OVER (PARTITION BY transaction_id ORDER BY image_id) AS sequence FROM r) SELECT 'transaction' AS kind, "
    "transaction_id, box_id AS a, count(*) AS b, 'WAITING' AS detail FROM r GROUP BY transaction_id, box_id UNION ALL SELECT 'image', "
    "transaction_id, image_id, sequence, '' FROM n UNION ALL SELECT 'value', transaction_id, image_id, sequence, 'Sent ' || imageType "
    "FROM n WHERE imageType LIKE 'A%'",
)
def outgoing_create(fx: Fixtures):
    """All images of each patient as one transaction, with a value for the type-A images."""
    flat = fx.flat_images()
    requests = flat.select(F.col("patient_id").alias("transaction_id"), (F.col("patient_id") % 5).alias("box_id"), "image_id")
    values = flat.filter(F.col("imageType").startswith("A")).select(
        F.col("patient_id").alias("transaction_id"), "image_id", F.lit("(0008,1030)").alias("tag_path"), F.concat(F.lit("Sent "), "imageType").alias("value"))
    made = T.create_outgoing(requests, values)
    return (
        made["transactions"].select(F.lit("transaction").alias("kind"), "transaction_id", F.col("box_id").alias("a"),
                                    F.col("total").alias("b"), F.col("status").alias("detail"))
        .unionByName(made["images"].select(F.lit("image").alias("kind"), "transaction_id", F.col("image_id").alias("a"),
                                           F.col("sequence").alias("b"), F.lit("").alias("detail")))
        .unionByName(made["values"].select(F.lit("value").alias("kind"), "transaction_id", F.col("image_id").alias("a"),
                                           F.col("sequence").alias("b"), F.col("value").alias("detail")))
    )


@query("outgoing_images", "SELECT t.id AS transaction_id, t.box_id AS box_id, i.id AS outgoing_image_id, i.image_id AS image_id, "
       "i.sequence AS sequence, i.sent AS sent FROM fx_outgoing t JOIN fx_outgoing_images i ON i.transaction_id = t.id WHERE t.box_id IN "
       "(1, 3)")
def outgoing_images(fx: Fixtures):
    some = fx.outgoing().filter(F.col("box_id").isin(1, 3)).select(F.col("id").alias("transaction_id"), "box_id")
    return fx.outgoing_images().withColumnRenamed("id", "outgoing_image_id").join(some, "transaction_id").select(
        "transaction_id", "box_id", "outgoing_image_id", "image_id", "sequence", "sent")


@query("outgoing_tag_values", "SELECT t.id AS transaction_id, i.id AS outgoing_image_id, '(0010,0010)' AS tag_path, c.role || ' ' || "
       "length(c.text) AS value FROM fx_outgoing t JOIN fx_outgoing_images i ON i.transaction_id = t.id JOIN conversations c ON c.conv_id * "
       "1000 + c.turn = i.id WHERE t.status <> 'FAILED'")
def outgoing_tag_values(fx: Fixtures):
    values = fx.table("conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("outgoing_image_id"), F.lit("(0010,0010)").alias("tag_path"),
        F.concat_ws(" ", "role", F.length("text").cast("string")).alias("value"))
    live = fx.outgoing().filter(F.col("status") != "FAILED").select(F.col("id").alias("transaction_id"))
    images = fx.outgoing_images().select(F.col("id").alias("outgoing_image_id"), "transaction_id")
    return images.join(live, "transaction_id").join(values, "outgoing_image_id").select(
        "transaction_id", "outgoing_image_id", "tag_path", "value")


@query("transaction_images", "SELECT 'out' AS direction, transaction_id, image_id FROM fx_outgoing_images UNION ALL SELECT 'in', "
       "transaction_id, image_id FROM fx_incoming_events WHERE image_id IS NOT NULL")
def transaction_images(fx: Fixtures):
    out = fx.outgoing_images().select(F.lit("out").alias("direction"), "transaction_id", "image_id")
    into = fx.incoming_events().filter("image_id IS NOT NULL").select(F.lit("in").alias("direction"), "transaction_id", "image_id")
    return out.unionByName(into)


@query("transactions_recent", "SELECT id, box_id, total, sent_count, created, updated, status FROM fx_outgoing ORDER BY updated DESC, id "
       "DESC LIMIT 20 OFFSET 10")
def transactions_recent(fx: Fixtures):
    return T.recent(fx.outgoing(), 10, 20)


@query("next_outgoing", "SELECT box_id, transaction_id, image_id, sequence, rank FROM (SELECT t.box_id, i.transaction_id, i.image_id, "
       "i.sequence, row_number() OVER (PARTITION BY t.box_id ORDER BY t.created, i.sequence, i.transaction_id) AS rank FROM fx_outgoing t "
       "JOIN fx_outgoing_images i ON i.transaction_id = t.id WHERE t.status <> 'FAILED' AND NOT i.sent) WHERE rank <= 25")
def next_outgoing(fx: Fixtures):
    return T.next_batch(fx.outgoing(), fx.outgoing_images(), 25).select("box_id", "transaction_id", "image_id", "sequence", "rank")


@query("running_sent_index", 'SELECT i.transaction_id AS transaction_id, i.sequence AS sequence, t.sent_count + row_number() OVER '
       '(PARTITION BY i.transaction_id ORDER BY i.sequence) AS "index" FROM fx_outgoing t JOIN fx_outgoing_images i ON i.transaction_id = '
       "t.id WHERE t.status <> 'FAILED' AND NOT i.sent")
def running_sent_index(fx: Fixtures):
    return T.sent_index(fx.outgoing(), fx.outgoing_images()).select("transaction_id", "sequence", "index")


@query(
    "outgoing_progress",
    "WITH rep AS (SELECT transaction_id FROM fx_outgoing_images WHERE role <> 'system' UNION ALL SELECT transaction_id FROM "
    "fx_outgoing_images WHERE sent AND transaction_id IN (SELECT id FROM fx_outgoing WHERE status = 'FAILED')), n AS (SELECT transaction_id, count(*) AS c FROM rep GROUP BY 1) SELECT t.id AS "
    "transaction_id, t.total AS total, least(t.total, coalesce(n.c, 0)) AS sent_count, CASE WHEN n.c IS NULL THEN 'WAITING' WHEN n.c >= "
    "t.total THEN 'FINISHED' ELSE 'PROCESSING' END AS status FROM fx_outgoing t LEFT JOIN n ON n.transaction_id = t.id",
)
def outgoing_progress(fx: Fixtures):
    """Delivery reports: every image but the system ones, and the user ones twice where a transaction failed once."""
    images = fx.outgoing_images()
    failed = fx.outgoing().filter(F.col("status") == "FAILED").select(F.col("id").alias("transaction_id"))
    again = images.filter("sent").join(failed, "transaction_id", "left_semi")
    reports = images.filter(F.col("role") != "system").select("transaction_id").unionByName(again.select("transaction_id"))
    return T.outgoing_progress(fx.outgoing().select(F.col("id").alias("transaction_id"), "total"), reports)


# -- incoming --------------------------------------------------------------------------------------------------

_INCOMING = (
    "WITH f AS (SELECT box_id, transaction_id, list_reduce(list(total ORDER BY ts_ms), lambda r, t: least(t, r + 1), 0::BIGINT) AS "
    "received, list_reduce(coalesce(list(total ORDER BY ts_ms) FILTER (WHERE added), []), lambda r, t: least(t, r + 1), 0::BIGINT) AS "
    "added, arg_max(total, ts_ms) AS total, count(DISTINCT sequence) AS sequences, count(image_id) AS members FROM fx_incoming_events "
    "GROUP BY ALL) SELECT box_id, transaction_id, received, added, total, sequences, members, CASE WHEN received >= total THEN "
    "'FINISHED' ELSE 'PROCESSING' END AS status FROM f"
)


@query("incoming_progress", _INCOMING)
def incoming_progress(fx: Fixtures):
    return T.incoming_progress(fx.incoming_events())


@query(
    "transaction_status",
    "WITH inc AS (" + _INCOMING + "), failed AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system') SELECT "
    "i.transaction_id AS transaction_id, i.total AS total, CASE WHEN i.sequences > 5 AND f.conv_id IS NULL THEN i.total ELSE "
    "i.received END AS received, CASE WHEN f.conv_id IS NOT NULL THEN 'FAILED' WHEN i.sequences > 5 THEN 'FINISHED' ELSE i.status "
    "END AS status FROM inc i LEFT JOIN failed f ON f.conv_id = i.transaction_id",
)
def transaction_status(fx: Fixtures):
    """Status messages: conversations with a system turn fail, the others with more than five turns are declared finished."""
    talk = fx.table("conversations").groupBy(F.col("conv_id").alias("transaction_id")).agg(
        F.max(F.when(F.col("role") == "system", 1).otherwise(0)).alias("bad"), F.count(F.lit(1)).alias("turns"))
    changes = talk.filter((F.col("bad") == 1) | (F.col("turns") > 5)).select(
        "transaction_id", F.when(F.col("bad") == 1, "FAILED").otherwise("FINISHED").alias("status"))
    state = T.incoming_progress(fx.incoming_events()).select("transaction_id", "total", "received", "status")
    return T.set_status(state, changes)


@query("transaction_timeout", f"SELECT id, updated, CASE WHEN status = 'PROCESSING' AND {NOW} - updated > 15000 THEN 'WAITING' ELSE status "
       "END AS status FROM fx_outgoing")
def transaction_timeout(fx: Fixtures):
    return T.time_out(fx.outgoing(), NOW).select("id", "updated", "status")


@query("peer_online", f"SELECT user_id AS peer, max(epoch_us(ts) // 1000) AS last_poll, {NOW} - max(epoch_us(ts) // 1000) < "
       f"{6 * V.HOUR_MS} AS online FROM events GROUP BY 1")
def peer_online(fx: Fixtures):
    polls = fx.events().select(F.col("user_id").alias("peer"), F.unix_millis("ts").alias("ts_ms"))
    return T.online_peers(polls, NOW, 6 * V.HOUR_MS)


_CODE = "CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 204 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 400 ELSE 503 END"


@query(
    "transfer_triage",
    f"WITH r AS (SELECT event_id // 10 AS batch, {_CODE} AS code FROM events), v AS (SELECT batch, CASE WHEN code BETWEEN 200 AND 299 THEN "
    "'pass' WHEN code IN (400, 404) THEN 'ignore' ELSE 'fail' END AS verdict FROM r) SELECT batch, count(*) FILTER (WHERE verdict = 'pass') "
    "AS passed, count(*) FILTER (WHERE verdict = 'ignore') AS ignored, bool_or(verdict = 'fail') AS failed FROM v GROUP BY 1",
)
def transfer_triage(fx: Fixtures):
    """Responses in batches of ten: one failing response fails its batch."""
    rows = fx.table("events").select(F.floor(F.col("event_id") / 10).cast("bigint").alias("batch"),
                                     T.triage(F.expr(_CODE)).alias("verdict"))
    return rows.groupBy("batch").agg(
        F.count_if(F.col("verdict") == "pass").alias("passed"), F.count_if(F.col("verdict") == "ignore").alias("ignored"),
        F.bool_or(F.col("verdict") == "fail").alias("failed"))


@query(
    "failure_throttle",
    "WITH e AS (SELECT user_id % 5 AS box_id, event_id, epoch_us(ts) // 1000 AS ts_ms FROM events WHERE event_type = 'error'), g AS (SELECT "
    "*, ts_ms - coalesce(lag(ts_ms) OVER (PARTITION BY box_id ORDER BY ts_ms, event_id), 0) AS apart FROM e) SELECT box_id, event_id, ts_ms "
    "FROM g WHERE apart > 2160000",
)
def failure_throttle(fx: Fixtures):
    failures = fx.events().filter(F.col("event_type") == "error").select(
        (F.col("user_id") % 5).alias("box_id"), "event_id", F.unix_millis("ts").alias("ts_ms"))
    return T.throttle_failures(failures, ["box_id"], "ts_ms", V.HOUR_MS // 2, tie=["event_id"])


@query("send_reconcile", "SELECT transaction_id % 5 AS box_id, count(*) AS requested, count(*) FILTER (WHERE image_id NOT IN (SELECT id FROM "
       "fx_images))::BIGINT AS missing FROM fx_outgoing_images GROUP BY 1")
def send_reconcile(fx: Fixtures):
    requested = fx.outgoing_images().select((F.col("transaction_id") % 5).alias("box_id"), "image_id")
    return T.reconcile(requested, fx.images().select("id"))


# -- forwarding ------------------------------------------------------------------------------------------------

_MATCH = ("m AS (SELECT a.event_id, a.image_id, a.ts_ms, r.rule_id FROM fx_image_added a JOIN fx_forwarding_rules r ON r.sourcetype = "
          "a.sourcetype AND r.sourceid = a.sourceid)")
_BATCH = (
    f"{_MATCH}, g AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w > {IDLE} OR lag(ts_ms) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM m "
    "WINDOW w AS (PARTITION BY rule_id ORDER BY ts_ms, event_id)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY rule_id ORDER BY ts_ms, "
    "event_id) AS nr FROM g), s AS (SELECT *, min(ts_ms) OVER (PARTITION BY rule_id, nr) AS session_start FROM n), members AS (SELECT "
    "rule_id, session_start, image_id, count(*) AS arrivals, max(ts_ms) AS last_ts FROM s GROUP BY ALL), tx AS (SELECT rule_id, "
    "session_start, max(last_ts) AS updated, sum(arrivals)::BIGINT AS arrivals, count(*) AS images FROM members GROUP BY ALL)"
)
_SENT = ("sent AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'box' ELSE 'scu' END AS destinationtype, user_id % 5 AS destinationid, "
         "event_id % 500 + event_id // 10000 * 500 AS image_id FROM events WHERE event_type = 'purchase')")
_HIT = (
    f"{_SENT}, hit AS (SELECT * FROM (SELECT x.destinationtype, x.destinationid, x.image_id, b.rule_id, b.session_start, row_number() OVER "
    "(PARTITION BY x.destinationtype, x.destinationid, x.image_id ORDER BY b.session_start, b.rule_id) AS rn FROM sent x JOIN "
    "fx_forwarding_rules r ON r.destinationtype = x.destinationtype AND r.destinationid = x.destinationid JOIN members b ON b.rule_id = "
    "r.rule_id AND b.image_id = x.image_id) WHERE rn = 1)"
)
_FLAGS = (
    f"{_BATCH}, {_HIT}, flags AS (SELECT t.*, (t.rule_id, t.session_start) IN (SELECT (rule_id, session_start) FROM hit) AS delivered FROM "
    f"tx t), state AS (SELECT *, updated < {NOW - IDLE} AND NOT delivered AS enroute FROM flags)"
)


def matched(fx: Fixtures):
    return W.match_rules(fx.image_added(), fx.forwarding_rules())


def members(fx: Fixtures):
    """Members are read by every later step, so they are written once."""
    return materialise(W.batches(matched(fx), IDLE), "members")


def sent_reports(fx: Fixtures, *keep: str):
    return fx.table("events").filter(F.col("event_type") == "purchase").select(
        F.when(F.col("event_id") % 2 == 0, "box").otherwise("scu").alias("destinationtype"),
        (F.col("user_id") % 5).alias("destinationid"), F.expr("event_id % 500 + event_id div 10000 * 500").alias("image_id"), *keep)


def state(fx: Fixtures, batch: DataFrame | None = None):
    batch = members(fx) if batch is None else batch
    hits = W.for_destination(fx.forwarding_rules(), batch, sent_reports(fx))
    return materialise(W.flags(W.transactions(batch), hits, NOW, IDLE), "transactions")


@query("forwarding_match", f"WITH {_MATCH} SELECT event_id, image_id, rule_id FROM m")
def forwarding_match(fx: Fixtures):
    return matched(fx).select("event_id", "image_id", "rule_id")


@query("forwarding_batches", f"WITH {_BATCH} SELECT * FROM tx")
def forwarding_batches(fx: Fixtures):
    return W.transactions(members(fx))


@query("forwarding_expired", f"WITH {_BATCH} SELECT b.rule_id AS rule_id, b.session_start AS session_start, b.image_id AS image_id FROM tx "
       f"JOIN members b ON b.rule_id = tx.rule_id AND b.session_start = tx.session_start WHERE tx.updated < {NOW - IDLE}")
def forwarding_expired(fx: Fixtures):
    batch = members(fx)
    due = W.expired(W.transactions(batch), NOW, IDLE).select(*W.KEY)
    return batch.join(due, W.KEY, "left_semi").select(*W.KEY, "image_id")


@query("transaction_for_destination", f"WITH {_BATCH}, {_HIT} SELECT destinationtype, destinationid, image_id, rule_id, session_start FROM hit")
def transaction_for_destination(fx: Fixtures):
    return W.for_destination(fx.forwarding_rules(), members(fx), sent_reports(fx))


@query("forwarding_delivered", f"WITH {_FLAGS} SELECT rule_id, session_start, delivered, enroute FROM state")
def forwarding_delivered(fx: Fixtures):
    return state(fx).select("rule_id", "session_start", "delivered", "enroute")


_CLOSED = (f"{_FLAGS}, k AS (SELECT s.*, r.sourcetype, r.sourceid, r.keep_images FROM state s JOIN fx_forwarding_rules r ON r.rule_id = "
           "s.rule_id WHERE r.rule_id <> 8)")


@query(
    "forwarding_deletes",
    f"WITH {_CLOSED} SELECT DISTINCT m.image_id AS image_id FROM k JOIN members m ON m.rule_id = k.rule_id AND m.session_start = "
    "k.session_start WHERE k.delivered AND NOT k.keep_images AND NOT EXISTS (SELECT 1 FROM k o WHERE o.sourcetype = k.sourcetype AND "
    "o.sourceid = k.sourceid AND NOT o.delivered)",
)
def forwarding_deletes(fx: Fixtures):
    """Images that the closing transactions allow to be deleted."""
    batch = members(fx)
    closed = W.finalise(state(fx, batch), fx.forwarding_rules().filter("rule_id <> 8"))
    return W.images_to_delete(closed, batch)


@query(
    "forwarding_finalize",
    f"WITH {_CLOSED} SELECT rule_id, session_start, CASE WHEN keep_images THEN 'remove' ELSE 'delete' END AS action FROM k "
    "WHERE delivered AND (keep_images OR NOT EXISTS (SELECT 1 FROM k o WHERE o.sourcetype = k.sourcetype AND o.sourceid = k.sourceid AND "
    "NOT o.delivered))",
)
def forwarding_finalize(fx: Fixtures):
    """Rule 8 has been removed meanwhile: its transactions are left alone."""
    return W.finalise(state(fx), fx.forwarding_rules().filter("rule_id <> 8"))


@query(
    "forwarding_route",
    f"WITH {_FLAGS} SELECT s.rule_id AS rule_id, s.session_start AS session_start, CASE WHEN r.destinationtype IN ('box', 'scu') THEN "
    "r.destinationtype ELSE 'unknown' END AS sink, NOT (r.destinationtype = 'scu' AND r.destinationid IN (SELECT s_suppkey FROM supplier "
    "WHERE s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = 7))) AS enroute FROM state s JOIN fx_forwarding_rules r ON "
    "r.rule_id = s.rule_id WHERE s.enroute",
)
def forwarding_route(fx: Fixtures):
    """Suppliers in the nation of supplier 7 are unreachable."""
    supplier = fx.table("supplier")
    dark = supplier.filter("s_suppkey = 7").select("s_nationkey")
    failed = supplier.join(dark, "s_nationkey", "left_semi").select(F.col("s_suppkey").alias("destinationid"))
    return W.route(state(fx), fx.forwarding_rules(), failed)


@query("rule_counts", "SELECT s.sourcetype AS sourcetype, s.sourceid AS sourceid, count(DISTINCT s.id) AS series_count, count(DISTINCT "
       "r.rule_id) AS rule_count, count(DISTINCT r.rule_id) > 0 AS has_rules FROM fx_series_sources s LEFT JOIN fx_forwarding_rules r ON "
       "r.sourcetype = s.sourcetype AND r.sourceid = s.sourceid GROUP BY ALL")
def rule_counts(fx: Fixtures):
    source = ["sourcetype", "sourceid"]
    series = fx.series_sources().groupBy(*source).agg(F.count(F.lit(1)).alias("series_count"))
    rules = fx.forwarding_rules().groupBy(*source).agg(F.count(F.lit(1)).alias("n"))
    count = F.coalesce("n", F.lit(0).cast("bigint"))
    return series.join(rules, source, "left").select(*source, "series_count", count.alias("rule_count"), (count > 0).alias("has_rules"))


@query(
    "activity_sessions",
    "WITH e AS (SELECT user_id, event_type, event_id, epoch_us(ts) // 1000 AS ts_ms FROM events), g AS (SELECT *, CASE WHEN ts_ms - "
    "lag(ts_ms) OVER w < 3600000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, event_id)), n AS "
    "(SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS nr FROM g) SELECT user_id, min(ts_ms) AS session_start, "
    "max(ts_ms) AS last_seen, count(*) AS actions FROM n GROUP BY user_id, nr",
)
def activity_sessions(fx: Fixtures):
    """A session refreshes on every action and ends after one hour of silence."""
    rows = fx.events().select("user_id", F.unix_millis("ts").alias("ts_ms"))
    placed = sessions(rows, ["user_id"], "ts_ms", V.HOUR_MS, V.DAY_MS)
    return placed.groupBy("user_id", "session_start").agg(F.max("ts_ms").alias("last_seen"), F.count(F.lit(1)).alias("actions"))

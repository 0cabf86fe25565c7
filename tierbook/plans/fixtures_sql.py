"""The same derived tables as SQL text, for the independent check in another engine."""

from __future__ import annotations

import re

from tierbook import schema as S
from tierbook.plans import fixture_values as V


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return f"CAST({value} AS BIGINT)"
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) v({columns})"


def _elements() -> str:
    entries = ", ".join(
        f"{{'path': '{p}', 'tag': {S.path_numbers(p)[-1]}::BIGINT, 'top': {S.path_numbers(p)[0]}::BIGINT, "
        f"'vr': '{vr}', 'val': {x}}}"
        for p, vr, x in V.ELEMENTS
    )
    return (
        "SELECT image_id, e.tag AS tag, e.path AS tag_path, e.top AS top_tag, e.vr AS vr, length(e.val)::BIGINT AS length, "
        "CASE WHEN e.vr = 'SQ' THEN '' ELSE e.val END AS val, series_id, study_id, patient_id, patientName, patientID, "
        "studyInstanceUID, seriesInstanceUID, sopInstanceUID "
        f"FROM (SELECT *, unnest([{entries}]) AS e FROM fx_flat_images) WHERE e.val IS NOT NULL"
    )


KIND = "(['user','box','scp','directory','import'])[({0} % 5 + 1)::INT]"

FX: dict[str, str] = {
    "fx_patients": "SELECT n_nationkey::BIGINT AS id, n_name AS patientName, n_nationkey::VARCHAR AS patientID, "
    "'' AS patientBirthDate, CASE WHEN n_regionkey % 2 = 0 THEN 'M' ELSE 'F' END AS patientSex FROM nation",
    "fx_studies": "SELECT c_custkey AS id, c_nationkey::BIGINT AS patient_ref, c_name AS studyInstanceUID, "
    "c_mktsegment AS studyDescription, '' AS studyDate, c_custkey::VARCHAR AS studyID, "
    "substr(md5(c_name), 1, 16) AS accessionNumber, '' AS patientAge FROM customer",
    "fx_series": "SELECT o_orderkey AS id, o_custkey AS study_ref, 'SE.' || o_orderkey AS seriesInstanceUID, "
    "o_orderpriority AS seriesDescription, strftime(o_orderdate, '%Y%m%d') AS seriesDate, o_orderstatus AS modality, "
    "'P' || (o_orderkey % 10) AS protocolName, 'B' || (o_orderkey % 4) AS bodyPartExamined, "
    "'M' || (o_custkey % 6) AS manufacturer, 'S' || (o_custkey % 12) AS stationName, "
    "'FR.' || o_custkey AS frameOfReferenceUID FROM orders",
    "fx_arrivals": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS series_ref, "
    "'SO.' || l_orderkey || '.' || l_linenumber AS sopInstanceUID, l_returnflag || '\\' || l_linestatus AS imageType, "
    "l_linenumber::VARCHAR AS instanceNumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, "
    "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, "
    "l_suppkey DESC, l_extendedprice DESC, l_returnflag DESC, l_linestatus DESC) AS recency, "
    "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, "
    "l_suppkey, l_extendedprice, l_returnflag, l_linestatus) AS turn FROM lineitem",
    "fx_images": "SELECT id, series_ref, sopInstanceUID, imageType, instanceNumber FROM fx_arrivals WHERE recency = 1",
    "fx_series_sources": f"SELECT o_orderkey AS id, {KIND.format('o_orderkey')} AS sourcetype, "
    f"{KIND.format('o_orderkey')} || (o_orderkey % 7) AS sourcename, o_orderkey % 7 AS sourceid FROM orders",
    "fx_series_tags": values(V.SERIES_TAG_NAMES, "id, name"),
    "fx_series_tag_links": "SELECT DISTINCT l_orderkey AS series_id, t.id AS tag_id FROM lineitem "
    "JOIN fx_series_tags t ON t.name = l_returnflag",
    "fx_series_types": values(V.SERIES_TYPE_NAMES, "id, name"),
    "fx_series_type_links": "SELECT DISTINCT l_orderkey AS series_id, t.id AS type_id FROM lineitem "
    "JOIN part ON p_partkey = l_partkey JOIN fx_series_types t ON t.name = p_type",
    "fx_flat_series": "SELECT s.id AS id, p.id AS patient_id, st.id AS study_id, p.* EXCLUDE (id), "
    "st.* EXCLUDE (id, patient_ref), s.* EXCLUDE (id, study_ref) FROM fx_series s "
    "JOIN fx_studies st ON st.id = s.study_ref JOIN fx_patients p ON p.id = st.patient_ref",
    "fx_flat_images": "SELECT i.id AS image_id, i.series_ref AS series_id, f.* EXCLUDE (id), i.sopInstanceUID, "
    "i.imageType, i.instanceNumber FROM fx_images i JOIN fx_flat_series f ON f.id = i.series_ref",
    "fx_elements": _elements(),
    "fx_rules": values(V.RULES, "type_id, rule_id"),
    "fx_rule_attributes": values(V.RULE_ATTRIBUTES, "rule_id, tag, sequence, expected"),
    "fx_nested_rules": values(V.NESTED_RULES, "type_id, rule_id"),
    "fx_nested_rule_attributes": values(V.NESTED_RULE_ATTRIBUTES, "rule_id, tag, sequence, expected"),
    "fx_tag_filters": values(V.TAG_FILTERS, "id, name, kind"),
    "fx_tag_filter_paths": values(V.TAG_FILTER_PATHS, "id, filter_id, path"),
    "fx_source_tag_filters": values(V.SOURCE_TAG_FILTERS, "sourcetype, sourceid, filter_id"),
    "fx_forwarding_rules": values(
        V.FORWARDING_RULES, "rule_id, sourcetype, sourceid, destinationtype, destinationid, keep_images"
    ),
    "fx_anon_keys": "SELECT image_id * 10 + g AS id, g AS created, image_id, patientName, "
    "'AN' || g || '.' || patientID AS anonPatientName, patientID, 'AI' || g || '.' || patientID AS anonPatientID, "
    "studyInstanceUID, 'AS' || g || '.' || studyID AS anonStudyInstanceUID, seriesInstanceUID, "
    "'AE' || g || '.' || seriesInstanceUID AS anonSeriesInstanceUID, sopInstanceUID, "
    "'AO' || g || '.' || sopInstanceUID AS anonSOPInstanceUID, studyDescription, protocolName, studyID "
    "FROM (SELECT *, unnest([1::BIGINT, 2::BIGINT]) AS g FROM fx_flat_images WHERE substr(md5(patientID), 1, 1) >= 'a' OR "
    "(imageType LIKE 'A%' AND studyDescription = 'FURNITURE' AND modality = 'F'))",
    "fx_anon_key_values": "SELECT key_id, v.tag_path AS tag_path, v.val AS value, 'anon ' || v.val AS anon_value FROM "
    "(SELECT id AS key_id, unnest([{'tag_path': '(0008,1030)', 'val': studyDescription}, "
    "{'tag_path': '(0020,0010)', 'val': studyID}, {'tag_path': '(0018,1030)', 'val': protocolName}]) AS v "
    "FROM fx_anon_keys WHERE created = 2)",
    "fx_log": "SELECT event_id AS id, epoch_us(ts) // 1000 AS created, CASE event_type WHEN 'error' THEN 'ERROR' "
    "WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO' ELSE 'DEFAULT' END AS entry_type, "
    "'user_' || user_id AS subject, props AS message FROM events",
    "fx_image_added": "SELECT event_id, event_id % 500 + event_id // 10000 * 500 AS image_id, epoch_us(ts) // 1000 AS ts_ms, "
    f"{KIND.format('user_id')} AS sourcetype, user_id % 7 AS sourceid FROM events",
    "fx_outgoing_images": "SELECT conv_id * 1000 + turn AS id, conv_id AS transaction_id, "
    "conv_id * 10 + turn % 7 + 1 AS image_id, turn + 1 AS sequence, role = 'user' AS sent, role FROM conversations",
    "fx_outgoing": "SELECT transaction_id AS id, transaction_id % 5 AS box_id, count(*) AS total, "
    "count(*) FILTER (WHERE sent) AS sent_count, transaction_id * 7 % 50 AS created, "
    f"{V.NOW_MS} - max(sequence) * 3000 - transaction_id % 3 AS updated, "
    "CASE WHEN bool_or(role = 'system') THEN 'FAILED' WHEN count(*) FILTER (WHERE sent) = 0 THEN 'WAITING' "
    "ELSE 'PROCESSING' END AS status FROM fx_outgoing_images GROUP BY transaction_id",
    "fx_incoming_events": "SELECT conv_id % 5 AS box_id, conv_id AS transaction_id, turn + 1 AS sequence, "
    "CASE WHEN role <> 'system' THEN conv_id * 10 + turn % 7 + 1 END AS image_id, role = 'user' AS added, "
    "CASE WHEN turn = 1 THEN 1::BIGINT ELSE count(*) OVER (PARTITION BY conv_id) + conv_id % 2 END AS total, (turn * 7 + conv_id) % 10 * 1000 + turn AS ts_ms FROM conversations",
    "fx_import_log": "SELECT series_ref % 20 AS session_id, id AS image_id, l_quantity = 50 AS rejected, turn, "
    "l_shipdate, l_partkey, l_suppkey, l_extendedprice, imageType, epoch_us(l_shipdate) // 1000 AS ts_ms FROM fx_arrivals",
    "fx_boxes": "SELECT r_regionkey::BIGINT AS id, r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'POLL' "
    "ELSE 'PUSH' END AS send_method FROM region",
}


def expand(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the derived tables it names, dependencies first."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name not in ordered and name in FX:
                need(FX[name])
                if name not in ordered:
                    ordered.append(name)

    need(sql)
    heads = [f"{name} AS ({FX[name]})" for name in ordered]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        heads.append(body[5:])
        return "WITH " + ",\n".join(heads) if ordered else body
    return "WITH " + ",\n".join(heads) + "\n" + body if heads else body

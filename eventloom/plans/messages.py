"""Message decoding, payload references, generic rows, dead letters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import json_fields as J
from ..functions.hashing import inline_reference
from ..operators import dead_letter as D
from ..operators import filters, generic
from ..operators import tables as T
from ..sources import messages, payload
from .inputs import AS_OF
from .normalizers import work_items
from .registry import CTES, query

_ENVELOPE_ERROR = """CASE "offset" % 13 WHEN 0 THEN 'message is not JSON' WHEN 1 THEN 'envelope must be a JSON object'
  WHEN 2 THEN 'envelope missing ''table'' field' WHEN 3 THEN 'envelope missing ''table'' field'
  WHEN 4 THEN 'envelope missing ''origin'' field' WHEN 5 THEN 'envelope missing ''destination'' field'
  WHEN 6 THEN 'envelope field ''data'' must be a JSON object' WHEN 7 THEN 'envelope missing ''data'' field' END"""
CTES["decoded"] = f"""
SELECT "offset", value, {_ENVELOPE_ERROR} AS error,
  CASE WHEN "offset" % 13 IN (0, 1, 2, 3, 4, 5, 6, 7) THEN NULL ELSE CASE "offset" % 3 WHEN 0 THEN 'devices' WHEN 1 THEN 'Devices' ELSE 'nosuch' END END AS tbl,
  CASE WHEN "offset" % 13 > 7 THEN CASE "offset" // 3 % 4 WHEN 0 THEN 'atheros-sensor' WHEN 1 THEN 'SSL-Proxy' WHEN 2 THEN 'atheros-search' ELSE 'intruder' END END AS origin
FROM v_envelopes"""


@query("envelope_decode", """
SELECT "offset", tbl AS "table", origin, CASE WHEN error IS NULL THEN 'warehouse' END AS destination, error FROM v_decoded""")
def _(t):
    return messages.envelope_decode(t.envelopes).select("offset", "table", "origin", "destination", "error")


def decoded(t):
    return D.dlq_split(messages.envelope_decode(t.envelopes))


_KNOWN = "'atheros-sensor', 'ssl-proxy', 'atheros-search'"


@query("filter_origin", f"""
SELECT "offset", origin FROM v_decoded WHERE error IS NULL AND lower(origin) IN ({_KNOWN})""")
def _(t):
    return filters.filter_origin(decoded(t)[0]).select("offset", "origin")


@query("context_columns", """
SELECT "offset", origin AS origin_system, 'warehouse' AS destination_system FROM v_decoded WHERE error IS NULL""")
def _(t):
    return generic.context_columns(decoded(t)[0]).select("offset", "origin_system", "destination_system")


_GROUP_ERROR = """CASE WHEN lower(tbl) <> 'devices' THEN 'unknown table ''' || tbl || ''''
  WHEN origin = 'intruder' THEN 'unknown origin ''intruder'' not in known origins: atheros-sensor, ssl-proxy, atheros-search' END"""


@query("dlq_batch_group", f"""
SELECT "offset", {_GROUP_ERROR} AS error FROM v_decoded WHERE error IS NULL""")
def _(t):
    return D.dlq_batch_group(decoded(t)[0], ["devices"]).select("offset", "error")


CTES["device_rows"] = """
SELECT d."offset", printf('02:00:%02x:%02x:%02x:%02x', c // 16777216 % 256, c // 65536 % 256, c // 256 % 256, c % 256) AS mac_id,
  o.o_orderpriority AS display_name, CASE WHEN d."offset" % 2 <> 0 THEN 'u' || o.o_custkey END AS username,
  (d."offset")::varchar AS hostname, '{"k":' || (d."offset" % 4) || '}' AS notes, date_trunc('second', o.o_orderdate) AS last_seen
FROM v_decoded d JOIN (SELECT *, o_custkey % 60 AS c FROM orders) o ON o.o_orderkey = d."offset" WHERE d.error IS NULL"""

DEVICE_COLUMNS = "MAC_ID string, wg_pubkey string, display_name string, username string, hostname string, notes string, last_seen timestamp_ntz"


@query("generic_project", """
SELECT "offset", mac_id AS "MAC_ID", NULL::varchar AS wg_pubkey, display_name, username, hostname, notes, last_seen FROM v_device_rows""")
def _(t):
    return generic.generic_project(decoded(t)[0], ST.StructType.fromDDL(DEVICE_COLUMNS), ("offset",))


@query("upsert_generic", """
SELECT mac_id, r.display_name AS display_name, r.username AS username, r.hostname AS hostname, r.notes AS notes, r.last_seen AS last_seen FROM (
  SELECT mac_id, arg_max({'display_name': display_name, 'username': username, 'hostname': hostname, 'notes': notes, 'last_seen': last_seen}, p) AS r
  FROM (SELECT mac_id, display_name, username, hostname, notes, last_seen, "offset" AS p FROM v_device_rows
        UNION ALL BY NAME SELECT mac_id, username, display_name, hostname, last_seen, -1 AS p FROM v_devices) GROUP BY mac_id)""")
def _(t):
    schema = ST.StructType.fromDDL("mac_id string, display_name string, username string, hostname string, notes string, last_seen timestamp_ntz")
    rows = generic.generic_project(decoded(t)[0], schema, ("offset",))
    stored = t.devices.withColumn("notes", F.lit(None).cast("string")).select(*schema.fieldNames())
    return T.upsert_generic(stored, rows, ["mac_id"], ["offset"])


@query("infer_colvalue", """
SELECT "offset", f.name AS field, f.tag AS tag FROM v_decoded, (VALUES ('MAC_ID', 'str'), ('display_name', 'str'), ('username', 'str'), ('hostname', 'long'),
  ('notes', 'json'), ('last_seen', 'str'), ('ratio', 'decimal'), ('flag', 'bool'), ('surplus', 'json')) AS f(name, tag)
WHERE error IS NULL AND NOT (f.name = 'username' AND "offset" % 2 = 0)
UNION ALL SELECT "offset", 'username', 'null' FROM v_decoded WHERE error IS NULL AND "offset" % 2 = 0""")
def _(t):
    return generic.infer_tags(decoded(t)[0].select("offset", "data")).select("offset", "field", "tag")


_ITEM_ERROR = """CASE "offset" % 11 WHEN 0 THEN 'message is not JSON' WHEN 1 THEN 'work item needs string ''job_id'''
  WHEN 2 THEN 'work item needs string ''batch_id''' ELSE CASE WHEN "offset" % 4 = 2 THEN 'work item needs integer ''batch_no''' END END"""


@query("load_decode", f"""
SELECT "offset", CASE WHEN "offset" % 11 NOT IN (0, 1) THEN 'j' || o_custkey END AS job_id, CASE WHEN "offset" % 11 NOT IN (0, 2) THEN 'b' || "offset" END AS batch_id,
  CASE WHEN "offset" % 11 <> 0 AND "offset" % 4 = 1 THEN ("offset" % 7)::int END AS batch_no,
  CASE WHEN "offset" % 11 <> 0 AND "offset" % 5 <> 0 THEN ("offset" % 6)::int ELSE 0 END AS attempt, {_ITEM_ERROR} AS error
FROM v_work_items JOIN orders ON o_orderkey = "offset" """)
def _(t):
    return messages.load_decode(t.work_items).select("offset", "job_id", "batch_id", "batch_no", "attempt", "error")


@query("target_route", """
SELECT "offset", stream_name, CASE WHEN stream_name = 'wireless.rogue_ap' THEN 'wireless.alert.rogue_ap' WHEN stream_name <> 'unknown.stream' THEN stream_name END AS target,
  CASE WHEN stream_name = 'unknown.stream' THEN 'unsupported stream_name unknown.stream' END AS route_error FROM (
  SELECT "offset", CASE WHEN "offset" % 11 <> 0 THEN ['proxy.events', 'wireless.audit', 'audit.wireless.bandwidth', 'proxy.payload_audit', 'wireless.probe.flush',
    'wireless.rogue_ap', 'unknown.stream']["offset" % 7 + 1] END AS stream_name FROM v_work_items)""")
def _(t):
    routed = messages.target_route(messages.load_decode(t.work_items))
    return routed.select("offset", "stream_name", "target", "route_error")


_AUDIT_ERROR = """CASE event_id % 17 WHEN 1 THEN 'message is not JSON' WHEN 2 THEN 'field ''observed_at'' must be a string'
  WHEN 3 THEN 'field ''observed_at'' must be a string' WHEN 4 THEN 'field ''host'' has the wrong type'
  WHEN 5 THEN 'field ''query_keys'' has the wrong type' WHEN 6 THEN 'field ''body_bytes_original'' has the wrong type'
  WHEN 7 THEN 'field ''truncated'' has the wrong type' WHEN 0 THEN 'message is not JSON' END"""


@query("audit_parse", f"""
SELECT event_id AS "offset", CASE WHEN event_id % 17 NOT IN (0, 1, 4) THEN 'h' || user_id END AS host,
  CASE WHEN event_id % 17 NOT IN (0, 1) THEN event_type END AS method,
  CASE WHEN event_id % 17 NOT IN (0, 1) THEN replace(props, ' ', '') END AS body,
  CASE WHEN event_id % 17 NOT IN (0, 1, 6) THEN event_id::int END AS body_bytes_original,
  CASE WHEN event_id % 17 NOT IN (0, 1, 7) AND event_id % 3 = 0 THEN true END AS truncated, {_AUDIT_ERROR} AS error FROM events""")
def _(t):
    return messages.audit_parse(t.audits).select("offset", "host", "method", "body", "body_bytes_original", "truncated", "error")


CTES["audit_good"] = """
SELECT a."offset", a.value, replace(ts::varchar, ' ', 'T') || 'Z' AS observed_text,
  'inline://json/' || rtrim(translate(to_base64(encode(a.value)), '+/', '-_'), '=') AS payload_ref, sha256(a.value) AS payload_sha256,
  sha256('proxy.payload_audit:' || sha256(a.value)) AS dedupe_key, CASE WHEN event_id % 4 = 0 THEN 'http' END AS event_kind
FROM v_audits a JOIN events ON event_id = a."offset" WHERE event_id % 17 > 7"""


@query("scan_requests", "SELECT * EXCLUDE (value) FROM v_audit_good")
def _(t):
    good, _ = D.dlq_split(messages.scan_requests(t.audits))
    return good.select("offset", "observed_text", "payload_ref", "payload_sha256", "dedupe_key", "event_kind")


@query("scan_request_json", """
SELECT "offset", json_object('stream_name', 'proxy.payload_audit', 'dedupe_key', dedupe_key, 'payload_ref', payload_ref,
  'observed_at', observed_text)::varchar AS request_json FROM v_audit_good""")
def _(t):
    good, _ = D.dlq_split(messages.scan_requests(t.audits))
    return good.select("offset", messages.request_json(good).alias("request_json"))


@query("dlq_split", """
SELECT 'good' AS side, count(*) AS n FROM events WHERE event_id % 17 > 7
UNION ALL SELECT 'bad', count(*) FROM events WHERE event_id % 17 BETWEEN 1 AND 7""")
def _(t):
    good, bad = D.dlq_split(messages.scan_requests(t.audits))
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return count(good, "good").unionByName(count(bad, "bad"))


@query("dlq_audit", f"""
SELECT event_id AS "offset", '{{"original":' || CASE WHEN event_id % 17 = 1 THEN '"no json"' ELSE a.value END || ',"error":' ||
  to_json({_AUDIT_ERROR})::varchar || '}}' AS value FROM events JOIN v_audits a ON a."offset" = event_id WHERE event_id % 17 BETWEEN 1 AND 7""")
def _(t):
    _, bad = D.dlq_split(messages.audit_parse(t.audits))
    return bad.select("offset", D.dlq_audit().alias("value")).filter(F.col("value").isNotNull())


@query("dlq_documents", """
SELECT doc_id, '{"original":' || to_json(text)::varchar || ',"error":"message is not JSON"}' AS value FROM documents""")
def _(t):
    """Whole documents are not messages: each one becomes a dead letter with its full text."""
    texts = t.documents.select("doc_id", "text")
    _, bad = D.dlq_split(messages.audit_parse(texts, "text"))
    return bad.select("doc_id", D.dlq_audit("text").alias("value"))


@query("dlq_load", f"""
SELECT "offset", '{{"original":' || CASE WHEN "offset" % 11 = 0 THEN '"' || value || '"' ELSE value END || ',"error":' || to_json({_ITEM_ERROR})::varchar || '}}' AS value
FROM v_work_items WHERE {_ITEM_ERROR} IS NOT NULL""")
def _(t):
    _, bad = D.dlq_split(messages.load_decode(t.work_items))
    return bad.select("offset", D.dlq_load().alias("value"))


@query("dlq_decode", """
SELECT "offset", json_object('table', 'sync.rows', 'origin', 'unknown', 'destination', 'unknown', 'error', error, 'timestamp', '2024-01-31T00:00:00Z',
  'row', '{}'::json)::varchar AS value FROM v_decoded WHERE error IS NOT NULL""")
def _(t):
    _, bad = decoded(t)
    return bad.select("offset", D.dlq_decode(bad, AS_OF).alias("value"))


@query("dlq_generic", f"""
SELECT "offset", '{{"table":"' || tbl || '","origin":"' || origin || '","destination":"warehouse","error":' || to_json(e)::varchar
  || ',"timestamp":"2024-01-31T00:00:00Z","row":{{"MAC_ID":"' || mac_id || '","display_name":"' || display_name || '","flag":true,"hostname":' || "offset"
  || ',"last_seen":"' || seen || '","notes":' || notes || ',"ratio":1.5,"surplus":[],"username":' || coalesce('"' || username || '"', 'null') || '}}}}' AS value
FROM (SELECT d."offset", tbl, origin, {_GROUP_ERROR} AS e, r.mac_id, r.display_name, r.username, r.notes,
        replace(o.o_orderdate::varchar, ' ', 'T') || 'Z' AS seen
      FROM v_decoded d JOIN v_device_rows r ON r."offset" = d."offset" JOIN orders o ON o.o_orderkey = d."offset")
WHERE e IS NOT NULL""")
def _(t):
    _, bad = D.dlq_split(D.dlq_batch_group(decoded(t)[0], ["devices"]))
    return bad.select("offset", D.dlq_generic(bad, AS_OF).alias("value"))


@query("dlq_probe", """
SELECT request_id, json_object('original', value, 'error', 'no probes in message', 'operation', 'flush_probe_batch')::varchar AS value FROM v_requests""")
def _(t):
    failed = t.requests.withColumns({"error": F.lit("no probes in message"), "operation": F.lit("flush_probe_batch")})
    return failed.select("request_id", D.dlq_probe().alias("value"))


# --- payload references -----------------------------------------------------

CTES["refs"] = """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'inline://json/' || rtrim(translate(to_base64(encode(props)), '+/', '-_'), '=')
    WHEN 1 THEN 'inline://json/' || translate(to_base64(encode(props)), '+/', '-_') WHEN 2 THEN 'inline://json/bm90IGpzb24'
    WHEN 3 THEN 'inline://json/bnVsbA' WHEN 4 THEN 'inline://json/a+b' ELSE 's3://bucket/' || event_id END AS payload_ref, props FROM events"""


def refs(t):
    e = t.events.select("event_id", "props")
    n = F.col("event_id") % 6
    padded = F.translate(F.base64(F.col("props").cast("binary")), "+/", "-_")
    ref = (
        F.when(n == 0, inline_reference(F.col("props")))
        .when(n == 1, F.concat(F.lit("inline://json/"), padded))
        .when(n == 2, "inline://json/bm90IGpzb24")
        .when(n == 3, "inline://json/bnVsbA")
        .when(n == 4, "inline://json/a+b")
        .otherwise(F.concat(F.lit("s3://bucket/"), "event_id"))
    )
    return e.select("event_id", ref.alias("payload_ref"))


@query("payload_inline", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN 'not json' WHEN 3 THEN 'null' END AS payload,
  CASE event_id % 6 WHEN 2 THEN 'payload_ref resolved non-JSON payload' WHEN 3 THEN 'payload_ref resolved an empty JSON payload'
    WHEN 4 THEN 'payload_ref is not valid base64' WHEN 5 THEN 'unsupported payload_ref scheme: s3://bucket/' || event_id END AS payload_error FROM events""")
def _(t):
    return payload.payload_inline(refs(t)).select("event_id", "payload", "payload_error")


@query("payload_rows", """
SELECT 'b' || (event_id // 100) AS batch_id, event_id % 100 AS pos, row_json AS raw FROM v_rows_wireless_alert_deauth_flood""")
def _(t):
    resolved = payload.payload_inline(work_items(t, "wireless.alert.deauth_flood"))
    return payload.payload_rows(resolved).select("batch_id", F.col("pos").cast("bigint").alias("pos"), "raw")


@query("payload_rows_single", """
SELECT event_id, 0 AS pos, replace(props, ' ', '') AS raw FROM events WHERE event_id % 6 < 2""")
def _(t):
    resolved = payload.payload_inline(refs(t))
    good = resolved.filter(F.col("payload_error").isNull())
    return payload.payload_rows(good).select("event_id", "pos", "raw")


@query("payload_rows_probes", """
SELECT 'b' || (event_id // 100) AS batch_id, event_id % 100 AS pos, 'c' || user_id AS client_mac FROM events""")
def _(t):
    rows = payload.payload_rows_probes(payload.payload_inline(work_items(t, "wireless.probe.flush")))
    return rows.select("batch_id", F.col("pos").cast("bigint").alias("pos"), J.string_value(F.col("row"), "client_mac").alias("client_mac"))


@query("client_inventory_merge", """
SELECT 'b' || (event_id // 100) AS batch_id, event_id % 100 AS pos, 'sensor-of-b' || (event_id // 100) AS sensor_id, 'hall' AS location_id,
  '2024-02-01T00:00:00+01:00' AS snapshot_at FROM events""")
def _(t):
    rows = payload.client_inventory_merge(payload.payload_inline(work_items(t, "wireless.client.inventory")))
    head = F.col("head")
    return rows.select(
        "batch_id",
        F.col("pos").cast("bigint").alias("pos"),
        *[J.string_value(head, n).alias(n) for n in ("sensor_id", "location_id", "snapshot_at")],
    )


@query("rows_error", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'wireless probe payload must contain a probes array'
  WHEN 1 THEN 'wireless probe payload: ''probes'' must be an array' END AS error FROM events""")
def _(t):
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, F.col("props")).when(kind == 1, '{"probes": 5}').otherwise('{"probes": []}')
    parsed = J.with_parsed(t.events.select("event_id", text.alias("payload")), F.col("payload"), "document")
    return parsed.select("event_id", payload.rows_error(F.lit("wireless.probe.flush"), F.col("document")).alias("error"))


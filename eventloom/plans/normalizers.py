"""Payloads built from the events table, resolved, exploded and normalised per target.

Events are grouped into batches of one hundred; each batch is one work item whose
payload is the JSON array (or object) of its events, encoded inline.  Some rows
lack a required field or carry a time without an offset; the oracles compute the
typed columns straight from the events table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import json_fields as J
from ..functions.hashing import inline_reference
from ..operators import alerts
from ..operators import normalize as N
from ..sources import messages, payload
from .inputs import AS_OF, CENTS, VIEWS, iso, obj, q
from .registry import CTES, query

_NUM = lambda e: f"cast({e} AS string)"
_FLAG = "CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '1' WHEN 3 THEN '0' END"
_FLAG_SQL = "(CASE WHEN event_id % 5 IN (0, 2) THEN 1 ELSE 0 END)::bigint"
# every 31st row has a time without an offset, every 29th lacks a required text
_TIME = f"CASE WHEN event_id % 31 = 0 THEN replace(cast(ts AS string), ' ', 'T') ELSE {iso('ts')} END"
_BAD = "(event_id % 31 = 0 OR event_id % 29 = 0)"
_NAKED = "replace(ts::varchar, ' ', 'T')"


def _required(expr: str) -> str:
    return f"CASE WHEN event_id % 29 <> 0 THEN {q(expr)} END"


def _every(n: int, expr: str) -> str:
    return f"CASE WHEN event_id % {n} = 0 THEN {expr} END"


_BLOCK_METRICS = obj(
    blocked_bytes=_every(3, _NUM("event_id % 500")),
    total_blocked_bytes_approx=_every(4, _NUM("event_id % 900")),
    frequency_hz="'0.' || (event_id % 9 + 1)",
    consecutive_blocks=_every(5, _NUM("event_id % 11")),
    attempt_count=_every(7, _NUM("event_id % 13")),
)

ROWS = {
    "proxy.events": obj(
        type=_required("event_type"),
        host=q("'h' || user_id"),
        time=q(_TIME),
        peer_ip="CASE WHEN event_id % 4 = 0 THEN '\"\"' WHEN event_id % 4 = 1 THEN '7' ELSE " + q("'10.0.0.' || (event_id % 99)") + " END",
        bytes_up=_every(2, f"cast({CENTS} AS string)"),
        bytes_down="CASE event_id % 6 WHEN 0 THEN '12.0' WHEN 1 THEN '1.5' WHEN 2 THEN '\"15\"' WHEN 3 THEN 'true' END",
        status_code=_every(3, _NUM("200 + event_id % 300")),
        blocked=_FLAG,
        verdict=_every(3, q("'V' || (event_id % 4)")),
        blocked_bytes=_every(10, _NUM("event_id % 70")),
        metrics=_BLOCK_METRICS,
        fingerprint=_every(3, obj(tls_ver=q("'1.3'"), alpn=_every(2, q("'h2'")))),
        reason=_every(9, q("event_type")),
    ),
    "proxy.payload_audit": obj(
        correlation_id=_every(2, q("'c-' || event_id")),
        host=_required("'h' || user_id"),
        direction="CASE event_id % 3 WHEN 0 THEN '\"down\"' WHEN 1 THEN '\"\"' END",
        observed_at=q(_TIME),
        byte_offset=_every(4, _NUM("event_id")),
        method=q("event_type"),
        http_status="CASE WHEN event_id % 3 = 0 THEN '404' END",
        status_code=_NUM("200 + event_id % 7"),
        path=q("'/p/' || event_id"),
        is_encrypted=_FLAG,
    ),
    "wireless.audit": obj(
        event_type=q("event_type"),
        observed_at=q(_TIME),
        sensor_id=_required("'s' || (user_id % 10)"),
        location_id=q("'l' || (user_id % 7)"),
        interface=q("'wlan0'"),
        channel=_NUM("1 + event_id % 40"),
        frame_subtype=q("'beacon'"),
        source_mac=q("'m' || user_id"),
        ssid=_every(2, q("'net' || user_id")),
        signal_dbm=_NUM("-80 + event_id % 50"),
        raw_len=_NUM("event_id % 1500"),
        retry=_FLAG,
        protected="'true'",
        security_flags=_every(3, _NUM("event_id % 8")),
        tags="CASE event_id % 4 WHEN 0 THEN '[\"a\", \"b\"]' WHEN 1 THEN '\"a\"' WHEN 2 THEN '[{\"z\":1,\"a\":2}]' END",
        anomaly_reasons="'[]'",
        reg_domain=_every(2, q("'US'")),
    ),
    "audit.wireless.bandwidth": obj(
        schema_version=_every(2, "'2'"),
        window_start=q("CASE WHEN event_id % 31 = 0 THEN replace(cast(ts AS string), ' ', 'T') ELSE replace(cast(ts AS string), ' ', 'T') || '+02:00' END"),
        window_end=q(iso("ts")),
        sensor_id=_required("'s' || (user_id % 10)"),
        location_id=q("'l' || (user_id % 7)"),
        interface=q("'wlan0'"),
        channel=_NUM("1 + event_id % 40"),
        source_mac=q("'m' || user_id"),
        destination_bssid=q("'b' || (event_id % 11)"),
        bytes=f"cast({CENTS} AS string)",
        frame_count=_NUM("event_id % 100"),
        retry_count=_every(2, _NUM("event_id % 9")),
        frame_size_histogram=_every(3, obj(under_100=_NUM("event_id % 5"), range_500_1000=_NUM("event_id % 6"))),
        threshold_exceeded=_FLAG,
        published_at=_every(2, q(iso("ts"))),
    ),
    "wireless.alert.rogue_ap": obj(
        detected_at=_every(2, q(_TIME)),
        observed_at=q(_TIME),
        sensor_id=_required("'s' || (user_id % 10)"),
        location_id=q("'l' || (user_id % 7)"),
        interface=q("'wlan0'"),
        channel=_NUM("1 + event_id % 40"),
        rogue_bssid=_every(3, q("'r' || (event_id % 11)")),
        bssid=q("'b' || (event_id % 11)"),
        signal_dbm=_NUM("-80 + event_id % 50"),
        ssid_impersonation=_every(7, "'true'"),
        reasons="CASE event_id % 4 WHEN 0 THEN '[\"other\",\"bssid_spoofing\"]' WHEN 1 THEN '[\"other\",1]' WHEN 2 THEN '\"bssid_spoofing\"' END",
    ),
    "wireless.alert.deauth_flood": obj(
        observed_at=q(_TIME),
        sensor_id=_required("'s' || (user_id % 10)"),
        location_id=q("'l' || (user_id % 7)"),
        interface=q("'wlan0'"),
        channel=_every(2, _NUM("1 + event_id % 40")),
        attacker_mac=_every(3, q("'a' || user_id")),
        source_mac=_every(2, q("'m' || user_id")),
        target_bssid=_every(2, q("'t' || (event_id % 11)")),
        bssid=q("'b' || (event_id % 11)"),
        ssid=_every(2, q("'net' || user_id")),
        frame_count=_NUM("event_id % 100"),
        window_secs="'10'",
        threshold=_every(2, "'30'"),
    ),
    "wireless.alert.signal_anomaly": obj(
        detected_at=q(_TIME),
        sensor_id=_required("'s' || (user_id % 10)"),
        location_id=q("'l' || (user_id % 7)"),
        source_mac=q("'m' || user_id"),
        ssid=_every(2, q("'net' || user_id")),
        channel=_NUM("1 + event_id % 40"),
        baseline_dbm="'-50'",
        observed_dbm=_NUM("-80 + event_id % 50"),
        dbm_delta=_NUM("-30 + event_id % 50"),
        configured_delta="'20'",
    ),
    "wireless.alert.pmf_attack": obj(
        detected_at=q(_TIME),
        sensor_id=_required("'s' || (user_id % 10)"),
        location_id=q("'l' || (user_id % 7)"),
        target_mac=_every(2, q("'t' || user_id")),
        source_mac=q("'m' || user_id"),
        bssid=_every(3, q("'b' || (event_id % 11)")),
        channel=_every(2, _NUM("1 + event_id % 40")),
        attack_tag=q("event_type"),
        reconnect_window_ms=_every(2, _NUM("event_id % 1000")),
    ),
    "wireless.client.inventory": obj(
        sensor_id=q("'own'"),
        snapshot_at=q("'2020-01-01T00:00:00Z'"),
        client_mac=_every(2, q("'c' || user_id")),
        source_mac=_required("'m' || user_id"),
        ssid=_every(2, q("'net' || user_id")),
        last_seen=q(_TIME),
        first_seen=q(iso("ts")),
        last_signal_dbm=_NUM("-80 + event_id % 50"),
        is_authorized=_FLAG,
    ),
    "wireless.probe.flush": obj(
        client_mac=q("'c' || user_id"),
        ssid=_required("'net' || user_id"),
        known_bssid=_every(2, q("'b' || (event_id % 11)")),
        first_seen=q(_TIME),
        last_seen=q(iso("ts")),
        probe_count=_NUM("event_id % 20"),
    ),
}
for _target, _json in ROWS.items():
    VIEWS["rows_" + _target.replace(".", "_")] = (
        "events",
        {"event_id": "event_id", "batch_id": "'b' || (event_id DIV 100)", "row_json": _json},
        None,
    )


def target_payload(target: str, batch: Column) -> Column:
    """Aggregate of rows ``(event_id, row_json)``: the payload text that carries them to ``target``."""
    listed = F.array_sort(F.collect_list(F.struct("event_id", "row_json")))
    array = F.concat(F.lit("["), F.array_join(F.transform(listed, lambda r: r["row_json"]), ","), F.lit("]"))
    if target == "wireless.probe.flush":
        return F.concat(F.lit('{"probes":'), array, F.lit("}"))
    if target == "wireless.client.inventory":
        head = F.concat(F.lit('{"sensor_id":"sensor-of-'), batch, F.lit('","location_id":"hall","observed_at":"2024-02-01T00:00:00+01:00","clients":'))
        return F.concat(head, array, F.lit("}"))
    return array


def work_items(t, target: str) -> DataFrame:
    """One work item per batch, with its payload encoded in the reference."""
    rows = getattr(t, "rows_" + target.replace(".", "_"))
    items = rows.groupBy("batch_id").agg(target_payload(target, F.col("batch_id")).alias("_payload"))
    return items.select("batch_id", F.lit(target).alias("stream_name"), inline_reference(F.col("_payload")).alias("payload_ref"))


def normalized(t, target: str) -> DataFrame:
    resolved = payload.resolve_payload(messages.target_route(work_items(t, target)))
    good = resolved.filter(F.col("payload_error").isNull())
    return N.normalize(payload.rows_for_target(good, target), target)


_KEY = "'b' || (event_id // 100) AS batch_id, event_id % 100 AS row_sequence"
_TAIL = f"FROM events WHERE NOT {_BAD}"

_UP = "CASE WHEN event_id % 2 = 0 THEN floor(value * 100)::bigint ELSE 0 END"
_DOWN = "(CASE event_id % 6 WHEN 0 THEN 12 WHEN 2 THEN 15 ELSE 0 END)::bigint"


@query("normalize_proxy_events", f"""
SELECT 'b' || (event_id // 100) AS batch_id, event_id % 100 + 1 AS row_sequence, ts AS event_time, date_trunc('millisecond', ts) AS event_timestamp_utc,
  event_type, 'h' || user_id AS host, CASE WHEN event_id % 4 >= 2 THEN '10.0.0.' || (event_id % 99) END AS peer_ip, NULL::varchar AS wg_pubkey,
  NULL::varchar AS device_id, 'unknown' AS identity_source, NULL::varchar AS peer_hostname, NULL::varchar AS client_ua, {_UP} AS bytes_up,
  {_DOWN} AS bytes_down, CASE WHEN event_id % 3 = 0 THEN 200 + event_id % 300 END AS status_code, {_FLAG_SQL} AS blocked,
  NULL::varchar AS obfuscation_profile, NULL::varchar AS correlation_id, NULL::varchar AS parent_event_id, NULL::bigint AS event_sequence,
  NULL::bigint AS duration_ms, CASE WHEN event_id % 9 = 0 THEN event_type END AS reason, r.row_json AS raw_json
FROM events JOIN (SELECT event_id AS id, row_json FROM v_rows_proxy_events) r ON r.id = event_id WHERE NOT {_BAD}""")
def _(t):
    return N.valid_rows(normalized(t, "proxy.events")).drop("row")


@query("extract_blocked", f"""
SELECT {_KEY}, 'h' || user_id AS host, ts AS event_time,
  CASE WHEN event_id % 10 = 0 THEN event_id % 70 WHEN event_id % 3 = 0 THEN event_id % 500 WHEN event_id % 4 = 0 THEN event_id % 900
    ELSE {_UP} + {_DOWN} END AS blocked_bytes,
  ('0.' || (event_id % 9 + 1))::double AS frequency_hz, NULL::double AS risk_score, NULL::varchar AS category,
  CASE WHEN event_id % 3 = 0 THEN 'V' || (event_id % 4) ELSE 'BLOCKED' END AS verdict, 0::bigint AS tarpit_held_ms, NULL::bigint AS iat_ms,
  CASE WHEN event_id % 5 = 0 THEN event_id % 11 WHEN event_id % 7 = 0 THEN event_id % 13 END AS consecutive_blocks,
  NULL::varchar AS last_verdict, CASE WHEN event_id % 3 = 0 THEN '1.3' END AS tls_ver, CASE WHEN event_id % 6 = 0 THEN 'h2' END AS alpn,
  NULL::varchar AS ja3_lite, NULL::varchar AS resolved_ip, NULL::varchar AS asn_org
{_TAIL} AND event_id % 5 IN (0, 2)""")
def _(t):
    return N.valid_rows(N.extract_blocked(normalized(t, "proxy.events")))


_UUID = """(CASE WHEN m IS NOT NULL THEN substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-3' || substr(m, 14, 3) || '-'
  || translate(substr(m, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(m, 18, 3) || '-' || substr(m, 21, 12) END)"""


@query("normalize_payload_audit", f"""
SELECT {_KEY}, CASE WHEN event_id % 2 = 0 THEN 'c-' || event_id ELSE {_UUID} END AS correlation_id, 'h' || user_id AS host,
  CASE WHEN event_id % 3 = 0 THEN 'DOWN' ELSE 'UP' END AS direction, ts AS captured_at, CASE WHEN event_id % 4 = 0 THEN event_id ELSE 0 END AS byte_offset,
  NULL::varchar AS payload_object_key, NULL::varchar AS content_type, event_type AS http_method,
  CASE WHEN event_id % 3 = 0 THEN 404 ELSE 200 + event_id % 7 END AS http_status, '/p/' || event_id AS http_path, {_FLAG_SQL} AS is_encrypted,
  0::bigint AS truncated, NULL::varchar AS peer_ip, NULL::varchar AS notes
FROM events JOIN (SELECT event_id AS id, md5(row_json) AS m FROM v_rows_proxy_payload_audit) r ON r.id = event_id WHERE NOT {_BAD}""")
def _(t):
    return N.valid_rows(normalized(t, "proxy.payload_audit"))


@query("normalize_audit_frames", f"""
SELECT {_KEY}, event_type, ts AS observed_at, 's' || (user_id % 10) AS sensor_id, 'l' || (user_id % 7) AS location_id, 'wlan0' AS interface,
  1 + event_id % 40::bigint AS channel, CASE WHEN event_id % 40 < 14 THEN '2.4GHz' ELSE '5GHz' END AS band, NULL::varchar AS frame_type, 'beacon' AS frame_subtype,
  NULL::varchar AS bssid, 'm' || user_id AS source_mac, NULL::varchar AS destination_mac, NULL::varchar AS transmitter_mac,
  NULL::varchar AS receiver_mac, NULL::varchar AS destination_bssid, CASE WHEN event_id % 2 = 0 THEN 'net' || user_id END AS ssid,
  -80 + event_id % 50::bigint AS signal_dbm, NULL::bigint AS sequence_number, event_id % 1500::bigint AS raw_len, {_FLAG_SQL} AS is_retry, 0::bigint AS is_more_data,
  0::bigint AS is_power_save, 1::bigint AS is_protected, 0::bigint AS is_to_ds, 0::bigint AS is_from_ds, 0::bigint AS is_handshake,
  CASE WHEN event_id % 3 = 0 THEN event_id % 8 ELSE 0 END AS security_flags, NULL::varchar AS device_id, NULL::varchar AS username,
  'unknown' AS identity_source, CASE event_id % 4 WHEN 0 THEN '["a","b"]' WHEN 2 THEN '[{{"z":1,"a":2}}]' END AS tags, '[]' AS anomaly_reasons,
  replace(r.row_json, '", "', '","') AS raw_json, CASE WHEN event_id % 2 = 0 THEN 'US' END AS reg_domain
FROM events JOIN (SELECT event_id AS id, row_json FROM v_rows_wireless_audit) r ON r.id = event_id WHERE NOT {_BAD}""")
def _(t):
    return N.valid_rows(normalized(t, "wireless.audit"))


@query("normalize_bandwidth", f"""
SELECT {_KEY}, (CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END)::bigint AS schema_version, ts - to_seconds(7200) AS window_start, ts AS window_end,
  's' || (user_id % 10) AS sensor_id, 'l' || (user_id % 7) AS location_id, 'wlan0' AS interface, 1 + event_id % 40::bigint AS channel,
  CASE WHEN event_id % 40 < 14 THEN '2.4GHz' ELSE '5GHz' END AS band, 'm' || user_id AS source_mac, 'b' || (event_id % 11) AS destination_bssid,
  NULL::varchar AS ssid, floor(value * 100)::bigint AS bytes, event_id % 100::bigint AS frame_count,
  CASE WHEN event_id % 2 = 0 THEN event_id % 9 ELSE 0 END AS retry_count, 0::bigint AS more_data_count, 0::bigint AS power_save_count,
  NULL::bigint AS strongest_signal_dbm, CASE WHEN event_id % 3 = 0 THEN event_id % 5 ELSE 0 END AS hist_under_100, 0::bigint AS hist_100_500,
  CASE WHEN event_id % 3 = 0 THEN event_id % 6 ELSE 0 END AS hist_500_1000, 0::bigint AS hist_1000_1500, NULL::bigint AS inter_arrival_p50_ms,
  0::bigint AS external_bssid, {_FLAG_SQL} AS threshold_exceeded, NULL::bigint AS wall_clock_delta_ms, 0::bigint AS window_is_partial,
  CASE WHEN event_id % 2 = 0 THEN ts END AS published_at, ts::date AS local_day {_TAIL}""")
def _(t):
    return N.valid_rows(normalized(t, "audit.wireless.bandwidth"))


CTES["rogue"] = f"""
SELECT {_KEY}, ts AS detected_at, 's' || (user_id % 10) AS sensor_id, 'l' || (user_id % 7) AS location_id, 'wlan0' AS interface,
  1 + event_id % 40::bigint AS channel, CASE WHEN event_id % 3 = 0 THEN 'r' ELSE 'b' END || (event_id % 11) AS rogue_bssid, NULL::varchar AS ssid,
  -80 + event_id % 50::bigint AS signal_dbm, (CASE WHEN event_id % 7 = 0 OR event_id % 4 = 0 THEN 1 ELSE 0 END)::bigint AS ssid_impersonation, r.row_json AS raw_json
FROM events JOIN (SELECT event_id AS id, row_json FROM v_rows_wireless_alert_rogue_ap) r ON r.id = event_id WHERE NOT {_BAD}"""
CTES["deauth"] = f"""
SELECT {_KEY}, ts AS detected_at, 's' || (user_id % 10) AS sensor_id, 'l' || (user_id % 7) AS location_id, 'wlan0' AS interface,
  CASE WHEN event_id % 2 = 0 THEN 1 + event_id % 40 ELSE 0 END AS channel,
  CASE WHEN event_id % 3 = 0 THEN 'a' || user_id WHEN event_id % 2 = 0 THEN 'm' || user_id END AS attacker_mac,
  CASE WHEN event_id % 2 = 0 THEN 't' ELSE 'b' END || (event_id % 11) AS target_bssid, CASE WHEN event_id % 2 = 0 THEN 'net' || user_id END AS target_ssid,
  event_id % 100::bigint AS deauth_count, 10::bigint AS window_secs, (CASE WHEN event_id % 2 = 0 THEN 30 ELSE 0 END)::bigint AS threshold, NULL::bigint AS signal_dbm,
  r.row_json AS raw_json
FROM events JOIN (SELECT event_id AS id, row_json FROM v_rows_wireless_alert_deauth_flood) r ON r.id = event_id WHERE NOT {_BAD}"""
CTES["anomaly"] = f"""
SELECT {_KEY}, ts AS detected_at, 's' || (user_id % 10) AS sensor_id, 'l' || (user_id % 7) AS location_id, 'm' || user_id AS source_mac,
  NULL::varchar AS bssid, CASE WHEN event_id % 2 = 0 THEN 'net' || user_id END AS ssid, 1 + event_id % 40::bigint AS channel, -50::bigint AS baseline_dbm,
  -80 + event_id % 50::bigint AS observed_dbm, abs(-30 + event_id % 50) AS dbm_delta, 20::bigint AS configured_delta {_TAIL}"""
CTES["pmf"] = f"""
SELECT {_KEY}, ts AS detected_at, 's' || (user_id % 10) AS sensor_id, 'l' || (user_id % 7) AS location_id,
  CASE WHEN event_id % 2 = 0 THEN 't' ELSE 'm' END || user_id AS target_mac, CASE WHEN event_id % 3 = 0 THEN 'b' || (event_id % 11) END AS target_bssid,
  NULL::varchar AS ssid, CASE WHEN event_id % 2 = 0 THEN 1 + event_id % 40 END AS channel, event_type AS attack_tag,
  CASE WHEN event_id % 2 = 0 THEN event_id % 1000 END AS reconnect_window_ms {_TAIL}"""


@query("normalize_rogue_ap", "SELECT * FROM v_rogue")
def _(t):
    return N.valid_rows(normalized(t, "wireless.alert.rogue_ap"))


@query("normalize_deauth_flood", "SELECT * FROM v_deauth")
def _(t):
    return N.valid_rows(normalized(t, "wireless.alert.deauth_flood"))


@query("normalize_signal_anomaly", "SELECT * FROM v_anomaly")
def _(t):
    return N.valid_rows(normalized(t, "wireless.alert.signal_anomaly"))


@query("normalize_pmf_attack", "SELECT * FROM v_pmf")
def _(t):
    return N.valid_rows(normalized(t, "wireless.alert.pmf_attack"))


@query("normalize_client_inventory", f"""
SELECT {_KEY}, 'sensor-of-b' || (event_id // 100) AS sensor_id, 'hall' AS location_id, timestamp '2024-01-31 23:00:00' AS snapshot_at,
  CASE WHEN event_id % 2 = 0 THEN 'c' ELSE 'm' END || user_id AS client_mac, NULL::varchar AS bssid,
  CASE WHEN event_id % 2 = 0 THEN 'net' || user_id END AS ssid, NULL::varchar AS device_id, NULL::varchar AS username,
  NULL::varchar AS identity_source, ts AS last_seen, ts AS first_seen, -80 + event_id % 50::bigint AS signal_dbm, {_FLAG_SQL} AS is_authorized,
  timestamp '2024-01-31 23:00:00' AS created_at
FROM events WHERE event_id % 31 <> 0 AND (event_id % 29 <> 0 OR event_id % 2 = 0) AND NOT (event_id % 31 = 0)""")
def _(t):
    return N.valid_rows(normalized(t, "wireless.client.inventory"))


@query("normalize_probe_requests", f"""
SELECT {_KEY}, 'c' || user_id AS client_mac, 'net' || user_id AS ssid, CASE WHEN event_id % 2 = 0 THEN 'b' || (event_id % 11) END AS known_bssid,
  ts AS first_seen, ts AS last_seen, event_id % 20::bigint AS probe_count, ts AS created_at {_TAIL}""")
def _(t):
    return N.valid_rows(normalized(t, "wireless.probe.flush"))


@query("normalize_errors", f"""
SELECT {_KEY}, CASE WHEN event_id % 31 = 0 THEN 'Invalid timestamp ''' || {_NAKED} || ''' for field ''observed_at'' in wireless.audit'
  ELSE 'Missing required string field ''sensor_id'' in wireless.audit' END AS error FROM events WHERE {_BAD}""")
def _(t):
    return N.invalid_rows(normalized(t, "wireless.audit")).select("batch_id", "row_sequence", "error")


@query("normalize_strict", f"""
SELECT 'p' || (event_id // 10) AS batch_id, event_id % 10 AS row_sequence, CASE WHEN event_id % 2 = 0 THEN 't' ELSE 'm' END || user_id AS target_mac
FROM events WHERE event_id // 10 NOT IN (SELECT event_id // 10 FROM events WHERE {_BAD})""")
def _(t):
    # batches of ten rows, so that some hold no bad row
    rows = t.rows_wireless_alert_pmf_attack.select(
        F.expr("'p' || (event_id DIV 10)").alias("batch_id"), F.expr("event_id % 10").alias("pos"), F.col("row_json").alias("raw")
    )
    parsed = J.with_parsed(rows, F.col("raw"), "row")
    strict = N.strict_rows(N.normalize(parsed, "wireless.alert.pmf_attack"))
    return strict.select("batch_id", "row_sequence", "target_mac")


_UNIFIED_TAIL = "timestamp '2024-01-31 00:00:00' AS created_at, timestamp '2024-01-31 00:00:00' AS updated_at"


@query("alerts_unified", f"""
SELECT 'rogue_ap' AS alert_type, batch_id, row_sequence, detected_at, sensor_id, location_id, interface, channel, rogue_bssid AS primary_mac,
  NULL::varchar AS secondary_mac, ssid, signal_dbm, '{{"ssid_impersonation":' || ssid_impersonation || '}}' AS details_json, raw_json,
  NULL::date AS alert_date, NULL::bigint AS bytes, {_UNIFIED_TAIL} FROM v_rogue
UNION ALL BY NAME SELECT 'deauth_flood' AS alert_type, batch_id, row_sequence, detected_at, sensor_id, location_id, interface, channel,
  attacker_mac AS primary_mac, target_bssid AS secondary_mac, target_ssid AS ssid, signal_dbm,
  '{{"deauth_count":' || deauth_count || ',"window_secs":10,"threshold":' || threshold || '}}' AS details_json, raw_json, {_UNIFIED_TAIL} FROM v_deauth
UNION ALL BY NAME SELECT 'signal_anomaly' AS alert_type, batch_id, row_sequence, detected_at, sensor_id, location_id, channel,
  source_mac AS primary_mac, bssid AS secondary_mac, ssid,
  '{{"baseline_dbm":-50,"observed_dbm":' || observed_dbm || ',"dbm_delta":' || dbm_delta || ',"configured_delta":20}}' AS details_json, {_UNIFIED_TAIL} FROM v_anomaly
UNION ALL BY NAME SELECT 'pmf_attack' AS alert_type, batch_id, row_sequence, detected_at, sensor_id, location_id, channel,
  target_mac AS primary_mac, target_bssid AS secondary_mac, ssid,
  '{{"attack_tag":"' || attack_tag || '"' || coalesce(',"reconnect_window_ms":' || reconnect_window_ms, '') || '}}' AS details_json, {_UNIFIED_TAIL} FROM v_pmf
UNION ALL BY NAME SELECT * FROM v_bandwidth_alerts""")
def _(t):
    rows = {target: N.valid_rows(normalized(t, target)) for target in alerts.ALERT_BUILDERS}
    return alerts.alerts_unified(rows, AS_OF, bandwidth=t.windows)


@query("input_row_count", f"""
SELECT target, 'b' || (event_id // 100) AS batch_id, count(*) AS row_count FROM events,
  (VALUES {", ".join(f"('{x}')" for x in schemas.TARGETS)}) AS x(target) GROUP BY ALL""")
def _(t):
    parts = [normalized(t, target).select(F.lit(target).alias("target"), "batch_id") for target in schemas.TARGETS]
    return N.input_row_count(reduce(DataFrame.unionByName, parts))


@query("row_sequence", f"""
SELECT target, 'b' || (event_id // 100) AS batch_id, event_id % 100 + CASE WHEN target = 'proxy.events' THEN 1 ELSE 0 END AS row_sequence, event_id
FROM events, (VALUES {", ".join(f"('{x}')" for x in schemas.TARGETS)}) AS x(target)""")
def _(t):
    """Each row's place in its batch, beside the event at that place."""

    def placed(target: str) -> DataFrame:
        resolved = payload.resolve_payload(messages.target_route(work_items(t, target)))
        rows = payload.rows_for_target(resolved.filter(F.col("payload_error").isNull()), target)
        first = F.substring("batch_id", 2, 20).cast("bigint") * 100
        return rows.select(
            F.lit(target).alias("target"), "batch_id", N.row_sequence(target).alias("row_sequence"), (first + F.col("pos")).alias("event_id")
        )

    return reduce(DataFrame.unionByName, [placed(target) for target in schemas.TARGETS])

"""Keyed upserts. Each query splits a table in time: what came before is stored, the rest is the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, detect
from ..operators import merge as M
from ..operators import tables as T
from .detection import shadow_frames
from .inputs import AS_OF
from .registry import CTES, query

CUT = "2024-01-16 00:00:00"
_NOW = f"timestamp '{AS_OF}'"
_CUT = f"timestamp '{CUT}'"


def before(df, time="observed_at"):
    return df.filter(F.col(time) < F.lit(CUT).cast("timestamp_ntz"))


def after(df, time="observed_at"):
    return df.filter(F.col(time) >= F.lit(CUT).cast("timestamp_ntz"))


def delivered_twice(df, value):
    """The batch delivered two times, the second time with another value."""
    first = df.withColumn("delivery", F.lit(1))
    return first.unionByName(df.withColumns({"delivery": F.lit(2), value: F.col(value) + 1000}))


def _insert_ignore_sql(keys: str, columns: str, value: str) -> str:
    """Stored rows keep value 0; new keys take the first delivery."""
    return f"SELECT {keys}, {columns}, CASE WHEN observed_at < {_CUT} THEN 0 ELSE {value} END AS {value} FROM v_frames"


@query("upsert_proxy_events", _insert_ignore_sql("batch_id, row_sequence", "source_mac, observed_at", "bytes"))
def _(t):
    rows = t.frames.select("batch_id", "row_sequence", "source_mac", "observed_at", "bytes")
    stored = before(rows).withColumn("bytes", F.lit(0).cast("bigint"))
    return T.upsert_proxy_events(stored, delivered_twice(rows, "bytes"), ["delivery"])


@query("upsert_audit_frames", _insert_ignore_sql("batch_id, row_sequence", "sensor_id, ssid, observed_at", "channel"))
def _(t):
    rows = t.frames.select("batch_id", "row_sequence", "sensor_id", "ssid", "observed_at", "channel")
    stored = before(rows).withColumn("channel", F.lit(0).cast("bigint"))
    return T.upsert_audit_frames(stored, delivered_twice(rows, "channel"), ["delivery"])


@query("upsert_bandwidth", f"""
SELECT batch_id, row_sequence, sensor_id, window_start, CASE WHEN window_start < timestamp '2024-01-02' THEN 0 ELSE bytes END AS bytes
FROM v_windows""")
def _(t):
    rows = t.windows.select("batch_id", "row_sequence", "sensor_id", "window_start", "bytes")
    early = F.col("window_start") < F.lit("2024-01-02").cast("timestamp_ntz")
    stored = rows.filter(early).withColumn("bytes", F.lit(0).cast("bigint"))
    return T.upsert_bandwidth(stored, delivered_twice(rows, "bytes"), ["delivery"])


@query("upsert_probe_requests", """
SELECT batch_id, client_mac, ssid, min({'p': probe_id, 'n': probe_count}).n AS probe_count
FROM v_probes GROUP BY batch_id, client_mac, ssid""")
def _(t):
    rows = t.probes.select("batch_id", "client_mac", "ssid", "probe_count", "probe_id")
    old = rows.filter(F.col("probe_id") < 5000)
    stored = M.first_per_key(old, ["batch_id", "client_mac", "ssid"], ["probe_id"])
    return T.upsert_probe_requests(stored, rows, ["probe_id"]).drop("probe_id")


@query("append_payload_audit", """
SELECT 'c' || l_partkey AS correlation_id, 'h' || l_linenumber AS host, l_returnflag AS direction, date_trunc('year', l_shipdate) AS captured_at,
  l_suppkey % 3 AS byte_offset, min(l_extendedprice) AS price FROM lineitem GROUP BY ALL""")
def _(t):
    rows, stored = audit_rows(t)
    return T.append_payload_audit(stored, rows, ["price"], on_duplicate="ignore")


@query("payload_audit_duplicates", """
SELECT *, direction = 'A' OR row_number() OVER (PARTITION BY correlation_id, host, direction, captured_at, byte_offset ORDER BY price, place) > 1 AS duplicate
FROM (SELECT 'c' || l_partkey AS correlation_id, 'h' || l_linenumber AS host, l_returnflag AS direction, date_trunc('year', l_shipdate) AS captured_at,
  l_suppkey % 3 AS byte_offset, l_extendedprice AS price, l_orderkey AS place FROM lineitem)""")
def _(t):
    rows, stored = audit_rows(t, F.col("l_orderkey").alias("place"))
    return T.payload_audit_duplicates(stored, rows, ["price", "place"])


def audit_rows(t, *more):
    """Payload-audit rows, and a table that holds the keys of one direction."""
    rows = t.lineitem.select(
        F.concat(F.lit("c"), "l_partkey").alias("correlation_id"),
        F.concat(F.lit("h"), "l_linenumber").alias("host"),
        F.col("l_returnflag").alias("direction"),
        F.date_trunc("year", "l_shipdate").cast("timestamp_ntz").alias("captured_at"),
        (F.col("l_suppkey") % 3).alias("byte_offset"),
        F.col("l_extendedprice").alias("price"),
        *more,
    )
    keys = ["correlation_id", "host", "direction", "captured_at", "byte_offset"]
    return rows, M.first_per_key(rows.filter(F.col("direction") == "A"), keys, ["price"])


@query("upsert_sensors", f"""
SELECT sensor_id, (last.f).location_id AS location_id, (last.f).interface AS interface, (last.f).reg_domain AS reg_domain,
  first_seen_at, last.latest_at AS last_seen_at FROM (
  SELECT sensor_id, arg_max({{'f': f, 'latest_at': latest_at}}, place) AS last, arg_min(f.observed_at, place) AS first_seen_at FROM (
    SELECT observed_at < {_CUT} AS old, batch_id, sensor_id, arg_min({{'location_id': location_id, 'interface': interface,
      'reg_domain': reg_domain, 'observed_at': observed_at}}, {{'o': observed_at, 'r': -row_sequence}}) AS f,
      max(observed_at) AS latest_at, max(frame_no) AS place
    FROM v_frames GROUP BY old, batch_id, sensor_id) GROUP BY sensor_id)""")
def _(t):
    frames = t.frames
    empty = frames.limit(0).selectExpr(
        "sensor_id", "location_id", "interface", "reg_domain", "observed_at AS first_seen_at", "observed_at AS last_seen_at"
    )
    stored = T.upsert_sensors(empty, before(frames), ["frame_no"])
    return T.upsert_sensors(stored, after(frames), ["frame_no"])


@query("upsert_client_inventory", """
SELECT sensor_id, snapshot_at, client_mac, r.location_id AS location_id, r.bssid AS bssid, r.ssid AS ssid, NULL::varchar AS device_id,
  r.username AS username, r.identity_source AS identity_source, r.last_seen AS last_seen, first_seen, r.signal_dbm AS signal_dbm,
  r.is_authorized AS is_authorized, created_at FROM (
  SELECT sensor_id, date_trunc('day', observed_at) AS snapshot_at, source_mac AS client_mac, min(observed_at) AS created_at,
    arg_max(observed_at, frame_no) AS first_seen,
    arg_max({'location_id': location_id, 'bssid': destination_bssid, 'ssid': ssid, 'username': reg_domain, 'identity_source': interface,
      'last_seen': observed_at, 'signal_dbm': signal_dbm, 'is_authorized': is_retry}, frame_no) AS r
  FROM v_frames GROUP BY ALL)""")
def _(t):
    rows = t.frames.selectExpr(
        "frame_no", "sensor_id", "cast(date_trunc('day', observed_at) AS timestamp_ntz) AS snapshot_at", "source_mac AS client_mac",
        "location_id", "destination_bssid AS bssid", "ssid", "cast(NULL AS string) AS device_id", "reg_domain AS username",
        "interface AS identity_source", "observed_at AS last_seen", "observed_at AS first_seen", "signal_dbm",
        "is_retry AS is_authorized", "observed_at AS created_at",
    )
    first = T.upsert_client_inventory(rows.limit(0).drop("frame_no"), before(rows, "last_seen"), ["frame_no"])
    return T.upsert_client_inventory(first, after(rows, "last_seen"), ["frame_no"])


# Alerts of one kind: several frames share a key, and one in 37 has no batch.
CTES["alert_rows"] = f"""
SELECT frame_no, observed_at, 'rogue_ap' AS alert_type, CASE WHEN frame_no % 37 <> 0 THEN batch_id END AS batch_id,
  row_sequence % 10 AS row_sequence, observed_at AS detected_at, sensor_id, location_id, interface, channel, source_mac AS primary_mac,
  destination_bssid AS secondary_mac, ssid, signal_dbm, '{{"n":' || frame_no || '}}' AS details_json, NULL::varchar AS raw_json,
  CASE WHEN observed_at < {_CUT} THEN {_CUT} ELSE {_NOW} END AS stamp FROM v_frames"""


def alert_rows(t):
    return t.frames.selectExpr(
        "frame_no", "observed_at", "'rogue_ap' AS alert_type", "CASE WHEN frame_no % 37 <> 0 THEN batch_id END AS batch_id",
        "row_sequence % 10 AS row_sequence", "observed_at AS detected_at", "sensor_id", "location_id", "interface", "channel",
        "source_mac AS primary_mac", "destination_bssid AS secondary_mac", "ssid", "signal_dbm",
        """'{"n":' || frame_no || '}' AS details_json""", "cast(NULL AS string) AS raw_json",
        f"timestamp_ntz '{CUT}' AS created_at", f"timestamp_ntz '{CUT}' AS updated_at",
    )


def stored_and_new_alerts(t):
    rows = alert_rows(t)
    now = F.lit(AS_OF).cast("timestamp_ntz")
    stored = T.upsert_alerts(rows.limit(0).drop("frame_no", "observed_at"), before(rows), ["frame_no"])
    new = after(rows).withColumns({"created_at": now, "updated_at": now})
    return stored, T.upsert_alerts(stored, new, ["frame_no"])


CTES["merged_alerts"] = """
SELECT alert_type, batch_id, row_sequence, arg_max({'detected_at': detected_at, 'sensor_id': sensor_id, 'location_id': location_id,
    'interface': interface, 'channel': channel, 'primary_mac': primary_mac, 'secondary_mac': secondary_mac, 'ssid': ssid,
    'signal_dbm': signal_dbm, 'details_json': details_json, 'raw_json': raw_json, 'updated_at': stamp}, frame_no) AS r,
  arg_min(stamp, frame_no) AS created_at, min(stamp) AS first_at, max(stamp) AS last_at
FROM v_alert_rows GROUP BY alert_type, batch_id, row_sequence, CASE WHEN batch_id IS NULL THEN frame_no END"""


@query("upsert_alerts", """
SELECT alert_type, batch_id, row_sequence, r.detected_at AS detected_at, r.sensor_id AS sensor_id, r.location_id AS location_id,
  r.interface AS interface, r.channel AS channel, r.primary_mac AS primary_mac, r.secondary_mac AS secondary_mac, r.ssid AS ssid,
  r.signal_dbm AS signal_dbm, r.details_json AS details_json, r.raw_json AS raw_json, r.updated_at AS updated_at, created_at
FROM v_merged_alerts""")
def _(t):
    return stored_and_new_alerts(t)[1]


@query("alerts_ledger", f"""
SELECT alert_type, batch_id, row_sequence, r.details_json AS details_json,
  CASE WHEN batch_id IS NOT NULL AND first_at < last_at THEN 'update' ELSE 'insert' END AS ledger_action, {_NOW} AS captured_at
FROM v_merged_alerts WHERE last_at = {_NOW}""")
def _(t):
    stored, merged = stored_and_new_alerts(t)
    log = T.alerts_ledger(stored, merged, AS_OF)
    return log.select("alert_type", "batch_id", "row_sequence", "details_json", "ledger_action", "captured_at")


_EARLY = "timestamp '2023-12-31 00:00:00'"


@query("upsert_bandwidth_alerts", f"""
SELECT * REPLACE (CASE WHEN alert_date = date '2024-01-01' THEN {_EARLY} ELSE created_at END AS created_at) FROM v_bandwidth_alerts""")
def _(t):
    new = alerts.bandwidth_alerts(t.windows, AS_OF)
    early = F.lit("2023-12-31").cast("timestamp_ntz")
    stored = new.filter(F.col("alert_date") == "2024-01-01").withColumns(
        {"bytes": F.lit(0).cast("bigint"), "location_id": F.lit("old"), "created_at": early, "updated_at": early}
    )
    return T.upsert_bandwidth_alerts(stored, new, ["batch_id", "row_sequence"])


@query("upsert_bandwidth_alerts_day", """
SELECT alert_type, sensor_id, primary_mac, secondary_mac, alert_date, r.batch_id AS batch_id, r.row_sequence AS row_sequence,
  r.detected_at AS detected_at, r.location_id AS location_id, r.ssid AS ssid, r.bytes AS bytes, r.details_json AS details_json,
  r.updated_at AS updated_at, NULL::bigint AS signal_dbm, created_at FROM (
  SELECT alert_type, sensor_id, primary_mac, secondary_mac, alert_date, min(created_at) AS created_at,
    arg_max({'batch_id': batch_id, 'row_sequence': row_sequence, 'detected_at': detected_at, 'location_id': location_id, 'ssid': ssid,
      'bytes': bytes, 'details_json': details_json, 'updated_at': updated_at}, {'b': batch_id, 'r': row_sequence}) AS r
  FROM v_bandwidth_alerts GROUP BY ALL)""")
def _(t):
    new = alerts.bandwidth_alerts(t.windows, AS_OF)
    return T.upsert_bandwidth_alerts(new.limit(0), new, ["batch_id", "row_sequence"], key="day")


@query("upsert_blocked_rollup", f"""
SELECT r.* REPLACE (coalesce(r.frequency_hz, 0) AS frequency_hz), CASE WHEN s.last_at >= {_CUT} THEN {_NOW} ELSE {_CUT} END AS updated_at,
  CASE WHEN s.first_at < {_CUT} THEN {_CUT} ELSE {_NOW} END AS first_seen
FROM v_rollup r JOIN (SELECT host, min(observed_at) AS first_at, max(observed_at) AS last_at FROM v_blocked GROUP BY host) s ON s.host = r.host""")
def _(t):
    rows = t.blocked
    empty = rows.limit(0).selectExpr(
        "host", "seq AS blocked_attempts", "blocked_bytes", *T.LAST_STATED, "tarpit_held_ms", "consecutive_blocks",
        "last_verdict", "observed_at AS updated_at", "observed_at AS first_seen",
    )
    stored = T.upsert_blocked_rollup(empty, before(rows), ["seq"], CUT)
    return T.upsert_blocked_rollup(stored, after(rows), ["seq"], AS_OF)


CTES["valid_scans"] = """
SELECT *, CASE place % 4 WHEN 1 THEN o WHEN 2 THEN o END AS observed_at FROM (
  SELECT s.*, o.o_orderdate AS o FROM v_scans s JOIN orders o ON o.o_orderkey = s.place)
WHERE trim(dedupe_key) <> '' AND trim(coalesce(payload_ref, '')) <> ''"""


@query("upsert_scan_requests", f"""
SELECT coalesce(s.dedupe_key, e.dedupe_key) AS dedupe_key, coalesce(s.stream_name, e.stream_name) AS stream_name,
  CASE WHEN s.place IS NULL THEN e.observed_at ELSE coalesce(s.observed_at, e.observed_at, {_NOW}) END AS observed_at,
  CASE WHEN s.place IS NULL THEN e.payload_ref ELSE s.payload_ref END AS payload_ref, coalesce(s.payload, e.payload) AS payload,
  s.payload_sha256 AS payload_sha256,
  CASE WHEN e.status IS NULL THEN 'pending' WHEN s.place IS NOT NULL AND e.status IN ('pending', 'failed') THEN 'pending' ELSE e.status END AS status,
  coalesce(e.attempt_count, 0) AS attempt_count,
  CASE WHEN s.place IS NOT NULL AND e.status IN ('pending', 'failed') THEN NULL ELSE e.last_error END AS last_error,
  CASE WHEN s.place IS NULL THEN e.producer ELSE 'ssl-proxy' END AS producer, coalesce(e.event_kind, s.event_kind) AS event_kind,
  coalesce(e.created_at, {_NOW}) AS created_at, CASE WHEN s.place IS NULL THEN e.updated_at ELSE {_NOW} END AS updated_at
FROM v_ledger e FULL JOIN v_valid_scans s ON s.dedupe_key = e.dedupe_key AND s.stream_name = e.stream_name""")
def _(t):
    stored = t.ledger.withColumn("payload_sha256", F.lit(None).cast("string"))
    # every request arrives twice; the later copy carries another payload and must not count
    again = t.scans.withColumns({"payload": F.lit("{}"), "place": F.col("place") + 10_000_000_000})
    return T.upsert_scan_requests(stored, t.scans.unionByName(again), ["place"], AS_OF)


CTES["client_deltas"] = """
SELECT ssid, client_mac, message_no, batch_id, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
  arg_min(probe_count, pos) AS probe_count, arg_max(known_bssid, pos) AS known_bssid, arg_max(location_id, pos) AS location_id
FROM v_known_probes GROUP BY ssid, client_mac, message_no, batch_id"""


@query("upsert_wireless_clients", """
SELECT ssid, client_mac, arg_max(known_bssid, message_no) AS known_bssid, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
  sum(CASE WHEN prev IS NULL OR prev <> batch_id THEN probe_count ELSE 0 END)::bigint AS probe_count,
  arg_max(location_id, message_no) AS location_id, arg_max(batch_id, message_no) AS last_probe_batch_id
FROM (SELECT *, lag(batch_id) OVER (PARTITION BY ssid, client_mac ORDER BY message_no) AS prev FROM v_client_deltas)
GROUP BY ssid, client_mac""")
def _(t):
    known = detect.probe_known_bssid(t.probes, t.networks)
    empty = known.limit(0).selectExpr(
        "ssid", "client_mac", "known_bssid", "first_seen", "last_seen", "probe_count", "location_id",
        "batch_id AS last_probe_batch_id",
    )
    # two micro-batches: the earlier messages are stored first
    middle = F.col("message_no") < 700
    stored = T.upsert_wireless_clients(empty, known.filter(middle), ["pos"])
    return T.upsert_wireless_clients(stored, known.filter(~middle), ["pos"])


@query("upsert_shadow_alerts", f"""
SELECT source_mac, min(observed_at) AS first_occurred_at, max(observed_at) AS last_occurred_at, count(*) AS occurrence_count,
  arg_max(destination_bssid, observed_at) AS destination_bssid, arg_max_null(ssid, observed_at) AS ssid,
  arg_max(sensor_id, observed_at) AS sensor_id, arg_max(location_id, observed_at) AS location_id,
  arg_max(signal_dbm, observed_at) AS signal_dbm, CASE WHEN min(observed_at) < timestamp '2024-01-20' THEN timestamp '2024-01-20' ELSE {_NOW} END AS created_at,
  CASE WHEN max(observed_at) >= timestamp '2024-01-20' THEN {_NOW} ELSE timestamp '2024-01-20' END AS updated_at
FROM v_shadow_frames GROUP BY source_mac""")
def _(t):
    found = shadow_frames(t)
    empty = found.limit(0).selectExpr(
        "source_mac", "observed_at AS first_occurred_at", "observed_at AS last_occurred_at", "signal_dbm AS occurrence_count",
        *T.SHADOW_ATTRIBUTES, "observed_at AS created_at", "observed_at AS updated_at",
    )
    early = F.col("observed_at") < F.lit("2024-01-20").cast("timestamp_ntz")
    stored = T.upsert_shadow_alerts(empty, found.filter(early), "2024-01-20 00:00:00")
    return T.upsert_shadow_alerts(stored, found.filter(~early), AS_OF)


@query("upsert_cursors", f"""
SELECT coalesce(o.stream_name, n.stream_name) AS stream_name, coalesce(o.cursor_value, '0') AS cursor_value,
  CASE WHEN n.stream_name IS NULL THEN o.updated_at ELSE {_NOW} END AS updated_at
FROM (SELECT 'sensor.' || sensor_id AS stream_name, count(*)::varchar AS cursor_value, max(observed_at) AS updated_at
      FROM v_frames WHERE observed_at < {_CUT} GROUP BY sensor_id) o
FULL JOIN (SELECT DISTINCT 'sensor.' || source_mac AS stream_name FROM v_frames WHERE observed_at >= {_CUT}
      UNION SELECT DISTINCT 'sensor.' || sensor_id FROM v_frames WHERE observed_at >= {_CUT}) n ON n.stream_name = o.stream_name""")
def _(t):
    named = lambda df, c: df.select(F.concat(F.lit("sensor."), c).alias("stream_name"), "observed_at")
    stored = named(before(t.frames), "sensor_id").groupBy("stream_name").agg(
        F.count("*").cast("string").alias("cursor_value"), F.max("observed_at").alias("updated_at")
    )
    streams = named(after(t.frames), "source_mac").unionByName(named(after(t.frames), "sensor_id"))
    return T.upsert_cursors(stored, streams, AS_OF)

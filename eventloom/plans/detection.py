"""Detection, network authorisation, lookups and their aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, detect, filters, metrics
from ..operators import tables as T
from .inputs import AS_OF
from .registry import CTES, query

FRAMES_FROM = "2024-01-15 00:00:00"
LOOK_BACK = 16 * 86_400  # seconds from FRAMES_FROM to AS_OF

# Frames parsed from the stored payloads, computed here from the source columns.
CTES["stored_frames"] = """
SELECT CASE WHEN event_id % 23 = 0 THEN 'bad-mac' ELSE printf('02:00:%02x:%02x:%02x:%02x', user_id // 16777216 % 256,
         user_id // 65536 % 256, user_id // 256 % 256, user_id % 256) END AS source_mac,
       ts AS observed_at,
       CASE WHEN event_id % 3 = 0 THEN 'b' || (event_id % 13) ELSE 'b' || (event_id % 11) END AS destination_bssid,
       CASE WHEN event_id % 17 <> 0 THEN 'net' || user_id END AS ssid,
       's' || (user_id // 10) AS sensor_id, 'l' || (user_id % 7) AS location_id, -80 + event_id % 50 AS signal_dbm
FROM events WHERE event_id % 5 = 1 AND event_id % 19 <> 0"""

CTES["strong"] = f"""
SELECT DISTINCT * FROM v_stored_frames
WHERE observed_at >= timestamp '{FRAMES_FROM}' AND signal_dbm >= -50
  AND regexp_full_match(source_mac, '[0-9a-f]{{2}}(:[0-9a-f]{{2}}){{5}}')"""

_NOT_AUTHORIZED = """NOT EXISTS (SELECT 1 FROM v_networks n WHERE n.enabled
   AND (n.location_id IS NULL OR n.location_id = w.location_id) AND (n.ssid IS NULL OR n.ssid = w.ssid)
   AND (n.bssid IS NULL OR n.bssid = w.destination_bssid))"""
_ABSENT = f"""NOT EXISTS (SELECT 1 FROM v_devices d WHERE d.mac_id = w.source_mac
   AND d.last_seen >= timestamp '{AS_OF}' - to_seconds(300))"""

CTES["shadow_frames"] = f"SELECT * FROM v_strong w WHERE {_NOT_AUTHORIZED} AND {_ABSENT}"

_SHADOW = """
SELECT source_mac, min(observed_at) AS first_occurred_at, max(observed_at) AS last_occurred_at,
       count(*) AS occurrence_count, arg_max(destination_bssid, observed_at) AS destination_bssid,
       arg_max_null(ssid, observed_at) AS ssid, arg_max(sensor_id, observed_at) AS sensor_id,
       arg_max(location_id, observed_at) AS location_id, arg_max(signal_dbm, observed_at) AS signal_dbm,
       'strong_wireless_without_proxy_presence' AS reason
FROM v_shadow_frames GROUP BY source_mac"""


def shadow_frames(t):
    frames = detect.frames_from_ledger(t.ledger)
    return detect.shadow_frames(frames, t.networks, t.devices, AS_OF, LOOK_BACK)


@query("shadow_alerts", _SHADOW)
def shadow_alerts(t):
    return detect.shadow_alerts(shadow_frames(t))


@query("shadow_alert_json", f"""
SELECT source_mac, json_object('event_type', 'shadow_device', 'first_occurred_at', first_occurred_at::varchar,
  'last_occurred_at', last_occurred_at::varchar, 'source_mac', source_mac, 'occurrence_count', occurrence_count,
  'destination_bssid', destination_bssid, 'ssid', ssid, 'sensor_id', sensor_id, 'location_id', location_id,
  'signal_dbm', signal_dbm, 'reason', reason, 'evidence', json_object('window_seconds', {LOOK_BACK}, 'signal_threshold_dbm', -50,
  'presence_window_seconds', 300))::varchar AS alert_json FROM ({_SHADOW})""")
def _(t):
    found = detect.shadow_alerts(shadow_frames(t)).withColumn("evidence", detect.shadow_evidence(LOOK_BACK))
    return found.select("source_mac", detect.shadow_alert_json(found).alias("alert_json"))


@query("distinct_frames", "SELECT DISTINCT * FROM v_stored_frames")
def _(t):
    return detect.distinct_frames(detect.frames_from_ledger(t.ledger))


@query("filter_recent_strong", f"""
SELECT * FROM v_stored_frames WHERE observed_at >= timestamp '{FRAMES_FROM}' AND signal_dbm >= -50""")
def _(t):
    return filters.filter_recent_strong(detect.frames_from_ledger(t.ledger), AS_OF, LOOK_BACK, payload=None)


@query("filter_mac_valid", """
SELECT frame_no, source_mac FROM v_frames WHERE regexp_full_match(lower(source_mac), '[0-9a-f]{2}(:[0-9a-f]{2}){5}')""")
def _(t):
    return filters.filter_mac_valid(t.frames).select("frame_no", "source_mac")


@query("unauthorized_frames", f"SELECT w.frame_no, w.ssid, w.location_id FROM v_frames w WHERE {_NOT_AUTHORIZED}")
def _(t):
    return detect.unauthorized_frames(t.frames, t.networks).select("frame_no", "ssid", "location_id")


@query("absent_devices", f"SELECT w.frame_no, w.source_mac FROM v_frames w WHERE {_ABSENT}")
def _(t):
    return detect.absent_devices(t.frames, t.devices, AS_OF).select("frame_no", "source_mac")


@query("filter_enabled_networks", "SELECT id, ssid, bssid, location_id FROM v_networks WHERE enabled")
def _(t):
    return filters.filter_enabled_networks(t.networks).select("id", "ssid", "bssid", "location_id")


_NETWORK_JSON = """json_object('ssid', ssid, 'bssid', lower(bssid), 'location_id', location_id, 'label', label,
  'enabled', enabled)::varchar"""


@query("authorized_networks_json", f"""
SELECT page, '[' || string_agg(j, ',' ORDER BY id) || ']' AS networks_json FROM (
  SELECT id, (row_number() OVER (ORDER BY id) - 1) // 50 AS page, {_NETWORK_JSON} AS j FROM v_networks WHERE enabled)
GROUP BY page""")
def _(t):
    return detect.authorized_networks_json(t.networks, page_size=50)


@query("networks_reply", """
SELECT r.request_id, CASE r.request_id % 9 WHEN 0 THEN 'wireless.networks.authorized.reply'
    ELSE CASE r.request_id % 6 WHEN 0 THEN 'wireless.mac.lookup.reply'
         WHEN 1 THEN '_INBOX.atheros_sensor.' || r.request_id ELSE 'wireless.networks.authorized.reply' END END AS topic,
  p.page, p.reply
FROM v_requests r, (SELECT page, '[' || string_agg(j, ',' ORDER BY n_nationkey) || ']' AS reply FROM (
  SELECT n_nationkey, (row_number() OVER (ORDER BY n_nationkey) - 1) // 7 AS page, json_object('ssid', n_name, 'bssid', lower('B' || n_nationkey),
     'location_id', 'l' || n_regionkey, 'label', n_name, 'enabled', true)::varchar AS j FROM nation WHERE n_nationkey % 4 <> 0) GROUP BY page) p""")
def _(t):
    networks = t.nation.selectExpr(
        "n_nationkey AS id", "n_name AS ssid", "'B' || n_nationkey AS bssid", "'l' || n_regionkey AS location_id",
        "n_name AS label", "n_nationkey % 4 <> 0 AS enabled",
    )
    from ..functions.json_fields import extract_field

    asked = t.requests.withColumn("reply_topic", extract_field(F.col("value"), "reply_topic"))
    answered = detect.networks_reply(asked, networks, "wireless.networks.authorized.reply", page_size=7)
    return answered.select("request_id", "topic", "page", "reply")


@query("device_lookup", """
SELECT r.o_orderkey AS request_id, json_object('device_id', d.mac_id, 'username', d.username, 'display_name',
   d.display_name, 'hostname', d.hostname)::varchar AS reply
FROM orders r JOIN v_devices d ON d.mac_id = printf('02:00:%02x:%02x:%02x:%02x', o_custkey // 16777216 % 256,
   o_custkey // 65536 % 256, o_custkey // 256 % 256, o_custkey % 256)
WHERE r.o_orderkey % 9 NOT IN (0, 1, 2, 3)""")
def _(t):
    from ..functions.json_fields import extract_field

    asked = t.requests.withColumn("mac", extract_field(F.col("value"), "mac"))
    return detect.device_lookup(asked, t.devices).select("request_id", "reply")


@query("filter_reply_topic", """
SELECT request_id, CASE WHEN request_id % 9 = 0 THEN 'default.reply' WHEN request_id % 6 = 0 THEN 'wireless.mac.lookup.reply'
  WHEN request_id % 6 = 1 THEN '_INBOX.atheros_sensor.' || request_id ELSE 'default.reply' END AS topic FROM v_requests""")
def _(t):
    from ..functions.json_fields import extract_field

    asked = t.requests.withColumn("reply_topic", extract_field(F.col("value"), "reply_topic"))
    return filters.filter_reply_topic(asked, "default.reply").select("request_id", "topic")


CTES["known_probes"] = """
SELECT p.*, (SELECT CASE WHEN count(*) = 1 THEN max(n.bssid) END FROM v_networks n WHERE n.enabled
    AND lower(n.ssid) = lower(p.ssid) AND (p.observed_bssid IS NULL OR lower(n.bssid) = lower(p.observed_bssid))
    AND (p.location_id IS NULL OR n.location_id = p.location_id)) AS known_bssid FROM v_probes p"""


@query("probe_known_bssid", "SELECT probe_id, ssid, known_bssid FROM v_known_probes")
def _(t):
    return detect.probe_known_bssid(t.probes, t.networks).select("probe_id", "ssid", "known_bssid")


@query("probe_clients", """
SELECT ssid, client_mac, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
  sum(probe_count)::bigint AS probe_count FROM v_probes GROUP BY ssid, client_mac""")
def _(t):
    return detect.probe_clients(t.probes)


@query("filter_threshold", "SELECT batch_id, row_sequence, bytes FROM v_windows WHERE threshold_exceeded <> 0")
def _(t):
    return filters.filter_threshold(t.windows).select("batch_id", "row_sequence", "bytes")


BANDWIDTH_ALERTS = """
SELECT 'bandwidth_threshold' AS alert_type, batch_id, min(row_sequence) AS row_sequence, local_day AS alert_date,
  min(window_start) AS detected_at, sensor_id,
  arg_max(location_id, {'w': window_start, 's': -row_sequence}) AS location_id, source_mac AS primary_mac,
  destination_bssid AS secondary_mac, arg_max_null(ssid, {'w': window_start, 's': -row_sequence}) AS ssid,
  NULL::bigint AS signal_dbm, sum(bytes)::bigint AS bytes,
  json_object('aggregated_rows', count(*), 'total_bytes', sum(bytes)::bigint, 'threshold', 'exceeded')::varchar AS details_json,
  timestamp '2024-01-31 00:00:00' AS created_at, timestamp '2024-01-31 00:00:00' AS updated_at
FROM v_windows WHERE threshold_exceeded <> 0
GROUP BY batch_id, sensor_id, source_mac, destination_bssid, local_day"""
CTES["bandwidth_alerts"] = BANDWIDTH_ALERTS


@query("bandwidth_alerts", "SELECT * FROM v_bandwidth_alerts")
def _(t):
    return alerts.bandwidth_alerts(t.windows, AS_OF)


@query("sensor_first_in_batch", """
SELECT batch_id, sensor_id, f.location_id AS location_id, f.interface AS interface, f.reg_domain AS reg_domain,
  f.observed_at AS observed_at, latest_at FROM (
  SELECT batch_id, sensor_id, max(observed_at) AS latest_at, arg_min({'location_id': location_id, 'interface': interface,
    'reg_domain': reg_domain, 'observed_at': observed_at}, {'o': observed_at, 'r': -row_sequence}) AS f
  FROM v_frames GROUP BY batch_id, sensor_id)""")
def _(t):
    return T.sensor_first_in_batch(t.frames, ["frame_no"]).drop("last_place")


CTES["streaks"] = """
SELECT host, arg_max(consecutive_blocks, seq) FILTER (consecutive_blocks IS NOT NULL)
   + count(*) FILTER (seq > last_stated) AS consecutive_blocks FROM (
  SELECT *, max(CASE WHEN consecutive_blocks IS NOT NULL THEN seq END) OVER (PARTITION BY host) AS last_stated FROM v_blocked)
GROUP BY host"""
_STATED = ["frequency_hz", "verdict", "category", "risk_score", "iat_ms", "tls_ver", "alpn", "ja3_lite", "resolved_ip", "asn_org"]
# a host's first row does not fall back on its verdict
CTES["verdicts"] = """
SELECT *, coalesce(last_verdict, CASE WHEN row_number() OVER (PARTITION BY host ORDER BY seq) > 1 THEN verdict END) AS final FROM v_blocked"""
CTES["rollup"] = f"""
SELECT b.host, count(*) AS blocked_attempts, sum(blocked_bytes)::bigint AS blocked_bytes,
  sum(tarpit_held_ms)::bigint AS tarpit_held_ms, {", ".join(f"arg_max({c}, seq) AS {c}" for c in _STATED)},
  arg_max(final, seq) AS last_verdict, any_value(s.consecutive_blocks) AS consecutive_blocks
FROM v_verdicts b JOIN v_streaks s ON s.host = b.host GROUP BY b.host"""


@query("blocked_host_rollup", "SELECT * FROM v_rollup")
def _(t):
    return T.blocked_host_rollup(t.blocked, ["seq"])


@query("consecutive_blocks", "SELECT * FROM v_streaks")
def _(t):
    from ..operators.ordering import consecutive_counts

    return consecutive_counts(t.blocked, ["host"], ["seq"], "consecutive_blocks", "consecutive_blocks")


@query("last_nonnull", """
SELECT host, arg_max(frequency_hz, seq) AS frequency_hz, arg_max(category, seq) AS category, arg_max(alpn, seq) AS alpn
FROM v_blocked GROUP BY host""")
def _(t):
    from ..operators.ordering import last_non_null_per_key

    return last_non_null_per_key(t.blocked, ["host"], ["seq"], ["frequency_hz", "category", "alpn"])


@query("last_verdict", "SELECT host, arg_max(final, seq) AS last_verdict FROM v_verdicts GROUP BY host")
def _(t):
    return T.last_verdict(t.blocked, ["seq"])


@query("frames_to_bandwidth_windows", """
SELECT window_start, window_start + to_seconds(14400) AS window_end, sensor_id, source_mac, destination_bssid, channel,
  sum(bytes)::bigint AS bytes, count(*) AS frame_count, sum(is_retry)::bigint AS retry_count, max(signal_dbm) AS strongest_signal_dbm,
  count(*) FILTER (bytes < 100) AS hist_under_100, count(*) FILTER (bytes >= 100 AND bytes < 500) AS hist_100_500,
  count(*) FILTER (bytes >= 500 AND bytes < 1000) AS hist_500_1000,
  count(*) FILTER (bytes >= 1000 AND bytes <= 1500) AS hist_1000_1500,
  quantile_disc(gap, 0.5)::bigint AS inter_arrival_p50_ms
FROM (SELECT *, (epoch_us(observed_at) - lag(epoch_us(observed_at)) OVER (PARTITION BY window_start, sensor_id, source_mac,
        destination_bssid, channel ORDER BY observed_at, frame_no)) // 1000 AS gap
      FROM (SELECT * REPLACE (channel % 2 AS channel, 'x' AS destination_bssid),
              time_bucket(interval 4 hours, observed_at, timestamp '1970-01-01') AS window_start FROM v_frames))
GROUP BY window_start, sensor_id, source_mac, destination_bssid, channel""")
def _(t):
    from ..operators.retention import frames_to_bandwidth_windows

    frames = t.frames.withColumns({"channel": F.col("channel") % 2, "destination_bssid": F.lit("x")})
    return frames_to_bandwidth_windows(frames, "4 hours")


@query("pending_timeline", """
SELECT stream_name, tick, sum(n) OVER (PARTITION BY stream_name ORDER BY tick)::bigint AS pending FROM (
  SELECT stream_name, date_trunc('hour', observed_at) AS tick, count(*) AS n FROM v_ledger
  WHERE status IN ('pending', 'processing') GROUP BY ALL)""")
def _(t):
    return metrics.pending_timeline(t.ledger)


# Pending counts that rise and fall: open events per stream and hour.
CTES["hourly"] = """
SELECT stream_name, date_trunc('hour', observed_at) AS tick, count(*) AS pending FROM v_ledger GROUP BY ALL"""


@query("backpressure_timeline", """
SELECT stream_name, tick, pending, coalesce(last_value(CASE WHEN pending >= 6 THEN true WHEN pending <= 3 THEN false END IGNORE NULLS)
  OVER (PARTITION BY stream_name ORDER BY tick ROWS UNBOUNDED PRECEDING), false) AS suspended FROM v_hourly""")
def _(t):
    per_hour = t.ledger.groupBy("stream_name", F.date_trunc("hour", "observed_at").cast("timestamp_ntz").alias("tick"))
    return metrics.backpressure_timeline(per_hour.agg(F.count("*").alias("pending")), budget=6)

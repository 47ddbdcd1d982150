"""Table columns, keys, stream names and message shapes.

Timestamps are ``timestamp_ntz`` in UTC, flags are 0/1 ``bigint``, JSON columns
are text.  ``pk`` marks the columns of the key that decides an upsert;
``auto_inc`` marks generated columns, which are never inserted.
"""

from __future__ import annotations

from pyspark.sql import types as T

# stream name -> target tag (the tag is also the checksum tag)
TARGET_OF_STREAM = {
    "proxy.events": "proxy.events",
    "proxy.payload_audit": "proxy.payload_audit",
    "wireless.audit": "wireless.audit",
    "audit.wireless.bandwidth": "audit.wireless.bandwidth",
    "wireless.alert.rogue_ap": "wireless.alert.rogue_ap",
    "wireless.alert.deauth_flood": "wireless.alert.deauth_flood",
    "wireless.alert.signal_anomaly": "wireless.alert.signal_anomaly",
    "wireless.alert.pmf_attack": "wireless.alert.pmf_attack",
    "wireless.client.inventory": "wireless.client.inventory",
    "wireless.probe.flush": "wireless.probe.flush",
    # older names of the same targets
    "wireless.rogue_ap": "wireless.alert.rogue_ap",
    "wireless.deauth_flood": "wireless.alert.deauth_flood",
    "wireless.signal_anomaly": "wireless.alert.signal_anomaly",
    "wireless.pmf_attack": "wireless.alert.pmf_attack",
    "wireless.client_inventory": "wireless.client.inventory",
    "wireless.probe_requests": "wireless.probe.flush",
}
TARGETS = tuple(dict.fromkeys(TARGET_OF_STREAM.values()))

# producer name the ledger stores for ingested requests
PRODUCER = "ssl-proxy"

# systems whose rows are accepted
KNOWN_ORIGINS = ("atheros-sensor", "ssl-proxy", "atheros-search")

REQUIRED_TABLES = (
    "proxy_events",
    "proxy_blocked_host_rollups",
    "proxy_payload_audit",
    "wireless_sensors",
    "wireless_audit_frames",
    "wireless_bandwidth_windows",
    "wireless_alerts",
    "wireless_client_inventory",
    "wireless_probe_requests",
)

_TABLES = {
    "proxy_events": (
        "id bigint, batch_id string, row_sequence int, event_time timestamp_ntz, event_timestamp_utc timestamp_ntz, "
        "event_type string, host string, peer_ip string, wg_pubkey string, device_id string, identity_source string, "
        "peer_hostname string, client_ua string, bytes_up bigint, bytes_down bigint, status_code int, blocked bigint, "
        "obfuscation_profile string, correlation_id string, parent_event_id bigint, event_sequence int, "
        "duration_ms bigint, reason string, raw_json string",
        ("batch_id", "row_sequence"),
        ("id",),
    ),
    "proxy_blocked_host_rollups": (
        "id bigint, host string, blocked_attempts bigint, blocked_bytes bigint, frequency_hz decimal(10,4), "
        "verdict string, category string, risk_score decimal(10,4), tarpit_held_ms bigint, iat_ms bigint, "
        "consecutive_blocks bigint, last_verdict string, tls_ver string, alpn string, ja3_lite string, "
        "resolved_ip string, asn_org string, updated_at timestamp_ntz, first_seen timestamp_ntz",
        ("host",),
        ("id",),
    ),
    "proxy_payload_audit": (
        "id bigint, correlation_id string, host string, direction string, captured_at timestamp_ntz, "
        "byte_offset bigint, payload_object_key string, content_type string, http_method string, http_status int, "
        "http_path string, is_encrypted bigint, truncated bigint, peer_ip string, notes string",
        ("correlation_id", "host", "direction", "captured_at", "byte_offset"),
        ("id",),
    ),
    "wireless_sensors": (
        "sensor_pk bigint, sensor_id string, location_id string, interface string, reg_domain string, "
        "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, created_at timestamp_ntz",
        ("sensor_id",),
        ("sensor_pk",),
    ),
    "wireless_audit_frames": (
        "frame_pk bigint, batch_id string, row_sequence int, event_type string, observed_at timestamp_ntz, "
        "sensor_id string, location_id string, interface string, channel smallint, band string, frame_type string, "
        "frame_subtype string, bssid string, source_mac string, destination_mac string, transmitter_mac string, "
        "receiver_mac string, destination_bssid string, ssid string, signal_dbm smallint, sequence_number int, "
        "raw_len int, is_retry bigint, is_more_data bigint, is_power_save bigint, is_protected bigint, "
        "is_to_ds bigint, is_from_ds bigint, is_handshake bigint, security_flags int, device_id string, "
        "username string, identity_source string, tags string, anomaly_reasons string, raw_json string, "
        "created_at timestamp_ntz",
        ("batch_id", "row_sequence"),
        ("frame_pk",),
    ),
    "wireless_bandwidth_windows": (
        "bw_pk bigint, batch_id string, row_sequence int, schema_version smallint, window_start timestamp_ntz, "
        "window_end timestamp_ntz, sensor_id string, location_id string, interface string, channel smallint, "
        "band string, source_mac string, destination_bssid string, ssid string, bytes bigint, frame_count bigint, "
        "retry_count bigint, more_data_count bigint, power_save_count bigint, strongest_signal_dbm smallint, "
        "hist_under_100 bigint, hist_100_500 bigint, hist_500_1000 bigint, hist_1000_1500 bigint, "
        "inter_arrival_p50_ms int, external_bssid bigint, threshold_exceeded bigint, wall_clock_delta_ms bigint, "
        "window_is_partial bigint, published_at timestamp_ntz, created_at timestamp_ntz",
        ("batch_id", "row_sequence"),
        ("bw_pk",),
    ),
    "wireless_alerts": (
        "alert_pk bigint, alert_type string, batch_id string, row_sequence int, alert_date date, "
        "detected_at timestamp_ntz, sensor_id string, location_id string, interface string, channel smallint, "
        "primary_mac string, secondary_mac string, ssid string, signal_dbm smallint, bytes bigint, "
        "details_json string, raw_json string, acknowledged bigint, acknowledged_by string, "
        "acknowledged_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz",
        ("alert_type", "batch_id", "row_sequence"),
        ("alert_pk",),
    ),
    "wireless_client_inventory": (
        "inventory_pk bigint, sensor_id string, location_id string, snapshot_at timestamp_ntz, client_mac string, "
        "bssid string, ssid string, device_id string, username string, identity_source string, "
        "last_seen timestamp_ntz, first_seen timestamp_ntz, signal_dbm smallint, is_authorized bigint, "
        "created_at timestamp_ntz",
        ("sensor_id", "snapshot_at", "client_mac"),
        ("inventory_pk",),
    ),
    "wireless_probe_requests": (
        "probe_pk bigint, batch_id string, client_mac string, ssid string, known_bssid string, "
        "first_seen timestamp_ntz, last_seen timestamp_ntz, probe_count int, created_at timestamp_ntz",
        ("batch_id", "client_mac", "ssid"),
        ("probe_pk",),
    ),
    "sync_cursors": (
        "stream_name string, cursor_value string, updated_at timestamp_ntz",
        ("stream_name",),
        (),
    ),
    "sync_event_tombstones": (
        "dedupe_key string, stream_name string, expires_at timestamp_ntz, created_at timestamp_ntz",
        ("dedupe_key", "stream_name"),
        (),
    ),
    "sync_events": (
        "dedupe_key string, stream_name string, observed_at timestamp_ntz, payload_ref string, payload string, "
        "payload_sha256 string, status string, attempt_count int, last_error string, producer string, "
        "event_kind string, created_at timestamp_ntz, updated_at timestamp_ntz",
        ("dedupe_key", "stream_name"),
        (),
    ),
    "sync_jobs": (
        "job_id string, stream_name string, status string, attempt_count int, created_at timestamp_ntz, "
        "started_at timestamp_ntz, finished_at timestamp_ntz",
        ("job_id",),
        (),
    ),
    "sync_batches": (
        "batch_id string, job_id string, batch_no int, payload_ref string, status string, row_count int, "
        "checksum string, attempt_count int, last_error string, dedupe_key string, stream_name string, "
        "cursor_start string, cursor_end string, created_at timestamp_ntz, updated_at timestamp_ntz",
        ("batch_id",),
        (),
    ),
    "sync_errors": (
        "id bigint, job_id string, batch_id string, error_class string, error_text string, created_at timestamp_ntz",
        ("id",),
        ("id",),
    ),
    "devices": (
        "mac_id string, wg_pubkey string, claim_token_hash string, display_name string, username string, "
        "hostname string, os_hint string, mac_hint string, first_seen timestamp_ntz, last_seen timestamp_ntz, "
        "notes string",
        ("mac_id",),
        (),
    ),
    "wireless_authorized_networks": (
        "id bigint, ssid string, bssid string, location_id string, label string, enabled boolean, notes string, "
        "psk_ciphertext string, created_at timestamp_ntz, updated_at timestamp_ntz",
        ("id",),
        ("id",),
    ),
    "wireless_clients": (
        "ssid string, client_mac string, known_bssid string, first_seen timestamp_ntz, last_seen timestamp_ntz, "
        "probe_count bigint, location_id string, last_probe_batch_id string",
        ("ssid", "client_mac"),
        (),
    ),
    "wireless_shadow_alerts": (
        "source_mac string, first_occurred_at timestamp_ntz, last_occurred_at timestamp_ntz, occurrence_count bigint, "
        "destination_bssid string, ssid string, sensor_id string, location_id string, signal_dbm bigint, "
        "reason string, evidence string, resolved_at timestamp_ntz, created_at timestamp_ntz, "
        "updated_at timestamp_ntz",
        ("source_mac",),
        (),
    ),
    "wireless_alerts_ledger": (
        "ledger_id bigint, alert_type string, batch_id string, row_sequence int, alert_date date, "
        "detected_at timestamp_ntz, sensor_id string, location_id string, interface string, channel smallint, "
        "primary_mac string, secondary_mac string, ssid string, signal_dbm smallint, bytes bigint, "
        "details_json string, raw_json string, acknowledged bigint, ledger_action string, captured_at timestamp_ntz",
        ("ledger_id",),
        ("ledger_id",),
    ),
}


def table_names() -> list[str]:
    return list(_TABLES)


def table_schema(name: str) -> T.StructType:
    """Schema of a table; key and generated columns are marked in the field metadata."""
    ddl, keys, generated = _TABLES[name]
    schema = T.StructType()
    for f in T.StructType.fromDDL(ddl).fields:
        marks = {"pk": f.name in keys, "auto_inc": f.name in generated}
        schema.add(T.StructField(f.name, f.dataType, f.name not in keys, marks))
    return schema


def table_keys(name: str) -> tuple[str, ...]:
    return _TABLES[name][1]


TOPIC_RECORD = "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"

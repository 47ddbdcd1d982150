"""The ten row normalisers: exploded JSON rows -> typed rows with an ``error`` column.

Input rows carry ``batch_id``, ``pos``, ``raw`` (compact text) and ``row``
(VARIANT), as produced by ``sources.payload``.  Each target is a list of output
fields; the error of a row is that of its first bad required field.
"""

from __future__ import annotations

from collections.abc import Iterable

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_fields as J
from ..functions.hashing import uuid_from_md5
from ..functions.text import band_for_channel

Reader = Callable[[Column, str], tuple[Column, Column | None]]


@dataclass(frozen=True)
class Field:
    """One output column; ``read(row, context)`` gives its value and its error."""

    name: str
    read: Reader


def text(name: str, key: str | None = None) -> Field:
    return Field(name, lambda r, c: J.required_string(r, key or name, c))


def number(name: str, key: str | None = None) -> Field:
    return Field(name, lambda r, c: J.required_long(r, key or name, c))


def time(name: str, key: str | None = None) -> Field:
    return Field(name, lambda r, c: J.required_timestamp(r, key or name, c))


def maybe_text(name: str, *keys: str, default: str | None = None) -> Field:
    def read(r, _):
        values = [J.optional_string(r, k) for k in keys or (name,)]
        return J.first_of(values if default is None else [*values, F.lit(default)]), None

    return Field(name, read)


def maybe_number(name: str, *keys: str, default: int | None = None) -> Field:
    def read(r, _):
        values = [J.optional_long(r, k) for k in keys or (name,)]
        return J.first_of(values if default is None else [*values, F.lit(default).cast("bigint")]), None

    return Field(name, read)


def maybe_real(name: str, *keys: str) -> Field:
    return Field(name, lambda r, _: (J.first_of([J.optional_double(r, k) for k in keys or (name,)]), None))


def maybe_time(name: str, key: str | None = None) -> Field:
    return Field(name, lambda r, _: (J.optional_timestamp(r, key or name), None))


def either(kind: str, name: str, primary: str, secondary: str) -> Field:
    return Field(name, lambda r, c: J.alias(kind, r, primary, secondary, c))


def flag(name: str, key: str | None = None) -> Field:
    return Field(name, lambda r, _: (J.bool_flag(r, key or name), None))


def array_text(name: str) -> Field:
    return Field(name, lambda r, _: (J.json_array_string(r, name, F.col("raw")), None))


def raw_text() -> Field:
    return Field("raw_json", lambda r, _: (F.col("raw"), None))


PROXY_EVENTS = [
    text("event_type", "type"),
    text("host"),
    time("event_time", "time"),
    maybe_text("peer_ip"),
    maybe_text("wg_pubkey"),
    maybe_text("device_id"),
    maybe_text("identity_source", default="unknown"),
    maybe_text("peer_hostname"),
    maybe_text("client_ua"),
    maybe_number("bytes_up", default=0),
    maybe_number("bytes_down", default=0),
    maybe_number("status_code"),
    flag("blocked"),
    maybe_text("obfuscation_profile"),
    maybe_text("correlation_id"),
    maybe_text("parent_event_id"),
    maybe_number("event_sequence"),
    maybe_number("duration_ms"),
    maybe_text("reason"),
    raw_text(),
]

PAYLOAD_AUDIT = [
    Field(
        "correlation_id",
        lambda r, _: (
            F.coalesce(
                J.optional_string(r, "correlation_id"), uuid_from_md5(F.coalesce(F.col("raw"), F.lit("{}")))
            ),
            None,
        ),
    ),
    text("host"),
    Field("direction", lambda r, _: (F.upper(F.coalesce(J.optional_string(r, "direction"), F.lit("UP"))), None)),
    time("captured_at", "observed_at"),
    maybe_number("byte_offset", default=0),
    maybe_text("payload_object_key"),
    maybe_text("content_type"),
    maybe_text("http_method", "method"),
    maybe_number("http_status", "http_status", "status_code"),
    maybe_text("http_path", "path"),
    flag("is_encrypted"),
    flag("truncated"),
    maybe_text("peer_ip"),
    maybe_text("notes"),
]

AUDIT_FRAMES = [
    text("event_type"),
    time("observed_at"),
    text("sensor_id"),
    text("location_id"),
    text("interface"),
    number("channel"),
    maybe_text("frame_type"),
    text("frame_subtype"),
    *[
        maybe_text(n)
        for n in (
            "bssid",
            "source_mac",
            "destination_mac",
            "transmitter_mac",
            "receiver_mac",
            "destination_bssid",
            "ssid",
        )
    ],
    maybe_number("signal_dbm"),
    maybe_number("sequence_number"),
    number("raw_len"),
    flag("is_retry", "retry"),
    flag("is_more_data", "more_data"),
    flag("is_power_save", "power_save"),
    flag("is_protected", "protected"),
    flag("is_to_ds", "to_ds"),
    flag("is_from_ds", "from_ds"),
    flag("is_handshake", "handshake_captured"),
    maybe_number("security_flags", default=0),
    maybe_text("device_id"),
    maybe_text("username"),
    maybe_text("identity_source", default="unknown"),
    array_text("tags"),
    array_text("anomaly_reasons"),
    raw_text(),
    maybe_text("reg_domain"),
]

BANDWIDTH = [
    maybe_number("schema_version", default=1),
    time("window_start"),
    time("window_end"),
    text("sensor_id"),
    text("location_id"),
    text("interface"),
    number("channel"),
    text("source_mac"),
    text("destination_bssid"),
    maybe_text("ssid"),
    number("bytes"),
    number("frame_count"),
    maybe_number("retry_count", default=0),
    maybe_number("more_data_count", default=0),
    maybe_number("power_save_count", default=0),
    maybe_number("strongest_signal_dbm"),
    maybe_number("hist_under_100", "frame_size_histogram.under_100", default=0),
    maybe_number("hist_100_500", "frame_size_histogram.range_100_500", default=0),
    maybe_number("hist_500_1000", "frame_size_histogram.range_500_1000", default=0),
    maybe_number("hist_1000_1500", "frame_size_histogram.range_1000_1500", default=0),
    maybe_number("inter_arrival_p50_ms"),
    flag("external_bssid"),
    flag("threshold_exceeded"),
    maybe_number("wall_clock_delta_ms"),
    flag("window_is_partial"),
    maybe_time("published_at"),
    # the window's calendar day in the sensor's own offset, lost once the time is UTC
    Field("local_day", lambda r, _: (F.substring(J.string_value(r, "window_start"), 1, 10).try_cast("date"), None)),
]

_ALERT_HEAD = [either("timestamp", "detected_at", "detected_at", "observed_at"), text("sensor_id"), text("location_id")]

ROGUE_AP = [
    *_ALERT_HEAD,
    text("interface"),
    number("channel"),
    either("string", "rogue_bssid", "rogue_bssid", "bssid"),
    maybe_text("ssid"),
    maybe_number("signal_dbm"),
    Field(
        "ssid_impersonation",
        lambda r, _: (
            F.greatest(
                J.bool_flag(r, "ssid_impersonation"),
                J.reason_flag(r, "reasons", ["ssid_impersonation", "bssid_spoofing"]),
            ),
            None,
        ),
    ),
    raw_text(),
]

DEAUTH_FLOOD = [
    *_ALERT_HEAD,
    text("interface"),
    maybe_number("channel", default=0),
    maybe_text("attacker_mac", "attacker_mac", "source_mac"),
    maybe_text("target_bssid", "target_bssid", "bssid"),
    maybe_text("target_ssid", "target_ssid", "ssid"),
    either("long", "deauth_count", "deauth_count", "frame_count"),
    number("window_secs"),
    maybe_number("threshold", default=0),
    maybe_number("signal_dbm"),
    raw_text(),
]


def _magnitude(name: str) -> Field:
    def read(r, c):
        value, error = J.required_long(r, name, c)
        return F.abs(value), error

    return Field(name, read)


SIGNAL_ANOMALY = [
    *_ALERT_HEAD,
    text("source_mac"),
    maybe_text("bssid"),
    maybe_text("ssid"),
    number("channel"),
    number("baseline_dbm"),
    number("observed_dbm"),
    _magnitude("dbm_delta"),
    number("configured_delta"),
]

PMF_ATTACK = [
    *_ALERT_HEAD,
    either("string", "target_mac", "target_mac", "source_mac"),
    maybe_text("target_bssid", "target_bssid", "bssid"),
    maybe_text("ssid"),
    maybe_number("channel"),
    text("attack_tag"),
    maybe_number("reconnect_window_ms"),
]

CLIENT_INVENTORY = [
    # merged with the parent object by the payload step
    Field("sensor_id", lambda r, c: J.required_string(F.col("head"), "sensor_id", c)),
    Field("location_id", lambda r, c: J.required_string(F.col("head"), "location_id", c)),
    Field("snapshot_at", lambda r, c: J.required_timestamp(F.col("head"), "snapshot_at", c)),
    either("string", "client_mac", "client_mac", "source_mac"),
    maybe_text("bssid"),
    maybe_text("ssid"),
    maybe_text("device_id"),
    maybe_text("username"),
    maybe_text("identity_source"),
    time("last_seen"),
    time("first_seen"),
    maybe_number("signal_dbm", "signal_dbm", "last_signal_dbm"),
    flag("is_authorized"),
]

PROBE_REQUESTS = [
    text("client_mac"),
    text("ssid"),
    maybe_text("known_bssid"),
    time("first_seen"),
    time("last_seen"),
    number("probe_count"),
]

FIELDS = {
    "proxy.events": PROXY_EVENTS,
    "proxy.payload_audit": PAYLOAD_AUDIT,
    "wireless.audit": AUDIT_FRAMES,
    "audit.wireless.bandwidth": BANDWIDTH,
    "wireless.alert.rogue_ap": ROGUE_AP,
    "wireless.alert.deauth_flood": DEAUTH_FLOOD,
    "wireless.alert.signal_anomaly": SIGNAL_ANOMALY,
    "wireless.alert.pmf_attack": PMF_ATTACK,
    "wireless.client.inventory": CLIENT_INVENTORY,
    "wireless.probe.flush": PROBE_REQUESTS,
}

def _derived(target: str) -> dict[str, Column]:
    """Columns that follow from the parsed ones."""
    if target == "proxy.events":
        return {"event_timestamp_utc": F.date_trunc("millisecond", "event_time").cast("timestamp_ntz")}
    if target in ("wireless.audit", "audit.wireless.bandwidth"):
        return {"band": band_for_channel(F.col("channel"))}
    if target == "wireless.client.inventory":
        return {"created_at": F.col("snapshot_at")}
    if target == "wireless.probe.flush":
        return {"created_at": F.col("first_seen")}
    return {}


def row_sequence(target: str) -> Column:
    """Position of a row in its batch: from 1 for proxy events, else from 0."""
    return (F.col("pos") + F.lit(1 if target == "proxy.events" else 0)).cast("bigint")


def normalize(rows: DataFrame, target: str, keep: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Typed rows of one target: ``keep`` columns, ``row_sequence``, fields, ``error``."""
    members = J.Members()
    read = [(f.name, *f.read(members, target)) for f in FIELDS[target]]
    errors = [e for _, _, e in read if e is not None]
    if "row_error" in rows.columns:
        errors.insert(0, F.col("row_error"))
    out = members.split(rows, F.col("row")).select(
        *keep,
        row_sequence(target).alias("row_sequence"),
        *[value.alias(name) for name, value, _ in read],
        J.first_error(errors).alias("error"),
        *(["row"] if target == "proxy.events" else []),
    )
    extra = _derived(target)
    return out.withColumns(extra) if extra else out


def valid_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("error").isNull()).drop("error")


def invalid_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("error").isNotNull())


def batch_errors(df: DataFrame) -> DataFrame:
    """First error of each batch that has one, for the all-or-nothing reading of a batch."""
    bad = invalid_rows(df)
    return bad.groupBy("batch_id").agg(F.min_by("error", "row_sequence").alias("batch_error"))


def strict_rows(df: DataFrame) -> DataFrame:
    """Rows of the batches in which every row is good."""
    failed = batch_errors(df).select("batch_id")
    return valid_rows(df).join(failed, "batch_id", "left_anti")


def extract_blocked(proxy_rows: DataFrame, context: str = "proxy blocked rollup", keep: Iterable[str] = ()) -> DataFrame:
    """Blocked-host facts of normalised proxy rows that carry the ``blocked`` flag.

    The byte count falls back to up + down; a sum beyond 64 bits is an error.
    """
    r = J.Members()
    total = F.try_add(F.col("bytes_up"), F.col("bytes_down"))
    stated = J.first_of(
        [
            J.optional_long(r, k)
            for k in ("blocked_bytes", "metrics.blocked_bytes", "metrics.total_blocked_bytes_approx")
        ]
    )
    real = lambda key: J.first_of([J.optional_double(r, key), J.optional_double(r, f"metrics.{key}")])
    value = F.coalesce(stated, total)
    columns = [
        *keep,
        "batch_id",
        (F.col("row_sequence") - 1).alias("row_sequence"),
        "host",
        "event_time",
        value.alias("blocked_bytes"),
        real("frequency_hz").alias("frequency_hz"),
        real("risk_score").alias("risk_score"),
        J.optional_string(r, "category").alias("category"),
        F.coalesce(J.optional_string(r, "verdict"), F.lit("BLOCKED")).alias("verdict"),
        F.coalesce(J.optional_long(r, "tarpit_held_ms"), F.lit(0).cast("bigint")).alias("tarpit_held_ms"),
        J.first_of([J.optional_long(r, "iat_ms"), J.optional_long(r, "metrics.iat_ms")]).alias("iat_ms"),
        J.first_of(
            [
                J.optional_long(r, k)
                for k in ("consecutive_blocks", "metrics.consecutive_blocks", "attempt_count", "metrics.attempt_count")
            ]
        ).alias("consecutive_blocks"),
        J.optional_string(r, "last_verdict").alias("last_verdict"),
        *[J.optional_string(r, f"fingerprint.{k}").alias(k) for k in ("tls_ver", "alpn", "ja3_lite")],
        J.optional_string(r, "resolved_ip").alias("resolved_ip"),
        J.optional_string(r, "asn_org").alias("asn_org"),
        F.coalesce(
            F.col("error"), F.when(value.isNull(), F.lit(f"long overflow in {context}"))
        ).alias("error"),
    ]
    return r.split(proxy_rows.filter(F.col("blocked") != 0), F.col("row")).select(*columns)


def input_row_count(df: DataFrame) -> DataFrame:
    """Rows per target and batch."""
    return df.groupBy("target", "batch_id").agg(F.count("*").alias("row_count"))

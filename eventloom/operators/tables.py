"""Upserts of the individual tables: their keys and per-column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timestamps import as_utc, parse_lenient_timestamp
from ..schemas import PRODUCER
from . import merge as M
from .filters import filter_scan_valid
from .ordering import consecutive_counts

BATCH_ROW = ["batch_id", "row_sequence"]

# Keys of the insert-only fact tables.
FACT_KEYS = {
    "proxy_events": BATCH_ROW,
    "proxy_payload_audit": ["correlation_id", "host", "direction", "captured_at", "byte_offset"],
    "wireless_audit_frames": BATCH_ROW,
    "wireless_bandwidth_windows": BATCH_ROW,
    "wireless_probe_requests": ["batch_id", "client_mac", "ssid"],
}


def upsert_proxy_events(target: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    return M.insert_ignore(target, batch, BATCH_ROW, order)


def upsert_audit_frames(target: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    return M.insert_ignore(target, batch, BATCH_ROW, order)


def upsert_bandwidth(target: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    return M.insert_ignore(target, batch, BATCH_ROW, order)


def upsert_probe_requests(target: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    return M.insert_ignore(target, batch, FACT_KEYS["wireless_probe_requests"], order)


def append_payload_audit(target: DataFrame, batch: DataFrame, order: list[str], on_duplicate: str = "error") -> DataFrame:
    return M.append_unique(target, batch, FACT_KEYS["proxy_payload_audit"], order, on_duplicate)


def payload_audit_duplicates(target: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """The batch with ``duplicate``: the key is stored already, or an earlier row of the batch has it."""
    keys = FACT_KEYS["proxy_payload_audit"]
    held = M.held_keys(target, batch, keys).withColumn("_held", F.lit(True))
    first = batch.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    marked = batch.join(first, keys).join(held, keys, "left")
    taken = F.coalesce(F.col("_held"), F.lit(False)) | (F.struct(*order) != F.col("_first"))
    return marked.select(*batch.columns, taken.alias("duplicate"))


def sensor_first_in_batch(frames: DataFrame, order: list[str]) -> DataFrame:
    """Per batch and sensor its earliest frame; of equally early ones the last in the batch."""
    place = F.struct(F.col("observed_at"), -F.col("row_sequence"))
    first = frames.groupBy("batch_id", "sensor_id").agg(
        F.min_by(F.struct("location_id", "interface", "reg_domain", "observed_at"), place).alias("_f"),
        F.max("observed_at").alias("latest_at"),
        F.max(F.struct(*order)).alias("last_place"),
    )
    return first.select("batch_id", "sensor_id", "_f.*", "latest_at", "last_place")


def upsert_sensors(target: DataFrame, frames: DataFrame, order: list[str], compat: bool = False, narrowed: bool = False) -> DataFrame:
    """Sensor inventory; everything but ``first_seen_at`` follows the newest batch.

    ``last_seen_at`` is the latest frame time of the batch; ``compat`` uses the
    time of its earliest frame.  ``order`` orders the frames over all batches.
    """
    batch = sensor_first_in_batch(frames, order).select(
        "sensor_id",
        "location_id",
        "interface",
        "reg_domain",
        F.col("observed_at").alias("first_seen_at"),
        F.col("observed_at" if compat else "latest_at").alias("last_seen_at"),
        "last_place",
    )
    rules = {
        "location_id": M.replace,
        "interface": M.replace,
        "reg_domain": M.replace,
        "first_seen_at": M.keep,
        "last_seen_at": M.replace,
    }
    return M.merge(target, batch, ["sensor_id"], rules, ["last_place"], narrowed=narrowed)


def upsert_client_inventory(target: DataFrame, batch: DataFrame, order: list[str], narrowed: bool = False) -> DataFrame:
    keys = ["sensor_id", "snapshot_at", "client_mac"]
    replaced = [
        "location_id",
        "bssid",
        "ssid",
        "device_id",
        "username",
        "identity_source",
        "last_seen",
        "first_seen",
        "signal_dbm",
        "is_authorized",
    ]
    return M.merge(target, batch, keys, {**dict.fromkeys(replaced, M.replace), "created_at": M.keep}, order, narrowed=narrowed)


ALERT_KEY = ["alert_type", "batch_id", "row_sequence"]
UNSEEN = {"acknowledged": 0}
ALERT_REPLACED = [
    "detected_at",
    "sensor_id",
    "location_id",
    "interface",
    "channel",
    "primary_mac",
    "secondary_mac",
    "ssid",
    "signal_dbm",
    "details_json",
    "raw_json",
    "updated_at",
]


def upsert_alerts(target: DataFrame, batch: DataFrame, order: list[str], narrowed: bool = False) -> DataFrame:
    rules = {**dict.fromkeys(ALERT_REPLACED, M.replace), "created_at": M.keep}
    return M.merge(target, batch, ALERT_KEY, rules, order, nulls_distinct=True, defaults=UNSEEN, narrowed=narrowed)


def upsert_bandwidth_alerts(
    target: DataFrame, batch: DataFrame, order: list[str], key: str = "batch", narrowed: bool = False
) -> DataFrame:
    """Bandwidth alerts; date, sensor and addresses of a stored alert are kept.

    ``key="day"`` merges the alerts of one sensor, address pair and day over all
    batches instead of within one batch.
    """
    kept = ["alert_date", "sensor_id", "primary_mac", "secondary_mac", "signal_dbm", "created_at"]
    replaced = ["detected_at", "location_id", "ssid", "bytes", "details_json", "updated_at"]
    if key == "day":
        keys = ["alert_type", "sensor_id", "primary_mac", "secondary_mac", "alert_date"]
        replaced += ["batch_id", "row_sequence"]
        kept = ["signal_dbm", "created_at"]
    else:
        keys = ALERT_KEY
    rules = {**dict.fromkeys(replaced, M.replace), **dict.fromkeys(kept, M.keep)}
    return M.merge(target, batch, keys, rules, order, nulls_distinct=True, defaults=UNSEEN, narrowed=narrowed)


LAST_STATED = ["frequency_hz", "verdict", "category", "risk_score", "iat_ms", "tls_ver", "alpn", "ja3_lite", "resolved_ip", "asn_org"]


def _rollup(blocked: DataFrame, order: list[str]) -> DataFrame:
    seq = F.struct(*order)
    stated = lambda c: F.max_by(c, F.when(c.isNotNull(), seq))
    totals = blocked.groupBy("host").agg(
        F.count("*").alias("blocked_attempts"),
        F.sum("blocked_bytes").alias("blocked_bytes"),
        F.sum(F.coalesce("tarpit_held_ms", F.lit(0))).alias("tarpit_held_ms"),
        *[stated(F.col(c)).alias(c) for c in LAST_STATED],
        *_verdicts(seq),
    )
    streaks = consecutive_counts(blocked, ["host"], order, "consecutive_blocks", "consecutive_blocks")
    return totals.join(streaks, "host")


def blocked_host_rollup(blocked: DataFrame, order: list[str]) -> DataFrame:
    """Per host: attempts, bytes, held time, last stated attributes and the block streak."""
    return _rollup(blocked, order).drop("known_verdict")


def _verdicts(seq: Column) -> list[Column]:
    """The final verdict of a host, from its rows in order.

    A host's first row counts with its stated last verdict only, later ones also with
    their verdict; ``known_verdict`` is the result if the host was known before.
    """
    value = F.coalesce("last_verdict", "verdict")
    stated = F.when(value.isNotNull(), seq)
    known = F.max_by(value, stated)
    first = F.max(stated) == F.min(seq)
    return [F.when(first, F.min_by("last_verdict", seq)).otherwise(known).alias("last_verdict"), known.alias("known_verdict")]


def last_verdict(blocked: DataFrame, order: list[str]) -> DataFrame:
    """``host, last_verdict`` of hosts that were not known before."""
    return blocked.groupBy("host").agg(*_verdicts(F.struct(*order))).drop("known_verdict")


def upsert_blocked_rollup(target: DataFrame, blocked: DataFrame, order: list[str], as_of) -> DataFrame:
    """Add a batch of blocked events to the per-host table.

    The batch is first reduced to one row per host, then combined with the
    stored row, so the table side of the join has unique keys.
    """
    now = as_utc(as_of)
    delta = _rollup(blocked, order)
    held = target.join(M.distinct_keys(delta, ["host"]), "host", "left_semi")
    old = held.select(*[F.col(c) if c == "host" else F.col(c).alias(f"_{c}") for c in target.columns])
    both = delta.join(old, "host", "left")
    known = F.col("_blocked_attempts").isNotNull()
    streak = F.coalesce("consecutive_blocks", F.col("_consecutive_blocks") + F.col("blocked_attempts"))
    combined = {
        "blocked_attempts": F.col("blocked_attempts") + F.coalesce("_blocked_attempts", F.lit(0)),
        "blocked_bytes": F.col("blocked_bytes") + F.coalesce("_blocked_bytes", F.lit(0)),
        "tarpit_held_ms": F.col("tarpit_held_ms") + F.coalesce("_tarpit_held_ms", F.lit(0)),
        "consecutive_blocks": F.when(known, streak).otherwise(F.col("consecutive_blocks")),
        "last_verdict": F.when(known, F.coalesce("known_verdict", "_last_verdict")).otherwise(F.col("last_verdict")),
        "updated_at": now,
        "first_seen": F.coalesce("_first_seen", now),
        **{c: F.coalesce(c, f"_{c}") for c in LAST_STATED},
    }
    # the table's frequency is NOT NULL: a new host without one starts at 0
    combined["frequency_hz"] = F.coalesce(combined["frequency_hz"], F.lit(0))
    merged = both.select("host", *[e.cast(target.schema[c].dataType).alias(c) for c, e in combined.items()])
    rest = target.join(M.distinct_keys(delta, ["host"]), "host", "left_anti")
    return rest.select("host", *combined).unionByName(merged)


def upsert_scan_requests(
    target: DataFrame, requests: DataFrame, order: list[str], as_of, compat: bool = False, narrowed: bool = False
) -> DataFrame:
    """Ledger upsert of decoded requests.

    The first valid request of each key in the batch counts; ``compat`` lets an
    invalid first request hide later ones of its key.  A failed or pending event
    becomes pending again, any other status stays.
    """
    keys = ["dedupe_key", "stream_name"]
    if compat:
        first = filter_scan_valid(M.first_per_key(requests, keys, order))
    else:
        first = M.first_per_key(filter_scan_valid(requests), keys, order)
    now = as_utc(as_of)
    batch = first.select(
        *keys,
        parse_lenient_timestamp(F.nullif(F.col("observed_text"), F.lit(""))).alias("observed_at"),
        "payload_ref",
        "payload",
        "payload_sha256",
        F.lit("pending").alias("status"),
        F.lit(0).alias("attempt_count"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit(PRODUCER).alias("producer"),
        "event_kind",
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    reopened = ("pending", "failed")

    def status(value, seq, side):
        before = F.max(F.when(side == 0, value))
        return F.when(before.isNotNull() & ~before.isin(*reopened), before).otherwise(F.lit("pending"))

    def last_error(value, seq, side):
        before, state = F.max(F.when(side == 0, value)), F.max(F.when(side == 0, F.col("status")))
        return F.when(state.isNotNull() & ~state.isin(*reopened), before)

    rules = {
        "observed_at": M.last_non_null,
        "payload_ref": M.replace,
        "payload": M.last_non_null,
        "payload_sha256": M.replace,
        "status": status,
        "attempt_count": M.keep,
        "last_error": last_error,
        "producer": M.replace,
        "event_kind": M.keep,
        "created_at": M.keep,
        "updated_at": M.replace,
    }
    merged = M.merge(target.select(*keys, *rules), batch, keys, rules, keys, narrowed=narrowed)
    return merged.withColumn("observed_at", F.coalesce("observed_at", now))


MESSAGES_PER_RUN = 65_536  # messages whose runs one row of a client summarises


def _message_range(probes: DataFrame) -> Column:
    """The range of ``MESSAGES_PER_RUN`` message numbers a message lies in, in the order of the messages."""
    kind = probes.schema["message_no"].dataType
    if not isinstance(kind, T.StructType):
        return F.expr(f"message_no div {MESSAGES_PER_RUN}")
    *before, last = [f"message_no.{n}" for n in kind.fieldNames()]
    return F.struct(*before, F.expr(f"{last} div {MESSAGES_PER_RUN}").alias("n"))


def _counted(runs: Column, skip: int, batch: str, last: str, amount: str) -> Column:
    """Sum of ``amount`` over the entries from ``skip`` on that do not go on with the batch of the entry before."""

    def added(entry: Column, place: Column) -> Column:
        before = F.get(runs, place - 1)[last]
        starts = F.coalesce(before != entry[batch], before.isNull())
        return F.when((place >= skip) & starts, F.coalesce(entry[amount], F.lit(0))).otherwise(F.lit(0))

    return F.aggregate(F.transform(runs, added), F.lit(0).cast("bigint"), lambda total, x: total + x)


def wireless_client_deltas(probes: DataFrame, order: list[str]) -> DataFrame:
    """Per client: seen range, last stated attributes, and its messages as one run summary.

    Several rows of one client in one message count once, and so does a message delivered again
    right after itself; the others add up. A summary (``first_batch``, what its first message adds,
    what the later ones add, ``last_batch``) can be joined to the one before it: what the first message
    adds drops out if that one ends in the same batch. So a client's messages are summarised in ranges
    of message numbers, and a client with a third of all rows is many groups of bounded size.
    ``message_no`` is a whole number, or a struct that ends in one.
    """
    keys = ["ssid", "client_mac"]
    stated = lambda c, seq: F.max_by(c, F.when(F.col(c).isNotNull(), seq)).alias(c)
    seen = [F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")]
    rows = probes.withColumn("_range", _message_range(probes)).repartition(*keys, "_range")
    seq = F.struct(*order)
    messages = rows.groupBy(*keys, "_range", "message_no", "batch_id").agg(
        *seen, F.min_by("probe_count", seq).cast("bigint").alias("n"), stated("known_bssid", seq), stated("location_id", seq)
    )
    entries = F.sort_array(F.collect_list(F.struct("message_no", "batch_id", "n"))).alias("_runs")
    ranges = messages.groupBy(*keys, "_range").agg(
        *seen, entries, stated("known_bssid", F.col("message_no")), stated("location_id", F.col("message_no"))
    )
    ends = F.struct(
        "_range",
        F.get("_runs", F.lit(0))["batch_id"].alias("first_batch"),
        F.get("_runs", F.lit(0))["n"].alias("first_n"),
        _counted(F.col("_runs"), 1, "batch_id", "batch_id", "n").alias("later_n"),
        F.element_at("_runs", -1)["batch_id"].alias("last_batch"),
    )
    parts = ranges.select(*keys, "_range", "first_seen", "last_seen", "known_bssid", "location_id", ends.alias("_part"))
    clients = parts.groupBy(*keys).agg(
        *seen,
        F.sort_array(F.collect_list("_part")).alias("_parts"),
        stated("known_bssid", F.col("_range")),
        stated("location_id", F.col("_range")),
    )
    within = F.aggregate("_parts", F.lit(0).cast("bigint"), lambda total, part: total + part["later_n"])
    between = _counted(F.col("_parts"), 1, "first_batch", "last_batch", "first_n")
    return clients.select(
        *keys,
        "first_seen",
        "last_seen",
        F.get("_parts", F.lit(0))["first_batch"].alias("first_batch"),
        F.coalesce(F.get("_parts", F.lit(0))["first_n"], F.lit(0)).alias("first_n"),
        (within + between).alias("later_n"),
        F.element_at("_parts", -1)["last_batch"].alias("last_batch"),
        "known_bssid",
        "location_id",
    )


def upsert_wireless_clients(target: DataFrame, probes: DataFrame, order: list[str]) -> DataFrame:
    """Client inventory from probe rows ``(message_no, batch_id, pos, ssid, client_mac, ...)``.

    One pass over the batch and one over ``target``, which a stored table narrows to the batch's clients.
    """
    keys = ["ssid", "client_mac"]
    new = wireless_client_deltas(probes, order).alias("new")
    old = target.alias("old")
    both = old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys], "full")
    fresh = F.col("new.first_n").isNotNull()  # the client is in the batch
    goes_on = F.col("old.last_probe_batch_id").isNotNull() & ~F.coalesce(
        F.col("old.last_probe_batch_id") != F.col("new.first_batch"), F.lit(False)
    )
    added = F.when(goes_on, F.lit(0)).otherwise(F.col("new.first_n")) + F.col("new.later_n")
    either = lambda c: F.coalesce(f"new.{c}", f"old.{c}").alias(c)
    return both.select(
        *[either(k) for k in keys],
        either("known_bssid"),
        F.least("old.first_seen", "new.first_seen").alias("first_seen"),
        F.greatest("old.last_seen", "new.last_seen").alias("last_seen"),
        F.when(fresh, F.coalesce("old.probe_count", F.lit(0)) + added).otherwise(F.col("old.probe_count")).alias("probe_count"),
        either("location_id"),
        F.when(fresh, F.col("new.last_batch")).otherwise(F.col("old.last_probe_batch_id")).alias("last_probe_batch_id"),
    )


def upsert_shadow_alerts(target: DataFrame, alerts: DataFrame, as_of, narrowed: bool = False) -> DataFrame:
    """Shadow-device table from detected frames, each counted once."""
    keys = ["source_mac"]
    now = as_utc(as_of)
    batch = alerts.select(
        "source_mac",
        F.col("observed_at").alias("first_occurred_at"),
        F.col("observed_at").alias("last_occurred_at"),
        F.lit(1).cast("bigint").alias("occurrence_count"),
        *SHADOW_ATTRIBUTES,
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    rules = {
        "first_occurred_at": M.least,  # a late frame moves it back
        "last_occurred_at": M.greatest,
        "occurrence_count": M.count,
        **{c: M.newest("last_occurred_at") for c in SHADOW_ATTRIBUTES},
        "created_at": M.keep,
        "updated_at": M.replace,
    }
    return M.merge(target, batch, keys, rules, ["first_occurred_at", *SHADOW_ATTRIBUTES], narrowed=narrowed)


SHADOW_ATTRIBUTES = ["destination_bssid", "ssid", "sensor_id", "location_id", "signal_dbm"]


def upsert_cursors(target: DataFrame, streams: DataFrame, as_of) -> DataFrame:
    """Ensure a cursor per stream: ``'0'`` when new, else only ``updated_at`` moves."""
    batch = streams.select(
        "stream_name", F.lit("0").alias("cursor_value"), as_utc(as_of).alias("updated_at")
    ).distinct()
    rules = {"cursor_value": M.keep, "updated_at": M.replace}
    return M.merge(target, batch, ["stream_name"], rules, ["stream_name"])


def upsert_generic(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str], narrowed: bool = False) -> DataFrame:
    """Replace every other column of the keyed rows; append when there is nothing to replace."""
    others = [c for c in target.columns if c not in keys]
    if not others:
        return append_keys(target, batch, keys, order)
    merged = M.merge(target, batch, keys, dict.fromkeys(others, M.replace), order, narrowed=narrowed)
    return merged.select(*target.columns)


def append_keys(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return M.append_unique(target, batch, keys, order)


def alerts_ledger(before: DataFrame, after: DataFrame, as_of) -> DataFrame:
    """Log of the alert rows that the merge at ``as_of`` inserted or updated.

    ``after`` is the table that merge returned; its rows are recognised by their
    ``updated_at``.  An alert without a full key never updates another one.
    """
    now = as_utc(as_of)
    changed = after.filter(F.col("updated_at") == now)
    held = M.held_keys(before, changed, ALERT_KEY).withColumn("_held", F.lit(True))
    action = F.when(F.col("_held"), "update").otherwise("insert")
    columns = [c for c in after.columns if c not in ("created_at", "updated_at")]
    joined = changed.join(held, ALERT_KEY, "left")
    return joined.select(*columns, action.alias("ledger_action"), now.alias("captured_at"))

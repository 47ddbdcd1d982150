"""Shadow-device detection, network authorisation and probe clients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_fields import json_text_field
from ..functions.text import is_mac, normalize_bssid
from ..functions.timestamps import seconds_before
from ..session import durable
from .filters import filter_enabled_networks, filter_mac_valid, filter_recent_strong, filter_reply_topic
from .ordering import numbered

_WHERE = ("location_id", "ssid", "bssid")  # what a network may fix; NULL means any


def frames_from_ledger(ledger: DataFrame, stream: str = "wireless.audit") -> DataFrame:
    """Wireless frames out of the stored payloads of one stream."""
    p = F.col("payload")
    field = lambda name: json_text_field(p, name)
    return ledger.filter((F.col("stream_name") == stream) & p.isNotNull()).select(
        F.lower(field("source_mac")).alias("source_mac"),
        "observed_at",
        normalize_bssid(field("destination_bssid"), field("bssid")).alias("destination_bssid"),
        field("ssid").alias("ssid"),
        field("sensor_id").alias("sensor_id"),
        field("location_id").alias("location_id"),
        field("signal_dbm").try_cast("bigint").alias("signal_dbm"),
    )


def distinct_frames(frames: DataFrame) -> DataFrame:
    return frames.select(
        "source_mac", "observed_at", "destination_bssid", "ssid", "sensor_id", "location_id", "signal_dbm"
    ).distinct()


def authorized_places(places: DataFrame, networks: DataFrame) -> DataFrame:
    """Distinct places (location, ssid, bssid) that some enabled network covers.

    A network fixes any subset of the three columns.  Each place is offered once
    per subset, as the key a network with that subset would have, so that the
    wildcard test becomes one equi semi-join for any number of networks.
    """

    def masked(mask: Column, name: str) -> Column:
        bit = 1 << _WHERE.index(name)
        return F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.col(name))

    fixed = sum((F.when(F.col(n).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(_WHERE)), F.lit(0))
    rules = filter_enabled_networks(networks).select(fixed.alias("_mask"), *_WHERE).distinct()
    mask = F.col("_mask")
    offers = places.withColumn("_mask", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("_has", fixed)
    # a subset that names a column the place does not know cannot match
    offers = offers.filter(mask.bitwiseAND(F.col("_has")) == mask)
    keys = offers.select(*_WHERE, "_mask", *[masked(mask, n).alias(f"_{n}") for n in _WHERE])
    same = keys["_mask"] == rules["_mask"]
    for n in _WHERE:
        same = same & keys[f"_{n}"].eqNullSafe(rules[n])
    return keys.join(rules, same, "left_semi").select(*_WHERE).distinct()


def unauthorized_frames(frames: DataFrame, networks: DataFrame) -> DataFrame:
    """Frames that no enabled network covers; NULL columns of a network match anything."""
    place = [F.col("location_id"), F.col("ssid"), F.col("destination_bssid").alias("bssid")]
    covered = authorized_places(frames.select(*place).distinct(), networks)
    same = (
        frames["location_id"].eqNullSafe(covered["location_id"])
        & frames["ssid"].eqNullSafe(covered["ssid"])
        & frames["destination_bssid"].eqNullSafe(covered["bssid"])
    )
    return frames.join(covered, same, "left_anti")


def absent_devices(frames: DataFrame, devices: DataFrame, as_of, presence_seconds: int = 300) -> DataFrame:
    """Frames whose address belongs to no device seen within the presence window."""
    present = devices.filter(F.col("last_seen") >= seconds_before(as_of, presence_seconds)).select("mac_id").distinct()
    return frames.join(present, frames["source_mac"] == present["mac_id"], "left_anti")


def shadow_frames(
    frames: DataFrame,
    networks: DataFrame,
    devices: DataFrame,
    as_of,
    window_seconds: int = 60,
    signal_threshold: int = -50,
    presence_seconds: int = 300,
) -> DataFrame:
    """Distinct strong recent frames of unknown devices outside the authorised networks."""
    strong = filter_recent_strong(filter_mac_valid(frames), as_of, window_seconds, signal_threshold, payload=None)
    unknown = absent_devices(distinct_frames(strong), devices, as_of, presence_seconds)
    return unauthorized_frames(unknown, networks)


def shadow_frames_at(
    frames: DataFrame, seen: DataFrame, late: str = "1 hour", signal_threshold: int = -50, presence_seconds: int = 300
) -> DataFrame:
    """Distinct strong frames whose device was not seen in the ``presence_seconds`` before them.

    ``frames`` and ``seen`` (``mac_id, last_seen``: one row whenever a device is seen) are streams, or
    tables. As streams both may be ``late``; repeated frames are dropped and unmatched ones given out
    in state that is bounded by it. A frame is judged when both streams have passed its time, so rows
    of null address that only carry a time let a quiet stream go on.
    """
    names = ["source_mac", "observed_at", "destination_bssid", "ssid", "sensor_id", "location_id", "signal_dbm"]
    timed = frames.select(*[c for c in names if c != "observed_at"], F.col("observed_at").cast("timestamp").alias("_at")).withWatermark("_at", late)
    # conditions that name the time are not moved below the watermark, which all rows are to move on
    strong = timed.filter(F.when(F.col("_at").isNotNull(), is_mac(F.col("source_mac")) & (F.col("signal_dbm") >= signal_threshold)))
    one = strong.dropDuplicates([*[c for c in names if c != "observed_at"], "_at"])
    mac = F.coalesce("mac_id", F.lit(""))  # matches no frame
    there = seen.select(mac.alias("_mac"), F.col("last_seen").cast("timestamp").alias("_seen")).withWatermark("_seen", late)
    near = (F.col("_seen") <= F.col("_at")) & (F.col("_seen") >= F.col("_at") - F.expr(f"INTERVAL {int(presence_seconds)} SECONDS"))
    met = one.join(there, (F.col("source_mac") == F.col("_mac")) & near, "left")
    unseen = met.filter(F.col("_mac").isNull())
    return unseen.select(*[F.col("_at").cast("timestamp_ntz").alias(c) if c == "observed_at" else F.col(c) for c in names])


SHADOW_REASON = "strong_wireless_without_proxy_presence"


def shadow_alerts(detected: DataFrame) -> DataFrame:
    """One row per address: first and last time, number of frames, attributes of the latest frame."""
    attributes = ["destination_bssid", "ssid", "sensor_id", "location_id", "signal_dbm"]
    latest = F.struct("observed_at", *attributes)
    grouped = detected.groupBy("source_mac").agg(
        F.min("observed_at").alias("first_occurred_at"),
        F.max("observed_at").alias("last_occurred_at"),
        F.count("*").alias("occurrence_count"),
        F.max_by(F.struct(*attributes), latest).alias("_last"),
    )
    return grouped.select(
        "source_mac",
        "first_occurred_at",
        "last_occurred_at",
        "occurrence_count",
        *[F.col(f"_last.{c}").alias(c) for c in attributes],
        F.lit(SHADOW_REASON).alias("reason"),
    )


EVIDENCE = "window_seconds int, signal_threshold_dbm int, presence_window_seconds int"


def shadow_evidence(window_seconds: int = 60, signal_threshold: int = -50, presence_seconds: int = 300) -> Column:
    return F.to_json(
        F.struct(
            F.lit(window_seconds).alias("window_seconds"),
            F.lit(signal_threshold).alias("signal_threshold_dbm"),
            F.lit(presence_seconds).alias("presence_window_seconds"),
        )
    )


def shadow_alert_json(alerts: DataFrame) -> Column:
    """Message text of a shadow-device alert."""
    names = [
        "first_occurred_at",
        "last_occurred_at",
        "source_mac",
        "occurrence_count",
        "destination_bssid",
        "ssid",
        "sensor_id",
        "location_id",
        "signal_dbm",
        "reason",
    ]
    times = ("first_occurred_at", "last_occurred_at")
    columns = [(F.col(n).cast("string") if n in times else F.col(n)).alias(n) for n in names if n in alerts.columns]
    if "evidence" in alerts.columns:  # stored as JSON text
        columns.append(F.from_json("evidence", EVIDENCE).alias("evidence"))
    head = F.lit("shadow_device").alias("event_type")
    return F.to_json(F.struct(head, *columns), {"ignoreNullFields": "false"})


def probe_known_bssid(probes: DataFrame, networks: DataFrame, key: str = "probe_id") -> DataFrame:
    """Add ``known_bssid``: the address of the single enabled network that fits a probe.

    SSIDs compare without case; a probe's own address and location narrow the
    match when it has them.  Networks are counted once per combination of the
    columns a probe may state, so a probe meets one row whatever the number of
    access points behind its SSID.
    """
    n = filter_enabled_networks(networks).select(
        F.lower("ssid").alias("s"), F.lower("bssid").alias("b"), F.col("location_id").alias("l"), "bssid"
    )
    n = n.filter(F.col("s").isNotNull())

    def summary(*by: str) -> DataFrame:
        # rows without a stated column cannot equal a probe's value
        rows = n
        for c in by:
            rows = rows.filter(F.col(c).isNotNull())
        grouped = rows.groupBy("s", *by).agg(F.count("*").alias("_n"), F.max("bssid").alias("_bssid"))
        absent = [F.lit(None).cast("string").alias(c) for c in ("b", "l") if c not in by]
        return grouped.filter(F.col("_n") == 1).select("s", *by, *absent, "_bssid")

    unique = summary().unionByName(summary("b")).unionByName(summary("l")).unionByName(summary("b", "l"))
    wanted = probes.withColumns(
        {"_s": F.lower("ssid"), "_b": F.lower("observed_bssid"), "_l": F.col("location_id")}
    )
    same = (F.col("_s") == F.col("s")) & F.col("_b").eqNullSafe(F.col("b")) & F.col("_l").eqNullSafe(F.col("l"))
    return wanted.join(unique, same, "left").select(*probes.columns, F.col("_bssid").alias("known_bssid"))


def probe_clients(probes: DataFrame) -> DataFrame:
    """Per (ssid, client): seen range and number of probes."""
    return probes.groupBy("ssid", "client_mac").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("probe_count").alias("probe_count"),
    )


def device_lookup(requests: DataFrame, devices: DataFrame, mac: str = "mac") -> DataFrame:
    """Join requests with their device, addresses compared without case; unknown ones get no reply."""
    reply = F.to_json(
        F.struct(F.col("mac_id").alias("device_id"), "username", "display_name", "hostname"),
        {"ignoreNullFields": "false"},
    )
    one = devices.groupBy(F.lower("mac_id").alias("_mac")).agg(
        F.min_by(F.struct("mac_id", "username", "display_name", "hostname"), "mac_id").alias("_d")
    )
    replies = one.select("_mac", "_d.*").select("_mac", reply.alias("reply"))
    return requests.join(replies, F.lower(F.col(mac)) == F.col("_mac"), "inner").drop("_mac")


def network_json() -> Column:
    return F.to_json(
        F.struct("ssid", F.lower("bssid").alias("bssid"), "location_id", "label", "enabled"),
        {"ignoreNullFields": "false"},
    )


def authorized_networks_json(networks: DataFrame, page_size: int = 500, key: str = "id") -> DataFrame:
    """Numbered pages (``page, networks_json``) of the enabled networks in key order.

    A page is a JSON array of at most ``page_size`` networks, so that no row grows with the
    table; without a network there is no page.
    """
    enabled = filter_enabled_networks(networks).select(F.col(key).alias("_k"), network_json().alias("_json"))
    placed = numbered(enabled, [], ["_k"], "_n")
    page = F.floor((F.col("_n") - 1) / page_size).cast("bigint")
    pages = placed.groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("_k", "_json"))).alias("_rows"))
    return pages.select("page", _json_array().alias("networks_json"))


def _json_array() -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform("_rows", lambda r: r["_json"]), ","), F.lit("]"))


def networks_reply(requests: DataFrame, networks: DataFrame, default_topic: str, page_size: int = 500) -> DataFrame:
    """One reply of bounded size per request and page; without a network one empty list per request."""
    pages = durable(authorized_networks_json(networks, page_size))
    last = pages.agg(F.max("page")).first()[0]
    if last is None:
        answered = requests.withColumns({"page": F.lit(0).cast("bigint"), "reply": F.lit("[]")})
    else:
        wanted = requests.withColumn("page", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last))))
        answered = wanted.join(pages.withColumnRenamed("networks_json", "reply"), "page")
    return filter_reply_topic(answered, default_topic)

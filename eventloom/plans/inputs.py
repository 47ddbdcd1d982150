"""Message, ledger and dimension views derived from the driver's tables.

Every view covers its whole source table.  A view is one list of SQL expressions
that both engines read; the few spellings that differ are written as tokens:
``A DIV B`` integer division, ``FMT(..)`` printf, ``SHA(..)`` sha-256 hex,
``SECS(n)`` an interval.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"
STREAMS = ["proxy.events", "wireless.audit", "audit.wireless.bandwidth", "proxy.payload_audit", "wireless.probe.flush"]


def pick(index: str, values: list[str]) -> str:
    """CASE expression that selects one of ``values`` by position."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


def q(expr: str) -> str:
    """JSON string of an SQL text that needs no escapes."""
    return f"'\"' || {expr} || '\"'"


def obj(**members: str) -> str:
    """SQL text of a JSON object; members whose SQL is NULL are left out."""
    parts = ", ".join(f"'\"{name}\":' || {expr}" for name, expr in members.items())
    return f"'{{' || concat_ws(',', {parts}) || '}}'"


def iso(expr: str) -> str:
    return f"replace(cast({expr} AS string), ' ', 'T') || 'Z'"


def mac(n: str) -> str:
    return (
        f"FMT('02:00:%02x:%02x:%02x:%02x', {n} DIV 16777216 % 256, {n} DIV 65536 % 256, {n} DIV 256 % 256, {n} % 256)"
    )


CENTS = "cast(floor(value * 100) AS bigint)"
STREAM_OF = lambda n: pick(f"{n} % 5", STREAMS)

_FRAME = {
    "frame_no": "event_id",
    "batch_id": "'b' || (event_id DIV 100)",
    "row_sequence": "event_id % 100",
    "observed_at": "ts",
    "source_mac": f"CASE WHEN event_id % 23 = 0 THEN 'bad-mac' ELSE {mac('user_id')} END",
    "channel": "1 + event_id % 40",
    "sensor_id": "'s' || (user_id DIV 10)",
    "location_id": "'l' || (user_id % 7)",
    "interface": "'wlan' || (event_id % 3)",
    "reg_domain": "CASE WHEN event_id % 2 = 0 THEN 'US' END",
    "ssid": "CASE WHEN event_id % 17 <> 0 THEN 'net' || user_id END",
    "destination_bssid": "'b' || (event_id % 11)",
    "signal_dbm": "-80 + event_id % 50",
    "bytes": CENTS,
    "is_retry": "CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END",
}

_PAYLOAD = obj(
    source_mac=q(f"CASE WHEN event_id % 23 = 0 THEN 'bad-mac' ELSE upper({mac('user_id')}) END"),
    destination_bssid=q("CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'B' || (event_id % 11) END"),
    bssid=q("'b' || (event_id % 13)"),
    ssid="CASE WHEN event_id % 17 <> 0 THEN " + q("'net' || user_id") + " END",
    sensor_id=q("'s' || (user_id DIV 10)"),
    location_id=q("'l' || (user_id % 7)"),
    signal_dbm="(-80 + event_id % 50)",
    type=q("event_type"),
)

# name -> (source table, {column: expression}, condition)
VIEWS: dict[str, tuple[str, dict[str, str], str | None]] = {
    "frames": ("events", _FRAME, None),
    "ledger": (
        "events",
        {
            "dedupe_key": "SHA('events:' || event_id)",
            "stream_name": STREAM_OF("event_id"),
            "observed_at": "ts",
            "payload_ref": "CASE WHEN event_id % 3 = 0 THEN 'outbox://e/' || event_id || '.json' END",
            "payload": f"CASE WHEN event_id % 19 <> 0 THEN {_PAYLOAD} END",
            "status": pick("event_id DIV 5 % 5", ["pending", "processing", "failed", "batched", "completed"]),
            "attempt_count": "user_id % 7",
            "last_error": "CASE WHEN event_id DIV 5 % 5 = 2 THEN 'earlier failure' END",
            "producer": "'feed-' || (event_id % 3)",
            "event_kind": "event_type",
            "created_at": "ts",
            "updated_at": "ts",
        },
        None,
    ),
    "batches": (
        "orders",
        {
            "batch_id": "'b' || o_orderkey",
            "job_id": "'j' || o_custkey",
            "batch_no": "0",
            "payload_ref": "CASE WHEN o_orderkey % 2 = 0 THEN 'outbox://b/' || o_orderkey || '.json' WHEN o_orderkey % 6 = 1 THEN '' END",
            "status": pick("o_orderkey % 4", ["pending", "dispatched", "failed", "completed"]),
            "row_count": "1",
            "checksum": "cast(NULL AS string)",
            "attempt_count": "o_orderkey % 6",
            "last_error": "CASE WHEN o_orderkey % 4 = 2 THEN 'earlier failure' END",
            "dedupe_key": "CASE WHEN o_orderkey % 3 <> 0 THEN SHA('events:' || o_orderkey) END",
            "stream_name": STREAM_OF("o_orderkey"),
            "cursor_start": "CASE WHEN o_orderkey % 5 <> 0 THEN " + iso("o_orderdate") + " END",
            "cursor_end": iso("o_orderdate"),
            "created_at": "o_orderdate",
            "updated_at": "o_orderdate",
        },
        None,
    ),
    "jobs": (
        "customer",
        {
            "job_id": "'j' || c_custkey",
            "stream_name": STREAM_OF("c_custkey"),
            "status": pick("c_custkey % 3", ["pending", "running", "completed"]),
            "attempt_count": "c_custkey % 4",
            "started_at": f"CASE WHEN c_custkey % 3 = 1 THEN timestamp '{AS_OF}' - SECS(c_custkey) END",
            "finished_at": f"CASE WHEN c_custkey % 3 = 2 THEN timestamp '{AS_OF}' - SECS(c_custkey) END",
        },
        None,
    ),
    "networks": (
        "supplier",
        {
            "id": "s_suppkey",
            "ssid": "CASE WHEN s_suppkey % 4 <> 2 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'NET' ELSE 'net' END || (s_suppkey DIV 2 * 2) END",
            "bssid": "CASE WHEN s_suppkey % 4 <> 0 THEN 'b' || (s_suppkey % 11) END",
            "location_id": "CASE WHEN s_suppkey % 4 <> 1 THEN 'l' || (s_suppkey % 7) END",
            "label": "s_name",
            "enabled": "s_suppkey % 5 <> 0",
        },
        None,
    ),
    "devices": (
        "customer",
        {
            "mac_id": mac("c_custkey"),
            "username": "c_name",
            "display_name": "c_mktsegment",
            "hostname": "CASE WHEN c_custkey % 4 <> 0 THEN 'host-' || c_nationkey END",
            "last_seen": f"timestamp '{AS_OF}' - SECS(c_custkey * 37 % 720)",
        },
        None,
    ),
    "devices_late": (
        "customer",
        {
            "mac_id": mac("c_custkey"),
            "last_seen": f"timestamp '{AS_OF}' - SECS(c_custkey * 37 % 720 * 600)",
        },
        None,
    ),
    "blocked": (
        "events",
        {
            "seq": "event_id",
            "observed_at": "ts",
            "host": "'h' || (user_id DIV 2)",
            "blocked_bytes": CENTS,
            "frequency_hz": "CASE WHEN event_id % 3 = 0 THEN value END",
            "risk_score": "CASE WHEN event_id % 6 = 1 THEN value END",
            "category": "CASE WHEN event_id % 4 = 1 THEN 'cat' || (event_id % 8) END",
            "verdict": pick("event_id % 3", ["BLOCKED", "MALICIOUS", "SUSPECT"]),
            "tarpit_held_ms": "event_id % 50",
            "iat_ms": "CASE WHEN event_id % 5 = 0 THEN event_id % 90 END",
            "consecutive_blocks": "CASE WHEN event_id % 4 = 0 THEN event_id % 9 END",
            "last_verdict": "CASE WHEN event_id % 7 = 0 THEN 'FINAL' || (event_id % 3) END",
            "tls_ver": "CASE WHEN event_id % 3 = 1 THEN '1.' || (event_id % 4) END",
            "alpn": "CASE WHEN event_id % 9 = 0 THEN 'h2' END",
            "ja3_lite": "CASE WHEN event_id % 8 = 3 THEN 'ja' || (event_id % 100) END",
            "resolved_ip": "CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || (event_id % 200) END",
            "asn_org": "CASE WHEN event_id % 11 = 0 THEN 'AS' || (event_id % 40) END",
        },
        None,
    ),
    "windows": (
        "orders",
        {
            "batch_id": "'b' || (o_orderkey DIV 40)",
            "row_sequence": "o_orderkey % 40",
            "window_start": "timestamp '2024-01-01 00:00:00' + SECS(o_orderkey * 7919 % 172800)",
            "local_day": "cast(timestamp '2024-01-01 00:00:00' + SECS(o_orderkey * 7919 % 172800) AS date)",
            "sensor_id": "'s' || (o_custkey % 2)",
            "location_id": "'l' || (o_orderkey % 7)",
            "source_mac": "'m' || (o_custkey % 3)",
            "destination_bssid": "'b' || (o_custkey % 2)",
            "ssid": "CASE WHEN o_orderkey % 4 <> 0 THEN 'net' || o_custkey END",
            "bytes": "cast(floor(o_totalprice) AS bigint)",
            "threshold_exceeded": "CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END",
        },
        None,
    ),
    "probes": (
        "orders",
        {
            "probe_id": "o_orderkey",
            "message_no": "o_orderkey DIV 10",
            "batch_id": "'m' || (o_orderkey DIV 10 % 50)",
            "pos": "o_orderkey % 10",
            "ssid": "CASE WHEN o_orderkey % 2 = 0 THEN 'Net' ELSE 'net' END || (o_custkey % 150)",
            "client_mac": mac("o_custkey % 40"),
            "first_seen": "o_orderdate",
            "last_seen": "o_orderdate + SECS(o_orderkey % 600)",
            "probe_count": "1 + o_orderkey % 9",
            "location_id": "CASE WHEN o_orderkey % 3 = 0 THEN 'l' || (o_orderkey % 7) END",
            "observed_bssid": "CASE WHEN o_orderkey % 4 = 0 THEN 'B' || (o_custkey % 11) END",
        },
        None,
    ),
    "scans": (
        "orders",
        {
            "place": "o_orderkey",
            "dedupe_key": "CASE WHEN o_orderkey % 33 = 0 THEN ' ' ELSE SHA('events:' || o_orderkey) END",
            "stream_name": STREAM_OF("o_orderkey"),
            "payload_ref": "CASE WHEN o_orderkey % 21 <> 0 THEN 'outbox://scan/' || o_orderkey END",
            "payload": "CASE WHEN o_orderkey % 4 <> 0 THEN '{\"n\":' || o_orderkey || '}' END",
            "payload_sha256": "'sha' || o_orderkey",
            "observed_text": "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN "
            + iso("o_orderdate")
            + " WHEN 2 THEN replace(cast(o_orderdate AS string), ' ', 'T') ELSE 'soon' END",
            "event_kind": "'scan'",
        },
        None,
    ),
    "envelopes": (
        "orders",
        {
            "offset": "o_orderkey",
            "topic": "'sync.rows'",
            "value": "CASE WHEN o_orderkey % 13 = 0 THEN 'not json ' || o_orderkey WHEN o_orderkey % 13 = 1 THEN '[1]' ELSE "
            + obj(
                table="CASE WHEN o_orderkey % 13 = 2 THEN '7' WHEN o_orderkey % 13 <> 3 THEN "
                + q(pick("o_orderkey % 3", ["devices", "Devices", "nosuch"]))
                + " END",
                origin="CASE WHEN o_orderkey % 13 <> 4 THEN "
                + q(pick("o_orderkey DIV 3 % 4", ["atheros-sensor", "SSL-Proxy", "atheros-search", "intruder"]))
                + " END",
                destination="CASE WHEN o_orderkey % 13 <> 5 THEN " + q("'warehouse'") + " END",
                data="CASE WHEN o_orderkey % 13 = 6 THEN '[1,2]' WHEN o_orderkey % 13 <> 7 THEN "
                + obj(
                    MAC_ID=q(mac("o_custkey % 60")),
                    display_name=q("o_orderpriority"),
                    username="CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE " + q("'u' || o_custkey") + " END",
                    hostname="cast(o_orderkey AS string)",
                    notes="'{\"k\":' || (o_orderkey % 4) || '}'",
                    last_seen=q(iso("o_orderdate")),
                    ratio="'1.5'",
                    flag="'true'",
                    surplus="'[]'",
                )
                + " END",
            )
            + " END",
        },
        None,
    ),
    "work_items": (
        "orders",
        {
            "offset": "o_orderkey",
            "value": "CASE WHEN o_orderkey % 11 = 0 THEN 'broken ' || o_orderkey ELSE "
            + obj(
                job_id="CASE WHEN o_orderkey % 11 <> 1 THEN " + q("'j' || o_custkey") + " END",
                batch_id="CASE WHEN o_orderkey % 11 = 2 THEN cast(o_orderkey AS string) ELSE " + q("'b' || o_orderkey") + " END",
                batch_no="CASE o_orderkey % 4 WHEN 0 THEN 'null' WHEN 1 THEN cast(o_orderkey % 7 AS string) WHEN 2 THEN '0.5' END",
                stream_name=q(
                    pick("o_orderkey % 7", [*STREAMS, "wireless.rogue_ap", "unknown.stream"])
                ),
                payload_ref=q("CASE WHEN o_orderkey % 11 = 3 THEN ' ' ELSE 'outbox://b/' || o_orderkey END"),
                cursor_start=q("''"),
                cursor_end=q(iso("o_orderdate")),
                attempt="CASE WHEN o_orderkey % 5 <> 0 THEN cast(o_orderkey % 6 AS string) END",
            )
            + " END",
        },
        None,
    ),
    "audits": (
        "events",
        {
            "offset": "event_id",
            "value": "CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 17 = 1 THEN 'no json' ELSE "
            + obj(
                observed_at="CASE WHEN event_id % 17 = 2 THEN '5' WHEN event_id % 17 <> 3 THEN " + q(iso("ts")) + " END",
                host="CASE WHEN event_id % 17 = 4 THEN '1' ELSE " + q("'h' || user_id") + " END",
                method=q("event_type"),
                query_keys="CASE WHEN event_id % 17 = 5 THEN '[1]' WHEN event_id % 2 = 0 THEN '[\"a\",\"b\"]' END",
                body="props",
                body_bytes_original="CASE WHEN event_id % 17 = 6 THEN '3000000000' ELSE cast(event_id AS string) END",
                truncated="CASE WHEN event_id % 17 = 7 THEN '1' WHEN event_id % 3 = 0 THEN 'true' ELSE 'null' END",
                type="CASE WHEN event_id % 4 = 0 THEN " + q("'http'") + " END",
            )
            + " END",
        },
        None,
    ),
    "requests": (
        "orders",
        {
            "request_id": "o_orderkey",
            "value": "CASE WHEN o_orderkey % 9 = 0 THEN 'hello' ELSE "
            + obj(
                mac="CASE WHEN o_orderkey % 9 = 1 THEN '42' WHEN o_orderkey % 9 = 2 THEN '\"\"' WHEN o_orderkey % 9 <> 3 THEN "
                + q(f"upper({mac('o_custkey')})")
                + " END",
                reply_topic="CASE o_orderkey % 6 WHEN 0 THEN '\"wireless.mac.lookup.reply\"' WHEN 1 THEN "
                + q("'_INBOX.atheros_sensor.' || o_orderkey")
                + " WHEN 2 THEN '\"bad?topic\"' WHEN 3 THEN '\"wireless.other.reply\"' WHEN 4 THEN '\"..\"' END",
            )
            + " END",
        },
        None,
    ),
    "errors": (
        "orders",
        {
            "error_id": "o_orderkey",
            "sqlstate": pick("o_orderkey % 7", ["08S01", "40001", "42000", "HY000", "hyt00", "70100", "23000"]),
            "code": "CASE o_orderkey % 5 WHEN 0 THEN 2006 WHEN 1 THEN -1213 WHEN 2 THEN 9007 WHEN 3 THEN 1064 END",
            "message": pick(
                "o_orderkey % 9",
                [
                    "Query TIMEOUT expired",
                    "syntax error",
                    "Deadlock found",
                    "duplicate entry",
                    "Region unavailable",
                    "unknown column",
                    "Lock wait exceeded",
                    "bad value",
                    "Connection reset by peer",
                ],
            ),
        },
        None,
    ),
}


def _dialect(sql: str, spark: bool) -> str:
    if spark:
        sql = sql.replace("FMT(", "format_string(").replace("SECS(", "make_dt_interval(0, 0, 0, ")
        sql = re.sub(r"timestamp '", "timestamp_ntz '", sql)
        return re.sub(r"SHA\(('events:' \|\| \w+)\)", r"sha2(\1, 256)", sql)
    return sql.replace("FMT(", "printf(").replace("SECS(", "to_seconds(").replace("SHA(", "sha256(").replace(" DIV ", " // ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Views that carry JSON text; a benchmark may spread their one-split files over its cores.
PREPARE = [lambda df: df]
MESSAGE_VIEWS = ("ledger", "envelopes", "work_items", "audits", "requests")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns, condition = VIEWS[name]
    df = table(spark, sf_dir, source)
    if name in MESSAGE_VIEWS or name.startswith("rows_"):
        df = PREPARE[0](df)
    if condition:
        df = df.filter(_dialect(condition, True))
    return df.selectExpr(*[f"{_dialect(e, True)} AS `{c}`" for c, e in columns.items()])


def view_sql(name: str) -> str:
    source, columns, condition = VIEWS[name]
    listed = ", ".join(f'{_dialect(e, False)} AS "{c}"' for c, e in columns.items())
    where = f" WHERE {condition}" if condition else ""
    return f"SELECT {listed} FROM {source}{where}"

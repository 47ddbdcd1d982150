"""Literal cases: message shapes, routing, checksums, error classes, helpers."""

import base64
import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.functions import hashing as H
from eventloom.functions import json_fields as J
from eventloom.functions import text as X
from eventloom.operators import alerts, ledger, metrics
from eventloom.operators import normalize as N
from eventloom.sources import messages, payload


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows_of(spark, target, *objects, batch="b1"):
    items = [(batch, i, json.dumps(o, separators=(",", ":"))) for i, o in enumerate(objects)]
    df = spark.createDataFrame(items, "batch_id string, pos int, raw string")
    return N.normalize(J.with_parsed(df, F.col("raw"), "row"), target)


AT = "2031-03-04T05:06:07Z"


def test_proxy_event_with_block(spark):
    event = {"type": "handshake", "host": "shop.test", "time": AT, "blocked": True, "bytes_up": 41,
             "bytes_down": 17, "blocked_bytes": 905, "verdict": "quarantine"}
    rows = rows_of(spark, "proxy.events", event)
    row = one(rows)
    assert (row.event_type, row.host, row.bytes_up, row.bytes_down, row.blocked) == ("handshake", "shop.test", 41, 17, 1)
    assert row.error is None and row.row_sequence == 1 and row.identity_source == "unknown"
    assert json.loads(row.raw_json) == event
    blocked = one(N.extract_blocked(rows))
    assert (blocked.blocked_bytes, blocked.verdict, blocked.row_sequence) == (905, "quarantine", 0)


def test_proxy_event_without_block(spark):
    rows = rows_of(spark, "proxy.events", {"type": "handshake", "host": "shop.test", "time": AT, "blocked": False})
    assert rows.count() == 1 and N.extract_blocked(rows).count() == 0


def test_blocked_byte_sum_overflow_is_an_error(spark):
    big = {"type": "t", "host": "h", "time": AT, "blocked": 1, "bytes_up": 2**63 - 1, "bytes_down": 1}
    assert "overflow" in one(N.extract_blocked(rows_of(spark, "proxy.events", big))).error


@pytest.mark.parametrize(
    "target, row, expected",
    [
        ("proxy.payload_audit", {"host": "shop.test", "observed_at": AT, "byte_offset": 0}, {"host": "shop.test", "direction": "UP"}),
        (
            "wireless.audit",
            {"event_type": "seeking", "observed_at": AT, "sensor_id": "post-9", "location_id": "yard", "interface": "mon2",
             "channel": 11, "frame_subtype": "seek", "raw_len": 77},
            {"sensor_id": "post-9", "band": "2.4GHz", "tags": None},
        ),
        (
            "audit.wireless.bandwidth",
            {"window_start": AT, "window_end": "2031-03-04T05:16:07Z", "sensor_id": "post-9", "location_id": "yard", "interface": "mon2",
             "channel": 149, "source_mac": "0a:1c:2e:3f:40:55", "destination_bssid": "0a:1c:2e:3f:40:66", "bytes": 7340,
             "frame_count": 12, "threshold_exceeded": 0, "external_bssid": 0},
            {"bytes": 7340, "band": "5GHz", "schema_version": 1, "hist_under_100": 0},
        ),
        (
            "wireless.alert.rogue_ap",
            {"detected_at": AT, "sensor_id": "post-9", "location_id": "yard", "interface": "mon2", "channel": 11, "bssid": "0a:1c:2e:3f:40:55"},
            {"rogue_bssid": "0a:1c:2e:3f:40:55", "ssid_impersonation": 0},
        ),
        (
            "wireless.alert.deauth_flood",
            {"observed_at": AT, "sensor_id": "post-9", "location_id": "yard", "interface": "mon2", "frame_count": 9, "window_secs": 10},
            {"deauth_count": 9, "channel": 0, "attacker_mac": None},
        ),
        (
            "wireless.alert.signal_anomaly",
            {"detected_at": AT, "sensor_id": "post-9", "location_id": "yard", "source_mac": "m", "channel": 1, "baseline_dbm": -41,
             "observed_dbm": -58, "dbm_delta": -17, "configured_delta": 20},
            {"dbm_delta": 17},
        ),
        (
            "wireless.alert.pmf_attack",
            {"detected_at": AT, "sensor_id": "post-9", "location_id": "yard", "source_mac": "m", "attack_tag": "pmf"},
            {"target_mac": "m", "channel": None},
        ),
        (
            "wireless.probe.flush",
            {"client_mac": "0a:1c:2e:3f:40:55", "ssid": "Foyer", "first_seen": AT, "last_seen": AT, "probe_count": 3},
            {"ssid": "Foyer", "probe_count": 3},
        ),
    ],
)
def test_normalised_rows(spark, target, row, expected):
    found = one(rows_of(spark, target, row)).asDict()
    assert found["error"] is None
    assert {k: found[k] for k in expected} == expected


def test_correlation_id_is_a_name_uuid_of_the_compact_text(spark):
    row = {"host": "h", "observed_at": AT}
    raw = json.dumps(row, separators=(",", ":"))
    expected = uuid.UUID(bytes=hashlib.md5(raw.encode()).digest(), version=3)
    assert one(rows_of(spark, "proxy.payload_audit", row)).correlation_id == str(expected)


def test_first_bad_required_field_is_the_error(spark):
    rows = rows_of(spark, "proxy.events", {"host": 5, "time": AT}, {"type": "", "host": "h", "time": "2031-03-04T05:06:07"})
    errors = [r.error for r in rows.orderBy("row_sequence").collect()]
    assert errors == [
        "Missing required string field 'type' in proxy.events",
        "Invalid timestamp '2031-03-04T05:06:07' for field 'time' in proxy.events",
    ]


def test_rows_that_are_no_objects_are_errors(spark):
    df = spark.createDataFrame([('["x", 5, null, {"type":"t","host":"h","time":"%s"}]' % AT,)], "payload string")
    parsed = J.with_parsed(df.withColumn("batch_id", F.lit("b")), F.col("payload"), "document")
    rows = N.normalize(payload.payload_rows(parsed), "proxy.events")
    assert rows.filter("error IS NULL").count() == 1 and rows.count() == 4


def test_local_day_is_taken_in_the_sensor_offset(spark):
    window = {"window_start": "2031-03-04T22:45:00-06:00", "window_end": "2031-03-05T05:15:00Z", "sensor_id": "s", "location_id": "l",
              "interface": "w", "channel": 1, "source_mac": "m", "destination_bssid": "b", "bytes": 5, "frame_count": 1,
              "threshold_exceeded": True}
    alert = one(alerts.bandwidth_alerts(rows_of(spark, "audit.wireless.bandwidth", window), "2031-03-06 00:00:00"))
    assert str(alert.alert_date) == "2031-03-04" and str(alert.detected_at) == "2031-03-05 04:45:00"


def test_routing(spark):
    names = [*schemas.TARGET_OF_STREAM, "no.such.stream"]
    df = spark.createDataFrame([(n,) for n in names], "stream_name string")
    found = {r.stream_name: r for r in messages.target_route(df).collect()}
    assert {n: found[n].target for n in schemas.TARGET_OF_STREAM} == schemas.TARGET_OF_STREAM
    assert found["no.such.stream"].target is None and found["no.such.stream"].route_error


def test_checksum(spark):
    expected = hashlib.sha256(b'proxy.events\x00[7,{"k":"v"}]').hexdigest()
    assert value(spark, H.batch_checksum(F.lit("proxy.events"), F.lit('[7,{"k":"v"}]'))) == expected


@pytest.mark.parametrize(
    "state, code, message, expected",
    [
        ("08S01", 2006, "first", "retryable"),
        ("40001", 1213, "second", "retryable"),
        ("40001", 8002, "third", "retryable"),
        ("HY000", 9007, "fourth", "retryable"),
        ("42000", 1064, "fifth", "permanent"),
        (None, None, "query timeout expired", "retryable"),
        (None, None, "Write conflict, txn restarted", "retryable"),
        (None, None, None, "permanent"),
    ],
)
def test_error_classes(spark, state, code, message, expected):
    columns = (F.lit(state).cast("string"), F.lit(code).cast("int"), F.lit(message).cast("string"))
    assert value(spark, X.error_class(*columns)) == expected


def test_error_class_of_a_cause_chain(spark):
    kind = "array<struct<sqlstate:string,code:int,message:string,transient:boolean>>"
    chain = spark.createDataFrame([([(None, None, "outer", False), (None, None, "connection lost", True)],)], f"f {kind}")
    assert chain.select(X.chain_error_class(F.col("f")).alias("c")).first()["c"] == "retryable"


def test_backpressure(spark):
    assert metrics.budget_of(700, 3) == 2100
    series = [90, 2100, 2100, 1500, 1050, 1500, 2600, 900]
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate(series)], "stream_name string, tick int, pending bigint")
    states = [r.suspended for r in metrics.backpressure_timeline(df, 2100).orderBy("tick").collect()]
    assert states == [False, True, True, True, False, False, True, False]


AUDIT = '{"observed_at": "2030-11-12T13:14:15Z", "host": "intranet.test", "method": "PUT", "path": "/forms/7", "body": {"note": ["n"]}}'


@pytest.mark.parametrize(
    "text, good",
    [
        (AUDIT, True),
        ('{"host": "intranet.test"}', False),
        ('{"observed_at": "soon", "host": "a"}', True),
        ('{"observed_at": "2030-11-12T13:14:15Z"}', True),
        ("}{", False),
        ('{"observed_at": "x", "query_keys": [false]}', False),
        ('{"observed_at": "x", "truncated": 3.5}', False),
        ('{"observed_at": "x", "host": null}', True),
    ],
)
def test_audit_messages(spark, text, good):
    df = spark.createDataFrame([(text,)], "value string")
    assert (one(messages.audit_parse(df)).error is None) is good


def test_audit_request(spark):
    df = spark.createDataFrame([(AUDIT,), ("",), (None,)], "value string")
    requests = messages.scan_requests(df)
    row = one(requests.withColumn("request", messages.request_json(requests)))
    sha = hashlib.sha256(AUDIT.encode()).hexdigest()
    reference = "inline://json/" + base64.urlsafe_b64encode(AUDIT.encode()).decode().rstrip("=")
    assert json.loads(row.request) == {
        "stream_name": "proxy.payload_audit",
        "dedupe_key": hashlib.sha256(f"proxy.payload_audit:{sha}".encode()).hexdigest(),
        "payload_ref": reference,
        "observed_at": "2030-11-12T13:14:15Z",
    }
    assert row.payload == AUDIT


ITEM = {"job_id": "ox", "batch_id": "elm", "batch_no": 31, "stream_name": "proxy.events",
        "payload_ref": "inline://json/e30", "cursor_start": "", "cursor_end": "", "attempt": 4}


@pytest.mark.parametrize(
    "change, batch_no, attempt, good",
    [
        ({}, 31, 4, True),
        ({"batch_no": None}, None, 4, True),
        ({"batch_no": "drop"}, None, 4, True),
        ({"attempt": "drop"}, 31, 0, True),
        ({"job_id": "drop"}, 31, 4, False),
        ({"cursor_end": 5}, 31, 4, False),
    ],
)
def test_work_items(spark, change, batch_no, attempt, good):
    item = {k: v for k, v in {**ITEM, **change}.items() if v != "drop"}
    row = one(messages.load_decode(spark.createDataFrame([(json.dumps(item),)], "value string")))
    assert (row.error is None) is good
    assert (row.batch_no, row.attempt) == (batch_no, attempt)


def test_work_item_round_trip(spark):
    first = messages.load_decode(spark.createDataFrame([(json.dumps({**ITEM, "batch_no": None}),)], "value string"))
    text = one(first.select(messages.work_item_json(first).alias("value")))
    assert json.loads(text.value) == {**ITEM, "batch_no": None}


def test_publish_refuses_blank_fields(spark):
    good = messages.load_decode(spark.createDataFrame([(json.dumps(ITEM),), (json.dumps({**ITEM, "payload_ref": " "}),)], "value string"))
    records, refused = ledger.dispatch_publish(good.drop("value", "error"), "load")
    assert records.count() == 1
    assert one(refused).error_text == "payload_ref must not be empty"


@pytest.mark.parametrize(
    "text, expected",
    [('{"mac": "q7"}', "q7"), ("{}", None), ('{"mac": ""}', None), ('{"mac": [1]}', None), ("}{", None)],
)
def test_extract_field(spark, text, expected):
    assert value(spark, J.extract_field(F.lit(text), "mac")) == expected


@pytest.mark.parametrize(
    "topic, valid, allowed",
    [
        ("wireless.mac.lookup.reply", True, True),
        ("wireless.networks.authorized.reply", True, True),
        ("_INBOX.atheros_sensor.8.x", True, True),
        ("_INBOX.atheros_sensor.", True, True),
        ("_INBOX.atheros_sensor", True, True),
        ("_INBOX.somebody.8", True, False),
        ("wireless.someone.reply", True, False),
        ("dashed-name", True, False),
        (".", False, False),
        ("..", False, False),
        ("what?", False, False),
        ("two words", False, False),
        ("q" * 300, False, False),
    ],
)
def test_reply_topics(spark, topic, valid, allowed):
    column = F.lit(topic)
    assert value(spark, X.is_valid_topic(column)) is valid
    assert value(spark, X.is_allowed_reply_topic(column)) is allowed
    assert value(spark, X.reply_topic(column, "default")) == (topic if valid and allowed else "default")


def test_masks_and_lines(spark):
    assert value(spark, X.hash_mac(F.lit("12:34:56:78:9a:bc"))) == "12***bc"
    assert value(spark, X.hash_mac(F.lit("z9"))) == "invalid"
    assert value(spark, X.hash_mac(F.lit(None).cast("string"))) == "invalid"
    assert value(spark, X.sanitize(F.lit("up\ndown\rleft"))) == "up down left"
    assert value(spark, X.sanitize(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize(
    "reference, error",
    [
        ("inline://json/e30", None),
        ("inline://json/e30=", None),
        ("inline://json/bnVsbA", payload.EMPTY_PAYLOAD),
        ("inline://json/bm90IGpzb24", payload.NOT_JSON_PAYLOAD),
        ("inline://json/a+b", payload.BAD_BASE64),
        ("ftp://host/x", "unsupported payload_ref scheme: ftp://host/x"),
        (None, "unsupported payload_ref scheme: "),
    ],
)
def test_inline_references(spark, reference, error):
    df = spark.createDataFrame([(reference,)], "payload_ref string")
    assert one(payload.payload_inline(df)).payload_error == error


@pytest.mark.parametrize(
    "path, clean, error",
    [
        ("a/b.json", "a/b.json", None),
        ("./a//x/../b.json", "a/b.json", None),
        ("", "", payload.BLANK_OUTBOX),
        ("  ", "  ", payload.BLANK_OUTBOX),
        ("/a", "a", payload.ESCAPING_OUTBOX),
        ("../a", "../a", payload.ESCAPING_OUTBOX),
        ("a/../../b", "../b", payload.ESCAPING_OUTBOX),
        ("a/..", "", payload.ESCAPING_OUTBOX),
    ],
)
def test_outbox_paths(spark, path, clean, error):
    ref = F.lit(f"outbox://{path}")
    assert value(spark, payload.outbox_path(ref)) == clean
    assert value(spark, payload.outbox_error(ref)) == error


def test_parent_fields_win_in_client_inventory(spark):
    text = json.dumps({"sensor_id": "p", "location_id": None, "observed_at": AT, "clients": [
        {"sensor_id": "own", "location_id": "own", "snapshot_at": "2020-01-01T00:00:00Z"}, 5]})
    df = J.with_parsed(spark.createDataFrame([(text,)], "payload string"), F.col("payload"), "document")
    first, second = payload.client_inventory_merge(df).orderBy("pos").select(
        J.string_value(F.col("head"), "sensor_id").alias("s"), J.json_type(F.col("head"), "location_id").alias("l"),
        J.string_value(F.col("head"), "snapshot_at").alias("t"), "row_error").collect()
    assert (first.s, first.l, first.t, first.row_error) == ("p", "VOID", AT, None)
    assert second.row_error == payload.CLIENT_NOT_OBJECT

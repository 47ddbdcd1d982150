"""Snapshot tables, catalog checks, plans and restarts of the streams."""

import json

import pytest
from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.operators import detect
from eventloom.operators import merge as M
from eventloom.operators import tables as T
from eventloom.plans import catalog
from eventloom.sources import tables as S
from eventloom.sources.topics import read_topic
from eventloom.streaming import pipelines as P

CLOCK = lambda: "2024-01-31 00:00:00"


def send(spark, folder, topic, values, start=0):
    rows = [(None, v, topic, 0, start + i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "key string, value string, topic string, partition int, offset bigint")
    df.withColumn("timestamp", F.lit("2024-01-31").cast("timestamp")).write.mode("append").parquet(f"{folder}/in")


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def files(folder):
    import os

    return {f"{d}/{x}" for d, _, names in os.walk(folder) for x in names if x.endswith(".parquet")}


ADD = lambda held, new: held.unionByName(new).groupBy("k").agg(F.sum("v").alias("v"))


def sums(spark, path):
    return S.KeyedTable(spark, f"{path}/t", spark.range(0).selectExpr("id AS k", "id AS v").schema, ["k"], buckets=8)


def test_upserts_count_once_per_epoch_and_rewrite_nothing(spark, tmp_path):
    table = sums(spark, tmp_path)
    assert table.read().count() == 0
    table.upsert(spark.range(100).selectExpr("id AS k", "1L AS v"), ADD, 0)
    before = files(tmp_path)
    for _ in range(2):  # the second time is a replay
        table.upsert(spark.createDataFrame([(7, 5)], "k int, v bigint"), ADD, 1)
    assert {r.v for r in table.read().filter("k = 7").collect()} == {6} and table.read().count() == 100
    assert before <= files(tmp_path)
    table.upsert(spark.createDataFrame([(7, 5), (500, 1)], "k int, v bigint"), ADD, 2)
    assert {r.k: r.v for r in table.read().filter("v > 1").collect()} == {7: 11} and table.read().count() == 101
    # a replay of a micro-batch that broke off halfway adds what is missing only
    table.upsert(spark.createDataFrame([(1, 10)], "k int, v bigint"), ADD, 3)
    table.upsert(spark.createDataFrame([(1, 10), (2, 10)], "k int, v bigint"), ADD, 3)
    assert {r.k: r.v for r in table.read().filter("v > 9").collect()} == {7: 11, 1: 11, 2: 11}


def test_epochs_belong_to_a_query(spark, tmp_path):
    table = sums(spark, tmp_path)
    rows = lambda *ks: spark.createDataFrame([(k, 1) for k in ks], "k int, v bigint")
    table.upsert(rows(*range(20)), ADD, 5, "first")
    table.upsert(rows(*range(10, 30)), ADD, 0, "second")  # a new checkpoint starts at 0
    assert {r.k: r.v for r in table.read().collect()} == {k: 2 if 10 <= k < 20 else 1 for k in range(30)}
    # both replay: the second query has written since, the first one's epoch is still known
    table.upsert(rows(*range(20)), ADD, 5, "first")
    table.upsert(rows(*range(10, 30)), ADD, 0, "second")
    assert {r.k: r.v for r in table.read().collect()} == {k: 2 if 10 <= k < 20 else 1 for k in range(30)}
    table.compact()
    table.upsert(rows(*range(20)), ADD, 5, "first")
    table.upsert(rows(15), ADD, 1, "second")
    assert {r.v for r in table.read().filter("k = 15").collect()} == {3} and table.read().count() == 30


def test_compaction_keeps_the_rows_and_empties_the_log(spark, tmp_path):
    table = sums(spark, tmp_path)
    table.append_new(spark.range(50).selectExpr("id AS k", "1L AS v"), ["v"])
    table.compact()  # nothing to do
    table.upsert(spark.range(40, 60).selectExpr("id AS k", "2L AS v"), ADD, 0)
    table.upsert(spark.range(3).selectExpr("id AS k"), lambda held, new: held.join(new, "k", "left_anti"))
    want = {k: 1 + 2 * (k >= 40) if k < 50 else 2 for k in range(3, 60)}
    assert {r.k: r.v for r in table.read().collect()} == want
    table.compact()
    assert {r.k: r.v for r in table.read().collect()} == want and not files(f"{tmp_path}/t/log")
    table.append_new(spark.range(5).selectExpr("id AS k", "7L AS v"), ["v"])
    assert {r.k: r.v for r in table.read().collect()} == want | {k: 7 for k in range(3)}


def test_bytes_written_follow_the_batch_not_the_table(spark, tmp_path):
    import os

    written = []
    for n in (1000, 100_000):
        table = sums(spark, tmp_path / str(n))
        table.append_new(spark.range(n).selectExpr("id AS k", "id AS v"), ["v"])
        before = files(tmp_path)
        table.upsert(spark.range(0, n, n // 100).selectExpr("id AS k", "1L AS v"), ADD, 0)
        assert before <= files(tmp_path)
        written.append(sum(os.path.getsize(f) for f in files(tmp_path) - before))
    assert written[1] < 1.5 * written[0]


def test_keys_are_refused_for_all_time_and_facts_are_not_rewritten(spark, tmp_path):
    rows = lambda *items: spark.createDataFrame(list(items), "batch_id string, row_sequence int, v string, place int")
    schema = rows(("b", 0, "x", 0)).drop("place").schema
    table = S.KeyedTable(spark, f"{tmp_path}/facts", schema, ["batch_id", "row_sequence"])
    table.append_new(rows(("b1", 0, "a", 0), ("b1", 0, "again", 1), ("b1", 1, "b", 2)), ["place"])
    before = files(tmp_path)
    for _ in range(2):
        table.append_new(rows(("b1", 0, "late", 0), ("b2", 0, "c", 1)), ["place"])
    assert sorted(r.v for r in table.read().collect()) == ["a", "b", "c"]
    assert before <= files(tmp_path)


def test_only_a_missing_path_is_an_empty_table(spark, tmp_path):
    (tmp_path / "t").write_text("no table")
    with pytest.raises(Exception):
        S.KeyedTable(spark, f"{tmp_path}/t", spark.range(0).schema, ["id"]).read().collect()


def test_preflight(spark):
    spark.range(1).createOrReplaceTempView("PROXY_EVENTS")
    missing = S.check_tables(spark, ("proxy_events", "wireless_alerts"), warn_only=True)
    assert missing == ["wireless_alerts"]
    with pytest.raises(RuntimeError, match="wireless_alerts"):
        S.check_tables(spark, ("proxy_events", "wireless_alerts"))


def test_introspection(spark):
    rows = S.schema_introspect({"Devices": schemas.table_schema("devices"), "proxy_events": schemas.table_schema("proxy_events")})
    by_name = {(t, c): (pk, auto) for t, _, c, _, pk, _, auto in rows}
    assert by_name[("devices", "mac_id")] == (True, False)
    assert by_name[("proxy_events", "id")] == (False, True)
    assert by_name[("proxy_events", "batch_id")] == (True, False)
    spark.range(1).createOrReplaceTempView("known_table")
    assert {r.table_name for r in S.catalog_schema(spark, ["known_table", "no_table"]).collect()} == {"known_table"}


def test_scan_ingest_restart_and_replay(spark, tmp_path):
    folder, topic = str(tmp_path), "proxy.payload_audit"
    message = lambda i: json.dumps({"observed_at": f"2024-01-{i % 28 + 1:02d}T00:00:00Z", "host": f"h{i}"})
    send(spark, folder, topic, [message(i) for i in range(6)] + ["", "broken", '{"host":"x"}'])
    out = P.Outputs(spark, f"{folder}/out")
    run = lambda o: finish(P.stream_scan_ingest(read_topic(spark, topic, path=f"{folder}/in"), o, f"{folder}/cp", clock=CLOCK))
    run(out)
    assert out.table("sync_events").read().count() == 6
    assert out.sent(topic + ".dlq").count() == 2
    # a restart goes on where the last run stopped; the same messages again change no row
    send(spark, folder, topic, [message(i) for i in range(8)], start=100)
    run(P.Outputs(spark, f"{folder}/out"))
    after = out.table("sync_events").read()
    assert after.count() == 8 and after.select("dedupe_key").distinct().count() == 8
    # a query without its checkpoint is a new writer: it sends everything again, and changes no row
    finish(P.stream_scan_ingest(read_topic(spark, topic, path=f"{folder}/in"), out, f"{folder}/cp2", clock=CLOCK))
    assert out.table("sync_events").read().count() == 8


def test_load_stream_writes_tables_and_results(spark, tmp_path):
    import base64

    def item(batch, stream, payload):
        ref = "inline://json/" + base64.urlsafe_b64encode(json.dumps(payload).encode()).decode()
        return json.dumps({"job_id": "j", "batch_id": batch, "stream_name": stream, "payload_ref": ref, "cursor_start": "", "cursor_end": ""})

    at = "2024-01-01T00:00:00Z"
    event = {"type": "t", "host": "h", "time": at, "blocked": True, "bytes_up": 1, "bytes_down": 2}
    window = {"window_start": at, "window_end": at, "sensor_id": "s", "location_id": "l", "interface": "w", "channel": 1,
              "source_mac": "m", "destination_bssid": "b", "bytes": 7, "frame_count": 1, "threshold_exceeded": 1}
    rogue = {"detected_at": at, "sensor_id": "s", "location_id": "l", "interface": "w", "channel": 1, "bssid": "b"}
    client = {"client_mac": "c", "last_seen": at, "first_seen": at}
    values = [
        item("e1", "proxy.events", [event, {**event, "host": "g"}]),
        item("e2", "proxy.events", [event, {"type": "t"}]),
        item("w1", "audit.wireless.bandwidth", window),
        item("r1", "wireless.rogue_ap", [rogue]),
        item("a1", "proxy.payload_audit", [{"host": "h", "observed_at": at}]),
        item("c1", "wireless.client_inventory", {"sensor_id": "s", "location_id": "l", "snapshot_at": at, "clients": [client]}),
        item("p1", "wireless.probe_requests", {"probes": [{"client_mac": "c", "ssid": "n", "first_seen": at, "last_seen": at, "probe_count": 3}]}),
        item("p2", "wireless.probe.flush", {"nothing": 1}),
        item("u1", "no.such.stream", {}),
        "broken",
    ]
    send(spark, str(tmp_path), "sync.load", values)
    out = P.Outputs(spark, f"{tmp_path}/out")
    finish(P.stream_load(read_topic(spark, "sync.load", path=f"{tmp_path}/in"), out, f"{tmp_path}/cp", clock=CLOCK))
    results = {json.loads(r.value)["batch_id"]: json.loads(r.value) for r in out.sent("sync.result").collect()}
    assert {b: (r["status"], r["row_count"]) for b, r in results.items()} == {
        "e1": ("success", 2), "e2": ("failed", 0), "w1": ("success", 1), "r1": ("success", 1), "a1": ("success", 1),
        "c1": ("success", 1), "p1": ("success", 1), "p2": ("failed", 0), "u1": ("failed", 0),
    }
    assert results["u1"]["error_text"] == "unsupported stream_name no.such.stream"
    count = lambda name: out.table(name).read().count()
    assert (count("proxy_events"), count("proxy_payload_audit"), count("wireless_bandwidth_windows")) == (2, 1, 1)
    assert (count("wireless_client_inventory"), count("wireless_probe_requests")) == (1, 1)
    assert {r.alert_type for r in out.table("wireless_alerts").read().collect()} == {"rogue_ap", "bandwidth_threshold"}
    rollup = {r.host: (r.blocked_attempts, r.blocked_bytes) for r in out.table("proxy_blocked_host_rollups").read().collect()}
    assert rollup == {"h": (1, 3), "g": (1, 3)}
    assert out.sent("sync.load.dlq").count() == 1


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_nested_loop_in_the_wildcard_anti_join(spark):
    text = plan_of(catalog.QUERIES["unauthorized_frames"](spark, "/root/testdata/sf0.001"))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_scans_read_only_the_columns_they_need(spark):
    text = plan_of(catalog.QUERIES["filter_threshold"](spark, "/root/testdata/sf0.001"))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_merge_passes_untouched_rows_without_a_shuffle(spark):
    table = spark.range(1000).selectExpr("id AS k", "id AS v")
    batch = spark.createDataFrame([(1, 5, 0)], "k bigint, v bigint, seq int")
    merged = M.merge(table, batch, ["k"], {"v": M.replace}, ["seq"])
    merged.collect()
    text = plan_of(merged)
    assert "LeftAnti" in text and "BroadcastHashJoin" in text
    assert {r.k: r.v for r in merged.filter("k < 3").collect()} == {0: 0, 1: 5, 2: 2}


def test_replaying_facts_changes_nothing(spark):
    rows = spark.createDataFrame([("b", i, f"v{i}", i) for i in range(5)], "batch_id string, row_sequence int, v string, seq int")
    empty = rows.limit(0).drop("seq")
    once = T.upsert_proxy_events(empty, rows, ["seq"])
    twice = T.upsert_proxy_events(once, rows.withColumn("v", F.lit("changed")), ["seq"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_single_page_of_networks(spark):
    networks = spark.createDataFrame([(2, "n", "B", None, "x", True), (1, "m", None, "l", "y", True), (3, "o", "C", "l", "z", False)],
                                     "id int, ssid string, bssid string, location_id string, label string, enabled boolean")
    listed = json.loads(detect.authorized_networks_json(networks).first().networks_json)
    assert [n["ssid"] for n in listed] == ["m", "n"] and listed[1]["bssid"] == "b"
    asked = spark.createDataFrame([(1, None)], "request_id int, reply_topic string")
    none = detect.networks_reply(asked, networks.filter("enabled = false"), "wireless.networks.authorized.reply")
    assert [(r.page, r.reply) for r in none.collect()] == [(0, "[]")]


def test_networks_come_in_pages(spark):
    networks = spark.range(5).selectExpr(
        "id", "'s' AS ssid", "'b' AS bssid", "'l' AS location_id", "'x' AS label", "true AS enabled"
    )
    assert detect.authorized_networks_json(networks, page_size=2).count() == 3


def test_generic_sink_replaces_fact_rows(spark, tmp_path):
    envelope = lambda host: json.dumps({"table": "Proxy_Events", "origin": "SSL-PROXY", "destination": "w", "data": {
        "BATCH_ID": "b", "ROW_SEQUENCE": 1, "HOST": host, "EVENT_TIME": "2024-01-01T00:00:00Z", "junk": [1]}})
    folder = str(tmp_path)
    send(spark, folder, "rows", [envelope("one"), envelope("two"), envelope("three").replace("SSL-PROXY", "nobody"), "[]"])
    out = P.Outputs(spark, f"{folder}/out")
    finish(P.stream_generic_sink(read_topic(spark, "rows", path=f"{folder}/in"), out, f"{folder}/cp", topic="rows", clock=CLOCK))
    stored = out.table("proxy_events").read().collect()
    assert [(r.batch_id, r.row_sequence, r.host) for r in stored] == [("b", 1, "two")]
    errors = [json.loads(r.value)["error"] for r in out.sent("rows.dlq").collect()]
    assert sorted(e.split(" not ")[0] for e in errors) == ["envelope must be a JSON object", "unknown origin 'nobody'"]


def load_item(batch, stream, payload):
    import base64

    ref = "inline://json/" + base64.urlsafe_b64encode(json.dumps(payload).encode()).decode()
    return json.dumps({"job_id": "j", "batch_id": batch, "stream_name": stream, "payload_ref": ref, "cursor_start": "", "cursor_end": ""})


def test_load_stream_refuses_bad_items_alone(spark, tmp_path):
    at = "2024-01-01T00:00:00Z"
    event = {"type": "t", "host": "h", "time": at}
    rogue = {"detected_at": at, "sensor_id": "s", "location_id": "l", "interface": "w", "channel": 1, "bssid": "b"}
    audit = lambda n: {"host": f"h{n}", "observed_at": at, "correlation_id": f"c{n}", "byte_offset": n}
    values = [
        load_item("again", "proxy.events", [event, {**event, "host": "g"}]),
        load_item("again", "proxy.events", [event, {**event, "host": "g"}]),
        load_item("shared", "proxy.events", [event]),
        load_item("shared", "wireless.rogue_ap", [{"detected_at": at}]),
        load_item("wide", "wireless.rogue_ap", [rogue, {**rogue, "channel": 40000}]),
        load_item("fits", "wireless.rogue_ap", [rogue]),
        load_item("parent", "proxy.events", [{**event, "parent_event_id": "abc"}]),
        load_item("sum", "proxy.events", [{**event, "blocked": 1, "bytes_up": 2**63 - 1, "bytes_down": 1}]),
        load_item("a1", "proxy.payload_audit", [audit(1), audit(2)]),
        load_item("a2", "proxy.payload_audit", [audit(3), audit(2)]),  # refused: a1 has 2
        load_item("a3", "proxy.payload_audit", [audit(3)]),  # free again
        load_item("a4", "proxy.payload_audit", [audit(4), audit(4)]),
        load_item("a1", "proxy.payload_audit", [audit(1), audit(2)]),
    ]
    send(spark, str(tmp_path), "sync.load", values)
    out = P.Outputs(spark, f"{tmp_path}/out")
    run = lambda: finish(P.stream_load(read_topic(spark, "sync.load", path=f"{tmp_path}/in"), out, f"{tmp_path}/cp", clock=CLOCK))
    run()
    results = lambda: sorted((r["batch_id"], r["status"], r["row_count"]) for r in (json.loads(x.value) for x in out.sent("sync.result").collect()))
    first = sorted([
        ("again", "success", 2), ("again", "success", 2), ("shared", "success", 1), ("shared", "failed", 0), ("wide", "failed", 0),
        ("fits", "success", 1), ("parent", "failed", 0), ("sum", "failed", 0), ("a1", "success", 2), ("a2", "failed", 0),
        ("a3", "success", 1), ("a4", "failed", 0), ("a1", "success", 2),
    ])
    assert results() == first
    stored = lambda: sorted(r.correlation_id for r in out.table("proxy_payload_audit").read().collect())
    assert stored() == ["c1", "c2", "c3"] and out.table("proxy_events").read().count() == 3
    assert [r.batch_id for r in out.table("wireless_alerts").read().collect()] == ["fits"]
    # stored keys count in later micro-batches too: the same batch again is fine, another one is not
    send(spark, str(tmp_path), "sync.load", [values[8], load_item("a5", "proxy.payload_audit", [audit(1)])], start=100)
    run()
    assert results() == sorted([*first, ("a1", "success", 2), ("a5", "failed", 0)]) and stored() == ["c1", "c2", "c3"]


FRAME = "source_mac string, observed_at string, destination_bssid string, ssid string, sensor_id string, location_id string, signal_dbm bigint"


@pytest.mark.parametrize("batches, shuffled", [(1, False), (2, True), (7, False), (7, True)])
def test_shadow_alerts_do_not_depend_on_micro_batches(spark, tmp_path, batches, shuffled):
    import random

    rows = [("02:00:00:00:00:0%d" % (i % 2), f"2024-01-01 00:{i:02d}:00", "b", "n", f"s{i}", "l", -40) for i in range(14)]
    # seen at 00:03 and, after all of its frames, at 00:30
    seen = [("02:00:00:00:00:00", "2024-01-01 00:03:00"), ("02:00:00:00:00:00", "2024-01-01 00:30:00")]
    networks = spark.createDataFrame([], "ssid string, bssid string, location_id string, enabled boolean")
    if shuffled:
        rows = rows + rows[3:9]  # frames are repeated, out of order and late
        random.Random(4).shuffle(rows)
    table = lambda r, shape, at: spark.createDataFrame(r, shape).withColumn(at, F.col(at).cast("timestamp_ntz"))
    out, per = P.Outputs(spark, f"{tmp_path}/out"), -(-len(rows) // batches)
    table(seen, "mac_id string, last_seen string", "last_seen").coalesce(1).write.parquet(f"{tmp_path}/seen")
    end = "2024-01-02 00:00:00"  # moves both streams on
    for n in range(batches + 1):
        part = rows[n * per : (n + 1) * per] if n < batches else [(None, end, None, None, None, None, None)]
        table(part, FRAME, "observed_at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if n == batches:
            table([(None, end)], "mac_id string, last_seen string", "last_seen").coalesce(1).write.mode("append").parquet(f"{tmp_path}/seen")
        frames = spark.readStream.schema(table([], FRAME, "observed_at").schema).parquet(f"{tmp_path}/in")
        there = spark.readStream.schema("mac_id string, last_seen timestamp_ntz").parquet(f"{tmp_path}/seen")
        finish(P.stream_shadow_alerts(frames, out, f"{tmp_path}/cp", lambda: networks, there, clock=CLOCK))
    found = {r.source_mac[-1]: (r.occurrence_count, str(r.first_occurred_at)[-8:], str(r.last_occurred_at)[-8:], r.sensor_id) for r in out.table("wireless_shadow_alerts").read().collect()}
    # device 0 was there from 00:03 for five minutes
    assert found == {"0": (4, "00:00:00", "00:12:00", "s12"), "1": (7, "00:01:00", "00:13:00", "s13")}
    sent = [json.loads(r.value) for r in out.sent("wireless.alert.shadow").collect()]
    assert sent and all(m["evidence"]["presence_window_seconds"] == 300 for m in sent)


def test_shadow_stream_runs_its_state_once_per_micro_batch(spark, tmp_path, monkeypatch):
    shape = "source_mac string, observed_at timestamp_ntz, destination_bssid string, ssid string, sensor_id string, location_id string, signal_dbm bigint"
    rows = spark.range(20).selectExpr(
        "CASE WHEN id < 19 THEN format_string('02:00:00:00:00:%02x', id) END AS source_mac",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(CASE WHEN id < 19 THEN 0 ELSE 30 END) AS observed_at",
        "'b' AS destination_bssid", "'n' AS ssid", "'s' AS sensor_id", "'l' AS location_id", "-40L AS signal_dbm",
    )
    rows.write.parquet(f"{tmp_path}/in")
    rows.filter("source_mac IS NULL").selectExpr("source_mac AS mac_id", "observed_at AS last_seen").write.parquet(f"{tmp_path}/seen")
    networks = spark.createDataFrame([], "id long, ssid string, bssid string, location_id string, enabled boolean")
    plans, plain = [], P.detect.unauthorized_frames
    monkeypatch.setattr(P.detect, "unauthorized_frames", lambda batch, n: plans.append(batch._jdf.queryExecution().logical().toString()) or plain(batch, n))
    out = P.Outputs(spark, f"{tmp_path}/out")
    read = lambda name, kind: spark.readStream.schema(kind).parquet(f"{tmp_path}/{name}")
    finish(P.stream_shadow_alerts(read("in", shape), out, f"{tmp_path}/cp", lambda: networks, read("seen", "mac_id string, last_seen timestamp_ntz"), clock=CLOCK))
    assert out.table("wireless_shadow_alerts").read().count() == 19
    assert plans and all("parquet" in p and "Join" not in p and "LogicalRDD" not in p for p in plans)


def test_a_late_frame_moves_the_first_occurrence_back(spark):
    shape = "source_mac string, observed_at timestamp_ntz, destination_bssid string, ssid string, sensor_id string, location_id string, signal_dbm bigint"
    frame = lambda at: spark.createDataFrame([("m", at, "b", "n", at, "l", -40)], shape.replace("timestamp_ntz", "string")).withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))
    empty = spark.createDataFrame([], schemas.table_schema("wireless_shadow_alerts"))
    once = T.upsert_shadow_alerts(empty, frame("2024-01-01 10:00:00"), "2024-01-31 00:00:00")
    late = T.upsert_shadow_alerts(once, frame("2024-01-01 09:00:00"), "2024-01-31 00:00:00").first()
    assert (str(late.first_occurred_at)[11:13], str(late.last_occurred_at)[11:13], late.occurrence_count, late.sensor_id[11:13]) == ("09", "10", 2, "10")


def test_generic_sink_appends_rows_of_generated_keys(spark, tmp_path):
    envelope = lambda table, **data: json.dumps({"table": table, "origin": "SSL-PROXY", "destination": "w", "data": data})
    values = [
        envelope("wireless_authorized_networks", ssid="n", id=4), envelope("wireless_authorized_networks", ssid="n", id=4),
        envelope("sync_errors", error_class="c", error_text="t"), envelope("wireless_alerts_ledger", alert_type="a", batch_id="b", row_sequence=1),
        envelope("devices", mac_id="m", hostname="one"), envelope("devices", mac_id="m", hostname="two"),
    ]
    send(spark, str(tmp_path), "rows", values)
    out = P.Outputs(spark, f"{tmp_path}/out")
    for checkpoint in ("cp", "cp2"):  # the second run is a replay of all messages
        finish(P.stream_generic_sink(read_topic(spark, "rows", path=f"{tmp_path}/in"), out, f"{tmp_path}/{checkpoint}", topic="rows", clock=CLOCK))
    count = lambda name: out.table(name).read().count()
    assert (count("wireless_authorized_networks"), count("sync_errors"), count("wireless_alerts_ledger")) == (2, 1, 1)
    assert [r.hostname for r in out.table("devices").read().collect()] == ["two"]


def test_generic_sink_decodes_its_messages_once(spark, tmp_path, monkeypatch):
    plans = []
    values = [
        json.dumps({"table": t, "origin": "SSL-PROXY", "destination": "w", "data": {"MAC_ID": "m", "batch_id": "b", "row_sequence": 1, "error_class": "c"}})
        for t in ("devices", "proxy_events", "sync_errors", "nosuch")
    ]
    send(spark, str(tmp_path), "rows", [*values, "[]"])
    out = P.Outputs(spark, f"{tmp_path}/out")
    stored = P.durable
    monkeypatch.setattr(P, "durable", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df))
    finish(P.stream_generic_sink(read_topic(spark, "rows", path=f"{tmp_path}/in"), out, f"{tmp_path}/cp", topic="rows", clock=CLOCK))
    # of the plans of the batch and its three tables, the batch's alone parses messages
    assert ["Generate explode" in p for p in plans] == [True, False, False, False]
    errors = sorted(json.loads(r.value)["error"] for r in out.sent("rows.dlq").collect())
    assert errors == ["envelope must be a JSON object", "unknown table 'nosuch'"]
    assert [out.table(n).read().count() for n in ("devices", "proxy_events", "sync_errors")] == [1, 1, 1]


def test_projected_values_are_those_of_the_printed_object(spark):
    from pyspark.sql import types as ST

    from eventloom.operators.generic import generic_project

    values = ["1.10", "1e3", "1E40", "-0.0", '"x"', "null", "true", '{"b":1.50,"a":[1e2,null]}', "[]", "[1.0,2e0]", "1e-7", '{"z":{"y":2e0}}', '""']
    docs = spark.createDataFrame([(i, '{"A":%s}' % v) for i, v in enumerate(values)], "i int, d string")
    docs = docs.select("i", F.explode(F.array(F.try_parse_json("d"))).alias("data"))
    texts = "1.1 1000 1.0E40 0 x None true {\"a\":[100,null],\"b\":1.5} [] [1,2] 1.0E-7 {\"z\":{\"y\":2}} ".split(" ")
    found = {r.i: r.a for r in generic_project(docs, ST.StructType.fromDDL("a string"), ("i",)).collect()}
    assert [str(found[i]) for i in range(len(values))] == texts
    whole = {r.i: r.a for r in generic_project(docs, ST.StructType.fromDDL("a bigint"), ("i",)).collect()}
    assert [whole[i] for i in (0, 1, 2, 4, 5, 6, 7)] == [1, 1000, None, None, None, 1, None]


def test_a_bucket_can_lose_all_of_its_rows(spark, tmp_path):
    table = S.KeyedTable(spark, f"{tmp_path}/t", spark.range(0).selectExpr("id AS k", "id AS v").schema, ["k"], buckets=4)
    table.append_new(spark.range(8).selectExpr("id AS k", "id AS v"), ["v"])
    everything = spark.range(8).selectExpr("id AS k")
    table.upsert(everything, lambda held, new: held.join(new, "k", "left_anti"), 0)
    assert table.read().count() == 0 and table.held(everything).count() == 0
    table.append_new(spark.range(3).selectExpr("id AS k", "id AS v"), ["v"])
    assert table.read().count() == 3


def test_outbox_scan_is_limited_to_the_named_folders(spark, tmp_path):
    from eventloom.sources import payload

    for day in ("d1", "d2", "d,3"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "a.json").write_text('{"day":"%s"}' % day)
    refs = spark.createDataFrame([("outbox://d1/a.json",), ("outbox://d,3/a.json",), ("outbox://none/a.json",)], "payload_ref string")
    found = payload.payload_outbox(refs, str(tmp_path))
    files = [f for f in found.inputFiles()]
    assert len(files) == 2 and not any("/d2/" in f for f in files)
    assert sorted(str(r.payload) for r in found.collect()) == ["None", '{"day":"d,3"}', '{"day":"d1"}']
    gone = payload.payload_outbox(refs.filter("payload_ref LIKE '%none%'"), str(tmp_path)).collect()
    assert [r.payload_retryable for r in gone] == [True]


def test_outbox_opens_matched_files_only_however_many_folders(spark, tmp_path):
    from eventloom.sources import payload

    odd = ["a{b", "s*", "q?", "x[1]", "c,d", "it's", "sp ace", "p+q", "pc%41"]
    folders = [f"f{i}" for i in range(1200)] + odd
    for name in folders:
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text('{"f":"%s"}' % name)
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "a.json").write_text("{}")  # a neighbour that an unescaped pattern would take
    (tmp_path / "f7" / "unnamed.json").write_text("x" * 5000)  # beyond the limit below: a scan that opens it fails
    named = [f for f in folders if f not in ("f3",)]
    refs = spark.createDataFrame([(f"outbox://{f}/a.json",) for f in (*named, "f7", "gone")], "payload_ref string")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        found = payload.payload_outbox(refs, str(tmp_path))
        rows = {r.payload_ref: r.payload for r in found.collect()}
        assert found.count() == len(named) + 2 and not any("/s1/" in f or "/f3/" in f for f in found.inputFiles())
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert rows == {f"outbox://{f}/a.json": '{"f":"%s"}' % f for f in named} | {"outbox://gone/a.json": None}
    nowhere = payload.payload_outbox(refs, f"{tmp_path}/none").collect()
    assert {r.payload_retryable for r in nowhere} == {True}


def test_an_outbox_is_read_in_passes_of_bounded_paths(spark, tmp_path, monkeypatch):
    from eventloom.sources import payload

    sizes, listed = [], payload._outbox_files
    monkeypatch.setattr(payload, "PASS_FOLDERS", 6, raising=False)
    monkeypatch.setattr(payload, "PASS_FILES", 4, raising=False)
    monkeypatch.setattr(payload, "_outbox_files", lambda s, b, folders: sizes.append(len(folders)) or listed(s, b, folders))
    for n in range(30):
        (tmp_path / f"f{n}").mkdir()
        for m in range(3):
            (tmp_path / f"f{n}" / f"{m}.json").write_text("[%d]" % (10 * n + m))
    rows = [(n, m, f"outbox://f{n}/{m}.json") for n in range(34) for m in range(4)]
    found = payload.payload_outbox(spark.createDataFrame(rows, "n int, m int, payload_ref string"), str(tmp_path)).collect()
    assert {(r.n, r.m): r.payload for r in found} == {(n, m): f"[{10 * n + m}]" if n < 30 and m < 3 else None for n, m, _ in rows}
    assert len(found) == len(rows) and sum(sizes) == 34 and max(sizes) < 20


def test_the_outbox_query_writes_and_lists_a_part_at_a_time(spark, con, monkeypatch):
    from oracle import compare

    from eventloom.plans import streams
    from eventloom.sources import payload

    monkeypatch.setattr(streams, "FILES_PER_JOB", 4)
    monkeypatch.setattr(payload, "PASS_FOLDERS", 3)
    rows, problem = compare(catalog.QUERIES["payload_outbox"](spark, "/root/testdata/sf0.001"), con, catalog.ORACLES["payload_outbox"])
    assert rows and problem is None


def test_outbox_files_of_the_query_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """A file takes its time however small it is; adaptive execution merged all of them into one task."""
    from eventloom.plans import catalog, streams

    monkeypatch.setattr(streams, "run_folder", lambda *_: f"{tmp_path}/outbox")
    rows = catalog.QUERIES["payload_outbox"](spark, "/root/testdata/sf0.01").count()
    files = [p.name for p in (tmp_path / "outbox").rglob("part-*.txt")]
    assert rows == len(files) == 100 and len({f.split("-")[1] for f in files}) > 8


def test_dedupe_drops_keys_of_any_age_and_repeats_a_replay(spark, tmp_path):
    rows = lambda *keys: spark.createDataFrame([(k, "s", 0, i) for i, k in enumerate(keys)], "dedupe_key string, stream_name string, partition int, offset bigint")
    out, given = P.Outputs(spark, f"{tmp_path}/out"), []
    ledger = S.KeyedTable(spark, f"{tmp_path}/ledger", rows().select("dedupe_key", "stream_name").schema, ["dedupe_key", "stream_name"])
    ledger.append_new(rows("old"), ["offset"])
    for n, keys in enumerate((["a", "b", "a", "old"], ["b", "c", "old"], ["a", "d"])):
        rows(*keys).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows().schema).parquet(f"{tmp_path}/in")
        sink = lambda df, epoch: given.append(sorted(r.dedupe_key for r in df.collect()))
        finish(P.stream_dedupe(stream, out, f"{tmp_path}/cp", sink, ledger=ledger))
    assert given == [["a", "b"], ["c"], ["d"]]
    seen = S.KeyedTable(spark, f"{tmp_path}/out/tables/seen_events", rows().select("dedupe_key", "stream_name").schema, ["dedupe_key", "stream_name"])
    assert sorted(r.dedupe_key for r in seen.changes(1, P.query_id(spark, f"{tmp_path}/cp")).collect()) == ["c"]


def test_wide_rows_are_projected_in_linear_time(spark):
    import time

    from eventloom.operators.generic import generic_project

    def taken(n):
        data = json.dumps({f"{'K' if i % 2 else 'k'}{i}": i for i in range(n)} | {"Wanted": 1, "wanted": 2})
        df = spark.createDataFrame([(data,)], "d string").select(F.try_parse_json("d").alias("data"))
        project = lambda: generic_project(df, spark.createDataFrame([], "wanted long, k4 string").schema).collect()
        project()
        start = time.perf_counter()
        found = project()
        assert [(r.wanted, r.k4) for r in found] == [(2, "4")]
        return time.perf_counter() - start

    assert taken(5000) < 3


def test_the_size_of_stored_rows_is_known_to_the_planner(spark):
    """A plan that drops a parsed document seems tiny: keys of a large batch were broadcast whole."""
    from eventloom.functions import json_fields as J
    from eventloom.session import durable

    texts = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.to_json(F.struct("id")).alias("value"))
    keys = J.with_parsed(texts, F.col("value")).filter("_v IS NOT NULL").select("k")
    size = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert size(durable(keys)) > 1_000_000


def test_a_merge_into_narrowed_rows_is_the_same(spark):
    held = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n bigint")
    batch = spark.createDataFrame([("a", 5, 0), ("b", 1, 1), ("c", 7, 2), ("a", 1, 3)], "k string, n bigint, o int")
    both = [M.merge(held, batch, ["k"], {"n": M.add}, ["o"], narrowed=x) for x in (False, True)]
    assert [sorted(map(tuple, df.collect())) for df in both] == [[("a", 7), ("b", 3), ("c", 7)]] * 2
    assert "Join" not in both[1]._jdf.queryExecution().optimizedPlan().toString()


def test_nothing_stored_moves_no_batch(spark, tmp_path):
    batch = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n bigint")
    table = S.KeyedTable(spark, str(tmp_path / "t"), batch.schema, ["k"])
    joined = batch.join(table.held(batch).select("k"), "k", "left_anti")
    assert "Join" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == 2


@pytest.mark.parametrize("name", ["stream_load_tables", "stream_load_errors"])
def test_the_load_queries_run_in_ranges_and_leave_no_staged_rows(spark, con, tmp_path, monkeypatch, name):
    """What a micro-batch stores goes with it, and ranges give the same tables as one micro-batch."""
    from oracle import compare

    from eventloom import session
    from eventloom.plans import streams

    started = []
    load = P.stream_load
    monkeypatch.setattr(streams, "EVENTS_PER_RUN", 300, raising=False)
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(P, "stream_load", lambda *a, **k: started.append(a) or load(*a, **k))
    rows, problem = compare(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"), con, catalog.ORACLES[name])
    assert rows and problem is None and len(started) > 2
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == {"load"} and len(list(tmp_path.iterdir())) == 1


def test_results_need_no_payload_in_their_join(spark, tmp_path, monkeypatch):
    """A micro-batch's payloads are stored once; the join with the outcomes moves their checksums."""
    from eventloom.operators import ledger

    seen, build = [], ledger.load_results
    monkeypatch.setattr(ledger, "load_results", lambda loads, now: seen.append(loads.columns) or build(loads, now))
    ref = "inline://json/W10"
    send(spark, str(tmp_path), "sync.load", [json.dumps({"job_id": "j", "batch_id": "b", "stream_name": "proxy.events", "payload_ref": ref, "cursor_start": "", "cursor_end": ""})])
    out = P.Outputs(spark, f"{tmp_path}/out")
    finish(P.stream_load(read_topic(spark, "sync.load", path=f"{tmp_path}/in"), out, f"{tmp_path}/cp", clock=CLOCK))
    result = json.loads(out.sent("sync.result").first().value)
    assert result["status"] == "success" and len(result["checksum"]) == 64
    assert seen and not {"payload", "document", "value"} & set(seen[0])

"""Merges and ordered operators against slow folds in plain Python, with ties, NULLs and one hot key."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import detect, metrics, ordering, retention
from eventloom.operators import ledger as L
from eventloom.operators import merge as M
from eventloom.operators import tables as T
from eventloom.operators.normalize import strict_rows

NOW, LATER = "2024-01-01 00:00:00", "2024-01-02 00:00:00"


def rows_with_hot_key(seed: int, n: int = 300):
    rng = random.Random(seed)
    keys = ["hot"] + [f"k{i}" for i in range(20)]
    weights = [10] + [1] * 20
    maybe = lambda v: v if rng.random() < 0.4 else None
    return [
        (rng.choices(keys, weights)[0], i, maybe(rng.randrange(9)), rng.randrange(100), maybe(f"v{rng.randrange(5)}"))
        for i in range(n)
    ]


SCHEMA = "key string, seq bigint, streak bigint, amount bigint, label string"


def fold(rows, state):
    for key, _, streak, amount, label in rows:
        old = state.get(key)
        if old is None:
            state[key] = [1, amount, label, label, amount, amount, label]
        else:
            state[key] = [
                old[0] + 1,
                old[1] + amount,
                old[2],
                label,
                min(old[4], amount),
                max(old[5], amount),
                label if label is not None else old[6],
            ]
    return state


@pytest.mark.parametrize("seed", range(3))
def test_merge_equals_fold_over_two_batches(spark, seed):
    rows = rows_with_hot_key(seed)
    df = spark.createDataFrame(rows, SCHEMA).select(
        "key", "seq", F.lit(1).cast("bigint").alias("n"), F.col("amount").alias("total"), F.col("label").alias("first"),
        F.col("label").alias("last"), F.col("amount").alias("low"), F.col("amount").alias("high"), F.col("label").alias("stated"),
    )
    rules = {"n": M.count, "total": M.add, "first": M.keep, "last": M.replace, "low": M.least, "high": M.greatest, "stated": M.last_non_null}
    table = df.limit(0).drop("seq")
    for part in (df.filter("seq < 120"), df.filter("seq >= 120").repartition(7)):
        table = M.merge(table, part, ["key"], rules, ["seq"])
    found = {r.key: [r.n, r.total, r.first, r["last"], r.low, r.high, r.stated] for r in table.collect()}
    assert found == fold(rows, {})


def test_null_keys_never_match(spark):
    table = spark.createDataFrame([("a", None, 1)], "k string, j string, v int")
    batch = spark.createDataFrame([("a", None, 2, 0), ("a", "x", 3, 1), ("a", "x", 4, 2)], "k string, j string, v int, seq int")
    merged = M.merge(table, batch, ["k", "j"], {"v": M.replace}, ["seq"], nulls_distinct=True)
    assert sorted(r.v for r in merged.collect()) == [1, 2, 4]


def test_columns_without_a_rule_stay(spark):
    table = spark.createDataFrame([("a", 1, "note")], "k string, v int, extra string")
    batch = spark.createDataFrame([("a", 2, 0), ("b", 3, 1)], "k string, v int, seq int")
    merged = M.merge(table, batch, ["k"], {"v": M.replace}, ["seq"], defaults={"extra": "new"})
    assert sorted(tuple(r) for r in merged.collect()) == [("a", 2, "note"), ("b", 3, "new")]


def test_append_of_a_known_key_fails(spark):
    table = spark.createDataFrame([("a", 1)], "k string, v int")
    batch = spark.createDataFrame([("b", 2, 0), ("a", 3, 1)], "k string, v int, seq int")
    assert M.append_unique(table, batch, ["k"], ["seq"], "ignore").count() == 2
    with pytest.raises(Exception, match="duplicate key in append"):
        M.append_unique(table, batch, ["k"], ["seq"]).collect()
    fresh = batch.filter("k = 'b'")
    assert M.append_unique(table, fresh, ["k"], ["seq"]).count() == 2


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_numbering_spans_partitions(spark, partitions):
    rows = rows_with_hot_key(7, 500)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    numbered = ordering.numbered(df, ["key"], ["seq"], "n", partitions).collect()
    expected, seen = {}, {}
    for key, seq, *_ in rows:
        seen[key] = seen.get(key, 0) + 1
        expected[(key, seq)] = seen[key]
    assert {(r.key, r.seq): r.n for r in numbered} == expected
    if partitions == 16:
        # the hot key must not sit in one partition
        spread = df.repartitionByRange(16, "key", "seq").filter("key = 'hot'").select(F.spark_partition_id()).distinct().count()
        assert spread > 2


@pytest.mark.parametrize("seed", range(3))
def test_streaks_equal_fold(spark, seed):
    rows = rows_with_hot_key(seed + 20)
    found = ordering.consecutive_counts(spark.createDataFrame(rows, SCHEMA), ["key"], ["seq"], "streak", "s")
    expected = {}
    for key, _, streak, *_ in rows:
        if key not in expected:
            expected[key] = streak
        else:
            expected[key] = streak if streak is not None else (None if expected[key] is None else expected[key] + 1)
    assert {r.key: r.s for r in found.collect()} == expected


def test_previous_value(spark):
    rows = rows_with_hot_key(5)
    found = ordering.previous_value(spark.createDataFrame(rows, SCHEMA), ["key"], ["seq"], "amount", "before").collect()
    last, expected = {}, {}
    for key, seq, _, amount, _ in rows:
        expected[seq] = last.get(key)
        last[key] = amount
    assert {r.seq: r.before for r in found} == expected


def test_first_per_key_ignores_input_order(spark):
    df = spark.createDataFrame(rows_with_hot_key(9), SCHEMA)
    one = sorted(map(tuple, ordering.dedupe_first(df.repartition(9), ["key"], ["seq"]).collect()), key=str)
    two = sorted(map(tuple, ordering.dedupe_first(df.orderBy(F.desc("seq")), ["key"], ["seq"]).collect()), key=str)
    assert one == two


def test_probe_counts_follow_the_message_order(spark):
    def message(no, batch, *probes):
        return [(no, batch, i, "net", mac, NOW, NOW, n, None, None) for i, (mac, n) in enumerate(probes)]

    # A, A again, B without the second client, A once more
    rows = [
        *message(1, "A", ("m1", 5), ("m1", 7), ("m2", 1)),
        *message(2, "A", ("m1", 5), ("m1", 7), ("m2", 1)),
        *message(3, "B", ("m1", 2)),
        *message(4, "A", ("m1", 5), ("m1", 7), ("m2", 1)),
    ]
    schema = "message_no bigint, batch_id string, pos int, ssid string, client_mac string, first_seen string, last_seen string, probe_count bigint, known_bssid string, location_id string"
    df = spark.createDataFrame(rows, schema)
    df = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})
    empty = df.limit(0).selectExpr(
        "ssid", "client_mac", "known_bssid", "first_seen", "last_seen", "probe_count", "location_id", "batch_id AS last_probe_batch_id"
    )
    whole = T.upsert_wireless_clients(empty, df, ["pos"])
    # m1: 5 + 2 + 5; m2 sees A three times in a row and counts once
    assert {r.client_mac: r.probe_count for r in whole.collect()} == {"m1": 12, "m2": 1}
    split = T.upsert_wireless_clients(empty, df.filter("message_no <= 2"), ["pos"])
    split = T.upsert_wireless_clients(split, df.filter("message_no > 2"), ["pos"])
    assert {r.client_mac: r.probe_count for r in split.collect()} == {"m1": 12, "m2": 1}


@pytest.mark.parametrize("struct", [False, True])
def test_client_runs_equal_a_fold_over_the_messages(spark, monkeypatch, struct):
    monkeypatch.setattr(T, "MESSAGES_PER_RUN", 3)  # so that runs of a batch cross the summaries
    pick = random.Random(5)
    rows = []
    for no in range(60):
        batch = pick.choice(["A", "A", "B", None])
        for pos in range(pick.randint(1, 4)):
            mac = "hot" if pick.random() < 0.6 else f"m{pick.randint(0, 3)}"
            rows.append((no, batch, pos, "net", mac, pick.choice([1, 2, 5]), pick.choice([None, "x", "y"])))
    schema = "message_no bigint, batch_id string, pos int, ssid string, client_mac string, probe_count bigint, known_bssid string"
    df = spark.createDataFrame(rows, schema).withColumn("location_id", F.lit(None).cast("string"))
    moment = F.timestamp_add("SECOND", F.col("message_no"), F.lit(NOW).cast("timestamp_ntz"))
    df = df.withColumns({"first_seen": moment, "last_seen": moment})
    early = F.col("message_no") < 25
    if struct:
        place = F.struct((F.col("message_no") > 9).cast("int").alias("partition"), F.col("message_no").alias("offset"))
        parts = [df.filter(early).withColumn("message_no", place), df.filter(~early).withColumn("message_no", place)]
    else:
        parts = [df.filter(early), df.filter(~early)]
    stored = df.limit(0).selectExpr(
        "ssid", "client_mac", "known_bssid", "first_seen", "last_seen", "probe_count", "location_id", "batch_id AS last_probe_batch_id"
    )
    for part in parts:
        stored = T.upsert_wireless_clients(stored, part, ["pos"])
    count, last, bssid, met = {}, {}, {}, set()
    for no, batch, _, _, mac, n, known in rows:
        if (no, mac) not in met:
            met.add((no, mac))
            goes_on = last.get(mac) is not None and batch in (None, last[mac])
            count[mac] = count.get(mac, 0) + (0 if goes_on else n)
            last[mac] = batch
        bssid[mac] = known or bssid.get(mac)
    found = {r.client_mac: (r.probe_count, r.last_probe_batch_id, r.known_bssid) for r in stored.collect()}
    assert found == {mac: (count[mac], last[mac], bssid[mac]) for mac in count}
    plan = T.wireless_client_deltas(parts[0], ["pos"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Window" not in plan  # the rows, then one row per client and range


def test_compat_lets_an_invalid_request_hide_a_valid_one(spark):
    rows = [(0, "k", "s", None, "{}", "x", NOW, "e"), (1, "k", "s", "ref", "{}", "x", NOW, "e")]
    schema = "place int, dedupe_key string, stream_name string, payload_ref string, payload string, payload_sha256 string, observed_text string, event_kind string"
    requests = spark.createDataFrame(rows, schema)
    ledger = spark.createDataFrame(
        [], "dedupe_key string, stream_name string, observed_at timestamp_ntz, payload_ref string, payload string, payload_sha256 string, "
        "status string, attempt_count int, last_error string, producer string, event_kind string, created_at timestamp_ntz, updated_at timestamp_ntz",
    )
    assert T.upsert_scan_requests(ledger, requests, ["place"], LATER).count() == 1
    assert T.upsert_scan_requests(ledger, requests, ["place"], LATER, compat=True).count() == 0


def test_sensor_last_seen_and_compat(spark):
    rows = [("b", 0, "s", "l1", "w", "US", "2024-01-01 10:00:00"), ("b", 1, "s", "l2", "w", "US", "2024-01-01 12:00:00"),
            ("b", 2, "s", "l3", "w", "US", "2024-01-01 10:00:00")]
    frames = spark.createDataFrame(rows, "batch_id string, row_sequence bigint, sensor_id string, location_id string, interface string, reg_domain string, observed_at string")
    frames = frames.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))
    empty = frames.limit(0).selectExpr("sensor_id", "location_id", "interface", "reg_domain", "observed_at AS first_seen_at", "observed_at AS last_seen_at")
    row = T.upsert_sensors(empty, frames, ["row_sequence"]).first()
    # of the two earliest frames the later one in the batch describes the sensor
    assert (row.location_id, str(row.first_seen_at), str(row.last_seen_at)) == ("l3", "2024-01-01 10:00:00", "2024-01-01 12:00:00")
    assert str(T.upsert_sensors(empty, frames, ["row_sequence"], compat=True).first().last_seen_at) == "2024-01-01 10:00:00"


@pytest.mark.parametrize("seed", range(2))
def test_wildcard_networks_equal_nested_loops(spark, seed):
    rng = random.Random(seed)
    some = lambda values: rng.choice([None, *values])
    frames = [(i, some(["l1", "l2"]), some(["n1", "n2", "n3"]), some(["b1", "b2"])) for i in range(200)]
    networks = [(some(["l1", "l2"]), some(["n1", "n2"]), rng.choice(["b1", "b2", "b3"]), rng.random() < 0.6) for _ in range(6)]
    ok = lambda f, n: n[3] and all(n[i] is None or n[i] == f[i + 1] for i in range(3))
    expected = {f[0] for f in frames if not any(ok(f, n) for n in networks)}
    f = spark.createDataFrame(frames, "id int, location_id string, ssid string, destination_bssid string")
    n = spark.createDataFrame(networks, "location_id string, ssid string, bssid string, enabled boolean")
    assert {r.id for r in detect.unauthorized_frames(f, n).collect()} == expected
    anything = n.unionByName(spark.createDataFrame([(None, None, None, True)], n.schema))
    assert detect.unauthorized_frames(f, anything).count() == 0


def test_form_batches_bounds_and_covers(spark):
    rows = [(f"k{i:04d}", "hot" if i % 3 else f"s{i % 5}", NOW, "processing") for i in range(400)]
    events = spark.createDataFrame(rows, "dedupe_key string, stream_name string, observed_at string, status string")
    events = events.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))  # all at the same time
    events = events.withColumn("payload", F.when(F.col("dedupe_key") != "k0000", F.concat(F.lit("{\"k\":\""), "dedupe_key", F.lit("\"}"))))
    jobs, batches, members = L.form_batches(events, 16, LATER)
    sizes = [r.row_count for r in batches.collect()]
    assert sum(sizes) == 400 and max(sizes) == 16 and members.count() == 400
    assert jobs.count() == events.select("stream_name").distinct().count()
    assert members.select("dedupe_key").distinct().count() == 400
    # one batch has an event without a payload; the others carry all of theirs
    assert [r.batch_id for r in batches.filter("payload_ref IS NULL").collect()] == [members.filter("dedupe_key = 'k0000'").first().batch_id]


def test_retention_cycle(spark):
    rows = [(f"k{i}", "s", f"2024-01-{i + 1:02d} 00:00:00") for i in range(20)]
    ledger = spark.createDataFrame(rows, "dedupe_key string, stream_name string, updated_at string")
    ledger = ledger.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    dropped = retention.retention_prune(ledger, "2024-02-10 00:00:00", keep_days=30, limit=5)
    assert [r.dedupe_key for r in dropped.orderBy("updated_at").collect()] == ["k0", "k1", "k2", "k3", "k4"]
    rest = retention.prune(ledger, dropped)
    stones = retention.tombstones_for(dropped, "2024-02-10 00:00:00")
    assert rest.count() == 15
    assert retention.tombstone_filter(ledger, stones, "2024-02-11 00:00:00").count() == 15
    assert retention.tombstone_filter(ledger, stones, "2024-04-11 00:00:00").count() == 20


def test_strict_batches(spark):
    rows = spark.createDataFrame([("a", 0, None), ("a", 1, "bad"), ("b", 0, None)], "batch_id string, row_sequence int, error string")
    assert [r.batch_id for r in strict_rows(rows).collect()] == ["b"]


def test_observed_counts(spark):
    df = spark.createDataFrame([("x", None), ("y", "bad"), ("z", None)], "v string, error string")
    watched, seen = metrics.observed(df, "ingest")
    watched.collect()
    assert seen.get == {"ingested": 2, "dead_lettered": 1}


def test_lower_medians_equal_sorting_also_of_a_hot_key(spark):
    import random

    from eventloom.operators.retention import lower_median

    rng = random.Random(3)
    rows = [("hot", rng.randrange(50)) for _ in range(3000)] + [(f"k{rng.randrange(40)}", rng.choice([None, 1, 2, 9])) for _ in range(300)] + [(None, 5), ("n", None)]
    found = {r.k: r.v for r in lower_median(spark.createDataFrame(rows, "k string, v bigint"), ["k"], "v").collect()}
    values = {}
    for k, v in rows:
        if v is not None:
            values.setdefault(k, []).append(v)
    assert found == {k: sorted(x)[(len(x) - 1) // 2] for k, x in values.items()}

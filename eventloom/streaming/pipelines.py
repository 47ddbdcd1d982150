"""The streams: topic in, operators per micro-batch, tables and topics out.

Each function starts one query.  State lives in ``KeyedTable`` s, whose rows know the last epoch
of each query that they have seen, so a restart from a query's checkpoint repeats no effect and
a query with a new checkpoint loses none.  Records sent to topics are at-least-once, like the
Kafka sink.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions import json_fields as J
from ..functions.hashing import batch_checksum, md5_batch_id
from ..functions.timestamps import parse_lenient_timestamp
from ..operators import alerts, dead_letter, detect, generic, ledger, normalize, retention, tables
from ..operators.filters import filter_reply_topic
from ..operators.merge import first_per_key
from ..session import durable, run_folder, scratch
from ..sources import messages, payload
from ..sources.tables import KeyedTable
from ..sources.topics import write_topic


@dataclass
class Outputs:
    """Where the tables and outgoing topics of a deployment live.

    ``bootstrap_servers`` sends records to Kafka; without it they are appended to
    Parquet files under ``<root>/topics``.
    """

    spark: SparkSession
    root: str
    bootstrap_servers: str | None = None
    _open: dict = field(default_factory=dict)

    def table(self, name: str) -> KeyedTable:
        """A table in buckets of its key; generated columns are left out, also as keys."""
        if name not in self._open:
            schema = schemas.table_schema(name)
            kept = type(schema)([f for f in schema.fields if not (f.metadata or {}).get("auto_inc")])
            keys = [k for k in tables.FACT_KEYS.get(name) or schemas.table_keys(name) if k in kept.names]
            self._open[name] = KeyedTable(self.spark, f"{self.root}/tables/{name}", kept, keys)
        return self._open[name]

    def send(self, records: DataFrame) -> None:
        if self.bootstrap_servers:
            write_topic(records, bootstrap_servers=self.bootstrap_servers)
        else:
            write_topic(records, path=f"{self.root}/topics")

    def sent(self, topic: str) -> DataFrame:
        return self.spark.read.schema("topic string, key string, value string").parquet(f"{self.root}/topics").filter(
            F.col("topic") == topic
        )


def utc_now() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a started query has in its checkpoint, for as long as the checkpoint lives."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def _start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def typed(df: DataFrame, table: KeyedTable) -> DataFrame:
    """Columns of the table, absent ones NULL, cast to its types."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table.schema.fields
        ]
    )


def stream_scan_ingest(
    stream: DataFrame, out: Outputs, checkpoint: str, topic: str = "proxy.payload_audit",
    interval: str | None = None, clock: Callable[[], str] = utc_now, tombstones: bool = True,
) -> StreamingQuery:
    """Audit messages -> ledger upsert; messages that fail go to the dead-letter topic."""

    def handle(batch: DataFrame, epoch: int) -> None:
        now = clock()
        good, bad = dead_letter.dlq_split(durable(messages.scan_requests(batch)))  # decoded once
        out.send(dead_letter.records(bad, topic, dead_letter.dlq_audit()))
        if tombstones:
            good = retention.tombstone_filter(good, out.table("sync_event_tombstones").read(), now)
        events = out.table("sync_events")
        writer = query_id(out.spark, checkpoint)
        order = ["partition", "offset"]
        events.upsert(good, lambda held, new: tables.upsert_scan_requests(held, new, order, now, narrowed=True), epoch, writer, removes=False)

    return _start(stream, handle, checkpoint, interval)


def stream_dedupe(
    stream: DataFrame, out: Outputs, checkpoint: str, sink: Callable[[DataFrame, int], None], keys: tuple[str, ...] = ("dedupe_key", "stream_name"),
    order: tuple[str, ...] = ("partition", "offset"), seen: str = "seen_events", ledger: KeyedTable | None = None, interval: str | None = None,
) -> StreamingQuery:
    """Gives ``sink`` the first row of each key that has never come before, of whatever age.

    Keys are remembered in the table ``seen``; keys that ``ledger`` holds count as seen, too. Both are
    read for the micro-batch's keys only, and a replayed micro-batch gives out the same rows.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        writer = query_id(out.spark, checkpoint)
        first = durable(first_per_key(batch, list(keys), list(order)))
        schema = first.select(*keys).schema
        table = KeyedTable(out.spark, f"{out.root}/tables/{seen}", schema, list(keys))
        known = first if ledger is None else first.join(ledger.held(first).select(*keys), list(keys), "left_anti")
        table.upsert(known.select(*keys), lambda held, new: new.join(held, list(keys), "left_anti"), epoch, writer, removes=False)
        sink(first.join(table.changes(epoch, writer).select(*keys), list(keys), "left_semi").select(*batch.columns), epoch)

    return _start(stream, handle, checkpoint, interval)


_FACT_TABLE = {
    "proxy.events": "proxy_events",
    "proxy.payload_audit": "proxy_payload_audit",
    "wireless.audit": "wireless_audit_frames",
    "audit.wireless.bandwidth": "wireless_bandwidth_windows",
    "wireless.probe.flush": "wireless_probe_requests",
}


PLACE = ["partition", "offset"]  # a work item is named by the place of its message


def _fitting(rows: DataFrame, table: KeyedTable) -> DataFrame:
    """``rows`` with values that the table's narrower types cannot hold as row errors, and NULL."""
    have = {f.name: f.dataType for f in rows.schema.fields}
    wider = [f for f in table.schema.fields if f.name in have and f.name not in ("batch_id", "row_sequence") and have[f.name] != f.dataType]
    errors = [
        F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.lit(f"value of {f.name} does not fit its column"))
        for f in wider
    ]
    checked = rows.withColumn("error", F.coalesce("error", *errors)) if errors else rows
    return checked.withColumns({f.name: F.col(f.name).try_cast(f.dataType) for f in wider})


def _repeated(rows: DataFrame, table: KeyedTable) -> DataFrame:
    """Items with a row whose key belongs to another batch, stored or earlier in the micro-batch.

    The same row delivered again in the same batch is no repetition.  An item that is refused
    gives its keys free, so items are refused in rounds: in each, those whose opponent stays.
    """
    keys, order = table.keys, F.struct(*PLACE, "row_sequence")
    stored = table.held(rows).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_source").alias("_owner"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    against = rows.select(*keys, *PLACE, "row_sequence", "batch_id").join(stored, same, "left")
    taken = F.col("_owner").isNotNull() & (F.col("_owner") != F.col("batch_id"))
    refused = durable(against.filter(taken).select(*PLACE).distinct())
    mine = against.select(*keys, *PLACE, "row_sequence", "batch_id")
    while True:
        live = mine.join(refused, PLACE, "left_anti")
        first = F.min_by(F.struct("batch_id", "row_sequence", *PLACE), order)
        owners = live.groupBy(*keys).agg(first.alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
        other = (F.col("batch_id") != F.col("_first.batch_id")) | (F.col("row_sequence") != F.col("_first.row_sequence"))
        claims = live.join(owners, keys).filter(other)  # audit keys are never NULL
        pairs = durable(claims.select(*PLACE, F.col("_first.partition").alias("_p"), F.col("_first.offset").alias("_o")).distinct())
        doubtful = pairs.select(F.col("partition").alias("_p"), F.col("offset").alias("_o")).distinct()
        own = (F.col("partition") == F.col("_p")) & (F.col("offset") == F.col("_o"))
        certain = pairs.filter(own).unionByName(pairs.filter(~own).join(doubtful, ["_p", "_o"], "left_anti"))
        found = certain.select(*PLACE).distinct()
        if found.isEmpty():
            return refused
        refused = durable(refused.unionByName(found))


BLOCKED = "proxy.blocked"  # the blocked-host facts beside the ten targets


def _load_table(target: str) -> str:
    if target == BLOCKED:
        return "proxy_blocked_host_rollups"
    if target in alerts.ALERT_BUILDERS:
        return "wireless_alerts"
    return _FACT_TABLE.get(target, "wireless_client_inventory")


def side_by_side(spark: SparkSession, calls: list[Callable[[], object]]) -> list:
    """Runs independent writes at the same time: small micro-batches wait for planning, not for cores."""
    with ThreadPoolExecutor(max(1, len(calls))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]]


STAGED = {"compression": "zstd"}  # JSON texts: a fraction of their size in the default codec
ITEMS_PER_FILE = 1 << 12  # a file is read by one task


def stored_items(decoded: DataFrame, out: Outputs, outbox: str | None) -> DataFrame:
    """Decoded work items, resolved and stored once in a folder per target; ``error`` and ``undecoded`` say why one is refused.

    A message's text is kept where it was not decoded, a payload where nothing is wrong with it; a
    payload is parsed again when its target's rows are made, as its document is larger than its text.
    """
    texts = {"undecoded": F.col("error"), "payload_ref": F.when(F.col("error").isNull(), F.col("payload_ref"))}
    checked = decoded.withColumns(texts | {"load_error": messages.validate_load(decoded)}).drop("error")
    resolved = payload.resolve_payload(messages.target_route(checked), outbox)
    error = F.coalesce("load_error", "route_error", "payload_error", payload.rows_error(F.col("target"), F.col("document")))
    once = resolved.select("*", F.explode(F.array(error)).alias("error"))
    good = lambda value: F.when(F.col("error").isNull() & F.col("undecoded").isNull(), value)
    kept = once.select(
        *PLACE, "key", F.when(F.col("undecoded").isNotNull(), F.col("value")).alias("value"), "job_id", "batch_id", "target",
        good(F.col("payload")).alias("payload"), good(batch_checksum(F.col("target"), F.col("payload"))).alias("checksum"),
        "payload_retryable", "undecoded", "error",
    )
    path = run_folder(out.spark, "items")
    kept.write.options(**STAGED, maxRecordsPerFile=ITEMS_PER_FILE).partitionBy("target").parquet(path)
    return out.spark.read.schema(kept.schema).parquet(path)


def staged_rows(ready: DataFrame, out: Outputs, present: list[str]) -> dict[str, DataFrame]:
    """The normalised rows of each target, stored once: the later steps read them from there.

    ``error`` is the error of a row, also where a column cannot hold its value.
    """
    parts = {}
    for target in present:
        loads = J.with_parsed(ready.filter(F.col("target") == target), F.col("payload"), "document")
        rows = normalize.normalize(payload.rows_for_target(loads, target), target, ("batch_id", *PLACE))
        parts[target] = _fitting(rows, out.table(_load_table(target)))
        if target == "proxy.events":
            valid = normalize.valid_rows(parts[target]).withColumn("error", F.lit(None).cast("string"))
            parts[BLOCKED] = _fitting(normalize.extract_blocked(valid, keep=PLACE), out.table(_load_table(BLOCKED)))
            parts[target] = parts[target].drop("row")
    path = run_folder(out.spark, "rows")
    side_by_side(out.spark, [lambda t=t, df=df: df.write.options(**STAGED).parquet(f"{path}/{t}") for t, df in parts.items()])
    return {t: out.spark.read.schema(df.schema).parquet(f"{path}/{t}") for t, df in parts.items()}


def _good(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows without those that have an error or belong to a failed item."""
    return normalize.valid_rows(rows).join(failed.select(*PLACE), PLACE, "left_anti")


def _load(ready: DataFrame, out: Outputs, now: str, epoch: int, writer: str) -> DataFrame:
    """Write the rows of resolved work items; returns ``partition, offset, row_count, row_error`` per item.

    An item with a bad row is refused as a whole, the others proceed.
    """
    present = [r["target"] for r in ready.select("target").distinct().collect()]  # at most ten targets
    if not present:
        return out.spark.createDataFrame([], "partition int, offset bigint, row_count bigint, row_error string")
    order, staged = [*PLACE, "row_sequence"], staged_rows(ready, out, [t for t in schemas.TARGETS if t in present])
    narrow = [df.select(*PLACE, "row_sequence", F.lit(t).alias("t"), F.col("error").alias("row_error")) for t, df in staged.items()]
    place = F.when(F.col("row_error").isNotNull(), F.struct("row_sequence", "t"))
    counted = F.count(F.when(F.col("t") != BLOCKED, 1))
    items = reduce(DataFrame.unionByName, narrow).groupBy(*PLACE).agg(counted.alias("row_count"), F.min_by("row_error", place).alias("row_error"))
    if "proxy.payload_audit" in present:
        audit = out.table("proxy_payload_audit")
        items = durable(items)
        sound = _good(staged["proxy.payload_audit"], items.filter("row_error IS NOT NULL"))
        repeated = _repeated(_typed_with(sound, audit, [*order, "batch_id"]), audit).withColumn("_again", F.lit("duplicate key in proxy_payload_audit"))
        items = items.join(repeated, PLACE, "left").select(*PLACE, "row_count", F.coalesce("row_error", "_again").alias("row_error"))
    items = durable(items)
    failed = items.filter("row_error IS NOT NULL")
    good = {t: _good(df, failed) for t, df in staged.items()}
    side_by_side(out.spark, _table_writes(good, out, now, epoch, writer))
    return items


def _table_writes(good: dict[str, DataFrame], out: Outputs, now: str, epoch: int, writer: str) -> list[Callable[[], object]]:
    """One write for each physical table."""
    order, writes = [*PLACE, "row_sequence"], []

    def append(target: str) -> None:
        table, rows = out.table(_FACT_TABLE[target]), good[target]
        stamped = rows if "created_at" in rows.columns else rows.withColumn("created_at", F.lit(now).cast("timestamp_ntz"))
        table.append_new(_typed_with(stamped, table, [*order, "batch_id"]), order, source="batch_id")

    writes += [lambda t=t: append(t) for t in _FACT_TABLE if t in good]
    if "wireless.client.inventory" in good:
        clients = out.table("wireless_client_inventory")
        batch = _typed_with(good["wireless.client.inventory"], clients, order)
        merge_clients = lambda held, new: typed(tables.upsert_client_inventory(held, new, order, narrowed=True), clients)
        writes.append(lambda: clients.upsert(batch, merge_clients, removes=False))
    if BLOCKED in good:
        rollup = out.table("proxy_blocked_host_rollups")
        add = lambda held, new: typed(tables.upsert_blocked_rollup(held, new, order, now), rollup)
        writes.append(lambda: rollup.upsert(good[BLOCKED], add, epoch, writer, removes=False))
    if "wireless.audit" in good:
        sensors = out.table("wireless_sensors")
        first_stored = F.coalesce("created_at", F.lit(now).cast("timestamp_ntz"))
        merge_sensors = lambda held, new: typed(tables.upsert_sensors(held, new, order, narrowed=True).withColumn("created_at", first_stored), sensors)
        writes.append(lambda: sensors.upsert(good["wireless.audit"], merge_sensors, removes=False))
    raised = [alerts.ALERT_BUILDERS[t](good[t], now) for t in good if t in alerts.ALERT_BUILDERS]
    if "audit.wireless.bandwidth" in good:
        raised.append(alerts.bandwidth_alerts(good["audit.wireless.bandwidth"], now))
    if raised:
        shaped = [typed(df, out.table("wireless_alerts")) for df in raised]
        out.table("wireless_alerts_ledger")
        writes.append(lambda: _upsert_alerts(out, shaped, now, epoch, writer))
    return writes


def _upsert_alerts(out: Outputs, raised: list[DataFrame], now: str, epoch: int, writer: str) -> None:
    """Merge alerts of all kinds, then append what changed to the alerts ledger.

    A replay finds the changes of its first run in the table, so the ledger misses none.
    """
    table, log = out.table("wireless_alerts"), out.table("wireless_alerts_ledger")
    by_window = F.col("alert_type") == "bandwidth_threshold"
    seq = ["batch_id", "row_sequence"]

    def apply(held: DataFrame, new: DataFrame) -> DataFrame:
        others = tables.upsert_alerts(held.filter(~by_window), new.filter(~by_window), seq, narrowed=True)
        windows = tables.upsert_bandwidth_alerts(held.filter(by_window), new.filter(by_window), seq, narrowed=True)
        return typed(others, table).unionByName(typed(windows, table))

    table.upsert(reduce(DataFrame.unionByName, raised), apply, epoch, writer, removes=False)
    action = F.when(F.col("_known"), "update").otherwise("insert")
    entries = table.changes(epoch, writer).withColumns({"ledger_action": action, "captured_at": F.col("updated_at")})
    # the table's key is generated: name an entry by what it says
    said = F.xxhash64("alert_type", "batch_id", "row_sequence", "ledger_action", "captured_at")
    log.append_new(_typed_with(entries.withColumns({"partition": F.lit(-1), "offset": said}), log, PLACE), ["offset"])


def _typed_with(df: DataFrame, table: KeyedTable, extra: list[str]) -> DataFrame:
    have = set(df.columns)
    columns = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields
    ]
    names = {f.name for f in table.schema.fields}
    return df.select(*columns, *[F.col(c) for c in dict.fromkeys(extra) if c not in names])


def stream_load(
    stream: DataFrame, out: Outputs, checkpoint: str, topic: str = "sync.load", result_topic: str = "sync.result",
    outbox: str | None = None, interval: str | None = None, clock: Callable[[], str] = utc_now,
) -> StreamingQuery:
    """Work items -> payload -> typed rows -> tables; one result message per work item."""

    def handle(batch: DataFrame, epoch: int) -> None:
        with scratch(out.spark, "load"):
            step(batch, epoch, clock())

    def step(batch: DataFrame, epoch: int, now: str) -> None:
        items = stored_items(messages.load_decode(batch), out, outbox)
        undecoded = items.filter("undecoded IS NOT NULL").withColumn("error", F.col("undecoded"))
        out.send(dead_letter.records(undecoded, topic, dead_letter.dlq_load(), F.col("key")))
        decoded = items.filter("undecoded IS NULL")
        done = _load(decoded.filter("error IS NULL"), out, now, epoch, query_id(out.spark, checkpoint))
        outcome = decoded.drop("key", "value", "payload").join(done, PLACE, "left").withColumns(
            {
                "error_text": F.coalesce("error", "row_error"),
                "error_class": F.when(F.col("payload_retryable"), "retryable").otherwise("permanent"),
                "row_count": F.least(F.coalesce("row_count", F.lit(0)), F.lit(2**31 - 1)),
            }
        )
        out.send(ledger.result_publish(ledger.load_results(outcome, now), result_topic))

    return _start(stream, handle, checkpoint, interval)


def stream_generic_sink(
    stream: DataFrame, out: Outputs, checkpoint: str, topic: str = "sync.rows",
    table_names: list[str] | None = None, interval: str | None = None, clock: Callable[[], str] = utc_now,
) -> StreamingQuery:
    """Envelopes -> origin check -> keyed upsert of each named table."""
    known = table_names or schemas.table_names()
    kept = ("key", "topic", *PLACE, "table", "origin", "destination", "data")

    def handle(batch: DataFrame, epoch: int) -> None:
        now = clock()
        decoded = messages.envelope_decode(batch).withColumnRenamed("error", "undecoded")
        checked = durable(dead_letter.dlq_batch_group(decoded, known).select(*kept, "undecoded", "error"))  # decoded once
        undecoded = checked.filter("undecoded IS NOT NULL").withColumn("error", F.col("undecoded"))
        valid, refused = dead_letter.dlq_split(checked.filter("undecoded IS NULL"))
        out.send(
            dead_letter.records(undecoded, topic, dead_letter.dlq_decode(undecoded, now), F.col("key")).unionByName(
                dead_letter.records(refused, topic, dead_letter.dlq_generic(refused, now), F.col("key"))
            )
        )
        named = generic.context_columns(valid).withColumn("table", F.lower("table"))
        present = {r["table"] for r in named.select("table").distinct().collect()}  # at most the known tables
        for name in [n for n in known if n.lower() in present]:
            table = out.table(name)
            mine = named.filter(F.col("table") == name.lower())
            rows = durable(generic.generic_project(mine, table.schema, ("partition", "offset")))
            if table.keys[-1] == "_offset":  # the key is generated: every envelope is a row of its own
                table.append_new(rows, PLACE)
            else:
                table.upsert(rows, lambda held, new, t=table: tables.upsert_generic(held, new, t.keys, PLACE, narrowed=True), removes=False)

    return _start(stream, handle, checkpoint, interval)


def stream_device_lookup(
    stream: DataFrame, out: Outputs, checkpoint: str, default_topic: str = "wireless.mac.lookup.reply", interval: str | None = None,
) -> StreamingQuery:
    """Lookup requests -> device replies at the allowed reply topic; unknown devices get none."""

    def handle(batch: DataFrame, epoch: int) -> None:
        asked = batch.withColumns(
            {"mac": J.extract_field(F.col("value"), "mac"), "reply_topic": J.extract_field(F.col("value"), "reply_topic")}
        ).filter(F.col("mac").isNotNull())
        answered = detect.device_lookup(filter_reply_topic(asked, default_topic), out.table("devices").read())
        out.send(answered.select(F.col("topic"), F.lit("").alias("key"), F.col("reply").alias("value")))

    return _start(stream.drop("topic"), handle, checkpoint, interval)


def stream_networks_reply(
    stream: DataFrame, out: Outputs, checkpoint: str, networks: Callable[[], DataFrame],
    default_topic: str = "wireless.networks.authorized.reply", interval: str | None = None, page_size: int = 500,
) -> StreamingQuery:
    """Every non-empty request gets the pages of authorised networks; ``networks`` re-reads the table."""

    def handle(batch: DataFrame, epoch: int) -> None:
        asked = batch.filter(F.coalesce(F.col("value") != "", F.lit(False))).withColumn(
            "reply_topic", J.extract_field(F.col("value"), "reply_topic")
        )
        answered = detect.networks_reply(asked, networks(), default_topic, page_size)
        out.send(answered.select("topic", F.lit("").alias("key"), F.col("reply").alias("value")))

    return _start(stream.drop("topic"), handle, checkpoint, interval)


def probe_rows(batch: DataFrame, value: str = "value") -> DataFrame:
    """Probe rows of flush messages: a bare array or an object with ``probes``; other messages give none."""
    text = F.col(value)
    document = F.col("document")
    listed = F.coalesce(
        F.try_variant_get(document, "$", "array<variant>"), F.try_variant_get(document, "$.probes", "array<variant>")
    )
    parsed = J.with_parsed(batch.withColumn("batch_id", md5_batch_id(text)), text, "document")
    rows = payload.explode_rows(parsed, listed, None)
    r = F.col("row")
    return rows.select(
        *batch.columns,
        "batch_id",
        "pos",
        F.coalesce(J.string_value(r, "ssid"), F.lit("")).alias("ssid"),
        F.coalesce(J.string_value(r, "client_mac"), F.lit("")).alias("client_mac"),
        parse_lenient_timestamp(J.string_value(r, "first_seen")).alias("first_seen"),
        parse_lenient_timestamp(J.string_value(r, "last_seen")).alias("last_seen"),
        F.coalesce(J.optional_long(r, "probe_count"), F.lit(1).cast("bigint")).alias("probe_count"),
        J.string_value(r, "location_id").alias("location_id"),
        F.coalesce(*[J.string_value(r, k) for k in ("observed_bssid", "known_bssid", "bssid")]).alias("observed_bssid"),
    )


def stream_probe_flush(
    stream: DataFrame, out: Outputs, checkpoint: str, networks: Callable[[], DataFrame],
    topic: str = "wireless.probe.flush", interval: str | None = None,
) -> StreamingQuery:
    """Probe messages -> client inventory; messages with a probe that cannot be stored are dead-lettered."""

    def handle(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            rows = probe_rows(batch).withColumn("message_no", F.struct("partition", "offset"))
            poison = rows.filter(F.col("first_seen").isNull() | F.col("last_seen").isNull())
            bad = poison.select("partition", "offset").distinct()
            refused = batch.join(bad, ["partition", "offset"], "left_semi").withColumns(
                {"error": F.lit("first_seen and last_seen must be timestamps"), "operation": F.lit("flush_probe_batch")}
            )
            out.send(dead_letter.records(refused, topic, dead_letter.dlq_probe(), F.lit("probe_flush")))
            good = rows.join(bad, ["partition", "offset"], "left_anti")
            known = durable(detect.probe_known_bssid(good, networks()))
            clients = out.table("wireless_clients")
            writer = query_id(out.spark, checkpoint)
            clients.upsert(known, lambda held, new: tables.upsert_wireless_clients(held, new, ["pos"]), epoch, writer, removes=False)
        finally:
            batch.unpersist()

    return _start(stream, handle, checkpoint, interval)


def stream_shadow_alerts(
    stream: DataFrame, out: Outputs, checkpoint: str, networks: Callable[[], DataFrame], seen: DataFrame,
    alert_topic: str = "wireless.alert.shadow", window_seconds: int = 60, interval: str | None = None,
    clock: Callable[[], str] = utc_now, late: str = "1 hour",
) -> StreamingQuery:
    """Frames (``source_mac, observed_at, ...``) and sightings of devices (``mac_id, last_seen``) -> shadow alerts.

    A frame counts once, however often and in whichever micro-batches it arrives, and is judged by
    the sightings before it; both may be ``late``. The alerts of a micro-batch's devices are sent
    again when it is replayed.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        now, writer = clock(), query_id(out.spark, checkpoint)
        found = detect.unauthorized_frames(durable(batch), networks())  # read twice, and each read would run the streams' state anew
        table = out.table("wireless_shadow_alerts")
        stamp = {"reason": F.lit(detect.SHADOW_REASON), "evidence": detect.shadow_evidence(window_seconds)}
        merge = lambda held, new: typed(tables.upsert_shadow_alerts(held, new, now, narrowed=True).withColumns(stamp), table)
        table.upsert(durable(found), merge, epoch, writer, removes=False)
        changed = table.changes(epoch, writer)
        out.send(changed.select(F.lit(alert_topic).alias("topic"), F.col("source_mac").alias("key"), detect.shadow_alert_json(changed).alias("value")))

    return _start(detect.shadow_frames_at(stream, seen, late), handle, checkpoint, interval)

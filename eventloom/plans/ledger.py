"""Ledger steps, dispatch, results, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import error_class
from ..operators import filters, metrics, ordering, retention
from ..operators import ledger as L
from ..sources import messages
from ..sources import tables as S
from .inputs import AS_OF, STREAMS
from .registry import CTES, query

CLAIM_STREAMS = STREAMS[:3]
_IN = "('" + "', '".join(CLAIM_STREAMS) + "')"
BACKOFF = 10 * 86_400
_NOW = f"timestamp '{AS_OF}'"

_CLAIMABLE = f"""status IN ('pending', 'failed') AND stream_name IN {_IN} AND attempt_count < 5
  AND (status = 'pending' OR updated_at <= {_NOW} - to_seconds({BACKOFF}))"""


@query("filter_claimable", f"SELECT dedupe_key, stream_name, status, attempt_count FROM v_ledger WHERE {_CLAIMABLE}")
def _(t):
    found = filters.filter_claimable(t.ledger, CLAIM_STREAMS, 5, BACKOFF, AS_OF)
    return found.select("dedupe_key", "stream_name", "status", "attempt_count")


@query("filter_pending_count", "SELECT count(*) AS pending FROM v_ledger WHERE status IN ('pending', 'processing')")
def _(t):
    return filters.filter_pending(t.ledger).agg(F.count("*").alias("pending"))


@query("pending_ledger_count", """
SELECT stream_name, status, count(*) AS pending FROM v_ledger WHERE status IN ('pending', 'processing') GROUP BY ALL""")
def _(t):
    return L.pending_ledger_count(t.ledger, ["stream_name", "status"])


_HAS_BATCH = "EXISTS (SELECT 1 FROM v_batches b WHERE b.dedupe_key = e.dedupe_key AND b.stream_name = e.stream_name)"
_LEDGER_OUT = ("dedupe_key", "stream_name", "status", "last_error", "updated_at")


@query("ledger_mark_batched", f"""
SELECT dedupe_key, stream_name, CASE WHEN status = 'processing' AND {_HAS_BATCH} THEN 'batched' ELSE status END AS status,
  last_error, CASE WHEN status = 'processing' AND {_HAS_BATCH} THEN {_NOW} ELSE updated_at END AS updated_at FROM v_ledger e""")
def _(t):
    return L.ledger_mark_batched(t.ledger, t.batches, AS_OF).select(*_LEDGER_OUT)


_EXPIRED = f"status = 'processing' AND updated_at < {_NOW} - to_seconds({BACKOFF}) AND NOT {_HAS_BATCH}"


@query("ledger_lease_expire", f"""
SELECT dedupe_key, stream_name, CASE WHEN {_EXPIRED} THEN 'failed' ELSE status END AS status,
  CASE WHEN {_EXPIRED} THEN 'coordinator processing lease expired' ELSE last_error END AS last_error,
  CASE WHEN {_EXPIRED} THEN {_NOW} ELSE updated_at END AS updated_at FROM v_ledger e""")
def _(t):
    return L.ledger_lease_expire(t.ledger, t.batches, BACKOFF, AS_OF).select(*_LEDGER_OUT)


@query("claim_topk", f"""
SELECT dedupe_key, stream_name, 'processing' AS status, attempt_count + 1 AS attempt_count, observed_at,
  {_NOW} AS updated_at, NULL::varchar AS last_error FROM v_ledger WHERE {_CLAIMABLE}
ORDER BY observed_at, dedupe_key, stream_name LIMIT 1000""")
def _(t):
    claimed = L.claim_topk(t.ledger, CLAIM_STREAMS, 5, BACKOFF, 1000, AS_OF)
    return claimed.select(
        "dedupe_key", "stream_name", "status", "attempt_count", "observed_at", "updated_at", "last_error"
    )


CTES["step_two"] = f"""
SELECT * REPLACE (CASE WHEN status = 'processing' AND {_HAS_BATCH} THEN 'batched' WHEN {_EXPIRED} THEN 'failed' ELSE status END AS status,
  CASE WHEN (status = 'processing' AND {_HAS_BATCH}) OR ({_EXPIRED}) THEN {_NOW} ELSE updated_at END AS updated_at,
  CASE WHEN {_EXPIRED} THEN 'coordinator processing lease expired' ELSE last_error END AS last_error) FROM v_ledger e"""
CTES["step_claimed"] = f"""
SELECT dedupe_key, stream_name FROM v_step_two WHERE {_CLAIMABLE} ORDER BY observed_at, dedupe_key, stream_name LIMIT 1000"""


@query("process_ingest_ledger", f"""
SELECT e.dedupe_key, e.stream_name, CASE WHEN c.dedupe_key IS NOT NULL THEN 'processing' ELSE status END AS status,
  CASE WHEN c.dedupe_key IS NOT NULL THEN attempt_count + 1 ELSE attempt_count END AS attempt_count,
  CASE WHEN c.dedupe_key IS NOT NULL THEN {_NOW} ELSE updated_at END AS updated_at,
  CASE WHEN c.dedupe_key IS NULL THEN last_error END AS last_error
FROM v_step_two e LEFT JOIN v_step_claimed c ON c.dedupe_key = e.dedupe_key AND c.stream_name = e.stream_name""")
def _(t):
    after = L.process_ingest_ledger(t.ledger, t.batches, CLAIM_STREAMS, AS_OF, 5, BACKOFF, 1000)
    return after.select("dedupe_key", "stream_name", "status", "attempt_count", "updated_at", "last_error")


@query("form_batches", """
SELECT md5('batch:' || stream_name || ':' || batch_no || ':2024-01-31T00:00:00Z') AS batch_id,
  md5('job:' || stream_name || ':2024-01-31T00:00:00Z') AS job_id, batch_no, stream_name, count(*)::int AS row_count,
  replace(min(observed_at)::varchar, ' ', 'T') || 'Z' AS cursor_start,
  replace(max(observed_at)::varchar, ' ', 'T') || 'Z' AS cursor_end
FROM (SELECT *, ((row_number() OVER (PARTITION BY stream_name ORDER BY observed_at, dedupe_key) - 1) // 50)::int AS batch_no
      FROM v_ledger WHERE status = 'processing') GROUP BY stream_name, batch_no""")
def _(t):
    _, batches, _ = L.form_batches(t.ledger, 50, AS_OF)
    return batches.select("batch_id", "job_id", "batch_no", "stream_name", "row_count", "cursor_start", "cursor_end")


CTES["picked"] = f"""
SELECT b.*, j.stream_name AS job_stream FROM v_batches b JOIN v_jobs j ON j.job_id = b.job_id
WHERE b.status = 'pending' AND j.stream_name IN {_IN}"""


@query("dispatch_topk", "SELECT batch_id, job_id, job_stream FROM v_picked ORDER BY batch_id LIMIT 50")
def _(t):
    return L.dispatch_topk(t.batches, t.jobs, CLAIM_STREAMS, 50).select("batch_id", "job_id", "job_stream")


CTES["next_batches"] = """
SELECT p.job_id, p.batch_id, 0 AS batch_no, p.job_stream AS stream_name,
  CASE WHEN coalesce(p.payload_ref, '') <> '' THEN p.payload_ref WHEN coalesce(e.payload, '') <> ''
    THEN 'inline://json/' || rtrim(translate(to_base64(encode(e.payload)), '+/', '-_'), '=') END AS payload_ref,
  coalesce(p.cursor_start, '') AS cursor_start, coalesce(p.cursor_end, '') AS cursor_end, p.attempt_count + 1 AS attempt
FROM v_picked p LEFT JOIN v_ledger e ON e.dedupe_key = p.dedupe_key AND e.stream_name = p.stream_name"""


def all_pending(t):
    allowed = t.jobs.filter(F.col("stream_name").isin(*CLAIM_STREAMS)).select(
        "job_id", F.col("stream_name").alias("job_stream")
    )
    return t.batches.filter(F.col("status") == "pending").join(allowed, "job_id")


@query("next_batches", """
SELECT *, CASE WHEN payload_ref IS NULL THEN 'batch ' || batch_id || ': payload_ref missing and no stored payload' END AS error
FROM v_next_batches""")
def _(t):
    return L.next_batches(all_pending(t), t.ledger)


@query("mark_dispatched", f"""
SELECT b.batch_id, CASE WHEN n.payload_ref IS NOT NULL THEN 'dispatched' ELSE b.status END AS status,
  CASE WHEN n.payload_ref IS NOT NULL THEN n.payload_ref ELSE b.payload_ref END AS payload_ref,
  CASE WHEN n.payload_ref IS NOT NULL THEN b.attempt_count + 1 ELSE b.attempt_count END AS attempt_count,
  CASE WHEN n.payload_ref IS NOT NULL THEN NULL ELSE b.last_error END AS last_error,
  CASE WHEN n.payload_ref IS NOT NULL THEN {_NOW} ELSE b.updated_at END AS updated_at
FROM v_batches b LEFT JOIN v_next_batches n ON n.batch_id = b.batch_id""")
def _(t):
    items = L.next_batches(all_pending(t), t.ledger).filter(F.col("error").isNull())
    batches, _ = L.mark_dispatched(t.batches, t.jobs, items, AS_OF)
    return batches.select("batch_id", "status", "payload_ref", "attempt_count", "last_error", "updated_at")


LEASE = 86_400 * 365 * 20
CTES["recovered"] = f"""
SELECT b.batch_id, b.job_id, CASE WHEN attempt_count >= 5 THEN 'failed' ELSE 'pending' END AS status,
  CASE WHEN attempt_count >= 5 THEN 'dispatch lease expired; max attempts reached' ELSE 'dispatch lease expired; retrying' END AS last_error,
  {_NOW} AS updated_at FROM v_batches b
WHERE status = 'dispatched' AND updated_at < {_NOW} - to_seconds({LEASE})
  AND EXISTS (SELECT 1 FROM v_jobs j WHERE j.job_id = b.job_id AND j.stream_name IN {_IN})"""


@query("recover_stale", "SELECT * FROM v_recovered")
def _(t):
    stale = L.recover_stale(t.batches, t.jobs, CLAIM_STREAMS, LEASE, 5, AS_OF)
    return stale.select("batch_id", "job_id", "status", "last_error", "updated_at")


@query("recover_stale_jobs", f"""
SELECT j.job_id, CASE WHEN r.failed IS NULL THEN j.status WHEN r.failed THEN 'failed' ELSE 'pending' END AS status,
  CASE WHEN r.failed IS NULL THEN j.finished_at WHEN r.failed THEN {_NOW} END AS finished_at
FROM v_jobs j LEFT JOIN (SELECT job_id, bool_or(status = 'failed') AS failed FROM v_recovered GROUP BY job_id) r ON r.job_id = j.job_id""")
def _(t):
    stale = L.recover_stale(t.batches, t.jobs, CLAIM_STREAMS, LEASE, 5, AS_OF)
    return L.jobs_after_batches(t.jobs, stale, AS_OF).select("job_id", "status", "finished_at")


# Every third order reports a failed publish; the report of every tenth names no batch.
def failures(t):
    return t.orders.select(
        F.when(F.col("o_orderkey") % 10 != 0, F.concat(F.lit("b"), "o_orderkey")).alias("batch_id"),
        F.concat(F.lit("broker said no to "), "o_orderpriority").alias("error_text"),
    )


CTES["failures"] = """
SELECT CASE WHEN o_orderkey % 10 <> 0 THEN 'b' || o_orderkey END AS batch_id,
  'broker said no to ' || o_orderpriority AS error_text FROM orders"""


@query("dispatch_failed", f"""
SELECT b.batch_id, CASE WHEN attempt_count >= 5 THEN 'failed' ELSE 'pending' END AS status, attempt_count,
  f.error_text AS last_error, {_NOW} AS updated_at
FROM v_batches b JOIN v_failures f ON f.batch_id = b.batch_id WHERE b.status = 'dispatched'""")
def _(t):
    failed = L.dispatch_failed(t.batches, failures(t), 5, AS_OF)
    return failed.select("batch_id", "status", "attempt_count", "last_error", "updated_at")


@query("dispatch_failed_jobs", f"""
SELECT j.job_id, CASE WHEN f.failed THEN 'failed' ELSE j.status END AS status,
  CASE WHEN f.failed THEN {_NOW} ELSE j.finished_at END AS finished_at
FROM v_jobs j LEFT JOIN (SELECT b.job_id, bool_or(CASE WHEN b.status = 'dispatched' THEN b.attempt_count >= 5 ELSE b.status = 'failed' END) AS failed
  FROM v_batches b JOIN v_failures f ON f.batch_id = b.batch_id GROUP BY b.job_id) f ON f.job_id = j.job_id""")
def _(t):
    named = failures(t).filter(F.col("batch_id").isNotNull())
    after = L.replace_rows(t.batches, L.dispatch_failed(t.batches, named, 5, AS_OF), ["batch_id"])
    return L.jobs_after_failure(t.jobs, after, named, AS_OF).select("job_id", "status", "finished_at")


@query("dispatch_release", f"""
SELECT b.batch_id, 'pending' AS status, greatest(attempt_count - 1, 0) AS attempt_count, f.error_text AS last_error,
  {_NOW} AS updated_at FROM v_batches b JOIN v_failures f ON f.batch_id = b.batch_id WHERE b.status = 'dispatched'""")
def _(t):
    released = L.dispatch_release(t.batches, failures(t), AS_OF)
    return released.select("batch_id", "status", "attempt_count", "last_error", "updated_at")


@query("dispatch_release_jobs", """
SELECT j.job_id, CASE WHEN h.job_id IS NOT NULL THEN 'pending' ELSE j.status END AS status,
  CASE WHEN h.job_id IS NULL THEN j.finished_at END AS finished_at
FROM v_jobs j LEFT JOIN (SELECT DISTINCT b.job_id FROM v_batches b JOIN v_failures f ON f.batch_id = b.batch_id) h ON h.job_id = j.job_id""")
def _(t):
    return L.jobs_after_release(t.jobs, t.batches, failures(t)).select("job_id", "status", "finished_at")


@query("error_log", f"""
SELECT NULL::varchar AS job_id, NULL::varchar AS batch_id, 'dispatch_publish_failed' AS error_class, error_text,
  {_NOW} AS created_at FROM v_failures WHERE batch_id IS NULL""")
def _(t):
    return L.error_log(failures(t), AS_OF)


@query("attempt_latest", """
SELECT job_id, attempt_count, s.status AS status, s.batch_id AS batch_id FROM (
  SELECT job_id, max(attempt_count) AS attempt_count,
    arg_max({'status': status, 'batch_id': batch_id}, {'a': attempt_count, 'b': batch_id}) AS s FROM v_batches GROUP BY job_id)""")
def _(t):
    placed = t.batches.withColumn("_place", F.struct("attempt_count", "batch_id"))
    latest = ordering.attempt_latest(placed, "job_id", "_place", ["status", "batch_id"])
    return latest.select("job_id", F.col("_place.attempt_count").alias("attempt_count"), "status", "batch_id")


@query("dedupe_first", """
SELECT l_orderkey, l_linenumber, r.partkey AS l_partkey, r.suppkey AS l_suppkey, r.price AS l_extendedprice FROM (
  SELECT l_orderkey, l_linenumber, min({'partkey': l_partkey, 'suppkey': l_suppkey, 'price': l_extendedprice}) AS r
  FROM lineitem GROUP BY ALL)""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return ordering.dedupe_first(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])


@query("pipeline_metrics", """
SELECT 'pending_ledger_count' AS metric, count(*) FILTER (status IN ('pending', 'processing')) AS value FROM v_ledger
UNION ALL SELECT 'ingest_processed', count(*) FILTER (status IN ('batched', 'completed')) FROM v_ledger
UNION ALL SELECT 'ingest_failed', count(*) FILTER (status = 'failed') FROM v_ledger
UNION ALL SELECT 'backpressure_active', (count(*) FILTER (status IN ('pending', 'processing')) >= 4000)::bigint FROM v_ledger
UNION ALL SELECT 'batches_dispatched', count(*) FILTER (status IN ('dispatched', 'completed')) FROM v_batches
UNION ALL SELECT 'batches_failed', count(*) FILTER (status = 'failed') FROM v_batches""")
def _(t):
    return metrics.pipeline_metrics(t.ledger, t.batches, metrics.budget_of())


_ITEM_JSON = """'{"job_id":"' || job_id || '","batch_id":"' || batch_id || '","batch_no":0,"stream_name":"' || stream_name
 || '","payload_ref":"' || payload_ref || '","cursor_start":"' || cursor_start || '","cursor_end":"' || cursor_end
 || '","attempt":' || attempt || '}'"""


@query("dispatch_publish", f"""
SELECT 'sync.load' AS topic, job_id AS key, {_ITEM_JSON} AS value FROM v_next_batches WHERE payload_ref IS NOT NULL""")
def _(t):
    items = L.next_batches(all_pending(t), t.ledger).drop("error")
    records, _ = L.dispatch_publish(items, "sync.load")
    return records


# Handled work items: every payload of the ledger, failing with the error of the same number.
def loads(t):
    e = t.errors.select(
        F.concat(F.lit("b"), "error_id").alias("batch_id"),
        F.when(F.col("error_id") % 3 != 0, F.col("message")).alias("error_text"),
        error_class(F.col("sqlstate"), F.col("code"), F.col("message")).alias("error_class"),
    )
    return t.batches.join(e, "batch_id").select(
        "job_id",
        "batch_id",
        F.col("stream_name").alias("target"),
        F.concat(F.lit('{"b":"'), "batch_id", F.lit('"}')).alias("payload"),
        (F.col("attempt_count") * 10).alias("row_count"),
        "error_text",
        "error_class",
    )


CTES["classified"] = """
SELECT *, CASE WHEN starts_with(upper(sqlstate), '08') OR starts_with(upper(sqlstate), '40') OR upper(sqlstate) IN ('HYT00', 'HYT01', '70100')
    OR coalesce(abs(code) IN (1205, 1213, 1218, 2006, 2013, 2059, 8002, 9007, 9013, 9014, 40001), false)
    OR regexp_matches(lower(message), 'timeout|temporarily unavailable|connection reset|deadlock|write conflict|lock wait|region unavailable')
  THEN 'retryable' ELSE 'permanent' END AS error_class FROM v_errors"""
CTES["results"] = """
SELECT b.job_id, b.batch_id, CASE WHEN error_id % 3 = 0 THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN error_id % 3 = 0 THEN b.attempt_count * 10 ELSE 0 END AS row_count,
  CASE WHEN error_id % 3 = 0 THEN sha256(encode(b.stream_name) || '\\x00'::blob || encode('{"b":"' || b.batch_id || '"}')) ELSE '' END AS checksum,
  error_id % 3 <> 0 AND error_class = 'retryable' AS retryable,
  CASE WHEN error_id % 3 = 0 THEN '' ELSE error_class END AS error_class,
  CASE WHEN error_id % 3 = 0 THEN '' ELSE message END AS error_text, '2024-01-31T00:00:00Z' AS finished_at
FROM v_batches b JOIN v_classified e ON 'b' || e.error_id = b.batch_id"""


@query("load_results", "SELECT * REPLACE (row_count::int AS row_count) FROM v_results")
def _(t):
    return L.load_results(loads(t), AS_OF)


@query("result_publish", """
SELECT 'sync.result' AS topic, job_id AS key, json_object('job_id', job_id, 'batch_id', batch_id, 'status', status, 'row_count', row_count,
  'checksum', checksum, 'retryable', retryable, 'error_class', error_class, 'error_text', error_text, 'finished_at', finished_at)::varchar AS value
FROM v_results""")
def _(t):
    return L.result_publish(L.load_results(loads(t), AS_OF), "sync.result")


@query("apply_batch_results", f"""
SELECT b.batch_id, CASE WHEN r.status = 'success' THEN 'completed' WHEN r.retryable THEN 'pending' ELSE 'failed' END AS status,
  CASE WHEN r.status = 'success' THEN r.checksum END AS checksum, CASE WHEN r.status <> 'success' THEN r.error_text END AS last_error,
  {_NOW} AS updated_at FROM v_batches b JOIN v_results r ON r.batch_id = b.batch_id""")
def _(t):
    sent = L.result_publish(L.load_results(loads(t), AS_OF), "sync.result")
    after = L.apply_batch_results(t.batches, L.results_from_messages(sent), AS_OF)
    return after.select("batch_id", "status", "checksum", "last_error", "updated_at")


@query("error_class", "SELECT error_id, error_class FROM v_classified")
def _(t):
    return t.errors.select("error_id", error_class(F.col("sqlstate"), F.col("code"), F.col("message")).alias("error_class"))


@query("retention_prune", f"""
SELECT dedupe_key, stream_name, updated_at FROM v_ledger WHERE updated_at < {_NOW} - to_seconds(15 * 86400)""")
def _(t):
    return retention.retention_prune(t.ledger, AS_OF, keep_days=15).select("dedupe_key", "stream_name", "updated_at")


@query("tombstones_for", f"""
SELECT dedupe_key, stream_name, {_NOW} + to_seconds(45 * 86400) AS expires_at, {_NOW} AS created_at
FROM v_ledger WHERE updated_at < {_NOW} - to_seconds(15 * 86400)""")
def _(t):
    return retention.tombstones_for(retention.retention_prune(t.ledger, AS_OF, keep_days=15), AS_OF)


# Tombstones of the orders' keys, expired for every other month.
CTES["tombstones"] = """
SELECT DISTINCT sha256('events:' || o_orderkey) AS dedupe_key,
  o_orderdate + to_seconds(86400 * 365 * 24) AS expires_at FROM orders"""


@query("tombstone_filter", f"""
SELECT dedupe_key, stream_name FROM v_ledger e WHERE NOT EXISTS (
  SELECT 1 FROM v_tombstones x WHERE x.dedupe_key = e.dedupe_key AND x.expires_at > {_NOW})""")
def _(t):
    stones = t.batches.select(F.concat(F.lit("events:"), F.substring("batch_id", 2, 20)).alias("k"), "stream_name", "updated_at")
    stones = stones.select(
        F.sha2("k", 256).alias("dedupe_key"),
        "stream_name",
        F.timestamp_add("SECOND", F.lit(86_400 * 365 * 24), F.col("updated_at")).alias("expires_at"),
    )
    return retention.tombstone_filter(t.ledger, stones, AS_OF).select("dedupe_key", "stream_name")


@query("payload_archive", f"""
SELECT dedupe_key, stream_name, observed_at, observed_at::date AS event_date, payload FROM v_ledger
WHERE observed_at < {_NOW} - to_seconds(7 * 86400) AND payload IS NOT NULL""")
def _(t):
    archive, _ = retention.payload_archive(t.ledger, AS_OF)
    return archive


@query("payload_archive_hot", f"""
SELECT dedupe_key, stream_name, CASE WHEN observed_at >= {_NOW} - to_seconds(7 * 86400) THEN payload END AS payload FROM v_ledger""")
def _(t):
    _, hot = retention.payload_archive(t.ledger, AS_OF)
    return hot.select("dedupe_key", "stream_name", "payload")


@query("filter_scan_valid", """
SELECT place, dedupe_key FROM v_scans WHERE trim(dedupe_key) <> '' AND trim(coalesce(payload_ref, '')) <> ''""")
def _(t):
    return filters.filter_scan_valid(t.scans).select("place", "dedupe_key")


@query("reconcile_except", """
SELECT DISTINCT dedupe_key, stream_name FROM v_batches WHERE dedupe_key IS NOT NULL
EXCEPT SELECT dedupe_key, stream_name FROM v_ledger""")
def _(t):
    wanted = t.batches.filter(F.col("dedupe_key").isNotNull()).select("dedupe_key", "stream_name")
    return S.reconcile_except(wanted, t.ledger.select("dedupe_key", "stream_name"))


@query("table_preflight", """
SELECT DISTINCT 'table_' || c_custkey AS table_name FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey % 1000 = c_custkey)""")
def _(t):
    wanted = t.customer.select(F.concat(F.lit("table_"), "c_custkey").alias("table_name"))
    have = t.orders.select(F.concat(F.lit("TABLE_"), F.col("o_custkey") % 1000).alias("table_name"))
    return S.table_preflight(wanted, have)


@query("validate_load", """
SELECT "offset", CASE WHEN "offset" % 11 = 1 THEN 'job_id must not be empty' WHEN "offset" % 11 = 2 THEN 'batch_id must not be empty'
  WHEN "offset" % 11 = 3 THEN 'payload_ref must not be empty' END AS error_text FROM v_work_items WHERE "offset" % 11 <> 0""")
def _(t):
    decoded = messages.load_decode(t.work_items).filter(F.coalesce("error", F.lit("")) != messages.NOT_JSON)
    return decoded.select("offset", messages.validate_load(decoded).alias("error_text"))

"""The ledger over stored tables: one re-runnable step, and the results that come back.

A trigger of the platform calls these functions; they hold no loop and no lock.  A step that
broke off is run again: every write replaces rows by key or appends keys that are not stored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import retention
from ..session import durable
from ..sources.tables import KeyedTable
from .pipelines import Outputs, typed

MEMBERS = "dedupe_key string, stream_name string, batch_id string"


def members_table(out: Outputs) -> KeyedTable:
    """Which batch each event is in."""
    schema = out.spark.createDataFrame([], MEMBERS).schema
    return KeyedTable(out.spark, f"{out.root}/tables/sync_batch_events", schema, L.EVENT_KEY)


def _replace(table: KeyedTable, changed: DataFrame) -> None:
    """Put changed rows in the place of the stored ones of their keys."""
    table.put(durable(typed(changed, table)))


def ledger_step(
    out: Outputs,
    as_of: str,
    streams: Iterable[str],
    topic: str = "sync.load",
    max_rows: int = 50,
    claim_limit: int = 1000,
    dispatch_limit: int = 50,
    max_attempts: int = 5,
    backoff_seconds: int = 30,
    lease_seconds: int = 300,
) -> None:
    """Recover stale batches, expire leases, claim, form batches and hand out the next ones."""
    streams = list(streams)
    events, jobs, batches, members = out.table("sync_events"), out.table("sync_jobs"), out.table("sync_batches"), members_table(out)

    stale = durable(L.recover_stale(batches.read(), jobs.read(), streams, lease_seconds, max_attempts, as_of))
    _replace(jobs, L.jobs_after_batches(jobs.read().join(stale.select("job_id").distinct(), "job_id", "left_semi"), stale, as_of))
    _replace(batches, stale)

    held = L.ledger_mark_batched(events.read().filter("status = 'processing'"), members.read(), as_of)
    _replace(events, L.ledger_lease_expire(held, members.read(), backoff_seconds, as_of))
    _replace(events, L.claim_topk(events.read(), streams, max_attempts, backoff_seconds, claim_limit, as_of))

    made = batches.read().filter(F.col("created_at") == F.lit(as_of).cast("timestamp_ntz"))
    first_no = durable(made.groupBy("stream_name").agg((F.max("batch_no") + 1).alias("first_no")))
    new_jobs, new_batches, links = L.form_batches(events.read(), max_rows, as_of, first_no)
    links = durable(links)
    batches.append_new(durable(typed(new_batches, batches)), ["batch_no"])
    jobs.append_new(durable(typed(new_jobs, jobs)), ["job_id"])
    members.append_new(links.select(*L.EVENT_KEY, "batch_id"), ["batch_id"])
    _replace(events, L.ledger_mark_batched(events.read().filter("status = 'processing'"), links, as_of))

    picked = durable(L.dispatch_topk(batches.read(), jobs.read(), streams, dispatch_limit))
    items = durable(L.next_batches(picked, events.read()))
    records, refused = L.dispatch_publish(items.filter("error IS NULL").drop("error"), topic)
    lost = items.filter("error IS NOT NULL").select("batch_id", F.col("error").alias("error_text"))
    failures = durable(refused.select("batch_id", "error_text").unionByName(lost))
    touched = batches.read().join(picked.select("batch_id"), "batch_id", "left_semi")
    of_jobs = jobs.read().join(picked.select("job_id").distinct(), "job_id", "left_semi")
    after_batches, after_jobs = map(durable, L.mark_dispatched(touched, of_jobs, items, as_of))
    failed = durable(L.dispatch_failed(after_batches, failures, max_attempts, as_of))
    _replace(batches, L.replace_rows(after_batches, failed, ["batch_id"]))
    _replace(jobs, L.jobs_after_failure(after_jobs, L.replace_rows(after_batches, failed, ["batch_id"]), failures, as_of))
    # equal failures of a step (at most dispatch_limit) are entries of their own
    number = F.expr("row_number() OVER (PARTITION BY error_text ORDER BY created_at)")
    errors = L.error_log(failures, as_of).withColumn("number", number)
    errors = errors.withColumns({"partition": F.lit(-1), "offset": F.xxhash64("error_text", "number", F.lit(as_of))})
    out.table("sync_errors").append_new(errors, ["offset"])
    out.send(records)


def apply_results(out: Outputs, results: DataFrame, as_of: str) -> None:
    """Results of handled work items -> batches, then the jobs and events of ended batches."""
    events, jobs, batches = out.table("sync_events"), out.table("sync_jobs"), out.table("sync_batches")
    changed = durable(L.apply_batch_results(batches.read(), results, as_of))
    _replace(batches, changed)
    of_jobs = changed.select("job_id").distinct()
    stored = batches.read().join(of_jobs, "job_id", "left_semi")
    _replace(jobs, L.jobs_after_results(jobs.read().join(of_jobs, "job_id", "left_semi"), stored, as_of))
    _replace(events, L.events_after_results(events.read(), members_table(out).read(), changed, as_of))


def retention_step(out: Outputs, as_of: str, archive: str, keep_days: int = 30, hot_days: int = 7) -> None:
    """Prune the ledger behind tombstones, and move payloads beyond the hot period to dated archive files.

    Tombstones and archive files are written before the ledger loses anything.  A step that broke off
    between the two archives payloads again: readers take one row per key.
    """
    events = out.table("sync_events")
    dropped = durable(retention.retention_prune(events.read(), as_of, keep_days).select(*L.EVENT_KEY))
    out.table("sync_event_tombstones").append_new(retention.tombstones_for(dropped, as_of), ["expires_at"])
    cold, _ = retention.payload_archive(events.read(), as_of, hot_days)
    retention.write_archive(cold, archive)
    events.remove(dropped)
    left = events.read().filter(retention.cold_payload(as_of, hot_days))  # all archived: one writer at a time
    _replace(events, left.withColumn("payload", F.lit(None).cast("string")))
    events.compact()

"""Ledger steps as set-based transforms: claim, lease, batching, dispatch, recovery, results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_fields as J
from ..functions.hashing import batch_checksum, inline_reference, md5_batch_id
from ..functions.text import clock_text
from ..functions.timestamps import as_utc, seconds_before
from ..sources.messages import validate_load, work_item_json
from .filters import filter_claimable, filter_pending
from .ordering import numbered

EVENT_KEY = ["dedupe_key", "stream_name"]
LEASE_EXPIRED = "coordinator processing lease expired"
DISPATCH_GIVEN_UP = "dispatch lease expired; max attempts reached"
DISPATCH_RETRY = "dispatch lease expired; retrying"


def pending_ledger_count(ledger: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of open events, overall or per ``by`` columns."""
    return filter_pending(ledger).groupBy(*(by or [])).agg(F.count("*").alias("pending"))


def _flag_keys(df: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """Add a boolean: does the row's key occur in ``keys``."""
    marked = keys.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(marked, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Set columns where the condition holds, keep them elsewhere."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def _batched_keys(batches: DataFrame) -> DataFrame:
    return batches.filter(F.col("dedupe_key").isNotNull() & F.col("stream_name").isNotNull()).select(*EVENT_KEY)


def ledger_mark_batched(ledger: DataFrame, batches: DataFrame, as_of) -> DataFrame:
    """Processing events that have a batch become ``batched``; only processing rows are joined."""
    processing = F.col("status") == "processing"
    flagged = _flag_keys(ledger.filter(processing), _batched_keys(batches), EVENT_KEY, "_batched")
    moved = update_where(flagged, F.col("_batched"), {"status": F.lit("batched"), "updated_at": as_utc(as_of)})
    return ledger.filter(~processing).unionByName(moved.select(*ledger.columns))


def ledger_lease_expire(ledger: DataFrame, batches: DataFrame, backoff_seconds: int, as_of) -> DataFrame:
    """Processing events without a batch whose lease ran out become ``failed``."""
    overdue = (F.col("status") == "processing") & (F.col("updated_at") < seconds_before(as_of, max(backoff_seconds, 1)))
    flagged = _flag_keys(ledger.filter(overdue), _batched_keys(batches), EVENT_KEY, "_batched")
    expired = {"status": F.lit("failed"), "updated_at": as_utc(as_of), "last_error": F.lit(LEASE_EXPIRED)}
    moved = update_where(flagged, ~F.col("_batched"), expired)
    return ledger.filter(~overdue).unionByName(moved.select(*ledger.columns))


def claim_topk(
    ledger: DataFrame, streams: Iterable[str], max_attempts: int, backoff_seconds: int, limit: int, as_of
) -> DataFrame:
    """The oldest ``limit`` claimable events, as they are after the claim."""
    candidates = filter_claimable(ledger, streams, max_attempts, backoff_seconds, as_of)
    claimed = candidates.orderBy("observed_at", *EVENT_KEY).limit(max(limit, 1))
    return update_where(
        claimed,
        F.lit(True),
        {
            "status": F.lit("processing"),
            "attempt_count": F.col("attempt_count") + 1,
            "updated_at": as_utc(as_of),
            "last_error": F.lit(None).cast("string"),
        },
    ).select(*ledger.columns)


def apply_claim(ledger: DataFrame, claimed: DataFrame) -> DataFrame:
    """Ledger with the claimed rows in place of their old versions."""
    return ledger.join(claimed.select(*EVENT_KEY), EVENT_KEY, "left_anti").unionByName(
        claimed.select(*ledger.columns)
    )


def process_ingest_ledger(
    ledger: DataFrame,
    batches: DataFrame,
    streams: list[str],
    as_of,
    max_attempts: int = 5,
    backoff_seconds: int = 30,
    limit: int = 1000,
) -> DataFrame:
    """One ledger step: mark batched, expire leases, claim the next events."""
    marked = ledger_mark_batched(ledger, batches, as_of)
    expired = ledger_lease_expire(marked, batches, backoff_seconds, as_of)
    if not streams:
        return expired
    return apply_claim(expired, claim_topk(expired, streams, max_attempts, backoff_seconds, limit, as_of))


def form_batches(events: DataFrame, max_rows: int, as_of, first_no: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Group claimed events of each stream, oldest first, into batches of at most ``max_rows``.

    Returns jobs, batches and the events with their batch.  A batch's payload, inline in its
    reference, is the array of its events' payloads; it is bounded by ``max_rows``.  A batch
    with an event without a stored payload has no reference.  ``first_no`` (``stream_name,
    first_no``) continues the numbers of streams that formed batches at ``as_of`` before.
    """
    open_events = events.filter(F.col("status") == "processing")
    placed = numbered(open_events, ["stream_name"], ["observed_at", "dedupe_key"], "_n")
    number = F.floor((F.col("_n") - 1) / max_rows).cast("int")
    if first_no is not None:
        placed = placed.join(first_no, "stream_name", "left")
        number = number + F.coalesce("first_no", F.lit(0))
    placed = placed.withColumn("batch_no", number)
    now = as_utc(as_of)
    job_id = md5_batch_id(F.concat_ws(":", F.lit("job"), "stream_name", clock_text(now)))
    batch_id = md5_batch_id(F.concat_ws(":", F.lit("batch"), "stream_name", F.col("batch_no").cast("string"), clock_text(now)))
    members = placed.withColumns({"job_id": job_id, "batch_id": batch_id})
    batches = members.groupBy("batch_id", "job_id", "batch_no", "stream_name").agg(
        F.count("*").cast("int").alias("row_count"),
        F.min("observed_at").alias("cursor_start"),
        F.max("observed_at").alias("cursor_end"),
        F.when(F.count("*") == 1, F.max("dedupe_key")).alias("dedupe_key"),
        F.sort_array(F.collect_list(F.struct("_n", "payload"))).alias("_payloads"),
    )
    whole = ~F.exists("_payloads", lambda p: F.coalesce(p["payload"], F.lit("")) == "")
    text = F.concat(F.lit("["), F.array_join(F.transform("_payloads", lambda p: p["payload"]), ","), F.lit("]"))
    batches = batches.select(
        "batch_id",
        "job_id",
        "batch_no",
        "stream_name",
        "row_count",
        clock_text(F.col("cursor_start")).alias("cursor_start"),
        clock_text(F.col("cursor_end")).alias("cursor_end"),
        "dedupe_key",
        F.when(whole, inline_reference(text)).alias("payload_ref"),
        F.lit("pending").alias("status"),
        F.lit(0).alias("attempt_count"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    jobs = members.groupBy("job_id", "stream_name").agg(
        F.lit("pending").alias("status"), F.lit(0).alias("attempt_count"), now.alias("created_at")
    )
    return jobs, batches, members.select(*EVENT_KEY, "batch_id", "job_id", "batch_no")


def dispatch_topk(batches: DataFrame, jobs: DataFrame, streams: Iterable[str], limit: int = 50) -> DataFrame:
    """The first ``limit`` pending batches, by batch id, of jobs on the given streams."""
    allowed = jobs.filter(F.col("stream_name").isin(*streams)).select("job_id", F.col("stream_name").alias("job_stream"))
    pending = batches.filter(F.col("status") == "pending")
    return pending.join(allowed, "job_id").orderBy("batch_id").limit(limit)


def next_batches(picked: DataFrame, events: DataFrame) -> DataFrame:
    """Work items of picked batches.

    A batch without a reference uses the stored payload of its event, encoded
    inline; ``error`` says when it has neither.
    """
    stored = events.select(
        F.col("dedupe_key").alias("_d"), F.col("stream_name").alias("_s"), F.col("payload").alias("_payload")
    )
    same = (F.col("dedupe_key") == F.col("_d")) & (F.col("stream_name") == F.col("_s"))
    joined = picked.join(stored, same, "left")
    given, payload = F.nullif(F.col("payload_ref"), F.lit("")), F.nullif(F.col("_payload"), F.lit(""))
    ref = F.coalesce(given, F.when(payload.isNotNull(), inline_reference(payload)))
    lost = F.concat(F.lit("batch "), F.col("batch_id"), F.lit(": payload_ref missing and no stored payload"))
    return joined.select(
        "job_id",
        "batch_id",
        F.lit(0).alias("batch_no"),
        F.col("job_stream").alias("stream_name"),
        ref.alias("payload_ref"),
        F.coalesce("cursor_start", F.lit("")).alias("cursor_start"),
        F.coalesce("cursor_end", F.lit("")).alias("cursor_end"),
        (F.col("attempt_count") + 1).alias("attempt"),
        F.when(ref.isNull(), lost).alias("error"),
    )


def mark_dispatched(batches: DataFrame, jobs: DataFrame, items: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Batches and jobs after their work items were handed out."""
    now = as_utc(as_of)
    sent = items.select("batch_id", F.col("payload_ref").alias("_ref")).withColumn("_sent", F.lit(True))
    hit = F.coalesce(F.col("_sent"), F.lit(False)) & (F.col("status") == "pending")
    new_batches = update_where(
        batches.join(sent, "batch_id", "left"),
        hit,
        {
            "payload_ref": F.col("_ref"),
            "attempt_count": F.col("attempt_count") + 1,
            "last_error": F.lit(None).cast("string"),
            "updated_at": now,
            "status": F.lit("dispatched"),
        },
    ).select(*batches.columns)
    running = _flag_keys(jobs, items, ["job_id"], "_running")
    new_jobs = update_where(
        running, F.col("_running"), {"status": F.lit("running"), "started_at": F.coalesce("started_at", now)}
    ).select(*jobs.columns)
    return new_batches, new_jobs


def recover_stale(
    batches: DataFrame, jobs: DataFrame, streams: Iterable[str], lease_seconds: int, max_attempts: int, as_of
) -> DataFrame:
    """Dispatched batches older than the lease, as they are after recovery."""
    tries = max(max_attempts, 1)
    allowed = jobs.filter(F.col("stream_name").isin(*streams)).select("job_id")
    stale = batches.filter(
        (F.col("status") == "dispatched") & (F.col("updated_at") < seconds_before(as_of, lease_seconds))
    ).join(allowed, "job_id", "left_semi")
    spent = F.col("attempt_count") >= tries
    return stale.withColumns(
        {
            "status": F.when(spent, "failed").otherwise("pending"),
            "last_error": F.when(spent, DISPATCH_GIVEN_UP).otherwise(DISPATCH_RETRY),
            "updated_at": as_utc(as_of),
        }
    ).select(*batches.columns)


def jobs_after_batches(jobs: DataFrame, changed: DataFrame, as_of) -> DataFrame:
    """Jobs of changed batches: failed when any of its batches failed, else pending."""
    outcome = changed.groupBy("job_id").agg(F.max(F.col("status") == "failed").alias("_failed"))
    joined = jobs.join(outcome, "job_id", "left")
    hit = F.col("_failed").isNotNull()
    return update_where(
        joined,
        hit,
        {
            "finished_at": F.when(F.col("_failed"), as_utc(as_of)),
            "status": F.when(F.col("_failed"), "failed").otherwise("pending"),
        },
    ).select(*jobs.columns)


def replace_rows(table: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Table with changed rows in place of the old ones."""
    return table.join(changed.select(*keys).distinct(), keys, "left_anti").unionByName(changed.select(*table.columns))


def dispatch_failed(batches: DataFrame, failures: DataFrame, max_attempts: int, as_of) -> DataFrame:
    """Dispatched batches named in ``failures(batch_id, error_text)``, after the failure."""
    tries = max(max_attempts, 1)
    named = failures.filter(F.coalesce("batch_id", F.lit("")) != "")
    reasons = named.groupBy("batch_id").agg(F.max("error_text").alias("_text"))
    hit = batches.filter(F.col("status") == "dispatched").join(reasons, "batch_id")
    return hit.withColumns(
        {
            "status": F.when(F.col("attempt_count") >= tries, "failed").otherwise("pending"),
            "last_error": F.col("_text"),
            "updated_at": as_utc(as_of),
        }
    ).select(*batches.columns)


def jobs_after_failure(jobs: DataFrame, batches_after: DataFrame, named: DataFrame, as_of) -> DataFrame:
    """Jobs of named batches: failed when one of those batches is failed, else unchanged."""
    touched = batches_after.join(named.select("batch_id").distinct(), "batch_id", "left_semi")
    outcome = touched.groupBy("job_id").agg(F.max(F.col("status") == "failed").alias("_failed"))
    joined = jobs.join(outcome, "job_id", "left")
    return update_where(
        joined,
        F.coalesce(F.col("_failed"), F.lit(False)),
        {"status": F.lit("failed"), "finished_at": as_utc(as_of)},
    ).select(*jobs.columns)


def dispatch_release(batches: DataFrame, releases: DataFrame, as_of) -> DataFrame:
    """Dispatched batches named in ``releases(batch_id, error_text)``, given back with their attempt."""
    named = releases.filter(F.coalesce("batch_id", F.lit("")) != "")
    reasons = named.groupBy("batch_id").agg(F.max("error_text").alias("_text"))
    hit = batches.filter(F.col("status") == "dispatched").join(reasons, "batch_id")
    return hit.withColumns(
        {
            "attempt_count": F.greatest(F.col("attempt_count") - 1, F.lit(0)),
            "status": F.lit("pending"),
            "last_error": F.col("_text"),
            "updated_at": as_utc(as_of),
        }
    ).select(*batches.columns)


def jobs_after_release(jobs: DataFrame, batches: DataFrame, releases: DataFrame) -> DataFrame:
    """Jobs of the named batches start over."""
    named = releases.filter(F.coalesce("batch_id", F.lit("")) != "")
    touched = batches.join(named.select("batch_id").distinct(), "batch_id", "left_semi")
    flagged = _flag_keys(jobs, touched, ["job_id"], "_hit")
    return update_where(
        flagged, F.col("_hit"), {"status": F.lit("pending"), "finished_at": F.lit(None).cast("timestamp_ntz")}
    ).select(*jobs.columns)


def error_log(failures: DataFrame, as_of, error_class: str = "dispatch_publish_failed") -> DataFrame:
    """Error rows for failures that name no batch."""
    nameless = failures.filter(F.coalesce("batch_id", F.lit("")) == "")
    return nameless.select(
        F.lit(None).cast("string").alias("job_id"),
        F.lit(None).cast("string").alias("batch_id"),
        F.lit(error_class).alias("error_class"),
        F.col("error_text"),
        as_utc(as_of).alias("created_at"),
    )


def dispatch_publish(items: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    """Valid work items as ``(topic, key, value)`` records, and the refused ones with their error."""
    checked = items.withColumn("_error", validate_load(items))
    good = checked.filter(F.col("_error").isNull())
    records = good.select(F.lit(topic).alias("topic"), F.col("job_id").alias("key"), work_item_json(items).alias("value"))
    refused = checked.filter(F.col("_error").isNotNull())
    return records, refused.select(*items.columns, F.col("_error").alias("error_text"))


def load_results(loads: DataFrame, as_of) -> DataFrame:
    """Outcome of handled work items.

    ``loads`` has ``job_id, batch_id, target, payload, row_count, error_text,
    error_class``; a NULL ``error_text`` is a success. A ``checksum`` computed before
    stands for the payload.
    """
    ok = F.col("error_text").isNull()
    empty = F.lit("")
    checksum = F.col("checksum") if "checksum" in loads.columns else batch_checksum(F.col("target"), F.col("payload"))
    return loads.select(
        F.coalesce("job_id", empty).alias("job_id"),
        F.coalesce("batch_id", empty).alias("batch_id"),
        F.when(ok, "success").otherwise("failed").alias("status"),
        F.when(ok, F.col("row_count").cast("int")).otherwise(F.lit(0)).alias("row_count"),
        F.when(ok, checksum).otherwise(empty).alias("checksum"),
        F.coalesce(~ok & (F.col("error_class") == "retryable"), F.lit(False)).alias("retryable"),
        F.when(ok, empty).otherwise(F.col("error_class")).alias("error_class"),
        F.coalesce("error_text", empty).alias("error_text"),
        clock_text(as_utc(as_of)).alias("finished_at"),
    )


def result_publish(results: DataFrame, topic: str) -> DataFrame:
    """Result records ``(topic, key, value)``."""
    names = ("job_id", "batch_id", "status", "row_count", "checksum", "retryable", "error_class", "error_text", "finished_at")
    return results.select(F.lit(topic).alias("topic"), F.col("job_id").alias("key"), F.to_json(F.struct(*names)).alias("value"))


def apply_batch_results(batches: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """Batches that have a result, as they are after it.

    Success completes a batch; a retryable failure makes it pending again, any
    other failure fails it.  The last result by ``finished_at`` decides.
    """
    last = results.groupBy("batch_id").agg(
        F.max_by(
            F.struct("status", "retryable", "checksum", "error_text", "row_count"),
            F.struct("finished_at", "status", "error_text"),
        ).alias("_r")
    )
    done = F.col("_r.status") == "success"
    state = F.when(done, "completed").when(F.col("_r.retryable"), "pending").otherwise("failed")
    return (
        batches.join(last, "batch_id")
        .withColumns(
            {
                "status": state,
                "checksum": F.when(done, F.col("_r.checksum")),
                "last_error": F.when(~done, F.col("_r.error_text")),
                "updated_at": as_utc(as_of),
            }
        )
        .select(*batches.columns)
    )


def jobs_after_results(jobs: DataFrame, batches: DataFrame, as_of) -> DataFrame:
    """Jobs whose batches have all ended, as they are then: failed if one of these failed, else completed."""
    ended = F.col("status").isin("completed", "failed")
    outcome = batches.groupBy("job_id").agg(F.min(ended).alias("_ended"), F.max(F.col("status") == "failed").alias("_failed"))
    done = outcome.filter("_ended").join(jobs.filter(~ended), "job_id")
    return done.withColumns(
        {"status": F.when(F.col("_failed"), "failed").otherwise("completed"), "finished_at": as_utc(as_of)}
    ).select(*jobs.columns)


def events_after_results(events: DataFrame, members: DataFrame, batches: DataFrame, as_of) -> DataFrame:
    """Batched events whose batch ended, as they are then; ``members`` links events and batches."""
    ended = batches.filter(F.col("status").isin("completed", "failed")).select(
        "batch_id", F.col("status").alias("_to"), F.col("last_error").alias("_why")
    )
    moved = members.join(ended, "batch_id").select(*EVENT_KEY, "_to", "_why")
    return (
        events.filter(F.col("status") == "batched")
        .join(moved, EVENT_KEY)
        .withColumns({"status": F.col("_to"), "last_error": F.col("_why"), "updated_at": as_utc(as_of)})
        .select(*events.columns)
    )


def results_from_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Result messages parsed back into columns."""
    v = J.parse_json(F.col(value))
    texts = ("job_id", "batch_id", "status", "checksum", "error_class", "error_text", "finished_at")
    return messages.select(
        *[J.string_value(v, n).alias(n) for n in texts],
        J.optional_long(v, "row_count").alias("row_count"),
        F.coalesce(J.optional_boolean(v, "retryable"), F.lit(False)).alias("retryable"),
    )

"""Pipeline counters and the back-pressure state over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .filters import filter_pending
from .ordering import hysteresis


def pipeline_metrics(ledger: DataFrame, batches: DataFrame, budget: int) -> DataFrame:
    """Counters as (metric, value): open events, throttle state, processed, dispatched, failed."""
    events = ledger.agg(
        F.count_if(F.col("status").isin("pending", "processing")).alias("pending_ledger_count"),
        F.count_if(F.col("status").isin("batched", "completed")).alias("ingest_processed"),
        F.count_if(F.col("status") == "failed").alias("ingest_failed"),
    )
    events = events.withColumn("backpressure_active", (F.col("pending_ledger_count") >= budget).cast("bigint"))
    sent = batches.agg(
        F.count_if(F.col("status").isin("dispatched", "completed")).alias("batches_dispatched"),
        F.count_if(F.col("status") == "failed").alias("batches_failed"),
    )
    return _long(events).unionByName(_long(sent))


def _long(row: DataFrame) -> DataFrame:
    return row.unpivot([], row.columns, "metric", "value")


def observed(df: DataFrame, name: str, error: str = "error") -> tuple[DataFrame, Observation]:
    """Count good and bad rows while they flow by; read the result after an action."""
    seen = Observation(name)
    counts = [
        F.count_if(F.col(error).isNull()).alias("ingested"),
        F.count_if(F.col(error).isNotNull()).alias("dead_lettered"),
    ]
    return df.observe(seen, *counts), seen


def budget_of(ingest_batch_size: int = 1000, multiplier: int = 4) -> int:
    return ingest_batch_size * multiplier


def pending_timeline(ledger: DataFrame, tick: str = "hour") -> DataFrame:
    """Open events that have arrived up to the end of each tick, per stream.

    Events are counted per tick first, so the running sum sees one row per tick.
    """
    per_tick = (
        filter_pending(ledger)
        .groupBy("stream_name", F.date_trunc(tick, "observed_at").cast("timestamp_ntz").alias("tick"))
        .agg(F.count("*").alias("_n"))
    )
    upto = W.partitionBy("stream_name").orderBy("tick").rowsBetween(W.unboundedPreceding, 0)
    return per_tick.select("stream_name", "tick", F.sum("_n").over(upto).alias("pending"))


def backpressure_timeline(counts: DataFrame, budget: int, order: str = "tick") -> DataFrame:
    """Add ``suspended``: on at the budget, off at half of it, else as before; per stream."""
    upto = W.partitionBy("stream_name").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    on, off = F.col("pending") >= budget, F.col("pending") <= budget // 2
    return counts.withColumn("suspended", hysteresis(on, off, upto))

"""Order-dependent operators that do not put a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import durable
from .merge import first_per_key

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index of a partition in its low 33 bits


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "n", partitions: int | None = None) -> DataFrame:
    """Add the 1-based position of each row in its group.

    A window over ``group`` would sort a hot group in one task.  Here the rows
    are range-partitioned on group *and* order columns, which must be unique
    together, so a hot group spans many partitions.  Each partition numbers its
    own rows; the number of rows of the same group in earlier partitions is
    added from a table with one row per (partition, group start), whose size is
    bounded by partitions plus groups.  The sorted rows are written once, because
    the numbering must not change when a lost task is run again.
    """
    keys = [*group, *order]
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    row_id = F.monotonically_increasing_id()
    placed = durable(spread.sortWithinPartitions(*keys).withColumn("_id", row_id))
    part = F.shiftright("_id", _LOCAL_BITS)
    local = F.col("_id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    placed = placed.withColumns({"_part": part, "_local": local}).drop("_id")
    sizes = placed.groupBy("_part", *group).agg(F.count("*").alias("_rows"), F.min("_local").alias("_first"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_part").alias("_p"),
        *[F.col(g).alias(f"_g_{g}") for g in group],
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = placed.join(offsets, same, "inner")
    return joined.select(*df.columns, (F.col("_local") + F.col("_shift")).alias(name))


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in ``order``; copies are dropped in every task before the shuffle."""
    return first_per_key(df, keys, order)


def last_non_null_per_key(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Per key the last non-NULL value of each column."""
    seq = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), seq)).alias(c) for c in columns])


def consecutive_counts(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Per key the fold ``s = coalesce(new, s + 1)`` over its rows in order.

    This is the last stated value plus the number of rows after it; a key that never
    states a value stays NULL.  Both are partial aggregates; the table of last places has
    one row per key and is stored, so that the join between them can split a hot key.
    """
    seq = F.struct(*order)
    place = F.when(F.col(value).isNotNull(), seq)
    last = durable(df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max_by(value, place).alias("_value"), F.max(place).alias("_last")))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    rows = df.select(*keys, *order).join(last, same)
    return rows.groupBy(*keys).agg((F.first("_value") + F.count(F.when(seq > F.col("_last"), 1))).alias(name))


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add ``value`` of the row before in the same key.

    The rows are sorted over all partitions once, as in ``numbered``, so that a hot key spans
    many of them.  Within a partition the row before is the one in place before; the first
    row's is the last one of an earlier partition, from a table with one row per partition.
    """
    sort = [*keys, *order]
    placed = durable(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", _LOCAL_BITS))
    said = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).alias("v"))
    lasts = placed.groupBy("_part").agg(F.max_by(said, "_id").alias("_last"))
    # a few bytes for each partition of the sort
    edges = lasts.select(F.lead("_part").over(W.orderBy("_part")).alias("_next"), F.col("_last").alias("_edge")).filter("_next IS NOT NULL")
    local = placed.withColumn("_before", F.lag(said).over(W.partitionBy("_part").orderBy("_id")))
    joined = local.join(edges, F.col("_part") == F.col("_next"), "left")
    before = F.coalesce("_before", "_edge")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & before[f"k{i}"].eqNullSafe(F.col(k))
    return joined.select(*df.columns, F.when(before.isNotNull() & same, before["v"]).alias(name))


def hysteresis(active_on: Column, active_off: Column, order_window) -> Column:
    """Switch state: on at ``active_on``, off at ``active_off``, else as before; off at the start."""
    change = F.when(active_on, F.lit(True)).when(active_off, F.lit(False))
    return F.coalesce(F.last(change, ignorenulls=True).over(order_window), F.lit(False))


def attempt_latest(df: DataFrame, key: str, attempt: str, columns: list[str]) -> DataFrame:
    """Per key the columns of its highest attempt, and that attempt."""
    latest = df.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(attempt)).alias("_r"), F.max(attempt).alias(attempt))
    return latest.select(key, attempt, *[F.col(f"_r.{c}").alias(c) for c in columns])

"""Keyed merge of a batch into a table, column by column.

Batch rows are folded in their order onto the stored row of the same key.  The
fold is written as aggregates over ``(side, order)``, where the stored row comes
first, so each task reduces its rows before the shuffle and a key that holds a
third of the batch costs one row per task.

Only stored rows whose key occurs in the batch enter the aggregation; the rest of
the table is passed on by an anti join on the batch's distinct keys, which Spark
broadcasts when they are small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Column, Column, Column], Column]

_SIDE, _SEQ = "_side", "_seq"


def keep(value: Column, seq: Column, side: Column) -> Column:
    """The stored value; for a new key the first one of the batch."""
    return F.min_by(value, seq)


def replace(value: Column, seq: Column, side: Column) -> Column:
    """The value of the last row, also when it is NULL."""
    return F.max_by(value, seq)


def add(value: Column, seq: Column, side: Column) -> Column:
    return F.sum(value)


def count(value: Column, seq: Column, side: Column) -> Column:
    """Stored count plus one per batch row."""
    return F.sum(F.when(side == 0, value).otherwise(F.lit(1)))


def last_non_null(value: Column, seq: Column, side: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), seq))


def least(value: Column, seq: Column, side: Column) -> Column:
    return F.min(value)


def greatest(value: Column, seq: Column, side: Column) -> Column:
    return F.max(value)


def newest(by: str) -> Rule:
    """The value of the row with the greatest ``by``; a later row wins a tie."""
    return lambda value, seq, side: F.max_by(value, F.struct(F.col(by), seq))


def stored(expression: Callable[[Column], Column], fresh: Column) -> Rule:
    """A value computed from the stored one alone, ``fresh`` for a new key."""

    def rule(value: Column, seq: Column, side: Column) -> Column:
        exists = F.max(side == 0)
        before = F.max(F.when(side == 0, value))
        return F.when(exists, expression(before)).otherwise(fresh)

    return rule


def distinct_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    return df.select(*keys).distinct()


def merge(
    target: DataFrame,
    batch: DataFrame,
    keys: list[str],
    rules: dict[str, Rule],
    order: list[str],
    nulls_distinct: bool = False,
    defaults: dict[str, object] | None = None,
    narrowed: bool = False,
) -> DataFrame:
    """New state of ``target`` after upserting ``batch``.

    ``order`` names batch columns that order its rows totally.  ``rules`` gives
    the rules of the non-key columns.  Further columns of the table are kept as
    stored; new keys get the batch's value, else the one in ``defaults``, else
    NULL.  With ``nulls_distinct`` a row with a NULL key column never matches
    another and is simply added.  ``narrowed`` says that ``target`` holds no key but
    the batch's, so no row has to be passed on.
    """
    rules = {**rules, **{c: keep for c in target.columns if c not in rules and c not in keys}}
    columns = [*keys, *rules]
    absent = {
        c: F.lit((defaults or {}).get(c)).cast(target.schema[c].dataType) for c in columns if c not in batch.columns
    }
    if absent:
        batch = batch.withColumns(absent)
    loose = None
    if nulls_distinct:
        no_null = F.lit(True)
        for k in keys:
            no_null = no_null & F.col(k).isNotNull()
        loose = batch.filter(~no_null).select(*columns)
        batch = batch.filter(no_null)
    touched, untouched = target, None
    if not narrowed:
        touched_keys = distinct_keys(batch, keys)
        same = _same_keys(target, touched_keys, keys)
        touched = target.join(touched_keys, same, "left_semi")
        untouched = target.join(touched_keys, same, "left_anti").select(*columns)

    no_order = F.struct(*[F.lit(None).cast(batch.schema[c].dataType).alias(c) for c in order])
    old = touched.select(*columns, F.lit(0).alias(_SIDE), F.struct(F.lit(0).alias("s"), no_order.alias("o")).alias(_SEQ))
    new = batch.select(
        *columns, F.lit(1).alias(_SIDE), F.struct(F.lit(1).alias("s"), F.struct(*order).alias("o")).alias(_SEQ)
    )
    merged = fold(old.unionByName(new), keys, rules)
    out = merged if untouched is None else untouched.unionByName(merged)
    return out if loose is None else out.unionByName(loose)


def fold(rows: DataFrame, keys: list[str], rules: dict[str, Rule]) -> DataFrame:
    """Apply ``rules`` per key to rows that carry ``_side`` and ``_seq``."""
    seq, side = F.col(_SEQ), F.col(_SIDE)
    # columns that come whole from the first or the last row share one aggregate
    first = [c for c, rule in rules.items() if rule is keep]
    last = [c for c, rule in rules.items() if rule is replace]
    aggregates = [rule(F.col(c), seq, side).alias(c) for c, rule in rules.items() if rule not in (keep, replace)]
    if first:
        aggregates.append(F.min_by(F.struct(*first), seq).alias("_first"))
    if last:
        aggregates.append(F.max_by(F.struct(*last), seq).alias("_last"))
    source = {**{c: f"_first.{c}" for c in first}, **{c: f"_last.{c}" for c in last}}
    merged = rows.groupBy(*keys).agg(*aggregates)
    return merged.select(*keys, *[F.col(source.get(c, c)).alias(c) for c in rules])


def _same_keys(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def held_keys(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the batch that the table holds; the table side is scanned for its key columns only."""
    wanted = distinct_keys(batch, keys)
    return target.select(*keys).join(wanted, _same_keys(target, wanted, keys), "left_semi").distinct()


def new_rows(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first batch row of each key that the table does not hold yet: what an append has to write."""
    fresh = batch.join(held_keys(target, batch, keys), keys, "left_anti")
    return first_per_key(fresh, keys, order, target.columns)


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table with the batch's new keys added."""
    return target.unionByName(new_rows(target, batch, keys, order))


def first_per_key(rows: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """The first row of each key, reduced in every task before the shuffle."""
    columns = columns or rows.columns
    others = [c for c in columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in columns])


def duplicate_keys(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that the batch repeats or that the table holds already."""
    repeated = batch.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select(*keys)
    return repeated.unionByName(held_keys(target, batch, keys)).distinct()


def append_unique(
    target: DataFrame, batch: DataFrame, keys: list[str], order: list[str], on_duplicate: str = "error"
) -> DataFrame:
    """Append a batch whose keys must be new.

    ``on_duplicate="ignore"`` keeps the first row of each key; ``"error"`` makes
    the result fail when it is computed and a duplicate exists.
    """
    if on_duplicate == "ignore":
        return insert_ignore(target, batch, keys, order)
    bad = duplicate_keys(target, batch, keys).withColumn("_bad", F.lit(True))
    marked = batch.join(bad, keys, "left")
    stop = F.raise_error(F.lit("duplicate key in append")).cast("boolean")
    checked = marked.filter(F.when(F.col("_bad"), stop).otherwise(F.lit(True)))
    return target.unionByName(checked.select(*target.columns))

"""Helpers shared by the operators: text expressions, staged tables and connected components."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import run_folder

WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to a new folder below the shared one and read back.

    This cuts the lineage and survives lost executors; a later join also knows the
    real size of the table.
    """
    path = run_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row.

    A plain column may be copied into every place that uses it, also into a lambda
    that runs once per element; a lambda argument is not.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def held_out(doc_id: Column, buckets: int, bucket: int) -> Column:
    """True if CRC-32 of the id as text leaves ``bucket``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % buckets == bucket, F.lit(False))


def hash_unit(*columns: Column, seed: int) -> Column:
    """A uniform number in (0, 1) from a hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 12).cast("double") + 0.5) / float(2**52)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of links ``(a, b)`` of longs: ``(node, root)``, root the smallest node.

    Alternating star operations: each node links its larger neighbours, then its smaller
    ones, to the smallest node it knows. Minima are partial aggregates; the joins run
    between staged tables, so that adaptive execution can split a hub's rows.
    """

    def link(pairs: DataFrame, name: str) -> DataFrame:
        return staged(pairs.filter("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), name)

    def signature(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = link(edges.select("a", "b"), "links")
    before = signature(current)
    for _ in range(rounds):
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select("b", "a"))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = link(current.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        small = staged(large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")), "small")
        joined = large.join(small, F.col("b") == F.col("u"))
        current = link(
            joined.select(F.col("a"), F.col("m").alias("b")).union(small.select(F.col("u"), F.col("m"))), "links"
        )
        after = signature(current)
        if after == before:
            return current.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")

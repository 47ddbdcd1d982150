"""Mixing sources to target weights by Poisson replication.

A source whose documents should be repeated ``rate`` times on average gets a Poisson number of
copies of each: the inverse Poisson distribution at a uniform number hashed from seed and id.
Copies are exploded and shuffled globally by a hash of id and copy number.

Target weights are a parameter (source -> weight); without it a source's weight is a power
``temperature`` of its number of documents. ``size`` is the expected number of output rows as a
multiple of the input rows. The distribution of each source is a small table made from counts
of all rows; Spark joins it by broadcast while it is small, by a skew-splitting join beyond.

Defined results: null is a source like any other; sources without a weight get none; rows of
equal id and source get equally many copies each; null ids hash like an id; null and empty texts
are replicated like any other; an empty table gives no rows; further columns travel along.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table
from .registry import query

SEED = 6
TEMPERATURE = 0.5
SIZE = 1.0
HASH_BITS = 52


def poisson_cdf(rate: float) -> list[float]:
    """Cumulative probabilities of 0, 1, .. up to where doubles reach one."""
    if not rate > 0:
        return [1.0]
    most = int(rate + 12 * np.sqrt(rate) + 40)
    log = np.concatenate(([0.0], np.cumsum(np.log(rate) - np.log(np.arange(1, most + 1))))) - rate
    return np.minimum(np.cumsum(np.exp(log)), 1.0).tolist()


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 of seed and id."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << HASH_BITS)


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, size: float = SIZE) -> DataFrame:
    """``source, rows, rate`` of every source of all rows of ``docs``."""
    counts = docs.groupBy("source").agg(F.count("*").alias("rows"))
    if weights is None:
        weight = F.pow(F.col("rows").cast("double"), F.lit(temperature))
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(given[F.col("source")], F.lit(0.0))
    weighted = staged(counts.withColumn("weight", weight), "mix-weights")  # one row per source
    total = weighted.agg(F.sum("rows").alias("all_rows"), F.sum("weight").alias("all_weight")).first()
    if not total["all_weight"]:
        return weighted.select("source", "rows", F.lit(0.0).alias("rate"))
    return weighted.select(
        "source", "rows", (F.lit(float(size * total["all_rows"])) * F.col("weight") / F.lit(total["all_weight"]) / F.col("rows")).alias("rate")
    )


def _with_cdf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"mix_source": batch["source"], "rate": batch["rate"], "cdf": [poisson_cdf(r) for r in batch["rate"]]})


def replicated(docs: DataFrame, seed: int = SEED, **targets) -> DataFrame:
    """``row`` (a struct of the input's columns), its ``copy`` number from 0, ``rate`` and ``shuffle_key``,
    dealt out by the key and sorted by it in each partition."""
    cdf = staged(rates(docs, **targets).select("source", "rate").mapInPandas(_with_cdf, "mix_source string, rate double, cdf array<double>"), "mix-cdf")
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("from_source"))
    joined = whole.join(cdf, F.col("from_source").eqNullSafe(F.col("mix_source")))
    u = uniform(F.col("id"), seed)
    counted = joined.select("row", "id", "rate", "cdf", F.explode(F.array(u)).alias("u")).select(
        "row", "id", "rate", F.size(F.filter("cdf", lambda c: c < F.col("u"))).alias("n")
    )
    copies = counted.filter("n > 0").select("row", "id", "rate", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null")), "copy")
    keyed = copies.select("row", "rate", "copy", key.alias("shuffle_key"), F.monotonically_increasing_id().alias("place"))
    # rows of one id have one key: their place in the input spreads them
    dealt = keyed.repartition("shuffle_key", F.pmod("place", F.lit(1009)))
    return dealt.sortWithinPartitions("shuffle_key", "place").drop("place")


def mixed(docs: DataFrame, **targets) -> DataFrame:
    """The columns of ``docs``, each row as often as its source's target wants."""
    return replicated(docs, **targets).select("row.*")


ORACLE = f"""
WITH n AS (SELECT source, count(*) AS rows, pow(CAST(count(*) AS DOUBLE), {TEMPERATURE}) AS w FROM documents GROUP BY source),
t AS (SELECT sum(rows) AS all_rows, sum(w ORDER BY source) AS all_w FROM n),
r AS (SELECT source, CAST(all_rows AS DOUBLE) * w / all_w / rows AS rate FROM n, t),
u AS (SELECT doc_id, r.source, rate,
    (CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
p AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM r, range(0, 400) g(k)),
c AS (SELECT doc_id, u.source, rate, (SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM u.source AND p.cdf < u.u AND p.k < 399) AS n FROM u)
SELECT doc_id, source, CAST(unnest(range(0, n)) AS INTEGER) AS copy, round(rate, 6) AS rate FROM c WHERE n > 0
"""


@query("op6_mixing", ORACLE)
def op6_mixing(spark, sf_dir):
    found = replicated(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "copy", F.round("rate", 6).alias("rate"))

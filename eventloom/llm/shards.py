"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Rows are staged with their partition and place (their number within it).
2. Row ``i`` of the matrix says how many rows of partition ``i`` go to each shard. Under a
   uniform permutation the matrix follows the multivariate hypergeometric law with the
   partition sizes and shard sizes as margins. It is drawn by halving the list of partitions:
   each half gets a share of every shard, and so on down to single partitions. Every draw has
   a seed of its own, so each task draws its own row from the partition sizes alone, in
   logarithmically many steps.
3. A seeded permutation of a partition's rows deals them to the shards by these counts, the
   rows are exchanged, and every shard is permuted again: in ascending order of a hash.

A shard is permuted in blocks, equal ranges of the hash with about ``BLOCK_ROWS`` rows and
``BLOCK_BYTES`` bytes at most. A block's first slot is the number of rows in its shard's earlier
blocks, so that no task holds a whole shard.

Law ``rows``: shard sizes differ by at most one. Equal texts (and any other group) are spread
like all rows. Null and empty texts are rows of 16 bytes; null and repeated ids are rows of their
own; with fewer rows than shards some shards are empty; an empty table gives no rows; further
columns of the input travel along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table
from .registry import query

SHARDS = 40
BLOCK_ROWS = 50_000
BLOCK_BYTES = 64 << 20
OVERHEAD = 16
SEED = 9
LAW = "rows"


def hypergeometric(good: int, bad: int, drawn: int, rng: np.random.Generator) -> int:
    """One exact draw; numpy's own is limited to populations below 10^9."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn else 0
    low, high = max(0, drawn - bad), min(drawn, good)
    mean = drawn * (good / (good + bad))
    spread = np.sqrt(max(mean * (bad / (good + bad)), 1.0))
    a, b = max(low, int(mean - 14 * spread) - 2), min(high, int(mean + 14 * spread) + 2)
    x = np.arange(a, b, dtype=np.float64)
    # the ratio of neighbouring probabilities
    ratio = np.log(good - x) + np.log(drawn - x) - np.log(x + 1) - np.log(bad - drawn + x + 1)
    log = np.concatenate(([0.0], np.cumsum(ratio)))
    mass = np.cumsum(np.exp(log - log.max()))
    return a + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def split(blocks: np.ndarray, drawn: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``drawn`` rows lie in each block when they are drawn without replacement."""
    out = np.zeros_like(blocks)
    left, need = int(blocks.sum()), drawn
    for j, size in enumerate(blocks):
        left -= int(size)
        out[j] = hypergeometric(int(size), left, need, rng)
        need -= int(out[j])
    return out


def matrix_row(sizes: np.ndarray, blocks: np.ndarray, i: int, seed: int = SEED) -> np.ndarray:
    """Row ``i`` of the communication matrix between partitions and blocks."""
    low, high, share = 0, len(sizes), blocks.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left = split(share, int(sizes[low:middle].sum()), np.random.default_rng([seed, low, high]))
        low, high, share = (low, middle, left) if i < middle else (middle, high, share - left)
    return share


def shard_sizes(total: int, shards: int) -> np.ndarray:
    base, more = divmod(total, shards)
    return base + (np.arange(shards) < more).astype(np.int64)


def shuffled(
    df: DataFrame, shards: int = SHARDS, seed: int = SEED, size: Column | None = None, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Every row of ``df`` as struct ``row`` with its ``shard`` and ``slot``; ``size`` tells a row's bytes."""
    numbered = df.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("mid"), (F.lit(0) if size is None else size).cast("long").alias("size"))
    place = F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))
    kept = staged(numbered.select("row", "size", F.shiftright("mid", 33).cast("int").alias("part"), place.alias("place")), "shards")
    # two numbers per partition of the input, not per row
    counts = sorted(tuple(r) for r in kept.groupBy("part").agg(F.count("*"), F.sum("size")).collect())
    index = {part: i for i, (part, _, _) in enumerate(counts)}
    sizes = np.array([rows for _, rows, _ in counts], dtype=np.int64)
    total, weight = int(sizes.sum()), sum(x[2] for x in counts)
    targets = shard_sizes(total, shards)
    blocks = max(1, -(-total // (shards * block_rows)), -(-weight // (shards * block_bytes)))

    @F.pandas_udf("int")
    def shard_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        dealt: dict[int, np.ndarray] = {}
        for part, place in batches:
            out = np.zeros(len(part), dtype=np.int32)
            for p in part.unique():
                if p not in dealt:
                    row = matrix_row(sizes, targets, index[p], seed)
                    order = np.random.default_rng([seed, 1, int(p)]).permutation(int(row.sum()))
                    dealt.clear()
                    dealt[p] = np.repeat(np.arange(shards, dtype=np.int32), row)[order]
                mine = (part == p).to_numpy()
                out[mine] = dealt[p][place.to_numpy()[mine]]
            yield pd.Series(out)

    again = F.xxhash64(F.lit(seed), "part", "place")
    # equal ranges of the hash, so that the blocks' order is the order of the hash
    block = F.floor((F.shiftright("again", 12).cast("double") / float(2**52) + 0.5) * blocks).cast("int")
    sent = kept.withColumn("shard", shard_of("part", "place")).withColumn("again", again).withColumn("block", block)
    held = sent.groupBy(F.col("shard").alias("of_shard"), F.col("block").alias("of_block")).agg(F.count("*").alias("rows"))
    earlier = F.expr("coalesce(sum(rows) OVER (PARTITION BY of_shard ORDER BY of_block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    firsts = staged(held.select("of_shard", "of_block", earlier.alias("first")), "shard-blocks")
    inner = sent.withColumn("n", F.expr("row_number() OVER (PARTITION BY shard, block ORDER BY again, part, place)"))
    placed = inner.join(firsts, (F.col("shard") == F.col("of_shard")) & (F.col("block") == F.col("of_block")))
    return placed.select("row", "shard", (F.col("first") + F.col("n") - 1).cast("long").alias("slot"))


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


@query("op9_sharding")
def op9_sharding(spark, sf_dir):
    placed = shuffled(table(spark, sf_dir, "documents"), size=text_size(F.col("text")))
    return placed.select(
        F.col("row.doc_id").alias("doc_id"),
        text_size(F.col("row.text")).alias("size"),
        F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

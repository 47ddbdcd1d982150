"""Mixing and sharding."""

import numpy as np
import pytest
from conftest import SMALL
from odd import no_docs, odd_docs  # noqa: F401
from oracle import compare

from eventloom.llm import mixing, shards


def test_mixing_equals_its_sql(spark, con):
    rows, problem = compare(mixing.op6_mixing(spark, SMALL), con, mixing.ORACLE)
    assert problem is None and rows > 0


@pytest.mark.parametrize("rate", [0.0, 0.01, 1.0, 7.5, 900.0])
def test_poisson_inverts_to_its_mean(rate):
    cdf = np.array(mixing.poisson_cdf(rate))
    u = (np.arange(20_000) + 0.5) / 20_000
    counts = (cdf[None, :] < u[:, None]).sum(axis=1) if rate < 100 else np.searchsorted(cdf, u)
    assert abs(counts.mean() - rate) < 0.01 * rate + 1e-3 and abs(counts.var() - rate) < 0.03 * rate + 1e-3


def test_targets_are_met_and_copies_agree(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id < 4000 THEN 'hot' WHEN id < 5900 THEN 'b' END AS source", "1 AS rate")
    found = mixing.replicated(docs, weights={"hot": 1.0, "b": 3.0}, size=2.0).selectExpr("row.doc_id", "row.source", "copy").toPandas()
    n = found.source.value_counts()
    assert abs(n["hot"] - 3000) < 250 and abs(n["b"] - 9000) < 400 and found.source.notna().all()
    copies = found.groupby("doc_id").copy
    assert (copies.max() + 1 == copies.count()).all() and (copies.nunique() == copies.count()).all()


def test_mixing_odd_documents(spark, odd_docs, no_docs):  # noqa: F811
    assert mixing.mixed(no_docs).count() == 0
    found = mixing.mixed(odd_docs, weights={"a": 1.0, "b": 1.0}, size=30.0)
    assert found.columns == odd_docs.columns
    assert {r.doc_id for r in found.select("doc_id").collect()} == {1, 3, 4, 5, 6, 7}
    twice = found.groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] % 2 for r in twice}[1] == 0  # both rows of id 1 alike
    assert mixing.mixed(odd_docs, weights={}).count() == 0


def test_order_is_shuffled(spark):
    order = [r.doc_id for r in mixing.mixed(spark.range(3000).selectExpr("id AS doc_id", "'x' AS source")).select("doc_id").collect()]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.1


def check_shards(found, rows, n):
    assert len(found) == rows
    sizes = found.groupby("shard").slot.count().reindex(range(n), fill_value=0)
    assert sizes.max() - sizes.min() <= 1
    for _, slots in found.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))


def test_shards_have_exact_sizes(spark):
    found = shards.op9_sharding(spark, "/root/testdata/sf0.01").toPandas()
    check_shards(found, 1000, 40)
    assert found.doc_id.is_unique and set(found.law) == {"rows"} and found.grown_shard.isna().all()


def test_digest_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    import zlib

    want = {r.doc_id: (len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in shards.op9_sharding(spark, SMALL).collect()} == want


@pytest.mark.parametrize("rows, block", [(0, 10), (7, 10), (1003, 10), (1003, 1000), (5000, 1)])
def test_blocks_of_shards(spark, rows, block):
    df = spark.range(rows).repartition(5).selectExpr("id", "'x' AS shard", "1 AS slot")
    found = shards.shuffled(df, shards=11, block_rows=block).selectExpr("row.id", "shard", "slot").toPandas()
    check_shards(found, rows, 11)
    assert found.id.is_unique


def test_odd_documents_are_all_placed(odd_docs, no_docs):  # noqa: F811
    found = shards.shuffled(odd_docs).selectExpr("row.doc_id", "shard", "slot").toPandas()
    check_shards(found, 10, 40)
    assert shards.shuffled(no_docs).count() == 0


def test_matrix_has_its_margins_and_law():
    sizes, blocks = np.array([4, 0, 9, 2]), np.array([5, 5, 5])
    cells = []
    for seed in range(3000):
        m = np.stack([shards.matrix_row(sizes, blocks, i, seed) for i in range(4)])
        assert (m.sum(axis=1) == sizes).all() and (m.sum(axis=0) == blocks).all()
        cells.append(m[2, 0])
    # hypergeometric(5 of 15, 9 drawn): mean 3, variance 9 * (1/3) * (2/3) * 6/14
    assert abs(np.mean(cells) - 3) < 0.06 and abs(np.var(cells) - 6 / 7) < 0.08


def test_large_populations_follow_the_law():
    rng = np.random.default_rng(1)
    draws = [shards.hypergeometric(6 * 10**8, 14 * 10**8, 10_000, rng) for _ in range(400)]
    assert abs(np.mean(draws) - 3000) < 10 and abs(np.var(draws) - 2100) < 500

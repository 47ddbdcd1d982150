import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import topk


def brute(rows, k):
    """Inner products of floors; each row is a query or candidate of its own."""
    vectors = []
    for vec_id, x in rows:
        if x is not None and all(v is not None and math.isfinite(v) for v in x):
            vectors.append((vec_id, [math.floor(256 * float(np.float32(v))) for v in x]))
    out = []
    for i, (a, q) in enumerate(vectors):
        if a is None or a % 2:
            continue
        scores = sorted((-sum(u * v for u, v in zip(q, p)), b is None, b or 0) for j, (b, p) in enumerate(vectors) if j != i)[:k]
        out += [(a, n, None if none else b, -s) for n, (s, none, b) in enumerate(scores, 1)]
    return sorted(out, key=str)


def run(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS block", "3 AS q", "4 AS row_no")
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 2 == 0, k).collect()), key=str)


def test_equals_brute_force_with_ties_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 16)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-4, 5, 6) / 8).astype("f4").tolist()) for i in range(150)]  # many equal scores
    rows += [(7, rows[7][1]), (8, [0.5] * 6), (None, [1.0] * 6), (900, None), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (904, [float("nan")] * 6)]
    rows += [(906, [float("inf")] * 6), (908, [0.25, 0.5]), (910, []), (912, [-900.0] * 6), (916, [1e6, -1e6, 70000.0, 0.0, 0.0, 0.0]), (914, [0.0] * 6)]
    assert run(spark, rows) == brute(rows, 5)


@pytest.mark.parametrize("rows", [[], [(2, [1.0, 2.0])], [(2, [1.0]), (3, [2.0]), (4, [-1.0])]])
def test_few_vectors(spark, rows):
    assert run(spark, rows) == brute(rows, 5)


def test_large_components_take_part_and_beyond_a_long_is_an_error(spark):
    rows = [(i, [1e5 * i, -1e6, 2.5, 3e6]) for i in range(2, 40)] + [(50, [1e6] * 4), (51, [-1e6] * 4), (52, [0.5] * 4)]
    assert run(spark, rows, 7) == brute(rows, 7)
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, [(2, [1.0, 1.0]), (3, [1e30, 1.0])])
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, [(2, [1e12, 1.0]), (4, [1e12, 1.0])])


def test_rows_of_one_id_are_rows_of_their_own(spark):
    rows = [(2, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (None, [2.0, 0.0])]
    found = run(spark, rows, 4)
    assert found == brute(rows, 4) and len(found) == 12


def test_pages_are_not_broadcast_however_many_blocks_they_meet(spark, monkeypatch):
    """The planner's estimate of a page does not count its copies, one per block: a join sent all of them to the driver."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 10)
    df = spark.range(400).selectExpr("id AS vec_id", "array(cast(id AS float), 1f) AS embedding")
    found = topk.top_k(df, F.col("vec_id") % 2 == 0)
    assert found.count() == 1000
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_tiles_are_bounded_and_as_many_as_tasks_where_there_is_so_much(spark, monkeypatch):
    assert topk.tiles(0, 0, 0, 0, 8) == (0, 0) and topk.tiles(1, 1, 10, 10, 8) == (1, 1)
    assert topk.tiles(1000, 2000, 1000 << 20, 256 << 20, 8) == (32, 32)
    b, p = topk.tiles(5, 40, 5 << 20, 1 << 20, 32)
    assert b == 5 and 32 <= b * p < 40
    monkeypatch.setattr(topk, "BLOCK_ROWS", 30)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 8)
    monkeypatch.setattr(topk, "TILE_INDEX", 50, raising=False)
    monkeypatch.setattr(topk, "TILE_QUERIES", 200, raising=False)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-4, 5, 4) * 300.0 ** (i % 3)).tolist()) for i in range(200)]
    assert run(spark, rows) == brute(rows, 5)


def test_bitmap_sums_equal_products():
    rng = np.random.default_rng(2)
    m, w = rng.integers(0, 300, (130, 9)), rng.integers(0, 100, 9)
    low, slices = topk.slice_block(m)
    sums = topk.weighted_sum(slices, w)
    values = [sum(int(sums[b, i // 64] >> np.uint64(i % 64) & np.uint64(1)) << b for b in range(len(sums))) for i in range(130)]
    assert values == ((m - low) @ w).tolist()

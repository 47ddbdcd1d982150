"""Exact top-k inner products over a bit-sliced index.

Every component becomes an integer. The index holds blocks of vectors; in a block, each bit of
each component is a bitmap over the block's rows (stored relative to the component's smallest
value). A query adds the slices of all components, weighted by the bits of its own component,
with bitmap arithmetic only: carry-save adders reduce three numbers to two for all rows at once.
The k best rows of a block are selected from the most significant slice of the sums downward;
rows that stay equal in all slices are the boundary, resolved by the smaller id. The best of all
blocks are merged by rank.

Blocks and pages of queries have a bounded size. A task searches a tile: blocks of at most about
``TILE_INDEX`` bytes for pages of at most about ``TILE_QUERIES`` bytes, and gives the k best of a
query in all of its blocks. So neither the queries nor the index are held whole anywhere, and none
of them passes the driver. The number of tiles grows with the product of queries and vectors, as
the exact search does.

Defined results: null vectors and vectors that hold null or non-finite components take no part;
a shorter vector counts as padded with zeros; rows that repeat an id, or have none, are rows of
their own: each is a query or candidate, and only its own row is left out; at equal scores null
ids come last; a component or score that does not fit a long is an error; with fewer than k
candidates all are returned; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table
from .registry import query

LEVELS = 256
LARGEST = 1 << 61
BLOCK_ROWS = 1 << 14
GROUP_QUERIES = 256
TILE_INDEX, TILE_QUERIES = 32 << 20, 8 << 20
K = 5
QUERY_EVERY = 50


def quantised(vectors: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``(row_no, vec_id, q)`` of every vector that takes part; ``row_no`` tells rows of one id apart."""
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))
    usable = vectors.filter(x.isNotNull()).filter(F.forall(x, finite))
    scaled = lambda v: F.floor(F.lit(float(levels)) * v.cast("double"))
    large = F.raise_error(F.lit("a component does not fit a long")).cast("long")
    fitting = lambda v: F.when(F.abs(F.lit(float(levels)) * v.cast("double")) < float(LARGEST), scaled(v)).otherwise(large)
    return usable.select(F.monotonically_increasing_id().alias("row_no"), "vec_id", F.transform(x, fitting).alias("q"))


def _matrix(rows: pd.Series) -> np.ndarray:
    wide = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), wide), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def slice_block(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest value per component and bitmaps ``[component, bit, 64-row word]`` of the rest."""
    low = m.min(axis=0) if m.size else np.zeros(m.shape[1], dtype=np.int64)
    x = m - low
    bits = max(1, int(x.max(initial=0)).bit_length())
    words = -(-len(m) // 64)
    out = np.zeros((m.shape[1], bits, words * 8), dtype=np.uint8)
    for b in range(bits):
        packed = np.packbits(((x >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return low, out.view("<u8")


INDEX = "block int, n int, dims int, bits int, row_nos binary, unnamed binary, ids binary, low binary, slices binary"


def index(vectors: DataFrame, blocks: int) -> DataFrame:
    """The bit-sliced index of ``(vec_id, q)``: one row per block, its rows ordered by id."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["unnamed", "vec_id", "row_no"])
        low, slices = slice_block(_matrix(pdf["q"]))
        row = (int(pdf["block"].iloc[0]), len(pdf), slices.shape[0], slices.shape[1])
        named = (pdf["row_no"].to_numpy("<i8").tobytes(), pdf["unnamed"].to_numpy(bool).tobytes(), pdf["vec_id"].to_numpy("<i8").tobytes())
        columns = ["block", "n", "dims", "bits", "row_nos", "unnamed", "ids", "low", "slices"]
        return pd.DataFrame([(*row, *named, low.astype("<i8").tobytes(), slices.tobytes())], columns=columns)

    block = F.pmod(F.xxhash64("row_no"), F.lit(blocks)).cast("int")
    named = vectors.withColumns({"block": block, "unnamed": F.col("vec_id").isNull(), "vec_id": F.coalesce("vec_id", F.lit(0))})
    return named.groupBy("block").applyInPandas(build, INDEX)


PAGES = "grp int, query_dims int, width int, query_rows binary, query_unnamed binary, query_ids binary, queries binary"


def query_pages(queries: DataFrame, groups: int) -> DataFrame:
    """Queries ``(row_no, vec_id, q)`` in pages: one row per page."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_no")
        m = _matrix(pdf["q"])
        width = next(w for w in (1, 2, 4, 8) if np.array_equal(m.astype(f"<i{w}"), m))
        named = (pdf["row_no"].to_numpy("<i8").tobytes(), pdf["unnamed"].to_numpy(bool).tobytes(), pdf["vec_id"].to_numpy("<i8").tobytes())
        columns = [c.split()[0] for c in PAGES.split(", ")]
        return pd.DataFrame([(int(pdf["grp"].iloc[0]), m.shape[1], width, *named, m.astype(f"<i{width}").tobytes())], columns=columns)

    grp = F.pmod(F.xxhash64("row_no", F.lit(1)), F.lit(groups)).cast("int")
    named = queries.withColumns({"grp": grp, "unnamed": F.col("vec_id").isNull(), "vec_id": F.coalesce("vec_id", F.lit(0))})
    return named.groupBy("grp").applyInPandas(build, PAGES)


def carry_save(x: np.ndarray) -> np.ndarray:
    """Numbers ``[m, slices, words]`` reduced to at most two with the same sum."""
    while len(x) > 2:
        k, s = len(x) // 3, x.shape[1]
        a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
        half = a ^ b
        out = np.zeros((2 * k + len(x) - 3 * k, s + 1, x.shape[2]), dtype=np.uint64)
        np.bitwise_xor(half, c, out=out[:k, :s])
        np.bitwise_or(a & b, half & c, out=out[k : 2 * k, 1:])
        out[2 * k :, :s] = x[3 * k :]
        x = out
    return x


def weighted_sum(slices: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Slices of the sum over components of weight times value; weights are not negative."""
    words = slices.shape[2]
    held = np.zeros((0, 1, words), dtype=np.uint64)
    for b in reversed(range(int(weights.max(initial=0)).bit_length())):
        part = slices[(weights >> b) & 1 == 1]
        depth = max(held.shape[1] + 1, part.shape[1])
        both = np.zeros((len(held) + len(part), depth, words), dtype=np.uint64)
        both[: len(held), 1 : held.shape[1] + 1] = held  # doubled
        both[len(held) :, : part.shape[1]] = part
        held = carry_save(both)
    if len(held) == 0:
        return np.zeros((1, words), dtype=np.uint64)
    if len(held) == 1:
        return held[0]
    a, b = held
    out, carry = np.empty((len(a) + 1, words), dtype=np.uint64), np.zeros(words, dtype=np.uint64)
    for i in range(len(a)):
        half = a[i] ^ b[i]
        out[i] = half ^ carry
        carry = (a[i] & b[i]) | (half & carry)
    out[len(a)] = carry
    return out


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best_rows(sums: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest sums among the set bits of ``rows``, equal ones from the front."""
    chosen, open_ = np.zeros_like(rows), rows.copy()
    if int(np.bitwise_count(rows).sum()) <= k:
        return _places(rows)
    for s in reversed(sums):
        tried = chosen | (open_ & s)
        n = int(np.bitwise_count(tried).sum())
        if n > k:
            open_ &= s
        else:
            chosen = tried
            open_ &= ~s
            if n == k:
                return _places(chosen)
    sure = _places(chosen)
    return np.concatenate([sure, _places(open_)[: k - len(sure)]])


def signed_digits(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers whose difference is ``q`` and whose bits are fewest (no two neighbouring digits)."""
    size = np.abs(q)
    half = size >> 1
    both = size + half
    changed = half ^ both
    plus, minus = both & changed, half & changed
    return np.where(q >= 0, plus, minus), np.where(q >= 0, minus, plus)


def search_block(row_nos: np.ndarray, low: np.ndarray, slices: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, k: int):
    """Per query the places and scores of its k best rows of one block, its own row left out."""
    dims, bits, words = slices.shape
    signed = np.concatenate([slices, ~slices])  # a value's complement stands for its negative
    most = (1 << bits) - 1
    rows = np.zeros(words * 64, dtype=bool)
    rows[: len(row_nos)] = True
    every = np.packbits(rows, bitorder="little").view("<u8")
    place = {int(r): i for i, r in enumerate(row_nos)}
    shared = min(dims, queries.shape[1])
    lows = [int(x) for x in low[:shared]]
    for row_no, q in zip(query_rows, queries[:, :shared], strict=True):
        weights = np.zeros(2 * dims, dtype=np.int64)
        weights[:shared], weights[dims : dims + shared] = signed_digits(q)
        # Python's integers: these may lie beyond a long where the score does not
        constant = sum(int(a) * b for a, b in zip(q, lows)) - most * sum(int(w) for w in weights[dims:])
        sums = weighted_sum(signed, weights)
        candidates = every.copy()
        own = place.get(int(row_no))
        if own is not None:
            candidates[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        at = best_rows(sums, candidates, k)
        bit = (sums[:, at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
        if len(sums) > 62:
            yield at, [sum(1 << i for i, b in enumerate(column) if b) + constant for column in bit.T.tolist()]
        else:
            places = np.arange(len(sums), dtype=np.int64)[:, None]
            yield at, [int(x) + constant for x in (bit.astype(np.int64) << places).sum(axis=0)]


def search_page(page, blocks: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of all ``blocks`` for every query of a page."""
    asked, query_ids = np.frombuffer(page.query_rows, "<i8"), np.frombuffer(page.query_ids, "<i8")
    queries = np.frombuffer(page.queries, f"<i{page.width}").astype(np.int64).reshape(-1, page.query_dims)
    by, ids, unnamed, scores = [], [], [], []
    for r in blocks.itertuples():
        slices = np.frombuffer(r.slices, "<u8").reshape(r.dims, r.bits, -1)
        named, nameless = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.unnamed, bool)
        found = search_block(np.frombuffer(r.row_nos, "<i8"), np.frombuffer(r.low, "<i8"), slices, asked, queries, k)
        for i, (at, score) in enumerate(found):
            if any(not -(1 << 63) <= x < 1 << 63 for x in score):
                raise OverflowError("a score does not fit a long")
            by.append(np.full(len(at), i))
            ids.append(named[at])
            unnamed.append(nameless[at])
            scores.append(np.array(score, dtype=np.int64))
    by, ids, unnamed, scores = (np.concatenate(x) for x in (by, ids, unnamed, scores))
    order = np.lexsort((ids, unnamed, ~scores, by))
    order = order[np.arange(len(order)) - np.searchsorted(by[order], by[order]) < k]
    query_id, vec_id = pd.array(query_ids[by[order]], dtype="Int64"), pd.array(ids[order], dtype="Int64")
    query_id[np.frombuffer(page.query_unnamed, bool)[by[order]]], vec_id[unnamed[order]] = pd.NA, pd.NA
    return pd.DataFrame({"query_row": asked[by[order]], "query_id": query_id, "vec_id": vec_id, "score": scores[order]})


def tiles(n_blocks: int, n_pages: int, index_bytes: int, query_bytes: int, tasks: int) -> tuple[int, int]:
    """Into how many groups blocks and pages fall: tiles of bounded size, and ``tasks`` of them where there is so much."""
    b, p = (min(n, max(1, -(-size // most))) for n, size, most in ((n_blocks, index_bytes, TILE_INDEX), (n_pages, query_bytes, TILE_QUERIES)))
    while b * p < tasks and (b < n_blocks or p < n_pages):
        if b < n_blocks and (p == n_pages or query_bytes <= index_bytes):  # a further group sends all of the other side once more
            b += 1
        else:
            p += 1
    return b, p


def search(blocks: DataFrame, pages: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best vectors of every query."""

    def run(met: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        found = [search_page(page, met, k) for page in sent.itertuples()] if len(met) else []
        return pd.concat(found) if found else pd.DataFrame(columns=["query_row", "query_id", "vec_id", "score"], dtype="int64")

    n_blocks, index_bytes = blocks.agg(F.count("*"), F.coalesce(F.sum(F.expr("cast(dims AS bigint) * bits * n DIV 8")), F.lit(0))).first()
    n_pages, query_bytes = pages.agg(F.count("*"), F.coalesce(F.sum(F.expr(f"cast(query_dims AS bigint) * width * {GROUP_QUERIES}")), F.lit(0))).first()
    b, p = tiles(n_blocks, n_pages, index_bytes, query_bytes, 4 * blocks.sparkSession.sparkContext.defaultParallelism)
    # grouped, not joined: the estimate of a page leaves out its copies, so a join would broadcast them all
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    placed = blocks.withColumns({"b": F.col("block") % max(1, b), "p": each(p)})
    sent = pages.withColumns({"b": each(b), "p": F.col("grp") % max(1, p)})
    met = placed.groupBy("b", "p").cogroup(sent.groupBy("b", "p"))
    found = met.applyInPandas(run, "query_row long, query_id long, vec_id long, score long")
    order = "PARTITION BY query_row ORDER BY score DESC, vec_id ASC NULLS LAST"
    ranked = found.withColumn("rank", F.expr(f"row_number() OVER ({order})")).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, levels: int = LEVELS) -> DataFrame:
    """The k best vectors for every row of ``vectors`` (``vec_id, embedding``) that is a query."""
    stored = staged(quantised(vectors, levels), "topk-vectors")
    n, m = stored.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    n_pages, n_blocks = max(1, -(-m // GROUP_QUERIES)), max(1, -(-n // BLOCK_ROWS))
    blocks = staged(index(stored, n_blocks), "topk-index")
    pages = staged(query_pages(stored.filter(is_query), n_pages), "topk-queries")
    return search(blocks, pages, k)


ORACLE = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({LEVELS} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""


@query("op1_top_k", ORACLE)
def op1_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)

"""Ranked lexical search: documents grouped by the mask of the item's terms they hold.

1. Every document is cut into terms once, whole. What the items' terms need of it (its length,
   and how often it holds each of these terms) is stored in blocks of ``BLOCK_DOCS`` documents.
2. Counts over all documents (documents with a term, terms, documents per term) follow from the
   blocks by sums.
3. In a block every term of an item is a bitmap over the documents; transposed, the bitmaps are
   the documents' masks. Documents of equal masks are one group. A mask can score at most the sum
   of its terms' largest contributions in the block. Masks are evaluated in descending order of
   that maximum, all their documents exactly, until the next maximum is below the k-th score.
   A task keeps the k best of each item over all its blocks, so later blocks stop sooner.
4. The k best of all tasks are merged by rank.

Items are the query set. They are searched in groups of at most ``GROUP_BYTES`` of text (one
item may be longer), so what is broadcast has a size that is checked.

Defined results: null texts have no term and are neither counted nor found; items without a term
get no rows; each row of the items is an item of its own, also if its id is null or repeated; each
row of the documents is a document of its own; at equal scores null ids come last; a term that
every document holds may weigh nothing, and a score of zero is no match; empty tables give no
rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table
from .registry import query

K = 20
BLOCK_DOCS = 1024
GROUP_BYTES = 16 << 20
MASK_CELLS = 1 << 24
MASKS_AT_ONCE = 64
ROW_GROUP = 16 << 20
WEIGHT_UNIT, SCORE_UNIT, LENGTH_UNIT, LENGTH_SHARE, LENGTH_FACTOR = 1000, 1_000_000_000, 100, 25, 12

# a term consists of ASCII letters and digits and of everything beyond ASCII; A-Z count as a-z
_FOLD = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """All terms of a whole text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


BLOCKS = "n_docs long, n_terms long, ids binary, unnamed binary, lengths binary, starts binary, terms binary, counts binary"


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Blocks of documents with their lengths and their counts of the terms in ``vocabulary``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def block(ids: list, texts: list) -> tuple:
        known, lengths, starts, held, counts = shared.value, [], [0], [], []
        for text in texts:
            words = terms(text)
            lengths.append(len(words))
            found = np.fromiter(map(known.get, words, repeat(-1)), dtype=np.int32, count=len(words))
            names, n = np.unique(found[found >= 0], return_counts=True)
            held.append(names)
            counts.append(n)
            starts.append(starts[-1] + len(names))
        numbers = np.array([0 if pd.isna(i) else int(i) for i in ids], dtype="<i8")
        size = np.array(lengths, dtype="<i8")
        return (
            int((size > 0).sum()),
            int(size.sum()),
            numbers.tobytes(),
            np.array([bool(pd.isna(i)) for i in ids]).tobytes(),
            size.tobytes(),
            np.array(starts, dtype="<i8").tobytes(),
            np.concatenate(held).astype("<i4").tobytes(),
            np.concatenate(counts).astype("<i8").tobytes(),
        )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in BLOCKS.split(", ")]
        for batch in batches:
            ids, texts = batch["doc_id"].astype(object).tolist(), batch["text"].tolist()
            for start in range(0, len(ids), BLOCK_DOCS):
                row = block(ids[start : start + BLOCK_DOCS], texts[start : start + BLOCK_DOCS])
                yield pd.DataFrame([row], columns=columns)

    # a text key keeps 64-bit ids exact: pandas would make floats of a column with nulls
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(cut, BLOCKS)


def document_counts(blocks: DataFrame, n_terms: int) -> DataFrame:
    """``(term, docs)``: in how many documents each term of the vocabulary occurs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            for held in batch["terms"]:
                total += np.bincount(np.frombuffer(held, "<i4"), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at.astype(np.int32), "docs": total[at]})

    return blocks.select("terms").mapInPandas(count, "term int, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def weigh(n_docs: int, docs: np.ndarray) -> np.ndarray:
    """Weights of terms that occur in ``docs`` of ``n_docs`` documents."""
    return np.array([math.floor(WEIGHT_UNIT * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in docs], dtype=np.int64)


def length_marks(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The documents' marks of relative length, in exact integers of any size."""
    base, share = LENGTH_UNIT - LENGTH_SHARE, LENGTH_SHARE * n_docs
    if len(lengths) and int(lengths.max()) * share >= 1 << 62:
        return np.array([base + (share * int(n)) // n_terms for n in lengths], dtype=np.int64)
    return base + (share * lengths) // max(n_terms, 1)


@dataclass
class Block:
    """The postings of a block in order of their terms."""

    docs: np.ndarray  # of each posting
    impact: np.ndarray  # of each posting: weight times the term's part of the score
    first: np.ndarray  # per term of the vocabulary, where its postings start
    most: np.ndarray  # per term, the largest impact

    @staticmethod
    def of(lengths, starts, held, counts, weights: np.ndarray, n_docs: int, n_terms: int) -> Block:
        docs = np.repeat(np.arange(len(lengths)), np.diff(starts))
        mark = length_marks(lengths, n_docs, n_terms)[docs]
        impact = weights[held] * ((SCORE_UNIT * counts) // (1000 * counts + LENGTH_FACTOR * mark))
        order = np.argsort(held, kind="stable")
        held, docs, impact = held[order], docs[order], impact[order]
        first = np.searchsorted(held, np.arange(len(weights) + 1))
        most = np.zeros(len(weights), dtype=np.int64)
        some = np.flatnonzero(np.diff(first))
        if len(some):
            most[some] = np.maximum.reduceat(impact, first[some])
        return Block(docs, impact, first, most)


def by_mask(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct masks (as columns of ``present``'s kind) and which of them each document has.

    ``present`` says by term and document whether the term occurs.
    """
    masks = np.ascontiguousarray(np.packbits(present, axis=0).T)
    wide = masks.shape[1]
    if wide <= 8:
        keys = np.zeros((len(masks), 8), dtype=np.uint8)
        keys[:, :wide] = masks
        keys = keys.view("<u8").ravel()
    else:
        keys = masks.view(np.dtype((np.void, wide))).ravel()
    _, at, group = np.unique(keys, return_index=True, return_inverse=True)
    return present[:, at], group


class Best:
    """The k best documents of one item so far."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.unnamed, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def least(self) -> int:
        """A score below this cannot enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, unnamed: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.least()
        if keep.any():
            score = np.concatenate([self.score, score[keep]])
            unnamed, ids = np.concatenate([self.unnamed, unnamed[keep]]), np.concatenate([self.ids, ids[keep]])
            order = np.lexsort((ids, unnamed, -score))[: self.k]
            self.score, self.unnamed, self.ids = score[order], unnamed[order], ids[order]


def search_block(block: Block, wanted: np.ndarray, times: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, best: Best) -> int:
    """Offers the block's documents to ``best`` by descending maximum of their masks.

    ``wanted`` are the item's different terms, ``times`` how often it holds them. Returns the number
    of documents that were scored.
    """
    there = block.most[wanted] > 0
    wanted, times = wanted[there], times[there]
    most = times * block.most[wanted]
    if int(most.sum()) < best.least() or not len(wanted):
        return 0
    scored, step = 0, max(64, MASK_CELLS // len(wanted))
    spans = [slice(block.first[t], block.first[t + 1]) for t in wanted]
    rows = np.repeat(np.arange(len(wanted)), [s.stop - s.start for s in spans])
    at = np.concatenate([np.arange(s.start, s.stop) for s in spans])
    docs = block.docs[at]
    for start in range(0, len(ids), step):
        here = (docs >= start) & (docs < start + step) if len(ids) > step else slice(None)
        posting = np.full((len(wanted), min(step, len(ids) - start)), -1, dtype=np.int64)
        posting[rows[here], docs[here] - start] = at[here]
        masks, group = by_mask(posting >= 0)
        limit = most @ masks
        order = np.argsort(-limit, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        members = np.argsort(place[group], kind="stable")  # documents by their mask's place
        edge = np.searchsorted(place[group][members], np.arange(len(order) + 1))
        for first in range(0, len(order), MASKS_AT_ONCE):
            last = min(first + MASKS_AT_ONCE, len(order))
            last = first + int((limit[order[first:last]] >= best.least()).sum())
            if last == first:
                break
            d = members[edge[first] : edge[last]]
            cell = posting[:, d]
            score = times @ np.where(cell >= 0, block.impact[cell], 0)
            best.add(score, unnamed[d + start], ids[d + start])
            scored += len(d)
    return scored


def _item_terms(texts: list[str | None], vocabulary: dict[bytes, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for text in texts:
        found = np.array([vocabulary[t] for t in terms(text)], dtype=np.int64)
        out.append(np.unique(found, return_counts=True))
    return out


def _search(docs: DataFrame, items: list, k: int) -> DataFrame:
    """``item, score, doc_id``: the k best documents of each task for each item, a row of ``items``."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    for text in items:
        for t in terms(text):
            vocabulary.setdefault(t, len(vocabulary))
    blocks = staged(postings(docs, vocabulary), "lexical-blocks", **{"parquet.block.size": str(ROW_GROUP)})
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    counts = np.zeros(len(vocabulary), dtype=np.int64)
    for r in document_counts(blocks, len(vocabulary)).collect():  # one number per term of the items
        counts[r["term"]] = r["docs"]
    weights = weigh(n_docs, counts)
    shared = spark.sparkContext.broadcast((_item_terms(items, vocabulary), weights, n_docs, n_terms))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, weights, n_docs, n_terms = shared.value
        best = [Best(k) for _ in wanted]
        for batch in batches:
            for r in batch.itertuples():
                lengths, starts = np.frombuffer(r.lengths, "<i8"), np.frombuffer(r.starts, "<i8")
                held, times = np.frombuffer(r.terms, "<i4"), np.frombuffer(r.counts, "<i8")
                block = Block.of(lengths, starts, held, times, weights, n_docs, n_terms)
                ids, unnamed = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.unnamed, bool)
                for (which, n), found in zip(wanted, best, strict=True):
                    search_block(block, which, n, ids, unnamed, found)
        for i, found in enumerate(best):
            if len(found.score):
                named = pd.array(found.ids, dtype="Int64")
                named[found.unnamed] = pd.NA
                yield pd.DataFrame({"item": i, "score": found.score, "doc_id": named})

    found = blocks.mapInPandas(run, "item int, score long, doc_id long")
    order = "PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST"
    return found.withColumn("rank", F.expr(f"row_number() OVER ({order})")).filter(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = K, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the k best documents of every item (``item_id, text``)."""
    spark = docs.sparkSession
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-total // group_bytes))
    mine = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))
    parts = []
    for group in range(groups):
        rows = items.filter(mine == group).select("item_id", "text").collect()  # about group_bytes
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
        found = _search(docs, [r["text"] for r in rows], k)
        parts.append(found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return reduce(DataFrame.unionAll, parts)


ORACLE = rf"""
WITH cut AS (SELECT doc_id, row_number() OVER () AS d,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
long AS (SELECT d, doc_id, len(terms) AS n FROM cut WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM long),
tf AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(terms) AS term FROM cut) GROUP BY d, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, nd),
wanted AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
scored AS (SELECT item_id, d, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt))))::BIGINT AS score
    FROM wanted JOIN weight USING (term) JOIN tf USING (term) JOIN long USING (d), total GROUP BY item_id, d, doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= {K}
"""


@query("op13_lexical_search", ORACLE)
def op13_lexical_search(spark, sf_dir):
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

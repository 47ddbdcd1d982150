"""Toxicity: a factorization machine over hashed terms.

A text is the set of buckets its lower-cased words hash to. The machine scores it with a weight
per bucket and, for every pair of buckets, the inner product of their factors, so that a pair
counts for more (or less) than its two terms alone: an insult beside the mention of a group, say.

The machine is fitted in the driver on a bounded sample: at most ``SAMPLE_ROWS`` labelled rows of
each class, chosen by a hash of the id, every row weighted by how many labelled rows it stands
for. Rows of the same buckets count once, with their mean label. Of the buckets that the sample
holds, the ``FEATURES`` that tell the classes apart best get weights and factors; the others
have none. The model (``FEATURES`` x ``RANK`` floats) is broadcast; every text is scored whole.

Defined results: null and empty texts and texts without a known term get the score of no term
(the share of toxic rows among those alike); with no usable label every score is the neutral 0;
documents labelled twice are toxic if a label says so; labels of null id or null value teach
nothing; repeated rows score alike; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_unit, held_out, table
from .registry import query

BUCKET_BITS = 20
SAMPLE_ROWS = 4000  # of each class
FEATURES = 1024
LEAST_ROWS = 5
LEAST_Z = 3.0
RANK = 8
EPOCHS = 30
BATCH = 256
RATE = 0.02
DECAY_W, DECAY_V = 1e-4, 1e-3
FOLDS, HELD_FOLD = 4, 2
TOXIC_FROM = 0.3
SEED = 11
CACHED_WORDS = 200_000

_WORD = re.compile(r"[^\W_]+")


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << BUCKET_BITS) - 1)


def buckets(text: str | None) -> np.ndarray:
    """The different buckets of a whole text, ascending."""
    return np.unique(np.fromiter((bucket(w) for w in set(_WORD.findall((text or "").lower()))), dtype=np.int32))


@dataclass
class Model:
    terms: np.ndarray  # buckets that have weights, ascending
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # terms x rank

    def margins(self, known: list[np.ndarray]) -> np.ndarray:
        """The machine's sum for rows given as places in ``terms``."""
        out = np.full(len(known), self.bias)
        sizes = np.array([len(k) for k in known])
        some = np.flatnonzero(sizes)
        if len(some):
            flat = np.concatenate([known[i] for i in some])
            starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
            v = self.factors[flat]
            total, squares = np.add.reduceat(v, starts), np.add.reduceat(v * v, starts)
            out[some] += np.add.reduceat(self.weights[flat], starts) + 0.5 * (total * total - squares).sum(axis=1)
        return out

    def score(self, texts: pd.Series, places: dict[str, int]) -> np.ndarray:
        """Chances of toxicity; ``places`` caches words, -1 for words without a weight."""
        known = []
        for text in texts:
            found = set()
            for word in set(_WORD.findall((text or "").lower())):
                at = places.get(word)
                if at is None:
                    b = bucket(word)
                    at = int(np.searchsorted(self.terms, b))
                    if at == len(self.terms) or self.terms[at] != b:
                        at = -1
                    if len(places) < CACHED_WORDS:
                        places[word] = at
                if at >= 0:
                    found.add(at)
            known.append(np.fromiter(sorted(found), dtype=np.int64))
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(known), -40, 40)))


def telling(rows: list[np.ndarray], label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The buckets whose share of toxic rows differs most from that of all rows, in standard errors."""
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    names, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
    share = float((label * weight).sum() / weight.sum())
    seen = np.bincount(inverse, weights=weight[at])
    toxic = np.bincount(inverse, weights=(label * weight)[at])
    squares = np.bincount(inverse, weights=(weight * weight)[at])
    z = np.abs(toxic - share * seen) / np.sqrt(max(share * (1 - share), 1e-9) * np.maximum(squares, 1e-12))
    z[(n < LEAST_ROWS) | (z < LEAST_Z)] = 0
    best = np.lexsort((names, -z))[:FEATURES]
    return np.sort(names[best[z[best] > 0]])


def fit(rows: list[np.ndarray], label: np.ndarray, weight: np.ndarray, rank: int = RANK) -> Model:
    """Logistic loss, minimised by Adam over shuffled batches; ``rank`` 0 leaves the pairs out."""
    terms = telling(rows, label, weight)
    x = np.zeros((len(rows), len(terms)), dtype=np.float32)
    for i, r in enumerate(rows):
        at = np.searchsorted(terms, r)
        x[i, at[(at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == r)] if len(terms) else []] = 1.0
    weight = (weight / weight.mean()).astype(np.float32)
    share = float(np.clip((label * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4))
    rng = np.random.default_rng(SEED)
    params = [
        np.array([np.log(share / (1 - share))], dtype=np.float32),
        np.zeros(len(terms), dtype=np.float32),
        (0.05 * rng.standard_normal((len(terms), rank))).astype(np.float32),
    ]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            b = order[start : start + BATCH]
            xb, (w0, w, v) = x[b], params
            held = xb @ v
            margin = w0 + xb @ w + 0.5 * (held * held - xb @ (v * v)).sum(axis=1)  # entries are 0 or 1
            error = weight[b] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[b]).astype(np.float32) / len(b)
            by_term = xb.T @ error
            grads = [error.sum(keepdims=True), by_term + DECAY_W * w, xb.T @ (error[:, None] * held) - by_term[:, None] * v + DECAY_V * v]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(terms, float(params[0][0]), params[1].astype(np.float64), params[2].astype(np.float64))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"toxic": batch["toxic"], "at": [buckets(t).astype("<i4").tobytes() for t in batch["text"]]})


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The machine of a bounded sample of the labelled rows for which ``usable`` (over ``doc_id``) holds."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.filter(usable) if usable is not None else known
    each = known.groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in each.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    draw = hash_unit(F.col("doc_id"), seed=SEED)
    parts = [each.filter(F.col("toxic") == y).orderBy(draw, "doc_id").limit(sample_rows) for y in sorted(sizes)]
    chosen = parts[0].union(parts[-1]) if len(parts) > 1 else parts[0]
    chosen = chosen.withColumnRenamed("doc_id", "labelled_id")  # bounded: broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))
    found = sample.select("toxic", "text").mapInPandas(_hashed, "toxic int, at binary")
    # equal sets of buckets count once, so copies of a document do not outvote others
    once = found.groupBy("at").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).limit(2 * sample_rows).toPandas()
    if once.empty:
        return None
    once = once.sort_values("at", kind="stable")
    rows = [np.frombuffer(at, "<i4") for at in once["at"]]
    label = (once["toxic"] / once["n"]).to_numpy(dtype=np.float64)
    stands_for = {y: n / min(n, sample_rows) for y, n in sizes.items()}
    weight = np.where(label >= 0.5, stands_for.get(1, 1.0), stands_for.get(0, 1.0))
    return fit(rows, label, weight)


def scored(docs: DataFrame, model: Model | None, *keep: str, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """``keep`` columns of every row with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model) if model else None)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, places = Model(**shared.value) if shared.value else None, {}
        for batch in batches:
            yield pd.Series(model.score(batch, places) if model else np.zeros(len(batch)))

    rows = docs.select(*keep, score("text").alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= toxic_from, 1).otherwise(0))


@query("op11_toxicity_fm")
def op11_toxicity_fm(spark, sf_dir):
    docs, held = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), FOLDS, HELD_FOLD)
    found = scored(docs, train(docs, table(spark, sf_dir, "labels"), ~held), "doc_id")
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")

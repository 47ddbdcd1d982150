"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of hashed terms (words and short runs of character classes), these are
weighted by inverse document frequency and projected on the leading singular vectors of a
bounded sample of labelled rows (at most ``SAMPLE_ROWS``, chosen by a hash of the id). The
sample's vectors are broadcast (``SAMPLE_ROWS`` x ``RANK`` floats); every document takes exact
cosine products with all of them, block by block, and its nearest neighbours vote with their
similarity as weight.

Defined results: null and empty texts are the zero vector and get the sample's share of good
labels, as does every text when nothing is labelled (0.5 then); documents labelled twice count
by the mean label; repeated rows score alike; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_unit, held_out, table
from .registry import query

DIMS = 1 << 12
RANK = 64
SAMPLE_ROWS = 6000
NEIGHBOURS = 25
SHARPNESS = 8
FOLDS, HELD_FOLD = 4, 2
GOOD_FROM = 0.7
SEED = 2

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CLASS = np.zeros(129, dtype=np.uint8)
_CLASS[128] = 1  # all beyond ASCII count as lower-case letters
for _i, _chars in enumerate(
    ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:", "!?", "-'\"()", "#*$%&|<>", "/@_="], 1
):
    _CLASS[[ord(c) for c in _chars]] = _i


def _bucket(grams: np.ndarray) -> np.ndarray:
    mixed = (grams.astype(np.uint32) * np.uint32(2654435761)) ^ np.uint32(0x9E3779B9)
    return ((mixed * np.uint32(2246822519)) >> np.uint32(20)).astype(np.int64)


def term_counts(text: str | None) -> np.ndarray:
    """Counts of hashed terms of a whole text: class runs, words and how often words repeat."""
    counts = np.zeros(DIMS, dtype=np.float32)
    if not text:
        return counts
    c = _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), 128)].astype(np.uint32)
    grams = c + np.uint32(1)
    for n in range(2, 5):
        if len(c) >= n:
            grams = grams[:-1] * np.uint32(16) + c[n - 1 :] + np.uint32(1)
            counts += np.bincount(_bucket(grams), minlength=DIMS)
    counts /= max(1.0, float(len(c)) / 100.0)  # runs per 100 characters
    seen = Counter(_WORD.findall(text))
    total = sum(seen.values())
    if total:
        for word, n in seen.items():
            counts[zlib.crc32(word.encode("utf-8", "surrogatepass")) & (DIMS - 1)] += n * 10.0 / total
        for name, share in (
            ("distinct", len(seen) / total),
            ("commonest", max(seen.values()) / total),
            ("length", min(1.0, np.log1p(total) / 10)),
        ):
            counts[zlib.crc32(f"{name} {round(10 * share)}".encode()) & (DIMS - 1)] += 3.0
    return counts


def features(texts: pd.Series) -> np.ndarray:
    return np.log1p(np.stack([term_counts(t) for t in texts])) if len(texts) else np.zeros((0, DIMS), np.float32)


@dataclass
class Model:
    weight: np.ndarray  # inverse document frequencies
    basis: np.ndarray  # features x rank
    vectors: np.ndarray  # sample x rank, unit length
    labels: np.ndarray
    prior: float

    def project(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.weight) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, texts: pd.Series, block: int = 256) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        for start in range(0, len(texts), block):
            part = texts.iloc[start : start + block]
            v = self.project(features(part))
            similar = v @ self.vectors.T
            k = min(NEIGHBOURS, len(self.labels))
            nearest = np.argpartition(-similar, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(similar, nearest, axis=1), 0, 1).astype(np.float64) ** SHARPNESS
            total = weight.sum(axis=1)
            voted = (weight * self.labels[nearest]).sum(axis=1) / np.maximum(total, 1e-300)
            out[start : start + block] = np.where(total > 1e-12, voted, self.prior)
        return np.clip(out, 0.0, 1.0)


def fit(x: np.ndarray, labels: np.ndarray) -> Model:
    frequency = (x > 0).sum(axis=0)
    weight = np.log((1 + len(x)) / (1 + frequency)).astype(np.float32) + np.float32(0.2)
    weighted = x * weight
    rank = min(RANK, *weighted.shape)
    rng = np.random.default_rng(SEED)
    q = np.linalg.qr(weighted @ rng.standard_normal((DIMS, rank + 16)).astype(np.float32))[0]
    for _ in range(4):  # subspace iteration
        q = np.linalg.qr(weighted @ (weighted.T @ q))[0]
    _, values, right = np.linalg.svd(q.T @ weighted, full_matrices=False)
    model = Model(weight, np.ascontiguousarray(right[:rank].T), np.zeros((0, rank)), labels, float(labels.mean()))
    model.vectors = model.project(x)
    return model


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        x = features(batch["text"])
        at = [np.flatnonzero(r) for r in x]
        yield pd.DataFrame(
            {
                "label": batch["label"],
                "at": [r.astype("<u2").tobytes() for r in at],
                "value": [x[i, r].astype("<f4").tobytes() for i, r in enumerate(at)],
            }
        )


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of a bounded sample of the labelled rows outside the held-out fold."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_FOLD))
    chosen = (
        usable.groupBy("doc_id")
        .agg(F.avg("quality").alias("label"))
        .orderBy(hash_unit(F.col("doc_id"), seed=SEED), "doc_id")
        .limit(sample_rows)
        .withColumnRenamed("doc_id", "labelled_id")
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))
    once = sample.groupBy("labelled_id").agg(F.first("text", ignorenulls=True).alias("text"), F.first("label").alias("label"))
    rows = once.mapInPandas(_packed, "label double, at binary, value binary").toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values(["at", "value", "label"], kind="stable")
    x = np.zeros((len(rows), DIMS), dtype=np.float32)
    for i, (at, value) in enumerate(zip(rows["at"], rows["value"], strict=True)):
        x[i, np.frombuffer(at, "<u2")] = np.frombuffer(value, "<f4")
    return fit(x, rows["label"].to_numpy(dtype=np.float64))


def scored(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """``keep`` columns of every row with ``score`` and ``predicted``."""
    # bounded: sample x rank and features x rank
    shared = docs.sparkSession.sparkContext.broadcast(vars(model) if model else None)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Model(**shared.value) if shared.value else None
        for batch in batches:
            yield pd.Series(model.score(batch) if model else np.full(len(batch), 0.5))

    rows = docs.select(*keep, score("text").alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= GOOD_FROM, 1).otherwise(0))


@query("op2_quality_knn")
def op2_quality_knn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")), "doc_id")
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_FOLD).alias("held_out"), "score", "predicted")

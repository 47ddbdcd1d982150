"""Language identification with error-correcting output codes.

Each language has a codeword of +1/-1 bits; one binary n-gram classifier per bit predicts it
from the whole text. Decoding adds up the loss of every bit's margin against every codeword,
weighted by how reliable the bit was on left-out sample rows, and takes the nearest codeword.

The classifiers are fitted on a bounded sample: ``SAMPLE_ROWS`` labelled rows, shared evenly by
the languages (but ``LEAST_ROWS`` or all rows of each) and chosen by a hash of the id and text.
Only their features leave the executors. Everything else covers all rows.

Defined results: null texts and texts without a letter are ``und`` with score 0; with no
labelled row every text is ``und``; with one language every text with a letter gets it; rows
of null ``lang`` or null ``doc_id`` teach nothing; repeated rows are predicted alike; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_unit, held_out, staged, table
from .registry import query

DIMS = 1 << 13
SAMPLE_ROWS = 4000
LEAST_ROWS = 20
SLICE = 1 << 16
FOLDS, HELD_FOLD = 5, 0
RIDGE = 1e-3
SHARPNESS = 12.0
AMBIGUOUS_BELOW = 0.6
CLEAN_BELOW, CLEAN_LOST = 0.9, 0.001
UNKNOWN = "und"
SEED = 5

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter, by code point."""
    if not _LETTER:
        flags = np.zeros(0x110000, dtype=bool)
        flags[: 0x20000] = [chr(c).isalpha() for c in range(0x20000)]
        flags[0x20000:0x323B0] = True  # ideograph planes
        _LETTER.append(flags)
    return _LETTER[0]


def _hashes(c: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed 1-, 2- and 3-grams that start at each code but the last two; 1-grams leave out the first."""
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ np.uint32(0x9E3779B9)) * np.uint32(40503) + c[1:] * np.uint32(2246822519)
    yield one[1:-1]
    yield two[:-1]
    yield (two[:-1] ^ np.uint32(0x85EBCA6B)) * np.uint32(3266489917) + c[2:] * np.uint32(668265263)


def ngram_counts(text: str | None, size: int = SLICE) -> np.ndarray | None:
    """Counts of hashed letter 1-, 2- and 3-grams; runs of other characters are one space.

    The text is taken in slices of ``size`` characters, each with the two codes before it, so that
    memory does not grow with the text.
    """
    counts, held, found = np.zeros(DIMS, dtype=np.int64), np.array([32], dtype=np.uint32), False
    for start in range(0, len(text or ""), size):
        # a capital may become several small letters: slices are cut before
        part = text[start : start + size].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _letters()[codes]
        found = found or bool(letter.any())
        spaced = np.where(letter, codes, np.uint32(32))
        # a run of others is a space already if the slice before ended in one of more than its start
        before = start == 0 or held[-1] != 32
        keep = letter | np.concatenate(([before], letter[:-1]))
        held = _count(np.concatenate((held, spaced[keep])).astype(np.uint32), counts)
    if not found:
        return None
    c = np.concatenate((held, [np.uint32(32)])).astype(np.uint32)
    _count(c, counts)
    _add(((c[-2:-1] * np.uint32(2654435761)) ^ np.uint32(0x9E3779B9)) * np.uint32(40503) + c[-1:] * np.uint32(2246822519), counts)
    return counts


def _count(c: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Adds the grams that are whole in ``c``; the codes that the next slice needs."""
    if len(c) < 3:
        return c
    for grams in _hashes(c):
        _add(grams, counts)
    return c[-2:]


def _add(grams: np.ndarray, counts: np.ndarray) -> None:
    mixed = (grams ^ (grams >> np.uint32(15))) * np.uint32(2246822519)
    counts += np.bincount((mixed >> np.uint32(19)).astype(np.int64), minlength=DIMS)


def features(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of root n-gram frequencies, and which texts have a letter."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    known = np.zeros(len(texts), dtype=bool)
    for i, text in enumerate(texts):
        counts = ngram_counts(text)
        if counts is not None:
            out[i] = np.sqrt(counts / counts.sum())
            known[i] = True
    return out, known


def codebook(n: int) -> np.ndarray:
    """Codewords of ``n`` classes as rows of +1/-1.

    Up to 6 classes: every split into two parts. More: as many hash-drawn balanced columns as
    separate all words by a margin that grows with their logarithm.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        splits = np.arange(1, 2 ** (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    rng = np.random.default_rng(SEED)
    width = 16 * int(np.ceil(np.log2(n)))
    half = np.where(np.arange(n) % 2, 1.0, -1.0)
    return np.stack([rng.permutation(half) for _ in range(width)], axis=1)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # per bit
    least_score: float = AMBIGUOUS_BELOW  # of a clean text

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword and probabilities of all of them."""
        loss = np.stack([(np.exp(-np.clip(margins * word, -4, 4)) * self.trust).sum(axis=1) for word in self.code], axis=1)
        scaled = -SHARPNESS * (loss - loss.min(axis=1, keepdims=True)) / self.trust.sum()
        chance = np.exp(scaled)
        return loss.argmin(axis=1), chance / chance.sum(axis=1, keepdims=True)

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        x, known = features(texts)
        best, chance = self.decode(x @ self.weights + self.bias)
        top = np.sort(chance, axis=1)
        score = np.where(known, top[:, -1], 0.0)
        return pd.DataFrame(
            {
                "lang_pred": np.where(known, np.array(self.languages, dtype=object)[best], UNKNOWN),
                "score": score.astype(np.float64),
                "ambiguous": ~known | (score < AMBIGUOUS_BELOW),
            }
        )


FIT_ROWS = 512  # of the sample that are spelt out at a time


def invert_in_place(a: np.ndarray, size: int = FIT_ROWS) -> None:
    """Replaces a symmetric positive definite matrix by its inverse, one block of columns after the other."""
    n = len(a)
    for start in range(0, n, size):
        k = slice(start, min(start + size, n))
        rest = np.r_[0:start, k.stop : n]
        pivot = np.linalg.inv(a[k, k].astype(np.float64)).astype(a.dtype)
        column = a[:, k].copy()
        row = pivot @ a[k, :]
        for low in range(0, len(rest), size):
            at = rest[low : low + size]
            a[at] -= column[at] @ row
        a[k, :] = row
        a[rest, k] = -column[rest] @ pivot
        a[k, k] = pivot


def fit(rows: list[tuple[np.ndarray, np.ndarray]], lang: np.ndarray) -> Model:
    """Least-squares classifiers of all bits; ``trust`` is a bit's left-out accuracy above chance.

    ``rows`` are the places and values of the sample's features. ``least_score`` loses
    ``CLEAN_LOST`` of the left-out rows that are predicted right, at most.
    """
    n, languages = len(rows), sorted(set(lang))
    code, known = codebook(len(languages)), np.searchsorted(languages, lang)
    y = code[known]
    share = 1.0 / np.bincount(known)[known]
    share /= share.sum()
    mean = np.zeros(DIMS)
    for (at, value), part in zip(rows, share, strict=True):
        mean[at] += value * part
    mean = mean.astype(np.float32)

    def spelt(start: int) -> np.ndarray:
        x = np.repeat(-mean[None], min(FIT_ROWS, n - start), axis=0)
        for i in range(len(x)):
            at, value = rows[start + i]
            x[i, at] += value
        return x

    kernel = np.zeros((n, n), dtype=np.float32)
    for i in range(0, n, FIT_ROWS):
        left = spelt(i)
        for j in range(0, i + 1, FIT_ROWS):
            block = left @ spelt(j).T
            kernel[i : i + len(left), j : j + block.shape[1]] = block
            kernel[j : j + block.shape[1], i : i + len(left)] = block.T
    kernel[np.diag_indices(n)] += np.float32(RIDGE * n**0.5)
    invert_in_place(kernel)
    bias = (y * share[:, None]).sum(axis=0)
    alpha = (kernel @ (y - bias).astype(np.float32)).astype(np.float64)
    left_out = y - alpha / np.diag(kernel).astype(np.float64)[:, None]  # leave-one-out margins
    del kernel
    trust = np.clip(2 * (np.sign(left_out) == y).mean(axis=0) - 1, 0.05, 1.0)
    weights = sum((spelt(i).T @ alpha[i : i + FIT_ROWS].astype(np.float32) for i in range(0, n, FIT_ROWS)), np.zeros((DIMS, code.shape[1]), np.float32))
    model = Model(languages, code, weights, (bias - mean @ weights).astype(np.float32), trust)
    best, chance = model.decode(left_out)
    right = chance.max(axis=1)[best == known]
    if len(right):
        model.least_score = min(CLEAN_BELOW, float(np.quantile(right, CLEAN_LOST, method="lower")))
    return model


def _sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        x, known = features(batch["text"])
        rows = [np.flatnonzero(r) for r in x]
        yield pd.DataFrame(
            {
                "lang": batch["lang"],
                "draw": batch["draw"],
                "at": [r.astype("<u2").tobytes() for r in rows],
                "value": [x[i, r].astype("<f4").tobytes() for i, r in enumerate(rows)],
            }
        )[known]


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of all languages among the learnable rows of ``docs``."""
    learnable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_FOLD))
    sizes = {r["lang"]: r["n"] for r in learnable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    per_language = max(LEAST_ROWS, sample_rows // len(sizes))
    likely = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, (2 * per_language + 100) / n))])
    draw = hash_unit(F.col("doc_id"), F.col("text"), seed=SEED)
    drawn = learnable.select("lang", "text", draw.alias("draw")).filter(F.col("draw") < likely[F.col("lang")])
    made = staged(drawn.mapInPandas(_sparse, "lang string, draw double, at binary, value binary"), "language-sample")
    place = F.expr("row_number() OVER (PARTITION BY lang ORDER BY draw, at, value)")  # a bounded number of rows
    rows = made.withColumn("place", place).filter(F.col("place") <= per_language).drop("place").toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values(["lang", "at", "value"], kind="stable")
    lang = rows["lang"].to_numpy(dtype=object)
    sample = [(np.frombuffer(at, "<u2"), np.frombuffer(value, "<f4")) for at, value in zip(rows["at"], rows["value"], strict=True)]
    del rows
    return fit(sample, lang)


def identify(docs: DataFrame, model: Model | None, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns of every row with ``lang_pred``, ``score`` and ``ambiguous`` of its ``text``."""
    # bounded: languages x bits and features x bits
    shared = docs.sparkSession.sparkContext.broadcast(vars(model) if model else None)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(**shared.value) if shared.value else None
        for batch in batches:
            parts = [_predicted(model, batch.iloc[i : i + 64]) for i in range(0, len(batch), 64)]
            yield pd.concat(parts, ignore_index=True) if parts else _predicted(model, batch)

    rows = docs.select(*keep, predict(text).alias("found"))
    return rows.select(*keep, "found.lang_pred", "found.score", "found.ambiguous")


def _predicted(model: Model | None, texts: pd.Series) -> pd.DataFrame:
    if model is None:
        n = len(texts)
        return pd.DataFrame({"lang_pred": [UNKNOWN] * n, "score": np.zeros(n), "ambiguous": np.ones(n, dtype=bool)})
    return model.predict(texts)


def keep_identified(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` whose language is found: texts without a letter and ambiguous ones,
    which score below the model's ``least_score``, go.

    A null ``lang`` becomes the predicted one. Where no model can be learned, every text with a
    letter stays as it is.
    """
    model = train(docs, sample_rows)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    whole = docs.select(F.struct("*").alias("row"))
    found = identify(whole, model, "row", text="row.text").filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= model.least_score))
    return found.select(F.col("row").withField("lang", F.coalesce("row.lang", "lang_pred")).alias("row")).select("row.*")


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs), "doc_id")
    return found.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD_FOLD).alias("held_out"), "lang_pred", "score", "ambiguous"
    )

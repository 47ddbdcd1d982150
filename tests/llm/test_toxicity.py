import itertools

import numpy as np
import pandas as pd
from odd import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from eventloom.llm import toxicity_fm as fm
from eventloom.llm.common import held_out

DIR = "/root/testdata/sf0.1"


def test_scores_equal_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(30)]
    terms = np.unique([fm.bucket(w) for w in words])
    model = fm.Model(terms, -0.3, rng.normal(size=len(terms)), rng.normal(size=(len(terms), 4)))
    texts = [" ".join(rng.choice(words, 9)) + " Unknown, WORD3!" for _ in range(20)] + ["", None, "none known"]
    want = []
    for text in texts:
        known = sorted({int(np.searchsorted(terms, fm.bucket(w.lower().strip(",!")))) for w in (text or "").split() if fm.bucket(w.lower().strip(",!")) in terms})
        total = -0.3 + sum(model.weights[i] for i in known) + sum(model.factors[i] @ model.factors[j] for i, j in itertools.combinations(known, 2))
        want.append(1 / (1 + np.exp(-total)))
    assert np.allclose(model.score(pd.Series(texts), {}), want)


def pairs(n, seed):
    """Insults and groups are harmless alone, toxic together."""
    rng = np.random.default_rng(seed)
    texts, label = [], []
    for _ in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = list(rng.choice([f"plain{i}" for i in range(60)], 12))
        words += list(rng.choice(["vermin", "filth", "rats"], int(insult))) + list(rng.choice(["tribea", "tribeb", "tribec"], int(group)))
        texts.append(" ".join(rng.permutation(words)))
        label.append(float(insult and group))
    return texts, np.array(label)


def test_pairs_are_learned_that_weights_alone_miss():
    texts, label = pairs(3000, 1)
    rows = [fm.buckets(t) for t in texts]
    unseen, truth = pairs(1000, 2)
    accuracy = {}
    for rank in (0, fm.RANK):
        model = fm.fit(rows, label, np.ones(len(label)), rank)
        accuracy[rank] = ((model.score(pd.Series(unseen), {}) > 0.5) == truth).mean()
    assert accuracy[fm.RANK] > 0.97 and accuracy[fm.RANK] >= accuracy[0]
    model, linear = fm.fit(rows, label, np.ones(len(label))), fm.fit(rows, label, np.ones(len(label)), 0)
    gap = lambda m: m.score(pd.Series(["vermin tribea"]), {})[0] - max(m.score(pd.Series(["vermin", "tribea"]), {}))
    assert gap(model) > gap(linear)


def test_toxicity_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    found = fm.op11_toxicity_fm(spark, DIR)
    assert found.count() == spark.read.parquet(f"{DIR}/documents.parquet").count()
    rows = found.join(labels, "doc_id").filter("held_out").toPandas()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    caught, clean = rows[rows.toxic == 1].predicted.mean(), 1 - rows[rows.toxic == 0].predicted.mean()
    assert caught > 0.7 and clean > 0.99  # over a quarter of the toxic labels have no insult at all


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = held_out(F.col("doc_id"), 4, 2)
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = fm.train(docs, labels, ~held), fm.train(docs.withColumn("lang", F.lit("x")), flipped, ~held)
    assert a.bias == b.bias and (a.weights == b.weights).all() and (a.factors == b.factors).all()


def test_odd_documents(spark, odd_docs, no_docs):  # noqa: F811
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (3, 0), (None, 1), (7, None), (99, 1)], "doc_id long, toxic int")
    model = fm.train(odd_docs, labels)
    found = fm.scored(odd_docs, model, "doc_id", "text").collect()
    assert len(found) == 10 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if not r.text}) == 1
    assert {r.score for r in fm.scored(odd_docs, None, "doc_id").collect()} == {0.0}
    assert fm.train(odd_docs, labels.limit(0)) is None and fm.train(no_docs, labels) is None
    one = fm.train(odd_docs, labels.filter("toxic = 0"))
    assert {r.predicted for r in fm.scored(odd_docs, one, "doc_id").collect()} == {0}
    assert fm.scored(no_docs, model, "doc_id").count() == 0

import math
import re

import numpy as np
import pandas as pd
import pytest
from odd import no_docs, odd_docs  # noqa: F401

from eventloom.llm import language_id, quality_knn

DIR = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    found = language_id.op5_language_id(spark, DIR)
    both = found.join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(both) == docs.count() and both.score.between(0, 1).all()
    held = both[both.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.98


def test_language_of_odd_documents(spark, odd_docs, no_docs):
    model = language_id.train(odd_docs)
    found = language_id.identify(odd_docs, model, "doc_id", "text").collect()
    assert len(found) == 10
    for r in found:
        lettered = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1
        assert lettered or (r.score == 0 and r.ambiguous)
    assert language_id.train(no_docs) is None
    assert {r.lang_pred for r in language_id.identify(odd_docs, None, "doc_id").collect()} == {"und"}
    assert language_id.identify(no_docs, model, "doc_id").count() == 0
    one = language_id.train(odd_docs.filter("lang = 'en'"))
    assert one is None or one.languages == ["en"]
    kept = language_id.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 6


def test_decoding_survives_wrong_bits():
    code = language_id.codebook(8)
    n, bits = code.shape
    distance = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
    assert min(distance) >= 8
    model = language_id.Model(list("abcdefgh"), code, np.zeros((1, bits)), np.zeros(bits), np.ones(bits))
    wrong = code.copy()
    wrong[:, : min(distance) // 2 - 1] *= -1
    best, chance = model.decode(wrong)
    assert best.tolist() == list(range(n)) and (chance.argmax(axis=1) == best).all()


def test_identification_equals_brute_force_decoding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(docs)
    found = {r.doc_id: r for r in language_id.identify(docs, model, "doc_id").collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        spaced = re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0][0].isalpha() else " ", (text or "").lower(), flags=re.S)
        spaced = " " + re.sub(" +", " ", spaced) + " "
        spaced = (" " if spaced.startswith(" ") and not (text or "x")[0].isalpha() else "") + spaced
        if not any(c.isalpha() for c in text or ""):
            assert (found[doc_id].lang_pred, found[doc_id].score) == ("und", 0.0)
            continue
        counts = language_id.ngram_counts(text)
        assert abs(int(counts.sum()) - (3 * len(spaced) - 5)) <= 1
        x = np.sqrt(counts / counts.sum())
        margins = [float(sum(x[i] * model.weights[i, b] for i in np.flatnonzero(x)) + model.bias[b]) for b in range(model.code.shape[1])]
        loss = [sum(t * math.exp(-max(-4.0, min(4.0, m * c))) for t, m, c in zip(model.trust, margins, word)) for word in model.code]
        chance = [math.exp(-language_id.SHARPNESS * (v - min(loss)) / model.trust.sum()) for v in loss]
        assert found[doc_id].lang_pred == model.languages[loss.index(min(loss))]
        assert abs(found[doc_id].score - max(chance) / sum(chance)) < 1e-4
        assert found[doc_id].ambiguous == (found[doc_id].score < language_id.AMBIGUOUS_BELOW)


def test_slices_count_the_same_ngrams():
    text = "Wörter, 12 жук!  漢字\n" * 50
    whole = language_id.ngram_counts(text)
    assert all((language_id.ngram_counts(text, n) == whole).all() for n in (1, 2, 3, 7, 1000))


def test_every_language_has_its_share_of_the_sample(spark):
    rows = [(i, f"alpha beta gamma {i}", "big") for i in range(3000)] + [(5000 + i, f"жук {i}", f"x{i % 30}") for i in range(120)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 200)
    assert set(model.languages) == {"big"} | {f"x{i}" for i in range(30)}


@pytest.mark.parametrize("n", [2, 3, 5, 6, 7, 40])
def test_codewords_differ(n):
    code = language_id.codebook(n)
    assert len({tuple(r) for r in code}) == n and (abs(code.sum(axis=0)) < n).all()


def test_quality_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    found = quality_knn.op2_quality_knn(spark, DIR)
    both = found.join(labels, "doc_id").toPandas()
    assert found.count() == 1000 and both.score.between(0, 1).all()
    assert (both.predicted == (both.score >= 0.7)).all()
    held = both[both.held_out]
    rank = held.score.rank()
    good = held.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95 and (held.predicted == held.quality).mean() > 0.93


def test_quality_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 1), (3, 0), (None, 1), (7, None), (99, 1)], "doc_id long, quality int")
    model = quality_knn.train(odd_docs, labels)
    found = quality_knn.scored(odd_docs, model, "doc_id", "text").collect()
    assert len(found) == 10 and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in found if not r.text} == {model.prior}
    assert {r.score for r in quality_knn.scored(odd_docs, None, "doc_id").collect()} == {0.5}
    assert quality_knn.train(odd_docs, labels.limit(0)) is None
    assert quality_knn.scored(no_docs, model, "doc_id").count() == 0


def test_votes_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = quality_knn.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    texts = docs.orderBy("doc_id").limit(30).toPandas()["text"]
    v = model.project(quality_knn.features(texts))
    want = []
    for row in v:
        similar = [(float(np.dot(row, other)), y) for other, y in zip(model.vectors, model.labels)]
        nearest = sorted(similar, reverse=True)[: quality_knn.NEIGHBOURS]
        weight = np.clip([s for s, _ in nearest], 0, 1) ** quality_knn.SHARPNESS
        want.append((weight * [y for _, y in nearest]).sum() / weight.sum())
    assert np.allclose(model.score(pd.Series(texts)), want, atol=1e-3)


def test_the_language_stage_uses_its_decisions(spark):
    rng = np.random.default_rng(6)
    words = {"aa": ["bacada", "fagaha", "lamana"], "ee": ["peqere", "setexe", "zebede"]}
    text = lambda *langs: " ".join(rng.choice([w for x in langs for w in words[x]]) for _ in range(60))
    rows = [(i, text(x), x) for i, x in enumerate(["aa", "ee"] * 40)]
    rows += [(100, text("aa"), None), (101, text("ee"), None), (102, "жщю ждш " * 20, None), (103, "12 3", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.lang for r in language_id.keep_identified(docs).collect()}
    assert kept == {i: x for i, _, x in rows[:80]} | {100: "aa", 101: "ee"}


def test_the_language_stage_without_a_model_keeps_texts_with_a_letter(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, "1 2", None), (3, None, None), (4, "ж", None)], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang) for r in language_id.keep_identified(docs).collect()} == {(1, None), (4, None)}

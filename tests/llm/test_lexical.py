import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from odd import no_docs, odd_docs  # noqa: F401
from oracle import compare

from eventloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(d, Counter(cut(t)), len(cut(t))) for d, t in docs if cut(t)]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, counts, size in held:
            m = 75 + (25 * size * n) // total
            parts = [math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m)) for t in cut(text) if counts[t]]
            if sum(parts) > 0:
                scores.append((-sum(parts), doc_id is None, doc_id or 0))
        out += [(str(item_id), i, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=20, **more):
    docs = docs if not isinstance(docs, list) else spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS rank", "2 AS item", "3 AS score", "4 AS item_id")
    items = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS item")
    return sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in lexical.ranked(docs, items, k, **more).collect()), key=str)


def corpus(seed, n, words=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["ÄÖ", "straße", "Foo9"]
    weight = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, weight, k=rng.randrange(1, 40)))
    return [(i, text()) for i in range(n)], [(i, text()) for i in range(12)]


def test_equals_brute_force_with_ties_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    monkeypatch.setattr(lexical, "MASKS_AT_ONCE", 3)
    docs, items = corpus(1, 150)
    docs += [(3, docs[3][1]), (None, docs[3][1]), (500, docs[3][1]), (501, None), (502, ""), (503, "!!! ..."), (2**60 + 1, docs[5][1])]
    items += [(None, docs[3][1]), (3, items[3][1]), (50, None), (51, ""), (52, "unseen terms only"), (53, "w0 w0 w0 W0 foo9")]
    assert run(spark, docs, items, 7) == brute(docs, items, 7)


@pytest.mark.parametrize("k", [1, 500])
def test_few_and_all_documents(spark, k):
    docs, items = corpus(2, 60)
    assert run(spark, docs, items[:4], k) == brute(docs, items[:4], k)


def test_items_in_several_groups_give_the_same(spark):
    docs, items = corpus(3, 80)
    assert run(spark, docs, items, 5, group_bytes=400) == brute(docs, items, 5)


def test_a_term_of_every_document_weighs_by_its_rule(spark):
    docs = [(i, "all same words") for i in range(40)]
    assert run(spark, docs, [(1, "all")], 3) == brute(docs, [(1, "all")], 3)


def test_long_items_have_wide_masks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "MASK_CELLS", 1000)
    docs, _ = corpus(4, 200, words=300)
    items = [(1, " ".join(f"w{i}" for i in range(300))), (2, "w1 w2")]
    assert run(spark, docs, items, 9) == brute(docs, items, 9)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(1, "one two"), (2, "Wörter 34 x")]
    assert run(spark, odd_docs, items) == brute(rows, items, 20)
    assert run(spark, no_docs, items) == []
    assert run(spark, rows, []) == []


def test_lengths_beyond_64_bits_stay_exact():
    lengths, n, total = np.array([10**7, 3]), 5 * 10**12, 7 * 10**15
    assert lexical.length_marks(lengths, n, total).tolist() == [75 + (25 * x * n) // total for x in (10**7, 3)]


def test_search_stops_before_all_masks_are_evaluated():
    rng = np.random.default_rng(5)
    n_docs, n_terms = 1000, 12
    present = rng.random((n_docs, n_terms)) < 0.3
    docs, held = np.nonzero(present)
    starts = np.concatenate(([0], np.cumsum(present.sum(axis=1))))
    weights = np.array([4000] * 2 + [5] * 10)
    block = lexical.Block.of(np.full(n_docs, 50), starts, held, np.ones(len(held), int), weights, n_docs, 50 * n_docs)
    best, ids = lexical.Best(20), np.arange(n_docs)
    scored = lexical.search_block(block, np.arange(n_terms), np.ones(n_terms, int), ids, np.zeros(n_docs, bool), best)
    score = np.zeros(n_docs, int)
    np.add.at(score, block.docs, block.impact)
    want = sorted((-s, i) for i, s in enumerate(score))[:20]
    assert list(zip(-best.score, best.ids)) == want and scored < n_docs / 4


def test_query_equals_oracle(spark, con):
    rows, problem = compare(lexical.op13_lexical_search(spark, "/root/testdata/sf0.001"), con, lexical.ORACLE)
    assert problem is None and rows > 0

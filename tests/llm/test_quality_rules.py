import re
from collections import Counter

import pytest
from conftest import SMALL
from odd import no_docs, odd_docs  # noqa: F401
from oracle import compare

from eventloom.llm import quality_rules as rules


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_query_equals_its_sql(spark, con):
    rows, problem = compare(rules.op8_quality_rules(spark, SMALL), con, rules.ORACLE)
    assert problem is None and rows > 0


def test_counts_equal_brute_force(spark, odd_docs):
    texts = [r.text for r in odd_docs.select("text").collect()]
    texts += ["a b c a b c a b c", "a a a a", "a b c", "x y z\nx y z\n\n \nx y z", "\x0b\x0ca\x1cb 😀 é", "a b c d a b c e f g a b c " * 9]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], "doc_id int, text string, lang string, source string")
    got = rules.measured(df, "doc_id").orderBy("doc_id").collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert [tuple(r[n] for n in names) for r in got] == [counts(t) for t in texts]


def corpus(spark, n, junk):
    word = lambda i, j: f"w{i * 131 % 97 + 100}x{j + 100}"
    rows = [(i, " ".join(word(i, j) for j in range(80)), "en", "big" if i % 3 else "small") for i in range(n)]
    rows += [(1000 + i, " ".join(word(i, j) + "$$" for j in range(80)), "en", "big") for i in range(junk)]
    return spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")


def test_thresholds_adapt_to_the_group(spark):
    found = {r.doc_id: r.kept for r in rules.apply_rules(corpus(spark, 400, 20)).collect()}
    assert all(found[i] for i in range(400)) and not any(found[1000 + i] for i in range(20))
    # where most documents are like that, it is the rule
    found = {r.doc_id: r.kept for r in rules.apply_rules(corpus(spark, 200, 900)).collect()}
    assert all(found[1000 + i] for i in range(900))


def test_sketches_merge(spark):
    docs = rules.measured(corpus(spark, 120, 10), "doc_id", "lang", "source")
    halves = [rules.sketch(docs.filter(f"doc_id % 2 = {k}")) for k in (0, 1)]
    order = ["lang", "source", "ratio", "bin"]
    assert rules.merged(*halves).orderBy(order).collect() == rules.sketch(docs).orderBy(order).collect()


def test_bins_are_narrow(spark):
    values = spark.range(0, 5000).selectExpr("CAST(id * id AS LONG) AS n_symbols", "10000L AS n_words", "0L AS n_dup_lines", "0L AS n_lines", "0L AS n_repeat_words", "0L AS word_chars")
    df = values.selectExpr("*", "'en' AS lang", "CAST(n_symbols AS STRING) AS source", "false AS base_failed")
    edges = rules.quartiles(rules.sketch(df), "source").filter("ratio = 'symbols'").selectExpr("CAST(source AS LONG) AS v", "q25")
    assert edges.filter("q25 > v OR v - q25 > v / 32").count() == 0


@pytest.mark.parametrize("stage", [rules.apply_rules, rules.keep_good])
def test_odd_documents(odd_docs, no_docs, stage):
    assert stage(no_docs).count() == 0
    assert stage(odd_docs).count() == (10 if stage is rules.apply_rules else 0)


def test_stage_keeps_columns_and_agrees_with_the_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    want = rules.apply_rules(docs).filter("kept").select("doc_id")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in want.collect())

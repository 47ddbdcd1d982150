import itertools

import corpus_pipeline
import __spark_entry__ as entry_point
from odd import no_docs, odd_docs  # noqa: F401

from eventloom.llm import catalog, language_id, mixing, quality_rules, simhash
from eventloom.llm.common import staged

DIR = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = entry_point.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in names and set(catalog.ORACLES) <= set(catalog.QUERIES)


def brute_kept(df):
    """The smallest id of each group of texts of similarity 0.8 or more, over all pairs."""
    rows = sorted((r.doc_id, r.text.translate({c: c + 32 for c in range(65, 91)}).split()) for r in df.collect())
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for _, w in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if x == high else x for x in root]
    return sorted(rows[i][0] for i in set(root))


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    at = dict(corpus_pipeline.STAGES)
    assert list(at) == ["language", "quality", "near_duplicates", "mixing", "packing"]
    named = staged(at["language"](spark, docs, DIR), "s1")
    model = language_id.train(docs)
    found = language_id.identify(docs, model, "doc_id")
    assert ids(named) == ids(found.filter((found.lang_pred != "und") & (found.score >= model.least_score)))
    good = staged(at["quality"](spark, named, DIR), "s2")
    assert ids(good) == ids(quality_rules.apply_rules(named).filter("kept")) and 0 < good.count() < named.count()
    single = staged(at["near_duplicates"](spark, good, DIR), "s3")
    assert ids(single) == ids(simhash.keep_first(good)) == brute_kept(good)
    mix = staged(at["mixing"](spark, single, DIR), "s4")
    assert ids(mix) == sorted(r.d for r in mixing.replicated(single).selectExpr("row.doc_id AS d").collect())
    for df in (named, good, single, mix):
        assert df.columns == docs.columns
    pieces = at["packing"](spark, mix, DIR).toPandas()
    whole = pieces.groupby("doc_id")[["length"]].sum().join(pieces.groupby("doc_id").doc_tokens.first())
    copies = mix.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert (whole.length == whole.doc_tokens * copies).all() and set(whole.index) == set(copies.index)
    assert len(corpus_pipeline.run(spark, DIR).toPandas()) == len(pieces)


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs):  # noqa: F811
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, DIR).count() == 0, name
        stage(spark, odd_docs, DIR).count()

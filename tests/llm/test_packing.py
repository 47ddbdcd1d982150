import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import no_docs, odd_docs  # noqa: F401
from tokenizers import Tokenizer

from eventloom.llm import tier_packing, token_matrices, tokens

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return tokens.WordTokenizer(tokens.default_tokenizer())


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokens.default_tokenizer())


@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from(list(" \n\t'aAbsSdßéÉΣσİ̌́!$.<|>_1½"))), max_size=60))
@settings(max_examples=400, deadline=None)
def test_cached_ids_equal_the_tokenizers(encoder, plain, text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoder.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text", ["", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>", "it's I'LL don't'RE dogs' b's. ''s", "J̌a ǰ Å ﬁ 한글 ᆫ", "a\x1cb\x85c\xa0d e", "ÄÖÜß ΑΣ ΣΑΣ."]
)
def test_special_texts(encoder, plain, text):
    assert encoder.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_documents_have_the_tokenizers_ids(spark, encoder, plain):
    texts = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect()]
    assert all(encoder.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids for t in texts)


@pytest.mark.parametrize("cached, together", [(50, 1 << 18), (3_000, 2_000)])
def test_a_small_cache_gives_the_same_ids(spark, plain, monkeypatch, cached, together):
    monkeypatch.setattr(tokens.WordTokenizer, "CACHED", cached)
    monkeypatch.setattr(tokens.WordTokenizer, "TOGETHER", together)
    small = tokens.WordTokenizer(tokens.default_tokenizer())
    texts = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect()]
    texts += [None, "", " ", "x" * 5_000 + " dogs' b's.", "ΑΣ <|endoftext|>", texts[0]]
    found = list(small.documents(texts, 1))
    assert [f.tolist() for f in found] == [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert len(small.words) <= cached + 1 and small.elder


@pytest.mark.parametrize("at_once", [1, 7, 1000])
def test_distinct_words_are_looked_up_once_and_marks_apart(plain, monkeypatch, at_once):
    monkeypatch.setattr(tokens.WordTokenizer, "AT_ONCE", at_once)
    one = tokens.WordTokenizer(tokens.default_tokenizer())
    texts = ["Dogs, dogs. dogs!", "", "dogs dogs,\ncats.", "ΣΑΣ dogs", " it's  it's ", "cats. dogs!"] * 3
    asked, plainly = [], one._coded
    monkeypatch.setattr(one, "_coded", lambda words: asked.append(words) or plainly(words))
    assert [x.tolist() for x in one.batch(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) == 1 and len(asked[0]) == len(set(asked[0]))
    assert set(one.words) == {"", "dogs", "cats", "it's", ",", ".", "!"}


def pieces_cover(rests, windows):
    got = {}
    for doc, start, n in sorted(p for w in windows for p in w):
        got.setdefault(doc, []).append((start, n))
    for doc, start, n in rests:
        at = start
        for s, m in sorted(got.pop(doc)):
            assert s == at and m > 0
            at += m
        assert at == start + n
    assert not got


def size(window):
    return sum(n for _, _, n in window)


def test_pools_fill_their_tiers():
    random.seed(4)
    for _ in range(200):
        lengths = [random.choice([1, 2, 200, 255, 256, 257, 1024, 2047, random.randint(1, 2047)]) for _ in range(random.randint(0, 40))]
        rests = [(i, random.choice([0, 2048]), n) for i, n in enumerate(lengths)]
        windows, left = tier_packing.pack_pool(rests)
        closed = tier_packing.close(left, 2048)
        pieces_cover(rests, windows + closed)
        assert all(size(w) in tier_packing.TIERS for w in windows)
        assert all(size(w) & (size(w) - 1) == 0 or size(w) >= 2048 - tier_packing.ALMOST_FULL for w in closed)


def test_step_groups_are_balanced():
    lengths = [2048] * 70 + [1024] * 33 + [512] * 50 + [256] * 91
    groups = tier_packing.step_groups(lengths)
    loads = np.bincount(groups, weights=lengths)
    assert loads.max() - loads.min() <= 256


def check_pieces(rows, texts, plain, end_id):
    """Pieces of all documents restore their ids."""
    found = {}
    for doc_id, start, ids in rows:
        found.setdefault(doc_id, []).append((start, ids))
    want = {}
    for doc_id, text in texts:
        want.setdefault(doc_id, []).append(plain.encode(text or "", add_special_tokens=False).ids + [end_id])
    for doc_id, documents in want.items():
        assert sorted(x for _, ids in found[doc_id] for x in ids) == sorted(x for d in documents for x in d)
        if len(documents) == 1:
            assert [x for _, ids in sorted(found[doc_id]) for x in ids] == documents[0]
    assert set(found) == set(want)


@pytest.mark.parametrize("source", ["documents", "odd"])
def test_packed_sequences_restore_the_documents(spark, odd_docs, plain, source, monkeypatch):  # noqa: F811
    monkeypatch.setattr(tier_packing, "POOL_TOKENS", 20_000)
    docs = odd_docs if source == "odd" else spark.read.parquet(f"{DIR}/documents.parquet")
    rows, pieces = tier_packing.packed(docs).collect(), []
    assert len({r.sequence_id for r in rows}) == len(rows)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == r.tokens <= r.tier <= 2048 and (r.tokens == r.tier or r.tier == 2048)
        at = 0
        for s in r.segments:
            assert s.offset == at
            part = ids[at : at + s.length]
            assert tokens.ids_crc32(part) == s.ids_crc32
            pieces.append((s.doc_id, s.start, part.tolist()))
            at += s.length
        assert at == r.tokens
    check_pieces(pieces, [(r.doc_id, r.text) for r in docs.collect()], plain, tier_packing.END_ID)
    padding = sum(r.tier - r.tokens for r in rows) / sum(r.tier for r in rows)
    assert padding < 0.01


def test_empty_tables_pack_to_nothing(no_docs):  # noqa: F811
    assert tier_packing.packed(no_docs).count() == 0 and token_matrices.matrices(no_docs).count() == 0


def test_best_fit_equals_a_plain_search():
    random.seed(5)
    for _ in range(200):
        pieces = [(i, 0, random.choice([1, 7, 64, 100, random.randint(1, 100)])) for i in range(random.randint(0, 60))]
        rows = token_matrices.best_fit_decreasing(pieces, 100)
        assert sorted(p for r in rows for p in r) == pieces
        rooms = []
        for n in sorted((n for *_, n in pieces), reverse=True):
            fits = [i for i, room in enumerate(rooms) if room >= n]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= n
            else:
                rooms.append(100 - n)
        assert sorted(100 - size(r) for r in rows) == sorted(rooms)


@pytest.mark.parametrize("source", ["documents", "odd"])
def test_matrices_restore_the_documents(spark, odd_docs, plain, source, tmp_path, monkeypatch):  # noqa: F811
    monkeypatch.setattr(token_matrices, "POOL_TOKENS", 20_000)
    docs = odd_docs if source == "odd" else spark.read.parquet(f"{DIR}/documents.parquet")
    token_matrices.write_matrices(docs, f"{tmp_path}/m")
    rows, pieces = spark.read.parquet(f"{tmp_path}/m").collect(), []
    assert len({r.row_id for r in rows}) == len(rows)
    for r in rows:
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        cuts = np.frombuffer(r.cu_seqlens, "<i4").tolist()
        assert len(ids) == len(places) == 2048 and cuts[-1] == r.tokens and len(cuts) == len(r.segments) + 1
        for s, a, b in zip(r.segments, cuts, cuts[1:]):
            assert s.length == b - a and places[a:b].tolist() == list(range(b - a))
            pieces.append((s.doc_id, s.start, ids[a:b].tolist()))
        assert not ids[r.tokens :].any()
    check_pieces(pieces, [(r.doc_id, r.text) for r in docs.collect()], plain, token_matrices.END_ID)

import itertools
import random
import re

import xxhash
from odd import no_docs, odd_docs  # noqa: F401

from eventloom.llm import simhash
from eventloom.llm.common import components


def fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        known = [x for x in (smallest.get(find(i)), doc_id) if x is not None]
        smallest[find(i)] = min(known) if known else None
    return sorted((str(d), prints[i], smallest[find(i)]) for i, (d, _) in enumerate(rows))


def run(df):
    return sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect())


def test_documents_equal_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert run(df) == brute(rows)


def test_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert run(odd_docs) == brute(rows)
    assert run(no_docs) == []


def test_links_join_all_fingerprints_within_the_radius(spark):
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(12)]
    prints = set(base)
    for b in base:  # chains and stars at one, two and three bits
        for _ in range(12):
            bits = random.sample(range(64), random.choice([1, 2, 2, 3]))
            near = random.choice(sorted(prints)) if random.random() < 0.5 else b
            prints.add(near ^ sum(1 << x for x in bits))
    signed = sorted(p - 2**64 if p >= 2**63 else p for p in prints)
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    got = {r.node: r.root for r in components(links).collect()}
    root = {p: p for p in signed}
    for _ in signed:
        for a, b in itertools.combinations(signed, 2):
            if ((a ^ b) % 2**64).bit_count() <= 2:
                root[a] = root[b] = min(root[a], root[b])
    assert {p: got.get(p, p) for p in signed} == root


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, i) for i in range(1001, 1200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 1000 for i in range(1001, 1200)}


def test_one_document_of_each_group_stays(odd_docs, no_docs):
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    groups = {c for _, _, c in run(odd_docs)}
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(groups)
    assert simhash.keep_first(no_docs).count() == 0


def edited(rng, kept, size=400):
    """Two texts of which a share of about ``kept`` 5-word shingles is common."""
    a = [f"w{rng.randrange(10**9)}" for _ in range(size)]
    b, shared = list(a), lambda x: {tuple(x[i : i + 5]) for i in range(size - 4)}
    while True:
        b[rng.randrange(size)] = f"v{rng.randrange(10**9)}"
        x, y = shared(a), shared(b)
        similarity = len(x & y) / len(x | y)
        if similarity <= kept:
            return " ".join(a), " ".join(b), similarity


def test_the_stage_joins_edited_copies_from_similarity_80(spark):
    rng = random.Random(8)
    pairs = [edited(rng, kept) for kept in (0.97, 0.92, 0.87, 0.84, 0.7, 0.5) for _ in range(15)]
    texts = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert kept >= {2 * i for i in range(len(pairs))}
    assert {2 * i + 1 for i, p in enumerate(pairs) if p[2] < 0.8} == {i for i in kept if i % 2}


def test_the_stage_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text.translate({c: c + 32 for c in range(65, 91)}).split()) for r in df.collect())
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for _, w in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if x == high else x for x in root]
    kept = sorted(r.doc_id for r in simhash.keep_first(df).collect())
    assert kept == [rows[i][0] for i in sorted(set(root))]


def similar_components(texts, percent=80):
    """Components by brute force: the smallest place of each."""
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    held = {}
    for i, x in enumerate(sets):
        for shingle in x:
            held.setdefault(shingle, []).append(i)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(sets):
        shared = {}
        for shingle in x:
            for j in held[shingle]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(x) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted({find(i) for i in range(len(texts))})


def changed(rng, base, n):
    out = list(base)
    for at in rng.sample(range(len(base)), n):
        out[at] = f"v{rng.randrange(10**9)}"
    return out


def kept_ids(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.keep_first(df).collect())


def test_families_of_edits_of_one_text_stay_whole(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(5):
        base = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        texts += [" ".join(base), *(" ".join(changed(rng, base, rng.randrange(4, 12))) for _ in range(50))]
    rng.shuffle(texts)
    assert kept_ids(spark, texts) == similar_components(texts)


def test_a_chain_of_edits_stays_whole(spark):
    rng = random.Random(13)
    chain = [[f"w{rng.randrange(10**9)}" for _ in range(200)]]
    while len(chain) < 60:
        chain.append(changed(rng, chain[-1], 3))
    texts = [" ".join(x) for x in chain]
    rng.shuffle(texts)
    assert kept_ids(spark, texts) == similar_components(texts) == [0]


def test_a_large_family_around_a_template(spark, monkeypatch):
    """A bucket of far more than SMALL texts: one hub, most members apart from each other."""
    monkeypatch.setattr(simhash, "SMALL", 16)
    rng = random.Random(14)
    template = [f"w{rng.randrange(10**9)}" for _ in range(100)]
    own = [template + [f"o{rng.randrange(10**9)}" for _ in range(40)] for _ in range(250)]
    near = [changed(rng, rng.choice(own), 2) for _ in range(250)]
    texts = [" ".join(x) for x in own + near]
    rng.shuffle(texts)
    assert kept_ids(spark, texts) == similar_components(texts)


def test_all_of_a_large_bucket_meet(spark, monkeypatch):
    """Pairs at the least similarity among texts that share most of their words: they share few buckets, all of them large."""
    monkeypatch.setattr(simhash, "SMALL", 3)
    monkeypatch.setattr(simhash, "PART_TEXTS", 40, raising=False)
    rng = random.Random(15)
    template = [f"w{rng.randrange(10**9)}" for _ in range(70)]
    own = [template + [f"o{rng.randrange(10**9)}" for _ in range(30)] for _ in range(120)]
    near = [x[:-10] + [f"v{rng.randrange(10**9)}" for _ in range(10)] for x in own]
    texts = [" ".join(x) for x in own + near]
    rng.shuffle(texts)
    assert len(similar_components(texts)) == 120
    assert kept_ids(spark, texts) == similar_components(texts)


def test_parts_of_a_large_bucket_link_all_similar_pairs(spark, monkeypatch):
    rng = random.Random(16)
    base = [[rng.randrange(1 << 62) for _ in range(40)] for _ in range(6)]
    sets = [base[i % 6][: 40 - i % 4] + [rng.randrange(1 << 62) for _ in range(i % 9)] for i in range(60)]
    alike = {(i, j) for i, j in itertools.combinations(range(60), 2) if 10 * len({*sets[i]} & {*sets[j]}) >= 8 * len({*sets[i]} | {*sets[j]})}
    held = spark.createDataFrame(list(enumerate(sets)), "key long, shingles array<long>")
    rows = [(1, i, len(x), [0, 0, 0, 0], i // 12, 60, sum(map(len, sets))) for i, x in enumerate(sets)]
    rows = spark.createDataFrame(rows, "group long, key long, n int, sketch array<long>, root long, rows long, total long")
    for texts, shingles in ((1000, 10**6), (7, 10**6), (1000, 300)):
        monkeypatch.setattr(simhash, "PART_TEXTS", texts)
        monkeypatch.setattr(simhash, "PART_SHINGLES", shingles)
        found = [tuple(sorted(r)) for r in simhash.crossed_wide(rows, held, 80).collect()]
        assert sorted(found) == sorted((i, j) for i, j in alike if i // 12 != j // 12)


def test_texts_whose_keys_collide_are_told_apart(spark):
    df = spark.createDataFrame([(7, 1, "a"), (7, 2, "b"), (7, 2, "c"), (8, 5, "d")], "key long, check long, x string")
    checks = spark.createDataFrame([(7, 1)], "key long, first_check long")
    assert {r.x: r.key for r in simhash.apart(df, checks).collect()} == {"a": 7, "b": 2, "c": 2, "d": 8}


def test_the_row_that_stays_does_not_depend_on_order(spark):
    rows = [(1, "one two three four five six", x) for x in "abcdefgh"]
    df = lambda r: spark.createDataFrame(r, "doc_id long, text string, source string").repartition(5)
    assert {simhash.keep_first(df(r)).first().source for r in (rows, rows[::-1], rows[3:] + rows[:3])} == {simhash.keep_first(df(rows)).first().source}


def test_rows_that_share_an_id_or_have_none_are_told_apart(spark):
    a, b, c, d, e = ("alpha beta gamma", "delta epsilon", "zeta eta theta", "iota kappa", "lambda mu nu xi")
    rows = [(None, a), (None, b), (None, c), (None, c), (1, c), (5, d), (5, e), (None, d), (3, e)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("None", a), ("None", b), ("1", c), ("5", d), ("3", e)])


def test_the_stage_links_by_balls_of_fingerprints(spark, monkeypatch):
    prints = [0, 1, 3, 7, 7, 1 << 40, 255 << 20, 253 << 20, -(1 << 63)]
    nodes = spark.createDataFrame([(10 + i, fp) for i, fp in enumerate(prints)], "key long, fp long")
    linked = {r.node: r.root for r in components(simhash.ball_pairs(nodes)).collect()}
    close = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if ((prints[i] ^ prints[j]) % 2**64).bit_count() <= 2]
    assert close and all(linked.get(10 + i, 10 + i) == linked.get(10 + j, 10 + j) for i, j in close)
    # texts that share no band: the balls alone find them
    nothing = lambda rows, percent: spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "starred", nothing)
    monkeypatch.setattr(simhash, "crossed", nothing)
    words = [f"w{i}" for i in range(2000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, "another text of some more words")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]

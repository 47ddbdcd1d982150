import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from oracle import compare

from eventloom.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, shared):
    def digest(r):
        role, text = r[2] or "", r[3] or ""
        return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()

    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, digest(r))):
        own[r[0]].append((r[2] or "", r[3] or ""))
    built = dict(own)
    if shared:
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    out = []
    for node, convs in members.items():
        under = [x for x in members if x[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        out.append(
            (
                min(convs),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(convs),
                len(kids[node]),
                sum(not kids[x] for x in under),
                sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def run(spark, rows, shared=False):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS conv", "2 AS pos", "3 AS k", "4 AS depth", "5 AS digest", "6 AS n")
    return sorted((tuple(r) for r in trie.prefix_trie(df, shared).collect()), key=str)


def talks(seed, n, longest=14, words=2):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "bot"]) if words > 1 else "user", "x" * rng.randrange(1, words + 1)))
    return rows


@pytest.mark.parametrize("shared", [False, True])
def test_equals_brute_force(spark, shared):
    rows = talks(1, 230, 9, 1) + [(1000 + c, t, r, x) for c, t, r, x in talks(2, 120, 11, 2)]
    rows += [(c, t, "user", "same") for c in range(2000, 2060) for t in range(9)]  # a group of copies
    assert run(spark, rows, shared) == brute(rows, shared)


def test_siblings_that_diverge_at_every_turn_of_a_block(spark):
    path = ["a", "b", "c", "d", "e", "f", "g", "h", "i"]
    rows, c = [], 10
    for cut in range(len(path) + 1):
        for tail in ([], ["z"], ["z", "y", "x", "w", "v"]):
            rows += [(c, t, "r", x) for t, x in enumerate(path[:cut] + tail)]
            c -= 1 if c % 3 else -17
    assert run(spark, rows) == brute(rows, False)


def test_odd_conversations(spark):
    rows = [
        (5, 1, "user", "a"), (5, 1, "user", "a"), (5, None, None, None), (5, 0, "user", None), (None, 1, "user", "a"),
        (7, 3, "us", "era"), (8, 3, "user", "a"), (9, 3, None, "usera"), (-250, 0, "user", "ä😀"), (-200, 0, "user", "ä😀"), (-201, 2, "", ""),
        (2, 0, "user", "long " * 30000),
    ]
    for shared in (False, True):
        assert run(spark, rows, shared) == brute(rows, shared)
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "a", "b")]) == []


def test_conversations_without_turns_are_members_of_the_root(spark):
    bare = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 6 > 1 and c % 100][:5]
    rows = [(c, 0, "user", "gone") for c in bare]
    found = run(spark, rows, True)
    assert found == brute(rows, True)
    assert len(found) == 1 and found[0][:7] == (min(bare), 0, None, 5, 0, 1, 0)


def test_long_conversations_run_over_many_stretches_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 2)
    monkeypatch.setattr(trie, "PIECE_IDS", 3)
    rows = [(c, t, "u", "same" if t < 45 - c else f"own {c} {t // 3}") for c in range(4) for t in range(60)]
    rows += [(c, t, "u", "same") for c in range(100, 120) for t in range(7)]
    assert run(spark, rows) == brute(rows, False)


def test_query_equals_oracle(spark, con):
    rows, problem = compare(trie.op12_prefix_trie(spark, "/root/testdata/sf0.001"), con, trie.ORACLE)
    assert problem is None and rows > 0

"""Prefix trie of conversations by fixed-length block hashing.

1. Every turn has a 128-bit digest of its role and text and, with its place, two 64-bit numbers.
   ``BLOCK_TURNS`` turns in a row are a block; a block's digest is the XOR of its turns' numbers,
   and the XOR of a conversation's blocks up to one of them identifies that whole prefix.
2. Conversations are grouped block by block: one row per distinct prefix of whole blocks (and of
   a last, shorter block), with its number of members and smallest member.
3. Turn boundaries are refined for one representative of each of these rows only, and merged only
   where several blocks follow the same prefix; a block without siblings is a plain chain.
4. Sums over subtrees follow without iteration from who owns a node, which is its smallest
   member: along a conversation's path the nodes that it owns are the last ones, so each node's
   value reaches its ancestors along its owner's path, inside a block by turns and above by blocks.

No window holds a conversation: turns are numbered over range partitions, and running values go
through stretches of ``STRETCH`` blocks. Member lists are hashed as a stream of joined pieces.

Defined results: turns are ordered by ``turn`` (null first), equal ones by digest, repeated rows
stay; null role or text is empty; rows of null conversation id take no part; a conversation
without turns is a member of the root; an empty table has no node; other columns are not looked
at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.ordering import numbered

from .common import staged, table
from .registry import query

BLOCK_TURNS = 4
STRETCH = 4096
PIECE_IDS = 4096
HEAD_EVERY, HEAD_TURNS = 100, 6

KEY = ["depth", "f1", "f2"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv, pos, digest, chars``: each conversation's turns, numbered from 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").isNotNull().alias("told"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    # rows that are equal in everything differ in their place in the stored table, so that they spread
    salted = staged(rows, "trie-turns").withColumn("salt", F.monotonically_increasing_id())
    placed = numbered(salted, ["conv"], ["told", "turn", "digest", "salt"], name="n")
    return staged(placed.select("conv", (F.col("n") - 1).alias("pos"), "digest", "chars"), "trie-numbered")


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """Conversations rebuilt on the first turns of their hundred's first conversation.

    Conversation c takes the first h turns of conversation c - c % 100, then its own turns after
    its first h, h being CRC-32 of its id modulo 6 (remainders of negative ids are negative).
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD_TURNS).cast("int")
    base = F.col("conv") - F.col("conv") % HEAD_EVERY
    first = turns.filter((F.col("conv") % HEAD_EVERY == 0) & (F.col("pos") < HEAD_TURNS))
    heads = first.groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head"))
    heads = staged(heads, "trie-heads")
    starts = turns.filter("pos = 0").select("conv", base.alias("base"), h.alias("h")).join(heads, "base")
    taken = starts.select("conv", F.explode(F.slice("head", 1, F.col("h"))).alias("t")).select("conv", "t.*")
    own = turns.withColumns({"base": base, "h": h}).filter("pos >= h")
    own = own.join(heads.select("base", F.size("head").alias("n_head")), "base", "left")
    moved = F.col("pos") - F.col("h") + F.least("h", F.coalesce("n_head", F.lit(0)))
    return taken.unionAll(own.select("conv", moved.alias("pos"), "digest", "chars"))


def _xor(column: str, rows) -> Column:
    return F.coalesce(F.bit_xor(column).over(rows), F.lit(0).cast("long"))


def _running(df: DataFrame, values: list[str], fold, names: list[str], last_first: bool = False) -> DataFrame:
    """Adds ``names``: ``values`` folded over the earlier (or later) blocks of the conversation.

    Blocks run within stretches; what earlier stretches hold is added from a table of stretches,
    which has a row only where a conversation has several.
    """
    k, s = F.col("k"), F.col("k") / STRETCH
    df = df.withColumn("stretch", F.floor(s).cast("long"))
    order = lambda c: c.desc() if last_first else c.asc()
    inside = Window.partitionBy("conv", "stretch").orderBy(order(k)).rowsBetween(Window.unboundedPreceding, -1)
    among = Window.partitionBy("whose").orderBy(order(F.col("which"))).rowsBetween(Window.unboundedPreceding, -1)
    whole = df.groupBy(F.col("conv").alias("whose"), F.col("stretch").alias("which")).agg(*[fold(v).alias(v) for v in values])
    carried = whole.select("whose", "which", *[fold(v).over(among).alias(f"before_{v}") for v in values]).filter(f"before_{values[0]} IS NOT NULL")
    both = df.join(carried, (F.col("conv") == F.col("whose")) & (F.col("stretch") == F.col("which")), "left")
    zero = F.lit(0).cast("long")
    join = (lambda a, b: a.bitwiseXOR(b)) if fold is F.bit_xor else (lambda a, b: a + b)
    made = {n: join(F.coalesce(fold(v).over(inside), zero), F.coalesce(f"before_{v}", zero)) for v, n in zip(values, names, strict=True)}
    return both.withColumns(made).drop("whose", "which", "stretch", *[f"before_{v}" for v in values])


def blocks_of(turns: DataFrame) -> DataFrame:
    """``conv, k, n, turns, pre1, pre2, post1, post2``: the blocks of every conversation."""
    number = lambda seed: F.xxhash64(F.lit(seed), "pos", "digest")
    salted = turns.select("conv", F.floor(F.col("pos") / BLOCK_TURNS).cast("long").alias("k"), "pos", number(1).alias("h1"), number(2).alias("h2"), "chars")
    grouped = salted.groupBy("conv", "k").agg(
        F.bit_xor("h1").alias("x1"),
        F.bit_xor("h2").alias("x2"),
        F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "chars"))).alias("turns"),
    )
    placed = _running(staged(grouped, "trie-blocks"), ["x1", "x2"], F.bit_xor, ["pre1", "pre2"])
    posts = {f"post{i}": F.col(f"pre{i}").bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)}
    return staged(placed.withColumns(posts).withColumn("n", F.size("turns")).drop("x1", "x2"), "trie-prefixes")


def steps_of(prefixes: DataFrame, *keep: str) -> DataFrame:
    """One row per turn of a block: ``depth, f1, f2`` of its node, ``p1, p2`` of the node above, ``i``, ``chars``."""
    grown = lambda name, size: F.aggregate(
        F.slice("turns", 1, size), F.col(f"pre{name}"), lambda a, t: a.bitwiseXOR(t[f"h{name}"])
    )
    step = lambda i: F.struct(
        (F.col("k") * BLOCK_TURNS + i + 1).alias("depth"),
        grown(1, i + 1).alias("f1"),
        grown(2, i + 1).alias("f2"),
        grown(1, i).alias("p1"),
        grown(2, i).alias("p2"),
        i.alias("i"),
        F.get("turns", i)["chars"].alias("chars"),
    )
    path = F.transform(F.sequence(F.lit(0), F.col("n") - 1), step)
    return prefixes.select(*keep, F.explode(path).alias("step")).select(*keep, "step.*")


def refined(prefixes: DataFrame) -> DataFrame:
    """All nodes below the root: ``depth, f1, f2, p1, p2, chars, n_convs, owner``."""
    alone = prefixes.groupBy("k", "pre1", "pre2").agg(F.count("*").alias("siblings"), F.min("owner").alias("owner")).filter("siblings = 1")
    marked = prefixes.join(alone.select("owner", "k", "siblings"), ["owner", "k"], "left")
    columns = [*KEY, "p1", "p2", "chars", "n_convs", "owner"]
    chains = steps_of(marked.filter("siblings = 1"), "n_convs", "owner").select(columns)
    diverging = steps_of(marked.filter("siblings IS NULL"), "n_convs", "owner")
    merged = diverging.groupBy(*KEY).agg(
        *[F.first(c).alias(c) for c in ("p1", "p2", "chars")], F.sum("n_convs").alias("n_convs"), F.min("owner").alias("owner")
    )
    return chains.unionAll(merged.select(columns))


def subtree_sums(nodes: DataFrame, prefixes: DataFrame, blocks: DataFrame) -> DataFrame:
    """``depth, f1, f2, n_leaves, saved_tokens`` of every node below the root.

    ``nodes`` has each node's own ``leaf`` and ``saved``.
    """
    block = F.floor((F.col("depth") - 1) / BLOCK_TURNS).cast("long")
    own = nodes.groupBy(F.col("owner"), block.alias("k")).agg(
        F.collect_list(F.struct((F.col("depth") - 1 - block * BLOCK_TURNS).cast("int").alias("i"), "leaf", "saved")).alias("own"),
        F.sum("leaf").alias("leaf"),
        F.sum("saved").alias("saved"),
    )
    own = staged(own, "trie-own")
    # what lies deeper than a block, handed up along the owners' paths
    mine = own.select(F.col("owner").alias("conv"), "k", "leaf", "saved")
    paths = blocks.select("conv", "k", "post1", "post2").join(mine.select("conv").distinct(), "conv", "left_semi")
    valued = paths.join(mine, ["conv", "k"], "left").fillna(0, ["leaf", "saved"])
    deeper = _running(staged(valued, "trie-paths"), ["leaf", "saved"], F.sum, ["later_leaf", "later_saved"], last_first=True)
    below = deeper.filter("later_leaf > 0 OR later_saved > 0").groupBy("k", "post1", "post2").agg(F.sum("later_leaf").alias("later_leaf"), F.sum("later_saved").alias("later_saved"))
    met = prefixes.join(own.select("owner", "k", "own"), ["owner", "k"], "left").join(below, ["k", "post1", "post2"], "left")
    under = lambda name, i: F.aggregate(
        F.filter("own", lambda o: o["i"] >= i), F.lit(0).cast("long"), lambda a, o: a + o[name]
    )
    total = lambda name: F.coalesce(under(name, F.col("i")), F.lit(0)) + F.coalesce(f"later_{name}", F.lit(0))
    steps = steps_of(met, "own", "later_leaf", "later_saved")
    return steps.groupBy(*KEY).agg(F.sum(total("leaf")).alias("n_leaves"), F.sum(total("saved")).alias("saved_tokens"))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows ``depth, f1, f2, conv`` to pieces of joined ids."""
    for batch in batches:
        if len(batch):
            key = batch[KEY].to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
            cuts = [c for a, b in zip(edges, [*edges[1:], len(batch)], strict=True) for c in range(a, b, PIECE_IDS)]
            ids = batch["conv"].astype(str).to_numpy()
            out = batch.iloc[cuts].rename(columns={"conv": "first"})
            yield out.assign(ids=[",".join(ids[a:b]) for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True)])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted pieces to one SHA-256 per node, whatever the number of its pieces."""
    at, running, done = None, None, []
    for batch in batches:
        for *key, ids in batch[[*KEY, "ids"]].itertuples(index=False, name=None):
            if key == at:
                running.update(b",")
            else:
                if at is not None:
                    done.append((*at, running.hexdigest()))
                at, running = key, hashlib.sha256()
            running.update(ids.encode())
        yield pd.DataFrame(done, columns=[*KEY, "ends_sha256"])
        done = []
    if at is not None:
        yield pd.DataFrame([(*at, running.hexdigest())], columns=[*KEY, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``depth, f1, f2, ends_sha256`` of ``(depth, f1, f2, conv)``, over ascending ids joined by commas."""
    key = "depth long, f1 long, f2 long"
    spread = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")
    pieces = staged(spread.mapInPandas(_pieces, f"{key}, first long, ids string"), "trie-pieces")
    gathered = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return gathered.mapInPandas(_digests, f"{key}, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the conversations ``convs`` (``conv``) with ``turns`` (``conv, pos, digest, chars``)."""
    n_all, smallest = convs.agg(F.count("*"), F.min("conv")).first()
    blocks = blocks_of(turns)
    prefixes = blocks.groupBy("k", "post1", "post2").agg(
        *[F.first(c).alias(c) for c in ("pre1", "pre2", "n", "turns")], F.count("*").alias("n_convs"), F.min("conv").alias("owner")
    )
    prefixes = staged(prefixes, "trie-distinct")
    found = staged(refined(prefixes), "trie-nodes")
    children = found.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("n_children"))
    valued = found.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    valued = staged(valued.withColumns({"leaf": leaf, "saved": saved}), "trie-valued")

    last = blocks.groupBy("conv").agg(F.max(F.struct("k", "n", "post1", "post2")).alias("end"))
    at = F.col("end.k") * BLOCK_TURNS + F.col("end.n")
    ends = convs.join(last, "conv", "left").select(
        F.coalesce(at, F.lit(0)).alias("depth"), F.coalesce("end.post1", F.lit(0)).alias("f1"), F.coalesce("end.post2", F.lit(0)).alias("f2"), "conv"
    )
    hashes = staged(end_digests(ends), "trie-ends")

    above = valued.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("owner").alias("parent_owner"))
    whole = valued.join(subtree_sums(valued, prefixes, blocks), KEY).join(hashes, KEY, "left")
    columns = ["n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")]
    whole = staged(whole, "trie-whole")
    placed = lambda df, parent: df.select(F.col("owner").alias("conv_id"), "depth", parent.cast("long").alias("parent_conv_id"), *columns)
    outer = placed(whole.filter("depth = 1"), F.lit(smallest))  # the root has the most children: no join for them
    inner = placed(whole.filter("depth > 1").join(above, ["depth", "p1", "p2"]), F.col("parent_owner"))
    first = F.count(F.when(F.col("depth") == 1, 1))
    sums = valued.agg(first.alias("n_children"), F.greatest(F.sum("leaf"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    root = sums.withColumns(
        {"conv_id": F.lit(smallest).cast("long"), "depth": F.lit(0).cast("long"), "f1": F.lit(0).cast("long"), "f2": F.lit(0).cast("long")}
        | {"parent_conv_id": F.lit(None).cast("long"), "n_convs": F.lit(n_all).cast("long")}
    ).join(hashes, KEY, "left")
    top = root.select("conv_id", "depth", "parent_conv_id", *columns).filter("n_convs > 0")
    return top.unionAll(outer).unionAll(inner)


def prefix_trie(conversations: DataFrame, shared_heads: bool = False) -> DataFrame:
    """The trie of ``conversations`` (``conv_id, turn, role, text``), as they are or rebuilt on shared heads."""
    turns = ordered_turns(conversations)
    convs = turns.filter("pos = 0").select("conv")
    return trie(staged(with_shared_heads(turns), "trie-rebuilt") if shared_heads else turns, convs)


_CRC32 = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ord(ch)::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::UBIGINT)),
        lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END))"""

ORACLE = f"""
WITH own AS (SELECT conv_id, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest,
        length(coalesce(text, '')) AS chars, turn FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, digest, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos FROM own),
h AS (SELECT conv_id, conv_id - conv_id % {HEAD_EVERY} AS base, CAST(xor({_CRC32}, 4294967295::UBIGINT) % {HEAD_TURNS} AS BIGINT) AS h
    FROM (SELECT DISTINCT conv_id FROM own)),
parts AS (SELECT h.conv_id, 0 AS part, p.pos, p.digest, p.chars FROM h JOIN placed p ON p.conv_id = h.base AND p.pos < h.h
    UNION ALL SELECT h.conv_id, 1, p.pos, p.digest, p.chars FROM h JOIN placed p ON p.conv_id = h.conv_id AND p.pos >= h.h),
turns AS (SELECT conv_id AS c, chars, digest, row_number() OVER w AS d, count(*) OVER (PARTITION BY conv_id) AS n,
        string_agg(digest, '') OVER (w ROWS UNBOUNDED PRECEDING) AS path FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
members AS (SELECT c, d, path, chars, left(path, length(path) - 32) AS above, n = d AS ends FROM turns
    UNION ALL SELECT conv_id, 0, '', 0, NULL, conv_id NOT IN (SELECT c FROM turns) FROM h),
nodes AS (SELECT d, path, min(c) AS c, count(*) AS n_convs, any_value(chars) AS chars, any_value(above) AS above,
        coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS members FROM members GROUP BY d, path),
kids AS (SELECT d - 1 AS d, above AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
valued AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, (n_convs - 1) * chars AS saved FROM nodes LEFT JOIN kids USING (d, path)),
sums AS (SELECT m.d, m.path, count(*) FILTER (y.n_children = 0) AS n_leaves, sum(y.saved) AS saved_tokens
    FROM valued y JOIN members m ON m.c = y.c AND m.d <= y.d GROUP BY m.d, m.path)
SELECT v.c AS conv_id, CAST(v.d AS BIGINT) AS depth, p.c AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
    sha256(v.members) AS ends_sha256
FROM valued v JOIN sums s USING (d, path) LEFT JOIN valued p ON p.d = v.d - 1 AND p.path = v.above
"""


@query("op12_prefix_trie", ORACLE)
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"), shared_heads=True)

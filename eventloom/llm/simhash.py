"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all fingerprints within half the radius of it. Two
fingerprints within the radius share at least one of these variants, and at most 65 distinct
fingerprints (radius 2) can meet in one, so no bucket grows with the data.

Defined results: null and empty texts have fingerprint zero and link like any other; texts of
fewer than three words hash as one shingle; repeated rows share a fingerprint; a component
whose ids are all null has a null id; an empty table gives no rows; other columns are not
looked at.

``keep_first``, the stage of the pipeline, links texts whose sets of 5-word shingles have a
Jaccard similarity of 0.8 or more. Pairs come from ball hashing of the fingerprints of these
shingles and, as most such pairs lie about 10 bits apart and out of reach of a ball, also from
bands of least hashes; each is verified on the whole sets. Texts of equal words
are one node, null and empty texts too; texts of fewer words than a shingle are one shingle.
Each text of a bucket first meets the one that most buckets share; then all texts of one bucket
that are still in different components meet, however large the bucket is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, components, let, staged, table, words
from .registry import query

SHINGLE = 3
BITS = 64
RADIUS = 2

STAGE_SHINGLE = 5
STAGE_PERCENT = 80
BANDS, BAND_ROWS = 20, 5  # a pair of similarity s shares a band with chance 1 - (1 - s^5)^20
SMALL = 64  # texts of a bucket whose pairs are made in place; those of larger ones are compared in blocks
PART_TEXTS, PART_SHINGLES = 1 << 10, 1 << 18
UNLIKE = 33  # of 100 two-bit hashes; a pair of similarity 0.8 differs in more with chance 4e-6


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of every word shingle, repeats included."""

    def hashes(w: Column) -> Column:
        shingle = lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)]))
        return (
            F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), shingle))
            .when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(words(ascii_lower(text)), hashes)


@F.pandas_udf(T.LongType())
def majority_bits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The number whose bits are set in over half of the hashes of a row; zero without hashes."""
    for batch in batches:
        out = np.zeros(len(batch), dtype=np.int64)
        for i, hashes in enumerate(batch):
            n = len(hashes)
            if n:
                counts = np.zeros(BITS, dtype=np.int64)
                for start in range(0, n, 4096):  # unpacked bits take 64 bytes a hash
                    raw = np.ascontiguousarray(hashes[start : start + 4096], dtype="<i8").view(np.uint8).reshape(-1, 8)
                    counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                out[i] = np.packbits(2 * counts > n, bitorder="little").view("<i8")[0]
        yield pd.Series(out)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` of every row."""
    hashed = docs.select("doc_id", F.explode(F.array(shingle_hashes(F.col("text")))).alias("hashes"))
    return hashed.select("doc_id", majority_bits("hashes").alias("fp"))


def variants(fp: Column) -> Column:
    """All fingerprints within half the radius: the fingerprint and its single-bit flips."""
    flips = [1 << b if b < 63 else -(1 << 63) for b in range(BITS)]
    return F.transform(F.array(*[F.lit(x).cast("long") for x in [0, *flips]]), lambda m: fp.bitwiseXOR(m))


def links(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that join all within the radius.

    Within a variant's bucket all fingerprints lie within the radius of each other, so a star
    from the smallest one keeps their connection; every pair is verified and kept once.
    """
    emitted = distinct.select("fp", F.explode(variants(F.col("fp"))).alias("variant"))
    centre = F.expr("min(fp) OVER (PARTITION BY variant)")
    pairs = emitted.select(centre.alias("a"), F.col("fp").alias("b")).filter("a <> b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; the id is the smallest of the component."""
    prints = staged(fingerprints(docs), "simhash-prints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = staged(components(links(distinct)), "simhash-roots")
    placed = staged(
        distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")),
        "simhash-placed",
    )
    smallest = staged(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-smallest")
    members = staged(placed.join(smallest, "root").select("fp", "component_id"), "simhash-members")
    return prints.join(members, "fp").select("doc_id", "fp", "component_id")


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(10)
    odd, added = rng.integers(0, 1 << 63, (2, BANDS * BAND_ROWS, 1), dtype=np.uint64)
    return 2 * odd + np.uint64(1), added


BAND_TYPE = T.StructType(
    [T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))]
)


@F.pandas_udf(BAND_TYPE)
def band_hashes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Number of different hashes of a row, a hash of the least ones in every band, and two bits of each least one."""
    odd, added = _mixers()
    for batch in batches:
        n, bands, sketches = np.zeros(len(batch), dtype=np.int32), [], []
        for i, hashes in enumerate(batch):
            x = np.unique(np.asarray(hashes, dtype="<i8")).view("<u8")
            n[i] = len(x)
            least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
            for start in range(0, len(x), 512):  # products stay in the cache
                np.minimum(least, (x[None, start : start + 512] * odd + added).min(axis=1), out=least)
            mixed = np.zeros(BANDS, dtype=np.uint64)
            for row in least.reshape(BAND_ROWS, BANDS):
                mixed = (mixed ^ row) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            bands.append(mixed.view("<i8"))
            bits = np.zeros((2, 128), dtype=np.uint8)
            bits[:, : len(least)] = (least & np.uint64(1), (least >> np.uint64(1)) & np.uint64(1))
            sketches.append(np.packbits(bits, axis=1).view("<i8").ravel())
        yield pd.DataFrame({"n": n, "bands": bands, "sketch": sketches})


def with_text_keys(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``key`` and ``check``: two hashes of a text's words."""
    joined = F.concat_ws(" ", words(ascii_lower(F.col(text))))
    return df.withColumn("_w", F.explode(F.array(joined))).withColumns({"key": F.xxhash64("_w"), "check": F.xxhash64(F.lit(1), "_w")}).drop("_w")


def apart(df: DataFrame, collided: DataFrame) -> DataFrame:
    """``key`` made different for texts that only their ``check`` tells apart."""
    other = collided.select(F.col("key").alias("_key"), "first_check")
    met = df.join(other, F.col("key") == F.col("_key"), "left")
    mine = F.when(F.col("first_check").isNotNull() & (F.col("check") != F.col("first_check")), F.col("check")).otherwise(F.col("key"))
    return met.withColumn("key", mine).drop("_key", "first_check", "check")


def fits(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches of two members (structs) allow the similarity."""
    n, sketch = (lambda x: F.col(f"{x}.n").cast("long")), (lambda x, i: F.col(f"{x}.sketch")[i])
    unlike = sum(
        (F.bit_count(sketch(a, i).bitwiseXOR(sketch(b, i)).bitwiseOR(sketch(a, i + 2).bitwiseXOR(sketch(b, i + 2)))) for i in (0, 1)), F.lit(0)
    )
    return (100 * F.least(n(a), n(b)) >= percent * F.greatest(n(a), n(b))) & (unlike <= UNLIKE)


MEMBER = ["key", "n", "sketch", "root"]


def _pairs(met: DataFrame, percent: int) -> DataFrame:
    """Distinct ``(a, b)`` of members ``x`` and ``y`` of different components that may be similar."""
    likely = met.filter((F.col("x.root") != F.col("y.root")) & fits("x", "y", percent))
    return likely.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def starred(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of each member of a group with the member of the most company."""
    leader = rows.groupBy(F.col("group").alias("_g")).agg(F.max_by(F.struct(*MEMBER), F.struct("company", "key")).alias("x"))
    return _pairs(rows.select("group", F.struct(*MEMBER).alias("y")).join(leader, F.col("group") == F.col("_g")), percent)


def crossed(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of all members of groups of at most ``SMALL``."""
    listed = rows.groupBy("group").agg(F.collect_list(F.struct(*MEMBER)).alias("m"))
    each = listed.select("m", F.posexplode("m").alias("at", "x"))
    both = each.select("x", F.explode(F.expr("slice(m, at + 2, size(m))")).alias("y"))
    return _pairs(both, percent)


def open_groups(rows: DataFrame) -> DataFrame:
    """The groups that hold more than one component, with their numbers of rows and of shingles."""
    total = F.sum(F.col("n").cast("long")).alias("total")
    sizes = rows.groupBy("group").agg(F.count("*").alias("rows"), total, F.min("root").alias("low"), F.max("root").alias("high"))
    return sizes.filter("low <> high").select("group", "rows", "total")


def crossed_wide(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between similar members of groups of any size: all members of different components meet.

    A group falls into parts of about ``PART_TEXTS`` texts or ``PART_SHINGLES`` shingles, and a task compares two
    parts and verifies their pairs in place. So the memory of a task is bounded and only similar pairs are stored;
    the number of comparisons is the square of the group's size.
    """
    parts = F.ceil(F.greatest(F.col("rows") / PART_TEXTS, F.col("total") / PART_SHINGLES)).cast("int")
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    dealt = rows.select("group", *MEMBER, parts.alias("parts")).withColumn("part", part).join(sets, "key")
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    each = each.select("group", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", *MEMBER, "shingles")
    ends = [each.filter(F.col("part") == F.col(end)).select("group", "low", "high", F.struct(*MEMBER, "shingles").alias(x)) for end, x in (("low", "x"), ("high", "y"))]
    # in blocks of one part a pair comes twice; the planner's estimate leaves out the copies, so the sides are merged
    met = ends[0].hint("merge").join(ends[1], ["group", "low", "high"])
    likely = (F.col("x.root") != F.col("y.root")) & ((F.col("low") != F.col("high")) | (F.col("x.key") < F.col("y.key"))) & fits("x", "y", percent)
    shared = F.size(F.array_intersect("x.shingles", "y.shingles")).cast("long")
    alike = (100 + percent) * shared >= percent * (F.size("x.shingles") + F.size("y.shingles"))
    return met.filter(likely & alike).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets of shingles have a Jaccard similarity of ``percent`` or more."""
    a = sets.select(F.col("key").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("key").alias("b"), F.col("shingles").alias("of_b"))
    met = pairs.select("a", "b").join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    return met.filter((100 + percent) * shared >= percent * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def ball_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of keys whose fingerprints ``fp`` lie within the radius: a star in each fingerprint, links between their centres."""
    centres = staged(nodes.groupBy("fp").agg(F.min("key").alias("centre")), "near-centres")
    same = nodes.join(centres, "fp").filter("key <> centre").select(F.col("centre").alias("a"), F.col("key").alias("b"))
    near = links(centres)
    for end in ("a", "b"):
        near = near.join(centres.select(F.col("fp").alias(end), F.col("centre").alias(f"_{end}")), end)
    return same.unionAll(near.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))).distinct()


def similar_roots(texts: DataFrame, prints: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``(node, root)`` of the keys in ``prints`` that have a similar one.

    ``texts`` (``key, text``) and ``prints`` (``key, n, fp, bands, sketch``) may repeat keys.
    """
    nodes = staged(prints.filter("n > 0").select("key", "n", "fp", "bands", "sketch").dropDuplicates(["key"]), "near-nodes")
    balls = staged(ball_pairs(nodes.select("key", "fp")), "near-balls")
    cells = nodes.select("key", F.posexplode("bands").alias("band", "bucket"))
    cells = cells.select("key", "band", F.xxhash64("band", "bucket").alias("group"))
    shared = cells.groupBy("group").agg(F.count("*").alias("rows")).filter("rows > 1")
    cells = staged(cells.join(shared, "group"), "near-cells")
    company = cells.groupBy("key").agg(F.sum("rows").alias("company"))
    members = staged(nodes.drop("bands", "fp").join(company, "key"), "near-members")
    met = members.select("key").unionAll(balls.select("a")).unionAll(balls.select("b")).distinct()
    once = texts.join(met, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    sets = staged(once.select("key", F.array_distinct(shingle_hashes(F.col("text"), shingle)).alias("shingles")), "near-sets")

    alone = cells.join(members, "key").withColumn("root", F.col("key"))
    first = staged(starred(alone, percent).unionAll(balls).distinct(), "near-pairs")
    found = staged(verified(first, sets, percent), "near-links")
    roots = staged(components(found), "near-roots")
    placed = members.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node")
    rows = cells.drop("rows").join(placed, "key")
    rows = staged(rows.join(staged(open_groups(rows), "near-open"), "group"), "near-rows")
    fresh = staged(crossed(rows.filter(F.col("rows") <= SMALL), percent), "near-pairs")
    more = verified(fresh, sets, percent).unionAll(crossed_wide(rows.filter(F.col("rows") > SMALL), sets, percent))
    more = staged(more, "near-links")
    return roots if more.isEmpty() else staged(components(found.unionAll(more)), "near-roots")


def keep_first(docs: DataFrame, shingle: int = STAGE_SHINGLE, percent: int = STAGE_PERCENT) -> DataFrame:
    """``docs`` with one row of each component of similar texts: a row of its smallest id.

    A row is found by its id and words, so rows that share an id, or have none, are told apart.
    A row of a null id stays only where a whole component has no id; of rows equal in id and
    words the one of the smallest hash of all its columns stays.
    """
    hashed = with_text_keys(docs.select("doc_id", "text")).select(
        "doc_id", "key", "check", F.explode(F.array(shingle_hashes(F.col("text"), shingle))).alias("hashes")
    )
    made = staged(hashed.select("doc_id", "key", "check", majority_bits("hashes").alias("fp"), band_hashes("hashes").alias("x")).select("doc_id", "key", "check", "fp", "x.*"), "near-prints")
    checks = made.groupBy("key").agg(F.min("check").alias("first_check"), F.max("check").alias("last"))
    collided = staged(checks.filter("first_check <> last").drop("last"), "near-collided")
    prints = apart(made, collided)
    texts = apart(with_text_keys(docs.select("text")), collided)
    roots = similar_roots(texts, prints, shingle, percent)
    smallest = prints.groupBy("key").agg(F.min("doc_id").alias("id"))
    placed = smallest.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    best = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("best")
    chosen = staged(placed.groupBy("root").agg(best).selectExpr("best.id AS leader", "best.key AS leader_key"), "near-leaders")
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("whole_text"), F.xxhash64("*").alias("pick"))
    whole = apart(with_text_keys(whole, "whole_text").drop("whole_text"), collided)
    leads = (F.col("key") == F.col("leader_key")) & F.col("id").eqNullSafe(F.col("leader"))
    once = whole.join(chosen, leads, "left_semi").groupBy("key").agg(F.min_by("row", "pick").alias("row"))
    return once.select("row.*")


@query("op10_simhash")
def op10_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", text.alias("fingerprint"), "component_id")

"""Quality rules whose thresholds adapt to language and source.

Counts per document are DataFrame expressions within one row. Each ratio goes into a
mergeable quantile sketch per (lang, source): a histogram whose bins have a relative width
of at most 1/32, so that merging sketches is adding counts and a quantile is off by no more
than a bin. A document is rejected when a ratio lies beyond the outer fence of its group.

Defined results: null or empty text has no words (``base_failed``); null ``lang`` or ``source``
is a group of its own; groups below ``min_group`` rows use their language's merged sketch, then
that of all rows; repeated rows are judged one by one; an empty table gives no rows; other
columns of the input are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, let, staged, table, words
from .registry import query

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# ratio -> (scaled numerator, denominator, smallest spread, two-sided); scaled by 10,000
RATIOS = {
    "symbols": ("n_symbols", "n_words", 100, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, False),
    "repeats": ("n_repeat_words", "n_words", 1000, False),
    "word_length": ("word_chars", "n_words", 2500, True),
}
SCALE = 10_000
FENCE = 4  # spreads beyond the quartiles
MIN_GROUP = 100


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in ``w``.

    Half of a hash and the place sort as one number; only windows whose halves meet are
    compared as text.
    """
    half = lambda x: F.shiftright(x, 32)
    place = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, j: (F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"]))
        return let(
            F.sort_array(F.transform(again, lambda x: x["p"])),
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(3), F.get(p, j + 1) - x)), F.lit(0), lambda a, x: a + x
            ),
        )

    def compared(s: Column) -> Column:
        near = F.filter(s, lambda x, j: (half(F.get(s, j - 1)) == half(x)) | (half(F.get(s, j + 1)) == half(x)))
        texts = F.transform(
            F.transform(near, place),
            lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("k"), i.alias("p")),
        )
        return let(F.sort_array(texts), covered)

    hashed = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 32).bitwiseOR(i.cast("long")),
    )
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(F.sort_array(hashed), compared)).cast("long")


def _line_counts(text: Column) -> Column:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        lines,
        lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")),
    )


def measures(text: Column) -> Column:
    """A struct of the counts of one text."""
    text = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))

    bare = F.regexp_replace(text, WORD_GAP, "")
    return F.struct(
        let(words(text), of).alias("words"),
        _line_counts(text).alias("lines"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` with the counts and ``base_failed``."""
    # a generator's output is not copied into the expressions above it
    rows = docs.select(*keep, F.explode(F.array(measures(F.col("text")))).alias("measure"))
    counts = rows.select(
        *keep,
        F.col("measure.words.n_words").alias("n_words"),
        F.col("measure.word_chars").alias("word_chars"),
        F.col("measure.n_symbols").alias("n_symbols"),
        F.col("measure.lines.again").cast("long").alias("n_dup_lines"),
        F.col("measure.words.n_repeat_words").alias("n_repeat_words"),
        F.col("measure.lines.all").cast("long").alias("n_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return counts.withColumn("base_failed", failed)


def ratio(name: str) -> Column:
    over, under, _, _ = RATIOS[name]
    return F.expr(f"CASE WHEN {under} > 0 THEN {over} * {SCALE} DIV {under} ELSE 0L END")


def sketch(counts: DataFrame) -> DataFrame:
    """Quantile sketches ``(lang, source, ratio, bin, n)`` of the rows that pass the base rules."""
    pairs = F.array(*[F.struct(F.lit(r).alias("ratio"), ratio(r).alias("value")) for r in RATIOS])
    long = counts.filter("NOT base_failed").select("lang", "source", F.explode(pairs).alias("x"))
    shift = "greatest(length(bin(x.value)) - 6, 0)"
    return long.groupBy(
        "lang", "source", F.col("x.ratio").alias("ratio"), F.expr(f"{shift} * 64L + shiftright(x.value, {shift})").alias("bin")
    ).agg(F.count("*").alias("n"))


def merged(*sketches: DataFrame) -> DataFrame:
    """The sketch of all rows of several sketches."""
    return reduce(DataFrame.union, sketches).groupBy("lang", "source", "ratio", "bin").agg(F.sum("n").alias("n"))


def quartiles(histogram: DataFrame, *group: str) -> DataFrame:
    """Per group and ratio: rows, and the lower edges of the bins of both quartiles.

    A group has a few hundred bins at most, whatever its number of rows.
    """
    bins = histogram.groupBy(*group, "ratio", "bin").agg(F.sum("n").alias("n"))
    lists = bins.groupBy(*group, "ratio").agg(
        F.sum("n").alias("rows"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins")
    )

    def at(percent: int) -> Column:
        found = F.aggregate(
            "bins",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin")),
            lambda a, x: F.struct(
                (a["seen"] + x["n"]).alias("seen"),
                F.coalesce(a["bin"], F.when(100 * (a["seen"] + x["n"]) >= percent * F.col("rows"), x["bin"])).alias("bin"),
            ),
        )["bin"]
        return found

    edges = lists.select(*group, "ratio", "rows", at(25).alias("b25"), at(75).alias("b75"))
    edge = "shiftleft({0} % 64, CAST({0} DIV 64 AS INT))"
    return edges.select(
        *group, "ratio", "rows", F.expr(edge.format("b25")).alias("q25"), F.expr(edge.format("b75")).alias("q75")
    )


def thresholds(histogram: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source) with the lowest and highest accepted value of every ratio."""
    own = quartiles(histogram, "lang", "source")
    language = quartiles(histogram, "lang")
    every = quartiles(histogram)
    spread = F.create_map(*[F.lit(x) for r, (_, _, least, _) in RATIOS.items() for x in (r, least)])
    two_sided = [r for r, x in RATIOS.items() if x[3]]

    def named(df: DataFrame, tag: str) -> DataFrame:
        q25, q75 = F.col("q25"), F.col("q75")
        width = F.greatest(q75 - q25, spread[F.col("ratio")].cast("long"))
        fence = F.struct(
            F.when(F.col("ratio").isin(two_sided), q25 - FENCE * width).alias("low"), (q75 + FENCE * width).alias("high")
        )
        return df.withColumn(tag, F.struct("rows", fence.alias("fence"))).drop("rows", "q25", "q75")

    o, la, e = named(own, "own").alias("o"), named(language, "language").alias("l"), named(every, "every").alias("e")
    joined = o.join(la, F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.ratio") == F.col("l.ratio"))).join(
        e, F.col("o.ratio") == F.col("e.ratio")
    )
    chosen = (
        F.when(F.col("own.rows") >= min_group, F.col("own.fence"))
        .when(F.col("language.rows") >= min_group, F.col("language.fence"))
        .otherwise(F.col("every.fence"))
    )
    return (
        joined.select(F.col("o.lang").alias("lang"), F.col("o.source").alias("source"), F.col("o.ratio").alias("ratio"), chosen.alias("fence"))
        .groupBy("lang", "source")
        .agg(*[F.max(F.when(F.col("ratio") == r, F.col("fence"))).alias(f"fence_{r}") for r in RATIOS])
    )


def judged(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """``counts`` with ``kept``. ``limits`` is a table on disk: Spark broadcasts it while its
    size is below the broadcast threshold and joins by shuffle, with skew splitting, beyond it."""
    renamed = limits.withColumnsRenamed({"lang": "limit_lang", "source": "limit_source"})
    joined = counts.join(
        renamed,
        F.col("lang").eqNullSafe(F.col("limit_lang")) & F.col("source").eqNullSafe(F.col("limit_source")),
        "left",
    )
    inside = [
        F.coalesce(ratio(r) <= F.col(f"fence_{r}.high"), F.lit(True))
        & F.coalesce(ratio(r) >= F.col(f"fence_{r}.low"), F.lit(True))
        for r in RATIOS
    ]
    kept = reduce(lambda a, b: a & b, inside, ~F.col("base_failed"))
    return joined.withColumn("kept", kept).drop(*renamed.columns)


def apply_rules(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every row: ``doc_id, lang, source``, counts, ``base_failed``, ``kept``."""
    counts = staged(measured(docs, "doc_id", "lang", "source"), "quality-counts")
    return judged(counts, staged(thresholds(sketch(counts)), "quality-limits"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules accept. Texts are read twice but never shuffled."""
    limits = staged(thresholds(sketch(measured(docs, "lang", "source"))), "quality-limits")
    whole = docs.select(F.struct("*").alias("row"), "text", "lang", "source")
    return judged(measured(whole, "row", "lang", "source"), limits).filter("kept").select("row.*")


COUNTS_SQL = r"""
base AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
word AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM base),
win AS (SELECT r, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM word WINDOW o AS (PARTITION BY r ORDER BY i)),
dup AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM win WHERE w3 IS NOT NULL),
hit AS (SELECT DISTINCT r, i + k AS i FROM dup, (VALUES (0), (1), (2)) v(k) WHERE n > 1),
rep AS (SELECT r, count(*) AS n_repeat_words FROM hit GROUP BY r),
line AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM base),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM line
          WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
counts0 AS (SELECT doc_id, lang, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
  FROM base LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
counts AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts0)
"""

ORACLE = f"""
WITH {COUNTS_SQL},
ratios AS (SELECT *, CASE WHEN n_words > 0 THEN n_symbols * 10000 // n_words ELSE 0 END AS v1,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 10000 // n_lines ELSE 0 END AS v2,
    CASE WHEN n_words > 0 THEN n_repeat_words * 10000 // n_words ELSE 0 END AS v3,
    CASE WHEN n_words > 0 THEN word_chars * 10000 // n_words ELSE 0 END AS v4 FROM counts),
vals AS (SELECT lang, source, k, CASE k WHEN 1 THEN v1 WHEN 2 THEN v2 WHEN 3 THEN v3 ELSE v4 END AS v
    FROM ratios, (VALUES (1), (2), (3), (4)) t(k) WHERE NOT base_failed),
edge AS (SELECT lang, source, k, v, greatest(length(bin(v)) - 6, 0) AS e FROM vals),
low AS (SELECT lang, source, k, (v >> e) << e AS v FROM edge),
q0 AS (SELECT lang, source, k, count(*) AS n, quantile_disc(v, 0.25) AS a, quantile_disc(v, 0.75) AS b FROM low GROUP BY ALL),
q1 AS (SELECT lang, k, count(*) AS n, quantile_disc(v, 0.25) AS a, quantile_disc(v, 0.75) AS b FROM low GROUP BY ALL),
q2 AS (SELECT k, quantile_disc(v, 0.25) AS a, quantile_disc(v, 0.75) AS b FROM low GROUP BY ALL),
pick AS (SELECT q0.lang, q0.source, q0.k,
    CASE WHEN q0.n >= 100 THEN q0.a WHEN q1.n >= 100 THEN q1.a ELSE q2.a END AS a,
    CASE WHEN q0.n >= 100 THEN q0.b WHEN q1.n >= 100 THEN q1.b ELSE q2.b END AS b,
    CASE q0.k WHEN 1 THEN 100 WHEN 2 THEN 1000 WHEN 3 THEN 1000 ELSE 2500 END AS s
  FROM q0 JOIN q1 ON q0.lang IS NOT DISTINCT FROM q1.lang AND q0.k = q1.k JOIN q2 ON q0.k = q2.k),
fence AS (SELECT lang, source, k, CASE WHEN k = 4 THEN a - 4 * greatest(b - a, s) END AS lo, b + 4 * greatest(b - a, s) AS hi FROM pick),
fences AS (SELECT lang, source, max(hi) FILTER (k = 1) AS h1, max(hi) FILTER (k = 2) AS h2, max(hi) FILTER (k = 3) AS h3,
    max(hi) FILTER (k = 4) AS h4, max(lo) FILTER (k = 4) AS l4 FROM fence GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND coalesce(v1 <= h1, true) AND coalesce(v2 <= h2, true) AND coalesce(v3 <= h3, true)
    AND coalesce(v4 <= h4, true) AND coalesce(v4 >= l4, true) AS kept
FROM ratios r LEFT JOIN fences f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
"""


@query("op8_quality_rules", ORACLE)
def op8_quality_rules(spark, sf_dir):
    return apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )

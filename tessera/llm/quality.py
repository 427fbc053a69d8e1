"""Quality rules with thresholds adapted to each language and source.

Four ratios of every text, and its numbers of words and lines, go into mergeable
quantile sketches, one per language and source.  A sketch counts values in buckets
of constant relative width (as DDSketch does, Masson et al. 2019): sketches merge by
adding counts, so partial aggregation builds them in any order with the same result,
and a quantile has a relative error of at most 1 %.

Every group's sketch is shrunk towards those of its language and of all documents,
which are merged into it with the weight of ``PRIOR`` and a tenth of ``PRIOR``
documents.  A ratio's fence lies ``FENCE`` interquartile ranges beyond the quartiles
of its group.  Where most texts have a rate of zero the range says nothing; it is
taken as at least ``EVENTS`` occurrences in a short text of the group, one at the
first quartile of length, so these fences follow the group's lengths.  A text is
rejected beyond a fence, or if it fails the base rules.  DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._storage import materialize
from ._text import WHITE, free_prefix, let, without, words

SYMBOLS = "#*$%&|<>"
ERROR = 0.01  # relative error of a sketch's quantiles
GAMMA = (1 + ERROR) / (1 - ERROR)
PRIOR = 200  # documents that the sketch of the language counts as in each of its groups
PART = 1000  # sketches are merged in whole thousandths of a document
FENCE = 5.0  # widths beyond the quartiles
ZERO = -100_000  # the bucket of zero
#: Rates, with what they are counted by, and the occurrences in a short text that make the least width (one repeated window has six words).
EVENTS = {"symbol_rate": ("n_words", 3), "dup_line_rate": ("n_lines", 1), "repeat_rate": ("n_words", 6)}
RATIOS = ("word_length", *EVENTS)
LENGTHS = ("n_words", "n_lines")


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found at least twice."""
    grams = F.transform(
        F.when(F.size(w) > 2, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )

    def starts(s: Column) -> Column:
        same = lambda x, other: F.coalesce(x["h"] == F.get(s, other)["h"], F.lit(False))
        return F.filter(s, lambda x, j: (same(x, j - 1) & (j > 0)) | same(x, j + 1))

    # a window at i after one at p adds min(3, i - p) words
    return F.aggregate(
        F.sort_array(F.transform(let(F.sort_array(grams), starts), lambda x: x["i"])),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"].cast("long"),
    )


def _lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    worded = F.filter(lines, lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    return let(
        worded,
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )


def text_counts(text: Column) -> Column:
    """A struct of counts of a whole text; of a null text, those of an empty one."""
    by_word = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    return F.struct(
        by_word.alias("w"),
        _lines(text).alias("l"),
        F.length(without(text, WHITE)).cast("long").alias("word_chars"),
        (F.length(F.coalesce(text, F.lit(""))) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
    )


def with_counts(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with its counts and ``base_failed``, each under ``prefix`` + name; columns of ``docs`` with these names are replaced."""
    c = free_prefix(docs.columns, "_counts_")
    n, repeat = F.col(c)["w"]["n_words"], F.col(c)["w"]["n_repeat_words"]
    new = {
        "n_words": n,
        "word_chars": F.col(c)["word_chars"],
        "n_symbols": F.col(c)["n_symbols"],
        "n_lines": F.col(c)["l"]["n_lines"],
        "n_dup_lines": F.col(c)["l"]["n_dup_lines"],
        "n_repeat_words": repeat,
        "base_failed": (n < 50) | (100 * repeat > 50 * n),
    }
    kept = [x for x in docs.columns if x.lower() not in {f"{prefix}{k}".lower() for k in new}]
    return docs.withColumn(c, text_counts(F.col(text_col))).select(*kept, *[v.alias(f"{prefix}{k}") for k, v in new.items()])


def _ratio(name: str, prefix: str) -> Column:
    top, below = {
        "word_length": ("word_chars", "n_words"),
        "symbol_rate": ("n_symbols", "n_words"),
        "dup_line_rate": ("n_dup_lines", "n_lines"),
        "repeat_rate": ("n_repeat_words", "n_words"),
    }[name]
    return F.col(prefix + top).cast("double") / F.greatest(F.col(prefix + below), F.lit(1)).cast("double")


def ratio_sketches(counted: DataFrame, lang_col: str, source_col: str, prefix: str = "") -> DataFrame:
    """``lang, source, ratio, bucket, n``: a mergeable sketch per group, of documents that pass the base rules.

    Bucket b holds values in (GAMMA^(b-1), GAMMA^b]; zero has a bucket of its own.
    """
    found = {r: _ratio(r, prefix) for r in RATIOS} | {x: F.col(prefix + x).cast("double") for x in LENGTHS}
    values = F.array(*[F.struct(F.lit(r).alias("ratio"), x.alias("x")) for r, x in found.items()])
    bucket = F.when(F.col("v.x") > 0, F.ceil(F.log(F.col("v.x")) / F.lit(math.log(GAMMA)))).otherwise(ZERO).cast("int")
    return (
        counted.where(~F.col(f"{prefix}base_failed"))
        .select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.explode(values).alias("v"))
        .groupBy("lang", "source", F.col("v.ratio").alias("ratio"), bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def shrunk(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The sketch of each group with those of its language and of all documents merged in; ``n`` in parts of a document."""
    own = sketch.select("lang", "source", "ratio", "bucket", (F.col("n") * PART).alias("n"))
    groups = sketch.select("lang", "source", "ratio").distinct()

    def merged_in(by: list[str], documents: int) -> DataFrame:
        sums = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
        whole = F.sum("n").over(Window.partitionBy(*by))  # a row for each bucket
        share = sums.withColumn("_n", F.floor(F.lit(PART * documents) * F.col("n") / whole)).select(*[F.col(c).alias(f"_{c}") for c in by], "bucket", "_n")
        same = F.lit(True)
        for c in by:
            same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        return groups.join(share, same).select("lang", "source", "ratio", "bucket", F.col("_n").alias("n"))

    everything = own.unionByName(merged_in(["lang", "ratio"], prior)).unionByName(merged_in(["ratio"], prior // 10))
    return everything.groupBy("lang", "source", "ratio", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame) -> DataFrame:
    """``lang, source, ratio, q1, q2, q3`` of each group's sketch."""
    over = Window.partitionBy("lang", "source", "ratio")
    ranked = sketch.withColumn("total", F.sum("n").over(over)).withColumn("upto", F.sum("n").over(over.orderBy("bucket")))
    middle = F.when(F.col("bucket") == ZERO, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    quartile = lambda q: F.min(F.when(F.col("upto") > F.floor(q * (F.col("total") - 1)), F.struct("bucket", middle.alias("x"))))["x"]
    return ranked.groupBy("lang", "source", "ratio").agg(*[quartile(k / 4).alias(f"q{k}") for k in (1, 2, 3)])


def fences(sketch: DataFrame, prior: int = PRIOR, widths: float = FENCE) -> DataFrame:
    """``lang, source``, and ``lo_, hi_`` of each ratio."""
    q = quartiles(shrunk(sketch, prior))
    wide = q.groupBy("lang", "source").agg(*[F.max(F.when(F.col("ratio") == r, F.col(f"q{k}"))).alias(f"{r}_{k}") for r in (*RATIOS, *LENGTHS) for k in (1, 2, 3)])
    # a median is known to 2 * ERROR of itself
    least = {"word_length": 2 * ERROR * F.col("word_length_2")} | {r: F.lit(float(n)) / F.col(f"{by}_1") for r, (by, n) in EVENTS.items()}
    width = {r: widths * F.greatest(F.col(f"{r}_3") - F.col(f"{r}_1"), least[r]) for r in RATIOS}
    return wide.select(
        "lang", "source", *[(F.col(f"{r}_1") - width[r]).alias(f"lo_{r}") for r in RATIOS], *[(F.col(f"{r}_3") + width[r]).alias(f"hi_{r}") for r in RATIOS]
    )


def judge(counted: DataFrame, lang_col: str = "lang", source_col: str = "source", prefix: str = "", prior: int = PRIOR) -> DataFrame:
    """Add ``prefix`` + ``kept``: false where base rules fail or a ratio lies beyond its group's fence.

    ``counted`` should be a stored table: it is read for the sketches and again for the verdicts.
    Nulls are a language and a source of their own.  In a group without sketch all have failed the base rules.
    """
    limits = fences(ratio_sketches(counted, lang_col, source_col, prefix), prior)
    f = free_prefix(counted.columns, "_fence_")
    limits = limits.select(*[F.col(c).alias(f"{f}{c}") for c in limits.columns])
    same = F.col(lang_col).eqNullSafe(F.col(f"{f}lang")) & F.col(source_col).eqNullSafe(F.col(f"{f}source"))
    inside = F.lit(True)
    for r in RATIOS:
        inside &= _ratio(r, prefix).between(F.col(f"{f}lo_{r}"), F.col(f"{f}hi_{r}"))
    joined = counted.join(limits, same, "left")
    return joined.select(*counted.columns, (~F.col(f"{prefix}base_failed") & F.coalesce(inside, F.lit(False))).alias(f"{prefix}kept"))


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged.

    A null text counts as empty and fails the base rules, as every text of fewer than 50 words does.
    Null languages and sources are groups of their own.  Repeated rows are judged alike and all stay
    or go.  Values at a fence are inside it.  An empty table gives an empty one.
    """
    p = free_prefix(docs.columns, "_quality_")
    counted = materialize(with_counts(docs, text_col, p), "quality-counts")
    return judge(counted, lang_col, source_col, p).where(F.col(f"{p}kept")).select(*docs.columns)


def op9_query(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    counted = materialize(with_counts(docs).drop("text"), "quality-counts")
    return judge(counted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


#: The same rows in DuckDB.
SQL = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM
    (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, sum(least(3, coalesce(step, 3))) AS n FROM r GROUP BY doc_id),
c AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CAST(word_chars AS DOUBLE) / greatest(n_words, 1) AS word_length, CAST(n_symbols AS DOUBLE) / greatest(n_words, 1) AS symbol_rate,
    CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1) AS dup_line_rate, CAST(n_repeat_words AS DOUBLE) / greatest(n_words, 1) AS repeat_rate FROM c),
u AS (SELECT *, CAST(n_words AS DOUBLE) AS words_x, CAST(n_lines AS DOUBLE) AS lines_x FROM f WHERE NOT base_failed),
v AS (SELECT lang, source, CASE ratio WHEN 'words_x' THEN 'n_words' WHEN 'lines_x' THEN 'n_lines' ELSE ratio END AS ratio, x FROM u UNPIVOT (x FOR ratio IN ({', '.join(RATIOS)}, words_x, lines_x))),
s AS (SELECT lang, source, ratio, CASE WHEN x > 0 THEN CAST(ceil(ln(x) / {math.log(GAMMA)!r}) AS INT) ELSE {ZERO} END AS bucket, count(*) AS n FROM v GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source, ratio FROM s),
sl AS (SELECT lang, ratio, bucket, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang, ratio) AS whole FROM s GROUP BY lang, ratio, bucket),
sa AS (SELECT ratio, bucket, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY ratio) AS whole FROM s GROUP BY ratio, bucket),
m AS (SELECT lang, source, ratio, bucket, sum(n) AS n FROM (SELECT lang, source, ratio, bucket, n * {PART} AS n FROM s
    UNION ALL SELECT g.lang, g.source, g.ratio, bucket, floor({PART * PRIOR} * n / CAST(whole AS DOUBLE)) FROM groups g JOIN sl ON sl.lang IS NOT DISTINCT FROM g.lang AND sl.ratio = g.ratio
    UNION ALL SELECT g.lang, g.source, g.ratio, bucket, floor({PART * (PRIOR // 10)} * n / CAST(whole AS DOUBLE)) FROM groups g JOIN sa ON sa.ratio = g.ratio) GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, ratio) AS total, sum(n) OVER (PARTITION BY lang, source, ratio ORDER BY bucket) AS upto,
    CASE WHEN bucket = {ZERO} THEN 0.0 ELSE 2 * pow({GAMMA!r}::DOUBLE, bucket) / ({GAMMA!r}::DOUBLE + 1) END AS x FROM m),
q AS (SELECT lang, source, ratio, {', '.join(f"min(CASE WHEN upto > floor({i / 4} * (total - 1)) THEN x END) AS q{i}" for i in (1, 2, 3))} FROM k GROUP BY ALL),
h AS (SELECT q.lang, q.source, q.ratio, q1 AS a, q3 AS b, {FENCE} * greatest(q3 - q1, CASE q.ratio WHEN 'word_length' THEN {2 * ERROR} * q2
    {' '.join(f"WHEN '{r}' THEN {float(n)} / (SELECT o.q1 FROM q o WHERE o.ratio = '{by}' AND o.lang IS NOT DISTINCT FROM q.lang AND o.source IS NOT DISTINCT FROM q.source)" for r, (by, n) in EVENTS.items())} END) AS width
    FROM q WHERE q.ratio NOT IN ('n_words', 'n_lines')),
o AS (SELECT f.doc_id, bool_and(y.x BETWEEN h.a - h.width AND h.b + h.width) AS inside
    FROM f JOIN (SELECT doc_id, ratio, x FROM f UNPIVOT (x FOR ratio IN ({', '.join(RATIOS)}))) y USING (doc_id)
    JOIN h ON h.lang IS NOT DISTINCT FROM f.lang AND h.source IS NOT DISTINCT FROM f.source AND h.ratio = y.ratio GROUP BY f.doc_id)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, false) AS kept
FROM f LEFT JOIN o USING (doc_id)
"""

"""License scan by diagonal voting.  DataFrame operations only.

The hashes of all rolling word k-grams of the documents are joined to the
positions of the k-grams in license templates.  A match votes for its diagonal,
the document position less the template position: the words of a copied passage
all vote for one diagonal.  Votes are summed by diagonal, and where a document
position has several votes, as in a template that repeats itself, the one on the
strongest diagonal stays.  Along the document, a run then goes on from diagonal to
diagonal (words put in or left out move a passage to another one) as long as it
goes forward in the template with gaps of at most the template's length: that
merges neighbouring diagonals, and a notice that begins again begins a new run.
The spans that result are verified: k-grams word by word, and the span's share of
the template.

Short phrases are templates with k = 2; a diagonal with all its votes is a place
where the phrase's words stand consecutively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._storage import materialize
from ._text import ascii_lower, let

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before lower-casing, for counts
K = 5
MIN_SHARE = 0.5  # of a template's k-grams that a span must hold

#: Phrases whose places are counted, with their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices as their licenses publish them, with a label each (fixed values).
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("warranty-disclaimer", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]


def template_grams() -> list[tuple[int, str, bool, int, int, int, list[str]]]:
    """(template, label, is a phrase, its k-grams, k, position, words) of every k-gram of every template."""
    import re

    out = []
    texts = [(label, phrase, True, 2) for phrase, label in PHRASES.items()] + [(label, text, False, K) for label, text in NOTICES]
    for t, (label, text, phrase, k) in enumerate(texts):
        w = re.findall(r"[0-9a-z]+", text.lower())
        out += [(t, label, phrase, len(w) - k + 1, k, i, w[i : i + k]) for i in range(len(w) - k + 1)]
    return out


def _templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(template_grams(), "template int, label string, phrase boolean, grams int, k int, t_pos int, t_words array<string>")
    one = [F.xxhash64(F.get("t_words", F.lit(i))) for i in range(K)]
    return rows.withColumn("h", F.when(F.col("k") == 2, F.xxhash64(F.lit(2), *one[:2])).otherwise(F.xxhash64(F.lit(K), *one)))


def _words(text: Column) -> Column:
    """The lower-cased words of a text; of a text without a word, one empty string.

    Two capital letters outside A-Z have an ASCII letter as their lower case; texts that hold one of
    them are lowered by a table instead.
    """
    odd = text.contains("\u0130") | text.contains("\u212a")
    low = F.when(odd, ascii_lower(text)).otherwise(F.lower(text))
    return F.split(F.trim(F.regexp_replace(low, NO_WORD, " ")), " ")


def _rolling(h: Column) -> Column:
    """The hashes of all 2-grams, one for each word, then those of all K-grams; the last ones, cut short, match nothing."""
    gram = lambda k: F.transform(h, lambda x, i: F.xxhash64(F.lit(k), x, *[F.get(h, i + j) for j in range(1, k)]))
    return F.concat(gram(2), gram(K))


def votes(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row for each k-gram of a document at each template position with the same words: ``keys, template, label, phrase, grams, k, t_pos, pos``."""
    split = docs.where(F.col(text_col).isNotNull()).select(*keys, _words(F.col(text_col)).alias("_w"))
    hashed = split.select(*keys, "_w", let(F.transform("_w", lambda x: F.xxhash64(x)), _rolling).alias("_g"))
    # an outer generator: for an inner one the optimiser adds a filter that evaluates the hashes twice
    grams = hashed.select(*keys, "_w", F.posexplode_outer("_g").alias("_at", "h"))
    # the templates are a constant of this module: some hundred rows
    hit = grams.join(F.broadcast(_templates(docs.sparkSession).withColumnRenamed("h", "_h")), F.col("h") == F.col("_h"))
    pos = F.when(F.col("k") == 2, F.col("_at")).otherwise(F.col("_at") - F.size("_w"))
    same = F.slice("_w", pos + 1, F.col("k")) == F.col("t_words")
    return hit.where((pos >= 0) & same).select(*keys, "template", "label", "phrase", "grams", "k", "t_pos", pos.cast("long").alias("pos")).distinct()


def spans(found: DataFrame, keys: list[str]) -> DataFrame:
    """Verified spans: ``keys, template, label, phrase, first, last, share``, words from 0, ``last`` included.

    ``found`` should be a stored table of :func:`votes`.  A window here holds the votes of one
    document for one template.
    """
    facts = ["template", "label", "phrase", "grams", "k"]
    by_diagonal = found.withColumn("diagonal", F.col("pos") - F.col("t_pos"))
    summed = by_diagonal.groupBy(*keys, *facts, "diagonal").agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last_pos"))
    places = summed.where(F.col("phrase") & (F.col("votes") == F.col("grams")))
    own = [*keys, "template"]
    strength = F.count("*").over(Window.partitionBy(*own, "diagonal"))
    strongest = F.row_number().over(Window.partitionBy(*own, "pos").orderBy(F.desc("votes"), "t_pos"))
    line = by_diagonal.where(~F.col("phrase")).withColumn("votes", strength).withColumn("_nth", strongest).where("_nth = 1")
    along = Window.partitionBy(*own).orderBy("pos")
    goes_on = (F.col("t_pos") > F.lag("t_pos").over(along)) & (F.col("pos") - F.lag("pos").over(along) <= F.col("grams") + F.col("k"))
    runs = (
        line.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
        .withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, *facts, "_run")
        .agg(F.min("pos").alias("first"), F.max("pos").alias("last_pos"), (F.count("*") / F.first("grams")).alias("share"))
        .where(F.col("share") >= MIN_SHARE)
    )
    ends = lambda df: df.select(*keys, "template", "label", "phrase", "first", (F.col("last_pos") + F.col("k") - 1).alias("last"), "share")
    return ends(places.withColumn("share", F.lit(1.0))).unionByName(ends(runs))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of each row of ``docs``; null texts are empty, other columns are ignored.

    Rows with equal id and text have equal results, each row its own.  ``score`` is the largest
    share of a template that a span holds, 1 where a phrase stands, 0 where nothing is found.
    """
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), F.col(text_col).alias("_t"))
    found = materialize(spans(materialize(votes(keyed, ["_id", "_text"], "_t"), "license-votes"), ["_id", "_text"]), "license-spans")
    labels = lambda only: F.array_join(F.array_sort(F.collect_set(F.when(only, F.col("label")))), ",")
    base = F.col("phrase")
    per_doc = found.groupBy("_id", "_text").agg(
        F.count_if(base).alias("_n_base"),
        F.min(F.when(base, F.col("first"))).alias("_first_word"),
        F.max(F.when(base, F.col("first"))).alias("_last_word"),
        labels(base).alias("_base_labels"),
        labels(F.lit(True)).alias("_labels"),
        F.max("share").alias("_score"),
    )
    right = per_doc.select(F.col("_id").alias("_r_id"), F.col("_text").alias("_r_text"), *[c for c in per_doc.columns if c not in ("_id", "_text")])
    n_words = F.coalesce(F.regexp_count("_t", F.lit(WORD)), F.lit(0))
    counted = keyed.select("_id", "_text", n_words.cast("long").alias("n_words"))
    joined = counted.join(right, F.col("_id").eqNullSafe(F.col("_r_id")) & (F.col("_text") == F.col("_r_text")), "left")
    return joined.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.coalesce("_n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("_first_word").alias("first_word"),
        F.col("_last_word").alias("last_word"),
        F.coalesce("_base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("_labels", F.lit("")).alias("labels"),
        F.coalesce("_score", F.lit(0.0)).alias("score"),
    )


def op3_query(spark, sf_dir: str) -> DataFrame:
    """The license scan of every row of ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    quoted = lambda w: "'" + " ".join(w) + "'"
    grams = ", ".join(f"({t}, '{label}', {phrase}, {n}, {k}, {i}, {quoted(w)})" for t, label, phrase, n, k, i, w in template_grams())
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    five = " || ' ' || ".join(f"w[i + {j}]" for j in range(K))
    return f"""
WITH t(template, label, phrase, grams, k, t_pos, gram) AS (VALUES {grams}),
d AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS gram FROM p WHERE i < len(w)
    UNION ALL SELECT doc_id, i - 1, {five} FROM p WHERE i + {K - 1} <= len(w)),
v AS (SELECT DISTINCT doc_id, template, label, phrase, grams, k, t_pos, pos FROM g JOIN t USING (gram)),
a AS (SELECT *, pos - t_pos AS diagonal, count(*) OVER (PARTITION BY doc_id, template, pos - t_pos) AS votes FROM v),
o AS (SELECT * FROM a WHERE NOT phrase QUALIFY row_number() OVER (PARTITION BY doc_id, template, pos ORDER BY votes DESC, t_pos) = 1),
n AS (SELECT *, CASE WHEN t_pos > lag(t_pos) OVER b AND pos - lag(pos) OVER b <= grams + k THEN 0 ELSE 1 END AS new FROM o WINDOW b AS (PARTITION BY doc_id, template ORDER BY pos)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY pos) AS run FROM n),
m AS (SELECT doc_id, label, phrase, min(pos) AS first, count(*) / CAST(grams AS DOUBLE) AS share FROM r GROUP BY doc_id, template, label, phrase, grams, k, run),
s AS (SELECT doc_id, label, phrase, min(pos) AS first, 1.0 AS share FROM a WHERE phrase AND votes = grams GROUP BY doc_id, template, label, phrase, diagonal
    UNION ALL SELECT doc_id, label, phrase, first, share FROM m WHERE share >= {MIN_SHARE}),
h AS (SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(first) FILTER (phrase) AS first_word, max(first) FILTER (phrase) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
    FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN h USING (doc_id)
"""


#: The same rows in DuckDB.
SQL = _sql()

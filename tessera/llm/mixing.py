"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of each source are dealt into shards and, within a shard, laid end to
end in a seeded order and cut into blocks of equal size.  Sainte-Lague gives
blocks to sources in the order of the highest quotients target / (2 k - 1), then
each source's blocks to its shards in the same way.  A shard's quota is filled
by whole passes over its blocks and by the blocks that a seed selects.  A
document takes the words of the blocks that it lies in, as often as they are taken.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._storage import materialize
from ._text import free_prefix, let, row_hash, words

MAX_REPEATS = 3  # times its size that a source or document may be taken
BLOCKS_PER_SOURCE = 20_000  # blocks in the mean source at least: the grain of the mix
MIN_BLOCK = 8  # words
SHARD_BLOCKS = 64  # blocks of a shard at least
SHARD_WORDS = 1_000_000  # words of a shard at least
SHARDS = 200_000  # shards of all sources at most, about: what reaches the driver; beyond, shards have more words


def capped_targets(sizes: np.ndarray, weights: np.ndarray, most: float = MAX_REPEATS) -> np.ndarray:
    """Shares of the total size by weight; what exceeds ``most`` times a source's size is shared anew by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    targets = np.zeros(len(sizes))
    capped = np.zeros(len(sizes), bool)
    left = sizes.sum()
    while left > 0 and not capped.all():
        free = np.where(capped, 0.0, weights)
        share = left * free / free.sum()
        over = ~capped & (share > most * sizes)
        if not over.any():
            targets = np.where(capped, targets, share)
            break
        targets = np.where(over, most * sizes, targets)
        capped |= over
        left = sizes.sum() - targets[capped].sum()
    return targets


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients votes / (2 k - 1), at most ``most`` each; ties go to the earlier entry.

    The quotient at which the seats run out is found by bisection, so the cost does not depend on the seats.
    """
    votes, most = np.asarray(votes, float), np.asarray(most, np.int64)
    seats = min(int(seats), int(most[votes > 0].sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)

    def down_to(q: float) -> np.ndarray:  # seats whose quotient is at least q
        return np.clip(np.floor((votes / q + 1) / 2), 0, most).astype(np.int64)

    low, high = votes[votes > 0].min() / (2 * most.max() + 1), votes.max() * 2
    for _ in range(200):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        if down_to(middle).sum() >= seats:
            low = middle
        else:
            high = middle
    out = down_to(high * (1 + 1e-9))  # surely among the seats; the last few are given one by one
    heap = [(-v / (2 * k + 1), i) for i, (v, k, m) in enumerate(zip(votes.tolist(), out.tolist(), most.tolist(), strict=True)) if v > 0 and k < m]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * int(out[i]) + 1), i))
    return out


def _seeded(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def mix(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), seed: int = 17, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", most: int = MAX_REPEATS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, size_col, source_col, source_size, target, taken, spans`` for each row.

    ``sized`` should be a stored table; its columns ``carry`` are returned as well and order rows of equal id and size.  Sources are ordered by code point, null last, and get
    ``weights`` in turn.  ``taken`` counts words with repeats; ``spans`` lists
    (first word, words, times) of what is taken, in order.  Rows of size 0 or null take nothing.
    Equal rows lie next to each other and may take different parts; which of them takes which does not matter.  An empty table gives no rows.
    """
    spark = sized.sparkSession
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    rows = sized.select(id_col, source_col, size.alias("_size"), *carry)
    sources = sorted(
        (r.asDict() for r in rows.groupBy(source_col).agg(F.sum("_size").alias("n"), F.count("*").alias("docs")).collect()),
        key=lambda r: (r[source_col] is None, (r[source_col] or "").encode("utf-32-be")),
    )  # one row for each source
    total = sum(r["n"] for r in sources)
    shard_words = max(SHARD_WORDS, total // SHARDS)
    block = int(max(MIN_BLOCK, min(total // (BLOCKS_PER_SOURCE * max(1, len(sources))), shard_words // SHARD_BLOCKS)))
    for i, r in enumerate(sources):
        r["weight"] = float(weights[i % len(weights)])
        r["shards"] = int(max(1, r["n"] // max(shard_words, SHARD_BLOCKS * block)))
    targets = capped_targets([r["n"] for r in sources], [r["weight"] for r in sources], most) if sources else []
    kind = sized.schema[source_col].dataType.simpleString()
    table = spark.createDataFrame(
        [(r[source_col], r["n"], float(t), r["shards"]) for r, t in zip(sources, targets, strict=True)],
        f"_source {kind}, source_size long, target double, _shards int",
    )
    digest = _seeded(seed, F.col(id_col), F.col("_size"))
    dealt = rows.join(table, F.col(source_col).eqNullSafe(F.col("_source"))).withColumn("_digest", digest)
    dealt = dealt.withColumn("_shard", F.pmod(_number("_digest"), F.col("_shards").cast("long")).cast("int"))
    dealt = materialize(dealt.drop("_source", "_shards"), "mix-shards")

    sums = dealt.groupBy(source_col, "_shard").agg(F.sum("_size").alias("n")).collect()  # about SHARDS rows at most
    by_source: dict = {}
    for r in sums:
        by_source.setdefault(r[source_col], []).append((r["_shard"], r["n"]))
    blocks_of = {s: -(-np.array([n for _, n in sorted(x)], np.int64) // block) for s, x in by_source.items()}
    most_of = np.array([most * int(blocks_of[r[source_col]].sum()) for r in sources], np.int64)
    # whole votes: equal quotients of different sources are then equal in floating point too
    seats = sainte_lague(np.rint(targets), round(sum(targets) / block), most_of) if sources else []
    quotas = []
    for r, quota in zip(sources, seats, strict=True):
        shards = sorted(by_source[r[source_col]])
        counts = blocks_of[r[source_col]]
        got = sainte_lague([n for _, n in shards], quota, most * counts)
        for (shard, _), q, c in zip(shards, got.tolist(), counts.tolist(), strict=True):
            if c:
                first = int(hashlib.md5(f"{seed}|{r[source_col]}|{shard}".encode()).hexdigest()[:12], 16) % c
                quotas.append((r[source_col], shard, q // c, q % c, c, first))
    shards = spark.createDataFrame(quotas, f"_source {kind}, _quota_shard int, _passes long, _extra long, _blocks long, _first long")

    line = Window.partitionBy(source_col, "_shard").orderBy("_digest", id_col, *carry).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_start", F.coalesce(F.sum("_size").over(line), F.lit(0)))
    joined = placed.join(shards, F.col(source_col).eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_quota_shard")), "left")
    # the documents of a shard lie in a seeded order, so a run of blocks from a seeded first one is a seeded selection
    start, stop = F.col("_start"), F.col("_start") + F.col("_size")
    pieces = F.transform(
        F.when(F.col("_size") > 0, F.sequence(F.floor(start / block), F.floor((stop - 1) / block))).otherwise(F.array().cast("array<bigint>")),
        lambda b: F.struct(
            (F.greatest(b * block, start) - start).alias("first"),
            (F.least((b + 1) * block, stop) - F.greatest(b * block, start)).alias("words"),
            (F.col("_passes") + (F.pmod(b - F.col("_first"), F.col("_blocks")) < F.col("_extra")).cast("long")).alias("times"),
        ),
    )
    spans = F.filter(pieces, lambda p: p["times"] > 0)
    return joined.select(
        id_col, F.col("_size").alias(size_col), source_col, "source_size", "target", *carry, spans.alias("spans")
    ).withColumn("taken", F.aggregate("spans", F.lit(0).cast("long"), lambda a, p: a + p["words"] * p["times"]))


def op10_query(spark, sf_dir: str) -> DataFrame:
    """The mix of all rows of ``documents`` with weights 1, 2, 3 in turn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    return mix(sized).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "source")


def take(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, columns unchanged.

    A document is repeated as often as it is taken whole; words that are taken once more make a
    further row with the text of just those words, joined by spaces, and its length as ``n_chars``.
    Null and empty texts have no words and go.  Null ids and sources are values like others;
    equal rows take their parts one by one.  An empty table gives an empty one.  Sizes, ids and row
    hashes make the mix; each text then moves once.
    """
    columns, p = docs.columns, free_prefix(docs.columns, "_mix_")
    size = F.size(words(F.col("text"))).cast("long")
    keyed = docs.withColumn(f"{p}hash", row_hash(docs))
    sized = materialize(keyed.select("doc_id", "source", size.alias(f"{p}size"), f"{p}hash"), "mix-sizes")
    got = materialize(mix(sized, size_col=f"{p}size", carry=(f"{p}hash",)).where("taken > 0"), "mix-spans")
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["words"]) == F.col(f"{p}size")
    whole_passes = F.when(covered, F.array_min("spans.times")).otherwise(0)
    # parts beyond the whole passes are taken once more
    beyond = let(whole_passes, lambda n: F.struct(n.alias("whole"), F.filter("spans", lambda x: x["times"] > n).alias("parts")))
    got = got.select(F.col("doc_id").alias(f"{p}id"), F.col(f"{p}hash").alias(f"{p}got_hash"), beyond.alias(f"{p}beyond"))
    got = got.select(f"{p}id", f"{p}got_hash", F.col(f"{p}beyond.whole").cast("int").alias(f"{p}whole"), F.col(f"{p}beyond.parts").alias(f"{p}parts"))
    # equal rows are one row here, met before the shuffle; each of their parts joins it
    joined = keyed.dropDuplicates(["doc_id", f"{p}hash"]).join(got, F.col("doc_id").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}hash") == F.col(f"{p}got_hash")))
    slices = lambda w: F.transform(f"{p}parts", lambda x: F.slice(w, (x["first"] + 1).cast("int"), x["words"].cast("int")))
    part_text = F.array_join(F.flatten(let(words(F.col("text")), slices)), " ")
    part = F.when(F.size(f"{p}parts") > 0, F.array(part_text)).otherwise(F.array().cast("array<string>"))
    rows = joined.withColumn(f"{p}texts", F.concat(F.array_repeat("text", F.col(f"{p}whole")), part)).withColumn(f"{p}at", F.explode(F.sequence(F.lit(0), F.size(f"{p}texts") - 1)))
    is_part = F.col(f"{p}at") == F.col(f"{p}whole")
    changed = {"text": F.get(f"{p}texts", F.col(f"{p}at")), "n_chars": F.when(is_part, F.length(F.get(f"{p}texts", F.col(f"{p}at"))).cast("long")).otherwise(F.col("n_chars"))}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in columns])


def _sql(seed: int = 17) -> str:
    """The rows of :func:`op10_query` in DuckDB.

    Capped sources are those first by size / weight, as many as leave no other above its cap.
    """
    digest = "md5(concat_ws('|', '{}', {}))"
    own = digest.format(seed, "coalesce(CAST(doc_id AS VARCHAR), '~'), CAST(size AS VARCHAR)")
    seat = lambda seats: f"row_number() OVER (PARTITION BY {seats} ORDER BY votes / (2 * k - 1) DESC, place)"
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, place % 3 + 1.0::DOUBLE AS weight, sum(n) OVER () AS total, count(*) OVER () AS m FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY n / weight, place) - 1 AS capped, coalesce(sum(n) OVER (ORDER BY n / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS small,
    sum(weight) OVER (ORDER BY n / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
lam AS (SELECT min(capped) AS capped, min_by((total - {MAX_REPEATS} * small) / rest, capped) AS share FROM o WHERE (total - {MAX_REPEATS} * small) / rest * weight <= {MAX_REPEATS} * n),
t AS (SELECT o.*, CASE WHEN o.capped < lam.capped THEN {MAX_REPEATS} * n ELSE lam.share * weight END AS target,
    greatest({SHARD_WORDS}, total // {SHARDS}) AS shard_words, greatest({MIN_BLOCK}, least(total // ({BLOCKS_PER_SOURCE} * m), greatest({SHARD_WORDS}, total // {SHARDS}) // {SHARD_BLOCKS})) AS block FROM o, lam),
h AS (SELECT *, greatest(1, n // greatest(shard_words, {SHARD_BLOCKS} * block)) AS shards FROM t),
p AS (SELECT d.*, h.n AS source_size, h.target, h.block, h.place, {own} AS digest, CAST('0x' || substr({own}, 1, 12) AS BIGINT) % h.shards AS shard FROM d JOIN h ON h.source IS NOT DISTINCT FROM d.source),
x AS (SELECT place, shard, any_value(source) AS source, any_value(block) AS block, CAST(sum(size) AS BIGINT) AS words, CAST(ceil(sum(size) / CAST(any_value(block) AS DOUBLE)) AS BIGINT) AS blocks FROM p GROUP BY place, shard),
q AS (SELECT t.place, CAST(round_even(t.target, 0) AS DOUBLE) AS votes, unnest(range(1, CAST({MAX_REPEATS} * b.blocks + 1 AS BIGINT))) AS k, (SELECT round(sum(target) / min(block)) FROM t) AS seats FROM t JOIN (SELECT place, sum(blocks) AS blocks FROM x GROUP BY place) b USING (place)),
a AS (SELECT place, count(*) AS quota FROM (SELECT *, {seat("0")} AS nth FROM q) WHERE nth <= seats GROUP BY place),
y AS (SELECT x.place AS source_place, x.shard AS place, words AS votes, a.quota, unnest(range(1, CAST({MAX_REPEATS} * blocks AS BIGINT) + 1)) AS k FROM x JOIN a USING (place)),
z AS (SELECT source_place, place AS shard, count(*) AS quota FROM (SELECT *, {seat("source_place")} AS nth FROM y) WHERE nth <= quota GROUP BY ALL),
f AS (SELECT x.*, coalesce(quota, 0) // blocks AS passes, coalesce(quota, 0) % blocks AS extra,
    CAST('0x' || substr(md5('{seed}|' || coalesce(source, 'None') || '|' || x.shard), 1, 12) AS BIGINT) % blocks AS first FROM x LEFT JOIN z ON z.source_place = x.place AND z.shard = x.shard WHERE blocks > 0),
l AS (SELECT p.*, CAST(coalesce(sum(size) OVER (PARTITION BY place, shard ORDER BY digest, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p),
b AS (SELECT doc_id, place, shard, digest, size, start, block, unnest(range(CAST(start // block AS BIGINT), CAST((start + size - 1) // block AS BIGINT) + 1)) AS i FROM l WHERE size > 0),
g AS (SELECT doc_id, b.place, b.start, b.shard, sum((least((i + 1) * b.block, b.start + size) - greatest(i * b.block, b.start)) * (passes + CASE WHEN ((i - first) % blocks + blocks) % blocks < extra THEN 1 ELSE 0 END)) AS taken
    FROM b JOIN f ON f.place = b.place AND f.shard = b.shard GROUP BY ALL)
SELECT l.doc_id, l.size, l.source_size, CAST(round(l.target, 6) AS DOUBLE) AS target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken, l.source
FROM l LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM l.doc_id AND g.place = l.place AND g.shard = l.shard AND g.start = l.start
"""


SQL = _sql()

"""Queries of whole fits, encoders, reports and stored models, with the DuckDB SQL that derives the same rows from the data.

Fits take uniform prebins of columns with few values, so SQL can build the prebins, enumerate all merges and make the table of the best.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from . import queries as q
from .functions import stats
from .operators.binning import BinaryBinner, BinningModel, ContinuousBinner, MulticlassBinner
from .operators.binning2d import Binner2D, Model2D
from .operators.histogram import refine
from .operators.monitoring import Monitoring
from .operators.piecewise import PiecewiseBinner
from .operators.process import BinningPipeline
from .operators.scorecard import FixedModel, Scorecard
from .operators.splits import cart_splits, mdlp_splits
from .operators.tables import as_frame, interval_labels
from .queries import KEY, LABELS, SPLITS, L, case, query, rounded
from .sources.files import fit_disk, read_table
from .streaming.sketch import StreamingBinner, chunk_state, merge_states, sketch_quantiles

TENTHS = [round(1 + 4.9 * i, 1) for i in range(1, 10)]  # ten uniform prebins of l_quantity, 1 to 50
QUARTERS = [13.25, 25.5, 37.75]


def named(splits) -> str:
    return "[" + ", ".join(q.quoted(f"{s:.2f}" for s in splits)) + "]"


def winner(best: str, splits) -> str:
    """CTEs of the bins that a best partition makes: ``bins(i, grp)`` for each prebin and ``label(grp, bin)``."""
    n = len(splits)
    return f"""best AS MATERIALIZED ({best}), b AS (SELECT CAST(string_split(ends, ',') AS INT[]) AS e FROM best),
bins AS (SELECT CAST(i AS INT) AS i, len(list_filter(e, lambda x: x < i)) AS grp FROM b, range({n + 1}) t(i)),
label AS (SELECT CAST(g AS INT) AS grp, CASE WHEN g = 0 THEN '(-inf, ' ELSE '[' || list_extract({named(splits)}, e[CAST(g AS INT)] + 1) || ', ' END ||
    CASE WHEN g + 1 = len(e) THEN 'inf)' ELSE list_extract({named(splits)}, e[CAST(g AS INT) + 1] + 1) || ')' END AS bin FROM b, range((SELECT len(e) FROM b)) t(g))"""


def fitted_binary_sql(best: str, splits, source: str = L, x: str = "l_quantity", y: str = "y1") -> str:
    return f"""WITH {winner(best, splits)}, src AS ({source}), g AS (SELECT {case(x, splits)} AS i, count(*) FILTER ({y} = 0) AS ne, count(*) FILTER ({y} <> 0) AS e FROM src GROUP BY 1),
c AS (SELECT label.bin, CAST(sum(ne) AS BIGINT) AS ne, CAST(sum(g.e) AS BIGINT) AS e FROM g JOIN bins USING (i) JOIN label USING (grp) GROUP BY 1 UNION ALL SELECT unnest(['Special', 'Missing']), 0, 0),
{q.TABLE_SQL} {q.TABLE_ROWS}"""


BEST = q.partition_sql("y1", f"{q.ASC} AND {q.Z} >= 3.2905267314919255", splits=TENTHS, x="l_quantity")


@query("optimal_binning", fitted_binary_sql(BEST, TENTHS))
def _(spark, d):
    b = BinaryBinner(prebinning_method="uniform", max_n_prebins=10, monotonic_trend="ascending", max_pvalue=0.001)
    return q.model_table(b.fit(q.lines(spark, d), "l_quantity", "y1"), spark)


NORMAL = f"SELECT * FROM ({L}) WHERE l_extendedprice BETWEEN (SELECT quantile_cont(l_extendedprice, 0.25) - 0.3 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) FROM lineitem) AND (SELECT quantile_cont(l_extendedprice, 0.75) + 0.3 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) FROM lineitem)"


@query("optimal_binning_outliers", q.binary_table_sql(NORMAL, q.bin_sql("l_extendedprice", SPLITS), "y1", [*LABELS, "Special", "Missing"]))
def _(spark, d):
    b = q.fixed_binner(outlier_detector="range", outlier_params={"k": 0.3})
    return q.model_table(b.fit(q.lines(spark, d), "l_extendedprice", "y1"), spark)


@query("fit_transform_woe", fitted_binary_sql(BEST, TENTHS).rsplit(" SELECT bin, CAST(n AS BIGINT)", 1)[0] + f", own AS (SELECT *, {case('l_quantity', TENTHS)} AS i FROM src) SELECT l_orderkey, l_linenumber, round(woe, 6) AS code FROM own JOIN bins USING (i) JOIN label USING (grp) JOIN v USING (bin)")
def _(spark, d):
    b = BinaryBinner(prebinning_method="uniform", max_n_prebins=10, monotonic_trend="ascending", max_pvalue=0.001)
    return rounded(b.fit_transform(q.lines(spark, d), "l_quantity", "y1", output="code").select(*KEY, "code"))


# ---------------------------------------------------------------- other targets


def continuous_best(edge: str, splits=TENTHS) -> str:
    n = len(splits)
    return f"""WITH RECURSIVE src AS ({L}), g AS (SELECT {case('l_quantity', splits)} AS i, CAST(count(*) AS DOUBLE) AS n, sum(yc) AS s FROM src GROUP BY 1), t AS (SELECT sum(s) / sum(n) AS m FROM g),
c AS (SELECT a.i AS k, b.i AS i, sum(g.s) / sum(g.n) AS mean FROM g a JOIN g b ON a.i <= b.i JOIN g ON g.i BETWEEN a.i AND b.i GROUP BY 1, 2),
v AS (SELECT k, i, CAST(trunc(1000000 * mean) AS BIGINT) AS d, CAST(trunc(1000000 * abs(mean - m)) AS BIGINT) AS v FROM c, t),
p AS (SELECT i, v AS value, 1 AS bins, d, CAST(i AS VARCHAR) AS ends FROM v WHERE k = 0 UNION ALL SELECT v.i, p.value + v.v, p.bins + 1, v.d, p.ends || ',' || v.i FROM p JOIN v ON v.k = p.i + 1 WHERE {edge})
SELECT ends FROM p WHERE i = {n} ORDER BY value DESC, bins, ends LIMIT 1"""


def fitted_continuous_sql(best: str, splits) -> str:
    rows = q.continuous_sql(L, "own", "yc", ["x"])
    table = rows[rows.index("t AS (SELECT *, CASE") :]
    return f"""WITH {winner(best, splits)}, src AS (SELECT *, label.bin AS own FROM (SELECT *, {case('l_quantity', splits)} AS i FROM ({L})) JOIN bins USING (i) JOIN label USING (grp)),
c AS (SELECT own AS bin, count(*) AS n, sum(yc) AS s, stddev_pop(yc) AS sd, min(yc) AS a, max(yc) AS b, count(*) FILTER (yc = 0) AS z FROM src GROUP BY 1
    UNION ALL SELECT unnest(['Special', 'Missing']), 0, 0, NULL, NULL, NULL, 0), {table}"""


@query("optimal_binning_continuous", fitted_continuous_sql(continuous_best("v.d <= p.d"), TENTHS))
def _(spark, d):
    b = ContinuousBinner(prebinning_method="uniform", max_n_prebins=10, monotonic_trend="descending")
    return q.model_table(b.fit(q.lines(spark, d), "l_quantity", "yc"), spark, sum=2, std=3, mean=5, woe=4, iv=4)


def class_values(splits) -> str:
    """CTEs up to ``v(k, i, v, d0, d1, d2)``: the value and the class rates of each bin of prebins k to i."""
    iv = lambda c: f"(a{c} / t{c} - (n - a{c}) / (tn - t{c})) * ln((a{c} / t{c}) / ((n - a{c}) / (tn - t{c})))"
    return f"""src AS ({L}), g AS (SELECT {case('l_quantity', splits)} AS i, CAST(count(*) AS DOUBLE) AS n, {', '.join(f"CAST(count(*) FILTER (ym = {c}) AS DOUBLE) AS a{c}" for c in range(3))} FROM src GROUP BY 1),
t AS (SELECT sum(n) AS tn, {', '.join(f"sum(a{c}) AS t{c}" for c in range(3))} FROM g),
c AS (SELECT a.i AS k, b.i AS i, sum(g.n) AS n, {', '.join(f"sum(g.a{c}) AS a{c}" for c in range(3))} FROM g a JOIN g b ON a.i <= b.i JOIN g ON g.i BETWEEN a.i AND b.i GROUP BY 1, 2),
v AS (SELECT k, i, {' + '.join(f"CAST(trunc(1000000 * ({iv(c)})) AS BIGINT)" for c in range(3))} AS v, {', '.join(f"CAST(trunc(1000000 * (a{c} / n)) AS BIGINT) AS d{c}" for c in range(3))} FROM c, t)"""


MULTI_BEST = f"""WITH RECURSIVE {class_values(QUARTERS)},
p AS (SELECT i, v AS value, 1 AS bins, d0, CAST(i AS VARCHAR) AS ends FROM v WHERE k = 0 UNION ALL SELECT v.i, p.value + v.v, p.bins + 1, v.d0, p.ends || ',' || v.i FROM p JOIN v ON v.k = p.i + 1 WHERE v.d0 <= p.d0)
SELECT ends FROM p WHERE i = 3 ORDER BY value DESC, bins, ends LIMIT 1"""


@query("optimal_binning_multiclass", f"""WITH {winner(MULTI_BEST, QUARTERS)}, src AS (SELECT label.bin AS own, ym FROM (SELECT *, {case('l_quantity', QUARTERS)} AS i FROM ({L})) JOIN bins USING (i) JOIN label USING (grp)),
c AS (SELECT own AS bin, count(*) AS n, {', '.join(f"count(*) FILTER (ym = {c}) AS n{c}" for c in range(3))} FROM src GROUP BY 1 UNION ALL SELECT unnest(['Special', 'Missing']), 0, 0, 0, 0),
u AS (SELECT * FROM c UNION ALL SELECT 'Totals', sum(n), sum(n0), sum(n1), sum(n2) FROM c)
SELECT bin, CAST(n AS BIGINT) AS "count", round(CAST(n AS DOUBLE) / (SELECT sum(n) FROM c), 6) AS count_pct, {', '.join(f"CAST(n{c} AS BIGINT) AS event_{c}" for c in range(3))},
{', '.join(f"round(CASE WHEN n > 0 THEN CAST(n{c} AS DOUBLE) / n ELSE 0 END, 6) AS event_rate_{c}" for c in range(3))} FROM u""")
def _(spark, d):
    b = MulticlassBinner(prebinning_method="uniform", max_n_prebins=4, monotonic_trend=["descending", None, None])
    return q.model_table(b.fit(q.lines(spark, d), "l_quantity", "ym"), spark)


@query("multiclass_model_data", f"WITH {class_values(QUARTERS)} SELECT CAST(k AS BIGINT) AS first, CAST(i AS BIGINT) AS last, v AS value, d0, d1, d2 FROM v")
def _(spark, d):
    h = q.histogram(q.lines(spark, d), "l_quantity", "ym", "multiclass", classes=[0, 1, 2], edges=[-np.inf, *QUARTERS, np.inf])
    p = MulticlassBinner(monotonic_trend=None)._problem(h.by_split(QUARTERS), h.total)
    rows = [(k, i, int(p.value[i][k]), *(int(r[i][k]) for r in p.rates)) for i in range(4) for k in range(i + 1)]
    return spark.createDataFrame(rows, "first long, last long, value long, d0 long, d1 long, d2 long")


@query("continuous_model_data", continuous_best("true").split("p AS (SELECT i, v")[0].replace("trunc(1000000 * mean)", "round(100 * mean)").replace("trunc(1000000 * abs(mean - m))", "round(100 * abs(mean - m))").rstrip().rstrip(",") + " SELECT CAST(k AS BIGINT) AS first, CAST(i AS BIGINT) AS last, d AS mean, v AS value FROM v")
def _(spark, d):
    bins, total = q.split_counts(q.lines(spark, d), "l_quantity", "yc", "continuous", TENTHS)
    p = ContinuousBinner(monotonic_trend=None)._problem(bins, total)
    cents = lambda x: int(np.rint(x / 10_000))
    return spark.createDataFrame([(k, i, cents(p.rates[0][i][k]), cents(p.value[i][k])) for i in range(10) for k in range(i + 1)], "first long, last long, mean long, value long")


# ---------------------------------------------------------------- partitions under rules on all bins

TURN = "(SELECT arg_{}(i, e / (ne + e)) FROM g)"
TURNED = f"{q.NO_TURN} AND (v.i >= {{t}} OR v.d {{up}} p.d) AND (p.i < {{t}} OR v.d {{down}} p.d)"
q.add_partition("optimal_peak_heuristic", q.partition_sql("y2", TURNED.format(t=TURN.format("max"), up=">=", down="<=")), "y2", monotonic_trend="peak_heuristic")
q.add_partition("optimal_valley_heuristic", q.partition_sql("y2", TURNED.format(t=TURN.format("min"), up="<=", down=">=")), "y2", monotonic_trend="valley_heuristic")


def bent_sql(y: str, sign: int) -> str:
    """Concave (1) or convex (-1): each new rate is at most 2 r_b - r_a for all earlier a < b, whose least is carried along."""
    base = q.partition_sql(y, q.NO_TURN)
    base = base.replace("CAST(i AS VARCHAR) AS ends, 0 AS turned FROM v", f"CAST(i AS VARCHAR) AS ends, 0 AS turned, {sign} * d AS most, CAST(NULL AS BIGINT) AS least FROM v")
    base = base.replace("tt.turn FROM p JOIN v", f"tt.turn, greatest(p.most, {sign} * v.d), least(coalesce(p.least, 9000000), {sign} * 2 * v.d - p.most) FROM p JOIN v")
    return base.replace(f"WHERE ({q.NO_TURN})", f"WHERE ({q.NO_TURN} AND (p.least IS NULL OR {sign} * v.d <= p.least))")


q.add_partition("optimal_concave", bent_sql("y1", 1), monotonic_trend="concave")
q.add_partition("optimal_convex", bent_sql("y2", -1), "y2", monotonic_trend="convex")

ALIKE = "abs(v.e / v.n - x.e / x.n) / sqrt(((v.e + x.e) / (v.n + x.n)) * (1 - (v.e + x.e) / (v.n + x.n)) * (1 / v.n + 1 / x.n)) < 3.2905267314919255"
ALL_PAIRS = (
    q.partition_sql("y2", q.NO_TURN)
    .replace("CAST(i AS VARCHAR) AS ends, 0 AS turned FROM v", "CAST(i AS VARCHAR) AS ends, 0 AS turned, [{'e': e, 'n': n}] AS past FROM v")
    .replace("tt.turn FROM p JOIN v", "tt.turn, list_append(p.past, {'e': v.e, 'n': v.n}) FROM p JOIN v")
    .replace(f"WHERE ({q.NO_TURN})", f"WHERE ({q.NO_TURN} AND len(list_filter(p.past, lambda x: {ALIKE})) = 0)")
)
q.add_partition("optimal_max_pvalue_all", ALL_PAIRS, "y2", max_pvalue=0.001, max_pvalue_policy="all")


# ---------------------------------------------------------------- prebins of trees


def cart_sql(leaves: int, columns: str, impurity: str) -> str:
    """Best-first growth, one step for each split; ``impurity`` is over n and the sums of ``columns``."""
    names = ["n", *columns.split()]
    own = {"e": "sum(y1)", "s": "sum(yc)", "ss": "sum(yc * yc)"}
    parts = [f"h AS MATERIALIZED (SELECT CAST(l_quantity AS DOUBLE) AS v, CAST(count(*) AS DOUBLE) AS n, {', '.join(f'{own[c]} AS {c}' for c in names[1:])} FROM ({L}) GROUP BY 1)", "sp0 AS (SELECT CAST([] AS DOUBLE[]) AS s)"]
    shape = lambda f: impurity.format(**{c: f.format(c) for c in names})
    for j in range(1, leaves):
        sums = ", ".join(f"sum({c}) OVER (w ROWS UNBOUNDED PRECEDING) AS l_{c}, sum({c}) OVER (PARTITION BY node) AS t_{c}" for c in names)
        parts += [
            f"nd{j} AS (SELECT h.*, len(list_filter(sp{j - 1}.s, lambda x: x < v)) AS node FROM h, sp{j - 1})",
            f"c{j} AS (SELECT v, lead(v) OVER w AS nxt, {sums} FROM nd{j} WINDOW w AS (PARTITION BY node ORDER BY v))",
            f"g{j} AS (SELECT (v + nxt) / 2 AS split FROM c{j} WHERE nxt IS NOT NULL AND least(l_n, t_n - l_n) >= ceil(0.05 * (SELECT sum(n) FROM h)) ORDER BY {shape('t_{}')} - {shape('l_{}')} - {shape('(t_{0} - l_{0})')} DESC, split LIMIT 1)",
            f"sp{j} AS MATERIALIZED (SELECT list_append(s, split) AS s FROM sp{j - 1}, g{j})",
        ]
    return f"WITH {', '.join(parts)} SELECT row_number() OVER (ORDER BY x) - 1 AS split_id, round(x, 4) AS split FROM (SELECT unnest(s) AS x FROM sp{leaves - 1})"


def tree(spark, d, kind: str, y: str):
    h = q.binned(q.lines(spark, d), "l_quantity", y, kind)
    return rounded(spark.createDataFrame([(i, float(s)) for i, s in enumerate(cart_splits(h, kind, 6, np.ceil(0.05 * h.total)))], "split_id long, split double"), 4)


@query("cart_prebins_few_values", cart_sql(6, "e", "(2 * {e} * ({n} - {e}) / {n})"))
def _(spark, d):
    return tree(spark, d, "binary", "y1")


@query("cart_prebins_continuous", cart_sql(6, "s ss", "({ss} - {s} * {s} / {n})"))
def _(spark, d):
    return tree(spark, d, "continuous", "yc")


def mdlp_sql(levels: int) -> str:
    entropy = lambda n, e: f"(CASE WHEN {e} > 0 AND {e} < {n} THEN -({e} / {n} * ln({e} / {n}) + (1 - {e} / {n}) * ln(1 - {e} / {n})) ELSE 0 END)"
    kinds = lambda n, e: f"(CAST({e} > 0 AS INT) + CAST({e} < {n} AS INT))"
    parts = [
        f"h AS MATERIALIZED (SELECT l_discount AS v, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y2) AS DOUBLE) AS e FROM ({L}) GROUP BY 1)",
        "k AS MATERIALIZED (SELECT v, lead(v) OVER o AS nv, n, e, lead(n) OVER o AS nn, lead(e) OVER o AS ne FROM h WINDOW o AS (ORDER BY v))",
        "n0 AS (SELECT -1e9 AS lo, 1e9 AS hi)",
    ]
    for j in range(levels):
        parts += [
            f"s{j} AS (SELECT lo, hi, (k.v + nv) / 2 AS split, sum(h.n) AS n, sum(h.e) AS e, sum(h.n) FILTER (h.v <= k.v) AS n1, coalesce(sum(h.e) FILTER (h.v <= k.v), 0) AS e1 FROM n{j} JOIN k ON k.v > lo AND nv < hi AND NOT ((k.e = 0 AND ne = 0) OR (k.e = k.n AND ne = nn)) JOIN h ON h.v > lo AND h.v < hi GROUP BY ALL)",
            f"x{j} AS (SELECT *, {entropy('n', 'e')} AS ht, {entropy('n1', 'e1')} AS h1, {entropy('(n - n1)', '(e - e1)')} AS h2, {kinds('n', 'e')} AS kt, {kinds('n1', 'e1')} AS k1, {kinds('(n - n1)', '(e - e1)')} AS k2 FROM s{j} WHERE least(n1, n - n1) >= 2)",
            f"b{j} AS MATERIALIZED (SELECT *, ht - (n1 * h1 + (n - n1) * h2) / n AS gain FROM x{j} QUALIFY row_number() OVER (PARTITION BY lo, hi ORDER BY round(gain, 12) DESC, split) = 1)",
            f"n{j + 1} AS MATERIALIZED (SELECT unnest([lo, split]) AS lo, unnest([split, hi]) AS hi FROM b{j} WHERE gain > (ln(n - 1) + ln(pow(3, kt) - 2) - (kt * ht - k1 * h1 - k2 * h2)) / n)",
        ]
    return f"WITH {', '.join(parts)} SELECT DISTINCT round(split, 4) AS split FROM ({' UNION ALL '.join(f'SELECT split FROM b{j}' for j in range(levels))})"


@query("mdlp_splits", mdlp_sql(5))
def _(spark, d):
    return rounded(spark.createDataFrame([(float(s),) for s in mdlp_splits(q.binned(q.lines(spark, d), "l_discount", "y2", "binary"))], "split double"), 4)


# ---------------------------------------------------------------- two columns

WITH_CODES = f"SELECT *, CASE WHEN l_linenumber = 6 THEN NULL WHEN l_linenumber = 7 THEN CAST(-9999 AS DOUBLE) ELSE l_quantity END AS xq FROM ({L})"
XS, YS = [1 + 49 / 3, 1 + 98 / 3], [0.1 / 3, 0.2 / 3]


def two_columns(spark, d):
    code = F.when(F.col("l_linenumber") == 6, None).when(F.col("l_linenumber") == 7, -9999.0).otherwise(F.col("l_quantity"))
    return q.lines(spark, d).withColumn("xq", code.cast("double"))


def fit_2d(spark, d, kind: str = "binary", **options) -> Model2D:
    b = Binner2D(kind=kind, prebinning_method="uniform", max_n_prebins_x=3, max_n_prebins_y=3, special_codes_x=[-9999], **options)
    return b.fit(two_columns(spark, d), "xq", "l_discount", "y1" if kind == "binary" else "yc")


def range_label(splits, first: str, last: str) -> str:
    names = [f"{s:.2f}" for s in splits]
    low = f"CASE {first} " + " ".join(f"WHEN {i + 1} THEN '[{n}'" for i, n in enumerate(names)) + " ELSE '(-inf' END"
    high = f"CASE {last} " + " ".join(f"WHEN {i} THEN '{n})'" for i, n in enumerate(names)) + " ELSE 'inf)' END"
    return f"({low} || ', ' || {high})"


def covers_sql(kind: str, ascending: bool) -> str:
    """CTEs up to ``rect(top, lft, bottom, rgt)``, the best of all exact covers of the 3 x 3 cells by rectangles."""
    sums = "count(*) AS n, count(*) FILTER (y1 <> 0) AS e" if kind == "binary" else "count(*) AS n, sum(yc) AS e"
    rate = "e / n"
    value = "(e / te - (n - e) / (tn - te)) * ln((e / te) / ((n - e) / (tn - te)))" if kind == "binary" else "abs(e / n - te / tn)"
    grows = "AND len(list_filter(p.used, lambda u: (u.r + 1 = r.lft AND u.t <= r.bottom AND r.top <= u.b AND u.d > r.d) OR (r.rgt + 1 = u.l AND u.t <= r.bottom AND r.top <= u.b AND r.d > u.d))) = 0" if ascending else ""
    return f"""src AS ({WITH_CODES}), cls AS (SELECT *, CASE WHEN xq IS NULL THEN 'Missing' WHEN xq = -9999 THEN 'Special' ELSE 'clean' END AS class, {case('xq', XS)} AS ix, {case('l_discount', YS)} AS iy FROM src),
g AS (SELECT ix, iy, {sums} FROM cls WHERE class = 'clean' GROUP BY 1, 2), tot AS (SELECT CAST(sum(n) AS DOUBLE) AS tn, CAST(sum(e) AS DOUBLE) AS te FROM g),
shape AS (SELECT a.i AS top, b.i AS bottom, c.i AS lft, e.i AS rgt FROM range(3) a(i) JOIN range(3) b(i) ON a.i <= b.i CROSS JOIN range(3) c(i) JOIN range(3) e(i) ON c.i <= e.i),
r0 AS (SELECT top, bottom, lft, rgt, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(e) AS DOUBLE) AS e, CAST(sum(1 << CAST(3 * iy + ix AS INT)) AS INT) AS mask, CAST(3 * top + lft AS INT) AS corner FROM shape JOIN g ON iy BETWEEN top AND bottom AND ix BETWEEN lft AND rgt GROUP BY ALL),
r AS MATERIALIZED (SELECT top, bottom, lft, rgt, mask, corner, CAST(trunc(1000000 * ({value})) AS BIGINT) AS v, CAST(trunc(1000000 * ({rate})) AS BIGINT) AS d FROM r0, tot),
path AS (SELECT 0 AS covered, CAST(0 AS BIGINT) AS value, [{{'t': CAST(-9 AS BIGINT), 'l': CAST(-9 AS BIGINT), 'b': CAST(-9 AS BIGINT), 'r': CAST(-9 AS BIGINT), 'd': CAST(0 AS BIGINT)}}] AS used
    UNION ALL SELECT p.covered | r.mask, p.value + r.v, list_append(p.used, {{'t': r.top, 'l': r.lft, 'b': r.bottom, 'r': r.rgt, 'd': r.d}}) FROM path p JOIN r ON p.covered & r.mask = 0 AND (p.covered >> r.corner) & 1 = 0 AND p.covered & ((1 << r.corner) - 1) = (1 << r.corner) - 1 WHERE p.covered < 511 {grows}),
win AS MATERIALIZED (SELECT used FROM path WHERE covered = 511 ORDER BY value DESC, len(used) LIMIT 1),
rect AS (SELECT u.t AS top, u.l AS lft, u.b AS bottom, u.r AS rgt, {range_label(XS, 'u.l', 'u.r')} || ' ∪ ' || {range_label(YS, 'u.t', 'u.b')} AS bin FROM (SELECT unnest(used) AS u FROM win) WHERE u.t >= 0),
own AS (SELECT cls.*, CASE WHEN class = 'clean' THEN rect.bin ELSE class END AS bin FROM cls LEFT JOIN rect ON class = 'clean' AND iy BETWEEN top AND bottom AND ix BETWEEN lft AND rgt)"""


BINARY_2D = f"WITH RECURSIVE {covers_sql('binary', True)}, c AS (SELECT bin, count(*) FILTER (y1 = 0) AS ne, count(*) FILTER (y1 <> 0) AS e FROM own GROUP BY 1), {q.TABLE_SQL}"


@query("table2d", f"{BINARY_2D} {q.TABLE_ROWS}")
def _(spark, d):
    return rounded(fit_2d(spark, d, monotonic_trend_x="ascending").binning_table(spark, show_bin_xy=True))


@query("transform2d", f"{BINARY_2D} SELECT l_orderkey, l_linenumber, round(CASE WHEN own.bin = 'Missing' THEN 0 ELSE woe END, 6) AS woe, round(CASE WHEN own.bin = 'Special' THEN 0 ELSE rate END, 6) AS event_rate, own.bin AS bin FROM own JOIN v ON v.bin = own.bin")
def _(spark, d):
    m, df = fit_2d(spark, d, monotonic_trend_x="ascending"), two_columns(spark, d)
    x, y = F.col("xq"), F.col("l_discount")
    return rounded(df.select(
        *KEY, m.encode(x, y, "woe", metric_special="empirical").alias("woe"), m.encode(x, y, "event_rate", metric_missing="empirical").alias("event_rate"),
        m.encode(x, y, "bins", metric_special="empirical", metric_missing="empirical").alias("bin"),
    ))


CONTINUOUS_2D = f"WITH RECURSIVE {covers_sql('continuous', False)}"
_rows = q.continuous_sql(L, "own", "yc", ["x"])


@query("table2d_continuous", f"{CONTINUOUS_2D}, c AS (SELECT bin, count(*) AS n, sum(yc) AS s, stddev_pop(yc) AS sd, min(yc) AS a, max(yc) AS b, count(*) FILTER (yc = 0) AS z FROM own GROUP BY 1), {_rows[_rows.index('t AS (SELECT *, CASE'):]}")
def _(spark, d):
    return rounded(fit_2d(spark, d, "continuous").binning_table(spark, show_bin_xy=True), sum=2, std=3, mean=5, woe=4, iv=4)


@query("transform2d_continuous", f"{CONTINUOUS_2D} SELECT l_orderkey, l_linenumber, round(CASE WHEN bin = 'Special' THEN -1 ELSE avg(yc) OVER (PARTITION BY bin) END, 5) AS code FROM own")
def _(spark, d):
    m = fit_2d(spark, d, "continuous")
    return rounded(m.transform(two_columns(spark, d), "xq", "l_discount", "code", metric_special=-1, metric_missing="empirical").select(*KEY, "code"), 5)


@query("model2d_saved", f"{BINARY_2D} {q.TABLE_ROWS}")
def _(spark, d):
    return rounded(stored(fit_2d(spark, d, monotonic_trend_x="ascending"), Model2D).binning_table(spark, show_bin_xy=True))


# ---------------------------------------------------------------- stored models and files


def stored(model, kind=BinningModel):
    """The model, written as JSON by the driver and read again."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "model.json")
        model.to_json(path)
        return kind.read_json(path)


@query("model_saved", q.SQL["binary_table_special_missing"])
def _(spark, d):
    return q.model_table(stored(q.fixed_binner(special_codes=[-9999, -8888]).fit(q.lines(spark, d), "x", "y1")), spark)


@query("model_saved_continuous", q.SQL["continuous_table"])
def _(spark, d):
    b = ContinuousBinner(user_splits=SPLITS, user_splits_fixed=[True] * 5, monotonic_trend=None, special_codes=[-9999, -8888])
    return q.model_table(stored(b.fit(q.lines(spark, d), "x", "yc")), spark, sum=2, std=3, mean=5, woe=4, iv=4)


@query("model_saved_multiclass", q.SQL["multiclass_table"])
def _(spark, d):
    return q.model_table(stored(q.multiclass_model(spark, d)), spark)


@query("model_from_dict", q.SQL["user_splits_table"])
def _(spark, d):
    return q.model_table(BinningModel.from_dict(q.fixed_binner().fit(q.lines(spark, d), "l_extendedprice", "y1").to_dict()), spark)


@query("process_saved", q.SQL["process_summary"])
def _(spark, d):
    with tempfile.TemporaryDirectory() as folder:
        q.process().fit(q.lines(spark, d), "y1").save(os.path.join(folder, "p.json"))
        p = BinningPipeline.load(os.path.join(folder, "p.json"))
    return rounded(p.summary(spark).select("name", "n_bins", "iv", "js"))


@query("process_from_models", q.SQL["process_summary"])
def _(spark, d):
    models = q.process().fit(q.lines(spark, d), "y1").models
    return rounded(q.process().fit_from_dict(models).summary(spark).select("name", "n_bins", "iv", "js"))


@query("scorecard_saved", q.SQL["scorecard_score"])
def _(spark, d):
    with tempfile.TemporaryDirectory() as folder:
        q.card(spark, d, scaling_method="pdo_odds", scaling_method_params=q.PDO).save(os.path.join(folder, "card"))
        c = Scorecard.load(os.path.join(folder, "card"))
    return rounded(c.score(q.lines(spark, d)).select(*KEY, "score"), 5)


DISK = {"l_extendedprice": SPLITS, "l_quantity": q.QSPLITS}


def disk_process() -> BinningPipeline:
    fit = {v: {"user_splits": s, "user_splits_fixed": [True] * len(s), "monotonic_trend": None} for v, s in DISK.items()}
    return BinningPipeline(list(DISK), binning_fit_params=fit)


def disk_sql(v: str) -> str:
    return f"round(avg(l_discount) OVER (PARTITION BY {case(v, DISK[v])}), 6) AS {v}"


@query("disk_fit_transform", f"SELECT {', '.join(disk_sql(v) for v in DISK)} FROM lineitem")
def _(spark, d):
    path = f"{d}/lineitem.parquet"
    p = fit_disk(spark, disk_process(), path, "l_discount")
    return rounded(p.transform(read_table(spark, path, list(DISK)), metric="mean"))


# ---------------------------------------------------------------- measures and tests

_clean = f"WITH {q.counts_sql(L, q.bin_sql('l_extendedprice', SPLITS), 'y1', [*LABELS, 'Special', 'Missing'])}, {q.TABLE_SQL}"
HHI = "sum(n * n / CAST(tn * tn AS DOUBLE))"
B = stats.BEST_IV


@query("analysis_quality", f"""{_clean}, s AS (SELECT sum(iv) AS iv, sum(n * n / CAST((te + tne) * (te + tne) AS DOUBLE)) AS hhi, count(*) AS m FROM v)
SELECT 'ascending' AS trend, round(iv / {B} * exp(0.5 * (1 - (iv / {B}) * (iv / {B}))) * (1 - (hhi - 1.0 / m) / (1 - 1.0 / m)), 5) AS quality_score FROM s""")
def _(spark, d):
    out, _ = q.fixed_binner().fit(q.lines(spark, d), "l_extendedprice", "y1").table().analysis()
    return rounded(spark.createDataFrame([(out["trend"], float(out["quality_score"]))], "trend string, quality_score double"), 5)


@query("divergence_terms", f"{_clean} SELECT bin, round(CASE WHEN p > 0 THEN p * ln(p / q) END, 8) AS kl, round(0.5 * (sqrt(p) - sqrt(q)) * (sqrt(p) - sqrt(q)), 8) AS hellinger, round((p - q) * (p - q) / (p + q), 8) AS triangular FROM v WHERE n > 0")
def _(spark, d):
    t = q.fixed_binner().fit(q.lines(spark, d), "l_extendedprice", "y1").table()
    used = t.records > 0
    p, r = t.p[used], t.q[used]
    rows = zip([x for x, u in zip(t.labels, used, strict=True) if u], *(map(float, f(p, r)) for f in (stats.kullback_leibler, stats.hellinger, stats.triangular)), strict=True)
    return rounded(spark.createDataFrame(list(rows), "bin string, kl double, hellinger double, triangular double"), 8)


_plogp = lambda x: f"CASE WHEN {x} > 0 THEN -({x}) * ln({x}) ELSE 0 END"


@query("multiclass_metrics", f"""WITH src AS ({L}), g AS (SELECT {q.bin_sql('x', q.MULTI, q.CODES)} AS bin, CAST(count(*) AS DOUBLE) AS n, {', '.join(f"CAST(count(*) FILTER (ym = {c}) AS DOUBLE) AS a{c}" for c in range(3))} FROM src GROUP BY 1),
t AS (SELECT *, sum(n) OVER () AS tn, {', '.join(f"a{c} / sum(a{c}) OVER () AS p{c}" for c in range(3))} FROM g), m AS (SELECT *, (p0 + p1 + p2) / 3 AS pm FROM t),
k AS (SELECT *, sum(n) OVER () AS cn, {', '.join(f"sum(a{c}) OVER () AS s{c}" for c in range(3))} FROM g WHERE bin NOT IN ('Special', 'Missing')),
x AS (SELECT sum({' + '.join(f"(a{c} - n * s{c} / cn) * (a{c} - n * s{c} / cn) / (n * s{c} / cn)" for c in range(3))}) AS chi, max(cn) AS cn FROM k), s AS (SELECT sum({_plogp('pm')}) - sum({' + '.join(_plogp(f'p{c}') for c in range(3))}) / 3 AS js, sum(n / tn * n / tn) AS hhi, count(*) AS m FROM m)
SELECT round(js, 6) AS js, round(hhi, 6) AS hhi, round((hhi - 1.0 / m) / (1 - 1.0 / m), 6) AS hhi_norm, round(sqrt(chi / cn / 2), 6) AS cramer_v FROM s, x""")
def _(spark, d):
    m = q.multiclass_model(spark, d).table().metrics()
    return rounded(spark.createDataFrame([tuple(float(v) for v in m.values())], ", ".join(f"{k} double" for k in m)))


@query("continuous_metrics", f"""WITH g AS (SELECT {case('l_extendedprice', SPLITS)} AS i, CAST(count(*) AS DOUBLE) AS n, sum(yc) AS s FROM ({L}) GROUP BY 1), t AS (SELECT *, abs(s / n - sum(s) OVER () / sum(n) OVER ()) AS w, n / sum(n) OVER () AS share FROM g)
SELECT round(sum(w * share), 4) AS iv, round(sum(w), 4) AS woe, round(sum(share * share), 6) AS hhi, round((sum(share * share) - 1.0 / 8) / (1 - 1.0 / 8), 6) AS hhi_norm FROM t""")
def _(spark, d):
    b = ContinuousBinner(user_splits=SPLITS, user_splits_fixed=[True] * 5, monotonic_trend=None)
    m = b.fit(q.lines(spark, d), "l_extendedprice", "yc").table().metrics()
    return rounded(spark.createDataFrame([tuple(float(v) for v in m.values())], ", ".join(f"{k} double" for k in m)), iv=4, woe=4)


WELCH = f"""WITH g AS (SELECT {{key}} AS i, CAST(count(*) AS DOUBLE) AS n, avg(yc) AS m, var_pop(yc) AS v FROM ({L}) GROUP BY 1)
SELECT CAST(a.i AS BIGINT) AS bin_a, CAST(b.i AS BIGINT) AS bin_b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 3) AS statistic FROM g a JOIN g b ON b.i = a.i + 1"""


@query("welch_neighbours", WELCH.format(key=case("l_extendedprice", SPLITS)))
def _(spark, d):
    b = ContinuousBinner(user_splits=SPLITS, user_splits_fixed=[True] * 5, monotonic_trend=None)
    _, tests = b.fit(q.lines(spark, d), "l_extendedprice", "yc").table().analysis()
    return rounded(as_frame(spark, tests[["bin_a", "bin_b", "statistic"]]), 3)


_fisher_p = lambda x: f"exp(lgamma(col + 1) - lgamma({x} + 1) - lgamma(col - ({x}) + 1) + lgamma(n - col + 1) - lgamma(rw - ({x}) + 1) - lgamma(n - col - rw + ({x}) + 1) - lgamma(n + 1) + lgamma(rw + 1) + lgamma(n - rw + 1))"


@query("binning_analysis", f"""WITH src AS ({L}), g AS (SELECT {case('l_extendedprice', q.CLOSE)} AS i, CAST(count(*) FILTER (y1 = 0) AS DOUBLE) AS ne, CAST(count(*) FILTER (y1 <> 0) AS DOUBLE) AS e FROM src GROUP BY 1),
t AS (SELECT a.i AS bin_a, b.i AS bin_b, a.ne AS a, a.e AS b, b.ne AS c, b.e AS d, a.ne + a.e AS rw, a.ne + b.ne AS col, a.ne + a.e + b.ne + b.e AS n FROM g a JOIN g b ON b.i = a.i + 1 WHERE a.i BETWEEN 2 AND 4),
x AS (SELECT *, {_fisher_p('a')} AS own, unnest(range(CAST(greatest(0, rw + col - n) AS BIGINT), CAST(least(rw, col) AS BIGINT) + 1)) AS k FROM t)
SELECT CAST(bin_a AS BIGINT) AS bin_a, CAST(bin_b AS BIGINT) AS bin_b, round(any_value(a * d / (b * c)), 6) AS statistic, round(sum(CASE WHEN {_fisher_p('k')} <= own * 1.0000001 THEN {_fisher_p('k')} ELSE 0 END), 5) AS p_value FROM x GROUP BY 1, 2""")
def _(spark, d):
    _, tests = q.fixed_binner(q.CLOSE).fit(q.lines(spark, d), "l_extendedprice", "y1").table().analysis("fisher")
    return rounded(as_frame(spark, tests[tests["bin_a"].between(2, 4)][["bin_a", "bin_b", "statistic", "p_value"]]), p_value=5)


# ---------------------------------------------------------------- scorecards, monitoring, processes


@query("scorecard_rounded", f"{q.CARD} SELECT variable, bin, CAST(round_even({q.PDO_POINTS}, 0) AS DOUBLE) AS points FROM pts")
def _(spark, d):
    return q.card(spark, d, scaling_method="pdo_odds", scaling_method_params=q.PDO, rounding=True).table(spark=spark)


@query("scorecard_transform", f"""{q.CARD}, s AS (SELECT variable, bin, {q.PDO_POINTS} AS p FROM pts)
SELECT l_orderkey, l_linenumber, round(a.p, 5) AS l_extendedprice, round(b.p, 5) AS l_quantity FROM base JOIN s a ON a.variable = 'l_extendedprice' AND a.bin = {q.bin_sql('l_extendedprice', SPLITS)} JOIN s b ON b.variable = 'l_quantity' AND b.bin = {q.bin_sql('l_quantity', q.QSPLITS)}""")
def _(spark, d):
    return rounded(q.card(spark, d, scaling_method="pdo_odds", scaling_method_params=q.PDO).transform(q.lines(spark, d), keep=KEY), 5)


def monitored(spark, d) -> Monitoring:
    df = q.lines(spark, d)
    return Monitoring(q.card(spark, d)).fit(df.where("l_linenumber % 2 = 0"), df.where("l_linenumber % 2 = 1"), "y1")


def variable_psi_sql() -> str:
    parts = [f"SELECT '{v}' AS variable, CAST({case(v, s)} AS BIGINT) AS bin_id, {q.bin_sql(v, s)} AS bin, l_linenumber % 2 AS side FROM lineitem" for v, s in (("l_extendedprice", SPLITS), ("l_quantity", q.QSPLITS))]
    return f"""WITH r AS ({' UNION ALL '.join(parts)}), g AS (SELECT variable, bin_id, bin, count(*) FILTER (side = 0) AS count_a, count(*) FILTER (side = 1) AS count_e FROM r GROUP BY 1, 2, 3),
t AS (SELECT *, count_a / CAST(sum(count_a) OVER (PARTITION BY variable) AS DOUBLE) AS a, count_e / CAST(sum(count_e) OVER (PARTITION BY variable) AS DOUBLE) AS e FROM g)
SELECT variable, bin_id, bin, count_a, count_e, round((a - e) * ln(a / e), 8) AS psi FROM t"""


@query("monitoring_report", variable_psi_sql())
def _(spark, d):
    return rounded(as_frame(spark, monitored(spark, d).psi_variable_table(style="detailed")), psi=8)


@query("monitoring_variable_summary", f"SELECT variable, round(sum(psi), 7) AS psi FROM ({variable_psi_sql()}) GROUP BY 1")
def _(spark, d):
    return rounded(as_frame(spark, monitored(spark, d).psi_variable_table()), psi=7)


@query("monitoring_target", "WITH g AS (SELECT l_linenumber % 2 AS side, count(*) AS n, sum(y1) AS e FROM (" + L + ") GROUP BY 1), w AS (SELECT max(n) FILTER (side = 0) AS na, max(n) FILTER (side = 1) AS ne, max(e) FILTER (side = 0) AS ea, max(e) FILTER (side = 1) AS ee FROM g) SELECT 'records' AS metric, CAST(na AS BIGINT) AS actual, CAST(ne AS BIGINT) AS expected FROM w UNION ALL SELECT 'event', CAST(ea AS BIGINT), CAST(ee AS BIGINT) FROM w UNION ALL SELECT 'non_event', CAST(na - ea AS BIGINT), CAST(ne - ee AS BIGINT) FROM w")
def _(spark, d):
    return as_frame(spark, monitored(spark, d).target)


def process_sql() -> str:
    parts = [f"{v}_t AS (WITH {q.counts_sql('SELECT * FROM base', q.bin_sql(v, s), 'y1', [*interval_labels(s), 'Special', 'Missing'])}, {q.TABLE_SQL} SELECT bin, woe FROM v)" for v, s in q.FOUR_SPLITS.items()]
    joins = " ".join(f"JOIN {v}_t ON {v}_t.bin = {q.bin_sql(v, s)}" for v, s in q.FOUR_SPLITS.items())
    return f"WITH base AS ({L}), {', '.join(parts)} SELECT l_orderkey, l_linenumber, {', '.join(f'round({v}_t.woe, 6) AS {v}' for v in q.FOUR)} FROM base {joins}"


@query("process_transform", process_sql())
def _(spark, d):
    df = q.lines(spark, d)
    return rounded(q.process().fit(df, "y1").transform(df, keep=KEY, metric="woe", metric_missing="empirical"))


@query("process_fit_transform", process_sql())
def _(spark, d):
    return rounded(q.process().fit_transform(q.lines(spark, d), "y1", keep=KEY, metric="woe", metric_missing="empirical"))


# ---------------------------------------------------------------- streams

FLAGS = ["A", "N", "R"]


@query("streaming_binning", q.binary_table_sql(L, "'[' || l_returnflag || ']'", "y1", [*(f"[{x}]" for x in FLAGS), "Special", "Missing"]))
def _(spark, d):
    b = StreamingBinner(spark, {"l_returnflag": "categorical"}, "y1", user_splits=FLAGS, user_splits_fixed=[True] * 3)
    for c in q.chunks(spark, d):
        b.add(c)
    return rounded(b.solve().get_binned_variable("l_returnflag").binning_table(spark))


@query("sketch_quantiles", "SELECT CAST(i AS DOUBLE) / 10 AS q, true AS within FROM range(1, 10) t(i)")
def _(spark, d):
    """Whether the rank of each quantile of merged sketches is right to 1 %."""
    df = q.lines(spark, d)
    state = merge_states(*[chunk_state(c, {"l_extendedprice": True}, "y1") for c in q.chunks(spark, d)])
    shares = [i / 10 for i in range(1, 10)]
    found = sketch_quantiles(state, "l_extendedprice", shares)
    ranks = df.agg(*[F.avg((F.col("l_extendedprice") <= v).cast("double")).alias(f"r{i}") for i, v in enumerate(found)]).first()
    return spark.createDataFrame([(s, abs(ranks[f"r{i}"] - s) <= 0.01) for i, s in enumerate(shares)], "q double, within boolean")


@query("streaming_numeric_error", "SELECT 'l_extendedprice' AS variable, true AS within")
def _(spark, d):
    """Whether the divergence of streamed bins is that of the same bins counted exactly to 1 %."""
    b = StreamingBinner(spark, {"l_extendedprice": "numerical"}, "y1")
    for c in q.chunks(spark, d):
        b.add(c)
    m = b.solve().get_binned_variable("l_extendedprice")
    exact = q.fixed_binner(m.splits).fit(q.lines(spark, d), "l_extendedprice", "y1").table().metrics()["iv"]
    return spark.createDataFrame([("l_extendedprice", bool(abs(m.table().metrics()["iv"] - exact) <= 0.01 * exact))], "variable string, within boolean")


# ---------------------------------------------------------------- piecewise

LINES = f"b AS (SELECT *, {case('l_extendedprice', q.PIECE_SPLITS)} AS i FROM ({L})), f AS (SELECT i, regr_slope(yc, l_extendedprice) AS s, regr_intercept(yc, l_extendedprice) AS c FROM b GROUP BY i)"


def line_binner(kind: str = "continuous", **options) -> PiecewiseBinner:
    return PiecewiseBinner(kind=kind, continuous=False, user_splits=q.PIECE_SPLITS, user_splits_fixed=[True, True], monotonic_trend=None, **options)


@query("piecewise_table", f"""WITH {LINES}, g AS (SELECT i, count(*) AS n FROM b GROUP BY 1)
SELECT list_extract([{', '.join(q.quoted(interval_labels(q.PIECE_SPLITS)))}], i + 1) AS bin, n AS "count", round(c, 3) AS c0, round(s, 8) AS c1 FROM f JOIN g USING (i) UNION ALL SELECT unnest(['Special', 'Missing']), 0, NULL, NULL""")
def _(spark, d):
    t = line_binner().fit(q.lines(spark, d), "l_extendedprice", "yc").binning_table(spark)
    return rounded(t.select("bin", "count", "c0", "c1"), c0=3, c1=8)


@query("piecewise_metrics", f"""WITH {LINES}, x AS (SELECT yc AS a, yc - (c + s * l_extendedprice) AS e FROM b JOIN f USING (i))
SELECT round(avg(abs(e)), 3) AS mae, round(avg(e * e), 0) AS mse, round(1 - sum(e * e) / (count(*) * var_pop(a)), 6) AS r2 FROM x""")
def _(spark, d):
    df = q.lines(spark, d)
    return rounded(line_binner().fit(df, "l_extendedprice", "yc").metrics(df, "l_extendedprice", "yc").select("mae", "mse", "r2"), mae=3, mse=0)


SLOPE, LEVEL = 2.0, -0.3
CURVE = f"""u AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd FROM lineitem), b AS (SELECT l.*, {case('l_extendedprice', q.PIECE_SPLITS)} AS i, 1 / (1 + exp(-({LEVEL} + {SLOPE} * (l_extendedprice - m) / sd))) AS t FROM ({L}) l, u),
f AS (SELECT i, regr_slope(t, l_extendedprice) AS s, regr_intercept(t, l_extendedprice) AS c FROM b GROUP BY i), r AS (SELECT b.*, greatest(0.0, least(1.0, c + s * l_extendedprice)) AS rate FROM b JOIN f USING (i))"""


@query("piecewise_binary_transform", f"WITH {CURVE} SELECT l_orderkey, l_linenumber, round(rate, 6) AS event_rate, round(ln((1 / least(greatest(rate, 1e-9), 1 - 1e-9) - 1) * (SELECT sum(y1) / CAST(sum(1 - y1) AS DOUBLE) FROM b)), 5) AS woe FROM r")
def _(spark, d):
    df = q.lines(spark, d)
    m = line_binner("binary", estimator=FixedModel([SLOPE], LEVEL)).fit(df, "l_extendedprice", "y1")
    return rounded(df.select(*KEY, m.encode(F.col("l_extendedprice"), "event_rate").alias("event_rate"), m.encode(F.col("l_extendedprice"), "woe").alias("woe")), woe=5)


@query("piecewise_divergences", f"""WITH {CURVE}, t AS (SELECT rate / sum(rate) OVER () AS a, (1 - rate) / sum(1 - rate) OVER () AS b FROM r)
SELECT round(sum((a - b) * CASE WHEN a > 0 AND b > 0 THEN ln(a / b) ELSE 0 END), 6) AS iv, round(sum(0.5 * (sqrt(a) - sqrt(b)) * (sqrt(a) - sqrt(b))), 6) AS hellinger, round(sum((a - b) * (a - b) / (a + b)), 6) AS triangular FROM t""")
def _(spark, d):
    df = q.lines(spark, d)
    m = line_binner("binary", estimator=FixedModel([SLOPE], LEVEL)).fit(df, "l_extendedprice", "y1")
    return rounded(m.divergences(df.withColumn("_p", m.encode(F.col("l_extendedprice"), "event_rate")), "_p").select("iv", "hellinger", "triangular"))


@query("piecewise_binary_metrics", f"WITH {CURVE} SELECT round(avg((rate - y1) * (rate - y1)), 6) AS brier FROM r")
def _(spark, d):
    df = q.lines(spark, d)
    m = line_binner("binary", estimator=FixedModel([SLOPE], LEVEL)).fit(df, "l_extendedprice", "y1")
    return rounded(m.metrics(df, "l_extendedprice", "y1").select("brier"))



# ---------------------------------------------------------------- default fits of long columns: trees and searches that SQL has no short form of


@query("cart_prebins")
def _(spark, d):
    df = q.lines(spark, d)
    h = q.binned(df, "l_extendedprice", "y1", "binary")
    while True:
        cells: set[int] = set()
        splits = cart_splits(h, "binary", 20, np.ceil(0.05 * h.total), cells)
        if not cells:
            break
        h = refine(h, df, "l_extendedprice", "y1", "binary", np.array(sorted(cells)))
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(splits)], "split_id long, split double")


@query("optimal_binning_default")
def _(spark, d):
    return BinaryBinner(max_pvalue=0.05).fit(q.lines(spark, d), "l_extendedprice", "y1").binning_table(spark)


@query("optimal_binning_continuous_default")
def _(spark, d):
    return ContinuousBinner().fit(q.lines(spark, d), "l_extendedprice", "yc").binning_table(spark)


@query("optimal_binning_multiclass_default")
def _(spark, d):
    return MulticlassBinner().fit(q.lines(spark, d), "l_extendedprice", "ym").binning_table(spark)


@query("optimal_binning_zscore_default")
def _(spark, d):
    return BinaryBinner(outlier_detector="zscore").fit(q.lines(spark, d), "l_extendedprice", "y1").binning_table(spark)


@query("table2d_default")
def _(spark, d):
    return Binner2D(monotonic_trend_x="ascending", monotonic_trend_y="ascending").fit(q.lines(spark, d), "l_extendedprice", "l_quantity", "y1").binning_table(spark)


@query("table2d_cart_default")
def _(spark, d):
    return Binner2D(kind="continuous", strategy="cart").fit(q.lines(spark, d), "l_extendedprice", "l_quantity", "yc").binning_table(spark)


@query("mdlp_splits_quantity")
def _(spark, d):
    return spark.createDataFrame([(float(s),) for s in mdlp_splits(q.binned(q.lines(spark, d), "l_quantity", "y1", "binary"))], "split double")


@query("piecewise_table_default")
def _(spark, d):
    return PiecewiseBinner(kind="continuous", max_n_prebins=6).fit(q.lines(spark, d), "l_extendedprice", "yc").binning_table(spark)


@query("piecewise_metrics_default")
def _(spark, d):
    df = q.lines(spark, d)
    return PiecewiseBinner(max_n_prebins=8).fit(df, "l_extendedprice", "y1").metrics(df, "l_extendedprice", "y1")


@query("scorecard_rounded_min_max")
def _(spark, d):
    return q.card(spark, d, scaling_method="min_max", scaling_method_params={"min": 300, "max": 850}, rounding=True).table(spark=spark)

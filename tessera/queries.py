"""One query per operator over the driver's tables, and the DuckDB SQL with the same rows.

Targets with signal are derived from lineitem, orders, part and events.  Doubles are
rounded in both places, since sums depend on their order in the last digits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import stats
from .operators import evaluate
from .operators.binning import BinaryBinner, BinningModel, ContinuousBinner, MulticlassBinner, ScenarioBinner
from .operators.binning2d import Axis, Binner2D, grid_moments
from .operators.counterfactual import Counterfactual
from .operators.encode import by_interval, rate_to_woe, woe_to_rate
from .operators.histogram import Histogram, cell_edges, histogram, refine
from .operators.monitoring import psi_table
from .operators.piecewise import PiecewiseBinner
from .operators.process import BinningPipeline
from .operators.rows import is_outlier, range_bounds, within, y_quantile_bounds, zscore_bounds
from .operators.scorecard import FixedModel, Scorecard
from .operators.splits import cart_splits, mdlp_candidates, mdlp_splits, quantile_cells, quantile_splits, uniform_splits
from .operators.tables import as_frame, interval_labels
from .plans.trend import label, trend_changes
from .streaming.sketch import StreamingBinner, chunk_state, merge_states, progress_band, sketch_quantiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Derived targets (F1 to F4), and x with missing and special values (F5).
TARGETS = {
    "y1": "CAST(l_extendedprice*(1-l_discount) + 1500*l_quantity > 95000 AS INT)",
    "y2": "CAST(abs(l_extendedprice-52500) + 700*l_quantity < 40000 AS INT)",
    "yc": "l_extendedprice*(1-l_discount)*(1+l_tax)",
    "ym": "CASE WHEN l_extendedprice+1000*l_quantity < 60000 THEN 0 WHEN l_extendedprice+1000*l_quantity < 95000 THEN 1 ELSE 2 END",
    "x": "CASE WHEN l_linenumber = 6 THEN NULL WHEN l_linenumber = 7 THEN CAST(-9999 AS DOUBLE) WHEN l_linenumber = 5 THEN CAST(-8888 AS DOUBLE) ELSE l_extendedprice END",
    "w": "1 + l_linenumber % 2",
}
SPLITS = [25000.0, 40000.0, 55000.0, 70000.0, 90000.0]
NINE = [22000.0, 30000.0, 40000.0, 50000.0, 60000.0, 70000.0, 80000.0, 90000.0]
MULTI = [47000.0, 57000.0]
L = "SELECT *, " + ", ".join(f"{sql} AS {name}" for name, sql in TARGETS.items()) + " FROM lineitem"
ORDERS = "SELECT *, CAST(o_totalprice + 20000*ascii(o_orderpriority) > 1270000 AS INT) AS y FROM orders"
PARTS = "SELECT *, CAST(p_retailprice + 10*p_size > 1200 AS INT) AS y FROM part"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "lineitem")
    return df.select("*", *[F.expr(sql).alias(name) for name, sql in TARGETS.items()])


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").withColumn("y", (F.col("o_totalprice") + 20000 * F.ascii("o_orderpriority") > 1270000).cast("int"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").withColumn("y", (F.col("p_retailprice") + 10 * F.col("p_size") > 1200).cast("int"))


def binned(df: DataFrame, x: str, y: str, kind: str) -> Histogram:
    """The histogram of a numeric column, by cells if it is long."""
    return histogram(df, x, y, kind, edges=cell_edges(df, x))


def split_counts(df: DataFrame, x: str, y: str, kind: str, splits) -> tuple[dict[str, np.ndarray], float]:
    """Moments of the bins at fixed splits, counted by them at every size, and the weight of all rows."""
    h = histogram(df, x, y, kind, edges=[-np.inf, *splits, np.inf])
    return h.by_split(splits), h.total


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    return df.select(*[F.round(c, own.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits})"


# ---------------------------------------------------------------- SQL of bins and tables


def case(x: str, splits, labels=None) -> str:
    """SQL of the bin of x."""
    labels = labels or [str(i) for i in range(len(splits) + 1)]
    return "CASE " + " ".join(f"WHEN {x} < {s} THEN {v}" for s, v in zip(splits, labels, strict=False)) + f" ELSE {labels[-1]} END"


def quoted(values) -> list[str]:
    return ["'" + str(v).replace("'", "''") + "'" for v in values]


def bin_sql(x: str, splits, specials: dict[str, list[float]] | None = None) -> str:
    """SQL of the row of a table that a value belongs to."""
    special = "".join(f"WHEN {x} IN ({', '.join(map(str, c))}) THEN '{k}' " for k, c in (specials or {}).items())
    return f"CASE WHEN {x} IS NULL THEN 'Missing' {special}ELSE {case(x, splits, quoted(interval_labels(splits)))} END"


def counts_sql(source: str, key: str, y: str, rows: list[str], n0: str = "count(*) FILTER ({y} = 0)", n1: str = "count(*) FILTER ({y} <> 0)") -> str:
    """``c(bin, ne, e)`` with a row for each of ``rows``."""
    values = ", ".join(f"({q})" for q in quoted(rows))
    return (
        f"src AS ({source}), g AS (SELECT {key} AS bin, {n0.format(y=y)} AS ne, {n1.format(y=y)} AS e FROM src GROUP BY 1), names(bin) AS (VALUES {values}), "
        "c AS (SELECT bin, CAST(coalesce(ne, 0) AS BIGINT) AS ne, CAST(coalesce(e, 0) AS BIGINT) AS e FROM names LEFT JOIN g USING (bin))"
    )


TABLE_SQL = (
    "t AS (SELECT *, ne + e AS n, sum(ne) OVER () AS tne, sum(e) OVER () AS te FROM c), "
    "p AS (SELECT *, CASE WHEN n > 0 THEN CAST(e AS DOUBLE) / n ELSE 0 END AS rate, CAST(e AS DOUBLE) / te AS p, CAST(ne AS DOUBLE) / tne AS q FROM t), "
    "v AS (SELECT *, CASE WHEN e > 0 AND ne > 0 THEN ln(q / p) ELSE 0 END AS woe, CASE WHEN e > 0 AND ne > 0 THEN (p - q) * ln(p / q) ELSE 0 END AS iv, "
    "CASE WHEN e > 0 AND ne > 0 THEN (p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2 ELSE 0 END AS js FROM p)"
)
TABLE_ROWS = (
    'SELECT bin, CAST(n AS BIGINT) AS "count", round(CAST(n AS DOUBLE) / (tne + te), 6) AS count_pct, CAST(ne AS BIGINT) AS non_event, CAST(e AS BIGINT) AS event, '
    "round(rate, 6) AS event_rate, round(woe, 6) AS woe, round(iv, 6) AS iv, round(js, 6) AS js FROM v "
    "UNION ALL SELECT 'Totals', CAST(sum(n) AS BIGINT), 1.0, CAST(sum(ne) AS BIGINT), CAST(sum(e) AS BIGINT), round(CAST(sum(e) AS DOUBLE) / sum(n), 6), NULL, round(sum(iv), 6), round(sum(js), 6) FROM v"
)


def binary_table_sql(source: str, key: str, y: str, rows: list[str], **counts: str) -> str:
    return f"WITH {counts_sql(source, key, y, rows, **counts)}, {TABLE_SQL} {TABLE_ROWS}"


def fixed_binner(splits=SPLITS, **options) -> BinaryBinner:
    """Bins at the given splits, none merged."""
    return BinaryBinner(user_splits=list(splits), user_splits_fixed=[True] * len(splits), monotonic_trend=None, **options)


def model_table(model: BinningModel, spark: SparkSession, **own: int) -> DataFrame:
    return rounded(model.binning_table(spark), **own)


LABELS = interval_labels(SPLITS)
CODES = {"Special": [-9999, -8888]}
DICT = {"refused": [-9999], "unknown": [-8888]}


# ---------------------------------------------------------------- tables


@query("user_splits_table", binary_table_sql(L, bin_sql("l_extendedprice", SPLITS), "y1", [*LABELS, "Special", "Missing"]))
def _(spark, d):
    return model_table(fixed_binner().fit(lines(spark, d), "l_extendedprice", "y1"), spark)


@query("binary_table_special_missing", binary_table_sql(L, bin_sql("x", SPLITS, CODES), "y1", [*LABELS, "Special", "Missing"]))
def _(spark, d):
    return model_table(fixed_binner(special_codes=[-9999, -8888]).fit(lines(spark, d), "x", "y1"), spark)


@query("special_dict_table", binary_table_sql(L, bin_sql("x", SPLITS, DICT), "y1", [*LABELS, *DICT, "Missing"]))
def _(spark, d):
    return model_table(fixed_binner(special_codes=DICT).fit(lines(spark, d), "x", "y1"), spark)


@query("weighted_counts", binary_table_sql(L, bin_sql("l_extendedprice", SPLITS), "y1", [*LABELS, "Special", "Missing"], n0="sum(w) FILTER ({y} = 0)", n1="sum(w) FILTER ({y} <> 0)"))
def _(spark, d):
    return model_table(fixed_binner().fit(lines(spark, d), "l_extendedprice", "y1", "w"), spark)


@query("class_weight_counts", binary_table_sql(L, bin_sql("l_extendedprice", SPLITS), "y1", [*LABELS, "Special", "Missing"], n0="2 * count(*) FILTER ({y} = 0)", n1="3 * count(*) FILTER ({y} <> 0)"))
def _(spark, d):
    return model_table(fixed_binner(class_weight={0: 2, 1: 3}).fit(lines(spark, d), "l_extendedprice", "y1"), spark)


def continuous_sql(source: str, key: str, y: str, rows: list[str]) -> str:
    values = ", ".join(f"({q})" for q in quoted(rows))
    return f"""WITH src AS ({source}), g AS (SELECT {key} AS bin, count(*) AS n, sum({y}) AS s, stddev_pop({y}) AS sd, min({y}) AS a, max({y}) AS b, count(*) FILTER ({y} = 0) AS z FROM src GROUP BY 1),
names(bin) AS (VALUES {values}), c AS (SELECT bin, coalesce(n, 0) AS n, coalesce(s, 0) AS s, sd, a, b, coalesce(z, 0) AS z FROM names LEFT JOIN g USING (bin)),
t AS (SELECT *, CASE WHEN n > 0 THEN s / n ELSE 0 END AS m, sum(n) OVER () AS tn, sum(s) OVER () AS ts FROM c),
v AS (SELECT *, CASE WHEN n > 0 THEN m - ts / tn ELSE 0 END AS woe FROM t)
SELECT bin, CAST(n AS BIGINT) AS "count", round(CAST(n AS DOUBLE) / tn, 6) AS count_pct, round(s, 2) AS "sum", round(sd, 3) AS std, round(m, 5) AS mean, round(a, 6) AS "min", round(b, 6) AS "max",
    CAST(z AS BIGINT) AS zeros_count, round(woe, 4) AS woe, round(abs(woe) * n / tn, 4) AS iv FROM v
UNION ALL SELECT 'Totals', CAST(sum(n) AS BIGINT), 1.0, round(sum(s), 2), NULL, round(sum(s) / sum(n), 5), round(min(a), 6), round(max(b), 6), CAST(sum(z) AS BIGINT), round(sum(abs(woe)), 4), round(sum(abs(woe) * n / tn), 4) FROM v"""


@query("continuous_table", continuous_sql(L, bin_sql("x", SPLITS, CODES), "yc", [*LABELS, "Special", "Missing"]))
def _(spark, d):
    b = ContinuousBinner(user_splits=SPLITS, user_splits_fixed=[True] * 5, monotonic_trend=None, special_codes=[-9999, -8888])
    return model_table(b.fit(lines(spark, d), "x", "yc"), spark, sum=2, std=3, mean=5, woe=4, iv=4)


def multiclass_sql() -> str:
    values = ", ".join(f"({q})" for q in quoted([*interval_labels(MULTI), "Special", "Missing"]))
    n = ", ".join(f"count(*) FILTER (ym = {c}) AS n{c}" for c in range(3))
    return f"""WITH src AS ({L}), g AS (SELECT {bin_sql("x", MULTI, CODES)} AS bin, count(*) AS n, {n} FROM src GROUP BY 1), names(bin) AS (VALUES {values}),
c AS (SELECT bin, coalesce(n, 0) AS n, {", ".join(f"coalesce(n{c}, 0) AS n{c}" for c in range(3))} FROM names LEFT JOIN g USING (bin)),
u AS (SELECT * FROM c UNION ALL SELECT 'Totals', sum(n), sum(n0), sum(n1), sum(n2) FROM c)
SELECT bin, CAST(n AS BIGINT) AS "count", round(CAST(n AS DOUBLE) / (SELECT sum(n) FROM c), 6) AS count_pct, {", ".join(f"CAST(n{c} AS BIGINT) AS event_{c}" for c in range(3))},
{", ".join(f"round(CASE WHEN n > 0 THEN CAST(n{c} AS DOUBLE) / n ELSE 0 END, 6) AS event_rate_{c}" for c in range(3))} FROM u"""


def multiclass_model(spark, d) -> BinningModel:
    b = MulticlassBinner(user_splits=MULTI, user_splits_fixed=[True, True], monotonic_trend=None, special_codes=[-9999, -8888])
    return b.fit(lines(spark, d), "x", "ym")





@query("multiclass_table", multiclass_sql())
def _(spark, d):
    return model_table(multiclass_model(spark, d), spark)


# ---------------------------------------------------------------- encoding


KEY = ["l_orderkey", "l_linenumber"]


def encode_sql(value: str, extra: str = "") -> str:
    """Encoding of x by the table with special codes; ``value`` is over v joined to the rows."""
    table = f"{counts_sql(L, bin_sql('x', SPLITS, CODES), 'y1', [*LABELS, 'Special', 'Missing'])}, {TABLE_SQL}"
    return f"WITH {table}{extra}, rows AS (SELECT *, {bin_sql('x', SPLITS, CODES)} AS own FROM src) SELECT l_orderkey, l_linenumber, {value} AS code FROM rows JOIN v ON v.bin = rows.own"


def encoded(spark, d, **kwargs) -> DataFrame:
    df = lines(spark, d)
    model = fixed_binner(special_codes=[-9999, -8888]).fit(df, "x", "y1")
    return rounded(df.select(*KEY, model.encode(F.col("x"), **kwargs).alias("code")))


ZERO = "CASE WHEN own IN ('Special', 'Missing') THEN 0 ELSE {} END"
INDEX = "CASE own " + " ".join(f"WHEN {q} THEN {i}" for i, q in enumerate(quoted([*LABELS, "Special", "Missing"]))) + " END"


@query("woe_transform", encode_sql(r(ZERO.format("woe"))))
def _(spark, d):
    return encoded(spark, d, metric="woe")


@query("event_rate_transform", encode_sql(r(ZERO.format("rate"))))
def _(spark, d):
    return encoded(spark, d, metric="event_rate")


@query("indices_transform", encode_sql(f"CAST({ZERO.format(INDEX)} AS INT)"))
def _(spark, d):
    return encoded(spark, d, metric="indices")


@query("bins_transform", encode_sql("own"))
def _(spark, d):
    return encoded(spark, d, metric="bins")


@query("empirical_special_missing_transform", encode_sql(r("woe")))
def _(spark, d):
    return encoded(spark, d, metric="woe", metric_special="empirical", metric_missing="empirical")


@query("continuous_transform", f"""WITH src AS ({L}), rows AS (SELECT *, {bin_sql('x', SPLITS, CODES)} AS own FROM src)
SELECT l_orderkey, l_linenumber, round(CASE WHEN own = 'Special' THEN -1 ELSE avg(yc) OVER (PARTITION BY own) END, 5) AS code FROM rows""")
def _(spark, d):
    df = lines(spark, d)
    b = ContinuousBinner(user_splits=SPLITS, user_splits_fixed=[True] * 5, monotonic_trend=None, special_codes=[-9999, -8888])
    code = b.fit(df, "x", "yc").encode(F.col("x"), "mean", -1, "empirical")
    return rounded(df.select(*KEY, code.alias("code")), 5)


def multi_woe_sql(weighted: bool) -> str:
    woe = lambda c: f"CASE WHEN n{c} > 0 AND n > n{c} THEN ln((CAST(n - n{c} AS DOUBLE) / (tn - t{c})) / (CAST(n{c} AS DOUBLE) / t{c})) ELSE 0 END"
    value = " + ".join(f"({woe(c)})" + (f" * t{c}" if weighted else "") for c in range(3))
    return f"""WITH src AS ({L}), rows AS (SELECT *, {bin_sql('x', MULTI, CODES)} AS own FROM src),
g AS (SELECT own, count(*) AS n, {", ".join(f"count(*) FILTER (ym = {c}) AS n{c}" for c in range(3))} FROM rows GROUP BY 1),
t AS (SELECT *, sum(n) OVER () AS tn, {", ".join(f"sum(n{c}) OVER () AS t{c}" for c in range(3))} FROM g), v AS (SELECT own, ({value}) / {"tn" if weighted else "3"} AS code FROM t)
SELECT l_orderkey, l_linenumber, round(CASE WHEN own IN ('Special', 'Missing') THEN 0 ELSE code END, 6) AS code FROM rows JOIN v USING (own)"""


@query("mean_woe_transform", multi_woe_sql(False))
def _(spark, d):
    return rounded(lines(spark, d).select(*KEY, multiclass_model(spark, d).encode(F.col("x"), "mean_woe").alias("code")))


@query("weighted_mean_woe_transform", multi_woe_sql(True))
def _(spark, d):
    return rounded(lines(spark, d).select(*KEY, multiclass_model(spark, d).encode(F.col("x"), "weighted_mean_woe").alias("code")))


@query("rate_woe_conversion", f"""WITH t AS (SELECT CAST(sum(y1) AS DOUBLE) AS e, CAST(sum(1 - y1) AS DOUBLE) AS ne FROM ({L})), r AS (SELECT l_orderkey, l_linenumber, (l_quantity + 1) / 60 AS rate FROM lineitem)
SELECT l_orderkey, l_linenumber, round(ln((1 / rate - 1) * e / ne), 6) AS woe, round(rate, 6) AS rate FROM r, t""")
def _(spark, d):
    df = lines(spark, d)
    t = df.agg(F.sum("y1").alias("e"), F.sum(1 - F.col("y1")).alias("ne")).first()
    woe = rate_to_woe((F.col("l_quantity") + 1) / 60, t["ne"], t["e"])
    return rounded(df.select(*KEY, woe.alias("woe"), woe_to_rate(woe, t["ne"], t["e"]).alias("rate")))


@query("bound_filter", f"SELECT l_orderkey, l_linenumber FROM ({L}) WHERE x IS NULL OR (x >= 20000 AND x <= 60000)")
def _(spark, d):
    return within(lines(spark, d), "x", 20000, 60000).select(*KEY)


# ---------------------------------------------------------------- categories


@query("categorical_ordering", f"SELECT o_orderpriority AS category, count(*) AS n, round(avg(y), 6) AS event_rate, row_number() OVER (ORDER BY avg(y), o_orderpriority) - 1 AS code FROM ({ORDERS}) GROUP BY 1")
def _(spark, d):
    h = histogram(orders(spark, d), "o_orderpriority", "y", "binary")
    rate = h.moments["n1"] / h.size()
    order = np.lexsort((h.low.astype(str), rate))
    rows = [(str(h.low[i]), int(h.size()[i]), float(rate[i]), k) for k, i in enumerate(order)]
    return rounded(spark.createDataFrame(rows, "category string, n long, event_rate double, code long"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("categorical_table", binary_table_sql(ORDERS, "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '[1-URGENT, 2-HIGH]' WHEN o_orderpriority = '3-MEDIUM' THEN '[3-MEDIUM]' ELSE '[4-NOT SPECIFIED, 5-LOW]' END", "y", ["[1-URGENT, 2-HIGH]", "[3-MEDIUM]", "[4-NOT SPECIFIED, 5-LOW]", "Special", "Missing"]))
def _(spark, d):
    groups = [["1-URGENT", "2-HIGH"], ["3-MEDIUM"], ["4-NOT SPECIFIED", "5-LOW"]]
    b = BinaryBinner(dtype="categorical", user_splits=groups, user_splits_fixed=[True, True, True], monotonic_trend=None)
    return model_table(b.fit(orders(spark, d), "o_orderpriority", "y"), spark)


CUT = f"""WITH src AS ({PARTS}), g AS (SELECT p_brand, count(*) AS n, count(*) FILTER (y <> 0) AS e FROM src GROUP BY 1),
s AS (SELECT *, n < ceil(0.04 * sum(n) OVER ()) AS small FROM g)"""


@query("categorical_cutoff", CUT + " SELECT p_brand AS category, n, e AS event, small AS is_other FROM s")
def _(spark, d):
    b = BinaryBinner(dtype="categorical", cat_cutoff=0.04)
    h = histogram(parts(spark, d), "p_brand", "y", "binary")
    others = set(b._cut_categories(h)[1])
    rows = [(str(c), int(n), int(e), c in others) for c, n, e in zip(h.low, h.size(), h.moments["n1"], strict=True)]
    return spark.createDataFrame(rows, "category string, n long, event long, is_other boolean")


@query("cat_unknown_transform", f"""WITH src AS ({ORDERS}), t AS (SELECT avg(y) AS rate FROM src WHERE o_orderpriority <> '5-LOW')
SELECT o_orderkey, round(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN (SELECT avg(y) FROM src WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
WHEN o_orderpriority = '5-LOW' THEN rate ELSE (SELECT avg(y) FROM src WHERE o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED')) END, 6) AS code FROM src, t""")
def _(spark, d):
    df = orders(spark, d)
    b = BinaryBinner(dtype="categorical", user_splits=[["1-URGENT", "2-HIGH"], ["3-MEDIUM", "4-NOT SPECIFIED"]], user_splits_fixed=[True, True], monotonic_trend=None)
    model = b.fit(df.where("o_orderpriority <> '5-LOW'"), "o_orderpriority", "y")
    return rounded(df.select("o_orderkey", model.encode(F.col("o_orderpriority"), "event_rate").alias("code")))


# ---------------------------------------------------------------- prebins


@query("uniform_prebins", "SELECT i AS split_id, round(a + (b - a) * i / 10, 4) AS split FROM (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem), range(1, 10) t(i)")
def _(spark, d):
    e = _read(spark, d, "lineitem").agg(F.min("l_extendedprice").alias("a"), F.max("l_extendedprice").alias("b")).first()
    return rounded(spark.createDataFrame([(i + 1, float(s)) for i, s in enumerate(uniform_splits(e["a"], e["b"], 10))], "split_id long, split double"), 4)


@query("quantile_prebins", "SELECT i AS split_id, round(list_extract(quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), i), 4) AS split FROM lineitem, range(1, 10) t(i) GROUP BY i")
def _(spark, d):
    df = lines(spark, d)
    h = binned(df, "l_extendedprice", "y1", "binary")
    while len(cells := quantile_cells(h, 10)):
        h = refine(h, df, "l_extendedprice", "y1", "binary", cells)
    return rounded(spark.createDataFrame([(i + 1, float(s)) for i, s in enumerate(quantile_splits(h, 10))], "split_id long, split double"), 4)


@query("cart_first_split", f"""WITH h AS (SELECT CAST(l_quantity AS DOUBLE) AS v, count(*) AS n, sum(y1) AS e FROM ({L}) GROUP BY 1),
c AS (SELECT v, lead(v) OVER o AS nxt, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS n, sum(e) OVER (o ROWS UNBOUNDED PRECEDING) AS e, sum(n) OVER () AS tn, sum(e) OVER () AS te FROM h WINDOW o AS (ORDER BY v)),
g AS (SELECT (v + nxt) / 2 AS split, n - (e * e + (n - e) * (n - e)) / CAST(n AS DOUBLE) + (tn - n) - ((te - e) * (te - e) + (tn - n - te + e) * (tn - n - te + e)) / CAST(tn - n AS DOUBLE) AS impurity FROM c WHERE nxt IS NOT NULL AND n >= ceil(0.05 * tn) AND tn - n >= ceil(0.05 * tn))
SELECT round(split, 4) AS split FROM g ORDER BY impurity, split LIMIT 1""")
def _(spark, d):
    h = binned(lines(spark, d), "l_quantity", "y1", "binary")
    splits = cart_splits(h, "binary", 2, np.ceil(0.05 * h.total))
    return rounded(spark.createDataFrame([(float(s),) for s in splits], "split double"), 4)


DISCOUNT_H = f"h AS (SELECT l_discount AS v, count(*) AS n, sum(y2) AS e FROM ({L}) GROUP BY 1), k AS (SELECT *, lead(v) OVER o AS nv, lead(n) OVER o AS nn, lead(e) OVER o AS ne FROM h WINDOW o AS (ORDER BY v)), cand AS (SELECT (v + nv) / 2 AS split FROM k WHERE nv IS NOT NULL AND NOT ((e = 0 AND ne = 0) OR (e = n AND ne = nn)))"


@query("mdlp_candidates", f"WITH {DISCOUNT_H} SELECT round(split, 4) AS split FROM cand")
def _(spark, d):
    h = binned(lines(spark, d), "l_discount", "y2", "binary")
    return rounded(spark.createDataFrame([(float(s),) for s in mdlp_candidates(h)], "split double"), 4)


@query("mdlp_best_split", f"""WITH {DISCOUNT_H}, s AS (SELECT split, sum(n) FILTER (v < split) AS n1, sum(e) FILTER (v < split) AS e1, sum(n) FILTER (v >= split) AS n2, sum(e) FILTER (v >= split) AS e2 FROM cand, h GROUP BY split),
q AS (SELECT split, n1, n2, e1 / CAST(n1 AS DOUBLE) AS p1, e2 / CAST(n2 AS DOUBLE) AS p2 FROM s)
SELECT round(split, 4) AS split FROM q ORDER BY round(n1 * -(p1 * ln(p1) + (1 - p1) * ln(1 - p1)) + n2 * -(p2 * ln(p2) + (1 - p2) * ln(1 - p2)), 7), split LIMIT 1""")
def _(spark, d):
    # the first split of the recursion is the one whose node is all rows
    h = binned(lines(spark, d), "l_discount", "y2", "binary")
    best, counts = None, np.stack([h.moments["n0"], h.moments["n1"]], axis=1)
    for s in mdlp_candidates(h):
        left, right = counts[h.low < s].sum(axis=0), counts[h.low >= s].sum(axis=0)
        rest = round(sum(p.sum() * stats.entropy(p / p.sum()) for p in (left, right)), 7)
        if best is None or rest < best[0]:
            best = (rest, float(s))
    return rounded(spark.createDataFrame([(best[1],)], "split double"), 4)


FINE = [2000.0, 5000.0, 20000.0, 50000.0, 99000.0]


@query("prebin_refinement", f"""WITH src AS ({L}), g AS (SELECT {case('l_extendedprice', FINE)} AS i, count(*) FILTER (y1 = 0) AS ne, count(*) FILTER (y1 <> 0) AS e FROM src GROUP BY 1),
b AS (SELECT i, coalesce(ne, 0) AS ne, coalesce(e, 0) AS e FROM range({len(FINE) + 1}) t(i) LEFT JOIN g USING (i)),
f AS (SELECT *, ne = 0 OR e = 0 AS pure FROM b),
s AS (SELECT i, ne, e, coalesce(sum(CASE WHEN NOT drop_right THEN 1 ELSE 0 END) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp
    FROM (SELECT *, pure OR (i = {len(FINE) - 1} AND (SELECT pure FROM f WHERE i = {len(FINE)})) AS drop_right FROM f))
SELECT CAST(grp AS BIGINT) AS bin, CAST(sum(ne) AS BIGINT) AS non_event, CAST(sum(e) AS BIGINT) AS event FROM s GROUP BY grp""")
def _(spark, d):
    df = lines(spark, d)
    model = BinaryBinner(user_splits=FINE, monotonic_trend=None).fit(df, "l_extendedprice", "y1")
    n = model.n_bins
    return spark.createDataFrame([(i, int(model.moments["n0"][i]), int(model.moments["n1"][i])) for i in range(n)], "bin long, non_event long, event long")


# ---------------------------------------------------------------- partitions


def partition_sql(y: str, edge: str = "true", first: str = "true", where: str = "true", gamma: str = "0", order: str = "", splits=NINE, source: str = L, x: str = "l_extendedprice") -> str:
    """The best partition by enumerating all: ``edge`` is over p (path, with its last bin) and c (next bin)."""
    n = len(splits)
    return f"""WITH RECURSIVE src AS ({source}), g AS (SELECT {case(x, splits)} AS i, CAST(count(*) FILTER ({y} = 0) AS DOUBLE) AS ne, CAST(count(*) FILTER ({y} <> 0) AS DOUBLE) AS e FROM src GROUP BY 1),
t AS (SELECT sum(ne) AS tne, sum(e) AS te FROM g),
c AS (SELECT a.i AS k, b.i AS i, sum(g.ne) AS ne, sum(g.e) AS e FROM g a JOIN g b ON a.i <= b.i JOIN g ON g.i BETWEEN a.i AND b.i GROUP BY 1, 2),
v AS (SELECT k, i, ne, e, ne + e AS n, CAST(trunc(1000000 * (e / (ne + e))) AS BIGINT) AS d, CAST(trunc(1000000 * ((e / te - ne / tne) * ln((e / te) / (ne / tne)))) AS BIGINT) AS v FROM c, t),
p AS (SELECT i, v AS value, 1 AS bins, d, k, ne, e, n AS small, n AS large, CAST(i AS VARCHAR) AS ends, 0 AS turned FROM v WHERE k = 0 AND ({first})
    UNION ALL SELECT v.i, p.value + v.v, p.bins + 1, v.d, v.k, v.ne, v.e, least(p.small, v.n), greatest(p.large, v.n), p.ends || ',' || v.i, tt.turn FROM p JOIN v ON v.k = p.i + 1 JOIN (VALUES (0), (1)) tt(turn) ON tt.turn >= p.turned WHERE ({edge}) AND ({first}))
SELECT value, CAST(bins AS BIGINT) AS bins, ends FROM (SELECT CAST(value - ({gamma}) AS BIGINT) AS value, bins, ends FROM p WHERE i = {n} AND ({where})) GROUP BY ALL ORDER BY value DESC, bins, ends LIMIT 1"""


NO_TURN = "tt.turn = 0"
ASC = f"{NO_TURN} AND v.d >= p.d"
PEAK = "((p.turned = 0 AND tt.turn = 0 AND v.d >= p.d) OR (p.turned = 0 AND tt.turn = 1) OR (p.turned = 1 AND tt.turn = 1 AND v.d <= p.d))"
VALLEY = PEAK.replace(">= p.d", "~ p.d").replace("<= p.d", ">= p.d").replace("~ p.d", "<= p.d")


def partition(spark, d, y: str = "y1", **options) -> DataFrame:
    bins, total = split_counts(lines(spark, d), "l_extendedprice", y, "binary", NINE)
    b = BinaryBinner(user_splits=NINE, **({"monotonic_trend": None} | options))
    fixed = np.asarray(options["user_splits_fixed"]) if "user_splits_fixed" in options else None
    solution, _ = b._optimise(bins, total, fixed)
    return spark.createDataFrame([(int(solution.value), len(solution.ends), ",".join(map(str, solution.ends)))], "value long, bins long, ends string")


def add_partition(name: str, sql: str, y: str = "y1", **options) -> None:
    query(name, sql)(lambda spark, d: partition(spark, d, y, **options))


add_partition("optimal_unconstrained", partition_sql("y1", NO_TURN))
add_partition("optimal_ascending", partition_sql("y1", ASC), monotonic_trend="ascending")
add_partition("optimal_descending", partition_sql("y2", f"{NO_TURN} AND v.d <= p.d"), "y2", monotonic_trend="descending")
add_partition("optimal_peak", partition_sql("y2", PEAK), "y2", monotonic_trend="peak")
add_partition("optimal_valley", partition_sql("y2", VALLEY), "y2", monotonic_trend="valley")
add_partition("optimal_max_bins", partition_sql("y1", ASC, where="bins <= 4"), monotonic_trend="ascending", max_n_bins=4)
add_partition("optimal_min_bins", partition_sql("y2", f"{NO_TURN} AND v.d <= p.d", where="bins >= 2"), "y2", monotonic_trend="descending", min_n_bins=2)
add_partition("optimal_min_size", partition_sql("y1", NO_TURN, first="v.n >= ceil(0.15 * (SELECT tne + te FROM t))"), min_bin_size=0.15)
add_partition("optimal_max_size", partition_sql("y1", NO_TURN, first="v.n <= ceil(0.3 * (SELECT tne + te FROM t))"), max_bin_size=0.3, max_n_bins=None)
add_partition("optimal_min_events", partition_sql("y1", NO_TURN, first="v.e >= 250"), min_bin_n_event=250)
add_partition("optimal_min_diff", partition_sql("y1", f"{ASC} AND abs(v.d - p.d) >= 150000"), monotonic_trend="ascending", min_event_rate_diff=0.15)
add_partition("optimal_fixed_split", partition_sql("y1", NO_TURN, where="bins <= 3 AND (',' || ends || ',') LIKE '%,2,%'"), max_n_bins=3, user_splits_fixed=[False, False, True, False, False, False, False, False])
Z = "abs(v.e / v.n - p.e / (p.ne + p.e)) / sqrt(((v.e + p.e) / (v.n + p.ne + p.e)) * (1 - (v.e + p.e) / (v.n + p.ne + p.e)) * (1 / v.n + 1 / (p.ne + p.e)))"
add_partition("optimal_max_pvalue", partition_sql("y1", f"{ASC} AND {Z} >= 3.2905267314919255"), monotonic_trend="ascending", max_pvalue=0.001)
add_partition("optimal_gamma", partition_sql("y1", NO_TURN, gamma="ceil(1000000 * 2.0 / (SELECT tne + te FROM t)) * (large - small)"), gamma=2.0)


@query("triangular_model_data", f"""WITH src AS ({L}), g AS (SELECT {case('l_extendedprice', NINE)} AS i, CAST(count(*) FILTER (y1 = 0) AS DOUBLE) AS ne, CAST(count(*) FILTER (y1 <> 0) AS DOUBLE) AS e FROM src GROUP BY 1),
t AS (SELECT sum(ne) AS tne, sum(e) AS te FROM g), c AS (SELECT a.i AS first, b.i AS last, sum(g.ne) AS ne, sum(g.e) AS e FROM g a JOIN g b ON a.i <= b.i JOIN g ON g.i BETWEEN a.i AND b.i GROUP BY 1, 2)
SELECT CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, CAST(trunc(1000000 * (e / (ne + e))) AS BIGINT) AS rate, CAST(trunc(1000000 * ((e / te - ne / tne) * ln((e / te) / (ne / tne)))) AS BIGINT) AS value FROM c, t""")
def _(spark, d):
    p = BinaryBinner(monotonic_trend=None)._problem(*split_counts(lines(spark, d), "l_extendedprice", "y1", "binary", NINE))
    rows = [(k, i, int(p.rates[0][i][k]), int(p.value[i][k])) for i in range(9) for k in range(i + 1)]
    return spark.createDataFrame(rows, "first long, last long, rate long, value long")


CLOSE = [30000.0, 40000.0, 40300.0, 40600.0, 40900.0, 41200.0, 60000.0, 80000.0]
CONFLICT = f"""WITH src AS ({L}), g AS (SELECT {case('l_extendedprice', CLOSE)} AS i, CAST(count(*) FILTER (y1 = 0) AS DOUBLE) AS ne, CAST(count(*) FILTER (y1 <> 0) AS DOUBLE) AS e FROM src GROUP BY 1),
c AS (SELECT a.i AS k, b.i AS i, sum(g.ne) AS ne, sum(g.e) AS e, sum(g.ne + g.e) AS n FROM g a JOIN g b ON a.i <= b.i JOIN g ON g.i BETWEEN a.i AND b.i GROUP BY 1, 2)
SELECT CAST(p.k AS BIGINT) AS first_a, CAST(p.i AS BIGINT) AS last_a, CAST(v.k AS BIGINT) AS first_b, CAST(v.i AS BIGINT) AS last_b FROM c p JOIN c v ON v.k = p.i + 1 WHERE """


def conflicts(spark, d, bad) -> DataFrame:
    p = BinaryBinner(monotonic_trend=None, max_pvalue=0.05)._problem(*split_counts(lines(spark, d), "l_extendedprice", "y1", "binary", CLOSE))
    rows = [(k, i, i + 1, j) for i in range(8) for k in range(i + 1) for j in range(i + 1, 9) if bad(p, k, i, j)]
    return spark.createDataFrame(rows, "first_a long, last_a long, first_b long, last_b long")


@query("pvalue_conflicts", CONFLICT + Z + " < 1.959963984540054")
def _(spark, d):
    return conflicts(spark, d, lambda p, k, i, j: p.conflict(k, i, i + 1, j))


@query("min_diff_conflicts", CONFLICT + "abs(trunc(1000000 * v.e / v.n) - trunc(1000000 * p.e / p.n)) < 100000")
def _(spark, d):
    return conflicts(spark, d, lambda p, k, i, j: abs(p.rates[0][j][i + 1] - p.rates[0][i][k]) < 100000)


# ---------------------------------------------------------------- measures


METRIC_SQL = f"""WITH {counts_sql(L, bin_sql('l_extendedprice', SPLITS), 'y1', [*LABELS, 'Special', 'Missing'])}, {TABLE_SQL},
o AS (SELECT *, CASE bin {' '.join(f"WHEN {q} THEN {i}" for i, q in enumerate(quoted([*LABELS, 'Special', 'Missing'])))} END AS i FROM v),
k AS (SELECT max(abs(cp - cq)) AS ks FROM (SELECT sum(p) OVER (ORDER BY i) AS cp, sum(q) OVER (ORDER BY i) AS cq FROM o)),
gi AS (SELECT 1 - sum(e * (ne + 2 * (cum - ne))) / CAST(max(te) * max(tne) AS DOUBLE) AS gini FROM (SELECT *, sum(ne) OVER (ORDER BY CAST(ne AS DOUBLE) / n, i) AS cum FROM o WHERE n > 0)),
x AS (SELECT sum((e - n * ctr) * (e - n * ctr) / (n * ctr) + (ne - n * (1 - ctr)) * (ne - n * (1 - ctr)) / (n * (1 - ctr))) AS chi, sum(n) AS cn FROM (SELECT *, CAST(te AS DOUBLE) / (te + tne) AS ctr FROM o WHERE n > 0)),
s AS (SELECT sum(iv) AS iv, sum(js) AS js, sum(CASE WHEN e > 0 AND ne > 0 THEN 0.5 * (sqrt(p) - sqrt(q)) * (sqrt(p) - sqrt(q)) ELSE 0 END) AS hellinger,
    sum(CASE WHEN e > 0 AND ne > 0 THEN (p - q) * (p - q) / (p + q) ELSE 0 END) AS triangular, sum(n * n / CAST((te + tne) * (te + tne) AS DOUBLE)) AS hhi, count(*) AS m FROM o)
SELECT round(iv, 6) AS iv, round(js, 6) AS js, round(hellinger, 6) AS hellinger, round(triangular, 6) AS triangular, round(gini, 6) AS gini, round(ks, 6) AS ks, round(hhi, 6) AS hhi,
    round((hhi - 1.0 / m) / (1 - 1.0 / m), 6) AS hhi_norm, round(sqrt(chi / cn), 6) AS cramer_v FROM s, k, gi, x"""


@query("divergences", METRIC_SQL)
def _(spark, d):
    m = fixed_binner().fit(lines(spark, d), "l_extendedprice", "y1").table().metrics()
    return rounded(spark.createDataFrame([tuple(float(v) for v in m.values())], ", ".join(f"{k} double" for k in m)))


PAIR_BINS = [30000.0, 45000.0, 60000.0]
PAIRS = f"""WITH src AS ({L}), g AS (SELECT {case('l_extendedprice', PAIR_BINS)} AS i, CAST(count(*) FILTER (y1 = 0) AS DOUBLE) AS ne, CAST(count(*) FILTER (y1 <> 0) AS DOUBLE) AS e FROM src GROUP BY 1)
SELECT CAST(a.i AS BIGINT) AS bin_a, CAST(b.i AS BIGINT) AS bin_b, round((a.ne * b.e - a.e * b.ne) * (a.ne * b.e - a.e * b.ne) * (a.ne + a.e + b.ne + b.e) / ((a.ne + a.e) * (b.ne + b.e) * (a.ne + b.ne) * (a.e + b.e)), 4) AS statistic FROM g a JOIN g b ON b.i = a.i + 1"""


@query("chi2_neighbours", PAIRS)
def _(spark, d):
    _, tests = fixed_binner(PAIR_BINS).fit(lines(spark, d), "l_extendedprice", "y1").table().analysis()
    return rounded(as_frame(spark, tests[["bin_a", "bin_b", "statistic"]]), 4)


@query("sign_changes", f"""WITH g AS (SELECT {case('l_extendedprice', NINE)} AS i, avg(y1) AS r1, avg(y2) AS r2 FROM ({L}) GROUP BY 1),
s AS (SELECT i, sign(r1 - lag(r1) OVER (ORDER BY i)) AS s1, sign(r2 - lag(r2) OVER (ORDER BY i)) AS s2 FROM g),
c AS (SELECT s1 <> lag(s1) OVER (ORDER BY i) AS c1, s2 <> lag(s2) OVER (ORDER BY i) AS c2 FROM s)
SELECT CAST(count(*) FILTER (c1) AS BIGINT) AS changes_y1, CAST(count(*) FILTER (c2) AS BIGINT) AS changes_y2 FROM c""")
def _(spark, d):
    out = []
    for y in ("y1", "y2"):
        b, _ = split_counts(lines(spark, d), "l_extendedprice", y, "binary", NINE)
        out.append(trend_changes(b["n1"] / (b["n0"] + b["n1"])))
    return spark.createDataFrame([tuple(out)], "changes_y1 long, changes_y2 long")


@query("trend_label", f"""WITH g AS (SELECT {case('l_extendedprice', NINE)} AS i, avg(y1) AS r1, avg(y2) AS r2 FROM ({L}) GROUP BY 1),
s AS (SELECT r1 - lag(r1) OVER (ORDER BY i) AS d1, r2 - lag(r2) OVER (ORDER BY i) AS d2, i, arg_max(i, r2) OVER () AS top FROM g)
SELECT CASE WHEN bool_and(coalesce(d1, 0) >= 0) THEN 'ascending' WHEN bool_and(coalesce(d1, 0) <= 0) THEN 'descending' ELSE 'other' END AS trend_y1,
CASE WHEN bool_and(CASE WHEN i <= top THEN coalesce(d2, 0) >= 0 ELSE d2 <= 0 END) THEN 'peak' ELSE 'other' END AS trend_y2 FROM s""")
def _(spark, d):
    out = []
    for y in ("y1", "y2"):
        b, _ = split_counts(lines(spark, d), "l_extendedprice", y, "binary", NINE)
        out.append(label(b["n1"] / (b["n0"] + b["n1"])).split(" (")[0])
    return spark.createDataFrame([tuple(out)], "trend_y1 string, trend_y2 string")


# ---------------------------------------------------------------- outliers


EVENTS_X = "SELECT event_id, value FROM events"


@query("range_eti_outliers", f"WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, round(value, 6) AS value FROM ({EVENTS_X}), q WHERE value > b + 0.5 * (b - a) OR value < a - 0.5 * (b - a)")
def _(spark, d):
    df = _read(spark, d, "events")
    return rounded(df.where(is_outlier(F.col("value"), range_bounds(df, "value", k=0.5))).select("event_id", "value"))


@query("range_hdi_outliers", f"""WITH s AS (SELECT value AS v, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events), w AS (SELECT v, lead(v, CAST(ceil(0.5 * (SELECT max(n) FROM s)) AS INT) - 1) OVER (ORDER BY v) AS b FROM s),
q AS (SELECT v AS a, b FROM w WHERE b IS NOT NULL ORDER BY b - v, v LIMIT 1) SELECT event_id, round(value, 6) AS value FROM ({EVENTS_X}), q WHERE value > b + 1.5 * (b - a) OR value < a - 1.5 * (b - a)""")
def _(spark, d):
    df = _read(spark, d, "events")
    return rounded(df.where(is_outlier(F.col("value"), range_bounds(df, "value", method="HDI"))).select("event_id", "value"))


@query("zscore_outliers", f"WITH m AS (SELECT median(value) AS m FROM events), k AS (SELECT m, median(abs(value - m)) AS mad FROM events, m GROUP BY m) SELECT event_id, round(value, 6) AS value FROM ({EVENTS_X}), k WHERE 0.6745 * abs(value - m) / mad > 3.5")
def _(spark, d):
    df = _read(spark, d, "events")
    return rounded(df.where(is_outlier(F.col("value"), zscore_bounds(df, "value"))).select("event_id", "value"))


@query("yquantile_outliers", f"""WITH src AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, yc AS y FROM ({L})), q AS (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS q FROM src),
b AS (SELECT src.*, CASE WHEN x < q[1] THEN 0 WHEN x < q[2] THEN 1 WHEN x < q[3] THEN 2 WHEN x < q[4] THEN 3 ELSE 4 END AS i FROM src, q),
m AS (SELECT i, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM b GROUP BY i)
SELECT b.l_orderkey, b.l_linenumber FROM b JOIN m USING (i) WHERE y > m.b + 0.4 * (m.b - m.a) OR y < m.a - 0.4 * (m.b - m.a)""")
def _(spark, d):
    df = lines(spark, d)
    bounds = y_quantile_bounds(df, "l_extendedprice", "yc", "range", {"k": 0.4})
    return df.where(is_outlier(F.col("l_extendedprice"), bounds, F.col("yc"))).select(*KEY)


# ---------------------------------------------------------------- two columns


GX, GY = [30000.0, 60000.0], [15.0, 35.0]
GRID = f"SELECT CAST({case('l_quantity', GY)} AS BIGINT) AS iy, CAST({case('l_extendedprice', GX)} AS BIGINT) AS ix, count(*) FILTER (y1 = 0) AS non_event, count(*) FILTER (y1 <> 0) AS event FROM ({L}) GROUP BY 1, 2"


def axes() -> tuple[Axis, Axis]:
    return Axis(True, GX, [], None), Axis(True, GY, [], None)


@query("grid2d_counts", GRID)
def _(spark, d):
    rows = grid_moments(lines(spark, d), "l_extendedprice", "l_quantity", "y1", *axes(), "binary")
    return spark.createDataFrame([(c["iy"], c["ix"], int(c["m_n0"]), int(c["m_n1"])) for c in rows], "iy long, ix long, non_event long, event long")


@query("rectangles2d", f"""WITH g AS ({GRID}), r AS (SELECT a.i AS y0, b.i AS y1, c.i AS x0, e.i AS x1 FROM range(3) a(i) JOIN range(3) b(i) ON a.i <= b.i CROSS JOIN range(3) c(i) JOIN range(3) e(i) ON c.i <= e.i)
SELECT CAST(r.y0 AS BIGINT) AS top, CAST(x0 AS BIGINT) AS "left", CAST(r.y1 AS BIGINT) AS bottom, CAST(x1 AS BIGINT) AS "right", CAST(sum(non_event) AS BIGINT) AS non_event, CAST(sum(event) AS BIGINT) AS event
FROM r JOIN g ON iy BETWEEN r.y0 AND r.y1 AND ix BETWEEN x0 AND x1 GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    from .plans.grid import all_rectangles, prefix_sums, rectangle_sum

    e, ne = np.zeros((3, 3)), np.zeros((3, 3))
    for c in grid_moments(lines(spark, d), "l_extendedprice", "l_quantity", "y1", *axes(), "binary"):
        ne[c["iy"], c["ix"]], e[c["iy"], c["ix"]] = c["m_n0"], c["m_n1"]
    pe, pn = prefix_sums(e), prefix_sums(ne)
    rows = [(*s, int(rectangle_sum(pn, *s)), int(rectangle_sum(pe, *s))) for s in all_rectangles(3, 3)]
    return spark.createDataFrame(rows, "top long, left long, bottom long, right long, non_event long, event long")


# ---------------------------------------------------------------- scenarios


@query("scenario_counts", f"SELECT CAST(l_linenumber % 3 AS BIGINT) AS scenario, {bin_sql('l_extendedprice', SPLITS)} AS bin, count(*) FILTER (y1 = 0) AS non_event, count(*) FILTER (y1 <> 0) AS event FROM ({L}) GROUP BY 1, 2")
def _(spark, d):
    b = ScenarioBinner(user_splits=SPLITS, user_splits_fixed=[True] * 5)
    b.fit(lines(spark, d).withColumn("s", (F.col("l_linenumber") % 3).cast("long")), "l_extendedprice", "y1", "s")
    rows = []
    for s in b.scenarios:
        t = b.scenario_table(s)
        rows += [(int(s), t.labels[i], int(t.n_nonevent[i]), int(t.n_event[i])) for i in range(t.n_bins)]
    return spark.createDataFrame(rows, "scenario long, bin string, non_event long, event long")


SIX = [25000.0, 35000.0, 50000.0, 65000.0, 80000.0]


def scenario_sql() -> str:
    return f"""WITH RECURSIVE src AS ({L}), g AS (SELECT l_linenumber % 3 AS s, {case('l_extendedprice', SIX)} AS i, CAST(count(*) FILTER (y1 = 0) AS DOUBLE) AS ne, CAST(count(*) FILTER (y1 <> 0) AS DOUBLE) AS e FROM src GROUP BY 1, 2),
t AS (SELECT s, sum(ne) AS tne, sum(e) AS te FROM g GROUP BY s), c AS (SELECT g.s, a.i AS k, b.i AS i, sum(g.ne) AS ne, sum(g.e) AS e FROM range(6) a(i) JOIN range(6) b(i) ON a.i <= b.i JOIN g ON g.i BETWEEN a.i AND b.i GROUP BY 1, 2, 3),
w AS (SELECT s, k, i, CAST(trunc(1000000 * (e / (ne + e))) AS BIGINT) AS d, CAST(trunc(1000000 * (CASE s WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END * ((e / te - ne / tne) * ln((e / te) / (ne / tne))))) AS BIGINT) AS v FROM c JOIN t USING (s)),
v AS (SELECT k, i, CAST(sum(v) AS BIGINT) AS v, max(d) FILTER (s = 0) AS d0, max(d) FILTER (s = 1) AS d1, max(d) FILTER (s = 2) AS d2 FROM w GROUP BY 1, 2),
p AS (SELECT i, v AS value, 1 AS bins, d0, d1, d2, CAST(i AS VARCHAR) AS ends FROM v WHERE k = 0
    UNION ALL SELECT v.i, p.value + v.v, p.bins + 1, v.d0, v.d1, v.d2, p.ends || ',' || v.i FROM p JOIN v ON v.k = p.i + 1 WHERE v.d0 >= p.d0 AND v.d1 >= p.d1 AND v.d2 >= p.d2)
SELECT CAST(value AS BIGINT) AS value, CAST(bins AS BIGINT) AS bins, ends FROM p WHERE i = 5 ORDER BY value DESC, bins, ends LIMIT 1"""


@query("scenario_optimum", scenario_sql())
def _(spark, d):
    df = lines(spark, d).withColumn("s", (F.col("l_linenumber") % 3).cast("long"))
    model = ScenarioBinner(user_splits=SIX, monotonic_trend="ascending").fit(df, "l_extendedprice", "y1", "s", {0: 0.5, 1: 0.3, 2: 0.2})
    ends = [*(SIX.index(s) for s in model.splits), len(SIX)]
    return spark.createDataFrame([(model.objective, len(ends), ",".join(map(str, ends)))], "value long, bins long, ends string")


# ---------------------------------------------------------------- scorecards


QSPLITS = [10.0, 20.0, 30.0, 40.0]
COEF, INTERCEPT = [-0.8, -0.6], -0.25


def card(spark, d, **options) -> Scorecard:
    fit = {"l_extendedprice": {"user_splits": SPLITS, "user_splits_fixed": [True] * 5, "monotonic_trend": None}, "l_quantity": {"user_splits": QSPLITS, "user_splits_fixed": [True] * 4, "monotonic_trend": None}}
    process = BinningPipeline(["l_extendedprice", "l_quantity"], binning_fit_params=fit)
    return Scorecard(process, FixedModel(COEF, INTERCEPT), **options).fit(lines(spark, d), "y1")


def _variable_sql(name: str, x: str, splits, coefficient: float) -> str:
    base = f"{counts_sql('SELECT * FROM base', bin_sql(x, splits), 'y1', [*interval_labels(splits), 'Special', 'Missing'])}, {TABLE_SQL}"
    return f"{name} AS (WITH {base} SELECT '{x}' AS variable, bin, CASE WHEN bin IN ('Special', 'Missing') THEN 0 ELSE woe END * {coefficient} AS p FROM v)"


CARD = f"WITH base AS ({L}), {_variable_sql('v1', 'l_extendedprice', SPLITS, COEF[0])}, {_variable_sql('v2', 'l_quantity', QSPLITS, COEF[1])}, pts AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2)"
PDO = {"pdo": 20, "odds": 50, "scorecard_points": 600}
FACTOR = "(20 / ln(2))"
PDO_POINTS = f"-(p + {INTERCEPT} / 2) * {FACTOR} + (600 - {FACTOR} * ln(50)) / 2"
ENDS = "e AS (SELECT sum(a) AS lo, sum(b) AS hi FROM (SELECT min(p) AS a, max(p) AS b FROM pts GROUP BY variable))"
SLOPE = "((300 - 850) / (hi - lo))"
MINMAX_POINTS = f"((850 - {SLOPE} * ({INTERCEPT} + lo)) + {SLOPE} * {INTERCEPT}) / 2 + {SLOPE} * p"


def points_table(c: Scorecard, spark) -> DataFrame:
    return rounded(c.table(spark=spark), 5)


@query("scorecard_points_pdo", f"{CARD} SELECT variable, bin, round({PDO_POINTS}, 5) AS points FROM pts")
def _(spark, d):
    return points_table(card(spark, d, scaling_method="pdo_odds", scaling_method_params=PDO), spark)


@query("scorecard_points_min_max", f"{CARD}, {ENDS} SELECT variable, bin, round({MINMAX_POINTS}, 5) AS points FROM pts, e")
def _(spark, d):
    return points_table(card(spark, d, scaling_method="min_max", scaling_method_params={"min": 300, "max": 850}), spark)


@query("scorecard_points_intercept_based", f"{CARD}, s AS (SELECT variable, bin, {PDO_POINTS} AS p FROM pts) SELECT variable, bin, round(p - min(p) OVER (PARTITION BY variable), 5) AS points FROM s")
def _(spark, d):
    return points_table(card(spark, d, scaling_method="pdo_odds", scaling_method_params=PDO, intercept_based=True), spark)


@query("scorecard_score", f"""{CARD}, s AS (SELECT variable, bin, {PDO_POINTS} AS p FROM pts)
SELECT l_orderkey, l_linenumber, round(a.p + b.p, 5) AS score FROM base JOIN s a ON a.variable = 'l_extendedprice' AND a.bin = {bin_sql('l_extendedprice', SPLITS)} JOIN s b ON b.variable = 'l_quantity' AND b.bin = {bin_sql('l_quantity', QSPLITS)}""")
def _(spark, d):
    c = card(spark, d, scaling_method="pdo_odds", scaling_method_params=PDO)
    return rounded(c.score(lines(spark, d)).select(*KEY, "score"), 5)


@query("scorecard_probability", f"""{CARD} SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-({INTERCEPT} + a.p + b.p))), 6) AS probability FROM base JOIN pts a ON a.variable = 'l_extendedprice' AND a.bin = {bin_sql('l_extendedprice', SPLITS)} JOIN pts b ON b.variable = 'l_quantity' AND b.bin = {bin_sql('l_quantity', QSPLITS)}""")
def _(spark, d):
    return rounded(card(spark, d).predict_proba(lines(spark, d)).select(*KEY, "probability"))


@query("scorecard_logistic")
def _(spark, d):
    return Scorecard(BinningPipeline(["l_extendedprice", "l_quantity", "l_discount"])).fit(lines(spark, d), "y1").table("detailed", spark=spark)


@query("counterfactual_best_bin", f"""{CARD}, q AS (SELECT * FROM base WHERE y1 = 0 ORDER BY l_orderkey, l_linenumber LIMIT 1), own AS (SELECT {bin_sql('l_extendedprice', SPLITS)} AS b1, {bin_sql('l_quantity', QSPLITS)} AS b2 FROM q),
w AS (SELECT variable, bin, p / CASE variable WHEN 'l_extendedprice' THEN {COEF[0]} ELSE {COEF[1]} END AS woe, p FROM pts WHERE bin NOT IN ('Special', 'Missing')), rng AS (SELECT variable, max(woe) - min(woe) AS width FROM w GROUP BY 1),
now AS (SELECT a.woe AS w1, b.woe AS w2 FROM own JOIN w a ON a.variable = 'l_extendedprice' AND a.bin = b1 JOIN w b ON b.variable = 'l_quantity' AND b.bin = b2),
c AS (SELECT a.bin AS b1, b.bin AS b2, abs(a.woe - w1) / (SELECT width FROM rng WHERE variable = 'l_extendedprice') + abs(b.woe - w2) / (SELECT width FROM rng WHERE variable = 'l_quantity') AS cost
    FROM now, w a JOIN w b ON a.variable = 'l_extendedprice' AND b.variable = 'l_quantity' WHERE {INTERCEPT} + a.p + b.p >= 0.000001)
SELECT CASE WHEN c.b1 = own.b1 THEN '-' ELSE c.b1 END AS l_extendedprice, CASE WHEN c.b2 = own.b2 THEN '-' ELSE c.b2 END AS l_quantity, round(cost, 6) AS cost FROM c, own ORDER BY c.cost LIMIT 1""")
def _(spark, d):
    df = lines(spark, d)
    cf = Counterfactual(card(spark, d)).fit(df)
    row = df.where("y1 = 0").orderBy(*KEY).first().asDict()
    cf.generate(row, 1, "binary", objectives={"proximity": 1}, max_changes=2)
    out = cf.display(show_only_changes=True).iloc[0]
    return rounded(spark.createDataFrame([(out["l_extendedprice"], out["l_quantity"], cf.objective_values[0]["proximity"])], "l_extendedprice string, l_quantity string, cost double"))


# ---------------------------------------------------------------- monitoring and evaluation


VALUE_SPLITS = [20.0, 50.0, 80.0, 120.0]
HALVES = f"SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'e' ELSE 'a' END AS part, {bin_sql('value', VALUE_SPLITS)} AS bin FROM events"


@query("psi_system", f"""WITH src AS ({HALVES}), g AS (SELECT bin, count(*) FILTER (part = 'a') AS a, count(*) FILTER (part = 'e') AS e FROM src GROUP BY bin),
names(bin) AS (VALUES {", ".join(f"({q})" for q in quoted(interval_labels(VALUE_SPLITS)))}), c AS (SELECT bin, coalesce(a, 0) AS a, coalesce(e, 0) AS e, sum(a) OVER () AS ta, sum(e) OVER () AS te FROM names JOIN g USING (bin)),
v AS (SELECT *, CAST(a AS DOUBLE) / ta AS pa, CAST(e AS DOUBLE) / te AS pe FROM c)
SELECT bin, a AS count_a, e AS count_e, round(pa, 6) AS count_a_pct, round(pe, 6) AS count_e_pct, round((pa - pe) * ln(pa / pe), 8) AS psi FROM v
UNION ALL SELECT 'Totals', CAST(sum(a) AS BIGINT), CAST(sum(e) AS BIGINT), 1.0, 1.0, round(sum((pa - pe) * ln(pa / pe)), 8) FROM v""")
def _(spark, d):
    df = _read(spark, d, "events").withColumn("part", F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), "e").otherwise("a"))
    found = {(c["i"], c["part"]): c["count"] for c in df.groupBy(by_interval(F.col("value"), VALUE_SPLITS, F.lit).alias("i"), "part").count().collect()}
    used = [i for i in range(5) if (i, "a") in found or (i, "e") in found]
    t = psi_table([interval_labels(VALUE_SPLITS)[i] for i in used], [found.get((i, "a"), 0) for i in used], [found.get((i, "e"), 0) for i in used])
    return rounded(as_frame(spark, t), psi=8)


SCORED = f"SELECT l_orderkey, l_linenumber, y1, round(l_extendedprice / 1000) AS s, CAST(l_extendedprice > 50000 AS INT) AS guess, yc, l_extendedprice AS pred FROM ({L})"
COUNTED = f"c AS (SELECT s, sum(y1) AS e, sum(1 - y1) AS ne FROM ({SCORED}) GROUP BY s)"


def scored(spark, d) -> DataFrame:
    return lines(spark, d).select(*KEY, "y1", F.round(F.col("l_extendedprice") / 1000).alias("s"), (F.col("l_extendedprice") > 50000).cast("int").alias("guess"), "yc", F.col("l_extendedprice").alias("pred"))


@query("roc_points", f"WITH {COUNTED} SELECT s AS threshold, round(CAST(sum(ne) OVER o AS DOUBLE) / sum(ne) OVER (), 6) AS fpr, round(CAST(sum(e) OVER o AS DOUBLE) / sum(e) OVER (), 6) AS tpr FROM c WINDOW o AS (ORDER BY s DESC)")
def _(spark, d):
    return rounded(evaluate.roc_points(scored(spark, d), "y1", "s"))


@query("cap_curve", f"WITH {COUNTED} SELECT s AS threshold, round(CAST(sum(ne + e) OVER o AS DOUBLE) / sum(ne + e) OVER (), 6) AS population, round(CAST(sum(e) OVER o AS DOUBLE) / sum(e) OVER (), 6) AS captured FROM c WINDOW o AS (ORDER BY s DESC)")
def _(spark, d):
    return rounded(evaluate.cap_curve(scored(spark, d), "y1", "s"))


@query("ks_curve", f"WITH {COUNTED}, k AS (SELECT s AS threshold, CAST(sum(e) OVER o AS DOUBLE) / sum(e) OVER () AS p_event, CAST(sum(ne) OVER o AS DOUBLE) / sum(ne) OVER () AS p_nonevent FROM c WINDOW o AS (ORDER BY s)) SELECT threshold, round(p_event, 6) AS p_event, round(p_nonevent, 6) AS p_nonevent, round(abs(p_nonevent - p_event), 6) AS distance FROM k")
def _(spark, d):
    return rounded(evaluate.ks_curve(scored(spark, d), "y1", "s"))


@query("auc_gini", f"WITH {COUNTED}, k AS (SELECT sum(e * (below + ne / 2.0)) / (sum(e) * sum(ne)) AS auc FROM (SELECT e, ne, coalesce(sum(ne) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)) SELECT round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini FROM k")
def _(spark, d):
    return rounded(evaluate.auc(scored(spark, d), "y1", "s"))


@query("ks_by_record", f"""WITH r AS (SELECT y1, row_number() OVER o - 1 AS before, sum(y1) OVER (o ROWS UNBOUNDED PRECEDING) AS e, sum(y1) OVER () AS te, count(*) OVER () AS n FROM (SELECT *, l_orderkey * 10 + l_linenumber AS id FROM ({SCORED})) WINDOW o AS (ORDER BY s, id))
SELECT round(max((before - e) / CAST(n - te AS DOUBLE) - e / CAST(te AS DOUBLE)), 6) AS ks FROM r""")
def _(spark, d):
    df = scored(spark, d).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rounded(evaluate.ks_by_record(df, "y1", "s", "id"))


@query("performance_binary", f"""WITH c AS (SELECT CAST(count(*) FILTER (y1 = 1 AND guess = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (y1 = 0 AND guess = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (y1 = 0 AND guess = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (y1 = 1 AND guess = 0) AS DOUBLE) AS fn FROM ({SCORED})),
x AS (SELECT tp / (tp + fn) AS tpr, tn / (tn + fp) AS tnr FROM c)
SELECT round(tpr, 6) AS tpr, round(tnr, 6) AS tnr, round(1 - tnr, 6) AS fpr, round(1 - tpr, 6) AS fnr, round((tpr + tnr) / 2, 6) AS balanced_accuracy, round(sqrt(3) / pi() * (ln(tpr / (1 - tpr)) + ln(tnr / (1 - tnr))), 6) AS discriminant_power FROM x""")
def _(spark, d):
    return rounded(evaluate.classification(scored(spark, d), "y1", "guess"))


@query("performance_continuous", f"""WITH x AS (SELECT yc AS a, yc - pred AS e, abs(yc) + abs(pred) AS b FROM ({SCORED}))
SELECT round(avg(abs(e)), 4) AS mae, round(avg(e * e), 1) AS mse, round(median(abs(e)), 4) AS median_absolute_error, round(1 - var_pop(e) / var_pop(a), 6) AS explained_variance, round(1 - sum(e * e) / (count(*) * var_pop(a)), 6) AS r2,
round(avg(e / a), 6) AS mpe, round(avg(abs(e / a)), 6) AS mape, round(median(abs(e / a)), 6) AS mdape, round(avg(abs(e) / b), 6) AS smape, round(median(abs(e) / b), 6) AS smdape FROM x""")
def _(spark, d):
    return rounded(evaluate.regression(scored(spark, d), "yc", "pred"), mae=4, mse=1, median_absolute_error=4)


# ---------------------------------------------------------------- processes


FOUR = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]
FOUR_SPLITS = {"l_extendedprice": SPLITS, "l_quantity": QSPLITS, "l_discount": [0.025, 0.055, 0.085], "l_tax": [0.025, 0.055]}


def process(**options) -> BinningPipeline:
    fit = {v: {"user_splits": s, "user_splits_fixed": [True] * len(s), "monotonic_trend": None} for v, s in FOUR_SPLITS.items()}
    return BinningPipeline(FOUR, binning_fit_params=fit, **options)


def iv_sql() -> str:
    parts_ = []
    for v, s in FOUR_SPLITS.items():
        parts_.append(f"{v}_t AS (WITH {counts_sql('SELECT * FROM base', bin_sql(v, s), 'y1', [*interval_labels(s), 'Special', 'Missing'])}, {TABLE_SQL} SELECT '{v}' AS name, CAST({len(s) + 1} AS BIGINT) AS n_bins, sum(iv) AS iv, sum(js) AS js FROM v)")
    return f"WITH base AS ({L}), {', '.join(parts_)}, s AS ({' UNION ALL '.join(f'SELECT * FROM {v}_t' for v in FOUR)})"


@query("process_summary", iv_sql() + " SELECT name, n_bins, round(iv, 6) AS iv, round(js, 6) AS js FROM s")
def _(spark, d):
    return rounded(process().fit(lines(spark, d), "y1").summary(spark).select("name", "n_bins", "iv", "js"))


@query("selection_topk", iv_sql() + " SELECT name, iv >= 0.0001 AND row_number() OVER (ORDER BY CASE WHEN iv >= 0.0001 THEN 0 ELSE 1 END, iv DESC) <= 2 OR name = 'l_tax' AS selected FROM s")
def _(spark, d):
    p = process(selection_criteria={"iv": {"min": 0.0001, "top": 2, "strategy": "highest"}}, fixed_variables=["l_tax"])
    return p.fit(lines(spark, d), "y1").summary(spark).select("name", "selected")


# ---------------------------------------------------------------- streams


def chunks(spark, d) -> list[DataFrame]:
    df = lines(spark, d)
    return [df.where(F.col("l_linenumber") % 3 == k) for k in range(3)]


@query("cat_sketch_counts", f"SELECT l_returnflag AS category, y1 <> 0 AS event, count(*) AS n FROM ({L}) WHERE l_linenumber % 3 = 0 GROUP BY 1, 2")
def _(spark, d):
    return chunk_state(chunks(spark, d)[0], {"l_returnflag": False}, "y1").select(F.col("label").alias("category"), "event", "n")


@query("sketch_merge", f"SELECT l_returnflag AS category, y1 <> 0 AS event, count(*) AS n FROM ({L}) GROUP BY 1, 2")
def _(spark, d):
    states = [chunk_state(c, {"l_returnflag": False}, "y1") for c in chunks(spark, d)]
    return merge_states(*states).select(F.col("label").alias("category"), "event", "n")


@query("sketch_special_missing", f"SELECT CASE WHEN x IS NULL THEN 'missing' WHEN x IN (-9999, -8888) THEN 'special:0' ELSE 'clean' END AS kind, y1 <> 0 AS event, count(*) AS n FROM ({L}) GROUP BY 1, 2")
def _(spark, d):
    states = [chunk_state(c, {"x": True}, "y1", [-9999, -8888]) for c in chunks(spark, d)]
    return merge_states(*states).select("kind", "event", "n")


@query("sketch_progress", "WITH g AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS solve, avg(value) AS divergence FROM events GROUP BY 1), w AS (SELECT *, avg(divergence) OVER o AS mean, stddev_samp(divergence) OVER o / sqrt(count(*) OVER o) AS stderr FROM g WINDOW o AS (ORDER BY solve)) SELECT solve, round(divergence, 6) AS divergence, round(mean, 6) AS mean, round(stderr, 6) AS stderr, round(mean - 1.959963984540054 * stderr, 6) AS low, round(mean + 1.959963984540054 * stderr, 6) AS high FROM w")
def _(spark, d):
    g = _read(spark, d, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("solve")).agg(F.avg("value").alias("divergence"))
    return rounded(progress_band(g))


# ---------------------------------------------------------------- piecewise


@query("piecewise_constant", f"SELECT l_orderkey, l_linenumber, round(avg(yc) OVER (PARTITION BY {case('l_extendedprice', SPLITS)}), 3) AS code FROM ({L})")
def _(spark, d):
    df = lines(spark, d)
    b = PiecewiseBinner(kind="continuous", degree=0, continuous=False, user_splits=SPLITS, user_splits_fixed=[True] * 5, monotonic_trend=None)
    return rounded(b.fit(df, "l_extendedprice", "yc").transform(df, "l_extendedprice", "code").select(*KEY, "code"), 3)


PIECE_SPLITS = [25000.0, 55000.0]


@query("piecewise_lines", f"""WITH b AS (SELECT *, {case('l_extendedprice', PIECE_SPLITS)} AS i FROM ({L})), f AS (SELECT i, regr_slope(yc, l_extendedprice) AS s, regr_intercept(yc, l_extendedprice) AS c FROM b GROUP BY i)
SELECT l_orderkey, l_linenumber, round(c + s * l_extendedprice, 2) AS code FROM b JOIN f USING (i)""")
def _(spark, d):
    df = lines(spark, d)
    b = PiecewiseBinner(kind="continuous", continuous=False, user_splits=PIECE_SPLITS, user_splits_fixed=[True, True], monotonic_trend=None)
    return rounded(b.fit(df, "l_extendedprice", "yc").transform(df, "l_extendedprice", "code").select(*KEY, "code"), 2)


# ---------------------------------------------------------------- whole fits


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An optimal ascending binning of lineitem, applied to its rows as weight of evidence."""
    df = lines(spark, sf_dir)
    model = BinaryBinner(monotonic_trend="ascending").fit(df, "l_extendedprice", "y1")
    return df.select(*KEY, model.encode(F.col("l_extendedprice")).alias("woe"))


from . import queries_fits  # noqa: E402, F401  registers its queries

__all__ = ["QUERIES", "SQL", "Column", "Histogram", "Window", "flagship"]

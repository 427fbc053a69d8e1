"""Target moments by value or by bin, from one aggregation.

Everything that follows works on these small tables: the rows of the input are
read once for a fit, partially aggregated on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import CLEAN, MISSING, SPECIAL, Bounds, is_missing, is_numeric, is_outlier, row_class, special_labels

#: Distinct values up to which each is a cell of its own; beyond, cells of about equal counts are used.
#: It also bounds the categories of a column, which all reach the driver.
MAX_DISTINCT = 200_000
CELLS = 1024
#: Cells that are looked at again come by value up to this many values, else by finer cells of their own.
FEW = 50_000
FINE_CELLS = 8192
#: Inputs of more bytes than this are scanned once for both.
ONE_PASS = 1 << 30

Moments = dict[str, float]


def moment_columns(kind: str, y: Column, w: Column, classes: list | None = None) -> dict[str, Column]:
    """Aggregates of the target: ``n0, n1`` (binary), ``n<i>`` by class, or count, sum, squares, extremes and zeros."""
    if kind == "binary":
        return {"n0": F.sum(F.when(y == 0, w).otherwise(0.0)), "n1": F.sum(F.when(y == 0, 0.0).otherwise(w))}
    if kind == "multiclass":
        return {f"n{i}": F.sum(F.when(y == F.lit(c), w).otherwise(0.0)) for i, c in enumerate(classes or [])}
    v = y.cast("double") * w
    return {
        "n": F.sum(w), "s": F.sum(v), "ss": F.sum(v * v), "min": F.min(v), "max": F.max(v), "zeros": F.sum(F.when(v == 0, 1.0).otherwise(0.0)),
    }


def add_moments(a: Moments, b: Moments) -> Moments:
    out = {}
    for k in a:
        out[k] = (min if k == "min" else max if k == "max" else lambda x, y: x + y)(a[k], b[k])
    return out


def no_moments(names) -> Moments:
    return {k: np.inf if k == "min" else -np.inf if k == "max" else 0.0 for k in names}


@dataclass
class Histogram:
    """Cells of clean values in order, from ``low`` to ``high``, with moments; and the rows that are not clean."""

    numeric: bool
    low: np.ndarray
    high: np.ndarray
    moments: dict[str, np.ndarray]
    missing: Moments
    special: list[Moments]
    rows: dict[str, float] = field(default_factory=dict)  # weighted rows by class, outliers included
    exact: bool = True  # whether each value is a cell of its own

    @property
    def total(self) -> float:
        return sum(self.rows.values())

    def size(self) -> np.ndarray:
        return self.moments["n"] if "n" in self.moments else np.sum(list(self.moments.values()), axis=0)

    def by_split(self, splits) -> dict[str, np.ndarray]:
        """Moments of the bins [.., s0), [s0, s1), ..."""
        at = np.searchsorted(np.asarray(splits, float), self.low.astype(float), side="right")
        return self.by_group(at, len(splits) + 1)

    def by_group(self, at: np.ndarray, n: int) -> dict[str, np.ndarray]:
        out = {}
        for k, v in self.moments.items():
            if k in ("min", "max"):
                out[k] = np.full(n, np.inf if k == "min" else -np.inf)
                (np.minimum if k == "min" else np.maximum).at(out[k], at, v)
            else:
                out[k] = np.bincount(at, v, minlength=n)
        return out


def many_edges(df: DataFrame, columns: list[str], special_codes: dict | None = None, most: int | None = None, cells: int = CELLS) -> dict[str, list[float]]:
    """Edges of cells of about equal counts for each long column; columns with at most ``most`` distinct values have none.

    Distinct values are counted by sketches; of small inputs, only long columns pay for quantiles, in another pass.
    """
    if not columns:
        return {}
    codes = special_codes or {}
    value = lambda c: F.when(row_class(F.col(c), True, codes.get(c)) == CLEAN, F.col(c).cast("double"))
    most = MAX_DISTINCT if most is None else most
    at = [i / cells for i in range(1, cells)]
    distinct = [F.approx_count_distinct(value(c), 0.05).alias(f"n{i}") for i, c in enumerate(columns)]
    quantiles = lambda names: [F.percentile_approx(value(c), at, 4 * cells).alias(f"p_{c}") for c in names]
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > ONE_PASS:
        found = sizes = df.agg(*distinct, *quantiles(columns)).first()  # a further scan costs more than quantiles that are not needed
    else:
        sizes, found = df.agg(*distinct).first(), None
    long = [c for i, c in enumerate(columns) if sizes[f"n{i}"] > most]
    if not long:
        return {}
    found = found or df.agg(*quantiles(long)).first()
    return {c: [-float("inf"), *sorted(set(found[f"p_{c}"])), float("inf")] for c in long}


def check_categories(counts: dict[str, int]) -> None:
    for c, n in counts.items():
        if n > MAX_DISTINCT:
            raise ValueError(f"{c} has about {n} categories; group them to at most {MAX_DISTINCT} before binning")


def cell_edges(df: DataFrame, x: str, special_codes=None) -> list[float] | None:
    """The edges of :func:`many_edges` for one column, or None."""
    return many_edges(df, [x], {x: special_codes}).get(x)


def histogram(
    df: DataFrame, x: str, y: str, kind: str, weight: str | None = None, special_codes=None, classes: list | None = None,
    bounds: Bounds | list[Bounds] | None = None, edges: list[float] | None = None, class_weight: dict | None = None, dtype: str | None = None,
) -> Histogram:
    """The histogram of ``x``; rows with a null target are left out.

    Clean outliers count in ``rows`` only.  ``edges`` group the values of large columns.
    """
    numeric = is_numeric(df, x) if dtype is None else dtype == "numerical"
    if not numeric:
        check_categories({x: df.agg(F.approx_count_distinct(x, 0.05)).first()[0]})
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    if class_weight:
        by_class = F.lit(1.0)
        for c, factor in class_weight.items():
            by_class = F.when(F.col(y) == F.lit(c), float(factor)).otherwise(by_class)
        w = w * by_class
    value = F.col(x).cast("double") if numeric else F.col(x).cast("string")
    rows = df.where(~is_missing(F.col(y), is_numeric(df, y))).select(value.alias("x"), F.col(y).alias("y"), w.alias("w"))
    rows = rows.withColumn("class", row_class(F.col("x"), numeric, special_codes))
    if bounds is not None:
        out = is_outlier(F.col("x"), bounds, F.col("y").cast("double"))
        rows = rows.withColumn("class", F.when((F.col("class") == CLEAN) & out, "outlier").otherwise(F.col("class")))
    cell = F.col("x")
    if edges is not None and numeric:
        rows = Bucketizer(splits=edges, inputCol="x", outputCol="cell", handleInvalid="keep").transform(rows)
        cell = F.col("cell")
    columns = moment_columns(kind, F.col("y"), F.col("w"), classes)
    table = (
        rows.groupBy("class", F.when(F.col("class") == CLEAN, cell).alias("cell"))
        .agg(F.min(F.when(F.col("class") == CLEAN, F.col("x"))).alias("low"), F.max(F.when(F.col("class") == CLEAN, F.col("x"))).alias("high"), F.sum("w").alias("rows"), *[c.alias(f"m_{k}") for k, c in columns.items()])
        .toPandas()
    )
    names = list(columns)
    pick = lambda r: {k: float(r[f"m_{k}"]) for k in names}
    clean = table[table["class"] == CLEAN].sort_values("low")
    labels = special_labels(special_codes)
    special, missing = [no_moments(names) for _ in labels], no_moments(names)
    for _, r in table[table["class"] != CLEAN].iterrows():
        if r["class"] == MISSING:
            missing = pick(r)
        elif r["class"].startswith(SPECIAL):
            special[int(r["class"].split(":")[1])] = pick(r)
    return Histogram(
        numeric,
        clean["low"].to_numpy(float if numeric else object),
        clean["high"].to_numpy(float if numeric else object),
        {k: clean[f"m_{k}"].to_numpy(float) for k in names},
        missing,
        special,
        {r["class"]: float(r["rows"]) for _, r in table.groupby("class", as_index=False)["rows"].sum().iterrows()},
        edges is None,
    )


def refine(h: Histogram, df: DataFrame, x: str, y: str, kind: str, cells: np.ndarray) -> Histogram:
    """``h`` of the clean values of ``x`` with these cells by value, or by smaller cells if they hold too many values.

    A row is placed by one search in the ends of the cells, however many there are.
    """
    nexts = np.append(h.low, np.inf)  # no value lies between a cell and the next one
    splits = sorted({-np.inf, np.inf, *h.low[cells].tolist(), *nexts[cells + 1].tolist()})
    wanted = np.searchsorted(splits, h.low[cells]).astype(float).tolist()
    place = Bucketizer(splits=splits, inputCol="_x", outputCol="_place", handleInvalid="keep")
    rows = place.transform(df.withColumn("_x", F.col(x).cast("double"))).where(F.col("_place").isin(wanted)).drop("_x", "_place")
    edges = many_edges(rows, [x], most=FEW, cells=FINE_CELLS).get(x)
    if edges is not None:
        # a new cell stays inside an old one, and no cell of several values comes back whole
        ends = h.low[cells].tolist() + h.high[cells].tolist()
        edges = sorted({*edges, *ends})
    new = histogram(rows, x, y, kind, edges=edges)
    keep = np.setdiff1d(np.arange(len(h.low)), cells)
    low = np.concatenate([h.low[keep], new.low])
    order = np.argsort(low, kind="stable")
    high = np.concatenate([h.high[keep], new.high])[order]
    moments = {k: np.concatenate([m[keep], new.moments[k]])[order] for k, m in h.moments.items()}
    return Histogram(True, low[order], high, moments, h.missing, h.special, h.rows, bool((low[order] == high).all()))


def histograms(
    df: DataFrame, variables: dict[str, bool], y: str, kind: str, weight: str | None = None, special_codes: dict | None = None, classes: list | None = None,
    splits: dict[str, list[float]] | None = None,
) -> dict[str, Histogram]:
    """Histograms of many columns from one aggregation (two if some columns are long).

    ``variables`` says of each column whether it is numeric, ``special_codes`` may have codes by column.
    Numeric columns with ``splits`` have the bins at these as their cells, at every size.
    """
    codes = special_codes or {}
    rows = df.where(~is_missing(F.col(y), is_numeric(df, y)))
    numeric = [v for v, is_number in variables.items() if is_number]
    texts = [v for v, is_number in variables.items() if not is_number]
    if texts:
        found = rows.agg(*[F.approx_count_distinct(v, 0.05).alias(f"n{i}") for i, v in enumerate(texts)]).first()
        check_categories({v: found[f"n{i}"] for i, v in enumerate(texts)})
    given = {v: [-np.inf, *sorted(map(float, s)), np.inf] for v, s in (splits or {}).items() if v in numeric and len(s)}
    edges = given | many_edges(rows, [v for v in numeric if v not in given], codes)
    if edges:
        long = list(edges)
        doubles = rows.withColumns({f"_v{i}": F.col(v).cast("double") for i, v in enumerate(long)})
        cut = Bucketizer(splitsArray=[edges[v] for v in long], inputCols=[f"_v{i}" for i in range(len(long))], outputCols=[f"_c{i}" for i in range(len(long))], handleInvalid="keep")
        rows = cut.transform(doubles)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    parts = []
    for i, (v, is_number) in enumerate(variables.items()):
        x = F.col(v).cast("double") if is_number else F.col(v).cast("string")
        number = x if is_number else F.lit(None).cast("double")
        cell = F.col(f"_c{list(edges).index(v)}") if v in edges else number
        parts.append(F.struct(F.lit(i).alias("i"), row_class(x, is_number, codes.get(v)).alias("class"), number.alias("x"), cell.alias("cell"), (F.lit(None).cast("string") if is_number else x).alias("name")))
    long_form = rows.select(F.col(y).alias("y"), w.alias("w"), F.explode(F.array(*parts)).alias("v")).select("y", "w", "v.*")
    clean = F.col("class") == CLEAN
    columns = moment_columns(kind, F.col("y"), F.col("w"), classes)
    table = (
        long_form.groupBy("i", "class", F.when(clean, F.col("cell")).alias("cell"), F.when(clean, F.col("name")).alias("name"))
        .agg(F.min(F.when(clean, F.col("x"))).alias("low"), F.max(F.when(clean, F.col("x"))).alias("high"), F.sum("w").alias("rows"), *[c.alias(f"m_{k}") for k, c in columns.items()])
        .toPandas()
    )
    names = list(columns)
    out = {}
    for i, (v, is_number) in enumerate(variables.items()):
        own = table[table["i"] == i]
        good = own[own["class"] == CLEAN].sort_values("low" if is_number else "name")
        rest = {r["class"]: {k: float(r[f"m_{k}"]) for k in names} for _, r in own[own["class"] != CLEAN].iterrows()}
        low, high = (good["low"].to_numpy(float), good["high"].to_numpy(float)) if is_number else (good["name"].to_numpy(object),) * 2
        special = [rest.get(f"{SPECIAL}:{k}", no_moments(names)) for k in range(len(special_labels(codes.get(v))))]
        out[v] = Histogram(
            is_number, low, high, {k: good[f"m_{k}"].to_numpy(float) for k in names}, rest.get(MISSING, no_moments(names)), special,
            {c: float(n) for c, n in own.groupby("class")["rows"].sum().items()}, v not in edges,
        )
    return out


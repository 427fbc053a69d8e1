"""Incremental binning over chunks or streams from mergeable state.

State is a small table: for a numeric variable two KLL sketches (events and
nonevents) and counts of missing and special rows; for a categorical one counts
by category.  Chunks may be added and states merged in any order.  ``solve`` may
be called as often as wanted.
"""

from __future__ import annotations

import json
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.binning import BinaryBinner, BinningModel, NotFittedError, _need, summary
from ..operators.histogram import MAX_DISTINCT, Histogram
from ..operators.process import select
from ..operators.rows import is_missing, is_numeric, row_class, special_labels

FACTS = "facts"  # the kind of the row that holds counts and parameters
STATE = "variable string, kind string, label string, event boolean, n long, sketch binary"


class NotDataAddedError(ValueError):
    """``solve`` was called before any data were added."""


class NotSolvedError(NotFittedError):
    """A result was asked for before ``solve``."""


def chunk_state(df: DataFrame, variables: dict[str, bool], y: str, special_codes=None, k: int = 2000) -> DataFrame:
    """The state of a chunk: one scan, partial aggregation of sketches on the executors.

    ``variables`` says whether each is numeric.  Rows with a null target are left out.
    """
    rows = df.where(~is_missing(F.col(y), is_numeric(df, y)))
    parts = []
    for v, numeric in variables.items():
        x = F.col(v).cast("double") if numeric else F.col(v).cast("string")
        parts.append(F.struct(
            F.lit(v).alias("variable"), row_class(x, numeric, special_codes).alias("kind"),
            (F.lit(None).cast("string") if numeric else x).alias("label"), (x if numeric else F.lit(None).cast("double")).alias("x"),
        ))
    long_form = rows.select((F.col(y) != 0).alias("event"), F.explode(F.array(*parts)).alias("v")).select("event", "v.*")
    clean = F.col("kind") == "clean"
    return long_form.groupBy("variable", "kind", F.when(clean, F.col("label")).alias("label"), "event").agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double(F.when(clean, F.col("x")), F.lit(k)).alias("sketch")
    ).select("variable", "kind", "label", "event", "n", "sketch")


def merge_states(*states: DataFrame) -> DataFrame:
    """One state of several; merging is associative and commutative but for the sketches' error."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    return both.groupBy("variable", "kind", "label", "event").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch")).select("variable", "kind", "label", "event", "n", "sketch")


def sketch_quantiles(state: DataFrame, variable: str, shares: list[float]) -> list[float]:
    """Quantiles of the clean values of a variable."""
    whole = state.where((F.col("variable") == variable) & (F.col("kind") == "clean")).agg(F.kll_merge_agg_double("sketch").alias("s"))
    row = whole.select(*[F.kll_sketch_get_quantile_double("s", F.lit(float(q))).alias(f"q{i}") for i, q in enumerate(shares)]).first()
    return [row[f"q{i}"] for i in range(len(shares))]


class QuantileSketch:
    """A mergeable quantile summary of one column."""

    def __init__(self, spark: SparkSession, eps: float = 0.01) -> None:
        _need(isinstance(eps, int | float) and 0 <= eps <= 1, ValueError, "eps is in [0, 1]")
        self.spark, self.eps = spark, eps
        self.k = int(min(65535, max(8, 3 / max(eps, 5e-5))))
        self.state: bytes | None = None
        self.n = 0

    def add(self, df: DataFrame, column: str) -> QuantileSketch:
        row = df.where(~is_missing(F.col(column), True)).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(self.k)).alias("s"), F.count("*").alias("n")).first()
        if row["n"]:
            self._take(bytes(row["s"]), row["n"])
        return self

    def mergeable(self, other: QuantileSketch) -> bool:
        return self.eps == other.eps

    def merge(self, other: QuantileSketch) -> QuantileSketch:
        _need(self.mergeable(other), ValueError, "sketches have different eps")
        if other.n:
            self._take(other.state, other.n)
        return self

    def copy(self) -> QuantileSketch:
        out = QuantileSketch(self.spark, self.eps)
        out.state, out.n = self.state, self.n
        return out

    def _take(self, state: bytes, n: int) -> None:
        if self.state is None:
            self.state = state
        else:
            rows = self.spark.createDataFrame([(bytearray(self.state),), (bytearray(state),)], "s binary")
            self.state = bytes(rows.agg(F.kll_merge_agg_double("s").alias("s")).first()["s"])
        self.n += n

    def quantile(self, q: float) -> float:
        _need(self.n > 0, NotDataAddedError, "no data were added")
        return self.spark.createDataFrame([(bytearray(self.state),)], "s binary").select(F.kll_sketch_get_quantile_double("s", F.lit(float(q))).alias("q")).first()["q"]


class StreamingBinner:
    """Add chunks, merge with others, solve, repeat."""

    def __init__(self, spark: SparkSession, variables: dict[str, str] | list[str], y: str, state_path: str | None = None, eps: float = 1e-4, cat_heuristic: bool = False, selection_criteria: dict | None = None, fixed_variables: list[str] | None = None, **options: Any) -> None:
        """``variables`` gives each its dtype.

        With ``state_path``, a folder that survives this process, every addition writes a new version
        of the state there, with the number of its batch, and a new object begins with the last
        complete one: a restarted stream goes on where it stopped.
        """
        self.spark, self.y, self.state_path, self.eps = spark, y, state_path, eps
        self.variables = variables if isinstance(variables, dict) else dict.fromkeys(variables, "numerical")
        _need(all(d in ("numerical", "categorical") for d in self.variables.values()), ValueError, "dtype is numerical or categorical")
        _need(not isinstance(options.get("special_codes"), dict), TypeError, "special_codes is a list")
        self.cat_heuristic, self.selection_criteria, self.fixed_variables, self.options = cat_heuristic, selection_criteria, fixed_variables, options
        self.k = int(min(65535, max(8, 3 / max(eps, 5e-5))))
        BinaryBinner(**options)  # checks the options
        self.state: DataFrame | None = None
        self.adds, self.records, self.progress = 0, 0, []
        self.models: dict[str, BinningModel] = {}
        self.last_batch, self.version = -1, 0
        if state_path:
            self._load()

    # ------------------------------------------------ adding

    def _folder(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.state_path}/{name}" if name else self.state_path)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _versions(self) -> list[str]:
        """The complete versions of the state, oldest first."""
        path, fs = self._folder()
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if n.startswith("state-") and self._folder(f"{n}/_SUCCESS")[1].exists(self._folder(f"{n}/_SUCCESS")[0]))

    def _load(self) -> None:
        versions = self._versions()
        if not versions:
            return
        rows = self.spark.read.schema(STATE).parquet(f"{self.state_path}/{versions[-1]}").collect()
        facts = json.loads(next(r["label"] for r in rows if r["kind"] == FACTS))
        _need(facts["variables"] == self.variables and facts["y"] == self.y and facts["eps"] == self.eps, ValueError, "the state was written with other parameters")
        self.adds, self.records, self.last_batch, self.version = facts["adds"], facts["records"], facts["last_batch"], facts["version"]
        kept = [r for r in rows if r["kind"] != FACTS]
        self.state = self.spark.createDataFrame(kept, STATE) if kept else None

    def _save(self) -> None:
        """Write the state, with the batch that it includes, as a version of its own; the one before stays until the next."""
        if not self.state_path:
            return
        old = self._versions()
        self.version += 1
        facts = {"variables": self.variables, "y": self.y, "eps": self.eps, "adds": self.adds, "records": self.records, "last_batch": self.last_batch, "version": self.version}
        row = self.spark.createDataFrame([(None, FACTS, json.dumps(facts), None, None, None)], STATE)
        # an incomplete version of the same number is left from a run that was cut off
        (row if self.state is None else self.state.unionByName(row)).coalesce(1).write.mode("overwrite").parquet(f"{self.state_path}/state-{self.version:012d}")
        for name in old[:-1]:
            path, fs = self._folder(name)
            fs.delete(path, True)

    def add(self, df: DataFrame) -> StreamingBinner:
        """Add a chunk; it may hold some of the variables only, other columns are ignored."""
        present = {v: d == "numerical" for v, d in self.variables.items() if v in df.columns}
        if present:
            self._keep(chunk_state(df, present, self.y, self.options.get("special_codes"), self.k))
        self.adds += 1
        self.records += df.where(F.col(self.y).isNotNull()).count()
        self._save()
        return self

    def _keep(self, more: DataFrame) -> None:
        merged = more if self.state is None else merge_states(self.state, more)
        # the merged state is a few rows for each variable: it is brought to the driver to cut the lineage of chunks
        rows = merged.limit(MAX_DISTINCT + 1).collect()
        _need(len(rows) <= MAX_DISTINCT, ValueError, f"more than {MAX_DISTINCT} categories")
        self.state = self.spark.createDataFrame(rows, STATE)

    def foreach_batch(self, batch: DataFrame, batch_id: int) -> None:
        """For ``writeStream.foreachBatch``; a batch that the state includes is not added again."""
        if batch_id > self.last_batch:
            self.last_batch = batch_id
            self.add(batch)

    def start(self, stream: DataFrame, checkpoint: str, **trigger: Any):
        """Start a query that adds each micro-batch of a stream."""
        return stream.writeStream.foreachBatch(self.foreach_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def mergeable(self, other: StreamingBinner) -> bool:
        return (self.variables, self.eps, self.options, self.y) == (other.variables, other.eps, other.options, other.y)

    def merge(self, other: StreamingBinner) -> StreamingBinner:
        _need(self.mergeable(other), ValueError, "binners have different parameters")
        if other.state is not None:
            self._keep(other.state)
        self.adds += other.adds
        self.records += other.records
        self._save()
        return self

    # ------------------------------------------------ solving

    def solve(self) -> StreamingBinner:
        _need(self.state is not None, NotDataAddedError, "no data were added")
        rows = self.state.select("variable", "kind", "label", "event", "n").toPandas()
        for v, dtype in self.variables.items():
            own = rows[rows["variable"] == v]
            if len(own):
                h = self._numeric(v, own) if dtype == "numerical" else self._categorical(own)
                options = {"name": v, "dtype": dtype} | self.options
                binner = BinaryBinner(**options)
                if dtype == "numerical":
                    splits = np.asarray(h.high[:-1])
                    if options.get("split_digits") is not None:
                        splits = np.unique(np.round(splits, options["split_digits"]))
                    binner.user_splits = splits.tolist()
                elif self.cat_heuristic and len(h.low) > 1:
                    binner.user_splits = self._groups(h)
                self.models[v] = binner.fit_histogram(h)
        table = summary(list(self.models.values()))
        self.support = select(table, self.selection_criteria, self.fixed_variables)
        self.table = table.assign(selected=self.support)
        self.progress.append({"solve": len(self.progress) + 1, "n_add": self.adds, "n_records": self.records, "divergence": float(table["iv"].sum())})
        return self

    def _rest(self, own: pd.DataFrame) -> tuple[dict, list[dict]]:
        count = lambda kind, event: float(own[(own["kind"] == kind) & (own["event"] == event)]["n"].sum())
        both = lambda kind: {"n0": count(kind, False), "n1": count(kind, True)}
        return both("missing"), [both(f"special:{i}") for i in range(len(special_labels(self.options.get("special_codes"))))]

    def _numeric(self, v: str, own: pd.DataFrame) -> Histogram:
        """Cells between equally spaced quantiles; a cell's counts come from the ranks of its ends in both sketches."""
        n = int(self.options.get("max_n_prebins", 20))
        splits = sorted(set(sketch_quantiles(self.state, v, [i / n for i in range(1, n)])) - {None})
        clean = self.state.where((F.col("variable") == v) & (F.col("kind") == "clean"))
        ranks = clean.select("event", "n", *[F.kll_sketch_get_rank_double("sketch", F.lit(float(np.nextafter(s, -np.inf)))).alias(f"r{i}") for i, s in enumerate(splits)]).collect()
        counts = {False: np.zeros(len(splits) + 1), True: np.zeros(len(splits) + 1)}
        for r in ranks:
            upto = np.rint(np.array([*(r[f"r{i}"] * r["n"] for i in range(len(splits))), r["n"]]))
            counts[r["event"]] = np.diff(np.concatenate([[0], upto]))
        missing, special = self._rest(own)
        low, high = np.array([-np.inf, *splits]), np.array([*splits, np.inf])
        total = {k: float(own[own["kind"] == k]["n"].sum()) for k in own["kind"].unique()}
        return Histogram(True, low, high, {"n0": counts[False], "n1": counts[True]}, missing, special, total, False)

    def _categorical(self, own: pd.DataFrame) -> Histogram:
        clean = own[own["kind"] == "clean"]
        labels = sorted(clean["label"].unique())
        count = lambda e: clean[clean["event"] == e].groupby("label")["n"].sum().reindex(labels).fillna(0).to_numpy(float)
        n0, n1 = count(False), count(True)
        names = np.array(labels, object)
        missing, special = self._rest(own)
        total = {k: float(own[own["kind"] == k]["n"].sum()) for k in own["kind"].unique()}
        return Histogram(False, names, names, {"n0": n0, "n1": n1}, missing, special, total)

    def _groups(self, h: Histogram) -> list[list[str]]:
        """Categories in the order of their rate; those with fewer rows than an even share of the prebins join the next one."""
        size = h.size()
        least = size.sum() / int(self.options.get("max_n_prebins", 20))
        groups: list[list[str]] = [[]]
        held = 0.0
        for i in np.lexsort((h.low.astype(str), h.moments["n1"] / np.maximum(1, size))):
            groups[-1].append(str(h.low[i]))
            held += size[i]
            if held >= least:
                groups.append([])
                held = 0.0
        if len(groups) > 1 and len(groups[-1]) == 0:
            groups.pop()
        elif len(groups) > 1 and held < least:
            last = groups.pop()
            groups[-1] += last
        return groups

    def _solved(self) -> None:
        if not self.models:
            raise NotSolvedError("call solve first")

    def get_binned_variable(self, name: str) -> BinningModel:
        self._solved()
        return self.models[name]

    def get_support(self, names: bool = False):
        self._solved()
        return [v for v, s in zip(self.models, self.support, strict=True) if s] if names else list(self.support)

    def summary(self) -> pd.DataFrame:
        self._solved()
        return self.table

    def transform(self, df: DataFrame, keep: list[str] | None = None, **kwargs) -> DataFrame:
        self._solved()
        return df.select(*[F.col(c) for c in keep or []], *[self.models[v].encode(F.col(v), **kwargs).alias(v) for v in self.get_support(names=True)])

    def progress_frame(self) -> DataFrame:
        """The divergence of each solve with its running mean, standard error and 95 % band."""
        _need(bool(self.progress), NotSolvedError, "call solve first")
        return progress_band(self.spark.createDataFrame(self.progress, "solve long, n_add long, n_records long, divergence double"))

    def information(self, print_level: int = 1) -> str:
        head = f"variables {len(self.variables)}, adds {self.adds}, records {self.records}, solves {len(self.progress)}"
        return "\n".join([head, *(m.information(print_level) for m in self.models.values())])


def progress_band(df: DataFrame, order: str = "solve", value: str = "divergence") -> DataFrame:
    """Add the running mean of ``value``, its standard error (null for the first row) and the 95 % band."""
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    error = F.stddev_samp(value).over(upto) / F.sqrt(F.count(value).over(upto))
    out = df.withColumn("mean", F.avg(value).over(upto)).withColumn("stderr", error)
    return out.withColumn("low", F.col("mean") - 1.959963984540054 * F.col("stderr")).withColumn("high", F.col("mean") + 1.959963984540054 * F.col("stderr"))

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Figures are medians of three runs after one warm-up, in seconds.  They follow
alone, two-dimensional grids, and the throughput of an encoding projection.
"""

from __future__ import annotations

import json
import os
import statistics
import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera import queries as q
from tessera.operators.binning import BinaryBinner, ContinuousBinner
from tessera.operators.binning2d import Binner2D
from tessera.operators.process import BinningPipeline
from tessera.operators.scorecard import Scorecard


def timed(f, runs: int = 3) -> float:
    f()
    out = []
    for _ in range(runs):
        began = time.perf_counter()
        f()
        out.append(time.perf_counter() - began)
    return round(statistics.median(out), 4)


def prebins(n: int, seed: int = 1) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    rate = np.clip(np.linspace(0.05, 0.6, n) + random.normal(0, 0.03, n), 0.01, 0.99)
    size = random.integers(2000, 6000, n)
    return {"n0": np.rint(size * (1 - rate)), "n1": np.rint(size * rate)}


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    df = q.lines(spark, sf).cache()
    rows = df.count()
    six = ["l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    out: dict[str, float] = {}
    out["fit_one_variable"] = timed(lambda: BinaryBinner().fit(df, "l_extendedprice", "y1"))
    out["fit_one_continuous"] = timed(lambda: ContinuousBinner().fit(df, "l_extendedprice", "yc"))
    out["fit_six_variables"] = timed(lambda: BinningPipeline(six, max_pvalue=0.05).fit(df, "y1"))
    out["fit_per_variable"] = round(out["fit_six_variables"] / len(six), 4)
    out["fit_categorical"] = timed(lambda: BinaryBinner(dtype="categorical").fit(df, "l_returnflag", "y1"))
    model = BinaryBinner().fit(df, "l_extendedprice", "y1")
    out["transform_woe"] = timed(lambda: df.select(model.encode(F.col("l_extendedprice")).alias("w")).write.format("noop").mode("overwrite").save())
    out["scorecard_fit"] = timed(lambda: Scorecard(BinningPipeline(six[:4])).fit(df, "y1"), 1)
    for n in (9, 20, 100):
        for trend in ("ascending", "peak"):
            out[f"solver_{n}_{trend}"] = timed(lambda n=n, trend=trend: BinaryBinner(monotonic_trend=trend)._optimise(prebins(n), 1e6, None))
    out["grid_5x5"] = timed(lambda: Binner2D().fit(df, "l_extendedprice", "l_quantity", "y1"), 1)
    out["grid_10x10_cart"] = timed(lambda: Binner2D(max_n_prebins_x=10, max_n_prebins_y=10, strategy="cart").fit(df, "l_extendedprice", "l_quantity", "y1"), 1)
    print(json.dumps({"metric": "fit_six_variables", "value": out["fit_six_variables"], "unit": "sec", "queries": out, "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "rows": rows}))
    spark.stop()


if __name__ == "__main__":
    main()

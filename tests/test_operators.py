"""Estimators: validation, nulls, persistence, sources, streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators.binning import MDLP, BinaryBinner, BinningModel, ContinuousBinner, MulticlassBinner, NotFittedError, ScenarioBinner
from tessera.operators.binning2d import Binner2D, Model2D
from tessera.operators.counterfactual import Counterfactual, InfeasibleError, NotGeneratedError
from tessera.operators.histogram import histogram
from tessera.operators.monitoring import Monitoring
from tessera.operators.piecewise import PiecewiseBinner
from tessera.operators.process import BinningPipeline, select, target_kind
from tessera.operators.scorecard import Scorecard, round_points
from tessera.operators.splits import cart_splits, mdlp_splits
from tessera.sources.files import fit_transform_disk, read_column, read_table, transform_disk
from tessera.streaming.sketch import NotDataAddedError, QuantileSketch, StreamingBinner


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(0)
    n = 3000
    x = r.normal(0, 1, n)
    t = pd.DataFrame({"x": x, "z": r.uniform(0, 1, n), "c": r.choice(list("abcde"), n), "y": (r.uniform(0, 1, n) < 1 / (1 + np.exp(-2 * x))).astype(int), "v": 3 * x + r.normal(0, 1, n)})
    t["m"] = np.where(t["x"] < -0.4, 0, np.where(t["z"] < 0.5, 1, 2))
    t.loc[:50, "x"] = np.nan
    t.loc[51:100, "x"] = -999
    return spark.createDataFrame(t).withColumn("y", F.when(F.col("z") < 0.99, F.col("y"))).cache()


@pytest.mark.parametrize(("options", "error"), [
    ({"name": 1}, TypeError), ({"dtype": "x"}, ValueError), ({"prebinning_method": "x"}, ValueError), ({"solver": "x"}, ValueError), ({"divergence": "x"}, ValueError),
    ({"max_n_prebins": 1}, ValueError), ({"min_prebin_size": 0.6}, ValueError), ({"min_n_bins": -1}, ValueError), ({"min_n_bins": 3, "max_n_bins": 2}, ValueError),
    ({"min_bin_size": 0.6}, ValueError), ({"max_bin_size": 1.1}, ValueError), ({"min_bin_n_event": 0}, ValueError), ({"monotonic_trend": "x"}, ValueError),
    ({"min_event_rate_diff": 2}, ValueError), ({"max_pvalue": 1.1}, ValueError), ({"max_pvalue_policy": "x"}, ValueError), ({"gamma": -1}, ValueError),
    ({"outlier_detector": "x"}, ValueError), ({"outlier_params": 1}, TypeError), ({"class_weight": "x"}, ValueError), ({"cat_cutoff": 0}, ValueError),
    ({"user_splits": 1}, TypeError), ({"user_splits_fixed": [True]}, ValueError), ({"user_splits": [1, 1]}, ValueError), ({"special_codes": 1}, TypeError),
    ({"special_codes": {}}, ValueError), ({"split_digits": 9}, ValueError), ({"mip_solver": "x"}, ValueError), ({"time_limit": -1}, ValueError), ({"verbose": 1}, TypeError), ({"nothing": 1}, TypeError),
])
def test_parameters_are_checked(options, error):
    with pytest.raises(error):
        BinaryBinner(**options)


def test_not_fitted(data):
    for f in (lambda: BinaryBinner().transform(data, "x"), lambda: BinaryBinner().splits, lambda: BinningPipeline(["x"]).summary(), lambda: Binner2D().transform(data, "x", "z", "o"), lambda: PiecewiseBinner().transform(data, "x", "o")):
        with pytest.raises(NotFittedError):
            f()


def test_null_targets_are_left_out_and_classes_add_up(data):
    m = BinaryBinner(special_codes=[-999]).fit(data, "x", "y")
    rows = m.table().records
    assert rows.sum() == data.where("y is not null").count()
    assert rows[-2] == data.where("y is not null and x = -999").count() and rows[-1] == data.where("y is not null and isnan(x)").count()
    assert m.status == "OPTIMAL" and m.trend == "ascending"


def test_json_keeps_the_whole_model(data, tmp_path):
    for b, x, y in ((BinaryBinner(special_codes={"s": [-999]}), "x", "y"), (ContinuousBinner(), "x", "v"), (MulticlassBinner(), "x", "m"), (BinaryBinner(dtype="categorical", cat_cutoff=0.1), "c", "y")):
        m = b.fit(data, x, y)
        m.to_json(str(tmp_path / "m.json"))
        again = BinningModel.read_json(str(tmp_path / "m.json"))
        a, c = (k.transform(data, x, "o").select("o").toPandas()["o"] for k in (m, again))
        pd.testing.assert_series_equal(a, c)
        assert m.information(2)


def test_all_missing_and_constant_columns(spark):
    df = spark.createDataFrame([(None, 1.0, 0), (None, 1.0, 1)] * 5, "a double, b double, y int")
    for x in ("a", "b"):
        m = BinaryBinner().fit(df, x, "y")
        assert m.n_bins == 1 and m.table().records.sum() == 10
    assert BinaryBinner(dtype="categorical").fit(df.withColumn("c", F.lit(None).cast("string")), "c", "y").table().records.sum() == 10


def test_cart_splits_need_their_leaf_size(data):
    h = histogram(data.where("x > -100"), "x", "y", "binary")
    s = cart_splits(h, "binary", 20, 0.05 * h.size().sum())
    sizes = np.add(*[h.by_split(s)[k] for k in ("n0", "n1")])
    assert len(s) > 2 and sizes.min() >= 0.05 * h.size().sum() - 1
    assert len(cart_splits(h, "binary", 3, 1)) == 2
    assert len(mdlp_splits(h)) >= 1 and len(MDLP().fit(data.where("x > -100"), "x", "y").splits) >= 1


def test_affine_change_of_x_moves_the_splits(data):
    a = BinaryBinner(prebinning_method="quantile").fit(data.where("x > -100"), "x", "y")
    b = BinaryBinner(prebinning_method="quantile").fit(data.where("x > -100").withColumn("x", F.col("x") * 4 + 8), "x", "y")
    assert np.allclose(np.array(a.splits) * 4 + 8, b.splits) and a.moments == b.moments


def test_scenarios_hold_in_each(data):
    b = ScenarioBinner(monotonic_trend="ascending")
    m = b.fit(data.where("x > -100").withColumn("s", F.when(F.col("z") < 0.5, 0).otherwise(1)), "x", "y", "s")
    for s in (0, 1):
        t = b.scenario_table(s)
        assert (np.diff(t.event_rate[: t.n_bins]) >= -1e-6).all()
    assert m.n_bins > 1


def test_two_columns(data, tmp_path):
    m = Binner2D(special_codes_x=[-999], monotonic_trend_x="ascending").fit(data, "x", "z", "y")
    assert m.table().records.sum() == data.where("y is not null").count()
    covered = np.zeros((m.y.n, m.x.n), int)
    for t, a, b, r in m.rectangles:
        covered[t : b + 1, a : r + 1] += 1
    assert (covered == 1).all()
    m.to_json(str(tmp_path / "m.json"))
    again = Model2D.read_json(str(tmp_path / "m.json"))
    pd.testing.assert_frame_equal(m.build(), again.build())
    assert m.transform(data, "x", "z", "o", metric="bins").where("o is null").count() == 0
    assert Binner2D(dtype_y="categorical", strategy="cart", kind="continuous").fit(data, "x", "c", "v").status == "OPTIMAL"
    m.analysis()


def test_process_scorecard_monitoring_and_changes(spark, data, tmp_path):
    clean = data.where("y is not null")
    assert [target_kind(data, y) for y in ("y", "m", "v", "c")] == ["binary", "multiclass", "continuous", "multiclass"]
    p = BinningPipeline(["x", "z", "c"], special_codes=[-999], categorical_variables=["c"], selection_criteria={"iv": {"top": 2}}).fit(clean, "y")
    single = BinaryBinner(special_codes=[-999], name="x").fit(clean, "x", "y")
    assert p.get_binned_variable("x").moments == single.moments and sum(p.get_support()) == 2
    p.save(str(tmp_path / "p.json"))
    assert BinningPipeline.load(str(tmp_path / "p.json")).get_support() == p.get_support()
    card = Scorecard(BinningPipeline(["x", "z"], special_codes=[-999]), scaling_method="min_max", scaling_method_params={"min": 0, "max": 100}).fit(clean, "y")
    low, high = card.score(clean).agg(F.min("score"), F.max("score")).first()
    assert low >= -1e-6 and high <= 100 + 1e-6
    card.save(str(tmp_path / "c.json"))
    assert Scorecard.load(str(tmp_path / "c.json")).points == card.points
    mon = Monitoring(card).fit(clean.where("z < 0.5"), clean.where("z >= 0.5"), "y")
    assert "PSI" in mon.system_stability_report() and (mon.psi_variable_table()["psi"] >= 0).all()
    cf = Counterfactual(card).fit(clean)
    with pytest.raises(NotGeneratedError):
        cf.display()
    row = card.predict(clean, "p").where("p = 0").first().asDict()
    cf.generate(row, 1, "binary", max_changes=2)
    assert cf.display(show_outcome=True)["outcome"].iloc[0] > 0.5
    with pytest.raises(InfeasibleError):
        cf.generate(row, 1, "binary", actionable_features=[])
    with pytest.raises(ValueError):
        cf.generate(row, 2, "binary")


def test_rounded_points_keep_the_sums():
    r = np.random.default_rng(3)
    points = [r.uniform(-50, 50, 5) for _ in range(6)]
    out = round_points(points)
    assert sum(p.min() for p in out) == np.rint(sum(p.min() for p in points)) and sum(p.max() for p in out) == np.rint(sum(p.max() for p in points))
    assert all((p == np.rint(p)).all() for p in out)


def test_selection_is_metric_by_metric():
    t = pd.DataFrame({"name": list("abcd"), "iv": [0.1, 0.4, 0.3, 0.2], "gini": [4, 1, 2, 3]})
    assert select(t, {"iv": {"min": 0.15, "top": 2}, "gini": {"top": 1, "strategy": "lowest"}}, ["d"]) == [False, True, False, True]
    assert select(t, {"iv": {"top": 0.5}}) == [False, True, True, False]


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_files(spark, data, tmp_path, kind):
    source, out = str(tmp_path / f"in.{kind}"), str(tmp_path / f"out.{kind}")
    rows = data.where("y is not null").select("x", "z", "y")
    (rows.write.option("header", "true").csv(source) if kind == "csv" else rows.write.parquet(source))
    p = BinningPipeline(["x", "z"])
    fit_transform_disk(spark, p, source, out, "y")
    assert read_table(spark, out).count() == rows.count()
    transform_disk(spark, p, source, out, mode="overwrite", metric="event_rate")
    assert read_column(spark, source, "x").columns == ["x"]
    with pytest.raises(ValueError):
        read_table(spark, "x.json")


def test_streams_merge_like_batches(spark, data, tmp_path):
    clean = data.where("y is not null and x > -100")
    a, b = (StreamingBinner(spark, {"x": "numerical", "c": "categorical"}, "y") for _ in range(2))
    with pytest.raises(NotDataAddedError):
        a.solve()
    a.add(clean.where("z < 0.3")).add(clean.where("z >= 0.3 and z < 0.6"))
    b.add(clean.where("z >= 0.6"))
    a.merge(b).solve()
    solved = a.get_binned_variable("x")
    exact = BinaryBinner(user_splits=solved.splits, user_splits_fixed=[True] * len(solved.splits), monotonic_trend=None).fit(clean, "x", "y")
    assert solved.table().metrics()["iv"] == pytest.approx(exact.table().metrics()["iv"], rel=1e-2)
    assert a.records == clean.count() and a.progress_frame().count() == 1
    with pytest.raises(ValueError):
        a.merge(StreamingBinner(spark, {"x": "numerical"}, "y"))
    clean.select("x", "c", "y").repartition(3).write.parquet(str(tmp_path / "in"))
    c = StreamingBinner(spark, {"x": "numerical", "c": "categorical"}, "y")
    stream = spark.readStream.schema("x double, c string, y long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    c.start(stream, str(tmp_path / "ck")).awaitTermination()
    assert c.records == clean.count() and c.solve().models["x"].table().records.sum() == clean.count()


def test_small_categories_stand_together_in_streams(spark, data):
    b = StreamingBinner(spark, {"c": "categorical"}, "y", cat_heuristic=True, max_n_prebins=3)
    m = b.add(data.where("y is not null")).solve().models["c"]
    assert sorted(c for g in m.groups for c in g) == list("abcde") and m.table().records.sum() == data.where("y is not null").count()


def test_bounds_hold_together(data):
    from tessera.operators.rows import within

    kept = within(data, "x", -1, 1).toPandas()["x"]
    assert kept.dropna().between(-1, 1).all() and kept.isna().sum() == 51


def test_quantile_sketch(spark, data):
    a, b = QuantileSketch(spark, 0.01), QuantileSketch(spark, 0.01)
    a.add(data.where("z < 0.5"), "z")
    b.add(data.where("z >= 0.5"), "z")
    assert a.merge(b).n == data.count() and a.quantile(0.5) == pytest.approx(0.5, abs=0.05)
    with pytest.raises(ValueError):
        a.merge(QuantileSketch(spark, 0.1))


@pytest.mark.parametrize("options", [{}, {"degree": 2}, {"objective": "huber"}, {"continuous": False}, {"degree": 0, "continuous": False}, {"regularization": "l2"}, {"regularization": "l1", "reg_l1": 0.01}, {"n_subsamples": 1500, "random_state": 1}])
def test_piecewise(data, options):
    clean = data.where("x > -100")
    m = PiecewiseBinner(kind="continuous", max_n_prebins=5, **options).fit(clean, "x", "v")
    r2 = m.metrics(clean, "x", "v").first()["r2"]
    assert r2 > 0.75
    if m.model.trend == "ascending" and options.get("degree", 1) == 1:
        assert all(c[1] >= -1e-9 for c in m.coefficients)


@pytest.mark.parametrize("one_pass", [0, 1 << 60])
def test_long_columns_are_binned_by_cells(data, monkeypatch, one_pass):
    from tessera.operators import histogram as h

    clean = data.where("x > -100")
    exact = BinaryBinner().fit(clean, "x", "y")
    monkeypatch.setattr(h, "MAX_DISTINCT", 100)
    monkeypatch.setattr(h, "ONE_PASS", one_pass)
    cells = BinaryBinner().fit(clean, "x", "y")
    assert exact.exact and not cells.exact
    assert cells.table().records.sum() == exact.table().records.sum()
    assert cells.table().metrics()["iv"] == pytest.approx(exact.table().metrics()["iv"], rel=0.05)
    shared = BinningPipeline(["x", "z"]).fit(clean, "y").get_binned_variable("x")
    assert shared.splits == cells.splits and shared.moments == cells.moments


def test_a_restarted_stream_goes_on_with_its_state(spark, tmp_path):
    source, state, marks = (str(tmp_path / n) for n in ("in", "state", "marks"))
    whole = spark.createDataFrame([(float(i % 50), "ab"[i % 2], int(i % 50 > 20)) for i in range(3000)], "x double, c string, y int")
    variables = {"x": "numerical", "c": "categorical"}

    def run(part):
        part.coalesce(1).write.mode("append").parquet(source)
        b = StreamingBinner(spark, variables, "y", state_path=state)  # a new object, as after a restart
        b.start(spark.readStream.schema(whole.schema).parquet(source), marks).awaitTermination()
        return b

    run(whole.where("x < 25"))
    last = run(whole.where("x >= 25"))
    assert (last.adds, last.records, last.last_batch) == (2, 3000, 1)
    last.foreach_batch(whole, 1)  # the batch is part of the state
    assert last.records == 3000
    once = StreamingBinner(spark, variables, "y").add(whole).solve()
    again = StreamingBinner(spark, variables, "y", state_path=state).solve()
    for v in variables:
        assert again.get_binned_variable(v).moments == once.get_binned_variable(v).moments
    with pytest.raises(ValueError):
        StreamingBinner(spark, {"x": "numerical"}, "y", state_path=state)

"""Operators on panels small enough to work out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewise import frames
from tidewise.functions import features, metrics, transforms
from tidewise.operators import backtest, detection, hierarchy, intervals, leaderboard, prepare, windows


def values(df, column="y"):
    return [r[column] for r in df.orderBy("unique_id", "ds").collect()]


def test_to_long_and_checks(spark):
    raw = spark.createDataFrame([(1, 2, "2020-01-01", 3.0), (1, None, "2020-01-02", 4.0), (1, 2, "2020-01-03", None)], "store int, dept int, week string, sales double")
    out = frames.to_long(raw, "week", "sales", "store, dept").collect()
    assert [(r["unique_id"], r["y"]) for r in out] == [("store=1|dept=2", 3.0)]
    assert frames.to_long(raw, "week", "sales").first()["unique_id"] == "series=0"
    twice = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0)], "unique_id string, ds long, y double")
    with pytest.raises(ValueError, match="unique"):
        frames.require_long(twice)
    with pytest.raises(ValueError, match="static"):
        frames.static_lookup(twice, ["y"])


def test_history_and_future(spark):
    past = spark.createDataFrame([("a", 1, 1.0)], "unique_id string, ds long, y double")
    ahead = spark.createDataFrame([("a", 2)], "unique_id string, ds long")
    assert frames.merge_history_and_future(past, ahead).count() == 2
    with pytest.raises(ValueError, match="overlap"):
        frames.merge_history_and_future(past, past.select("unique_id", "ds"))
    with pytest.raises(ValueError, match="observed"):
        frames.require_future(past)


def test_parameters():
    assert frames.parse_interval_levels("80,90") == (0.8, 0.9)
    assert frames.required_quantiles_for_interval_levels([0.8]) == (0.1, 0.5, 0.9)
    assert features.lag_steps(3) == (3, 2, 1) and features.lag_steps("1,12,2") == (12, 2, 1)
    with pytest.raises(ValueError):
        features.lag_steps([0])
    with pytest.raises(ValueError):
        frames.parse_quantiles([0.125])


def test_missing_policies(panel):
    gap = panel({"s": [1, None, None, 4]})
    assert values(prepare.prepare_long(gap, "D", "zero")) == [1, 0, 0, 4]
    assert values(prepare.prepare_long(gap, "D", "ffill")) == [1, 1, 1, 4]
    assert values(prepare.prepare_long(gap, "D", "interpolate")) == [1, 2, 3, 4]
    assert values(prepare.prepare_long(gap, "D", "drop")) == [1, 4]
    with pytest.raises(ValueError, match="missing"):
        prepare.prepare_long(gap, "D")


def test_align_and_clip(spark, panel):
    rows = [("s", dt.datetime(2020, 1, 1, 3), 1.0), ("s", dt.datetime(2020, 1, 1, 9), 2.0), ("s", dt.datetime(2020, 1, 3), 4.0)]
    df = spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")
    assert values(prepare.align_long(df, "D", "last")) == [2.0, None, 4.0]
    assert values(prepare.align_long(df, "D", "sum")) == [3.0, 0.0, 4.0]
    clipped = prepare.clip_outliers(panel({"stable": [1, 2, 3, 4], "spiky": [1, 2, 3, 100]}))
    assert values(clipped.where("unique_id = 'spiky'"))[-1] == 65.5
    assert values(clipped.where("unique_id = 'stable'")) == [1, 2, 3, 4]


def test_frequency(spark, panel):
    monthly = spark.createDataFrame([("m", dt.datetime(2020, i, 1), 1.0) for i in (1, 2, 3)], "unique_id string, ds timestamp_ntz, y double")
    found = {r["unique_id"]: r["freq"] for r in prepare.infer_frequency(monthly.union(panel({"d": [1, 2, 3], "x": [1, 2, None, 4], "one": [1]}))).collect()}
    assert found == {"m": "MS", "d": "D", "x": None, "one": None}


def test_split_and_scaler(panel):
    df = panel({"s": range(10)})
    out = {r["y"]: r["split"] for r in prepare.split_long(df, valid_size=2, test_size=2, gap=1).collect()}
    assert [out[float(i)] for i in range(10)] == ["train"] * 4 + [None, "valid", "valid", None, "test", "test"]
    with pytest.raises(ValueError, match="train"):
        prepare.split_long(df, valid_size=9, min_train_size=5)
    scaler = prepare.fit_scaler(df, "minmax", "global")
    scaled = prepare.scale_long(df, scaler)
    assert values(scaled)[0] == 0 and values(scaled)[-1] == 1
    assert values(prepare.unscale_long(scaled, scaler)) == list(range(10))


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, 3.0, 1.0)], "unique_id string, step int, y double, yhat double")
    row = df.agg(metrics.mae().alias("mae"), metrics.mse().alias("mse"), metrics.wape().alias("wape"), metrics.pinball(0.5).alias("p")).first()
    assert (row["mae"], row["mse"], row["wape"], row["p"]) == (1.5, 2.5, 0.75, 0.75)
    assert {r["step"]: r["n_points"] for r in metrics.evaluate(df).collect()} == {None: 2, 1: 1, 2: 1}
    q = df.withColumns({"yhat_p10": F.col("yhat") - 1, "yhat_p50": F.col("yhat"), "yhat_p90": F.col("yhat") + 1})
    out = metrics.evaluate_quantiles(q).first()
    assert out["coverage_80"] == 0.5 and out["mean_width_80"] == 2 and out["interval_score_80"] == pytest.approx(2 + 10 * 0.5)


def test_conformal_takes_the_higher_value(spark):
    df = spark.createDataFrame([(float(i), 0.0, 1) for i in range(1, 8)], "y double, yhat double, step int")
    row = intervals.fit_conformal(df, (0.5, 0.7), per_step=False).first()
    assert row["radius_50"] == intervals.higher_quantile(range(1, 8), 0.5) == 4
    assert row["radius_70"] == 6
    assert intervals.apply_conformal(df, intervals.fit_conformal(df, (0.5,))).first()["yhat_hi_50"] == 4


def test_detection_flags_the_spike(panel):
    df = panel({"s": [10] * 8 + [50, 10] + [10] * 6, "quiet": [1] * 8})
    out = {(r["unique_id"], r["ds"].day): r for r in detection.detect(df, threshold_k=3.0).collect()}
    assert out["s", 9]["is_anomaly"] and out["s", 9]["score"] == float("inf")
    assert not any(r["is_anomaly"] for (k, _), r in out.items() if k == "quiet")
    assert out["s", 2]["score"] is None
    assert detection.anomaly_counts(detection.detect(df)).count() == 2


def test_splits_of_windows(spark, panel):
    df = panel({"a": [float(i) for i in range(20)], "b": [float(i) for i in range(12)]})
    found = windows.split_windows(windows.panel_arrays(windows.panel_window_frame(df, horizon=3, lags=2)), valid_size=2, test_size=3, gap=1)
    by_origin = {}
    for r in found.collect():
        by_origin.setdefault((r["unique_id"], r["cutoff_ds"]), set()).add(r["split"])
    assert all(len(v) == 1 for v in by_origin.values())
    for one, origins in (("a", 18), ("b", 10)):
        own = [next(iter(v)) for (k, _), v in sorted(by_origin.items()) if k == one]
        assert own == ["train"] * (origins - 7) + [None] + ["valid"] * 2 + [None] + ["test"] * 3
    rows = windows.split_windows(windows.supervised_frame(df, lags=3), test_frac=0.5).groupBy("unique_id", "split").count().collect()
    assert {(r["unique_id"], r["split"]): r["count"] for r in rows} == {("a", "train"): 9, ("a", "test"): 8, ("b", "train"): 5, ("b", "test"): 4}
    assert windows.split_windows(windows.supervised_frame(df.limit(0), lags=3), test_size=1).count() == 0
    with pytest.raises(ValueError):
        windows.split_windows(df, test_size=1)
    with pytest.raises(ValueError):
        windows.split_windows(windows.supervised_frame(df, lags=3), test_size=9)


def test_runs_together_equal_runs_apart(spark, panel, monkeypatch):
    """Column, kernel, ensemble, panel and refused runs in one pass, in rows of two runs each; a short series and a run that refuses all series have no rows."""
    df = panel({"s": [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9, 3], "t": [float(i % 5 + i) for i in range(16)], "short": [1, 2, 3]})
    runs = {
        "a": ("mean", None), "b": ("moving-average", {"window": 4}), "c": ("ar-ols", {"p": 2}), "d": ("ensemble-mean", {"members": ("mean", "ar-ols")}), "e": ("ssa", {"window_length": 90}),
        "f": ("ridge-step-lag-global", {"lags": 3, "add_time_features": False}),
    }
    whole = df.where("unique_id != 'short'")
    monkeypatch.setattr(backtest, "RUNS_TOGETHER", 2)
    for own, options in ((df, {"keep": "first", "n_windows": 2, "on_short": "skip"}), (whole, {"max_train_size": 8})):
        runs_of = runs if own is whole else {k: v for k, v in runs.items() if k != "f"}
        both = {(r["model"], r["unique_id"], r["cutoff"], r["step"]): (r["ds"], r["y"], r["yhat"]) for r in backtest.cross_validation_of(own, runs_of, 2, 2, 8, **options).collect()}
        apart = {(k, r["unique_id"], r["cutoff"], r["step"]): (r["ds"], r["y"], r["yhat"]) for k, (m, p) in runs_of.items() for r in backtest.cross_validation(own, m, 2, 2, 8, p, **options).collect()}
        assert both.keys() == apart.keys() and {k[0] for k in both} == runs_of.keys() - {"e"}
        for k, v in both.items():
            assert v[:2] == apart[k][:2] and (v[2] == apart[k][2] or v[2] == pytest.approx(apart[k][2]))
    plan = backtest.cross_validation_of(df, {k: runs[k] for k in "ab"}, 2, 2, 8, on_short="skip")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1
    with pytest.raises(ValueError):
        backtest.cross_validation_of(df, {}, 2)


def test_hierarchy(spark):
    raw = spark.createDataFrame([("n", "a"), ("n", "b"), ("s", "c")], "region string, store string")
    edges = frames.hierarchy_spec(raw, ["region", "store"])
    leaf = lambda r, s: f"region={r}|store={s}"
    fc = spark.createDataFrame([(leaf("n", "a"), 1, 30.0), (leaf("n", "b"), 1, 10.0), (leaf("s", "c"), 1, 60.0), ("other", 1, 5.0)], "unique_id string, ds long, yhat double")
    up = {r["unique_id"]: r["yhat"] for r in hierarchy.reconcile(fc, edges, "bottom_up").collect()}
    assert up["total"] == 100 and up["region=n"] == 40 and up["other"] == 5
    assert hierarchy.check_consistency(hierarchy.bottom_up(fc, edges), edges).count() == 0
    # What differs by the order of a sum alone agrees; what differs by more does not.
    for off, n in ((2e-6, 0), (1.0, 1)):
        large = spark.createDataFrame([("t", 1, 3e9 + off), ("a", 1, 1e9), ("b", 1, 2e9)], "unique_id string, ds long, yhat double")
        pair = spark.createDataFrame([("t", "a"), ("t", "b")], "parent string, child string")
        assert hierarchy.check_consistency(large, pair, rtol=hierarchy.ROUNDING).count() == n and hierarchy.check_consistency(large, pair).count() == 1
    root = spark.createDataFrame([("total", 2, 200.0)], "unique_id string, ds long, yhat double")
    down = {r["unique_id"]: r["yhat"] for r in hierarchy.reconcile(root, edges, "top_down", fc.withColumnRenamed("yhat", "y")).collect()}
    assert down[leaf("n", "a")] == pytest.approx(60) and down["region=s"] == pytest.approx(120)
    for bad in ([("a", "b"), ("b", "a")], [("a", "a")], [("a", "c"), ("b", "c")], [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "y")]):
        with pytest.raises(ValueError):
            hierarchy.levels(spark.createDataFrame(bad, "parent string, child string"))


def test_deep_hierarchy(spark):
    """A chain of 21 levels with a twig at each: closure, levels and shares as by hand."""
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(20)] + [(f"n{i}", f"t{i}") for i in range(20)]
    edges = spark.createDataFrame(pairs, "parent string, child string")
    depth = {r["node"]: r["level"] for r in hierarchy.levels(edges).collect()}
    assert depth == {f"n{i}": i for i in range(21)} | {f"t{i}": i + 1 for i in range(20)}
    under = {}
    for r in hierarchy.closure(edges).collect():
        under.setdefault(r["node"], []).append(r["leaf"])
    assert sorted(under["n0"]) == sorted([f"t{i}" for i in range(20)] + ["n20"]) and sorted(under["n19"]) == ["n20", "t19"] and under["t3"] == ["t3"]
    history = spark.createDataFrame([(f"t{i}", float(i + 1)) for i in range(20)] + [("n20", 5.0)], "unique_id string, y double")
    share = {r["node"]: r["share"] for r in hierarchy.shares(edges, history).collect()}
    total = sum(range(1, 21)) + 5
    assert share["n0"] == 1 and share["n20"] == pytest.approx(5 / total) and share["t7"] == pytest.approx(8 / total)


def test_evaluate_hierarchy(spark):
    edges = spark.createDataFrame([("all", "a"), ("all", "b")], "parent string, child string")
    leaves = spark.createDataFrame([("a", 1, 3.0), ("b", 1, 5.0), ("a", 2, 4.0), ("b", 2, 6.0)], "unique_id string, ds int, yhat double")
    seen = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 5.0), ("a", 2, 4.0), ("b", 2, 9.0)], "unique_id string, ds int, y double")
    rows = {r["level"]: r for r in hierarchy.evaluate_hierarchy(leaves, edges, "bottom_up", observed=seen).collect()}
    assert set(rows) == {None, 0, 1} and all(r["n_inconsistent"] == 0 for r in rows.values())
    assert rows[0]["mae"] == pytest.approx((1 + 3) / 2) and rows[1]["mae"] == pytest.approx((1 + 0 + 0 + 3) / 4)
    assert (rows[None]["n_points"], rows[None]["n_series"], rows[None]["n_timestamps"]) == (6, 3, 2)
    assert {r["level"]: r["mae"] for r in hierarchy.evaluate_hierarchy(leaves, edges, "bottom_up").collect()} == {None: None, 0: None, 1: None}


def test_splits():
    assert backtest.rolling_origin_splits(10, 2, 3, 4) == [(0, 4, 4, 6), (0, 7, 7, 9)]
    assert backtest.rolling_origin_splits(10, 2, 1, 4, 3, 2) == [(4, 7, 7, 9), (5, 8, 8, 10)]
    with pytest.raises(ValueError):
        backtest.rolling_origin_splits(5, 3, 1, 4)


def test_prefix_validation_equals_array_validation(panel):
    df = panel({"a": [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9, 3], "b": range(16)})
    for model, params in (("mean", {}), ("drift", {}), ("moving-average", {"window": 3}), ("seasonal-naive", {"season_length": 4})):
        a = backtest.cross_validation(df, model, 2, 2, 5, params).orderBy("unique_id", "cutoff", "step").collect()
        b = backtest.prefix_cross_validation(df, model, 2, 2, 5, season_length=4).orderBy("unique_id", "cutoff", "step").collect()
        assert [(r["unique_id"], r["ds"], r["y"]) for r in a] == [(r["unique_id"], r["ds"], r["y"]) for r in b]
        assert [r["yhat"] for r in a] == pytest.approx([r["yhat"] for r in b])


def test_supervised_and_windows(panel):
    df = panel({"s": [1, 2, 3, 4, 5, 6]}, promo=[10, 11, 12, 13, 14, 15])
    rows = windows.supervised_frame(df, lags=3, x_cols=("promo",)).orderBy("target_t").collect()
    assert [(r["feat_y_lag_3"], r["feat_y_lag_1"], r["feat_promo"], r["y_target"]) for r in rows] == [(1, 3, 13, 4), (2, 4, 14, 5), (3, 5, 15, 6)]
    ahead = windows.supervised_predict_frame(df.select("unique_id", "ds", "y"), dt.datetime(2020, 1, 6), lags=3).collect()
    assert [(r["feat_y_lag_3"], r["feat_y_lag_1"]) for r in ahead] == [(4, 6)]
    assert windows.supervised_arrays(windows.supervised_frame(df, lags=3)).first()["x"] == [1, 2, 3]
    panel_rows = windows.panel_window_frame(df, 2, lags=2, x_cols=("promo",), future_x_lags=(0,)).where("origin = 2").orderBy("step").collect()
    assert [(r["y_lag_2"], r["y_lag_1"], r["futr_promo_lag_0"], r["y_target"]) for r in panel_rows] == [(1, 2, 12, 3), (1, 2, 13, 4)]
    bundle = windows.xreg_eval_bundle(df, 2, 1, 3, ("promo",)).orderBy("train_end").collect()
    assert [(r["train_y"], r["test_x"]) for r in bundle][0] == ([1, 2, 3], [[13], [14]])


def test_transforms(panel):
    df = panel({"s": [1, 3, 6]})
    assert values(transforms.difference(df)) == [2, 3]
    t = transforms.Transform("diff1")
    t.fit_transform([1, 3, 6])
    assert list(t.inverse([4, 5])) == [10, 15]
    assert values(transforms.impute(prepare.regular_grid(panel({"s": [1, None, 5]}), "D").join(panel({"s": [1, None, 5]}), ["unique_id", "ds"], "left"), "mean")) == [1, 3, 5]


def test_summary_ranks(spark):
    rows = [("m1", "d1", "point", 1.0, 10), ("m2", "d1", "point", 2.0, 10), ("m1", "d2", "point", 4.0, 30), ("m2", "d2", "point", 4.0, 30)]
    out = {r["model"]: r for r in leaderboard.summarize(spark.createDataFrame(rows, "model string, dataset string, task_group string, mae double, n_points long"), ("mae",)).collect()}
    assert out["m1"]["mae_rank_mean"] == 1 and out["m2"]["mae_rank_mean"] == 1.5
    assert out["m2"]["mae_rel_mean"] == 1.5 and out["m1"]["mae_wmean"] == pytest.approx(3.25)


def test_tuning_picks_the_best(panel):
    out = leaderboard.tune(panel({"s": [1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2]}), "seasonal-naive", 2, 1, 6, {"season_length": [1, 2, 3]})
    assert out.first()["params"] == '{"season_length": 2}' and out.first()["score"] == 0


def test_sweep_resumes(panel):
    df = panel({"s": range(20)})
    first = leaderboard.sweep({"d": df}, ["mean"], 1, 1, 10)
    again = leaderboard.sweep({"d": df}, ["mean", "drift"], 1, 1, 10, done=first)
    assert sorted(r["model"] for r in again.collect()) == ["drift", "mean"]


@pytest.mark.parametrize("per_step", [True, False])
def test_conformal_radii_of_many_errors(spark, monkeypatch, per_step):
    """With far more errors than the accuracy of the brackets, radii are still those of the sorted errors."""
    import numpy as np

    monkeypatch.setattr(intervals, "ACCURACY", 100)
    rng = np.random.default_rng(1)
    rows = [(int(k), float(x), 0.0) for k in (1, 2) for x in np.round(rng.normal(size=3000), 2 if k == 1 else 9)] + [(3, 1.5, 0.0), (3, None, 0.0), (3, 0.5, 0.0)]
    found = intervals.fit_conformal(spark.createDataFrame(rows, "step int, y double, yhat double"), (0.5, 0.8, 0.99), per_step).collect()
    for r in found:
        own = [abs(y) for k, y, _ in rows if y is not None and (not per_step or k == r["step"])]
        assert [r["radius_50"], r["radius_80"], r["radius_99"]] == [intervals.higher_quantile(own, lv) for lv in (0.5, 0.8, 0.99)]
    assert len(found) == (3 if per_step else 1)


def test_cutoffs_of_kernel_and_column_models_agree(panel):
    """A model in the JVM and its twin in numpy see the same training sets; refused ones have no rows."""
    df = panel({"a": [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8], "b": [2, 7, 1, 8, 2, 8]})
    run = lambda m, **p: [tuple(r)[:6] for r in backtest.cross_validation(df, m, 2, 1, 3, p, max_train_size=4).orderBy("unique_id", "cutoff", "step").collect()]
    line, degree_two = run("poly-trend", degree=1), run("poly-trend", degree=2)
    assert len(line) == 2 * (8 + 2) == len(degree_two) + 2 * 2  # three values are too few for a parabola's check
    assert backtest.cross_validation(df, "ar-ols", 2, 1, 3, {"p": 5}, max_train_size=4).count() == 0
    for uid, ds, cutoff, step, y, yhat in line:
        values = [r["y"] for r in df.where(F.col("unique_id") == uid).orderBy("ds").collect()]
        end = (cutoff - dt.datetime(2020, 1, 1)).days + 1
        assert y == values[end + step - 1] and ds == cutoff + dt.timedelta(days=step)
        import numpy as np

        train = values[max(0, end - 4) : end]
        assert yhat == pytest.approx(np.polyval(np.polyfit(range(len(train)), train, 1), len(train) + step - 1))


@pytest.mark.parametrize("policy", ["ffill", "interpolate"])
@pytest.mark.parametrize("chunk", [3, 7, 1000])
def test_filling_one_axis_in_chunks(spark, panel, policy, chunk):
    rng = __import__("random").Random(chunk)
    values = [None if rng.random() < 0.5 else float(i * i % 17) for i in range(60)]
    other = [None] * 25 + [1.0] + [None] * 34
    df = panel({"": [1.0] * 60}).withColumn("_k", F.row_number().over(__import__("pyspark").sql.Window.partitionBy("unique_id").orderBy("ds")))
    pairs = spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(zip(values, other, strict=True))], "_k int, a double, b double")
    df = df.join(pairs, "_k").drop("_k", "y")
    found = prepare.fill_axis(df, ["a", "b"], policy, chunk).orderBy("ds").collect()
    assert found == prepare.fill_missing(df, ["a", "b"], policy).orderBy("ds").select(found[0].__fields__).collect()


def test_sorted_frames(spark, panel):
    df = panel({"a": [1.0, 2, 3], "b": [1.0, 2]})
    assert frames.is_sorted(df.orderBy("unique_id", "ds")) and frames.is_sorted(df.limit(0))
    assert not frames.is_sorted(df.orderBy("unique_id", F.desc("ds"))) and not frames.is_sorted(df.orderBy(F.desc("unique_id"), "ds"))

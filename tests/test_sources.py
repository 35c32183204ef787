"""Sources, sinks, adapters, artifacts, the command line and streaming."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewise import api, cli
from tidewise.frames import CovariateSpec
from tidewise.operators import detection
from tidewise.sources import adapters, datasets, sinks
from tidewise.streaming import detect as streaming


def test_datasets(spark, tmp_path):
    (tmp_path / "catfish.csv").write_text("Date,Total\n1986-1-01,1034\n1986-2-01,\nbad,3\n")
    assert datasets.load_long(spark, "catfish", str(tmp_path)).collect()[0]["ds"] == dt.datetime(1986, 1, 1)
    assert datasets.load_dataset(spark, "catfish", 1, str(tmp_path)).count() == 1
    with pytest.raises(FileNotFoundError):
        datasets.load_dataset(spark, "store_sales", data_dir=str(tmp_path))
    with pytest.raises(KeyError):
        datasets.get_dataset_spec("none")


def test_work_on_named_datasets(spark, tmp_path, monkeypatch):
    monkeypatch.delenv(datasets.ENV, raising=False)
    (tmp_path / "catfish.csv").write_text("Date,Total\n" + "".join(f"2000-{m}-01,{100 if m == 9 else m}\n" for m in range(1, 13)))
    assert datasets.available_datasets(spark, str(tmp_path)) == ["catfish"]
    assert datasets.preview_dataset_path(spark, "catfish", str(tmp_path)) == (f"{tmp_path}/catfish.csv", "data_dir", True)
    assert datasets.preview_dataset_path(spark, "store_sales", str(tmp_path)) == (f"{tmp_path}/store_sales.csv", "data_dir", False)
    with pytest.raises(KeyError):
        datasets.preview_dataset_path(spark, "none")
    whole = api.evaluate_dataset(spark, "catfish", horizon=1, min_train_size=10, data_dir=str(tmp_path)).where("step is null").first()
    assert (whole["dataset"], whole["model"], whole["n_points"], whole["mae"]) == ("catfish", "naive-last", 2, 1.0)
    odd = api.detect_dataset(spark, "catfish", str(tmp_path), window=6).where("is_anomaly").collect()
    assert [r["ds"].month for r in odd] == [9]


def test_artifacts_round_trip(spark, panel, tmp_path):
    df = panel({"s": [1, 2, 3, 4]})
    sinks.save_forecaster(df, str(tmp_path / "a"), "drift")
    sinks.save_forecaster(df, str(tmp_path / "b"), "ses", {"alpha": 0.5})
    assert [r["yhat"] for r in sinks.load_forecaster(spark, str(tmp_path / "a")).predict(2).orderBy("step").collect()] == [5.0, 6.0]
    assert set(sinks.diff_artifacts(spark, str(tmp_path / "a"), str(tmp_path / "b"))) == {"model", "params"}


def test_render(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "x int, y string")
    assert sinks.render(df).splitlines()[2] == "| 1 | a\\|b |"
    assert sinks.render(df, "csv").splitlines() == ["x,y", "1,a|b", "2,"]


def test_bundles_round_trip(panel):
    df = panel({"a": [1, 2, 3], "b": [4, 5, 6]}, promo=[7, 8, 9])
    roles = CovariateSpec(future=("promo",))
    back = adapters.from_bundle(adapters.to_bundle(df, roles), "D", roles)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError, match="frequency"):
        adapters.to_bundle(panel({"x": [1, 2, None, 4]}))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "x.csv").write_text("day,v\n" + "".join(f"2020-01-{i:02d},{i}\n" for i in range(1, 21)))
    common = [str(tmp_path / "x.csv"), "--time-col", "day", "--y-col", "v"]
    assert cli.main(["forecast", *common, "--model", "drift", "--horizon", "2"], spark) == 0
    assert "2020-01-22" in capsys.readouterr().out
    cli.main(["eval", *common, "--model", "mean", "--min-train-size", "10", "--format", "md"], spark)
    assert "n_points" in capsys.readouterr().out
    cli.main(["models", "--search", "theta"], spark)
    assert "theta-auto" in capsys.readouterr().out


def test_more_commands(spark, tmp_path, capsys):
    (tmp_path / "catfish.csv").write_text("Date,Total\n" + "".join(f"20{y:02d}-{m}-1,{10 * y + m}\n" for y in (1, 2, 3) for m in range(1, 13)))
    common = [str(tmp_path / "catfish.csv"), "--time-col", "Date", "--y-col", "Total"]

    def said(*words):
        assert cli.main([*words], spark) == 0
        return capsys.readouterr().out.strip()

    assert "library torch,missing" in said("doctor") and "season_length" in said("model-info", "seasonal-naive")
    assert "cal_month_sin" in said("calendar-features", *common) and "feat_y_lag_2" in said("make-supervised", *common, "--lags", "2")
    assert said("splits", *common, "--horizon", "3", "--step", "10").splitlines()[1:] == ["series=0,0,12,12,15", "series=0,0,22,22,25", "series=0,0,32,32,35"]
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    said("save-forecaster", *common, "--model", "drift", "--artifact", one)
    said("save-forecaster", *common, "--model", "mean", "--artifact", two)
    assert "drift" in said("artifact-info", one) and "valid" in said("artifact-validate", one)
    assert said("artifact-diff", one, two).splitlines()[1].startswith("model,") and "2004-02-01" in said("artifact-forecast", one, "--horizon", "2")
    where = ["--data-dir", str(tmp_path)]
    assert len(said("dataset-preview", "catfish", *where, "--rows", "3").splitlines()) == 4
    assert "catfish.csv" in said("dataset-path", "catfish", *where) and "36" in said("dataset-validate", "catfish", *where)
    rows = str(tmp_path / "board.csv")
    cli.main(["leaderboard-sweep", "--datasets", "catfish", *where, "--models", "mean,naive-last", "--output", rows], spark)
    assert said("leaderboard-summarize", rows, "--metrics", "mae,rmse").count("\n") == 2


def test_objects(spark, panel):
    df = panel({"s": [1, 2, 3, 4]})
    assert api.Ensemble(("naive-last", "mean")).fit(df).predict(1).first()["yhat"] == 3.25
    assert api.PipelineForecaster("naive-last", ("diff1",)).fit(df).predict(1).first()["yhat"] == 5
    with pytest.raises(RuntimeError):
        api.Forecaster("mean").predict(1)


def test_stream_equals_batch(spark, panel, tmp_path):
    df = panel({"s": [10, 11, 10, 9, 10, 50, 10, 11], "t": [1, 2, 1, 2, 1, 2, 1, 9]}).withColumn("ds", F.col("ds").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.rolling_zscore_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), window=4)
    query = stream.writeStream.format("memory").queryName("scored").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    found = {(r["unique_id"], r["ds"]): r["score"] for r in spark.table("scored").collect()}
    for r in detection.rolling_scores(df, window=4).collect():
        assert found[r["unique_id"], r["ds"]] == pytest.approx(r["score"])


def test_windowed_totals_batch(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    out = streaming.windowed_totals(events, "event_type")
    assert out.agg(F.round(F.sum("y"), 3)).first()[0] == events.agg(F.round(F.sum("value"), 3)).first()[0]


def test_kept_datasets(spark, tmp_path):
    (tmp_path / "catfish.csv").write_text("Date,Total\n1986-1-01,1034\n")
    one = datasets.kept_long(spark, "catfish", str(tmp_path))
    assert one is datasets.kept_long(spark, "catfish", str(tmp_path)) and one.is_cached and one.count() == 1
    assert datasets.kept_dataset(spark, "catfish", str(tmp_path)) is not one
    assert datasets.release("catfish") == 2 and datasets.release() == 0 and not one.is_cached


def test_models_by_what_they_can(spark):
    from tidewise.models import registry

    assert [r["key"] for r in registry.filter_models(spark, supports_x_cols=True, interface="local").collect()] == ["xreg"]
    assert {r["tier"] for r in registry.filter_models(spark, "ridge", where="tier <> 'panel'").collect()} == {"kernel"}
    with pytest.raises(KeyError):
        registry.filter_models(spark, colour="red")


def test_series_for_memory_are_bounded(panel, monkeypatch):
    monkeypatch.setattr(adapters, "MOST_VALUES", 2)
    with pytest.raises(ValueError):
        adapters.to_series(panel({"a": [1.0, 2, 3]}), ["a"])

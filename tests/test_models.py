"""Models per zone on small frames: shape, determinism, baseline, saving and loading."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from __spark_entry__ import queries
from gridcast.operators.evaluation import regression_metrics
from gridcast.operators.forecasting import linear as LIN, logistic as LG, methods as M, regional as RG, trees as TR
from gridcast.operators.forecasting.compare import classify_peak_day, common_zones, fit_peak_day
from gridcast.plans import model_queries
from gridcast.sources.registry import load_models, read_registry, save_models, versions


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    n = 600
    pdf = pd.DataFrame({"region": np.where(np.arange(n) % 3 == 0, "a", "b"), "x": rng.normal(50, 10, n), "y": rng.normal(0, 1, n)})
    pdf["w"] = (pdf.x > 50).astype(float)
    pdf["v"] = 1 - pdf["w"]  # collinear with w
    pdf["load"] = 1e4 + 30 * pdf.x - 200 * pdf.y * (pdf.region == "a") + 500 * pdf.w + rng.normal(0, 5, n)
    pdf["is_peak_day"] = (pdf.x + rng.normal(0, 3, n) > 58).astype(int)
    return spark.createDataFrame(pdf).repartition(7), pdf


def test_least_squares_against_numpy(spark, frame):
    df, pdf = frame
    feats = ["x", "y", "w", "v"]
    model = LIN.fit_ols(df, feats)
    got = LIN.predict_ols(df, model, feats).toPandas()
    for region, g in got.groupby("region"):
        z = np.column_stack([np.ones(len(g)), g[feats].to_numpy()])
        want = z @ np.linalg.lstsq(z, g.load.to_numpy(), rcond=None)[0]
        assert np.allclose(g.predicted_load, want, rtol=0, atol=1e-5)
        assert np.abs(z.T @ (g.load - g.predicted_load).to_numpy()).max() < 1e-2
    assert {r.region: r.n_train for r in model.collect()} == pdf.region.value_counts().to_dict()


def test_rows_with_nulls_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", None, 9.0), ("a", 3.0, None)],
                               "region string, x double, load double")
    row = LIN.fit_ols(df, ["x"]).collect()[0]
    assert row.n_train == 2 and abs(row.coef[0] - 2) < 1e-9 and abs(row.intercept) < 1e-9


def test_trees_beat_the_zone_mean(spark, frame):
    df, _ = frame
    m = M.smaller(M.LOAD_METHODS, 5, 4)["random_forest"]
    fitted = RG.fit_regional(df, m, ["x", "y", "w"], "load", "t")
    scored = RG.score_regional(df, fitted, "predicted_load")
    assert scored.count() == 600 and sorted(r.region for r in fitted.zones().collect()) == ["a", "b"]
    assert all(r.r2 > 0.8 for r in regression_metrics(scored, ["region"]).collect())
    again = RG.score_regional(df, RG.fit_regional(df.repartition(3, "x"), m, ["x", "y", "w"], "load", "t"), "predicted_load")
    # The seed is fixed and the order of the rows does not count.
    a, b = (x.orderBy("x").toPandas() for x in (scored, again))
    pd.testing.assert_frame_equal(a, b)


def test_classifier_save_and_load(spark, frame, tmp_path):
    df, _ = frame
    feats = ["x", "y"]
    fitted = fit_peak_day(df, df, M.PEAK_DAY_METHODS["logistic"].with_(trees=50), feats)
    before = classify_peak_day(df, fitted).orderBy("x").toPandas()
    assert before.p.between(0, 1).all() and len(before) == 600
    assert (before.peak_day_pred == before.is_peak_day).mean() > 0.8
    save_models(fitted, str(tmp_path), spark)
    reg = read_registry(spark, str(tmp_path), "peak_day").collect()
    assert sorted(r.region for r in reg) == ["a", "b"] and all(0.1 <= r.threshold < 1 for r in reg)
    after = classify_peak_day(df, load_models(spark, str(tmp_path), "peak_day")).orderBy("x").toPandas()
    pd.testing.assert_frame_equal(before, after)


def test_defaults_are_the_documented_ones():
    assert (M.LOAD_METHODS["random_forest"].trees, M.LOAD_METHODS["random_forest"].depth) == (100, 20)
    assert (M.PEAK_DAY_METHODS["boosted_trees"].trees, M.PEAK_DAY_METHODS["boosted_trees"].step) == (200, 0.05)


def test_zone_without_a_complete_row_is_reported(spark, frame):
    df, _ = frame
    gone = df.withColumn("load", F.when(F.col("region") != "a", F.col("load")))
    m = M.smaller(M.LOAD_METHODS, 2, 2)["random_forest"]
    fitted = RG.fit_regional(gone, m, ["x"], "load", "t")
    assert [r.region for r in fitted.zones().collect()] == ["b"]
    assert [tuple(r) for r in RG.skipped_table([fitted], spark).collect()] == [("t", "random_forest", "a", RG.NO_ROWS)]


def test_failed_fit_is_an_error_unless_told_otherwise(spark, frame):
    df, _ = frame
    m = M.smaller(M.LOAD_METHODS, 2, 2)["random_forest"].with_(min_leaf=-1)
    with pytest.raises(RuntimeError, match="zone a"):
        RG.fit_regional(df, m, ["x"], "load", "t")
    left_out = RG.fit_regional(df, m, ["x"], "load", "t", on_error="skip").skipped.collect()
    assert sorted(r.region for r in left_out) == ["a", "b"] and all("leaf" in r.reason for r in left_out)


def test_means_compare_zones_that_all_methods_have(spark):
    rows = [("a", "m1", 5.0), ("a", "m2", 4.0), ("b", "m2", 90.0)]
    res = spark.createDataFrame(rows, "region string, method string, rmse double")
    assert {r["region"] for r in common_zones(res).collect()} == {"a"}


def test_registered_queries_use_the_full_methods():
    assert (model_queries.LOAD, model_queries.HOUR, model_queries.DAY) == (M.LOAD_METHODS, M.PEAK_HOUR_METHODS, M.PEAK_DAY_METHODS)


# Trees against a plain search.


def plain_tree(x, y, w, depth, min_leaf):
    """Value of every row by trying each cut of each feature, all rows in the sample."""
    mean = np.average(y, weights=w)
    best = (np.sum(w) * mean**2 + 1e-6, None)
    if depth:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                left = x[:, f] <= cut
                if min(left.sum(), (~left).sum()) >= min_leaf:
                    gain = sum(np.sum((w * y)[s]) ** 2 / np.sum(w[s]) for s in (left, ~left))
                    if gain > best[0] + 1e-6:
                        best = (gain, left)
    out = np.full(len(y), mean)
    if best[1] is not None:
        for s in (best[1], ~best[1]):
            out[s] = plain_tree(x[s], y[s], w[s], depth - 1, min_leaf)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_grown_trees_against_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(90, 4)), 1 if seed % 2 else 3)
    y = np.where(x[:, 0] > 0, 3.0, 0.0) + x[:, 1] + rng.normal(0, 0.3, 90)
    w = rng.choice([1.0, 4.0], 90)
    tree, leaf = TR.grow(TR.binned(x), np.ones(90), w, w * y, depth=4, min_leaf=1 + seed)
    assert np.allclose(tree[3][leaf], plain_tree(x, y, w, 4, 1 + seed))
    assert np.allclose(TR.walk(x, *tree), tree[3][leaf])


def test_more_values_than_bins():
    x = np.arange(1000.0)[:, None]
    data = TR.binned(x, 10)
    assert len(data.cuts[0]) == 9 and np.bincount(data.cells[0]).min() >= 99
    assert np.array_equal(data.cells[0], (x > data.cuts[0]).sum(axis=1))


def test_large_zones_get_distributed_ensembles(spark, frame):
    """Zone b has 400 rows and goes to Spark's own trees, zone a stays in the table; both come back together."""
    df, pdf = frame
    m = M.smaller(M.LOAD_METHODS, 5, 4)["random_forest"]
    fitted = RG.fit_regional(df, m, ["x", "y", "w"], "load", "t", local_rows=300)
    assert list(fitted.models) == ["b"] and {r.region for r in fitted.table.select("region").collect()} == {"a"}
    scored = RG.score_regional(df, fitted, "predicted_load")
    assert scored.count() == 600
    assert all(r.r2 > 0.8 for r in regression_metrics(scored, ["region"]).collect())


def test_many_zones_take_one_chain_of_jobs(spark):
    rows = spark.range(24_000).select(
        F.concat(F.lit("z"), F.col("id") % 1200).alias("region"), (F.col("id") % 7).cast("double").alias("x"),
        (F.col("id") % 7 > 3).cast("int").alias("is_peak_day"),
    )
    for m in (M.PEAK_DAY_METHODS["boosted_trees"].with_(trees=2, depth=2), M.PEAK_DAY_METHODS["logistic"]):
        fitted = RG.fit_regional(rows, m, ["x"], "is_peak_day", "t")
        assert fitted.zones().count() == 1200
        scored = RG.score_regional(rows, fitted, "p")
        sides = scored.groupBy("region").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("is_peak_day") == 1, F.col("p"))).alias("hi"),
            F.max(F.when(F.col("is_peak_day") == 0, F.col("p"))).alias("lo"),
        )
        assert sides.agg(F.sum("n")).first()[0] == 24_000 and sides.where("hi <= lo or hi is null or lo is null").isEmpty()


def test_scores_do_not_depend_on_the_cut_into_parts(spark, frame, monkeypatch):
    df, _ = frame
    for name in ("random_forest", "boosted_trees"):
        m = M.smaller(M.PEAK_DAY_METHODS, 4, 3)[name].with_(min_leaf=1, step=0.5)
        fitted = RG.fit_regional(df, m, ["x", "y"], "is_peak_day", "t")
        whole = RG.score_regional(df, fitted, "p").orderBy("x").toPandas()
        monkeypatch.setattr(TR, "SCORE_ROWS", 50)
        parts = RG.score_regional(df, fitted, "p").orderBy("x").toPandas()
        monkeypatch.undo()
        pd.testing.assert_frame_equal(whole, parts)
        assert whole.p.between(0, 1).all() and whole.p[whole.is_peak_day == 1].mean() > whole.p[whole.is_peak_day == 0].mean() + 0.2


def test_logistic_against_spark_per_zone(spark, frame):
    df, _ = frame
    rows = df.withColumn("c", F.when(F.col("is_peak_day") == 1, 4.0).otherwise(1.0)).withColumn("x", (F.col("x") - 50) / 10)
    model = {r.region: r for r in LG.fit_logistic(rows, ["x", "y"], "is_peak_day", "c").collect()}
    for zone in "ab":
        part = rows.where(F.col("region") == zone)
        total = part.agg(F.sum("c")).first()[0]
        spark_fit = LogisticRegression(
            maxIter=500, tol=1e-12, standardization=False, regParam=1.0 / total, featuresCol="f", labelCol="is_peak_day", weightCol="c"
        ).fit(VectorAssembler(inputCols=["x", "y"], outputCol="f").transform(part))
        assert np.allclose([model[zone].intercept, *model[zone].coef], [spark_fit.intercept, *spark_fit.coefficients], atol=1e-6)
        assert model[zone].slope < 1e-6


def test_logistic_of_one_class(spark):
    rows = spark.createDataFrame([("a", float(i), 0) for i in range(9)], "region string, x double, y int")
    scored = LG.predict_logistic(rows, LG.fit_logistic(rows, ["x"], "y"), ["x"], "p")
    assert scored.where("p > 0.01 or p is null").isEmpty()


# Versions.


def test_a_reader_between_two_saves_gets_one_whole_version(spark, frame, tmp_path):
    df, _ = frame
    path, m = str(tmp_path), M.smaller(M.PEAK_DAY_METHODS, 2, 2)["random_forest"]
    first = fit_peak_day(df, df, m, ["x"])
    save_models(first, path, spark)
    reader = load_models(spark, path, "peak_day")
    before = classify_peak_day(df, reader).orderBy("x").toPandas()
    second = fit_peak_day(df, df, M.PEAK_DAY_METHODS["logistic"], ["x", "y"])
    save_models(second, path, spark)
    # What was loaded before stays whole, what is loaded now is whole and new.
    pd.testing.assert_frame_equal(before, classify_peak_day(df, reader).orderBy("x").toPandas())
    now = load_models(spark, path, "peak_day")
    assert now.method.kind == "logistic" and now.features == ["x", "y"] and now.stats is not None
    seqs = [r.seq for r in versions(spark, path, "peak_day").collect()]
    assert seqs == [2, 1]
    old = versions(spark, path, "peak_day").collect()[1]["version"]
    pd.testing.assert_frame_equal(before, classify_peak_day(df, load_models(spark, path, "peak_day", old)).orderBy("x").toPandas())


def test_an_unfinished_save_is_not_seen(spark, frame, tmp_path):
    df, _ = frame
    fitted = fit_peak_day(df, df, M.smaller(M.PEAK_DAY_METHODS, 2, 2)["random_forest"], ["x"])
    fitted.info.write.parquet(f"{tmp_path}/peak_day/versions/00000001-x/info")
    with pytest.raises(ValueError, match="no models of peak_day"):
        load_models(spark, str(tmp_path), "peak_day")


def test_large_models_are_saved_and_loaded(spark, frame, tmp_path):
    df, _ = frame
    m = M.smaller(M.PEAK_DAY_METHODS, 2, 2)["random_forest"]
    fitted = RG.fit_regional(df, m, ["x"], "is_peak_day", "peak_day", local_rows=300)
    save_models(fitted, str(tmp_path), spark)
    loaded = load_models(spark, str(tmp_path), "peak_day")
    a, b = (RG.score_regional(df, f, "p").orderBy("x").toPandas() for f in (fitted, loaded))
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("name", list(M.LOAD_METHODS))
def test_a_sound_model_of_noise_is_reported_as_sound(spark, monkeypatch, name):
    # Load has nothing to do with the features: on test rows no method beats their own mean reliably.
    rng, n = np.random.default_rng(5), 900
    pdf = pd.DataFrame({c: rng.integers(0, 5, n).astype(float) for c in model_queries.HOURLY_FEATURES})
    pdf["region"], pdf["load"] = np.where(np.arange(n) % 2 == 0, "a", "b"), rng.normal(1e5, 1e3, n)
    df = spark.createDataFrame(pdf).withColumn("day_of_week", F.col("day_of_week").cast("int"))
    parts = {"train": df.limit(700).localCheckpoint(), "test": df.exceptAll(df.limit(700)).localCheckpoint()}
    monkeypatch.setattr(model_queries, "_splits", lambda spark, sf: parts)
    monkeypatch.setattr(model_queries, "LOAD", M.smaller(M.LOAD_METHODS, 20, 8))
    key = {"linear": "ols_interactions", "random_forest": "rf_regressor", "boosted_trees": "gbt_regressor"}[name]
    rows = queries()[key](spark, "").collect()
    assert len(rows) == 2 and all(r.consistent and r.better_than_mean and r.method == name for r in rows)
    assert {r.region: r.n_test for r in rows} == {r.region: r["count"] for r in parts["test"].groupBy("region").count().collect()}


def _random_rows(spark, features, n, seed, zones="ab", **more):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({c: rng.integers(0, 5, n).astype(float) for c in features})
    pdf["region"] = [zones[i % len(zones)] for i in range(n)]
    pdf["date"] = (np.datetime64("2000-01-01") + np.arange(n) // (24 * len(zones))).astype("datetime64[D]").astype(object)
    return spark.createDataFrame(pdf.assign(**{k: f(rng, pdf) for k, f in more.items()}))


def test_models_of_all_tasks_are_saved(spark, monkeypatch, tmp_path):
    """Trials of every task and method, and the best method's models of the longer range, which has a zone more."""
    load, peak = lambda rng, p: 1e4 + 9 * p.temperature + rng.normal(0, 1, len(p)), lambda rng, p: (np.arange(len(p)) // 2 % 5 == 0).astype(int)
    hours = [_random_rows(spark, model_queries.HOURLY_FEATURES, n, n, z, load=load, is_peak_hour=peak) for n, z in ((480, "ab"), (96, "ab"), (600, "abc"))]
    hours = [h.withColumn("day_of_week", F.col("day_of_week").cast("int")).withColumn("hour", F.col("hour").cast("int")) for h in hours]
    days = [_random_rows(spark, model_queries.DAILY_FEATURES, n, n, z, is_peak_day=peak) for n, z in ((200, "ab"), (60, "ab"), (60, "ab"), (300, "abc"))]
    monkeypatch.setattr(model_queries.V, "model_frame", lambda spark, sf: spark.range(1))
    monkeypatch.setattr(model_queries, "_splits", lambda spark, sf, frame=None: dict(zip(("train", "test", "final_train"), hours, strict=True)))
    monkeypatch.setattr(model_queries, "_day_splits", lambda spark, sf, frame=None: dict(zip(("train", "tune", "test", "final_train"), days, strict=True)))
    monkeypatch.setattr(model_queries, "scratch_dir", lambda spark, purpose: str(tmp_path / purpose / uuid.uuid4().hex))
    methods = {"hourly_load": M.LOAD_METHODS, "peak_hour": {k: m for k, m in M.PEAK_HOUR_METHODS.items() if k != "historical"}, "peak_day": M.PEAK_DAY_METHODS}
    for name in ("LOAD", "HOUR", "DAY"):
        monkeypatch.setattr(model_queries, name, M.smaller(getattr(model_queries, name), 2, 2))

    rows = queries()["save_models"](spark, "").collect()
    want = [(t, z, m) for t, known in methods.items() for m in known for z in "ab"] + [(t, z, "best") for t in methods for z in "abc"]
    assert sorted((r.task, r.region, r.method) for r in rows) == sorted(want) and all(r.as_fitted for r in rows)
    weights = {(r.task, r.method): r.scale_pos_weight for r in rows if r.region == "a" and r.method != "best"}
    n, pos = 240, 48  # hours of zone a, a fifth of them peaks
    assert weights["peak_hour", "random_forest"] == n / (2 * pos) and weights["peak_hour", "boosted_trees"] == (n - pos) / pos
    assert weights["peak_day", "boosted_trees"] == 4 * 4 and weights["peak_day", "random_forest"] == weights["peak_day", "logistic"] == 4
    assert all(weights[t, "linear"] is None for t in ("hourly_load", "peak_hour"))

    path = str(next((tmp_path / "models").iterdir()))
    for task, known in methods.items():
        trial = load_models(spark, f"{path}/trials/linear" if task != "peak_day" else f"{path}/trials/logistic", task)
        best = load_models(spark, path, task)
        assert best.method.name in known and sorted(r.region for r in best.zones().collect()) == ["a", "b", "c"]
        assert sorted(r.region for r in trial.zones().collect()) == ["a", "b"]
    # Load is linear here, so least squares is best; it has seen the longer range.
    assert {r.region: r.n_train for r in load_models(spark, path, "hourly_load").table.collect()} == {"a": 200, "b": 200, "c": 200}
    limits = [{r.region: r.threshold for r in read_registry(spark, p, "peak_day").collect()} for p in (path, f"{path}/trials/{best.method.name}")]
    # The best method keeps the thresholds of its trial; a zone without a trial has the default.
    assert limits[0] == {**limits[1], "c": 0.5}


def test_a_trial_whose_models_do_not_come_back_is_seen(spark, frame, monkeypatch, tmp_path):
    df, _ = frame
    fitted = fit_peak_day(df, df, M.PEAK_DAY_METHODS["logistic"], ["x"])
    assert all(r.as_fitted for r in model_queries._saved(spark, f"{tmp_path}/whole", fitted).collect())

    def without_b(spark, path, task):
        back = load_models(spark, path, task)
        back.table = back.table.where("region <> 'b'")
        return back

    monkeypatch.setattr(model_queries, "load_models", without_b)
    assert {r.region: r.as_fitted for r in model_queries._saved(spark, f"{tmp_path}/part", fitted).collect()} == {"a": True, "b": False}


def test_daily_features_start_from_the_written_join(spark):
    # Conditions on the date must meet hours, of which there are few, not the rows of the facts.
    daily = model_queries._daily(spark, "/root/testdata/sf0.001")
    assert daily.inputFiles() and not any("lineitem" in f for f in daily.inputFiles())

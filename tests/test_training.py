import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pluvian.models import residual as M
from pluvian.models.boosting import BoostSettings
from pluvian.operators import columns as C
from pluvian.operators import split as P
from pluvian.operators.guards import LeakageError
from pluvian.plans import training as T


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 1200
    raw = rng.exponential(3, n)
    lead = rng.integers(1, 25, n)
    wet = (rng.random(n) < 0.6).astype(float)
    obs = wet * (raw + 0.1 * lead)
    t = pd.Timestamp("2022-01-01") + pd.to_timedelta(rng.integers(0, 3 * 365 * 24, n), unit="h")
    pdf = pd.DataFrame({"id": range(n), "valid_time": t, "run_time": t, "lead_time_hours": lead, "nwp_rain_raw": raw, "elevation_m": wet * 100,
                        "observed_rain": obs, "lat": 13.0, "lon": 100.0, "grid_id": "G_1_1", "origin": "ecmwf"})
    df = spark.createDataFrame(pdf)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_time", "run_time")}).cache()


@pytest.mark.parametrize("model", ["gbt_l1", "gbt_l2", "hurdle", "quantile", "quantile_forest"])
def test_models_beat_the_raw_forecast(table, model):
    rows = T.training_rows(table, "ecmwf_ifs")
    fast = M.TreeSettings(rounds=8, depth=3, step=0.3, bins=32)
    if model in ("gbt_l1", "quantile"):
        fast = BoostSettings(rounds=8, leaves=8, step=0.3, bins=32)
    _, preds = T.train_and_score(rows, "m1", model, ["id"], settings=fast)
    preds = preds.cache()
    assert preds.count() == table.where("year(valid_time) = 2024").count()
    rep = T.validation_report(preds).first()
    assert rep["corrected_rmse"] < rep["raw_rmse"]
    assert preds.where("corrected_rain < 0").count() == 0
    assert preds.columns[:14] == ["valid_time", "run_time", "lead_time", "weather_model", "station_id", "lat", "lon", "basin_id", "observed_rain",
                                  "nwp_raw_rain", "predicted_bias", "corrected_rain", "model_name", "ablation"]
    if model.startswith("quantile"):
        assert preds.where("q10 > q50 or q50 > q90 or q90 > q95").count() == 0


def test_hurdle_with_no_wet_rows(spark):
    df = spark.createDataFrame([(float(i), 0.0, 1.0, i < 8, i >= 8) for i in range(10)], "x double, observed_rain double, nwp_rain_raw double, is_train boolean, is_val boolean")
    _, out = M.hurdle(df, ["x"], settings=M.TreeSettings(rounds=1, depth=1))
    assert {r["predicted_bias"] for r in out.collect()} == {-1.0}


def test_chronological_split_with_one_crowded_time(spark):
    rows = [(i, "2022-01-01 00:00:00") for i in range(10)] + [(i, "2022-01-02 00:00:00") for i in range(10, 100)]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    out = P.chronological_split(df, "t", ["id"])
    assert {r["id"] for r in out.where("is_train").collect()} == set(range(70))


def test_year_split_and_fallback(table, spark):
    marked = P.train_validation_split(table, ["id"])
    assert marked.where("is_val").select(F.year("valid_time")).distinct().count() == 1
    only = table.where("year(valid_time) = 2024")
    back = P.train_validation_split(only, ["id"])
    n = only.count()
    assert back.where("is_train").count() == int(n * 0.7) and back.where("is_train and is_val").count() == 0
    with pytest.raises(LeakageError):
        P.train_validation_split(table.withColumn("valid_time", F.expr("valid_time + interval 1 year")), ["id"])


def test_standardise_constant_and_missing(spark):
    df = spark.createDataFrame([(1.0, 5.0, True), (3.0, 5.0, True), (None, 5.0, False)], "a double, b double, is_train boolean")
    rows = P.standardise(df, ["a", "b"]).collect()
    assert [r["a"] for r in rows] == [-1.0, 1.0, -2.0] and {r["b"] for r in rows} == {0.0}


def test_row_budget_keeps_whole_cycles(table):
    cycles = table.withColumn("run_time", F.expr("timestamp_ntz'2022-01-01 00:00:00' + make_dt_interval(0, cast(id % 12 as int))"))
    marked = cycles.withColumn("is_train", F.col("id") % 2 == 0)
    kept = P.train_row_budget(marked, 300)
    assert kept.where("is_train").select("run_time").distinct().count() == 3 and kept.where("is_train").count() == 300
    assert kept.where("not is_train").count() == marked.where("not is_train").count()


def test_ablation_columns(table):
    assert len(C.K.ABLATIONS["m1"]) == 43 and len(C.K.ABLATIONS["m2"]) == 22 and len(C.K.ABLATIONS["m3"]) == 51
    assert C.ablation_features(table, "m2") == ["nwp_rain_raw", "lead_time_hours", "elevation_m"]
    assert C.of_weather_model(table, "jma").count() == 0
    std = C.standard_columns(table.drop("lat").withColumnRenamed("lon", "target_lon"))
    assert {"lat", "lon", "target_lat", "lead_time", "station_id", "basin_id", "target_bias"} <= set(std.columns)


def test_text_keys_split_in_text_order(spark):
    df = spark.createDataFrame([("2022-01-01 00:00:00", k) for k in "jihgfedcba"], "t string, k string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = P.chronological_split(df, "t", ["k"])
    assert {r["k"] for r in got.where("is_train").collect()} == set("abcdefg")


def test_early_stop_waits_for_small_gains(spark):
    """A learnable step: the default tolerance must not stop after one tree."""
    rows = spark.range(2000).select((F.col("id") % 20).cast("double").alias("x"), (F.floor(F.col("id") / 20) % 5 == 0).alias("is_val"))
    rows = rows.withColumns({"target_bias": F.sin("x") * 5, "is_train": ~F.col("is_val")})
    fitted, scored = M.boosted_residual(rows, ["x"], settings=M.TreeSettings(rounds=30, depth=3))
    assert len(fitted.trees) > 10
    assert scored.agg(F.avg(F.pow(F.col("predicted_bias") - F.col("target_bias"), F.lit(2.0)))).first()[0] < 8


def test_saved_models_score_alike(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 3 == 0).alias("is_val"))
    rows = rows.withColumns({"target_bias": F.col("x") * 4 - 1, "is_train": ~F.col("is_val")})
    fitted, scored = M.boosted_residual(rows, ["x"], settings=M.TreeSettings(rounds=1, depth=1, step=1.0))
    # one stump on a binary feature predicts the mean of each side
    assert {(r["x"], round(r["predicted_bias"], 9)) for r in scored.collect()} == {(0.0, -1.0), (1.0, 3.0)}
    folder = M.place(str(tmp_path), "gfs", "gbt_l2", "m1")
    M.save(fitted, folder)
    M.save(fitted, folder)
    (back,) = M.load(spark, folder)
    assert back.toDebugString.split("\n", 1)[1] == fitted.toDebugString.split("\n", 1)[1]


def test_saved_boosters_score_alike(spark, table, tmp_path):
    rows = T.training_rows(table, "ecmwf_ifs")
    small = BoostSettings(rounds=3, leaves=4, step=0.5)
    fitted, preds = T.train_and_score(rows, "m1", "quantile", ["id"], settings=small, save_to=str(tmp_path))
    back = M.load(spark, M.place(str(tmp_path), "ecmwf_ifs", "quantile", "m1"))
    assert [b.to_json() for b in back] == [b.to_json() for b in fitted] and len(back) == 4


def test_cells_stand_for_their_rows(spark):
    """Trees from the cells are those from all rows, and copies of the rows add no cells."""
    rows = spark.range(3000).select("id", (F.col("id") % 12).cast("double").alias("a"), (F.floor(F.col("id") / 12) % 5).cast("double").alias("b"),
                                    F.lit(2.0).alias("flat"), (F.floor(F.col("id") / 60) % 4 == 0).alias("is_val"))
    rows = rows.withColumns({"target_bias": F.sin("a") * 5 + F.col("b") * F.col("a") / 9 + F.pmod(F.xxhash64("id"), F.lit(7)), "is_train": ~F.col("is_val")}).cache()
    names, settings = ["a", "b", "flat"], M.TreeSettings(rounds=12, depth=3, bins=16, partitions=2)
    _, got = M.boosted_residual(rows, names, settings=settings)
    plain = M.GBTRegressor(featuresCol="_x", labelCol="target_bias", predictionCol="want", maxIter=12, maxDepth=3, stepSize=0.05, maxBins=16, seed=42,
                           validationIndicatorCol="is_val", validationTol=1e-6)
    every = M.VectorAssembler(inputCols=names, outputCol="_x").transform(rows)
    both = got.join(plain.fit(every).transform(every.where("is_val")).select("id", "want"), "id")
    assert both.count() == rows.where("is_val").count() and both.agg(F.max(F.abs(F.col("predicted_bias") - F.col("want")))).first()[0] < 1e-9
    many = rows.crossJoin(spark.range(5).select(F.col("id").alias("copy")))
    sizes = [M.cells(x, names, "target_bias", settings, ["is_train", "is_val"])[0] for x in (rows, many)]
    assert [x.count() for x in sizes] == [240, 240] and [x.agg(F.sum("_w")).first()[0] for x in sizes] == [3000, 15000]


def test_cells_part_raw_values_as_their_trees_do(spark):
    """Many distinct values: every threshold of a tree lies between the bins, so a row is scored as it was learned."""
    rows = spark.range(4000).select((F.pmod(F.xxhash64("id"), F.lit(100003)) / 7).alias("x"), F.lit(True).alias("is_train"), F.lit(False).alias("is_val"))
    rows = rows.withColumn("target_bias", F.sqrt("x")).cache()
    fitted, _ = M.boosted_residual(rows, ["x"], settings=M.TreeSettings(rounds=1, depth=2, bins=8), early_stop_tol=None)
    scored = fitted.transform(M.VectorAssembler(inputCols=["x"], outputCol="_x").transform(rows)).groupBy("predicted_bias").agg(F.avg("target_bias").alias("mean"))
    assert all(abs(r["predicted_bias"] - r["mean"]) < 1e-9 for r in scored.collect()) and scored.count() == 4


@pytest.mark.parametrize("tolerance", [1e-6, None])
def test_absolute_loss_without_passes_over_all_rows(spark, monkeypatch, tolerance):
    """The trees of Spark ML under absolute loss, but not from its learner, which goes over all rows for every level of every tree."""
    rng = np.random.default_rng(4)
    n = 6000
    pdf = pd.DataFrame({"id": range(n), "a": rng.integers(0, 12, n).astype(float), "b": rng.integers(0, 5, n) * 2.5, "flat": 2.0, "is_val": rng.random(n) < 0.25})
    pdf["target_bias"], pdf["is_train"] = np.sin(pdf.a) * 5 + pdf.a * pdf.b / 9 + rng.normal(0, 1 + pdf.b, n), ~pdf.is_val
    rows, names = spark.createDataFrame(pdf).cache(), ["a", "b", "flat"]
    stop = {} if tolerance is None else {"validationIndicatorCol": "is_val", "validationTol": tolerance}
    plain = M.GBTRegressor(featuresCol="_x", labelCol="target_bias", predictionCol="want", lossType="absolute", maxIter=8, maxDepth=3, stepSize=0.4, maxBins=16, seed=42, **stop)
    every = M.VectorAssembler(inputCols=names, outputCol="_x").transform(rows)
    model = plain.fit(every if stop else every.where("is_train"))
    monkeypatch.setattr(M.GBTRegressor, "fit", lambda *_: pytest.fail("all rows were given to Spark ML"))
    fitted, got = M.boosted_residual(rows, names, "absolute", settings=M.TreeSettings(rounds=8, depth=3, step=0.4, bins=16, partitions=3), early_stop_tol=tolerance)
    both = got.join(model.transform(every.where("is_val")).select("id", "want"), "id")
    assert both.count() == pdf.is_val.sum() and both.agg(F.max(F.abs(F.col("predicted_bias") - F.col("want")))).first()[0] < 1e-9
    assert fitted.treeWeights == model.treeWeights and len(fitted.trees) > 3
    assert np.allclose(fitted.featureImportances.toArray(), model.featureImportances.toArray())


def test_absolute_loss_saved_and_missing_targets(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 3 == 0).alias("is_val"))
    rows = rows.withColumns({"target_bias": F.col("x") * 4 - 1, "is_train": ~F.col("is_val")})
    fitted, scored = M.boosted_residual(rows, ["x"], "absolute", settings=M.TreeSettings(rounds=1, depth=1))
    assert {(r["x"], r["predicted_bias"]) for r in scored.collect()} == {(0.0, -1.0), (1.0, 3.0)}
    M.save(fitted, str(tmp_path / "m"))
    (back,) = M.load(spark, str(tmp_path / "m"))
    assert back.toDebugString.split("\n", 1)[1] == fitted.toDebugString.split("\n", 1)[1]
    gaps = rows.withColumn("target_bias", F.when(F.col("x") > 0, F.col("target_bias")))
    with pytest.raises(Exception, match="a row has no target"):
        M.boosted_residual(gaps, ["x"], "absolute", settings=M.TreeSettings(rounds=1, depth=1))

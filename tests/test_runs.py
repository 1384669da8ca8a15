import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pluvian.functions import scalars as S
from pluvian.operators import deaccum as D
from pluvian.operators import guards as G
from pluvian.operators import temporal as T


def ts(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def test_six_hour_bucket(spark):
    acc = [1, 2, 3, 3, 5, 6, 2, 5]
    df = spark.createDataFrame([("g", 1, "c", i + 1, float(v)) for i, v in enumerate(acc)],
                               "origin string, run_time int, grid_id string, lead_time_hours int, tp double")
    got = [r["tp"] for r in D.deaccumulate_buckets(df).orderBy("lead_time_hours").collect()]
    assert got == [1, 1, 1, 0, 2, 1, 2, 3]


def test_bucket_gap_keeps_total(spark):
    df = spark.createDataFrame([("g", 1, "c", 2, 2.0), ("g", 1, "c", 4, 5.0), ("g", 1, "c", 9, 4.0)],
                               "origin string, run_time int, grid_id string, lead_time_hours int, tp double")
    assert [r["tp"] for r in D.deaccumulate_buckets(df).orderBy("lead_time_hours").collect()] == [2, 3, 4]


def test_deaccumulate_undoes_a_running_sum_and_leaves_intervals(spark):
    rng = np.random.default_rng(4)
    rows = []
    for run in (1, 2):
        for cell in range(20):
            step = rng.exponential(2, 24).round(2) * (rng.random(24) < 0.4)
            tp = step.cumsum() if run == 1 else step
            rows += [("g", run, cell, lead + 1, float(v), float(s)) for lead, (v, s) in enumerate(zip(tp, step))]
    df = spark.createDataFrame(rows, "origin string, run_time int, grid_id int, lead_time_hours int, tp double, want double")
    bad = D.deaccumulate(df).where(F.abs(F.col("tp") - F.col("want")) > 1e-9).count()
    assert bad == 0


@pytest.mark.parametrize("values", [[0.001, 0.002], [0.04, 0.06, 0.0], [0.049, 0.0509], [0.01] * 19 + [0.6], [0.01] * 19 + [0.9] * 2,
                                    [5.0, 7.0], [0.0, 0.0], [0.02, 1.99], [0.02, 2.5]])
def test_metre_test_is_the_quantile_test(spark, values):
    s = pd.Series(values)
    pos = s[s > 0]
    want = bool(len(pos) and pos.median() < 0.05 and s.max() < 2.0 and pos.quantile(0.95) < 0.5)
    df = spark.createDataFrame([("g", 1, v) for v in values], "origin string, run_time int, tp double")
    assert D.unit_flags(df).first()["tp_in_m"] is want


def test_normalise_runs_and_declared_unit(spark):
    df = ts(spark.createDataFrame([("g", "2024-01-01", "2024-01-01 03:00", 13.75, 100.5, 3.0, 101000.0, 300.0, "m")],
                                  "origin string, run_time string, valid_time string, lat double, lon double, tp double, sp double, t2m double, tp_units string"),
            "run_time", "valid_time")
    row = D.normalise_runs(df).first()
    assert row["lead_time_hours"] == 3 and row["tp"] == 300.0 and row["sp"] == 1010.0
    assert row["t2m"] == pytest.approx(26.85) and row["cape"] == 0.0 and row["grid_id"] == "G_688_5025"


def test_valid_before_run_fails(spark):
    df = ts(spark.createDataFrame([("2024-01-02", "2024-01-01")], "r string, v string"), "r", "v")
    with pytest.raises(Exception, match="earlier than run_time"):
        df.select(S.lead_hours("r", "v").alias("x")).collect()


def test_leakage_guard(spark):
    def rows(*times):
        return ts(spark.createDataFrame([("2025-06-01 00:00", t) for t in times], "run_time string, observed_at string"),
                  "run_time", "observed_at")
    G.assert_no_leakage(rows("2025-06-01 00:00", "2025-05-31 23:50"))
    for late in ("2025-06-01 00:10", "2025-06-01 06:00"):
        with pytest.raises(G.LeakageError):
            G.assert_no_leakage(rows("2025-05-31 23:50", late))
    window = rows("2025-05-30 00:00", "2025-05-31 12:00", "2025-06-01 00:00", "2025-06-01 01:00")
    assert G.lookback_filter(window).count() == 2
    with pytest.raises(Exception, match="after run_time"):
        window.select(G.no_leakage("run_time", "observed_at").alias("t")).collect()
    with pytest.raises(G.LeakageError):
        G.assert_not_frozen(window, "run_time")
    assert G.before_frozen(window, "run_time").count() == 0


def test_held_out_network(spark, tmp_path):
    path = str(tmp_path / "blind_net" / "x")
    spark.range(3).write.parquet(path)
    with pytest.raises(G.LeakageError):
        G.assert_not_held_out(spark.read.parquet(path), ["blind_net"])
    with pytest.raises(G.LeakageError):
        G.assert_not_held_out(spark.createDataFrame([("BLIND",)], "network string"), ["blind"])


def test_asof_keeps_a_null_last_value_unless_told(spark):
    runs = ts(spark.createDataFrame([("2024-01-01 12:00",)], "run_time string"), "run_time")
    obs = ts(spark.createDataFrame([("s", "rain", "2024-01-01 09:00", 1.0), ("s", "rain", "2024-01-01 11:00", None),
                                    ("s", "rain", "2024-01-01 08:59", 9.0), ("s", "rain", "2024-01-01 12:01", 7.0)],
                                   "station_code string, variable_type string, observed_at string, value double"), "observed_at")
    assert T.asof_lookback(runs, obs).first()["value"] is None
    assert T.asof_lookback(runs, obs, ignore_nulls=True).first()["value"] == 1.0


def test_interval_label_window_and_sum(spark):
    obs = ts(spark.createDataFrame([("s", f"2024-01-01 {h}", v) for h, v in
                                    (("05:00", 1.0), ("06:00", 2.0), ("11:00", 4.0), ("12:15", 8.0), ("12:16", 16.0))],
                                   "station_code string, observed_at string, value double"), "observed_at")
    asks = ts(spark.createDataFrame([("s", "2024-01-01 12:00", 1), ("s", "2024-01-01 12:00", 6)],
                                    "station_code string, valid_time string, step_hours int"), "valid_time")
    got = {r["step_hours"]: r["observed_rain"] for r in T.interval_labels(asks, obs).collect()}
    assert got == {1: 8.0, 6: 12.0}  # the first bound is open, the second reaches 15 minutes past


def test_step_hours(spark):
    df = spark.createDataFrame([("a", 1, 6), ("a", 1, 12), ("a", 1, 6), ("b", 1, 3), ("c", 1, None)], "origin string, run_time int, lead_time_hours int")
    assert {r["origin"]: r["step_hours"] for r in T.step_hours(df).collect()} == {"a": 6, "b": 3}


def test_rolling_cycles_brute_force(spark):
    hours = pd.date_range("2024-01-01 05:00", "2024-01-03 20:00", freq="h").delete([7, 30])
    pdf = pd.DataFrame({"time": hours, "precipitation": np.arange(len(hours)) * 0.1 - 0.5, "rain": 1.0})
    df = spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz")).select(
        F.lit("gfs").alias("origin"), F.lit(13.75).alias("lat"), F.lit(100.5).alias("lon"), "time", "precipitation", "rain")
    got = {(r["run_time"], r["lead_time_hours"]): r["tp"] for r in T.rolling_cycles(df, ("00:00", "12:00"), 30).collect()}
    want = {}
    for day in pd.date_range("2024-01-01", "2024-01-03", freq="D"):
        for c in (0, 12):
            for lead in range(1, 31):
                hit = pdf[pdf.time == day + pd.Timedelta(hours=c + lead)]
                if len(hit):
                    want[((day + pd.Timedelta(hours=c)).to_pydatetime(), lead)] = max(0.0, round(hit.precipitation.iloc[0], 3))
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)


def test_satellite_evolution_needs_all_lags(spark):
    rows = [("c", f"2024-01-01 00:{m:02d}", 250.0 - m, 205.0) for m in (0, 10, 20, 30, 40)] + [("d", "2024-01-01 00:30", 1.0, 1.0)]
    band = ts(spark.createDataFrame(rows, "grid_id string, timestamp string, bt_mean double, bt_min double"), "timestamp")
    wv = band.where("minute(timestamp) = 30").select("grid_id", "timestamp", F.lit(240.0).alias("wv_mean"))
    out = {r["timestamp"].minute: r for r in T.satellite_evolution(band, wv).collect()}
    assert set(out) == {30, 40}
    assert out[30]["delta_bt_30"] == -30.0 and out[30]["is_rapid_cooling"] and out[30]["is_deep_convective"]
    assert out[30]["wv_mean"] == 240.0 and out[40]["wv_mean"] is None


def test_snap_and_identity(spark):
    df = ts(spark.createDataFrame([("2021-06-01 12:06:30",), ("2024-06-01 12:04:59",)], "t string"), "t")
    rows = df.select(S.snap_10min("t").alias("f"), S.snap_10min("t", "nearest").alias("n"), S.satellite_name("t").alias("s")).collect()
    assert [r["f"].minute for r in rows] == [0, 0] and [r["n"].minute for r in rows] == [10, 0]
    assert [r["s"] for r in rows] == ["H08", "H09"]


def test_unknown_model_raises_only_when_strict(spark):
    df = spark.createDataFrame([(" ECMF ",), ("brandnew",)], "m string")
    assert [r[0] for r in df.select(S.model_name("m")).collect()] == ["ecmwf_ifs", "brandnew"]
    with pytest.raises(Exception, match="unsupported weather model"):
        df.select(S.model_name("m", "acquisition")).collect()

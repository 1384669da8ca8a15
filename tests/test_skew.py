import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pluvian.functions import skew


def test_rows_below_matches_a_sort(spark):
    rng = np.random.default_rng(0)
    values = pd.DataFrame({"g": rng.integers(0, 3, 5000), "v": rng.normal(0, 100, 5000)})
    hist = spark.createDataFrame(values).groupBy("g", "v").agg(F.count("*").alias("n"))
    # a tiny divisor makes many cut points, so the bucket path is exercised
    got = skew.rows_below(hist, ["g"], "v", "n").toPandas()
    for g, part in values.groupby("g"):
        want = {v: int((part.v < v).sum()) for v in part.v.unique()}
        mine = got[got.g == g].set_index("v").n_below.to_dict()
        assert mine == want


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_exact_quantiles(spark, groups):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 999), "v": rng.exponential(3, 999).round(1)})
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = skew.exact_quantiles(spark.createDataFrame(pdf), groups, "v", probs).toPandas()
    for g, part in (pdf.groupby("g") if groups else [(None, pdf)]):
        mine = got if g is None else got[got.g == g]
        for p in probs:
            assert mine[mine.prob == p].value.iloc[0] == pytest.approx(part.v.quantile(p))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_is_the_plain_join(spark, how):
    keys = [1] * 700 + list(range(2, 302)) + [None]
    b = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    o = spark.createDataFrame([(k, j) for j, k in enumerate([1, 1, 2, 3, 999])], "k int, j int")
    salted = skew.salted_join(b, o, ["k"], how, hot_rows=50)
    plain = b.join(o, "k", how)
    assert sorted(map(str, salted.select("k", "i", "j").collect())) == sorted(map(str, plain.select("k", "i", "j").collect()))


def test_first_row_is_deterministic(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 5, "x"), (1, 1, "b")], "k int, o int, t string")
    out = {(r["k"], r["t"]) for r in skew.first_row(df, ["k"], [F.col("o"), F.col("t")]).collect()}
    assert out == {(1, "a"), (2, "x")}


def test_spearman_of_mostly_dry_rows(spark, monkeypatch):
    """95 % of the observations are zero, so one value holds most pairs of each key; it is salted and nothing is lost."""
    from pluvian.operators import verify
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"model": rng.choice(["a", "b"], 1500), "obs": np.where(rng.random(1500) < 0.95, 0.0, rng.integers(1, 30, 1500)),
                        "pred": rng.integers(0, 300, 1500) / 7.0, "raw": 1.0})
    got = {r["model"]: r["spearman_rho"] for r in verify.spearman(spark.createDataFrame(pdf), ["model"]).collect()}
    for m, g in pdf.groupby("model"):
        assert got[m] == pytest.approx(g["obs"].rank().corr(g["pred"].rank()), abs=1e-9)


def test_nearest_site_with_all_targets_in_one_degree(spark):
    from pluvian.operators.spatial import nearest_site
    rng = np.random.default_rng(8)
    t = pd.DataFrame({"id": range(300), "lon": 100 + rng.random(300), "lat": 13 + rng.random(300)})
    s = pd.DataFrame({"site": range(80), "lon": np.r_[100 + rng.random(70), rng.uniform(-170, 170, 10)], "lat": np.r_[13 + rng.random(70), rng.uniform(-60, 60, 10)]})
    got = {r["id"]: (r["site"], r["dist"]) for r in nearest_site(spark.createDataFrame(t), spark.createDataFrame(s), "id", "site", hot_rows=5).collect()}
    d = np.hypot(t["lon"].values[:, None] - s["lon"].values, t["lat"].values[:, None] - s["lat"].values)
    assert {i: v[0] for i, v in got.items()} == {i: int(d[i].argmin()) for i in range(300)}


def test_labels_where_most_cells_have_no_gauge(spark, monkeypatch):
    from pluvian.plans.features import attach_labels
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    run = pd.Timestamp("2024-01-01 00:00")
    rows = pd.DataFrame({"origin": "gfs", "run_time": run, "lead_time_hours": [i % 3 + 1 for i in range(600)], "grid_id": [f"g{i // 3}" for i in range(600)]})
    rows["valid_time"] = rows.run_time + pd.to_timedelta(rows.lead_time_hours, unit="h")
    seen = pd.DataFrame({"station_code": "s1", "variable_type": "hourly_rain", "value": [1.0, 2.0, 5.0, 3.0],
                         "observed_at": [run + pd.Timedelta(hours=7 + h) for h in (1, 2, 2, 3)]})
    def ntz(df, *cols):
        out = spark.createDataFrame(df)
        return out.withColumns({c: out[c].cast("timestamp_ntz") for c in cols})
    gauges = spark.createDataFrame([("g0", "s1"), ("g7", "s2")], "grid_id string, station_code string")
    out = attach_labels(ntz(rows, "run_time", "valid_time"), ntz(seen, "observed_at"), gauges).toPandas()
    assert len(out) == 600 and out.observed_rain.notna().sum() == 3
    assert sorted(out[out.grid_id == "g0"].observed_rain) == [1.0, 3.0, 5.0]  # two reports at one time: the larger

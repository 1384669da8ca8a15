import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pluvian.operators import verify as V
from pluvian.plans import verification as plan

OBS = [0, 0, 1.2, 5, 12, 25, 0, .5]
RAW = [0, 1.5, 0, 3, 8, 15, .2, 1]
PRED = [0, .1, 1, 4.8, 11.5, 23, 0, .4]


def frame(spark, obs=OBS, raw=RAW, pred=PRED, **extra):
    rows = pd.DataFrame({"obs": obs, "raw": raw, "pred": pred, **extra}).astype({"obs": float, "raw": float, "pred": float})
    return spark.createDataFrame(rows)


def scores(df, keys=()):
    cells = V.score_cells(df, list(keys))
    cols = [c.alias(n) for n, c in V.continuous_columns().items()]
    return cells.select(*keys, "n", "n_pair", *cols, *[c.alias(n) for n, c in V.contingency_columns(2.0).items()])


def test_metrics_vectors(spark):
    o, r, p = map(np.array, (OBS, RAW, PRED))
    got = scores(frame(spark)).first()
    rmse, mae = math.sqrt(((p - o) ** 2).mean()), np.abs(p - o).mean()
    raw_rmse = math.sqrt(((r - o) ** 2).mean())
    assert got["n"] == 8
    assert got["rmse"] == pytest.approx(rmse)
    assert got["mae"] == pytest.approx(mae)
    assert got["ratio"] == pytest.approx(rmse / mae)
    assert got["mbe"] == pytest.approx((p - o).mean())
    assert got["ss_rmse"] == pytest.approx((1 - rmse / raw_rmse) * 100)
    assert got["pearson_r"] == pytest.approx(np.corrcoef(o, p)[0, 1])
    assert (got["hits"], got["misses"], got["false_alarms"], got["correct_negatives"]) == (3, 0, 0, 5)


def test_spearman_uses_average_ranks(spark):
    got = V.spearman(frame(spark).withColumn("k", F.lit(1)), ["k"]).first()["spearman_rho"]
    want = np.corrcoef(pd.Series(OBS).rank(), pd.Series(PRED).rank())[0, 1]
    assert got == pytest.approx(want)


def test_constant_and_empty_groups(spark):
    constant = frame(spark, [12.5] * 4, [1, 2, 3, 4], [12.5] * 4)
    got = scores(constant).first()
    assert got["pearson_r"] == 0.0 and got["ratio"] == 1.0 and got["rmse"] == 0.0
    empty = frame(spark, [None, float("nan")], [1, 2], [1, 2], g=["a", "a"])
    got = scores(empty, ["g"]).first()
    assert got["n"] == 0 and got["rmse"] is None and got["pearson_r"] is None


def test_non_finite_pairs_are_left_out(spark):
    df = frame(spark, [1, 2, float("inf"), 4], [1, float("nan"), 1, 1], [1, 2, 3, float("nan")])
    got = scores(df).first()
    # three-way finite for errors, two-way finite for the table
    assert (got["n"], got["n_pair"]) == (1, 2)


def test_table_adds_up_and_rolls_up(spark):
    rng = np.random.default_rng(1)
    n = 4000
    obs, pred = rng.exponential(4, n).round(1), rng.exponential(4, n).round(1)
    df = frame(spark, obs, rng.exponential(4, n), pred, month=rng.integers(1, 13, n), basin_id=rng.integers(1, 4, n))
    fine = V.score_cells(df, ["month", "basin_id"])
    whole, rolled = V.score_cells(df, ["month"]), V.roll_up(fine, ["month"])
    a = {r["month"]: r.asDict() for r in whole.collect()}
    for r in rolled.collect():
        for k, v in r.asDict().items():
            assert v == pytest.approx(a[r["month"]][k])
    for row in V.threshold_rows(whole, ["month"], ["hits", "misses", "false_alarms", "correct_negatives", "total_cases"]).collect():
        assert row["hits"] + row["misses"] + row["false_alarms"] + row["correct_negatives"] == row["total_cases"]


def test_missing_holdout_gives_null_gap(spark):
    df = frame(spark, model=["x"] * 8, ablation=["m3"] * 8, is_holdout=[False] * 8)
    row = V.generalization_gap(V.score_cells(df, ["model", "ablation", "is_holdout"])).first()
    assert row["innet_rmse"] is not None and row["holdout_rmse"] is None and row["delta_rmse"] is None


def test_all_reports_from_one_pass(spark, tmp_path):
    from pluvian.sources.tables import write_reports
    n = 200
    rng = np.random.default_rng(2)
    base = dict(lead_time=rng.integers(1, 25, n), month=rng.integers(1, 13, n), basin_id=rng.integers(1, 26, n),
                is_holdout=rng.random(n) < 0.3)
    obs, raw = rng.exponential(5, n), rng.exponential(5, n)
    parts = []
    for m, a, p in [("baseline_b0", "raw_nwp", raw), ("lightgbm", "m1", obs + 1), ("lightgbm", "m2", obs + 2),
                    ("lightgbm", "m3", obs + .5), ("hurdle", "m3", obs + .7)]:
        parts.append(pd.DataFrame({**base, "obs": obs, "raw": raw, "pred": p, "model": m, "ablation": a}))
    long = spark.createDataFrame(pd.concat(parts))
    cells = plan.verification_cells(long)
    tables = plan.reports(cells, ["lightgbm", "hurdle"], long=long)
    assert len(tables) == 12
    write_reports(tables, str(tmp_path / "reports"))
    back = spark.read.option("header", True).csv(str(tmp_path / "reports" / "basin_skill_scores"))
    assert {r["best_model"] for r in back.collect()} == {"lightgbm"}
    best = tables["model_ablation_matrix"].where("model = 'lightgbm'").first()
    assert best["best_variant"] == "m3"


def test_alignment_imputes_and_keeps_first(spark):
    base = spark.createDataFrame([("t1", "a", 1, 9.0), ("t1", "b", 1, 8.0)], "valid_time string, station_id string, lead_time int, nwp_raw_rain double")
    preds = spark.createDataFrame([("t1", "a", 1, "x", "m1", 2, 5.0), ("t1", "a", 1, "x", "m1", 1, 4.0)],
                                  "valid_time string, station_id string, lead_time int, model string, ablation string, ord int, corrected_rain double")
    out = {r["station_id"]: (r["pred"], r["imputed"]) for r in
           V.align_variants(base, preds, ["valid_time", "station_id", "lead_time"], ["ord"]).collect()}
    assert out == {"a": (4.0, False), "b": (8.0, True)}

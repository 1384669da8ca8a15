"""Verification queries (scores by lead, month, basin, threshold, tier) and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvian.operators import verify as V
from pluvian.plans.verification import GRAIN
from pluvian.plans.verification import report_cells as report_grains
from workload.common import Registry, r
from workload.views import MODELS, VARIANTS, oracle_view, view

REG = Registry()
KEEP = ["lead_time", "valid_time", "basin_id", "is_holdout"]


def long_rows(spark: SparkSession, sf_dir: str, variants=VARIANTS) -> DataFrame:
    rows = V.variants_long(view(spark, sf_dir, "v_forecast_obs"), variants, KEEP)
    return rows.withColumn("month", F.month("valid_time")).drop("valid_time")


def in_network(spark: SparkSession, sf_dir: str, variants=VARIANTS) -> DataFrame:
    return long_rows(spark, sf_dir, variants).where(~F.col("is_holdout"))


def cells(spark: SparkSession, sf_dir: str, keys: list[str], variants=VARIANTS) -> DataFrame:
    return V.score_cells(in_network(spark, sf_dir, variants), keys)


# ---- oracle fragments: every score is written from its definition ----

def oracle_long(variants=VARIANTS, where: str = "WHERE NOT is_holdout") -> str:
    parts = [f"SELECT lead_time, month(valid_time) AS month, basin_id, is_holdout, observed_rain AS obs, nwp_raw_rain AS raw, "
             f"'{m}' AS model, '{a}' AS ablation, {c} AS pred FROM v_forecast_obs {where}" for m, a, c in variants]
    return f"WITH {oracle_view('v_forecast_obs')}, lng AS ({' UNION ALL '.join(parts)})"


RMSE = "sqrt(avg((pred-obs)*(pred-obs)))"
MAE = "avg(abs(pred-obs))"
RAW_RMSE = "sqrt(avg((raw-obs)*(raw-obs)))"
RAW_MAE = "avg(abs(raw-obs))"
SS_RMSE = f"CASE WHEN {RAW_RMSE} > 1e-9 THEN (1.0 - {RMSE}/{RAW_RMSE})*100.0 ELSE 0.0 END"
SS_MAE = f"CASE WHEN {RAW_MAE} > 1e-9 THEN (1.0 - {MAE}/{RAW_MAE})*100.0 ELSE 0.0 END"
RATIO = f"CASE WHEN {MAE} > 1e-9 THEN {RMSE}/{MAE} ELSE 1.0 END"
PEARSON = ("CASE WHEN stddev_pop(obs) > 1e-9 AND stddev_pop(pred) > 1e-9 "
           "THEN covar_pop(obs, pred)/(stddev_pop(obs)*stddev_pop(pred)) ELSE 0.0 END")


def counts(t: float) -> tuple[str, str, str, str]:
    return (f"count(*) FILTER (obs >= {t} AND pred >= {t})", f"count(*) FILTER (obs >= {t} AND pred < {t})",
            f"count(*) FILTER (obs < {t} AND pred >= {t})", f"count(*) FILTER (obs < {t} AND pred < {t})")


def contingency(t: float) -> dict[str, str]:
    h, m, f, c = counts(t)
    pod = f"CASE WHEN {h}+{m} > 0 THEN 100.0*{h}/({h}+{m}) ELSE 0.0 END"
    far = f"CASE WHEN {h}+{f} > 0 THEN 100.0*{f}/({h}+{f}) ELSE 0.0 END"
    return {
        "hits": h, "misses": m, "false_alarms": f, "correct_negatives": c, "pod": pod, "far": far,
        "miss_rate": f"CASE WHEN {h}+{m} > 0 THEN 100.0 - 100.0*{h}/({h}+{m}) ELSE 0.0 END",
        "csi": f"CASE WHEN {h}+{m}+{f} > 0 THEN 1.0*{h}/({h}+{m}+{f}) ELSE 0.0 END",
        "f1": f"CASE WHEN {h} > 0 THEN 2.0*(1.0*{h}/({h}+{f}))*(1.0*{h}/({h}+{m}))/((1.0*{h}/({h}+{f}))+(1.0*{h}/({h}+{m}))) ELSE 0.0 END",
        "success_ratio": f"1.0 - ({far})/100.0",
        "frequency_bias": f"CASE WHEN {h}+{m} > 0 THEN 1.0*({h}+{f})/({h}+{m}) ELSE 1.0 END",
        "total_cases": "count(*)",
    }


INTEGERS = {"hits", "misses", "false_alarms", "correct_negatives", "total_cases"}


def cont(t: float, names: list[str], suffix: str = "") -> str:
    table = contingency(t)
    return ", ".join(f"{table[n]} AS {n}{suffix}" if n in INTEGERS else r(table[n], n + suffix) for n in names)


# ---- D18 ----
@REG.add("lead_time_scores", f"""{oracle_long()}
SELECT lead_time, model, ablation, count(*) AS n, {r(RMSE, 'rmse')}, {r(MAE, 'mae')}, {r(RATIO, 'ratio')}, {r(SS_RMSE, 'ss_rmse')},
       {r(SS_MAE, 'ss_mae')}, {cont(10.0, ['csi', 'pod'], '_10mm')} FROM lng GROUP BY lead_time, model, ablation""")
def lead_time_scores(spark, sf_dir):
    return V.by_lead(cells(spark, sf_dir, ["lead_time", "model", "ablation"]))


# ---- D19 ----
SEASON = "CASE WHEN month BETWEEN 5 AND 10 THEN 'Wet/Monsoon' WHEN month IN (3, 4) THEN 'Hot' ELSE 'Dry/Cool' END"


@REG.add("monthly_scores", f"""{oracle_long()}
SELECT month, {SEASON} AS season, model, ablation, {r(RMSE, 'rmse')}, {r(MAE, 'mae')}, {r(RATIO, 'ratio')}, {r(SS_RMSE, 'ss_rmse')},
       {r(SS_MAE, 'ss_mae')} FROM lng GROUP BY month, model, ablation""")
def monthly_scores(spark, sf_dir):
    return V.by_month(cells(spark, sf_dir, ["month", "model", "ablation"]))


MONTH_CT = " UNION ALL ".join(
    f"SELECT month, {SEASON} AS season, model, ablation, CAST({t} AS DOUBLE) AS threshold, "
    f"{cont(t, ['pod', 'far', 'miss_rate', 'csi', 'f1'])} FROM lng GROUP BY month, model, ablation"
    for t in (0.1, 2.0, 10.0, 20.0))


@REG.add("monthly_contingency", f"{oracle_long()} {MONTH_CT}")
def monthly_contingency(spark, sf_dir):
    return V.by_month_threshold(cells(spark, sf_dir, ["month", "model", "ablation"]))


# ---- D17 + E8 ----
RANK_CTE = ("rk AS (SELECT model, ablation, obs, pred, "
            "rank() OVER (PARTITION BY model, ablation ORDER BY obs) + (count(*) OVER (PARTITION BY model, ablation, obs) - 1)/2.0 AS ro, "
            "rank() OVER (PARTITION BY model, ablation ORDER BY pred) + (count(*) OVER (PARTITION BY model, ablation, pred) - 1)/2.0 AS rp FROM lng)")
RHO = ("SELECT model, ablation, CASE WHEN stddev_pop(ro) > 1e-9 AND stddev_pop(rp) > 1e-9 "
       "THEN covar_pop(ro, rp)/(stddev_pop(ro)*stddev_pop(rp)) ELSE 0.0 END AS rho FROM rk GROUP BY model, ablation")
BOARD = f"""SELECT model, ablation, {RMSE} AS rmse, {MAE} AS mae, {RATIO} AS ratio, {SS_RMSE} AS ss_rmse, {SS_MAE} AS ss_mae,
 avg(pred-obs) AS mbe, {PEARSON} AS pearson_r, {', '.join(contingency(10.0)[x] + f' AS {x}_10mm' for x in ('pod', 'far', 'miss_rate', 'csi'))},
 {', '.join(contingency(20.0)[x] + f' AS {x}_20mm' for x in ('pod', 'far', 'csi'))} FROM lng GROUP BY model, ablation"""
BOARD_COLS = ["rmse", "mae", "ratio", "ss_rmse", "ss_mae", "mbe", "pearson_r", "pod_10mm", "far_10mm", "miss_rate_10mm",
              "csi_10mm", "pod_20mm", "far_20mm", "csi_20mm"]


@REG.add("leaderboard", f"""{oracle_long()}, {RANK_CTE}, rho AS ({RHO}), board AS ({BOARD})
SELECT b.model, b.ablation, {', '.join(r('b.' + c, c) for c in BOARD_COLS)}, {r('rho.rho', 'spearman_rho')},
       CAST(row_number() OVER (ORDER BY b.ss_rmse DESC, b.model, b.ablation) AS INT) AS skill_rank
FROM board b JOIN rho ON b.model = rho.model AND b.ablation = rho.ablation""")
def leaderboard(spark, sf_dir):
    long = in_network(spark, sf_dir)
    return V.leaderboard(V.score_cells(long, ["model", "ablation"]), long)


# ---- D13, D14 ----
@REG.add("pearson_spearman", f"""{oracle_long()}, rk AS (SELECT month, model, ablation, obs, pred,
 rank() OVER (PARTITION BY month, model, ablation ORDER BY obs) + (count(*) OVER (PARTITION BY month, model, ablation, obs) - 1)/2.0 AS ro,
 rank() OVER (PARTITION BY month, model, ablation ORDER BY pred) + (count(*) OVER (PARTITION BY month, model, ablation, pred) - 1)/2.0 AS rp FROM lng)
SELECT month, model, ablation, {r(PEARSON, 'pearson_r')}, {r('covar_pop(ro, rp)/(stddev_pop(ro)*stddev_pop(rp))', 'spearman_rho')}
FROM rk GROUP BY month, model, ablation""")
def pearson_spearman(spark, sf_dir):
    keys = ["month", "model", "ablation"]
    long = in_network(spark, sf_dir)
    scored = V.score_cells(long, keys, []).select(*keys, V.continuous_columns()["pearson_r"].alias("pearson_r"))
    return scored.join(V.spearman(long, keys), keys)


# ---- D15, D16, D22 ----
ALL_CT = ["hits", "misses", "false_alarms", "correct_negatives", "pod", "far", "miss_rate", "csi", "f1", "success_ratio",
          "frequency_bias", "total_cases"]


@REG.add("contingency_thresholds", f"{oracle_long()} " + " UNION ALL ".join(
    f"SELECT model, ablation, CAST({t} AS DOUBLE) AS threshold, {cont(t, ALL_CT)} FROM lng GROUP BY model, ablation"
    for t in (0.1, 2.0, 10.0, 20.0)))
def contingency_thresholds(spark, sf_dir):
    keys = ["model", "ablation"]
    return V.threshold_rows(cells(spark, sf_dir, keys), keys, ALL_CT)


CT_TABLE = ["hits", "misses", "false_alarms", "correct_negatives", "pod", "far", "miss_rate", "csi", "f1", "frequency_bias"]


@REG.add("rain_intensity_table", f"{oracle_long()} " + " UNION ALL ".join(
    f"SELECT model, ablation, CAST({t} AS DOUBLE) AS threshold, {cont(t, CT_TABLE)} FROM lng GROUP BY model, ablation"
    for t in (0.1, 2.0, 10.0, 20.0)))
def rain_intensity_table(spark, sf_dir):
    return V.intensity_table(cells(spark, sf_dir, ["model", "ablation", "month", "lead_time"]))


# ---- D23 ----
@REG.add("heavy_warning", f"""{oracle_long()} SELECT model, ablation, {cont(10.0, ['pod', 'far', 'miss_rate'], '_10mm')},
 {counts(10.0)[1]} AS missed_count_10mm, {cont(20.0, ['pod', 'far', 'miss_rate'], '_20mm')}, {counts(20.0)[1]} AS missed_count_20mm
FROM lng GROUP BY model, ablation""")
def heavy_warning(spark, sf_dir):
    return V.heavy_rain_table(cells(spark, sf_dir, ["model", "ablation"]))


# ---- D20 ----
def gap_sql(keys: list[str]) -> str:
    k = ", ".join([*keys, "model", "ablation"])
    on = " AND ".join(f"a.{x} IS NOT DISTINCT FROM b.{x}" for x in [*keys, "model", "ablation"])
    side = f"SELECT {k}, {RMSE} AS rmse, {MAE} AS mae, {contingency(10.0)['csi']} AS csi, {contingency(10.0)['pod']} AS pod FROM lng"
    return f"""{oracle_long(where='')}, a AS ({side} WHERE NOT is_holdout GROUP BY {k}), b AS ({side} WHERE is_holdout GROUP BY {k})
SELECT {', '.join('a.' + x for x in [*keys, 'model', 'ablation'])},
 {r('a.rmse', 'innet_rmse')}, {r('a.mae', 'innet_mae')}, {r('a.csi', 'innet_csi_10')}, {r('a.pod', 'innet_pod_10')},
 {r('b.rmse', 'holdout_rmse')}, {r('b.mae', 'holdout_mae')}, {r('b.csi', 'holdout_csi_10')}, {r('b.pod', 'holdout_pod_10')},
 {r('b.rmse - a.rmse', 'delta_rmse')}, {r('b.mae - a.mae', 'delta_mae')} FROM a JOIN b ON {on}"""


@REG.add("generalization_gap", gap_sql([]))
def generalization_gap(spark, sf_dir):
    return V.generalization_gap(V.score_cells(long_rows(spark, sf_dir), ["model", "ablation", "is_holdout"]))


@REG.add("monthly_generalization_gap", gap_sql(["month"]))
def monthly_generalization_gap(spark, sf_dir):
    return V.generalization_gap(V.score_cells(long_rows(spark, sf_dir), ["month", "model", "ablation", "is_holdout"]),
                                ["month"])


# ---- D21 ----
M3 = [v for v in VARIANTS if v[1] == "m3"]


@REG.add("basin_scores", f"""{oracle_long(M3)} SELECT basin_id, model, ablation, {r(RMSE, 'rmse')}, {r(MAE, 'mae')},
 {r(SS_RMSE, 'ss_rmse')}, {r(SS_MAE, 'ss_mae')}, {cont(10.0, ['csi'], '_10mm')} FROM lng GROUP BY basin_id, model, ablation""")
def basin_scores(spark, sf_dir):
    return V.basin_table(cells(spark, sf_dir, ["basin_id", "model", "ablation"]))


@REG.add("basin_best_model", f"""{oracle_long()},
 m AS (SELECT basin_id, model, {RMSE} AS rmse, {SS_RMSE} AS ss FROM lng WHERE ablation = 'm3' GROUP BY basin_id, model),
 o AS (SELECT *, row_number() OVER (PARTITION BY basin_id ORDER BY ss DESC, CASE model WHEN 'lightgbm' THEN 1 ELSE 2 END) AS k FROM m),
 b AS (SELECT basin_id, {RMSE} AS rr, {MAE} AS rm FROM lng WHERE model = 'baseline_b0' GROUP BY basin_id)
SELECT b.basin_id, {r('rr', 'raw_rmse')}, {r('rm', 'raw_mae')}, model AS best_model, {r('rmse', 'best_rmse')}, {r('ss', 'best_ss_rmse')}
FROM b JOIN o ON b.basin_id = o.basin_id AND k = 1""")
def basin_best_model(spark, sf_dir):
    return V.basin_best(cells(spark, sf_dir, ["basin_id", "model", "ablation"]), MODELS, ("baseline_b0", "raw_nwp"))


# ---- D24 ----
ABL_COLS = ", ".join(f"max(CASE WHEN ablation = '{a}' THEN {s} END) AS {a}_{s}" for a in ("m1", "m2", "m3")
                     for s in ("rmse", "mae", "ss_rmse"))


@REG.add("ablation_matrix", f"""{oracle_long()},
 s AS (SELECT model, ablation, {RMSE} AS rmse, {MAE} AS mae, {SS_RMSE} AS ss_rmse FROM lng WHERE ablation IN ('m1','m2','m3') GROUP BY model, ablation),
 w AS (SELECT model, {ABL_COLS}, max(ss_rmse) AS mx FROM s GROUP BY model),
 raw AS (SELECT {RMSE} AS v FROM lng WHERE model = 'baseline_b0')
SELECT w.model, {', '.join(r(f'{a}_{s}', f'{a}_{s}') for a in ('m1', 'm2', 'm3') for s in ('rmse', 'mae', 'ss_rmse'))},
 (SELECT max(ablation) FROM s WHERE s.model = w.model AND s.ss_rmse = w.mx) AS best_variant, {r('mx', 'max_ss_rmse')},
 {r('(SELECT v FROM raw)', 'raw_rmse')}, CAST(0.0 AS DOUBLE) AS raw_ss_rmse FROM w""")
def ablation_matrix(spark, sf_dir):
    return V.ablation_matrix(cells(spark, sf_dir, ["model", "ablation"]), MODELS, ("baseline_b0", "raw_nwp"))


# ---- D25 ----
@REG.add("raw_vs_baseline", f"""{oracle_long()}, s AS (SELECT model, ablation, {RMSE} AS rmse, {MAE} AS mae, {RATIO} AS ratio,
 {SS_RMSE} AS ss_rmse, {contingency(10.0)['pod']} AS pod_10mm, {contingency(10.0)['csi']} AS csi_10mm FROM lng GROUP BY model, ablation)
SELECT s.model, s.ablation, {', '.join(r('s.' + c, c) for c in ('rmse', 'mae', 'ratio', 'ss_rmse', 'pod_10mm', 'csi_10mm'))},
 {r('(b.rmse - s.rmse)/b.rmse*100.0', 'rmse_change_pct')} FROM s, (SELECT rmse FROM s WHERE model = 'baseline_b0') b""")
def raw_vs_baseline(spark, sf_dir):
    return V.against_baseline(cells(spark, sf_dir, ["model", "ablation"]), ("baseline_b0", "raw_nwp"))


# ---- D26 ----
@REG.add("perf_diagram", f"""{oracle_long()}, s AS (SELECT model, ablation, (100.0 - ({contingency(10.0)['far']}))/100.0 AS sr,
 ({contingency(10.0)['pod']})/100.0 AS p FROM lng WHERE ablation IN ('m3', 'raw', 'raw_nwp') GROUP BY model, ablation)
SELECT model, ablation, {r('sr', 'success_ratio')}, {r('p', 'pod')}, {r('1.0/(1.0/sr + 1.0/p - 1.0)', 'csi')} FROM s""")
def perf_diagram(spark, sf_dir):
    return V.performance_points(V.leaderboard(cells(spark, sf_dir, ["model", "ablation"])))


# ---- D27 ----
QQ_P = "[" + ", ".join(repr((1.0 + 98.0 * i / 49) / 100.0) for i in range(50)) + "]"


@REG.add("qq_pairs", f"""WITH {oracle_view('v_forecast_obs')}, q AS (SELECT is_holdout, unnest({QQ_P}) AS prob,
 unnest(quantile_cont(observed_rain, {QQ_P})) AS qo, unnest(quantile_cont(lightgbm_m3_pred, {QQ_P})) AS qp
 FROM v_forecast_obs GROUP BY is_holdout)
SELECT is_holdout, {r('prob', 'prob')}, {r('qo', 'q_obs')}, {r('qp', 'q_pred')} FROM q""")
def qq_pairs(spark, sf_dir):
    return V.qq_pairs(view(spark, sf_dir, "v_forecast_obs"), ["is_holdout"], "observed_rain", "lightgbm_m3_pred")


# ---- D30 ----
@REG.add("split_report", f"""WITH {oracle_view('v_forecast_obs')}, s AS (SELECT year(valid_time) AS year, count(*) AS n,
 sqrt(avg(power(nwp_raw_rain - observed_rain, 2))) AS a, sqrt(avg(power(lightgbm_m3_pred - observed_rain, 2))) AS b
 FROM v_forecast_obs GROUP BY 1) SELECT CAST(year AS INT) AS year, n, {r('a', 'raw_rmse')}, {r('b', 'corrected_rmse')},
 {r('(a-b)/a*100.0', 'skill_pct')} FROM s""")
def split_report(spark, sf_dir):
    rows = view(spark, sf_dir, "v_forecast_obs").withColumn("year", F.year("valid_time"))
    return V.split_report(rows, corrected="lightgbm_m3_pred", keys=["year"])


# ---- D31 ----
@REG.add("chart_skill_bars", f"""{oracle_long()}, s AS (SELECT model, ablation, {SS_RMSE} AS a, {SS_MAE} AS b, {RMSE} AS c FROM lng
 WHERE model <> 'baseline_b0' GROUP BY model, ablation),
 l AS (SELECT CASE WHEN model LIKE 'raw_%' THEN upper(replace(model, 'raw_', '')) || ' (Raw)' ELSE upper(model) || ' (' || upper(ablation) || ')' END AS label, a, b, c FROM s)
SELECT label, {r('a', 'ss_rmse')}, {r('b', 'ss_mae')}, {r('c', 'rmse')}, CAST(row_number() OVER (ORDER BY a, label) AS INT) AS bar FROM l""")
def chart_skill_bars(spark, sf_dir):
    return V.skill_series(V.leaderboard(cells(spark, sf_dir, ["model", "ablation"])))


@REG.add("chart_month_lead", f"""{oracle_long()} SELECT month, lead_time, {r(RMSE, 'rmse')} FROM lng
 WHERE model = 'lightgbm' AND ablation = 'm3' AND lead_time IN (3, 6, 12, 24) GROUP BY month, lead_time""")
def chart_month_lead(spark, sf_dir):
    return V.month_lead_series(cells(spark, sf_dir, ["month", "lead_time", "model", "ablation"]), "lightgbm", "m3")


@REG.add("chart_progression", f"""{oracle_long()}, s AS (SELECT model, ablation, {SS_RMSE} AS v FROM lng WHERE ablation IN ('m1','m2','m3') GROUP BY model, ablation),
 a AS (SELECT model, ablation, v FROM s UNION ALL SELECT DISTINCT model, 'raw', 0.0 FROM s)
SELECT model, CASE ablation WHEN 'raw' THEN 0 WHEN 'm1' THEN 1 WHEN 'm2' THEN 2 ELSE 3 END AS step,
 CASE ablation WHEN 'raw' THEN 'Raw Model' WHEN 'm1' THEN 'M1 (Ground Obs)' WHEN 'm2' THEN 'M2 (Satellite)' ELSE 'M3 (Multi-Modal)' END AS label,
 {r('v', 'ss_rmse')}, {r('greatest(-25.0, least(35.0, v))', 'colour_value')} FROM a""")
def chart_progression(spark, sf_dir):
    return V.progression(V.ablation_matrix(cells(spark, sf_dir, ["model", "ablation"]), MODELS,
                                           ("baseline_b0", "raw_nwp")))


MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"


@REG.add("chart_monthly_gap", f"""{oracle_long(M3, '')}, s AS (SELECT month, model, is_holdout, {RMSE} AS v FROM lng GROUP BY ALL)
SELECT a.month, {MONTHS}[a.month] AS month_label, upper(a.model) AS series, {r('b.v - a.v', 'delta_rmse')} FROM s a JOIN s b
 ON a.month = b.month AND a.model = b.model AND NOT a.is_holdout AND b.is_holdout""")
def chart_monthly_gap(spark, sf_dir):
    cell = V.score_cells(long_rows(spark, sf_dir), ["month", "model", "ablation", "is_holdout"])
    return V.gap_series(V.generalization_gap(cell, ["month"]))


@REG.add("chart_lead", f"""{oracle_long()} SELECT lead_time, upper(model) AS series, {r(RMSE, 'rmse')}, {r(MAE, 'mae')}, {r(RATIO, 'ratio')}
 FROM lng WHERE ablation IN ('m3', 'raw_nwp') GROUP BY lead_time, model""")
def chart_lead(spark, sf_dir):
    return V.lead_series(V.by_lead(cells(spark, sf_dir, ["lead_time", "model", "ablation"])))


# ---- C11 ----
@REG.add("align_models", f"""WITH {oracle_view('v_forecast_obs')},
 preds AS (SELECT valid_time, station_id, lead_time, l_orderkey, l_partkey, l_linenumber, 'lightgbm' AS model, 'm3' AS ablation, lightgbm_m3_pred AS p FROM v_forecast_obs WHERE NOT is_holdout
   UNION ALL SELECT valid_time, station_id, lead_time, l_orderkey, l_partkey, l_linenumber, 'hurdle', 'm3', hurdle_m3_pred FROM v_forecast_obs WHERE is_holdout),
 one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY valid_time, station_id, lead_time, model ORDER BY l_orderkey, l_partkey, l_linenumber) AS k FROM preds) WHERE k = 1),
 full_ AS (SELECT b.*, v.model FROM v_forecast_obs b, (VALUES ('lightgbm'), ('hurdle')) v(model))
SELECT f.l_orderkey, f.l_partkey, f.l_linenumber, f.station_id, f.model, 'm3' AS ablation, one.p IS NULL AS imputed, {r('coalesce(one.p, f.nwp_raw_rain)', 'pred')}
FROM full_ f LEFT JOIN one ON f.valid_time = one.valid_time AND f.station_id = one.station_id AND f.lead_time = one.lead_time AND f.model = one.model""")
def align_models(spark, sf_dir):
    base = view(spark, sf_dir, "v_forecast_obs")
    ids = ["l_orderkey", "l_partkey", "l_linenumber"]
    keys = ["valid_time", "station_id", "lead_time"]

    def part(where, model, column):
        return base.where(where).select(*keys, *ids, F.lit(model).alias("model"), F.lit("m3").alias("ablation"),
                                        F.col(column).alias("corrected_rain"))
    preds = part(~F.col("is_holdout"), "lightgbm", "lightgbm_m3_pred").unionByName(
        part(F.col("is_holdout"), "hurdle", "hurdle_m3_pred"))
    return V.align_variants(base, preds, keys, ids).select(*ids, "station_id", "model", "ablation", "imputed", "pred")


# ---- D17 to D23: every grain of the reports from one aggregation ----
@REG.add("report_cells", f"""{oracle_long(where='')} SELECT CASE WHEN grouping(lead_time) = 0 THEN 'lead' WHEN grouping(month) = 0 THEN 'month' WHEN grouping(basin_id) = 0 THEN 'basin' ELSE 'variant' END AS grain,
 is_holdout, model, ablation, lead_time, month, basin_id, count(*) AS n, {r(RMSE, 'rmse')}, {r(MAE, 'mae')}, {r(SS_RMSE, 'ss_rmse')}, {cont(10.0, ['hits', 'csi'])} FROM lng
 GROUP BY GROUPING SETS ((is_holdout, model, ablation), (is_holdout, lead_time, model, ablation), (is_holdout, month, model, ablation), (is_holdout, basin_id, model, ablation))""")
def report_cells(spark, sf_dir):
    fine = V.score_cells(long_rows(spark, sf_dir), GRAIN)
    return report_grains(fine).select("grain", "is_holdout", "model", "ablation", "lead_time", "month", "basin_id", "n", *V.pick(
        V.continuous_columns(), ["rmse", "mae", "ss_rmse"]), *V.pick(V.contingency_columns(10.0), ["hits", "csi"]))

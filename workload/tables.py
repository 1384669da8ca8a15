"""Table plumbing, scalar functions, splits and model queries with their oracles (models: rows only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvian.functions import scalars as S
from pluvian.models import boosting as B
from pluvian.models import residual as M
from pluvian.operators import columns as C
from pluvian.operators import quality as Q
from pluvian.operators import split as P
from pluvian.session import written
from pluvian.sources import forecasts as FS
from pluvian.sources import inventory as INV
from pluvian.sources import stations as ST
from workload.common import Registry, r
from workload.views import oracle_view, table, view

REG = Registry()

# ---- B1 ----
RAW_NAME = """CASE event_type WHEN 'click' THEN ' ECMF ' WHEN 'view' THEN 'kwbc' WHEN 'error' THEN 'Icon' WHEN 'signup' THEN 'bom' ELSE 'New_Model ' END"""


@REG.add("alias_normalise", f"""WITH n AS (SELECT event_id, lower(trim({RAW_NAME})) AS c FROM events)
SELECT event_id, CASE c WHEN 'ecmf' THEN 'ecmwf_ifs' WHEN 'kwbc' THEN 'ncep_gfs' WHEN 'icon' THEN 'dwd_icon' WHEN 'bom' THEN 'bom_access' ELSE c END AS weather_model FROM n""")
def alias_normalise(spark, sf_dir):
    named = table(spark, sf_dir, "events").select("event_id", F.expr(RAW_NAME).alias("weather_model"))
    return C.canonical_models(named)


# ---- B22, B23, B6, B24, B27 ----
@REG.add("season", "SELECT o_orderkey, CASE WHEN month(o_orderdate) BETWEEN 5 AND 10 THEN 'Wet/Monsoon' WHEN month(o_orderdate) IN (3, 4) THEN 'Hot' ELSE 'Dry/Cool' END AS season FROM orders")
def season(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.season(F.month("o_orderdate")).alias("season"))


TRUNC10 = "to_timestamp(floor(epoch_us(ts) / 600000000) * 600)::TIMESTAMP"


@REG.add("snap_10min", f"""SELECT event_id, {TRUNC10} AS floor_slot, CASE WHEN minute(ts) % 10 < 5 THEN {TRUNC10} ELSE {TRUNC10} + INTERVAL 10 MINUTE END AS nearest_slot,
 ts - INTERVAL 7 HOUR AS utc, ts + INTERVAL 7 HOUR AS local_time, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso,
 CASE WHEN ts - INTERVAL 399 DAY < TIMESTAMP '2022-12-13 05:00:00' THEN 'H08' ELSE 'H09' END AS satellite FROM events""")
def snap_10min(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", S.snap_10min("ts").alias("floor_slot"), S.snap_10min("ts", "nearest").alias("nearest_slot"),
        S.to_utc("ts").alias("utc"), S.to_local("ts").alias("local_time"), S.iso_z("ts").alias("iso"),
        S.satellite_name(S.shift("ts", hours=-399 * 24)).alias("satellite"))


# ---- B7, B25, B26, B28, B9 ----
@REG.add("lead_and_correction", f"""WITH {oracle_view('v_forecast_obs')} SELECT l_orderkey, l_partkey, station_id, l_linenumber, CAST(date_diff('second', run_time, valid_time) // 3600 AS INT) AS lead_hours,
 {r('observed_rain - nwp_raw_rain', 'bias')}, {r('greatest(0.0, nwp_raw_rain + (observed_rain - nwp_raw_rain) * 1.5)', 'corrected')}, observed_rain >= 0.1 AS wet, {r('greatest(5.0, least(20.0, observed_rain))', 'clipped')} FROM v_forecast_obs""")
def lead_and_correction(spark, sf_dir):
    bias = F.col("observed_rain") - F.col("nwp_raw_rain")
    return view(spark, sf_dir, "v_forecast_obs").select(
        "l_orderkey", "l_partkey", "station_id", "l_linenumber", S.lead_hours("run_time", "valid_time").alias("lead_hours"),
        S.target_bias("observed_rain", "nwp_raw_rain", 6).alias("bias"), S.corrected_rain("nwp_raw_rain", bias * 1.5).alias("corrected"),
        S.wet("observed_rain").alias("wet"), S.clip("observed_rain", 5.0, 20.0).alias("clipped"))


# ---- B12, B13, B29, M5 ----
@REG.add("prediction_export", f"""WITH {oracle_view('v_forecast_obs')} SELECT strftime(valid_time, '%Y-%m-%dT%H:%M:%SZ') AS valid_time, strftime(run_time, '%Y-%m-%dT%H:%M:%SZ') AS run_time, lead_time, 'ncep_gfs' AS weather_model,
 CAST(station_id AS VARCHAR) AS station_id, CAST(0.0 AS DOUBLE) AS lat, CAST(0.0 AS DOUBLE) AS lon, CAST(basin_id AS VARCHAR) AS basin_id, round(CAST(CAST(observed_rain AS FLOAT) AS DOUBLE), 4) AS observed_rain,
 round(CAST(CAST(nwp_raw_rain AS FLOAT) AS DOUBLE), 4) AS nwp_raw_rain, round(CAST(CAST(lightgbm_m3_pred - nwp_raw_rain AS FLOAT) AS DOUBLE), 4) + 0.0 AS predicted_bias,
 round(CAST(CAST(greatest(0.0, nwp_raw_rain + lightgbm_m3_pred - nwp_raw_rain) AS FLOAT) AS DOUBLE), 4) + 0.0 AS corrected_rain, 'lightgbm' AS model_name, 'm3' AS ablation FROM v_forecast_obs""")
def prediction_export(spark, sf_dir):
    rows = view(spark, sf_dir, "v_forecast_obs").withColumnRenamed("nwp_raw_rain", "nwp_rain_raw") \
        .withColumn("predicted_bias", F.col("lightgbm_m3_pred") - F.col("nwp_rain_raw"))
    out = C.prediction_frame(rows, "lightgbm", "m3", "ncep_gfs")
    return out.select([(F.round(F.col(n).cast("double"), 4) + 0.0).alias(n) if t == "float" else F.col(n) for n, t in out.dtypes])


# ---- A15, F4 ----
@REG.add("plan_missing", """WITH rq AS (SELECT m AS model, d + c * INTERVAL 1 HOUR AS run_time FROM (VALUES ('click'), ('view'), ('error'), ('forecast')) a(m),
  unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) b(d), (VALUES (0), (12)) t(c)),
 ex AS (SELECT DISTINCT event_type AS model, date_trunc('day', ts) + INTERVAL 12 HOUR * CAST(hour(ts) >= 12 AS INT) AS run_time FROM events)
SELECT rq.model, rq.run_time FROM rq LEFT JOIN ex ON rq.model = ex.model AND rq.run_time = ex.run_time WHERE ex.model IS NULL""")
def plan_missing(spark, sf_dir):
    return INV.plan_missing(requested(spark), existing(spark, sf_dir))


def requested(spark):
    return INV.requested_cycles(spark, ["click", "view", "error", "forecast"], "2024-01-01", "2024-02-05")


def existing(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), S.floor_to("ts", 43200).alias("run_time"))


@REG.add("acquisition_progress", f"""WITH rq AS (SELECT m AS model, d + c * INTERVAL 1 HOUR AS run_time FROM (VALUES ('click'), ('view'), ('error'), ('forecast')) a(m),
  unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) b(d), (VALUES (0), (12)) t(c)),
 ex AS (SELECT DISTINCT event_type AS model, date_trunc('day', ts) + INTERVAL 12 HOUR * CAST(hour(ts) >= 12 AS INT) AS run_time FROM events)
SELECT rq.model, count(*) AS total, count(ex.model) AS skipped, count(*) - count(ex.model) AS todo, {r('round_even(count(ex.model) * 100.0 / count(*), 1)', 'done_pct')}
FROM rq LEFT JOIN ex ON rq.model = ex.model AND rq.run_time = ex.run_time GROUP BY rq.model""")
def acquisition_progress(spark, sf_dir):
    return INV.progress(requested(spark), existing(spark, sf_dir))


@REG.add("yearly_coverage", """WITH d AS (SELECT DISTINCT o_orderdate AS t FROM orders) SELECT CAST(year(t) AS INT) AS year, count(*) AS present,
 CAST(max(CASE WHEN year(t) % 4 = 0 THEN 366 ELSE 365 END) AS INT) AS expected, count(*) >= max(CASE WHEN year(t) % 4 = 0 THEN 366 ELSE 365 END) AS complete FROM d GROUP BY year(t)""")
def yearly_coverage(spark, sf_dir):
    return INV.yearly_coverage(table(spark, sf_dir, "orders"), "o_orderdate", 1)


# ---- A16, A17, F1, F2, F3 ----
# the first source has no run in June, as a source with an outage would
@REG.add("prefer_source", f"""WITH {oracle_view('v_nwp')}, a AS (SELECT origin, run_time, cell_id, lead_time_hours, tp, 0 AS s FROM v_nwp WHERE month(run_time) <> 6),
 b AS (SELECT origin, run_time, cell_id, lead_time_hours, tp * 2.0e0 AS tp, 1 AS s FROM v_nwp), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT origin, run_time, cell_id, lead_time_hours, {r('tp', 'tp')} FROM (SELECT *, dense_rank() OVER (PARTITION BY origin, run_time ORDER BY s) AS k FROM u) WHERE k = 1""")
def prefer_source(spark, sf_dir):
    runs = view(spark, sf_dir, "v_nwp")
    return FS.prefer_source([runs.where(F.month("run_time") != 6), runs.withColumn("tp", F.col("tp") * 2.0)]) \
        .select("origin", "run_time", "cell_id", "lead_time_hours", "tp")


@REG.add("combine_cycles", """SELECT 'a' AS part, event_id, user_id, CAST(NULL AS BIGINT) AS o_orderkey FROM events UNION ALL SELECT 'b', NULL, NULL, o_orderkey FROM orders""")
def combine_cycles(spark, sf_dir):
    return FS.combine_cycles([table(spark, sf_dir, "events").select(F.lit("a").alias("part"), "event_id", "user_id"),
                              table(spark, sf_dir, "orders").select(F.lit("b").alias("part"), "o_orderkey")])


@REG.add("station_codes", """SELECT CAST(s_suppkey AS VARCHAR) AS station_code FROM supplier UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer UNION SELECT CAST(user_id AS VARCHAR) FROM events""")
def station_codes(spark, sf_dir):
    parts = [("supplier", "s_suppkey"), ("customer", "c_custkey"), ("events", "user_id")]
    return ST.all_station_codes([table(spark, sf_dir, t).select(F.col(c).cast("string").alias("station_code")) for t, c in parts])


# ---- A14, C13 ----
STATION_CATALOGS = "SELECT CAST(user_id AS STRING) AS station_code, CASE event_type WHEN 'click' THEN 'hourly_rain' WHEN 'view' THEN 'hourly_rain' WHEN 'error' THEN 'pressure' ELSE 'humidity' END AS catalog FROM events"


def catalogs(spark, sf_dir):
    text = STATION_CATALOGS.replace("FROM events", "FROM {ev}")
    rows = spark.sql(text, ev=table(spark, sf_dir, "events"))
    place = view(spark, sf_dir, "v_station").select("station_code", F.col("latitude").cast("string").alias("latitude"),
                                                    (F.col("longitude") + 5.0).cast("string").alias("longitude"))
    return rows.join(place, "station_code", "left")


@REG.add("station_master", f"""WITH {oracle_view('v_station')}, c AS ({STATION_CATALOGS}), f AS (SELECT station_code, bool_or(catalog = 'hourly_rain') AS has_rain, bool_or(catalog = 'pressure') AS has_pressure, bool_or(catalog = 'humidity') AS has_humidity FROM c GROUP BY 1)
SELECT f.*, has_rain AND has_pressure AND has_humidity AS has_all_three, {r('latitude', 'latitude')}, {r('longitude + 5.0e0', 'longitude')},
 coalesce(latitude BETWEEN 5 AND 21.5 AND longitude + 5.0e0 BETWEEN 96.5 AND 106.5, false) AS valid_thailand_coords FROM f LEFT JOIN v_station s ON s.station_code = f.station_code WHERE has_rain""")
def station_master(spark, sf_dir):
    return ST.station_master(catalogs(spark, sf_dir))


@REG.add("cross_map_summary", f"""WITH {oracle_view('v_station')}, c AS ({STATION_CATALOGS}), f AS (SELECT station_code, bool_or(catalog = 'hourly_rain') AS a, bool_or(catalog = 'pressure') AS b, bool_or(catalog = 'humidity') AS d FROM c GROUP BY 1)
SELECT count(*) FILTER (a) AS total_stations, count(*) FILTER (a) AS rain_stations_count, count(*) FILTER (b) AS pressure_stations_count, count(*) FILTER (d) AS humidity_stations_count,
 count(*) FILTER (a AND b AND d) AS stations_with_all_three_catalogs, count(*) FILTER (a AND coalesce(latitude BETWEEN 5 AND 21.5 AND longitude + 5.0e0 BETWEEN 96.5 AND 106.5, false)) AS stations_with_valid_coords
FROM f LEFT JOIN v_station s ON s.station_code = f.station_code""")
def cross_map_summary(spark, sf_dir):
    cat = catalogs(spark, sf_dir)
    return ST.cross_map_summary(ST.station_master(cat), cat)


# ---- C1, C8 ----
@REG.add("label_lookup", f"""WITH {oracle_view('v_nwp')}, lab AS (SELECT run_time, cell_id, max(tp) AS observed FROM v_nwp WHERE lead_time_hours > 12 GROUP BY ALL)
SELECT n.run_time, n.cell_id, n.lead_time_hours, {r('observed', 'observed')} FROM v_nwp n LEFT JOIN lab USING (run_time, cell_id)""")
def label_lookup(spark, sf_dir):
    runs = view(spark, sf_dir, "v_nwp")
    labels = runs.where("lead_time_hours > 12").groupBy("run_time", "cell_id").agg(F.max("tp").alias("observed"))
    return runs.join(labels, ["run_time", "cell_id"], "left").select("run_time", "cell_id", "lead_time_hours", "observed")


# ---- E3 ----
@REG.add("keep_last", f"""WITH {oracle_view('v_telemetry')} SELECT station_code, variable_type, observed_at, max(event_id) AS event_id FROM
 (SELECT *, row_number() OVER (PARTITION BY station_code, variable_type, observed_at ORDER BY reported_at DESC, event_id DESC) AS k FROM v_telemetry) WHERE k = 1 GROUP BY ALL""")
def keep_last(spark, sf_dir):
    last = Q.latest_per_hour(view(spark, sf_dir, "v_telemetry"), [F.col("reported_at"), F.col("event_id")])
    return last.select("station_code", "variable_type", "observed_at", "event_id")


@REG.add("keep_first", f"""WITH {oracle_view('v_telemetry')} SELECT station_code, variable_type, observed_at, event_id FROM
 (SELECT *, row_number() OVER (PARTITION BY station_code, variable_type, observed_at ORDER BY reported_at, event_id) AS k FROM v_telemetry) WHERE k = 1""")
def keep_first(spark, sf_dir):
    rows = view(spark, sf_dir, "v_telemetry").select("station_code", "variable_type", "observed_at", "reported_at", "event_id")
    first = Q.earliest_per_key(rows, ["station_code", "variable_type", "observed_at"], [F.col("reported_at"), F.col("event_id")])
    return first.drop("reported_at")


# ---- E5, E6, D28, E7, P4 ----
@REG.add("time_split", f"""WITH {oracle_view('v_forecast_obs')}, k AS (SELECT l_orderkey, l_partkey, station_id, l_linenumber, valid_time, rank() OVER (ORDER BY valid_time, l_orderkey) AS p, count(*) OVER () AS n FROM v_forecast_obs)
SELECT l_orderkey, l_partkey, station_id, l_linenumber, valid_time, p <= floor(0.7 * n) AS is_train FROM k""")
def time_split(spark, sf_dir):
    rows = view(spark, sf_dir, "v_forecast_obs").select("l_orderkey", "l_partkey", "station_id", "l_linenumber", "valid_time")
    return P.chronological_split(rows, "valid_time", ["l_orderkey"])


@REG.add("year_split", f"""WITH {oracle_view('v_forecast_obs')} SELECT l_orderkey, l_partkey, station_id, l_linenumber, year(valid_time) < 2000 AS is_train, year(valid_time) = 2000 AS is_val FROM v_forecast_obs""")
def year_split(spark, sf_dir):
    rows = view(spark, sf_dir, "v_forecast_obs").select("l_orderkey", "l_partkey", "station_id", "l_linenumber", "valid_time")
    return P.train_validation_split(rows, ["l_orderkey"], val_year=2000).drop("valid_time")


@REG.add("expanding_folds", f"""WITH {oracle_view('v_forecast_obs')}, f AS (SELECT * FROM (VALUES (1, 1995, 1997, 1998), (2, 1995, 1999, 2000)) t(fold, a, b, v))
SELECT l_orderkey, l_partkey, station_id, l_linenumber, CAST(fold AS INT) AS fold, year(valid_time) <= b AS is_train, year(valid_time) = v AS is_val FROM v_forecast_obs JOIN f ON year(valid_time) BETWEEN a AND v""")
def expanding_folds(spark, sf_dir):
    rows = view(spark, sf_dir, "v_forecast_obs").select("l_orderkey", "l_partkey", "station_id", "l_linenumber", "valid_time")
    return P.year_folds(rows, ((1995, 1997, 1998), (1995, 1999, 2000))).drop("valid_time")


@REG.add("standardise", f"""WITH {oracle_view('v_forecast_obs')}, t AS (SELECT *, CASE WHEN l_linenumber = 7 THEN 0.0 ELSE observed_rain END AS obs0, year(valid_time) < 2000 AS tr FROM v_forecast_obs),
 s AS (SELECT avg(nwp_raw_rain) AS m1, stddev_pop(nwp_raw_rain) AS s1, avg(obs0) AS m2, stddev_pop(obs0) AS s2 FROM t WHERE tr)
SELECT l_orderkey, l_partkey, station_id, l_linenumber, {r('(nwp_raw_rain - m1)/s1', 'nwp_raw_rain')}, {r('(obs0 - m2)/s2', 'observed_rain')}, CAST(0.0 AS DOUBLE) AS flat FROM t, s""")
def standardise(spark, sf_dir):
    rows = view(spark, sf_dir, "v_forecast_obs").select(
        "l_orderkey", "l_partkey", "station_id", "l_linenumber", "nwp_raw_rain",
        F.when(F.col("l_linenumber") != 7, F.col("observed_rain")).alias("observed_rain"), F.lit(3.0).alias("flat"),
        (F.year("valid_time") < 2000).alias("is_train"))
    return P.standardise(rows, ["nwp_raw_rain", "observed_rain", "flat"]).drop("is_train")


@REG.add("quantile_rearrange", f"""WITH {oracle_view('v_forecast_obs')}, q AS (SELECT l_orderkey, l_partkey, station_id, l_linenumber, list_sort([lightgbm_m1_pred, hurdle_m1_pred, lightgbm_m3_pred, hurdle_m3_pred]) AS s FROM v_forecast_obs)
SELECT l_orderkey, l_partkey, station_id, l_linenumber, {r('s[1]', 'q10')}, {r('s[2]', 'q50')}, {r('s[3]', 'q90')}, {r('s[4]', 'q95')} FROM q""")
def quantile_rearrange(spark, sf_dir):
    rows = view(spark, sf_dir, "v_forecast_obs").select(
        "l_orderkey", "l_partkey", "station_id", "l_linenumber", F.col("lightgbm_m1_pred").alias("q10"), F.col("hurdle_m1_pred").alias("q50"),
        F.col("lightgbm_m3_pred").alias("q90"), F.col("hurdle_m3_pred").alias("q95"))
    return rows.select("l_orderkey", "l_partkey", "station_id", "l_linenumber", *S.sorted_quantiles(["q10", "q50", "q90", "q95"]))


@REG.add("frozen_year_isolation", f"""WITH {oracle_view('v_forecast_obs')} SELECT l_orderkey, l_partkey, station_id, l_linenumber, valid_time FROM v_forecast_obs WHERE valid_time < TIMESTAMP '2000-01-01'""")
def frozen_year_isolation(spark, sf_dir):
    from pluvian.operators.guards import before_frozen
    return before_frozen(view(spark, sf_dir, "v_forecast_obs"), year=2000).select(
        "l_orderkey", "l_partkey", "station_id", "l_linenumber", "valid_time")


# ---- A6 on JSON text made from the events: one document per hour and user group ----
@REG.add("hourly_json", f"""SELECT event_id, date_trunc('hour', ts) AS time, {r('value', 'precipitation')}, {r("CAST(props ->> 'k' AS DOUBLE)", 'cape')} FROM events""")
def hourly_json(spark, sf_dir):
    text = F.format_string('{"latitude": %d, "longitude": 0, "hourly": {"time": ["%s"], "precipitation_gfs": ["%s"], "cape": [%s], "rain": ["x"]}}',
                           F.col("event_id"), F.date_format(S.floor_to("ts", 3600), "yyyy-MM-dd'T'HH:mm"), F.col("value").cast("string"),
                           F.get_json_object("props", "$.k"))
    docs = table(spark, sf_dir, "events").select(F.from_json(text, FS.HOURLY_SCHEMA.simpleString()).alias("d")).select("d.*")
    rows = FS.hourly_rows(docs, "gfs", ("precipitation", "cape"))
    return rows.select(F.col("latitude").cast("bigint").alias("event_id"), "time", "precipitation", "cape")


# ---- M1..M4 ----
FEATURES = ["nwp_rain_raw", "lead_time_hours", "gfs", "month"]


def settings(spark, rounds=100):
    """The defaults, with the training rows spread over the cores."""
    return M.TreeSettings(rounds=rounds, partitions=spark.sparkContext.defaultParallelism)


def training_table(spark, sf_dir):
    rows = view(spark, sf_dir, "v_forecast_obs").select(
        "l_orderkey", "l_partkey", "station_id", "l_linenumber", F.col("nwp_raw_rain").alias("nwp_rain_raw"),
        F.col("lead_time").cast("double").alias("lead_time_hours"), F.col("gfs_raw_pred").alias("gfs"),
        F.month("valid_time").cast("double").alias("month"), "observed_rain", "valid_time",
        (F.col("observed_rain") - F.col("nwp_raw_rain")).alias("target_bias"))
    return P.train_validation_split(rows, ["l_orderkey"], val_year=2000)


VALIDATION = f"""WITH {oracle_view('v_forecast_obs')} SELECT l_orderkey, l_partkey, station_id, l_linenumber, true AS finite, true AS corrected_ok, true AS beats_raw{{more}} FROM v_forecast_obs WHERE year(valid_time) = 2000"""


def facts(scored, *more):
    """Keys of the validation rows, and what must hold: finite residuals, corrected rain from 0 up, a lower squared error than raw."""
    bias, raw, obs = (F.col(c).cast("double") for c in ("predicted_bias", "nwp_rain_raw", "observed_rain"))
    scored = written(scored)  # read twice, so the rows are scored once
    scored = scored.withColumn("_c", S.corrected_rain(raw, bias))
    error = scored.agg((F.avg((F.col("_c") - obs) * (F.col("_c") - obs)) < F.avg((raw - obs) * (raw - obs))).alias("b"))
    return scored.select("l_orderkey", "l_partkey", "station_id", "l_linenumber", S.finite("predicted_bias").alias("finite"),
                         (F.col("_c") >= 0).alias("corrected_ok"), error.select("b").scalar().alias("beats_raw"), *more)


@REG.add("gbt_l1", VALIDATION.format(more=""))
def gbt_l1(spark, sf_dir):
    return facts(M.boosted_residual(training_table(spark, sf_dir), FEATURES, "absolute", settings=settings(spark))[1])


@REG.add("gbt_l2", VALIDATION.format(more=""))
def gbt_l2(spark, sf_dir):
    return facts(M.boosted_residual(training_table(spark, sf_dir), FEATURES, "squared", settings=settings(spark))[1])


@REG.add("hurdle", VALIDATION.format(more=""))
def hurdle(spark, sf_dir):
    return facts(M.hurdle(training_table(spark, sf_dir), FEATURES, settings=settings(spark, 80))[1])


@REG.add("quantile_forest", VALIDATION.format(more=", true AS ordered"))
def quantile_forest(spark, sf_dir):
    scored = M.quantile_forest(training_table(spark, sf_dir), FEATURES, settings=settings(spark))[1]
    return facts(scored, ((F.col("q10") <= F.col("q50")) & (F.col("q50") <= F.col("q90")) & (F.col("q90") <= F.col("q95"))).alias("ordered"))


# leaf by leaf; fewer and larger steps than the defaults, since every round is a dozen small jobs
@REG.add("leafwise_l1", VALIDATION.format(more=""))
def leafwise_l1(spark, sf_dir):
    boost = B.BoostSettings(rounds=15, step=0.3, partitions=4)
    return facts(M.leafwise_residual(training_table(spark, sf_dir), FEATURES, settings=boost)[1])


@REG.add("quantile_boosting", VALIDATION.format(more=", true AS ordered"))
def quantile_boosting(spark, sf_dir):
    boost = B.BoostSettings(rounds=8, step=0.4, patience=None, partitions=4)
    scored = M.quantile_boosting(training_table(spark, sf_dir), FEATURES, settings=boost)[1]
    return facts(scored, ((F.col("q10") <= F.col("q50")) & (F.col("q50") <= F.col("q90")) & (F.col("q90") <= F.col("q95"))).alias("ordered"))


# the best split of the training residuals by lead hour and the means on either side, in closed form
@REG.add("boosted_stump", f"""WITH {oracle_view('v_forecast_obs')}, t AS (SELECT lead_time AS x, observed_rain - nwp_raw_rain AS y FROM v_forecast_obs WHERE year(valid_time) < 2000),
 h AS (SELECT x, sum(y) AS s, count(*) AS n FROM t GROUP BY x), u AS (SELECT x, sum(s) OVER (ORDER BY x) AS ls, sum(n) OVER (ORDER BY x) AS ln, sum(s) OVER () AS s, sum(n) OVER () AS n FROM h),
 b AS (SELECT * FROM u WHERE ln >= 20 AND n - ln >= 20 ORDER BY power(ls - ln * s / n, 2) * (1.0 / ln + 1.0 / (n - ln)) DESC, x LIMIT 1)
SELECT l_orderkey, l_partkey, station_id, l_linenumber, round(CASE WHEN lead_time <= x THEN ls / ln ELSE (s - ls) / (n - ln) END, 3) + 0.0 AS predicted_bias FROM v_forecast_obs, b WHERE year(valid_time) = 2000""")
def boosted_stump(spark, sf_dir):
    stump = B.BoostSettings(rounds=1, leaves=2, step=1.0, patience=None, partitions=4)
    scored = M.leafwise_residual(training_table(spark, sf_dir), ["lead_time_hours"], "squared", settings=stump)[1]
    return scored.select("l_orderkey", "l_partkey", "station_id", "l_linenumber", F.round("predicted_bias", 3).alias("predicted_bias"))

"""Telemetry, time-join and forecast-run queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvian.functions import scalars as S
from pluvian.operators import deaccum as D
from pluvian.operators import guards as G
from pluvian.operators import quality as Q
from pluvian.operators import temporal as T
from pluvian.session import fresh_path
from workload.common import Registry, r
from workload.views import oracle_view, view

REG = Registry()
START, END = "2024-01-01 00:00:00", "2024-01-30 23:00:00"
# event values reach 490, so the rain limit is a parameter here
BOUNDS = {"hourly_rain": (0.0, 480.0), "pressure": (850.0, 1020.0), "humidity": (0.0, 100.0)}


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "v_telemetry")
    return Q.classify(Q.latest_per_hour(raw, [F.col("reported_at"), F.col("event_id")]), BOUNDS)


ONE = """one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_code, variable_type, observed_at
  ORDER BY reported_at DESC, event_id DESC) AS k FROM v_telemetry) WHERE k = 1),
 num AS (SELECT *, TRY_CAST(trim(raw_value) AS DOUBLE) AS v, lower(trim(raw_value)) IN ('', 'null', 'none', 'nan', 'na', 'n/a', '-') AS tok,
   CASE variable_type WHEN 'hourly_rain' THEN 0.0 WHEN 'pressure' THEN 850.0 ELSE 0.0 END AS lo,
   CASE variable_type WHEN 'hourly_rain' THEN 480.0 WHEN 'pressure' THEN 1020.0 ELSE 100.0 END AS hi FROM one),
 cls AS (SELECT *, CASE WHEN NOT tok AND v IS NOT NULL AND v NOT IN (-999, -9999) AND (v < lo OR v > hi) THEN 'OUT_OF_BOUNDS'
   WHEN upper(trim(raw_quality_flag)) IN ('E','M','B','ERR','ERROR','NULL') THEN 'FLAG_ERROR'
   WHEN v IN (-999, -9999) THEN 'SENTINEL_ERROR' WHEN tok THEN 'EXPLICIT_NULL' WHEN v IS NULL THEN 'UNPARSEABLE' ELSE 'VALID' END AS status FROM num)"""
QC = f"WITH {oracle_view('v_telemetry')}, {ONE}"
HOURS = f"hrs AS (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 1 HOUR)) AS h)"
GRID = """g AS (SELECT k.station_code, k.variable_type, hrs.h, coalesce(c.status, 'MISSING_TIMESTAMP') AS status, c.v,
   c.tok, upper(trim(c.raw_quality_flag)) IN ('E','M','B','ERR','ERROR','NULL') AS flagged
  FROM (SELECT DISTINCT station_code, variable_type FROM cls) k CROSS JOIN hrs
  LEFT JOIN cls c ON c.station_code = k.station_code AND c.variable_type = k.variable_type AND c.observed_at = hrs.h)"""
RUNS = """bad AS (SELECT *, row_number() OVER (PARTITION BY station_code, variable_type ORDER BY h)
   - row_number() OVER (PARTITION BY station_code, variable_type, status = 'VALID' ORDER BY h) AS island FROM g),
 runs AS (SELECT station_code, variable_type, min(h) AS gap_start, max(h) AS gap_end, count(*) AS gap_hours FROM bad WHERE status <> 'VALID'
   GROUP BY station_code, variable_type, island)"""
AUDIT = """a0 AS (SELECT station_code, variable_type, count(*) AS total_expected_hours, count(*) FILTER (status <> 'MISSING_TIMESTAMP') AS actual_hours_reported,
   count(*) FILTER (status = 'MISSING_TIMESTAMP') AS missing_timestamp_hours, count(*) FILTER (tok) AS explicit_null_hours,
   count(*) FILTER (v IN (-999, -9999)) AS sentinel_error_hours, count(*) FILTER (flagged) AS flag_error_hours,
   count(*) FILTER (status = 'OUT_OF_BOUNDS') AS out_of_bounds_hours, count(*) FILTER (status = 'VALID') AS valid_hours
  FROM g GROUP BY station_code, variable_type),
 a1 AS (SELECT a0.*, round_even(valid_hours * 100.0 / total_expected_hours, 4) AS pct,
   coalesce((SELECT max(gap_hours) FROM runs WHERE runs.station_code = a0.station_code AND runs.variable_type = a0.variable_type), 0) AS gap FROM a0),
 aud AS (SELECT *, CASE WHEN valid_hours = total_expected_hours THEN 'Tier 1: Golden' WHEN pct >= 99.5 AND gap <= 3 THEN 'Tier 2: Silver'
   WHEN pct >= 95.0 THEN 'Tier 3: Bronze' ELSE 'Tier 4: Excluded' END AS tier FROM a1)"""
FULL = f"{QC}, {HOURS}, {GRID}, {RUNS}, {AUDIT}"


def audit(spark, sf_dir):
    return Q.completeness(hourly(spark, sf_dir), START, END)


@REG.add("qc_status", f"""{QC} SELECT station_code, variable_type, observed_at, status, CAST(CASE WHEN status = 'VALID' THEN round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) END AS DOUBLE) AS value FROM cls""")
def qc_status(spark, sf_dir):
    return hourly(spark, sf_dir).select("station_code", "variable_type", "observed_at", "status",
                                        F.col("value").cast("double").alias("value"))


@REG.add("completeness_tiers", f"""{FULL} SELECT station_code, variable_type, total_expected_hours, actual_hours_reported, missing_timestamp_hours,
 explicit_null_hours, sentinel_error_hours, flag_error_hours, out_of_bounds_hours, valid_hours, {r('pct', 'completeness_pct')},
 gap AS max_consecutive_gap_hours, tier, tier = 'Tier 1: Golden' AS is_golden FROM aud""")
def completeness_tiers(spark, sf_dir):
    return audit(spark, sf_dir)


@REG.add("longest_gap", f"{QC}, {HOURS}, {GRID}, {RUNS} SELECT * FROM runs")
def longest_gap(spark, sf_dir):
    return Q.invalid_runs(hourly(spark, sf_dir), START, END)


@REG.add("hourly_frame", f"""{QC}, {HOURS}, {GRID} SELECT station_code, variable_type, h AS observed_at, status AS quality_flag, status = 'VALID' AS is_valid,
 CAST(CASE WHEN status = 'VALID' THEN round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) END AS DOUBLE) AS value FROM g""")
def hourly_frame(spark, sf_dir):
    out = Q.hourly_frame(hourly(spark, sf_dir), START, END)
    return out.withColumn("value", F.col("value").cast("double"))


MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13)]
MCOLS = ", ".join(f"max(CASE WHEN strftime(o_orderdate, '%Y-%m') = '{m}' THEN 1 ELSE 0 END) AS m_{m.replace('-', '_')}" for m in MONTHS)


@REG.add("presence_matrix", f"""WITH p AS (SELECT CAST(l_suppkey AS VARCHAR) AS station_code, 'catalog_' || l_returnflag AS catalog, {MCOLS},
  count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
 SELECT * EXCLUDE (n), CAST(n AS INT) AS months_present_count, {r('round_even(n * 100.0 / 84, 2)', 'presence_rate_pct')} FROM p""")
def presence_matrix(spark, sf_dir):
    return Q.presence_matrix(presence_rows(spark, sf_dir), MONTHS)


def presence_rows(spark, sf_dir):
    from workload.views import table
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    return rows.select(F.col("l_suppkey").cast("string").alias("station_code"),
                       F.concat(F.lit("catalog_"), "l_returnflag").alias("catalog"), F.col("o_orderdate").alias("observed_at"))


@REG.add("continuity_summary", """WITH p AS (SELECT l_suppkey, 'catalog_' || l_returnflag AS catalog, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
 SELECT catalog, count(*) AS stations, count(*) FILTER (n = 84) AS stations_all_months, """
         + r("round_even(count(*) FILTER (n = 84) * 100.0 / count(*), 2)", "continuity_pct") + " FROM p GROUP BY catalog")
def continuity_summary(spark, sf_dir):
    return Q.continuity_summary(Q.presence_matrix(presence_rows(spark, sf_dir), MONTHS), len(MONTHS))


CATS = ("hourly_rain", "pressure", "humidity")


@REG.add("joint_catalogs", f"""{FULL} SELECT station_code, bool_and(tier = 'Tier 1: Golden') AS all_three_golden,
 bool_and(tier IN ('Tier 1: Golden', 'Tier 2: Silver')) AS all_three_silver_or_better, {r('min(pct)', 'min_completeness_pct')},
 {r('round_even(avg(pct), 4)', 'avg_completeness_pct')}, {', '.join(f"max(CASE WHEN variable_type = '{c}' THEN tier END) AS {c}_tier" for c in CATS)},
 {', '.join(r(f"max(CASE WHEN variable_type = '{c}' THEN pct END)", f'{c}_completeness_pct') for c in CATS)}
 FROM aud GROUP BY station_code HAVING count(DISTINCT variable_type) = 3""")
def joint_catalogs(spark, sf_dir):
    return Q.joint_catalogs(audit(spark, sf_dir))


@REG.add("audit_summary", f"""{FULL} SELECT coalesce(variable_type, 'all') AS variable_type, count(*) AS audited, count(*) FILTER (tier LIKE '%Golden') AS golden,
 count(*) FILTER (tier LIKE '%Silver') AS silver, count(*) FILTER (tier LIKE '%Bronze') AS bronze, count(*) FILTER (tier LIKE '%Excluded') AS excluded
 FROM aud GROUP BY ROLLUP (variable_type)""")
def audit_summary(spark, sf_dir):
    return Q.audit_summary(audit(spark, sf_dir))


@REG.add("golden_excerpt", f"{FULL} SELECT station_code, variable_type, tier FROM aud WHERE tier = 'Tier 1: Golden' ORDER BY station_code, variable_type LIMIT 15")
def golden_excerpt(spark, sf_dir):
    return Q.top_stations(audit(spark, sf_dir), 15).select("station_code", "variable_type", "tier")


@REG.add("station_flags", f"""WITH {oracle_view('v_obs')} SELECT station_code, true AS has_rain, bool_or(variable_type = 'pressure') AS has_pressure,
 bool_or(variable_type = 'humidity') AS has_humidity, bool_or(variable_type = 'pressure') AND bool_or(variable_type = 'humidity') AS has_all_three
 FROM v_obs GROUP BY station_code HAVING bool_or(variable_type = 'hourly_rain')""")
def station_flags(spark, sf_dir):
    return Q.station_flags(view(spark, sf_dir, "v_obs").withColumnRenamed("variable_type", "catalog"))


@REG.add("metadata_enrichment", f"""WITH {oracle_view('v_obs')}, {oracle_view('v_station')} SELECT event_id, o.station_code, s.basin_id,
 {r('s.latitude', 'latitude')}, {r('s.longitude', 'longitude')} FROM v_obs o LEFT JOIN v_station s ON o.station_code = s.station_code""")
def metadata_enrichment(spark, sf_dir):
    return Q.enrich(view(spark, sf_dir, "v_obs").select("event_id", "station_code"), view(spark, sf_dir, "v_station"),
                    ["basin_id", "latitude", "longitude"])


# ---- E1, E2, B8 ----
NWP_KEYS = ["origin", "run_time", "cell_id"]
CUM = f"WITH {oracle_view('v_nwp')}, c AS (SELECT * REPLACE (sum(tp) OVER (PARTITION BY run_time, cell_id ORDER BY lead_time_hours) AS tp) FROM v_nwp)"


def cumulative(spark, sf_dir):
    from pyspark.sql import Window
    w = Window.partitionBy("run_time", "cell_id").orderBy("lead_time_hours")
    return view(spark, sf_dir, "v_nwp").withColumn("tp", F.sum("tp").over(w))


# odd months hold running totals, even months hold interval rain: the operator must tell them apart
@REG.add("deaccumulate", f"""{CUM}, m AS (SELECT c.run_time, c.cell_id, c.lead_time_hours, CASE WHEN month(c.run_time) % 2 = 1 THEN c.tp ELSE n.tp END AS tp
  FROM c JOIN v_nwp n USING (run_time, cell_id, lead_time_hours)),
 d AS (SELECT *, tp - lag(tp) OVER (PARTITION BY run_time, cell_id ORDER BY lead_time_hours) AS df FROM m),
 v AS (SELECT run_time, sum(CASE WHEN df < -0.01 THEN 1 ELSE 0 END) / count(*) < 0.02 AND count(DISTINCT lead_time_hours) > 1 AS cum FROM d GROUP BY run_time)
SELECT d.run_time, d.cell_id, d.lead_time_hours, {r('greatest(0.0, least(300.0, CASE WHEN cum THEN greatest(0.0, coalesce(df, tp)) ELSE tp END))', 'tp')} FROM d JOIN v USING (run_time)""")
def deaccumulate(spark, sf_dir):
    both = cumulative(spark, sf_dir).withColumnRenamed("tp", "_cum").join(
        view(spark, sf_dir, "v_nwp"), ["origin", "run_time", "cell_id", "lead_time_hours"])
    mixed = both.withColumn("tp", F.when(F.month("run_time") % 2 == 1, F.col("_cum")).otherwise(F.col("tp"))).drop("_cum")
    return D.deaccumulate(mixed, cell="cell_id").select("run_time", "cell_id", "lead_time_hours", "tp")


@REG.add("deaccumulate_6h", f"""WITH {oracle_view('v_nwp')}, c AS (SELECT * REPLACE (sum(tp) OVER (PARTITION BY run_time, cell_id, (lead_time_hours - 1) // 6 ORDER BY lead_time_hours) AS tp) FROM v_nwp),
 l AS (SELECT *, lag(tp) OVER w AS pt, lag(lead_time_hours) OVER w AS pl FROM c WINDOW w AS (PARTITION BY run_time, cell_id ORDER BY lead_time_hours))
SELECT run_time, cell_id, lead_time_hours, {r('greatest(0.0, CASE WHEN pl > ((lead_time_hours - 1) // 6) * 6 THEN tp - pt ELSE tp END)', 'tp')} FROM l""")
def deaccumulate_6h(spark, sf_dir):
    from pyspark.sql import Window
    w = Window.partitionBy("run_time", "cell_id", F.floor((F.col("lead_time_hours") - 1) / F.lit(6))).orderBy("lead_time_hours")
    totals = view(spark, sf_dir, "v_nwp").withColumn("tp", F.sum("tp").over(w))
    return D.deaccumulate_buckets(totals, NWP_KEYS).select("run_time", "cell_id", "lead_time_hours", "tp")


UNITS = """u AS (SELECT origin, run_time, cell_id, lead_time_hours, CASE WHEN month(run_time) % 2 = 0 THEN tp / 1000.0e0 ELSE tp END AS tp,
  (980.0e0 + cell_id * 0.05e0) * CASE WHEN month(run_time) % 3 = 0 THEN 100.0e0 ELSE 1.0e0 END AS sp,
  20.0e0 + lead_time_hours * 0.5e0 + CASE WHEN month(run_time) % 4 = 0 THEN 273.15e0 ELSE 0.0e0 END AS t2m FROM v_nwp)"""


@REG.add("unit_inference", f"""WITH {oracle_view('v_nwp')}, {UNITS},
 f AS (SELECT run_time, coalesce(median(tp) FILTER (tp > 0) < 0.05 AND max(tp) < 2.0 AND quantile_cont(tp, 0.95) FILTER (tp > 0) < 0.5, false) AS m,
   avg(sp) > 2000 AS pa, avg(t2m) > 200 AS k FROM u GROUP BY run_time)
SELECT run_time, cell_id, lead_time_hours, {r('CASE WHEN m THEN tp * 1000.0 ELSE tp END', 'tp')}, {r('greatest(800.0, least(1050.0, CASE WHEN pa THEN sp / 100.0 ELSE sp END))', 'sp')},
 {r('greatest(-10.0, least(50.0, CASE WHEN k THEN t2m - 273.15 ELSE t2m END))', 't2m')} FROM u JOIN f USING (run_time)""")
def unit_inference(spark, sf_dir):
    text = UNITS[UNITS.index("(") + 1:-1].replace("v_nwp", "{nwp}")
    raw = spark.sql(text, nwp=view(spark, sf_dir, "v_nwp"))
    return D.normalise_units(raw).select("run_time", "cell_id", "lead_time_hours", "tp", "sp", "t2m")


# ---- C6, C7, C9, C10, I1, I2 ----
RUN_TIMES = "rt AS (SELECT DISTINCT date_trunc('day', ts) + INTERVAL '12' HOUR * CAST(hour(ts) >= 12 AS INT) AS run_time FROM events)"


def run_times(spark, sf_dir):
    from workload.views import table
    day = S.floor_to("ts", 43200)
    return table(spark, sf_dir, "events").select(day.alias("run_time")).distinct()


@REG.add("asof_lookback", f"""WITH {oracle_view('v_obs')}, {RUN_TIMES}, j AS (SELECT run_time, station_code, variable_type, value, observed_at,
  row_number() OVER (PARTITION BY run_time, station_code, variable_type ORDER BY observed_at DESC, event_id DESC) AS k
  FROM rt JOIN v_obs ON observed_at <= run_time AND observed_at >= run_time - INTERVAL 3 HOUR)
SELECT run_time, station_code, variable_type, {r('value', 'value')}, observed_at FROM j WHERE k = 1""")
def asof_lookback(spark, sf_dir):
    return T.asof_lookback(run_times(spark, sf_dir), view(spark, sf_dir, "v_obs"), tiebreak=["event_id"])


@REG.add("observations_at_runs", f"""WITH {oracle_view('v_obs')}, {RUN_TIMES}, j AS (SELECT run_time, station_code, variable_type, value,
  row_number() OVER (PARTITION BY run_time, station_code, variable_type ORDER BY observed_at DESC, value DESC) AS k
  FROM rt JOIN v_obs ON observed_at - INTERVAL 7 HOUR <= run_time AND observed_at - INTERVAL 7 HOUR >= run_time - INTERVAL 3 HOUR)
SELECT run_time, station_code, {r("max(value) FILTER (variable_type = 'hourly_rain')", 'rain')}, {r("max(value) FILTER (variable_type = 'pressure')", 'pressure')},
 {r("max(value) FILTER (variable_type = 'humidity')", 'humidity')} FROM j WHERE k = 1 GROUP BY run_time, station_code""")
def observations_at_runs(spark, sf_dir):
    return T.observations_at_runs(run_times(spark, sf_dir), view(spark, sf_dir, "v_obs"))


LABEL_REQ = """q AS (SELECT DISTINCT CAST(user_id % (SELECT count(*) FROM supplier) AS VARCHAR) AS station_code, date_trunc('hour', ts) AS valid_time, CAST(CASE WHEN user_id % 3 = 0 THEN 6 ELSE 1 END AS INT) AS step_hours FROM events)"""


@REG.add("interval_labels", f"""WITH {oracle_view('v_obs')}, {LABEL_REQ}, rain AS (SELECT * FROM v_obs WHERE variable_type = 'hourly_rain'),
 j AS (SELECT q.*, value, observed_at, event_id FROM q JOIN rain o ON o.station_code = q.station_code
  AND observed_at > valid_time - step_hours * INTERVAL 1 HOUR AND observed_at <= valid_time + INTERVAL 15 MINUTE)
SELECT station_code, valid_time, step_hours, {r('CASE WHEN step_hours = 1 THEN arg_max(value, struct_pack(a := observed_at, b := event_id)) ELSE sum(value) END', 'observed_rain')},
 count(*) AS n_obs FROM j GROUP BY station_code, valid_time, step_hours""")
def interval_labels(spark, sf_dir):
    from workload.views import table
    gauges = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    asks = table(spark, sf_dir, "events").select(
        (F.col("user_id") % gauges).cast("string").alias("station_code"), S.floor_to("ts", 3600).alias("valid_time"),
        F.when(F.col("user_id") % 3 == 0, 6).otherwise(1).cast("int").alias("step_hours"))
    rain = view(spark, sf_dir, "v_obs").where("variable_type = 'hourly_rain'")
    return T.interval_labels(asks, rain, tiebreak=["event_id"])


SAT = """sat AS (SELECT to_timestamp(floor(epoch(ts) / 600) * 600)::TIMESTAMP AS timestamp, event_type AS grid_id,
  avg(300.0e0 - value * 0.25e0) AS bt_mean, min(300.0e0 - value * 0.25e0) AS bt_min, avg(250.0e0 - value * 0.1e0) AS wv FROM events GROUP BY 1, 2)"""


def snapshots(spark, sf_dir):
    from workload.views import table
    bt, wv = F.lit(300.0) - F.col("value") * 0.25, F.lit(250.0) - F.col("value") * 0.1
    return table(spark, sf_dir, "events").groupBy(S.snap_10min("ts").alias("timestamp"), F.col("event_type").alias("grid_id")) \
        .agg(F.avg(bt).alias("bt_mean"), F.min(bt).alias("bt_min"), F.avg(wv).alias("wv_mean"))


@REG.add("lag_features", f"""WITH {SAT}, j AS (SELECT a.timestamp, a.grid_id, a.bt_mean AS b0, a.bt_min AS n0, b.bt_mean AS b1, c.bt_mean AS b2, d.bt_mean AS b3,
   round_even(a.bt_mean - d.bt_mean, 2) AS dl, CASE WHEN minute(a.timestamp) <> 30 THEN a.wv END AS wv FROM sat a
  JOIN sat b ON a.grid_id = b.grid_id AND b.timestamp = a.timestamp - INTERVAL 10 MINUTE
  JOIN sat c ON a.grid_id = c.grid_id AND c.timestamp = a.timestamp - INTERVAL 20 MINUTE
  JOIN sat d ON a.grid_id = d.grid_id AND d.timestamp = a.timestamp - INTERVAL 30 MINUTE)
SELECT grid_id, timestamp, {r('b0', 'bt_mean_t0')}, {r('n0', 'bt_min_t0')}, {r('b1', 'bt_mean_lag10m')}, {r('b2', 'bt_mean_lag20m')}, {r('b3', 'bt_mean_lag30m')},
 {r('wv', 'wv_mean')}, dl < -5.0 AS is_rapid_cooling, n0 < 210.0 AND dl < -3.0 AS is_deep_convective FROM j""")
def lag_features(spark, sf_dir):
    sat = snapshots(spark, sf_dir)
    vapour = sat.withColumn("wv_mean", F.when(F.minute("timestamp") != 30, F.col("wv_mean")))
    out = T.satellite_evolution(sat.drop("wv_mean"), vapour)
    return out.drop("delta_bt_30")


# factors with many digits keep the operator's decimal rounding away from ties
SERIES = """ser AS (SELECT 'gfs' AS origin, 10.0e0 + CAST(length(event_type) AS DOUBLE) * 0.333e0 AS lat, 100.0e0 + CAST(length(event_type) AS DOUBLE) * 0.777e0 AS lon,
  date_trunc('hour', ts) AS "time", avg(value) * 0.1000731e0 AS precipitation, avg(value) * 0.0100731e0 + 1000.0e0 AS surface_pressure, max(value) * 0.1000731e0 AS wind_speed_10m, min(value) AS wind_direction_10m
  FROM events GROUP BY event_type, date_trunc('hour', ts))"""


def series(spark, sf_dir):
    from workload.views import table
    n = F.length("event_type").cast("double")
    return table(spark, sf_dir, "events").groupBy("event_type", S.floor_to("ts", 3600).alias("time")).agg(
        (F.avg("value") * 0.1000731).alias("precipitation"), (F.avg("value") * 0.0100731 + 1000.0).alias("surface_pressure"),
        (F.max("value") * 0.1000731).alias("wind_speed_10m"), F.min("value").alias("wind_direction_10m")).select(
        F.lit("gfs").alias("origin"), (F.lit(10.0) + n * 0.333).alias("lat"), (F.lit(100.0) + n * 0.777).alias("lon"),
        "time", "precipitation", "surface_pressure", "wind_speed_10m", "wind_direction_10m")


CYCLES = f"""{SERIES}, f AS (SELECT origin, lat, lon, min("time") AS f, max("time") AS t FROM ser GROUP BY ALL),
 d AS (SELECT *, unnest(generate_series(date_trunc('day', f), date_trunc('day', t), INTERVAL 1 DAY)) AS day FROM f),
 rr AS (SELECT *, day + c * INTERVAL 1 HOUR AS run_time FROM d, (VALUES (0), (12)) v(c)),
 l AS (SELECT *, unnest(generate_series(1, 24)) AS lead FROM rr),
 cyc AS (SELECT l.origin, run_time, s."time" AS valid_time, CAST(lead AS INT) AS lead_time_hours, 'G_' || CAST(round_even(l.lat * 50, 0) AS BIGINT) || '_' || CAST(round_even(l.lon * 50, 0) AS BIGINT) AS grid_id,
  round_even(l.lat, 4) AS lat, round_even(l.lon, 4) AS lon, round(greatest(0.0, precipitation), 3) AS tp, round(surface_pressure, 1) AS sp, CAST(25.0 AS DOUBLE) AS t2m,
  round(-s.wind_speed_10m * sin(radians(s.wind_direction_10m)), 3) AS u10, round(-s.wind_speed_10m * cos(radians(s.wind_direction_10m)), 3) AS v10, CAST(0.0 AS DOUBLE) AS cape
  FROM l JOIN ser s ON s.origin = l.origin AND s.lat = l.lat AND s.lon = l.lon AND s."time" = l.run_time + lead * INTERVAL 1 HOUR)"""
CYCLE_FLOATS = ("lat", "lon", "tp", "sp", "u10", "v10")


@REG.add("rolling_cycles", f"""WITH {CYCLES} SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in CYCLE_FLOATS)}) FROM cyc""")
def rolling_cycles(spark, sf_dir):
    return T.rolling_cycles(series(spark, sf_dir))


@REG.add("rolling_cycle_sums", f"""WITH {CYCLES} SELECT run_time, count(*) AS n, {', '.join(r(f'sum({c})', c) for c in ('tp', 'sp', 'u10', 'v10'))} FROM cyc GROUP BY run_time""")
def rolling_cycle_sums(spark, sf_dir):
    return T.rolling_cycles(series(spark, sf_dir)).groupBy("run_time").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("tp", "sp", "u10", "v10")])


WITH_RUN = f"WITH {oracle_view('v_obs')}, w AS (SELECT event_id, observed_at, to_timestamp(floor(epoch(observed_at) / 43200) * 43200)::TIMESTAMP + INTERVAL 3 HOUR AS run_time FROM v_obs)"


def with_run(spark, sf_dir):
    return view(spark, sf_dir, "v_obs").select(
        "event_id", "observed_at", S.shift(S.floor_to("observed_at", 43200), hours=3).alias("run_time"))


@REG.add("leakage_violations", f"{WITH_RUN} SELECT * FROM w WHERE observed_at > run_time")
def leakage_violations(spark, sf_dir):
    return G.leakage_violations(with_run(spark, sf_dir))


@REG.add("lookback_filter", f"{WITH_RUN} SELECT * FROM w WHERE observed_at <= run_time AND observed_at >= run_time - INTERVAL 2 HOUR")
def lookback_filter(spark, sf_dir):
    return G.lookback_filter(with_run(spark, sf_dir), max_lookback_hours=2)


# ---- P2 ----
@REG.add("gap_fill", f"""{QC}, ok AS (SELECT station_code, variable_type, observed_at, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v, lead(observed_at) OVER w AS nx, lead(CAST(CAST(v AS FLOAT) AS DOUBLE)) OVER w AS nv
  FROM cls WHERE status = 'VALID' WINDOW w AS (PARTITION BY station_code, variable_type ORDER BY observed_at)),
 g AS (SELECT *, date_diff('hour', observed_at, nx) - 1 AS gap FROM ok),
 e AS (SELECT *, unnest(generate_series(1, gap)) AS k FROM g WHERE gap BETWEEN 1 AND 3)
SELECT station_code, variable_type, observed_at, round(v, 6) + 0.0 AS value, 'VALID' AS quality_flag FROM ok
UNION ALL SELECT station_code, variable_type, observed_at + k * INTERVAL 1 HOUR, round(v + (nv - v)*k/(gap + 1), 6) + 0.0, 'INTERPOLATED' FROM e""")
def gap_fill(spark, sf_dir):
    return Q.fill_short_gaps(hourly(spark, sf_dir))


@REG.add("gap_fill_curved", f"""{QC}, ok AS (SELECT station_code, variable_type, observed_at, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM cls WHERE status = 'VALID'),
 g AS (SELECT *, lag(observed_at) OVER w AS t0, lag(v) OVER w AS y0, lead(observed_at) OVER w AS t2, lead(v) OVER w AS y2, lead(observed_at, 2) OVER w AS t3, lead(v, 2) OVER w AS y3
  FROM ok WINDOW w AS (PARTITION BY station_code, variable_type ORDER BY observed_at)),
 h AS (SELECT *, date_diff('hour', observed_at, t2) AS h1, (y2 - v) / nullif(date_diff('hour', observed_at, t2), 0) AS d1, date_diff('hour', t0, observed_at) AS h0, date_diff('hour', t2, t3) AS h2 FROM g),
 d AS (SELECT *, CASE WHEN h0 <= 4 THEN (v - y0) / h0 END AS d0, CASE WHEN h2 <= 4 THEN (y3 - y2) / h2 END AS d2 FROM h WHERE h1 BETWEEN 2 AND 4),
 m AS (SELECT *, CASE WHEN d0 IS NULL THEN d1 WHEN d0 * d1 <= 0 THEN 0.0 ELSE 3.0 * (h0 + h1) / ((2 * h1 + h0) / d0 + (h1 + 2 * h0) / d1) END AS ma,
   CASE WHEN d2 IS NULL THEN d1 WHEN d2 * d1 <= 0 THEN 0.0 ELSE 3.0 * (h2 + h1) / ((2 * h1 + h2) / d2 + (h1 + 2 * h2) / d1) END AS mb FROM d),
 e AS (SELECT *, k * 1.0e0 / h1 AS s FROM (SELECT *, unnest(generate_series(1, h1 - 1)) AS k FROM m))
SELECT station_code, variable_type, observed_at, round(v, 6) + 0.0 AS value, 'VALID' AS quality_flag FROM ok
UNION ALL SELECT station_code, variable_type, observed_at + k * INTERVAL 1 HOUR, round((1 + 2*s)*(1 - s)*(1 - s)*v + s*(1 - s)*(1 - s)*h1*ma + s*s*(3 - 2*s)*y2 + s*s*(s - 1)*h1*mb, 6) + 0.0, 'INTERPOLATED' FROM e""")
def gap_fill_curved(spark, sf_dir):
    return Q.fill_short_gaps(hourly(spark, sf_dir), curve="cubic", chunk_hours=240)


# ---- I1, I2 while a table is written ----
@REG.add("guarded_write", f"""{WITH_RUN} SELECT event_id, observed_at, run_time, (SELECT count(*) FROM w WHERE observed_at > run_time) AS n_late,
 (SELECT count(*) FROM w WHERE year(run_time) = 2025) AS n_frozen FROM w WHERE observed_at <= run_time""")
def guarded_write(spark, sf_dir):
    """The whole table meets its guards and is refused; the rows that hold are written."""
    rows, path = with_run(spark, sf_dir), fresh_path(spark, "guarded")
    late = frozen = 0
    try:
        G.write_guarded(rows, path)
    except G.LeakageError as e:
        late, frozen = e.counts["observed after run"], e.counts["frozen year"]
    G.write_guarded(rows.where(F.col("observed_at") <= F.col("run_time")), path)
    return spark.read.parquet(path).withColumns({"n_late": F.lit(late).cast("bigint"), "n_frozen": F.lit(frozen).cast("bigint")})

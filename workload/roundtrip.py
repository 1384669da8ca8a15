"""Sources and sinks: whole driver tables written in a layout of their own, read back, and compared with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvian.functions import scalars as S
from pluvian.operators import columns as C
from pluvian.operators import verify as V
from pluvian.operators.deaccum import normalise_runs
from pluvian.operators.guards import invalid_runs_of
from pluvian.operators.spatial import attach_satellite, satellite_of_cell
from pluvian.plans.features import attach_labels
from pluvian.session import fresh_path
from pluvian.sources import forecasts as FS
from pluvian.sources import stations as ST
from pluvian.sources import tables as TB
from pluvian.sources import telemetry as TL
from workload.assembly import FORECAST, SATELLITE, forecast, satellite
from workload.common import Registry, r
from workload.telemetry import UNITS
from workload.views import oracle_view, table, view

REG = Registry()


folder = fresh_path


# ---- A1, A9 ----
@REG.add("clean_round_trip", f"""WITH {oracle_view('v_obs')} SELECT station_code, observed_at, variable_type, {r('CAST(value AS FLOAT)', 'value')}, 'VALID' AS quality_flag, event_id % 2 = 0 AS is_golden, CAST(year(observed_at) AS INT) AS year
 FROM v_obs WHERE variable_type IN ('hourly_rain', 'pressure')""")
def clean_round_trip(spark, sf_dir):
    path = folder(spark, "clean")
    rows = view(spark, sf_dir, "v_obs").select(
        "station_code", "observed_at", "variable_type", F.col("value").cast("float").alias("value"),
        F.lit("VALID").alias("quality_flag"), (F.col("event_id") % 2 == 0).alias("is_golden"))
    TL.write_clean(rows, path)
    return TL.scan_clean(spark, path, ["hourly_rain", "pressure"])


# ---- A2, A10, E10 ----
@REG.add("runs_round_trip", f"""WITH {FORECAST} SELECT origin, run_time, lead_time_hours, CAST(cell_id AS VARCHAR) AS grid_id, {r('tp', 'tp')} FROM fc WHERE cell_id IN (SELECT c_custkey FROM customer)""")
def runs_round_trip(spark, sf_dir):
    path = folder(spark, "runs")
    FS.write_runs(forecast(spark, sf_dir), path)
    return FS.scan_runs(spark, path, recursive=False).select("origin", "run_time", "lead_time_hours", "grid_id", "tp")


# ---- A3, I6, B21, B17 ----
@REG.add("features_round_trip", f"""WITH {oracle_view('v_forecast_obs')} SELECT CAST(l_orderkey AS INT) AS l_orderkey, l_linenumber, 'G' || l_partkey AS grid_id, valid_time, {r('CAST(observed_rain AS FLOAT)', 'observed_rain')}
 FROM v_forecast_obs WHERE valid_time < TIMESTAMP '2000-01-01'""")
def features_round_trip(spark, sf_dir):
    path = folder(spark, "features")
    rows = view(spark, sf_dir, "v_forecast_obs").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("G"), "l_partkey").alias("grid_id"), "run_time", "valid_time", "observed_rain")
    TB.write_features(rows, path)
    return TB.scan_features(spark, path, before_year=2000).select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "grid_id", "valid_time", "observed_rain")


# ---- A11, B24 ----
@REG.add("snapshots_round_trip", f"""WITH {oracle_view('v_pixels')} SELECT event_id, scan_time AS timestamp, {r('val', 'val')}, CAST(scan_time AS DATE) AS date FROM v_pixels""")
def snapshots_round_trip(spark, sf_dir):
    path = folder(spark, "snapshots")
    TB.write_snapshots(view(spark, sf_dir, "v_pixels").select("event_id", F.col("scan_time").alias("timestamp"), "val"), path)
    return TB.scan_snapshots(spark, path, start="1900-01-01", end="2100-01-01")


# ---- A12, A8, B18: a second weather model must not erase the first ----
@REG.add("predictions_round_trip", f"""WITH {oracle_view('v_forecast_obs')} SELECT l_orderkey, l_partkey, station_id, l_linenumber, {r('lightgbm_m1_pred', 'corrected_rain')}, 'gfs' AS weather_model, 'lightgbm' AS model_name, 'm1' AS ablation
 FROM v_forecast_obs WHERE l_partkey % 2 = 0""")
def predictions_round_trip(spark, sf_dir):
    path = folder(spark, "predictions")
    rows = view(spark, sf_dir, "v_forecast_obs").select(
        "l_orderkey", "l_partkey", "station_id", "l_linenumber", F.col("lightgbm_m1_pred").alias("corrected_rain"),
        F.when(F.col("l_partkey") % 2 == 0, "gfs").otherwise("ecmwf_ifs").alias("weather_model"),
        F.lit("lightgbm").alias("model_name"), F.lit("m1").alias("ablation"))
    for name in ("gfs", "ecmwf_ifs"):
        TB.write_predictions(rows.where(F.col("weather_model") == name), path)
    return C.of_weather_model(TB.scan_predictions(spark, path), "ncep")


# ---- A13 ----
@REG.add("reports_round_trip", f"""WITH {oracle_view('v_forecast_obs')} SELECT CAST(basin_id AS VARCHAR) AS basin_id, CAST(count(*) AS VARCHAR) AS n FROM v_forecast_obs GROUP BY basin_id""")
def reports_round_trip(spark, sf_dir):
    path = folder(spark, "reports")
    TB.write_reports({"basins": view(spark, sf_dir, "v_forecast_obs").groupBy("basin_id").agg(F.count(F.lit(1)).alias("n"))}, path)
    return spark.read.option("header", True).csv(f"{path}/basins")


# ---- A5: both generations as text files ----
@REG.add("telemetry_csv", """SELECT CAST(event_id AS VARCHAR) AS station_code, ts AS observed_at, CASE WHEN event_id % 2 = 0 THEN 'hourly_rain' ELSE 'pressure' END AS variable_type,
 CAST(user_id AS VARCHAR) AS raw_value, CASE WHEN event_id % 3 = 0 THEN 'E' ELSE 'N' END AS raw_quality_flag FROM events""")
def telemetry_csv(spark, sf_dir):
    path = folder(spark, "telemetry")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("station_code"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("measure_datetime"),
        "event_id", "user_id", F.when(F.col("event_id") % 3 == 0, "E").otherwise("N").alias("quality_flag"))
    for name, even in (("rain", True), ("press", False)):
        part = rows.where((F.col("event_id") % 2 == 0) == F.lit(even))
        (part.select("station_code", "measure_datetime", F.col("user_id").alias(name), "quality_flag")
         .write.option("header", True).csv(f"{path}/{name}"))
    return TL.parse_telemetry(spark, [f"{path}/rain", f"{path}/press"])


# ---- A4, A14 ----
@REG.add("station_csv", f"""WITH {oracle_view('v_station')} SELECT station_code, CAST(basin_id AS VARCHAR) AS basin_id, 'กรุงเทพ ' || station_code AS station_name, 'hourly_rain' AS catalog FROM v_station""")
def station_csv(spark, sf_dir):
    path = folder(spark, "stations")
    (view(spark, sf_dir, "v_station").select(F.col("station_code").alias("Station Code"), F.col("basin_id").alias("Basin_ID"),
                                             F.concat(F.lit("กรุงเทพ "), "station_code").alias("Station Name"))
     .write.option("header", True).csv(path))
    return ST.scan_station_csv(spark, path, "hourly_rain")


# ---- B19, B26, B29, I3 ----
@REG.add("labelled_rows", f"""WITH {oracle_view('v_forecast_obs')} SELECT l_orderkey, l_partkey, station_id, l_linenumber, {r('nwp_raw_rain + (observed_rain - nwp_raw_rain)', 'observed')} FROM v_forecast_obs WHERE l_linenumber <> 7""")
def labelled_rows(spark, sf_dir):
    rows = view(spark, sf_dir, "v_forecast_obs").select(
        "l_orderkey", "l_partkey", "station_id", "l_linenumber", F.col("nwp_raw_rain").alias("nwp_rain_raw"),
        F.when(F.col("l_linenumber") != 7, F.col("observed_rain") - F.col("nwp_raw_rain")).alias("target_bias"))
    kept = C.labelled(rows)
    return kept.select("l_orderkey", "l_partkey", "station_id", "l_linenumber", C.observed_or_fallback(kept).alias("observed"))


@REG.add("ablation_input", f"""WITH {oracle_view('v_forecast_obs')} SELECT l_orderkey, l_partkey, station_id, l_linenumber, {r('CASE WHEN l_linenumber = 7 THEN 0.0 ELSE nwp_raw_rain END', 'nwp_rain_raw')}, CAST(lead_time AS DOUBLE) AS lead_time_hours FROM v_forecast_obs""")
def ablation_input(spark, sf_dir):
    rows = view(spark, sf_dir, "v_forecast_obs").select(
        "l_orderkey", "l_partkey", "station_id", "l_linenumber",
        F.when(F.col("l_linenumber") != 7, F.col("nwp_raw_rain")).alias("nwp_rain_raw"), F.col("lead_time").alias("lead_time_hours"))
    return C.ablation_matrix_input(rows, "m2", ["l_orderkey", "l_partkey", "station_id", "l_linenumber"])


@REG.add("invalid_runs", f"""WITH {oracle_view('v_forecast_obs')} SELECT l_orderkey, l_partkey, station_id, l_linenumber FROM v_forecast_obs WHERE lead_time < 6""")
def invalid_runs(spark, sf_dir):
    rows = view(spark, sf_dir, "v_forecast_obs").withColumn("valid_time", S.shift("run_time", hours=F.col("lead_time") - 6))
    return invalid_runs_of(rows).select("l_orderkey", "l_partkey", "station_id", "l_linenumber")


# ---- C8, with cells that no gauge labels ----
PLACES = f"""{oracle_view('v_grid')}, {oracle_view('v_station')}, {oracle_view('v_obs')}, {FORECAST}"""


@REG.add("attach_labels", f"""WITH {PLACES},
 k AS (SELECT cell_id, station_code AS sc FROM v_grid JOIN v_station ON station_code = CAST(cell_id % (SELECT count(*) FROM v_station) AS VARCHAR)),
 lab AS (SELECT fc.run_time, fc.cell_id, lead_time_hours, arg_max(value, struct_pack(a := observed_at, b := value)) AS o FROM fc JOIN k USING (cell_id) JOIN v_obs v ON v.station_code = k.sc AND variable_type = 'hourly_rain'
  AND observed_at - INTERVAL 7 HOUR > run_time + lead_time_hours * INTERVAL 1 HOUR - INTERVAL 1 HOUR AND observed_at - INTERVAL 7 HOUR <= run_time + lead_time_hours * INTERVAL 1 HOUR + INTERVAL 15 MINUTE WHERE cell_id % 10 = 0 GROUP BY ALL)
SELECT fc.run_time, CAST(fc.cell_id AS VARCHAR) AS grid_id, fc.lead_time_hours, {r('lab.o', 'observed_rain')} FROM fc JOIN v_grid USING (cell_id) LEFT JOIN lab USING (run_time, cell_id, lead_time_hours)""")
def labels(spark, sf_dir):
    """Every tenth cell has the gauge of its number, the others none, so most rows share a null gauge."""
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    cells = view(spark, sf_dir, "v_grid").where(F.col("cell_id") % 10 == 0).select(
        F.col("cell_id").cast("string").alias("grid_id"), (F.col("cell_id") % n).cast("string").alias("station_code"))
    gauges = view(spark, sf_dir, "v_station").select("station_code")
    out = attach_labels(forecast(spark, sf_dir), view(spark, sf_dir, "v_obs"), cells.join(gauges, "station_code"))
    return out.select("run_time", "grid_id", "lead_time_hours", "observed_rain")


# ---- C3, B14 ----
@REG.add("satellite_cells", f"""WITH {PLACES}, {SATELLITE}
SELECT fc.run_time, CAST(fc.cell_id AS VARCHAR) AS grid_id, fc.lead_time_hours, {r('coalesce(bt, 285.0)', 'bt_mean_t0')} FROM fc JOIN nn USING (cell_id) LEFT JOIN sv ON sv.sid = nn.sid AND sv.run_time = fc.run_time""")
def satellite_cells(spark, sf_dir):
    rows, seen = forecast(spark, sf_dir), satellite(spark, sf_dir)
    cells = view(spark, sf_dir, "v_grid").select(F.col("cell_id").cast("string").alias("grid_id"), "lat", "lon")
    return attach_satellite(rows, satellite_of_cell(cells, seen), seen).select("run_time", "grid_id", "lead_time_hours", "bt_mean_t0")


# ---- raw runs to analysis-ready runs in one plan ----
@REG.add("normalised_runs", f"""WITH {oracle_view('v_nwp')}, {oracle_view('v_station')}, {UNITS},
 f AS (SELECT run_time, coalesce(median(tp) FILTER (tp > 0) < 0.05 AND max(tp) < 2.0 AND quantile_cont(tp, 0.95) FILTER (tp > 0) < 0.5, false) AS m,
   avg(sp) > 2000 AS pa, avg(t2m) > 200 AS k FROM u JOIN v_station ON station_code = CAST(cell_id AS VARCHAR) GROUP BY run_time),
 n AS (SELECT origin, run_time, lead_time_hours, latitude AS lat, longitude AS lon, 'G_' || CAST(round_even(latitude * 50.0, 0) AS BIGINT) || '_' || CAST(round_even(longitude * 50.0, 0) AS BIGINT) AS grid_id,
   CASE WHEN m THEN tp * 1000.0 ELSE tp END AS tp, greatest(800.0, least(1050.0, CASE WHEN pa THEN sp / 100.0 ELSE sp END)) AS sp,
   greatest(-10.0, least(50.0, CASE WHEN k THEN t2m - 273.15 ELSE t2m END)) AS t2m FROM u JOIN f USING (run_time) JOIN v_station ON station_code = CAST(cell_id AS VARCHAR)),
 d AS (SELECT *, tp - lag(tp) OVER (PARTITION BY origin, run_time, grid_id ORDER BY lead_time_hours) AS df FROM n),
 v AS (SELECT origin, run_time, sum(CASE WHEN df < -0.01 THEN 1 ELSE 0 END) / count(*) < 0.02 AND count(DISTINCT lead_time_hours) > 1 AS cum FROM d GROUP BY origin, run_time)
SELECT origin, run_time, run_time + lead_time_hours * INTERVAL 1 HOUR AS valid_time, CAST(lead_time_hours AS INT) AS lead_time_hours, grid_id, {r('lat', 'lat')}, {r('lon', 'lon')},
 {r('greatest(0.0, least(300.0, CASE WHEN cum THEN greatest(0.0, coalesce(df, tp)) ELSE tp END))', 'tp')}, {r('sp', 'sp')}, {r('t2m', 't2m')}, CAST(0.0 AS DOUBLE) AS cape FROM d JOIN v USING (origin, run_time)""")
def normalised_runs(spark, sf_dir):
    text = UNITS[UNITS.index("(") + 1:-1].replace("v_nwp", "{nwp}")
    sites = view(spark, sf_dir, "v_station").select(F.col("station_code").cast("bigint").alias("cell_id"),
                                                    F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    raw = (spark.sql(text, nwp=view(spark, sf_dir, "v_nwp")).join(sites, "cell_id")
           .withColumn("valid_time", S.shift("run_time", hours=F.col("lead_time_hours"))).drop("lead_time_hours", "cell_id"))
    return normalise_runs(raw).withColumn("lead_time_hours", F.col("lead_time_hours").cast("int"))


# ---- prediction files of two models to a report table in one job ----
REPORT = """SELECT model, ablation, lead_time, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg((p - o) * (p - o))), 6) + 0.0 AS rmse, round(avg(abs(p - o)), 6) + 0.0 AS mae FROM l GROUP BY ALL"""


@REG.add("prediction_reports", f"""WITH {oracle_view('v_forecast_obs')}, l AS (SELECT 'lightgbm' AS model, 'm1' AS ablation, lead_time, lightgbm_m1_pred AS p, observed_rain AS o FROM v_forecast_obs
 UNION ALL SELECT 'hurdle', 'm2', lead_time, hurdle_m2_pred, observed_rain FROM v_forecast_obs) {REPORT}""")
def prediction_reports(spark, sf_dir):
    path, out = fresh_path(spark, "predictions"), fresh_path(spark, "reports")
    rows = view(spark, sf_dir, "v_forecast_obs")
    for model, ablation in (("lightgbm", "m1"), ("hurdle", "m2")):
        TB.write_predictions(rows.select("lead_time", "observed_rain", "nwp_raw_rain", F.col(f"{model}_{ablation}_pred").alias("corrected_rain"),
                                         F.lit("gfs").alias("weather_model"), F.lit(model).alias("model_name"), F.lit(ablation).alias("ablation")), path)
    long = TB.scan_predictions(spark, path).select(
        F.col("model_name").alias("model"), "ablation", "lead_time", F.col("observed_rain").alias("obs"),
        F.col("corrected_rain").alias("pred"), F.col("nwp_raw_rain").alias("raw"))
    cells = V.score_cells(long, ["model", "ablation", "lead_time"], [])
    scores = V.continuous_columns()
    TB.write_reports({"lead_time": cells.select("model", "ablation", "lead_time", "n", scores["rmse"].alias("rmse"), scores["mae"].alias("mae"))}, out)
    return spark.read.option("header", True).schema("model string, ablation string, lead_time int, n bigint, rmse double, mae double").csv(f"{out}/lead_time")

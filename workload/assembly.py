"""The assembled feature matrix and its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvian.functions import constants as K
from pluvian.functions import scalars as S
from pluvian.plans.cycles import extend_cycles, finished_cycles, scan_cycles
from pluvian.plans.features import feature_matrix
from pluvian.session import fresh_path
from workload.common import Registry, r
from workload.space import G2, G3, PAIRS, R1, RING_COLS, RINGS, moments, near_out, near_sql, ring_out
from workload.views import oracle_view, table, view

REG = Registry()

RUN = "to_timestamp(floor(epoch_us(ts) / 43200000000) * 43200)::TIMESTAMP"
FORECAST = f"""fc AS (SELECT 'gfs' AS origin, {RUN} AS run_time, CAST(event_id % 6 + 1 AS INT) AS lead_time_hours, user_id AS cell_id, avg(value) * 0.1e0 AS tp FROM events GROUP BY ALL)"""


def forecast(spark, sf_dir, places: str = "v_grid"):
    ev = table(spark, sf_dir, "events").groupBy(
        S.floor_to("ts", 43200).alias("run_time"), (F.col("event_id") % 6 + 1).cast("int").alias("lead_time_hours"),
        F.col("user_id").cast("string").alias("grid_id")).agg((F.avg("value") * 0.1).alias("tp"))
    cells = view(spark, sf_dir, places).select(F.col("cell_id").cast("string").alias("grid_id"), "lat", "lon")
    return ev.join(cells, "grid_id").withColumn("origin", F.lit("gfs")) \
        .withColumn("valid_time", S.shift("run_time", hours=F.col("lead_time_hours")))


def terrain(spark, sf_dir, places: str = "v_station"):
    return view(spark, sf_dir, places).select(
        F.concat(F.lit("S"), "station_code").alias("grid_id"), F.col("station_code").alias("legacy_grid_id"),
        F.col("latitude").alias("centroid_lat"), F.col("longitude").alias("centroid_lon"), "elevation_m")


NEAR = ", ".join(f"{r(f'coalesce(n_{v}.x, {d})', f'nearest_{v}_val')}, {r(f'coalesce(n_{v}.d, 50.0)', f'nearest_{v}_dist_km')}"
                 for v, d in (("rain", 0.0), ("pressure", 1010.0), ("humidity", 70.0)))


@REG.add("feature_matrix", f"""{PAIRS}, {oracle_view('v_obs')}, {FORECAST}, rt AS (SELECT DISTINCT run_time FROM fc),
 lo AS (SELECT run_time, station_code, variable_type, value, row_number() OVER (PARTITION BY run_time, station_code, variable_type ORDER BY observed_at DESC, value DESC) AS k
  FROM rt JOIN v_obs ON observed_at - INTERVAL 7 HOUR <= run_time AND observed_at - INTERVAL 7 HOUR >= run_time - INTERVAL 3 HOUR),
 ob AS (SELECT run_time, station_code, max(value) FILTER (variable_type = 'hourly_rain') AS rain, max(value) FILTER (variable_type = 'pressure') AS pressure,
  max(value) FILTER (variable_type = 'humidity') AS humidity FROM lo WHERE k = 1 GROUP BY ALL),
 nr AS (SELECT run_time, cell_id, {near_sql('rain')}, {near_sql('pressure')}, {near_sql('humidity')}, avg(pressure) FILTER (dist > 20.0) AS p4 FROM p JOIN ob USING (station_code) GROUP BY run_time, cell_id),
 ls AS (SELECT cell_id, arg_min(station_code, struct_pack(a := d, b := station_code)) AS sc FROM (SELECT cell_id, station_code, sqrt((sx-gx)*(sx-gx)+(sy-gy)*(sy-gy)) AS d FROM g, s) WHERE d <= 5.0 GROUP BY cell_id),
 lab AS (SELECT fc.run_time, fc.cell_id, lead_time_hours, arg_max(value, struct_pack(a := observed_at, b := value)) AS o FROM fc JOIN ls USING (cell_id) JOIN v_obs v ON v.station_code = ls.sc AND variable_type = 'hourly_rain'
  AND observed_at - INTERVAL 7 HOUR > run_time + lead_time_hours * INTERVAL 1 HOUR - INTERVAL 1 HOUR AND observed_at - INTERVAL 7 HOUR <= run_time + lead_time_hours * INTERVAL 1 HOUR + INTERVAL 15 MINUTE GROUP BY ALL),
 te AS (SELECT cell_id, arg_min(elevation_m, power(lat-latitude, 2)+power(lon-longitude, 2)) AS elevation_m FROM g, s GROUP BY cell_id)
SELECT fc.run_time, CAST(fc.cell_id AS VARCHAR) AS grid_id, fc.lead_time_hours, {r('fc.tp', 'nwp_rain_raw')}, {r('te.elevation_m', 'elevation_m')}, {NEAR}, {r('coalesce(p4, n_pressure.x, 1010.0)', 'pressure_mean_20_50km')}, {r('lab.o', 'observed_rain')}
FROM fc JOIN g USING (cell_id) LEFT JOIN nr USING (run_time, cell_id) LEFT JOIN te USING (cell_id) LEFT JOIN lab USING (run_time, cell_id, lead_time_hours)""")
def assembled(spark, sf_dir):
    out = feature_matrix(forecast(spark, sf_dir), terrain(spark, sf_dir), view(spark, sf_dir, "v_station"),
                         view(spark, sf_dir, "v_obs"), require_label=False)
    return out.select("run_time", "grid_id", "lead_time_hours", "nwp_rain_raw", "elevation_m", *[
        f"nearest_{v}_{s}" for v in ("rain", "pressure", "humidity") for s in ("val", "dist_km")], "pressure_mean_20_50km",
        "observed_rain")


SATELLITE = """nn AS (SELECT cell_id, arg_min(sid, struct_pack(a := power(lat - latitude, 2) + power(lon - longitude, 2), b := sid)) AS sid
  FROM v_grid, (SELECT DISTINCT 'S' || station_code AS sid, latitude, longitude FROM v_station) GROUP BY cell_id),
 sv AS (SELECT 'S' || CAST(cell_id % (SELECT count(*) FROM v_station) AS VARCHAR) AS sid, run_time, max(tp) + 200.0e0 AS bt FROM fc GROUP BY ALL)"""


def satellite(spark, sf_dir):
    """One satellite cell per station place, seen at the runs for which the cells of its number have rain."""
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    layout = view(spark, sf_dir, "v_station").select(F.concat(F.lit("S"), "station_code").alias("grid_id"),
                                                     F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    seen = (forecast(spark, sf_dir).groupBy(F.concat(F.lit("S"), (F.col("grid_id").cast("bigint") % n).cast("string")).alias("grid_id"),
                                            F.col("run_time").alias("timestamp")).agg((F.max("tp") + 200.0).alias("bt_mean_t0")))
    return layout.join(seen, "grid_id", "left")


# ---- the default path: labels required, satellite, every feature ----
MESH = (PAIRS.replace(oracle_view("v_grid"), oracle_view("v_mesh")).replace(oracle_view("v_station"), oracle_view("v_gauge"))
        .replace("FROM v_grid", "FROM v_mesh").replace("FROM v_station", "FROM v_gauge"))
SEEN = """nn AS (SELECT cell_id, arg_min(sid, struct_pack(a := power(lat - latitude, 2) + power(lon - longitude, 2), b := sid)) AS sid
  FROM v_mesh, (SELECT DISTINCT 'S' || station_code AS sid, latitude, longitude FROM v_gauge) GROUP BY cell_id),
 sv AS (SELECT 'S' || CAST(cell_id % (SELECT count(*) FROM v_gauge) AS VARCHAR) AS sid, run_time, max(tp) + 200.0e0 AS bt FROM fc GROUP BY ALL)"""
MATRIX_COLS = ["nwp_rain_raw", "elevation_m", *K.GROUND_FEATURES, "bt_mean_t0", "observed_rain", "target_bias"]


@REG.add("feature_matrix_labelled", f"""{MESH}, {oracle_view('v_readings')}, {FORECAST}, rt AS (SELECT DISTINCT run_time FROM fc),
 lo AS (SELECT run_time, station_code, variable_type, value, row_number() OVER (PARTITION BY run_time, station_code, variable_type ORDER BY observed_at DESC, value DESC) AS k
  FROM rt JOIN v_readings ON observed_at - INTERVAL 7 HOUR <= run_time AND observed_at - INTERVAL 7 HOUR >= run_time - INTERVAL 3 HOUR),
 ob AS (SELECT run_time, station_code, max(value) FILTER (variable_type = 'hourly_rain') AS rain, max(value) FILTER (variable_type = 'pressure') AS pressure,
  max(value) FILTER (variable_type = 'humidity') AS humidity FROM lo WHERE k = 1 GROUP BY ALL),
 ls AS (SELECT cell_id, arg_min(station_code, struct_pack(a := d, b := station_code)) AS sc FROM (SELECT cell_id, station_code, sqrt((sx-gx)*(sx-gx)+(sy-gy)*(sy-gy)) AS d FROM g, s) WHERE d <= 5.0 GROUP BY cell_id),
 lab AS MATERIALIZED (SELECT fc.run_time, fc.cell_id, lead_time_hours, any_value(tp) AS tp, arg_max(value, struct_pack(a := observed_at, b := value)) AS o FROM fc JOIN ls USING (cell_id) JOIN v_readings v ON v.station_code = ls.sc AND variable_type = 'hourly_rain'
  AND observed_at - INTERVAL 7 HOUR > run_time + lead_time_hours * INTERVAL 1 HOUR - INTERVAL 1 HOUR AND observed_at - INTERVAL 7 HOUR <= run_time + lead_time_hours * INTERVAL 1 HOUR + INTERVAL 15 MINUTE GROUP BY ALL),
 pj AS MATERIALIZED (SELECT p.*, ob.run_time, rain, pressure, humidity FROM p JOIN ob USING (station_code) SEMI JOIN lab ON lab.run_time = ob.run_time AND lab.cell_id = p.cell_id),
 {RINGS}, b AS (SELECT cell_id, arg_min(struct_pack(d := dist, dx := dx, dy := dy), struct_pack(a := dist, b := station_code)) AS n FROM p WHERE {R1} GROUP BY cell_id),
 mp AS ({moments('pressure')}), mh AS ({moments('humidity')}),
 gp AS (SELECT run_time, cell_id, CASE WHEN n >= 3 THEN greatest(0.0, least(50.0, 100.0*({G3}))) ELSE 0.0 END AS pg FROM mp),
 gh AS (SELECT run_time, cell_id, CASE WHEN n >= 3 THEN greatest(0.0, least(50.0, 100.0*({G2}))) ELSE 0.0 END AS hg FROM mh),
 te AS (SELECT cell_id, arg_min(elevation_m, power(lat-latitude, 2)+power(lon-longitude, 2)) AS elevation_m FROM g, s GROUP BY cell_id), {SEEN}
SELECT lab.run_time, CAST(lab.cell_id AS VARCHAR) AS grid_id, lead_time_hours, {r('tp', 'nwp_rain_raw')}, {r('te.elevation_m', 'elevation_m')}, {ring_out()}, {near_out()},
 {r('coalesce(n.d, 5.0)', 'nearest_stn_dist_2_5km')}, {r('coalesce(sin(atan2(n.dx, n.dy)), 0.0)', 'nearest_stn_bearing_sin')}, {r('coalesce(cos(atan2(n.dx, n.dy)), 1.0)', 'nearest_stn_bearing_cos')},
 round(coalesce(pg, 0.0), 4) + 0.0 AS pressure_gradient_mag, round(coalesce(hg, 0.0), 4) + 0.0 AS humidity_gradient_mag,
 {r('coalesce(bt, 285.0)', 'bt_mean_t0')}, {r('lab.o', 'observed_rain')}, {r('round_even(lab.o - tp, 2)', 'target_bias')}
FROM lab JOIN g USING (cell_id) LEFT JOIN a USING (run_time, cell_id) LEFT JOIN b USING (cell_id) LEFT JOIN gp USING (run_time, cell_id) LEFT JOIN gh USING (run_time, cell_id)
 LEFT JOIN te USING (cell_id) LEFT JOIN nn USING (cell_id) LEFT JOIN sv ON sv.sid = nn.sid AND sv.run_time = lab.run_time""")
def labelled_matrix(spark, sf_dir):
    """With satellite; rows without a label go before anything is joined to them."""
    rows = forecast(spark, sf_dir, "v_mesh")
    gauges = view(spark, sf_dir, "v_gauge")
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    layout = gauges.select(F.concat(F.lit("S"), "station_code").alias("grid_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    seen = (rows.groupBy(F.concat(F.lit("S"), (F.col("grid_id").cast("bigint") % n).cast("string")).alias("grid_id"),
                         F.col("run_time").alias("timestamp")).agg((F.max("tp") + 200.0).alias("bt_mean_t0")))
    cells = view(spark, sf_dir, "v_mesh").select(F.col("cell_id").cast("string").alias("grid_id"), "lat", "lon")
    out = feature_matrix(rows, terrain(spark, sf_dir, "v_gauge"), gauges, view(spark, sf_dir, "v_readings"),
                         satellite=layout.join(seen, "grid_id", "left"), cells=cells)
    return out.select("run_time", "grid_id", "lead_time_hours", *[
        F.round(c, 4).alias(c) if c.endswith("gradient_mag") else F.col(c) for c in MATRIX_COLS])


# ---- cycles in three runs: the first ones, the rest, and once more with nothing left to do ----
@REG.add("incremental_cycles", f"""WITH {oracle_view('v_grid')}, {FORECAST}
SELECT fc.run_time, CAST(cell_id AS VARCHAR) AS grid_id, lead_time_hours, {r('tp', 'tp')}, count(*) OVER (PARTITION BY fc.run_time) AS n_rows,
 CAST((SELECT count(DISTINCT run_time) FROM fc JOIN v_grid USING (cell_id)) AS INT) AS n_built, 0 AS n_again FROM fc JOIN v_grid USING (cell_id)""")
def incremental_cycles(spark, sf_dir):
    path, rows = fresh_path(spark, "cycles"), forecast(spark, sf_dir)
    cycles = rows.select("origin", "run_time").distinct()

    def build(wanted):
        return rows.join(wanted, ["origin", "run_time"], "left_semi").select("origin", "run_time", "grid_id", "lead_time_hours", "tp")
    first = extend_cycles(spark, cycles.where(F.col("run_time") < F.expr("timestamp_ntz'2024-01-16 00:00:00'")), build, path)
    rest = extend_cycles(spark, cycles, build, path)
    again = extend_cycles(spark, cycles, build, path)
    entries = finished_cycles(spark, path).select("origin", "run_time", "n_rows")
    return scan_cycles(spark, path).join(entries, ["origin", "run_time"]).select(
        "run_time", "grid_id", "lead_time_hours", "tp", "n_rows", F.lit(first + rest).alias("n_built"), F.lit(again).alias("n_again"))

"""Readers, guards and fits that the other queries do not touch, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvian.functions import scalars as S
from pluvian.models import boosting as B
from pluvian.operators import guards as G
from pluvian.operators import split as P
from pluvian.plans.training import fold_scores
from pluvian.session import fresh_path
from pluvian.sources import forecasts as FS
from pluvian.sources import stations as ST
from workload.common import Registry, r
from workload.tables import STATION_CATALOGS, catalogs, training_table
from workload.views import oracle_view, table, view

REG = Registry()


# ---- A7: a JSON document per run and lead, arrays in the order of the gauges; rain restarts every six hours ----
BLOCK = 256
LEAD_VALUES = {"t2m": "20.0037e0 + 0.101313177e0 * pos", "sp": "990.0041e0 + 0.051731319e0 * pos + lead_time_hours", "u10": "0.100731731e0 * pos",
               "v10": "-0.100919137e0 * lead_time_hours", "cape": "10.063173191e0 * pos"}


@REG.add("lead_json", f"""WITH {oracle_view('v_nwp')}, {oracle_view('v_station')}, co AS (SELECT row_number() OVER (ORDER BY CAST(station_code AS BIGINT)) - 1 AS pos, CAST(station_code AS BIGINT) AS cell_id, latitude, longitude FROM v_station),
 rq AS (SELECT DISTINCT run_time, lead_time_hours FROM v_nwp), d AS (SELECT rq.run_time, rq.lead_time_hours, pos, latitude, longitude, coalesce(tp, 0.0) AS tp FROM rq CROSS JOIN co LEFT JOIN v_nwp n ON n.run_time = rq.run_time AND n.lead_time_hours = rq.lead_time_hours AND n.cell_id = co.cell_id),
 l AS (SELECT *, lag(tp) OVER w AS pt, lag(lead_time_hours) OVER w AS pl FROM d WINDOW w AS (PARTITION BY run_time, pos ORDER BY lead_time_hours))
SELECT run_time, lead_time_hours, run_time + lead_time_hours * INTERVAL 1 HOUR AS valid_time, {r('latitude', 'lat')}, {r('longitude', 'lon')}, {r('round(greatest(0.0, CASE WHEN pl > ((lead_time_hours - 1) // 6) * 6 THEN tp - pt ELSE tp END), 2)', 'tp')},
 {', '.join(r(f'round({e}, {3 if v in ("u10", "v10") else 1 if v == "cape" else 2})', v) for v, e in LEAD_VALUES.items())} FROM l""")
def lead_json(spark, sf_dir):
    from pyspark.sql import Window
    gauges = view(spark, sf_dir, "v_station").select(F.col("station_code").cast("bigint").alias("cell_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    coordinates = gauges.withColumn("pos", (F.row_number().over(Window.orderBy("cell_id")) - 1).cast("int"))  # a row per gauge
    n = coordinates.agg(F.count(F.lit(1)).cast("int").alias("n")).select("n").scalar()
    # rain by blocks of positions: a lookup goes through one block's entries, not through those of all gauges
    placed = view(spark, sf_dir, "v_nwp").join(coordinates.select("cell_id", "pos"), "cell_id", "left").withColumn(
        "block", F.floor(F.col("pos") / BLOCK).cast("int"))
    filled = placed.groupBy("run_time", "lead_time_hours", "block").agg(F.map_from_entries(F.collect_list(
        F.when(F.col("pos").isNotNull(), F.struct((F.col("pos") % BLOCK).alias("at"), "tp")))).alias("m")).select(
        "run_time", "lead_time_hours", "block", F.expr(f"transform(sequence(0, {BLOCK - 1}), i -> coalesce(try_element_at(m, i), 0.0D))").alias("part"))
    runs = filled.groupBy("run_time", "lead_time_hours").agg(F.map_from_entries(F.collect_list(
        F.when(F.col("block").isNotNull(), F.struct("block", "part")))).alias("parts"))
    shaped = runs.withColumn("n", n).withColumn("c", F.expr("slice(sequence(0, n), 1, n)"))

    def array(v, e):
        return f"transform(c, x -> {e.replace('pos', 'x')}) AS {v}"
    blocks = f"transform(sequence(0, n div {BLOCK}), b -> coalesce(try_element_at(parts, cast(b AS INT)), array_repeat(0.0D, {BLOCK})))"
    arrays = shaped.selectExpr("run_time", "lead_time_hours", f"slice(flatten({blocks}), 1, n) AS apcp",
                               *[array(v, e.replace("e0", "D")) for v, e in LEAD_VALUES.items()])
    values = F.create_map(*[x for v in ("apcp", *LEAD_VALUES) for x in (F.lit(v), F.col(v))])
    text = F.to_json(F.struct(F.date_format("run_time", "yyyy-MM-dd").alias("date"), F.date_format("run_time", "HH:mm").alias("cycle"),
                              F.col("lead_time_hours").alias("lead"), values.alias("variables")))
    documents = arrays.select(F.from_json(text, FS.LEAD_SCHEMA.simpleString()).alias("d")).select("d.*")
    rows = FS.lead_rows(documents, coordinates)
    return rows.select("run_time", "lead_time_hours", "valid_time", "lat", "lon", "tp", *LEAD_VALUES)


# ---- A8 ----
@REG.add("file_tags", """SELECT event_id, to_timestamp(floor(epoch_us(ts) / 3600000000) * 3600)::TIMESTAMP AS file_run_time, event_type AS file_origin,
 CASE event_type WHEN 'click' THEN 'ncep_gfs' WHEN 'view' THEN 'dwd_icon' END AS weather_model, CASE WHEN event_id % 2 = 0 THEN 'lightgbm' ELSE 'hurdle' END AS model, 'm' || (event_id % 3 + 1) AS ablation FROM events""")
def file_tags(spark, sf_dir):
    """Names of forecast files, and of prediction files whose weather model stands in the name, in the folder or nowhere."""
    ev = table(spark, sf_dir, "events")
    run = F.concat(F.lit("/data/x=1/"), "event_type", F.lit("/run_"), F.date_format("ts", "yyyyMMdd_HH"), F.lit("z.parquet"))
    variant = F.concat(F.when(F.col("event_id") % 2 == 0, "lightgbm").otherwise("hurdle"), F.lit("_M"), (F.col("event_id") % 3 + 1).cast("string"), F.lit(".csv"))
    path = F.when(F.col("event_type") == "click", F.concat(F.lit("/p/ncep_gfs_"), variant)).when(
        F.col("event_type") == "view", F.concat(F.lit("/p/DWD_ICON/"), variant)).otherwise(F.concat(F.lit("/p/q/"), variant))
    weather, model, ablation = FS.prediction_tags(path, ["lightgbm", "hurdle"])
    return FS.run_tags(ev.withColumn("path", run), "path").select("event_id", "file_run_time", "file_origin", weather.alias("weather_model"),
                                                                  model.alias("model"), ablation.alias("ablation"))


# ---- A14 ----
@REG.add("cross_map_records", f"""WITH {oracle_view('v_station')}, c AS ({STATION_CATALOGS}), f AS (SELECT station_code, bool_or(catalog = 'pressure') AS b, bool_or(catalog = 'humidity') AS d FROM c GROUP BY 1 HAVING bool_or(catalog = 'hourly_rain'))
SELECT f.station_code, {r('latitude', 'latitude')}, {r('longitude + 5.0e0', 'longitude')}, '' AS province_name, 'St ' || f.station_code AS station_name, b AS has_pressure, d AS has_humidity, b AND d AS has_all_three FROM f LEFT JOIN v_station s ON s.station_code = f.station_code""")
def cross_map_records(spark, sf_dir):
    master = ST.station_master(catalogs(spark, sf_dir)).withColumn("station_name", F.concat(F.lit("St "), "station_code"))
    path = fresh_path(spark, "cross_map")
    ST.write_cross_map(master, catalogs(spark, sf_dir), path)
    back = spark.read.schema("station_code string, record struct<station_name:string,latitude:double,longitude:double,province_name:string,"
                             "has_pressure:boolean,has_humidity:boolean,has_all_three:boolean>").json(f"{path}/stations")
    return back.select("station_code", "record.*")


# ---- B20: whole, evenly strided cycles of training rows; all other rows stay ----
@REG.add("row_budget", f"""WITH {oracle_view('v_forecast_obs')}, t AS (SELECT *, year(run_time) < 1998 AS is_train FROM v_forecast_obs),
 s AS (SELECT run_time, count(*) AS n, row_number() OVER (ORDER BY run_time) - 1 AS i FROM t WHERE is_train GROUP BY run_time),
 k AS (SELECT count(*) AS c, arg_min(n, run_time) AS f FROM s), q AS (SELECT c, least(c, greatest(1, CAST(ceil(500.0 / f) AS BIGINT))) AS need FROM k),
 z AS (SELECT need, greatest(1, c // need) AS stride FROM q)
SELECT l_orderkey, l_partkey, station_id, l_linenumber, run_time, is_train FROM t WHERE NOT is_train OR run_time IN (SELECT run_time FROM s, z WHERE i % stride = 0 AND i < stride * need)""")
def row_budget(spark, sf_dir):
    rows = view(spark, sf_dir, "v_forecast_obs").select("l_orderkey", "l_partkey", "station_id", "l_linenumber", "run_time")
    return P.train_row_budget(rows.withColumn("is_train", F.year("run_time") < 1998), 500)


# ---- B31: the first of several rain columns that has a value ----
@REG.add("usable_column", f"""WITH {oracle_view('v_telemetry')} SELECT event_id, station_code, variable_type, {r('TRY_CAST(raw_value AS DOUBLE)', 'rain')}, 'rain_mm' AS source FROM v_telemetry""")
def usable_column(spark, sf_dir):
    rows = view(spark, sf_dir, "v_telemetry").withColumns({"rain": F.lit(None).cast("double"), "rain_mm": F.col("raw_value").try_cast("double"), "tp": F.lit(1.0)})
    name = S.first_usable_column(rows, ["precip", "rain", "rain_mm", "tp"])
    return rows.select("event_id", "station_code", "variable_type", F.col(name).alias("rain"), F.lit(name).alias("source"))


# ---- I4 ----
@REG.add("held_out_network", """SELECT event_id, event_type AS network, (SELECT count(*) FROM events WHERE event_type IN ('click', 'error')) AS n_refused FROM events WHERE event_type NOT IN ('click', 'error')""")
def held_out_network(spark, sf_dir):
    """A table with two held-out networks is refused, also by the check before a fit; the rest of it is written."""
    rows, path = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("network")), fresh_path(spark, "training")
    held, refused = ["CLICK", "Error"], 0
    guards = G.row_guards(rows.columns, held_out=held)
    try:
        G.write_guarded(rows, path, guards)
    except G.LeakageError as e:
        refused = e.counts["held-out network"]
    G.write_guarded(rows.where(~F.lower("network").isin("click", "error")), path, guards)
    allowed = spark.read.parquet(path)
    G.assert_not_held_out(allowed, held)
    return allowed.withColumn("n_refused", F.lit(refused).cast("bigint"))


# ---- P4: a stump for each expanding fold, in closed form ----
FOLDS = ((1995, 1997, 1998), (1995, 1999, 2000))


def _fold_sql(fold: int, first: int, last: int, val: int) -> str:
    return f"""SELECT {fold} AS fold, count(*) AS n, sqrt(avg(power(greatest(0.0, raw + CASE WHEN lead <= x THEN ls / ln ELSE (s - ls) / (n0 - ln) END) - obs, 2))) AS rmse, sqrt(avg(power(raw - obs, 2))) AS raw_rmse
 FROM (SELECT lead_time AS lead, observed_rain AS obs, nwp_raw_rain AS raw FROM v_forecast_obs WHERE year(valid_time) = {val}) v,
 (SELECT x, ls, ln, s, n0 FROM (SELECT x, sum(s) OVER (ORDER BY x) AS ls, sum(n) OVER (ORDER BY x) AS ln, sum(s) OVER () AS s, sum(n) OVER () AS n0 FROM (SELECT lead_time AS x, sum(observed_rain - nwp_raw_rain) AS s, count(*) AS n
  FROM v_forecast_obs WHERE year(valid_time) BETWEEN {first} AND {last} GROUP BY lead_time)) WHERE ln >= 20 AND n0 - ln >= 20 ORDER BY power(ls - ln * s / n0, 2) * (1.0 / ln + 1.0 / (n0 - ln)) DESC, x LIMIT 1)"""


@REG.add("fold_scores", f"""WITH {oracle_view('v_forecast_obs')} SELECT CAST(fold AS INT) AS fold, 'stump' AS model_name, n, round(raw_rmse, 4) AS raw_rmse, round(rmse, 4) AS corrected_rmse
 FROM ({' UNION ALL '.join(_fold_sql(k + 1, *f) for k, f in enumerate(FOLDS))})""")
def fold_table(spark, sf_dir):
    stump = B.BoostSettings(rounds=1, leaves=2, step=1.0, patience=None, partitions=4)
    out = fold_scores(training_table(spark, sf_dir), ["lead_time_hours"], FOLDS, {"stump": B.Objective()}, settings=stump)
    return out.select("fold", "model_name", "n", F.round("raw_rmse", 4).alias("raw_rmse"), F.round("corrected_rmse", 4).alias("corrected_rmse"))

"""Domain-shaped inputs over the driver tables.

Each view reads a whole table and only renames and computes columns (plus joins and groupings): no ids, rows or texts
are left out. The text of every view is plain SQL that both engines understand, except where a dialect differs; then the
oracle side is given in `ORACLE_ONLY`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "supplier", "orders", "lineitem", "events", "embeddings", "nation")

# model variants of the verification view: (model, ablation, column)
VARIANTS = [
    ("baseline_b0", "raw_nwp", "nwp_raw_rain"),
    ("raw_ncep_gfs", "raw", "gfs_raw_pred"),
    ("lightgbm", "m1", "lightgbm_m1_pred"), ("lightgbm", "m2", "lightgbm_m2_pred"),
    ("lightgbm", "m3", "lightgbm_m3_pred"),
    ("hurdle", "m1", "hurdle_m1_pred"), ("hurdle", "m2", "hurdle_m2_pred"), ("hurdle", "m3", "hurdle_m3_pred"),
]
MODELS = ["lightgbm", "hurdle"]

VIEWS: dict[str, str] = {}

VIEWS["v_station"] = """
SELECT CAST(s_suppkey AS STRING) AS station_code, (s_nationkey % 25) + 1 AS basin_id,
       13.0e0 + CAST((s_suppkey * 37) % 100 AS DOUBLE) * 0.03e0 AS latitude,
       99.0e0 + CAST((s_suppkey * 61) % 97 AS DOUBLE) * 0.03e0 AS longitude,
       s_acctbal / 10.0e0 AS elevation_m
FROM supplier
"""

VIEWS["v_grid"] = """
SELECT c_custkey AS cell_id,
       12.5e0 + CAST((c_custkey * 7919) % 1009 AS DOUBLE) * 0.004e0 AS lat,
       98.5e0 + CAST((c_custkey * 6151) % 997 AS DOUBLE) * 0.004e0 AS lon,
       c_acctbal AS height
FROM customer
"""

VIEWS["v_forecast_obs"] = """
SELECT l_orderkey, l_partkey, l_suppkey AS station_id, l_linenumber, (l_suppkey % 25) + 1 AS basin_id,
       (l_partkey % 5) = 0 AS is_holdout,
       o_orderdate AS run_time, CAST((l_partkey % 24) + 1 AS INT) AS lead_time,
       o_orderdate + INTERVAL '1' HOUR * CAST((l_partkey % 24) + 1 AS INT) AS valid_time,
       CASE WHEN l_linenumber % 3 = 0 THEN 0.0e0 ELSE l_quantity * 0.5000731317e0 END AS observed_rain,
       greatest(0.0e0, l_quantity * 0.5000379171e0 + (l_tax - 0.04e0) * 200.0137913e0) AS nwp_raw_rain,
       greatest(0.0e0, l_quantity * 0.5000113719e0 + (l_discount - 0.05e0) * 180.0291373e0) AS gfs_raw_pred,
       greatest(0.0e0, l_quantity * 0.5000173939e0 + (l_tax - 0.04e0) * 150.0173177e0) AS lightgbm_m1_pred,
       greatest(0.0e0, l_quantity * 0.5000197351e0 + (l_tax - 0.04e0) * 160.0119731e0) AS lightgbm_m2_pred,
       greatest(0.0e0, l_quantity * 0.5000233917e0 + (l_tax - 0.04e0) * 100.0237319e0) AS lightgbm_m3_pred,
       greatest(0.0e0, l_quantity * 0.4500371713e0 + (l_discount - 0.05e0) * 110.0311937e0) AS hurdle_m1_pred,
       greatest(0.0e0, l_quantity * 0.4500397171e0 + (l_discount - 0.05e0) * 120.0133379e0) AS hurdle_m2_pred,
       greatest(0.0e0, l_quantity * 0.4500419939e0 + (l_discount - 0.05e0) * 70.0351173e0) AS hurdle_m3_pred
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

VIEWS["v_nwp"] = """
SELECT 'gfs' AS origin, o_month AS run_time, CAST((l_partkey % 24) + 1 AS INT) AS lead_time_hours,
       l_suppkey AS cell_id, sum(l_quantity) * 0.1e0 AS tp
FROM lineitem JOIN (SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS o_month FROM orders) o
  ON l_orderkey = o_orderkey
GROUP BY o_month, CAST((l_partkey % 24) + 1 AS INT), l_suppkey
"""

# every event reports at its own gauge and at the network-wide gauge, once per variable
VIEWS["v_telemetry"] = """
SELECT station_code, variable_type, event_id, ts AS reported_at,
       CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS observed_at,
       CASE WHEN variable_type = 'humidity' AND event_id % 353 = 0 THEN '-999'
            WHEN variable_type = 'humidity' AND event_id % 247 = 0 THEN ' NULL '
            WHEN variable_type = 'humidity' AND event_id % 243 = 0 THEN 'abc'
            WHEN variable_type = 'pressure' AND event_id % 1601 = 0 THEN '-9999'
            WHEN variable_type = 'hourly_rain' THEN CAST(value AS STRING)
            WHEN variable_type = 'pressure' THEN CAST(900.0e0 + value * 0.25e0 AS STRING)
            ELSE CAST(value * 0.25e0 AS STRING) END AS raw_value,
       CASE WHEN variable_type = 'humidity' AND event_id % 137 = 0 THEN ' e ' ELSE 'N' END AS raw_quality_flag
FROM (SELECT station_code, event_id, ts, value, explode(array('hourly_rain', 'pressure', 'humidity')) AS variable_type
      FROM (SELECT event_id, ts, value, explode(array('ALL', event_type)) AS station_code FROM events) a) b
"""

# gauge readings: local wall time, one gauge per supplier
VIEWS["v_obs"] = """
SELECT CAST(user_id % (SELECT count(*) FROM supplier) AS STRING) AS station_code, event_id, ts AS observed_at,
       CASE event_type WHEN 'click' THEN 'hourly_rain' WHEN 'view' THEN 'hourly_rain' WHEN 'error' THEN 'pressure'
                       WHEN 'signup' THEN 'pressure' ELSE 'humidity' END AS variable_type,
       CASE event_type WHEN 'click' THEN value * 0.1e0 WHEN 'view' THEN value * 0.1e0
                       WHEN 'error' THEN 990.0e0 + value * 0.1e0 WHEN 'signup' THEN 990.0e0 + value * 0.1e0
                       ELSE value * 0.2e0 END AS value
FROM events
"""

# a 2 km mesh with gauges inside it, all of which report every variable
VIEWS["v_mesh"] = """
SELECT c_custkey AS cell_id, 13.0e0 + CAST(c_custkey % 40 AS DOUBLE) * 0.02e0 AS lat,
       98.0e0 + CAST(floor(c_custkey / 40) AS DOUBLE) * 0.02e0 AS lon
FROM customer
"""

VIEWS["v_gauge"] = """
SELECT CAST(s_suppkey AS STRING) AS station_code, 13.0e0 + CAST((s_suppkey * 37) % 101 AS DOUBLE) * 0.007931e0 AS latitude,
       98.0e0 + CAST((s_suppkey * 61) % 97 AS DOUBLE) / 97.0e0 * 0.000503e0 * CAST((SELECT count(*) FROM customer) AS DOUBLE) AS longitude,
       s_acctbal / 10.0e0 AS elevation_m
FROM supplier
"""

VIEWS["v_readings"] = """
SELECT CAST(user_id % (SELECT count(*) FROM supplier) AS STRING) AS station_code, event_id, ts AS observed_at, variable_type,
       CASE variable_type WHEN 'hourly_rain' THEN value * 0.100731e0 WHEN 'pressure' THEN 990.0e0 + value * 0.100379e0 ELSE value * 0.200171e0 END AS value
FROM (SELECT event_id, user_id, ts, value, explode(array('hourly_rain', 'pressure', 'humidity')) AS variable_type FROM events) e
"""

VIEWS["v_pixels"] = """
SELECT event_id, ts AS scan_time,
       5.0e0 + CAST((event_id * 37) % 1601 AS DOUBLE) * 0.01e0 AS lat,
       96.5e0 + CAST((event_id * 61) % 953 AS DOUBLE) * 0.01e0 AS lon,
       300.0e0 - value * 0.2500731e0 AS val
FROM events
"""

VIEWS["v_dem"] = """
SELECT 13 AS tile_lat, 100 AS tile_lon, CAST(vec_id AS INT) AS row, CAST(pos AS INT) AS col,
       CASE WHEN (vec_id * 64 + pos) % 211 = 0 THEN -9999.0e0 ELSE CAST(v AS DOUBLE) * 500.0e0 + vec_id * 3.0e0 END AS elevation
FROM (SELECT vec_id, posexplode(embedding) AS (pos, v) FROM embeddings) e
"""

ORACLE_ONLY = {
    "v_telemetry": VIEWS["v_telemetry"]
    .replace("explode(array('hourly_rain', 'pressure', 'humidity'))", "unnest(['hourly_rain', 'pressure', 'humidity'])")
    .replace("explode(array('ALL', event_type))", "unnest(['ALL', event_type])"),
    "v_readings": VIEWS["v_readings"].replace("explode(array('hourly_rain', 'pressure', 'humidity'))", "unnest(['hourly_rain', 'pressure', 'humidity'])"),
    "v_dem": VIEWS["v_dem"].replace(
        "SELECT vec_id, posexplode(embedding) AS (pos, v) FROM embeddings",
        "SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; the tables it names are bound as parameters, so no global temp view is left behind."""
    import re
    text = VIEWS[name]
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b|FROM {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def oracle_view(name: str) -> str:
    """The same view as a CTE for the oracle engine."""
    text = ORACLE_ONLY.get(name, VIEWS[name])
    return f"{name} AS ({text.strip().replace('TIMESTAMP_NTZ', 'TIMESTAMP')})"

"""Projection, radius and nearest joins, ground features, pixels, terrain and graph queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvian.functions import constants as K
from pluvian.functions import geo
from pluvian.functions import scalars as S
from pluvian.operators import graph as N
from pluvian.operators import ground as GR
from pluvian.operators import raster as RS
from pluvian.operators import spatial as SP
from workload.common import Registry, r
from workload.views import oracle_view, table, view

REG = Registry()


def utm_sql(lat: str, lon: str) -> tuple[str, str]:
    """Oracle text of the forward projection."""
    s = geo.krueger_series()
    t = f"sinh(atanh(sin(radians({lat}))) - {s['ecc']!r}*atanh({s['ecc']!r}*sin(radians({lat}))))"
    xi = f"atan2({t}, cos(radians({lon} - 99.0)))"
    eta = f"atanh(sin(radians({lon} - 99.0))/sqrt(1 + {t}*{t}))"
    k = geo.SCALE * s["radius"]
    x = " + ".join([eta] + [f"{a!r}*cos({2 * j}*{xi})*sinh({2 * j}*{eta})" for j, a in enumerate(s["alpha"], 1)])
    y = " + ".join([xi] + [f"{a!r}*sin({2 * j}*{xi})*cosh({2 * j}*{eta})" for j, a in enumerate(s["alpha"], 1)])
    return f"(500000.0 + {k!r}*({x}))", f"({k!r}*({y}))"


GX, GY = utm_sql("lat", "lon")
SX, SY = utm_sql("latitude", "longitude")
GEO = f"""WITH {oracle_view('v_grid')}, {oracle_view('v_station')},
 g AS MATERIALIZED (SELECT cell_id, lat, lon, {GX}/1000.0 AS gx, {GY}/1000.0 AS gy FROM v_grid),
 s AS MATERIALIZED (SELECT *, {SX}/1000.0 AS sx, {SY}/1000.0 AS sy FROM v_station)"""
PAIRS = f"""{GEO}, p0 AS (SELECT cell_id, station_code, elevation_m, sx-gx AS dx, sy-gy AS dy, sqrt((sx-gx)*(sx-gx)+(sy-gy)*(sy-gy)) AS dist FROM g, s),
 p AS MATERIALIZED (SELECT * FROM p0 WHERE dist BETWEEN 2.0 AND 50.0)"""
# one reading per station, with gaps, as of two runs; factors with many digits keep averages away from rounding ties
OBS = """ob AS (SELECT station_code, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '12' HOUR * k AS run_time,
  CASE WHEN (CAST(station_code AS INT) + k) % 7 <> 0 THEN elevation_m * 0.0100731e0 + k END AS rain,
  CASE WHEN (CAST(station_code AS INT) + k) % 5 <> 0 THEN 1010.0e0 - elevation_m * 0.0200317e0 + k END AS pressure,
  CASE WHEN (CAST(station_code AS INT) + k) % 3 <> 0 THEN 50.0e0 + elevation_m * 0.0300719e0 END AS humidity FROM v_station, (VALUES (0), (1)) AS t(k))"""


def grid(spark, sf_dir):
    return view(spark, sf_dir, "v_grid").withColumnRenamed("cell_id", "grid_id")


def observations(spark, sf_dir):
    st = view(spark, sf_dir, "v_station").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    code = F.col("station_code").cast("int") + F.col("k")
    return st.select(
        "station_code", S.shift(F.expr("timestamp_ntz'2024-01-01 00:00:00'"), hours=F.col("k") * 12).alias("run_time"),
        F.when(code % 7 != 0, F.col("elevation_m") * 0.0100731 + F.col("k")).alias("rain"),
        F.when(code % 5 != 0, F.lit(1010.0) - F.col("elevation_m") * 0.0200317 + F.col("k")).alias("pressure"),
        F.when(code % 3 != 0, F.lit(50.0) + F.col("elevation_m") * 0.0300719).alias("humidity"))


# ---- G1, B10, B11, C15, C16 ----
@REG.add("utm_forward", f"""{GEO} SELECT cell_id, round(gx*1000.0, 4) + 0.0 AS x_m, round(gy*1000.0, 4) + 0.0 AS y_m FROM g""")
def utm_forward(spark, sf_dir):
    x, y = geo.utm_forward("lat", "lon")
    return view(spark, sf_dir, "v_grid").select("cell_id", F.round(x, 4).alias("x_m"), F.round(y, 4).alias("y_m"))


@REG.add("utm_round_trip", f"WITH {oracle_view('v_grid')} SELECT cell_id, {r('lat', 'lat')}, {r('lon', 'lon')} FROM v_grid")
def utm_round_trip(spark, sf_dir):
    x, y = geo.utm_forward("lat", "lon")
    lat, lon = geo.utm_inverse("x", "y")
    return view(spark, sf_dir, "v_grid").select("cell_id", x.alias("x"), y.alias("y")).select(
        "cell_id", lat.alias("lat"), lon.alias("lon"))


@REG.add("grid_ids", f"""WITH {oracle_view('v_grid')} SELECT cell_id, 'G_' || CAST(round_even(lat*50.0, 0) AS BIGINT) || '_' || CAST(round_even(lon*50.0, 0) AS BIGINT) AS grid_id,
 CAST(floor(lat) AS INT) AS tile_lat, CAST(floor(lon) AS INT) AS tile_lon, (lat BETWEEN 5.6 AND 20.4) AND (lon BETWEEN 97.4 AND 105.6) AND (lat >= 12.0 OR lon BETWEEN 98.2 AND 102.0) AS on_land,
 (lat BETWEEN 5.0 AND 21.5) AND (lon BETWEEN 96.5 AND 106.5) AS in_station_box, {r('2.0*7.2921159e-5*sin(radians(lat))*1000.0', 'coriolis_e3')} FROM v_grid""")
def grid_ids(spark, sf_dir):
    tlat, tlon = geo.tile_of("lat", "lon")
    return view(spark, sf_dir, "v_grid").select(
        "cell_id", S.grid_id("lat", "lon").alias("grid_id"), tlat.alias("tile_lat"), tlon.alias("tile_lon"),
        geo.in_land_mask("lat", "lon").alias("on_land"), geo.in_station_box("lat", "lon").alias("in_station_box"),
        (geo.coriolis("lat") * 1000.0).alias("coriolis_e3"))


@REG.add("uv_wind", f"SELECT event_id, {r('-value*sin(radians(user_id*7.0))', 'u10')}, {r('-value*cos(radians(user_id*7.0))', 'v10')} FROM events")
def uv_wind(spark, sf_dir):
    u, v = S.wind_uv("value", F.col("user_id") * 7.0)
    return table(spark, sf_dir, "events").select("event_id", u.alias("u10"), v.alias("v10"))


COAST = ", ".join(f"({a!r}, {b!r})" for a, b in K.COAST_VERTICES)


@REG.add("coast_distance", f"""WITH {oracle_view('v_grid')}, c AS (SELECT * FROM (VALUES {COAST}) t(clat, clon))
SELECT cell_id, {r('greatest(0.5, least(750.0, min(sqrt(power((lat-clat)*111.13, 2) + power((lon-clon)*111.13*cos(radians((lat+clat)*0.5)), 2)))))', 'dist_coast_km')}
FROM v_grid, c GROUP BY cell_id""")
def coast_distance(spark, sf_dir):
    return view(spark, sf_dir, "v_grid").select("cell_id", geo.coast_distance_km("lat", "lon").alias("dist_coast_km"))


# ---- C4, C5, D1..D4 ----
@REG.add("radius_pairs", f"{PAIRS} SELECT cell_id AS grid_id, station_code, {r('dx', 'dx')}, {r('dy', 'dy')}, {r('dist', 'dist')} FROM p")
def radius_pairs(spark, sf_dir):
    return GR.station_pairs(grid(spark, sf_dir), view(spark, sf_dir, "v_station")).select(
        "grid_id", "station_code", "dx", "dy", "dist")


@REG.add("label_station", f"""{GEO}, d AS (SELECT cell_id, station_code, sqrt((sx-gx)*(sx-gx)+(sy-gy)*(sy-gy)) AS dist FROM g, s)
SELECT cell_id AS grid_id, arg_min(station_code, struct_pack(a := dist, b := station_code)) AS station_code, {r('min(dist)', 'dist')} FROM d WHERE dist <= 5.0 GROUP BY cell_id""")
def label_station(spark, sf_dir):
    targets = SP.project_km(grid(spark, sf_dir), "lat", "lon")
    sites = SP.project_km(view(spark, sf_dir, "v_station"), "latitude", "longitude")
    return SP.nearest_within(targets, sites, "grid_id", "station_code", 5.0)


FEATS = f"""{PAIRS}, {OBS}, pj AS MATERIALIZED (SELECT p.*, ob.run_time, rain, pressure, humidity FROM p JOIN ob USING (station_code)),
 rq AS (SELECT DISTINCT cell_id, run_time FROM v_grid, ob)"""


def features(spark, sf_dir, extra_rings=False):
    obs = observations(spark, sf_dir)
    near = GR.places(grid(spark, sf_dir), view(spark, sf_dir, "v_station"))
    runs = F.explode(F.array(*[F.expr(f"timestamp_ntz'2024-01-01 {h}:00:00'") for h in ("00", "12")]))
    requests = grid(spark, sf_dir).select("grid_id", runs.alias("run_time"))
    return GR.ground_features(requests, near, obs, extra_rings=extra_rings)


def near_sql(v: str) -> str:
    return f"arg_min(struct_pack(x := {v}, d := dist, dx := dx, dy := dy), struct_pack(a := dist, b := station_code)) FILTER ({v} IS NOT NULL) AS n_{v}"


R1, R2, R4 = "dist <= 5.0", "dist > 5.0 AND dist <= 10.0", "dist > 20.0 AND dist <= 50.0"
RINGS = f"""a AS (SELECT run_time, cell_id, avg(rain) FILTER ({R1}) AS r1, max(rain) FILTER ({R1}) AS x1, avg(rain) FILTER ({R2}) AS r2, max(rain) FILTER ({R2}) AS x2,
 {', '.join(f"avg({v}) FILTER ({c}) AS {v[0]}{i}" for v in ('pressure', 'humidity') for i, c in ((1, R1), (2, R2), (4, R4)))},
 stddev_pop(pressure) FILTER ({R1}) AS ps, stddev_pop(humidity) FILTER ({R1}) AS hs, {near_sql('rain')}, {near_sql('pressure')}, {near_sql('humidity')} FROM pj GROUP BY run_time, cell_id)"""


def ring_out() -> str:
    out = [r("coalesce(r1, 0.0)", "rain_mean_2_5km"), r("coalesce(x1, 0.0)", "rain_max_2_5km"), r("coalesce(r2, 0.0)", "rain_mean_5_10km"),
           r("coalesce(x2, 0.0)", "rain_max_5_10km"), r("coalesce(ps, 0.0)", "pressure_std_2_5km"), r("coalesce(hs, 0.0)", "humidity_std_2_5km")]
    for v, fill in (("pressure", 1010.0), ("humidity", 70.0)):
        out += [r(f"coalesce({v[0]}{i}, n_{v}.x, {fill})", f"{v}_mean_{name}") for i, name in ((1, "2_5km"), (2, "5_10km"), (4, "20_50km"))]
    return ", ".join(out)


RING_COLS = ["rain_mean_2_5km", "rain_max_2_5km", "rain_mean_5_10km", "rain_max_5_10km", "pressure_std_2_5km", "humidity_std_2_5km",
             "pressure_mean_2_5km", "pressure_mean_5_10km", "pressure_mean_20_50km", "humidity_mean_2_5km", "humidity_mean_5_10km", "humidity_mean_20_50km"]


@REG.add("ring_stats", f"{FEATS}, {RINGS} SELECT rq.run_time, rq.cell_id AS grid_id, {ring_out()} FROM rq LEFT JOIN a USING (run_time, cell_id)")
def ring_stats(spark, sf_dir):
    return features(spark, sf_dir).select("run_time", "grid_id", *RING_COLS)


def near_out() -> str:
    out = []
    for v, fill in (("rain", 0.0), ("pressure", 1010.0), ("humidity", 70.0)):
        out += [r(f"coalesce(n_{v}.x, {fill})", f"nearest_{v}_val"), r(f"coalesce(n_{v}.d, 50.0)", f"nearest_{v}_dist_km"),
                r(f"coalesce(sin(atan2(n_{v}.dx, n_{v}.dy)), 0.0)", f"nearest_{v}_bearing_sin"), r(f"coalesce(cos(atan2(n_{v}.dx, n_{v}.dy)), 1.0)", f"nearest_{v}_bearing_cos")]
    return ", ".join(out)


@REG.add("nearest_station", f"""{FEATS}, {RINGS}, b AS (SELECT cell_id, arg_min(struct_pack(d := dist, dx := dx, dy := dy), struct_pack(a := dist, b := station_code)) AS n FROM p WHERE {R1} GROUP BY cell_id)
SELECT rq.run_time, rq.cell_id AS grid_id, {near_out()}, {r('coalesce(n.d, 5.0)', 'nearest_stn_dist_2_5km')}, {r('coalesce(sin(atan2(n.dx, n.dy)), 0.0)', 'nearest_stn_bearing_sin')},
 {r('coalesce(cos(atan2(n.dx, n.dy)), 1.0)', 'nearest_stn_bearing_cos')} FROM rq LEFT JOIN a USING (run_time, cell_id) LEFT JOIN b USING (cell_id)""")
def nearest_station(spark, sf_dir):
    return features(spark, sf_dir).select("run_time", "grid_id", *[
        c for c in K.GROUND_FEATURES if c.startswith("nearest_")])


def cov(a: str, b: str, v: str) -> str:
    return f"covar_pop({a}, {b}) FILTER ({v} IS NOT NULL)"


def moments(v: str) -> str:
    z = "elevation_m/1000.0"
    return (f"SELECT run_time, cell_id, count({v}) AS n, {cov('dx', 'dx', v)} AS xx, {cov('dy', 'dy', v)} AS yy, {cov('dx', 'dy', v)} AS xy, {cov('dx', v, v)} AS xv, {cov('dy', v, v)} AS yv, "
            f"{cov(z, z, v)} AS zz, {cov('dx', z, v)} AS xz, {cov('dy', z, v)} AS yz, {cov(z, v, v)} AS zv FROM pj GROUP BY run_time, cell_id")


G2 = "CASE WHEN xx*yy-xy*xy <= 1e-9*(xx+yy)*(xx+yy) THEN coalesce(sqrt(xv*xv+yv*yv)/nullif(xx+yy, 0), 0.0) ELSE sqrt(power((xv*yy-yv*xy)/(xx*yy-xy*xy), 2)+power((yv*xx-xv*xy)/(xx*yy-xy*xy), 2)) END"
D3 = "(xx*(yy*zz-yz*yz)-xy*(xy*zz-yz*xz)+xz*(xy*yz-yy*xz))"
A3 = f"((xv*(yy*zz-yz*yz)-xy*(yv*zz-yz*zv)+xz*(yv*yz-yy*zv))/{D3})"
B3 = f"((xx*(yv*zz-yz*zv)-xv*(xy*zz-yz*xz)+xz*(xy*zv-yv*xz))/{D3})"
G3 = f"CASE WHEN sqrt(zz)*1000.0 > 15.0 AND n >= 4 AND {D3} > 1e-9*(xx+yy)*(xx+yy)*zz THEN sqrt({A3}*{A3}+{B3}*{B3}) ELSE {G2} END"


@REG.add("plane_gradient", f"""{FEATS}, mp AS ({moments('pressure')}), mh AS ({moments('humidity')}),
 gp AS (SELECT run_time, cell_id, CASE WHEN n >= 3 THEN greatest(0.0, least(50.0, 100.0*({G3}))) ELSE 0.0 END AS v FROM mp),
 gh AS (SELECT run_time, cell_id, CASE WHEN n >= 3 THEN greatest(0.0, least(50.0, 100.0*({G2}))) ELSE 0.0 END AS v FROM mh)
SELECT rq.run_time, rq.cell_id AS grid_id, round(coalesce(gp.v, 0.0), 4) + 0.0 AS pressure_gradient_mag, round(coalesce(gh.v, 0.0), 4) + 0.0 AS humidity_gradient_mag
FROM rq LEFT JOIN gp USING (run_time, cell_id) LEFT JOIN gh USING (run_time, cell_id)""")
def plane_gradient(spark, sf_dir):
    return features(spark, sf_dir).select("run_time", "grid_id", *[
        F.round(c, 4).alias(c) for c in ("pressure_gradient_mag", "humidity_gradient_mag")])


# ---- C2, C3 ----
@REG.add("nearest_site", f"""WITH {oracle_view('v_grid')}, {oracle_view('v_station')}, d AS (SELECT cell_id, station_code, power(lat-latitude, 2)+power(lon-longitude, 2) AS d FROM v_grid, v_station)
SELECT cell_id, {r('sqrt(min(d))', 'dist')} FROM d GROUP BY cell_id""")
def nearest_site(spark, sf_dir):
    sites = view(spark, sf_dir, "v_station").select("station_code", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return SP.nearest_site(view(spark, sf_dir, "v_grid"), sites, "cell_id", "station_code").select("cell_id", "dist")


# half of the forecast cells carry a name the terrain grid does not know
TERRAIN = f"""WITH {oracle_view('v_grid')}, {oracle_view('v_station')}, t AS (SELECT 'G_' || CAST(round_even(latitude*50.0, 0) AS BIGINT) || '_' || CAST(round_even(longitude*50.0, 0) AS BIGINT) AS gid, station_code, latitude, longitude, elevation_m FROM v_station),
 u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY station_code) AS k FROM t) WHERE k = 1)"""


@REG.add("terrain_attach", f"""{TERRAIN}, f AS (SELECT cell_id, 'G_' || CAST(round_even(lat*50.0, 0) AS BIGINT) || '_' || CAST(round_even(lon*50.0, 0) AS BIGINT) AS gid, lat, lon FROM v_grid),
 c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY lat, lon) AS k FROM f) WHERE k = 1),
 n AS (SELECT c.gid, min(power(c.lat-u.latitude, 2)+power(c.lon-u.longitude, 2)) AS best FROM c, u GROUP BY c.gid)
SELECT f.cell_id, f.gid AS grid_id, d.elevation_m IS NOT NULL AS direct, {r('CASE WHEN d.elevation_m IS NULL THEN sqrt(n.best) ELSE 0.0 END', 'dist')} FROM f JOIN n ON f.gid = n.gid LEFT JOIN u d ON d.gid = f.gid""")
def terrain_attach(spark, sf_dir):
    terrain = view(spark, sf_dir, "v_station").select(
        S.grid_id("latitude", "longitude").alias("grid_id"), F.col("station_code").alias("legacy_grid_id"),
        F.col("latitude").alias("centroid_lat"), F.col("longitude").alias("centroid_lon"), "elevation_m",
        F.col("latitude").alias("slope_deg"), F.col("longitude").alias("aspect_sin"))
    cells = view(spark, sf_dir, "v_grid").select("cell_id", S.grid_id("lat", "lon").alias("grid_id"), "lat", "lon")
    out = cells.join(SP.cell_terrain(SP.cells_of(cells), terrain), "grid_id", "left")
    # slope and aspect carry the matched site's place, so the distance to it can be told from the output
    from pluvian.functions.skew import first_row
    shared = first_row(cells.select("grid_id", F.col("lat").alias("_la"), F.col("lon").alias("_lo")), ["grid_id"], [F.col("_la"), F.col("_lo")])
    known = terrain.select("grid_id").distinct().withColumn("direct", F.lit(True))
    gap = F.hypot(F.col("slope_deg") - F.col("_la"), F.col("aspect_sin") - F.col("_lo"))
    joined = out.join(shared, "grid_id").join(known, "grid_id", "left").withColumn("direct", F.coalesce("direct", F.lit(False)))
    return joined.select("cell_id", "grid_id", "direct", F.when(~F.col("direct"), gap).otherwise(F.lit(0.0)).alias("dist"))


# ---- D5 ----
PIX = f"""WITH {oracle_view('v_pixels')}, px AS (SELECT date_trunc('day', scan_time) AS timestamp, CAST(greatest(0, least(30, round_even((lat-5.5)/0.5, 0))) AS INT) AS i,
  CAST(greatest(0, least(17, round_even((lon-97.0)/0.5, 0))) AS INT) AS j, val FROM v_pixels WHERE lat BETWEEN 5.0 AND 21.0 AND lon BETWEEN 96.5 AND 106.0),
 agg AS (SELECT timestamp, i, j, avg(val) AS m, min(val) AS lo, max(val) AS hi, stddev_samp(val) AS sd FROM px GROUP BY ALL),
 full_ AS (SELECT t.timestamp, a.i, b.j FROM (SELECT DISTINCT timestamp FROM px) t, generate_series(0, 30) a(i), generate_series(0, 17) b(j))"""


@REG.add("cell_stats", f"""{PIX} SELECT timestamp, 'G_' || CAST(round_even((5.5+0.5*i)*50, 0) AS BIGINT) || '_' || CAST(round_even((97.0+0.5*j)*50, 0) AS BIGINT) AS grid_id, {r('5.5+0.5*i', 'lat')}, {r('97.0+0.5*j', 'lon')},
 {r('round(m, 2)', 'bt_mean')}, {r('round(lo, 2)', 'bt_min')}, {r('round(hi, 2)', 'bt_max')}, {r('round(coalesce(sd, 0.0), 2)', 'bt_std')} FROM full_ LEFT JOIN agg USING (timestamp, i, j)""")
def cell_stats(spark, sf_dir):
    pixels = view(spark, sf_dir, "v_pixels").withColumn("timestamp", S.floor_to("scan_time", 86400))
    return RS.satellite_cells(pixels)


# ---- D6 ----
HALF = 4
DEM = f"""WITH {oracle_view('v_dem')}, c AS (SELECT CAST(vec_id AS INT) AS r0, CAST(4 + 8*(vec_id % 8) AS INT) AS c0, 'P_' || vec_id AS gid FROM embeddings),
 pt AS (SELECT gid, row, col, elevation AS z FROM v_dem, c WHERE abs(row-r0) <= {HALF} AND abs(col-c0) <= {HALF}),
 d AS (SELECT *, lag(z) OVER wx AS zl, lead(z) OVER wx AS zr, lag(z) OVER wy AS zu, lead(z) OVER wy AS zd FROM pt WINDOW wx AS (PARTITION BY gid, row ORDER BY col), wy AS (PARTITION BY gid, col ORDER BY row)),
 e AS (SELECT gid, z, CASE WHEN zl IS NULL THEN zr-z WHEN zr IS NULL THEN z-zl ELSE (zr-zl)/2 END/30.0 AS gx, CASE WHEN zu IS NULL THEN zd-z WHEN zd IS NULL THEN z-zu ELSE (zd-zu)/2 END/30.0 AS gr FROM d)"""


@REG.add("terrain_slope", f"""{DEM}
SELECT gid AS grid_id, {r('avg(z)', 'elevation_m')}, {r('stddev_pop(z)', 'elevation_std')}, {r('avg(degrees(atan(sqrt(gx*gx+gr*gr))))', 'slope_deg')},
 {r('avg(sin(atan2(-gx, gr)))', 'aspect_sin')}, {r('avg(cos(atan2(-gx, gr)))', 'aspect_cos')} FROM e WHERE z > -100.0 AND z < 9000.0 GROUP BY gid""")
def terrain_slope(spark, sf_dir):
    cells = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("P_"), "vec_id").alias("grid_id"), F.lit(13).alias("tile_lat"), F.lit(100).alias("tile_lon"),
        F.col("vec_id").cast("int").alias("row"), (F.lit(4) + F.col("vec_id") % 8 * 8).cast("int").alias("col"))
    return RS.terrain_patches(view(spark, sf_dir, "v_dem"), cells, half=HALF)


# ---- C17, D29 ----
SNAP = """nd AS (SELECT event_id, date_trunc('hour', ts) AS t, 13.0e0 + CAST(user_id % 23 AS DOUBLE)*0.11e0 AS lat, 100.0e0 + CAST(user_id % 17 AS DOUBLE)*0.13e0 AS lon, value FROM events)"""


def nodes(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", S.floor_to("ts", 3600).alias("t"), (F.lit(13.0) + (F.col("user_id") % 23).cast("double") * 0.11).alias("lat"),
        (F.lit(100.0) + (F.col("user_id") % 17).cast("double") * 0.13).alias("lon"), "value")


DIST = "sqrt(power((a.lat-b.lat)*111.0, 2)+power((a.lon-b.lon)*105.0, 2))"


def hop(src: str, out: str) -> str:
    return f"""w_{out} AS (SELECT a.t, a.event_id, CASE WHEN count(*) = 1 AND any_value(a.sz) = 1 THEN max(b.x) ELSE sum(exp(-{DIST}/25.0)*b.x)/(sum(exp(-{DIST}/25.0))+1e-6) END AS m
  FROM {src} a JOIN {src} b ON a.t = b.t AND {DIST} <= 50.0 GROUP BY a.t, a.event_id), {out} AS (SELECT n.* REPLACE (n.x + w.m AS x) FROM {src} n JOIN w_{out} w USING (event_id))"""


@REG.add("neighbour_smooth", f"""WITH {SNAP}, h0 AS (SELECT *, value AS x, count(*) OVER (PARTITION BY t) AS sz FROM nd), {hop('h0', 'h1')}, {hop('h1', 'h2')}
SELECT event_id, round(x, 4) + 0.0 AS value_nb FROM h2""")
def neighbour_smooth(spark, sf_dir):
    return N.smooth(nodes(spark, sf_dir), "t", ["value"]).select("event_id", F.round("value_nb", 4).alias("value_nb"))


@REG.add("neighbour_edges", f"""WITH {SNAP}, pl AS (SELECT t, lat, lon, count(*) AS n FROM nd GROUP BY ALL), sz AS (SELECT t, sum(n) AS s FROM pl GROUP BY t),
 e AS (SELECT a.t, a.lat AS la, a.lon AS lo, b.lat AS lb, b.lon AS lob, a.n AS n_src, b.n AS n_dst, exp(-{DIST}/25.0) AS w FROM pl a JOIN pl b ON a.t = b.t AND {DIST} <= 50.0)
SELECT e.t, round(la, 4) AS src_lat, round(lo, 4) AS src_lon, round(lb, 4) AS dst_lat, round(lob, 4) AS dst_lon, n_src, n_dst,
 {r('CASE WHEN s = 1 THEN 1.0 ELSE w/(sum(w*n_dst) OVER (PARTITION BY e.t, la, lo) + 1e-6) END', 'weight')} FROM e JOIN sz USING (t)""")
def neighbour_edges(spark, sf_dir):
    e = N.neighbour_edges(nodes(spark, sf_dir), "t")
    return e.select("t", *[F.round(F.col(f"{a}.{b}"), 4).alias(f"{a}_{b}") for a in ("src", "dst") for b in ("lat", "lon")],
                    "n_src", "n_dst", "weight")


# ---- P1 ----
@REG.add("inverse_distance", f"""{GEO}, pr AS (SELECT cell_id, elevation_m AS v, 1.0/power(greatest(sqrt((sx-gx)*(sx-gx)+(sy-gy)*(sy-gy)), 0.001), 2) AS w, sqrt((sx-gx)*(sx-gx)+(sy-gy)*(sy-gy)) AS d FROM g, s)
SELECT cell_id AS grid_id, {r('sum(w*v)/sum(w)', 'elevation_m')}, count(*) AS n_sites FROM pr WHERE d <= 5.0 GROUP BY cell_id""")
def inverse_distance(spark, sf_dir):
    targets = SP.project_km(grid(spark, sf_dir), "lat", "lon")
    sites = SP.project_km(view(spark, sf_dir, "v_station"), "latitude", "longitude")
    return SP.inverse_distance(targets, sites, "grid_id", "station_code", ["elevation_m"])


# ---- P5 ----
CELLS = f"""{PIX}, {oracle_view('v_station')}, cl AS (SELECT timestamp, i, j, 5.5+0.5*i AS clat, 97.0+0.5*j AS clon, round(m, 2) AS v FROM full_ LEFT JOIN agg USING (timestamp, i, j))"""


def cells_and_gauges(spark, sf_dir):
    pixels = view(spark, sf_dir, "v_pixels").withColumn("timestamp", S.floor_to("scan_time", 86400))
    gauges = view(spark, sf_dir, "v_station").select("station_code", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return RS.satellite_cells(pixels), gauges


@REG.add("gauge_bilinear", f"""{CELLS}, w AS (SELECT station_code, timestamp, v, (1 - abs(latitude - clat)/0.5)*(1 - abs(longitude - clon)/0.5) AS w FROM v_station, cl
  WHERE v IS NOT NULL AND abs(latitude - clat) < 0.5 - 1e-9 AND abs(longitude - clon) < 0.5 - 1e-9)
SELECT station_code, timestamp, {r('sum(w*v)/sum(w)', 'bt_mean')}, count(*) AS n_corners FROM w GROUP BY ALL""")
def gauge_bilinear(spark, sf_dir):
    cells, gauges = cells_and_gauges(spark, sf_dir)
    return SP.grid_to_gauge_bilinear(cells, gauges, "bt_mean", 0.5, "timestamp")


@REG.add("gauge_nearest", f"""{CELLS}, d AS (SELECT station_code, timestamp, v, 'G_' || CAST(round_even(clat*50, 0) AS BIGINT) || '_' || CAST(round_even(clon*50, 0) AS BIGINT) AS gid, power(latitude-clat, 2)+power(longitude-clon, 2) AS d FROM v_station, cl)
SELECT station_code, timestamp, arg_min(gid, struct_pack(a := d, b := gid)) AS grid_id FROM d GROUP BY ALL""")
def gauge_nearest(spark, sf_dir):
    cells, gauges = cells_and_gauges(spark, sf_dir)
    return SP.grid_to_gauge_nearest(cells, gauges, "bt_mean", "timestamp").select("station_code", "timestamp", "grid_id")


# ---- P3 ----
@REG.add("middle_ring", f"""{FEATS}, {RINGS}, m AS (SELECT run_time, cell_id, avg(pressure) FILTER (dist > 10.0 AND dist <= 20.0) AS p3, avg(humidity) FILTER (dist > 10.0 AND dist <= 20.0) AS h3 FROM pj GROUP BY run_time, cell_id)
SELECT rq.run_time, rq.cell_id AS grid_id, {r('coalesce(p3, n_pressure.x)', 'pressure_mean_10_20km')}, {r('coalesce(h3, n_humidity.x)', 'humidity_mean_10_20km')}
FROM rq LEFT JOIN a USING (run_time, cell_id) LEFT JOIN m USING (run_time, cell_id)""")
def middle_ring(spark, sf_dir):
    return features(spark, sf_dir, True).select("run_time", "grid_id", "pressure_mean_10_20km", "humidity_mean_10_20km")

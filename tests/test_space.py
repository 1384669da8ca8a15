import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pluvian.functions import geo
from pluvian.operators import graph as N
from pluvian.operators import ground as GR
from pluvian.operators import raster as RS
from pluvian.operators import spatial as SP

LAT0, LON0 = 13.75, 100.50


def place(spark, north_km, east_km):
    """Coordinates of a point given by projected offsets from the target."""
    one = spark.range(1)
    x, y = geo.utm_forward(F.lit(LAT0), F.lit(LON0))
    lat, lon = geo.utm_inverse(x + F.lit(east_km * 1000.0), y + F.lit(north_km * 1000.0))
    row = one.select(lat.alias("a"), lon.alias("b")).first()
    return row["a"], row["b"]


def features(spark, stations):
    """stations: (code, north km, east km, rain, pressure, humidity)."""
    st = spark.createDataFrame([(c, *place(spark, n, e)) for c, n, e, *_ in stations], "station_code string, latitude double, longitude double")
    obs = spark.createDataFrame([(1, c, *map(lambda v: None if v is None else float(v), (r, p, h))) for c, _, _, r, p, h in stations],
                                "run_time int, station_code string, rain double, pressure double, humidity double")
    grid = spark.createDataFrame([("g", LAT0, LON0)], "grid_id string, lat double, lon double")
    pairs = GR.station_pairs(grid, st)
    return GR.ground_features(grid.select(F.lit(1).alias("run_time"), "grid_id"), pairs, obs).first()


def fit(df, value, with_height):
    sums = df.agg(*GR.gradient_sums(value, with_height))
    return GR.central_moments(sums, value, with_height).select(GR.gradient_magnitude(value, with_height).alias("g")).first()["g"]


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(LAT0, LON0), (5.6, 97.4), (20.4, 105.6), (18.78, 98.98)], "lat double, lon double")
    x, y = geo.utm_forward("lat", "lon")
    lat, lon = geo.utm_inverse("x", "y")
    for r in df.withColumns({"x": x, "y": y}).withColumns({"la": lat, "lo": lon}).collect():
        assert abs(r["la"] - r["lat"]) < 1e-8 and abs(r["lo"] - r["lon"]) < 1e-8
    first = df.select(x.alias("x"), y.alias("y")).first()
    assert (round(first["x"], 3), round(first["y"], 3)) == (662176.290, 1520582.494)


def test_gauges_nearer_than_two_km_never_count(spark):
    r = features(spark, [("near", 1.0, 0.0, 99.9, 900.0, 10.0), ("ok", 0.0, 3.5, 12.5, 1008.0, 80.0)])
    assert r["rain_max_2_5km"] == 12.5 and r["pressure_mean_2_5km"] == 1008.0
    assert r["nearest_stn_dist_2_5km"] == pytest.approx(3.5, abs=1e-6)
    assert r["nearest_stn_bearing_sin"] ** 2 + r["nearest_stn_bearing_cos"] ** 2 == pytest.approx(1.0)


def test_nearest_per_variable_and_backfill(spark):
    r = features(spark, [("a", 3.0, 0.0, 15.0, None, None), ("b", 0.0, 7.0, None, 1006.5, None), ("c", -12.0, 0.0, None, None, 88.0)])
    assert (r["nearest_rain_val"], r["nearest_pressure_val"], r["nearest_humidity_val"]) == (15.0, 1006.5, 88.0)
    for v, (s, c) in {"rain": (0, 1), "pressure": (1, 0), "humidity": (0, -1)}.items():
        assert r[f"nearest_{v}_bearing_sin"] == pytest.approx(s, abs=1e-6) and r[f"nearest_{v}_bearing_cos"] == pytest.approx(c, abs=1e-6)
    assert r["pressure_mean_2_5km"] == 1006.5 and r["humidity_mean_20_50km"] == 88.0


def test_gradient_plane(spark):
    r = features(spark, [("n", 10.0, 0.0, 0, 1005.0, 60.0), ("s", -10.0, 0.0, 0, 1010.0, 60.0), ("e", 0.0, 10.0, 0, 1007.0, 60.0), ("w", 0.0, -10.0, 0, 1008.0, 60.0)])
    assert r["pressure_gradient_mag"] == pytest.approx(math.sqrt(0.25 ** 2 + 0.05 ** 2) * 100, abs=1e-4)
    assert r["humidity_gradient_mag"] == pytest.approx(0.0, abs=1e-9)


def test_gradient_against_least_squares_with_heights(spark):
    rng = np.random.default_rng(5)
    for trial in range(3):
        n = 9
        dx, dy, z = rng.uniform(-40, 40, n), rng.uniform(-40, 40, n), rng.uniform(0, 900, n)
        v = 1010 + 0.03 * dx - 0.05 * dy - 0.1 * z + rng.normal(0, .2, n)
        pdf = pd.DataFrame({"dx": dx, "dy": dy, "elevation_m": z, "pressure": v})
        got = fit(spark.createDataFrame(pdf), "pressure", True)
        c, *_ = np.linalg.lstsq(np.column_stack([dx, dy, z / 1000, np.ones(n)]), v, rcond=None)
        assert got == pytest.approx(min(50.0, math.hypot(c[0], c[1]) * 100), rel=1e-6)


def test_collinear_and_few_stations(spark):
    line = pd.DataFrame({"dx": [0., 3., 6.], "dy": [0., 4., 8.], "v": [0., 1., 2.], "elevation_m": 0.0})
    got = fit(spark.createDataFrame(line), "v", False)
    assert got == pytest.approx(20.0)
    got = fit(spark.createDataFrame(line.head(2)), "v", False)
    assert got == 0.0


def test_empty_neighbourhood_has_defaults(spark):
    r = features(spark, [("far", 80.0, 0.0, 5.0, 1000.0, 50.0)])
    assert r["nearest_pressure_val"] == 1010.0 and r["humidity_mean_5_10km"] == 70.0 and r["nearest_stn_bearing_cos"] == 1.0


def test_radius_join_brute_force_with_a_crowded_cell(spark):
    rng = np.random.default_rng(6)
    t = pd.DataFrame({"t": range(300), "x_km": np.r_[rng.uniform(0, 5, 200), rng.uniform(-200, 200, 100)], "y_km": np.r_[rng.uniform(0, 5, 200), rng.uniform(-200, 200, 100)]})
    s = pd.DataFrame({"s": range(80), "x_km": rng.uniform(-100, 100, 80), "y_km": rng.uniform(-100, 100, 80)})
    got = {(r["t"], r["s"]) for r in SP.within_radius(spark.createDataFrame(t), spark.createDataFrame(s), "t", "s", 50.0, 2.0, hot_rows=20).collect()}
    d = np.hypot(t.x_km.values[:, None] - s.x_km.values, t.y_km.values[:, None] - s.y_km.values)
    assert got == {(i, j) for i, j in zip(*np.where((d <= 50) & (d >= 2)))}


def test_radius_pairs_are_dealt_by_their_number(spark):
    """A few kB of rows that make 40,000 pairs in one cell: no task makes most of them, copies and missing places included."""
    rng = np.random.default_rng(7)
    t = pd.DataFrame({"t": np.r_[np.arange(300), 299, 300], "x_km": rng.uniform(0, 30, 302), "y_km": rng.uniform(0, 30, 302)})
    t.loc[300, ["x_km", "y_km"]] = t.loc[299, ["x_km", "y_km"]]
    s = pd.DataFrame({"s": range(150), "x_km": rng.uniform(0, 30, 150), "y_km": rng.uniform(0, 30, 150)})
    targets = spark.createDataFrame(t).withColumn("x_km", F.when(F.col("t") < 300, F.col("x_km")))
    pairs = SP.within_radius(targets, spark.createDataFrame(s), "t", "s", 50.0, 2.0, hot_rows=40)
    rows = pairs.withColumn("task", F.spark_partition_id()).collect()
    d = np.hypot(t.x_km.values[:301, None] - s.x_km.values, t.y_km.values[:301, None] - s.y_km.values)
    want = Counter((int(t.t[i]), int(j)) for i, j in zip(*np.where((d <= 50) & (d >= 2))))
    assert Counter((r["t"], r["s"]) for r in rows) == want
    assert max(Counter(r["task"] for r in rows).values()) < 0.5 * len(rows)


def test_nearest_site_brute_force(spark):
    rng = np.random.default_rng(7)
    s = pd.DataFrame({"s": range(400), "lon": np.r_[rng.normal(100, .05, 300), rng.uniform(-180, 180, 100)], "lat": np.r_[rng.normal(14, .05, 300), rng.uniform(-90, 90, 100)]})
    s = pd.concat([s, s.head(5).assign(s=range(900, 905))])  # copies of a place: the smallest id wins
    t = pd.DataFrame({"t": range(300), "lon": np.r_[rng.normal(100, .1, 150), rng.uniform(-180, 180, 150)], "lat": np.r_[rng.normal(14, .1, 150), rng.uniform(-90, 90, 150)]})
    got = {r["t"]: (r["s"], r["dist"]) for r in SP.nearest_site(spark.createDataFrame(t), spark.createDataFrame(s), "t", "s").collect()}
    d = np.hypot(t.lon.values[:, None] - s.lon.values, t.lat.values[:, None] - s.lat.values)
    assert len(got) == 300
    for i in range(300):
        assert got[i][1] == pytest.approx(d[i].min())
        assert got[i][0] == s.s.values[d[i].argmin()]


def test_ramp_terrain(spark):
    pix = [(13, 100, r, c, 15.0 * c) for r in range(10) for c in range(10)]
    pixels = spark.createDataFrame(pix, "tile_lat int, tile_lon int, row int, col int, elevation double")
    cells = spark.createDataFrame([("g", 13, 100, 5, 5)], "grid_id string, tile_lat int, tile_lon int, row int, col int")
    r = RS.terrain_patches(pixels, cells, half=4).first()
    assert r["slope_deg"] == pytest.approx(26.565, abs=1e-3)
    assert r["aspect_sin"] == pytest.approx(-1.0) and r["aspect_cos"] == pytest.approx(0.0, abs=1e-9)  # the ramp falls to the west


def test_patch_matches_numpy_gradient(spark):
    rng = np.random.default_rng(8)
    z = rng.uniform(0, 300, (20, 20))
    z[4, 7] = -9999
    pixels = spark.createDataFrame([(0, 0, r, c, float(z[r, c])) for r in range(20) for c in range(20)], "tile_lat int, tile_lon int, row int, col int, elevation double")
    cells = spark.createDataFrame([("in", 0, 0, 8, 8), ("edge", 0, 0, 1, 18)], "grid_id string, tile_lat int, tile_lon int, row int, col int")
    got = {r["grid_id"]: r for r in RS.terrain_patches(pixels, cells, half=3).collect()}
    for name, r0, c0 in (("in", 8, 8), ("edge", 1, 18)):
        p = z[max(0, r0 - 3):r0 + 4, max(0, c0 - 3):c0 + 4]
        ok = (p > -100) & (p < 9000)
        dr, gx = np.gradient(p, 30.0, 30.0)
        assert got[name]["elevation_m"] == pytest.approx(p[ok].mean())
        assert got[name]["elevation_std"] == pytest.approx(p[ok].std())
        assert got[name]["slope_deg"] == pytest.approx(np.degrees(np.arctan(np.hypot(gx, dr)))[ok].mean())
        assert got[name]["aspect_sin"] == pytest.approx(np.sin(np.arctan2(-gx, dr))[ok].mean())


def test_coast_and_coriolis(spark):
    df = spark.createDataFrame([(13.75, 100.5), (18.78, 98.98)], "lat double, lon double")
    near, far = df.select(geo.coast_distance_km("lat", "lon").alias("d"), geo.coriolis("lat").alias("f")).collect()
    assert 0 < near["d"] < far["d"] and near["f"] < far["f"]


def test_smoothing_brute_force(spark):
    rng = np.random.default_rng(9)
    n = 120
    pdf = pd.DataFrame({"i": range(n), "t": rng.integers(0, 4, n), "lat": 13 + rng.integers(0, 6, n) * .2, "lon": 100 + rng.integers(0, 6, n) * .2, "a": rng.normal(0, 1, n)})
    pdf = pd.concat([pdf, pd.DataFrame({"i": [n], "t": [99], "lat": [13.0], "lon": [100.0], "a": [2.0]})], ignore_index=True)
    got = N.smooth(spark.createDataFrame(pdf), "t", ["a"]).toPandas().set_index("i").a_nb
    for _, g in pdf.groupby("t"):
        xy = np.column_stack([g.lat * 111.0, g.lon * 105.0])
        d = np.linalg.norm(xy[:, None] - xy[None], axis=-1)
        w = np.where(d > 50, 0, np.exp(-d / 25))
        np.fill_diagonal(w, 1.0)
        w = np.array([[1.0]]) if len(g) == 1 else w / (w.sum(1, keepdims=True) + 1e-6)
        h = g.a.values
        for _ in range(2):
            h = h + w @ h
        assert np.allclose(got.loc[g.i].values, h, atol=1e-9)


def test_mesh_is_on_land_and_numbered(spark):
    mesh = SP.regular_mesh(spark, 50_000.0)
    rows = mesh.orderBy("legacy_grid_id").toPandas()
    assert list(rows.legacy_grid_id) == [f"GRID_{i + 1:06d}" for i in range(len(rows))]
    assert rows.centroid_lat.between(5.6, 20.4).all() and (rows.utm_y.diff().dropna() >= -1e-6).all()

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pluvian.operators import ground as GR
from pluvian.operators import spatial as SP
from pluvian.operators import tiles


def scene(spark, rng, n_cells=150, n_sites=250):
    """Cells over a degree and a half, some gauges at one place, reports with gaps in two runs."""
    cells = pd.DataFrame({"grid_id": [f"g{i}" for i in range(n_cells)], "lat": 13 + rng.uniform(0, 1.5, n_cells), "lon": 100 + rng.uniform(0, 1.5, n_cells)})
    places = np.column_stack([13 + rng.uniform(-.2, 1.2, n_sites // 2), 100 + rng.uniform(-.2, 1.2, n_sites // 2)]).round(2)
    at = places[rng.integers(0, len(places), n_sites)]
    sites = pd.DataFrame({"station_code": [f"s{i}" for i in range(n_sites)], "latitude": at[:, 0], "longitude": at[:, 1], "elevation_m": rng.uniform(0, 900, n_sites)})
    obs = pd.DataFrame({"run_time": np.repeat([1, 2], n_sites), "station_code": np.tile(sites.station_code, 2)})
    for v, base in (("rain", 5), ("pressure", 1005), ("humidity", 80)):
        obs[v] = np.where(rng.uniform(size=len(obs)) < .6, base + rng.uniform(0, 5, len(obs)), np.nan)
    obs = spark.createDataFrame(obs.drop(index=[3, 300]))
    return spark.createDataFrame(cells), spark.createDataFrame(sites), obs.select("run_time", "station_code", *[
        F.nanvl(v, F.lit(None).cast("double")).alias(v) for v in ("rain", "pressure", "humidity")])


@pytest.mark.parametrize("tile_rows,box_rows", [(100_000, 24), (7, 3)])
def test_features_from_tiles_are_those_from_pairs(spark, monkeypatch, tile_rows, box_rows):
    monkeypatch.setattr(tiles, "BOX_ROWS", box_rows)
    monkeypatch.setattr(GR.tiled_sums, "__defaults__", (tile_rows,))
    cells, sites, obs = scene(spark, np.random.default_rng(tile_rows))
    requests = cells.select("grid_id", F.explode(F.array(*[F.lit(k).cast("bigint") for k in (1, 2, 3)])).alias("run_time"))
    want, got = (GR.ground_features(requests, p, obs, extra_rings=True).toPandas().sort_values(["run_time", "grid_id"]).reset_index(drop=True)
                 for p in (GR.station_pairs(cells, sites), GR.places(cells, sites)))
    assert len(got) == 450 and list(got.columns) == list(want.columns)
    assert want.nearest_rain_dist_km.lt(50).any() and want.pressure_gradient_mag.gt(0).any()
    pd.testing.assert_frame_equal(got, want, rtol=1e-7, atol=1e-9)


def test_features_make_no_table_of_pairs(spark):
    """4 cells and 5 gauges at two places: nothing on the way has a row for each of the 20 pairs."""
    cells = spark.createDataFrame([(f"g{i}", 13.0, 100.0) for i in range(4)], "grid_id string, lat double, lon double")
    sites = spark.createDataFrame([(f"s{i}", 13.05, 100.05) for i in range(5)], "station_code string, latitude double, longitude double")
    obs = sites.select(F.lit(1).alias("run_time"), "station_code", *[F.lit(float(i)).alias(v) for i, v in enumerate(GR.VALUES)])
    out = GR.ground_features(cells.select(F.lit(1).alias("run_time"), "grid_id"), GR.places(cells, sites), obs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan
    assert out.count() == 4 and out.first()["nearest_pressure_val"] == 1.0


def test_nearest_within_brute_force(spark):
    rng = np.random.default_rng(3)
    t = pd.DataFrame({"t": range(400), "k": rng.integers(0, 2, 400), "x_km": rng.uniform(-60, 60, 400), "y_km": rng.uniform(-60, 60, 400)})
    s = pd.DataFrame({"s": [f"s{i}" for i in range(300)], "k": rng.integers(0, 2, 300), "x_km": rng.uniform(-50, 50, 300).round(), "y_km": rng.uniform(-50, 50, 300).round()})
    s = pd.concat([s, s.head(40).assign(s=[f"a{i}" for i in range(40)])], ignore_index=True)  # copies of a place: the smallest id wins
    d = np.hypot(t.x_km.values[:, None] - s.x_km.values, t.y_km.values[:, None] - s.y_km.values)
    for low, equal in ((0.0, []), (2.0, ["k"])):
        ok = (d >= low) & (d <= 5.0) & ((t.k.values[:, None] == s.k.values) | (not equal))
        want = {i: min((d[i, j], s.s[j]) for j in np.flatnonzero(ok[i])) for i in range(400) if ok[i].any()}
        found = SP.nearest_within(spark.createDataFrame(t), spark.createDataFrame(s), "t", "s", 5.0, min_distance=low, equal=equal, tile_rows=20)
        assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = {r["t"]: (r["dist"], r["s"]) for r in found.collect()}
        assert got.keys() == want.keys() and 100 < len(got) < 400
        for i, (dist, code) in want.items():
            assert got[i][0] == pytest.approx(dist) and got[i][1] == code


def test_nearest_site_beyond_a_full_turn(spark):
    """A mesh wider than 360 degrees, as large copies of the tables make it."""
    t = spark.createDataFrame([(i, 98.0 + i, 13.0) for i in range(0, 500, 7)], "t int, lon double, lat double")
    s = spark.createDataFrame([(i, 98.3 + i, 13.1) for i in range(0, 500, 5)], "s int, lon double, lat double")
    for r in SP.nearest_site(t, s, "t", "s").collect():
        want = min((np.hypot(98.3 + i - 98.0 - r["t"], .1), i) for i in range(0, 500, 5))
        assert (r["dist"], r["s"]) == (pytest.approx(want[0]), want[1])
    with pytest.raises(Exception, match="not finite"):
        SP.nearest_site(t.withColumn("lon", F.lit(float("inf"))), s, "t", "s").collect()

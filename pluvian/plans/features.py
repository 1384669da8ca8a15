"""The feature table of all cycles as one plan: terrain, satellite, ground gauges, labels and target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvian.functions.geo import coast_distance_km, coriolis
from pluvian.functions.scalars import to_utc
from pluvian.operators import ground, spatial, temporal
from pluvian.operators.columns import forecast_features, labelled, with_target
from pluvian.operators.guards import no_leakage
from pluvian.session import stored, written


def station_of_cell(cells: DataFrame, stations: DataFrame, max_km: float = 5.0, cell: str = "grid_id") -> DataFrame:
    """(cell, station_code): the gauge that labels a cell."""
    targets = spatial.project_km(cells, "lat", "lon")
    sites = spatial.project_km(stations.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()),
                               "latitude", "longitude")
    return spatial.nearest_within(targets, sites, cell, "station_code", max_km).select(cell, "station_code")


def attach_labels(rows: DataFrame, telemetry: DataFrame, label_gauge: DataFrame, cell: str = "grid_id") -> DataFrame:
    """Adds `observed_rain` of the cell's gauge over the forecast step; NULL where no gauge is in reach or none reported.

    Labels are worked out per (gauge, valid time, step), which many cells and runs share, and then looked up.
    """
    placed = rows.join(label_gauge, cell, "left").join(temporal.step_hours(rows), ["origin", "run_time"], "left")
    rain = telemetry.where(F.col("variable_type") == "hourly_rain").withColumn("observed_at", to_utc("observed_at"))
    labels = temporal.interval_labels(placed.where(F.col("station_code").isNotNull()), rain).drop("n_obs")
    # cells without a gauge would all share one null key; each row gets a key of its own instead, which meets no label
    own = F.concat(F.lit("\0"), F.xxhash64(cell, "run_time", "valid_time").cast("string"))
    keyed = placed.withColumn("_gauge", F.coalesce("station_code", own))
    return (keyed.join(labels.withColumnRenamed("station_code", "_gauge"), ["_gauge", "valid_time", "step_hours"], "left")
            .select(*rows.columns, "observed_rain"))


def feature_matrix(forecast: DataFrame, grid: DataFrame, stations: DataFrame, telemetry: DataFrame,
                   satellite: DataFrame | None = None, lookback_hours: int = 3, require_label: bool = True,
                   cell: str = "grid_id", cells: DataFrame | None = None) -> DataFrame:
    """One row per forecast row with terrain, satellite and ground features, observed rain and residual target.

    forecast: analysis-ready runs (UTC). telemetry: clean long rows in local time. satellite: evolution rows with `timestamp`
    equal to the run time they serve; an `observed_at` column, if any, is checked against the run. Nothing is made up: a row
    without a label is dropped, or kept with NULL when `require_label` is off.

    Labels come first, so an unlabelled row is dropped before anything is joined to it. Geometry does not depend on the run,
    so terrain and nearest cells are worked out once per distinct cell and stored (tables of cells, not of forecast rows); gauges are
    summed tile by tile, without a table of pairs. The forecast rows themselves only meet these tables through equi keys. `cells` (cell, lat, lon), such as the master grid,
    saves the pass over the forecasts that finds the distinct cells.
    """
    cells = stored(spatial.cells_of(cells if cells is not None else forecast, cell))
    label_gauge = stored(station_of_cell(cells, stations, cell=cell))
    terrain = stored(spatial.cell_terrain(cells, grid, cell))
    near = ground.places(cells, stations, cell)
    observed = temporal.observations_at_runs(forecast.select("run_time"), telemetry, lookback_hours)
    rows = attach_labels(forecast, telemetry, label_gauge, cell)
    requests = forecast.select("run_time", cell).distinct()
    if require_label:
        # a small part of the forecast rows: written once, since the gauge sums, terrain fills and the result all read them
        rows = written(labelled(rows, "observed_rain"))
        requests = rows.select("run_time", cell).distinct()
    rows = spatial.attach_terrain(rows, terrain, cell)
    if satellite is not None:
        if "observed_at" in satellite.columns:
            satellite = satellite.withColumn("observed_at", no_leakage("timestamp", "observed_at"))
        nearest = stored(spatial.satellite_of_cell(cells, satellite, cell))
        rows = spatial.attach_satellite(rows, nearest, satellite, cell=cell)
    rows = ground.attach_ground(rows, near, observed, cell, requests=requests)
    return with_target(forecast_features(rows))


def grid_attributes(cells: DataFrame, patches: DataFrame, cell: str = "grid_id") -> DataFrame:
    """Terrain attributes of the master grid: patch statistics where there are pixels, coast distance and Coriolis always."""
    out = cells.join(patches, cell, "left").na.fill(0.0, ["elevation_m", "elevation_std", "slope_deg", "aspect_sin",
                                                          "aspect_cos"])
    return out.withColumns({"dist_coast_km": coast_distance_km("centroid_lat", "centroid_lon"),
                            "coriolis_param": coriolis("centroid_lat")})

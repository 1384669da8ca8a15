"""Space joins: within a radius, nearest of all, meshes. Every join is an equi join on cell keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvian.functions import constants as K
from pluvian.functions.geo import in_land_mask, project, utm_forward, utm_inverse
from pluvian.functions.scalars import grid_id
from pluvian.functions.skew import BLOCK_ROWS, HOT_ROWS, block_join, exact_quantiles, first_row, salted_join
from pluvian.operators.tiles import nearest_of
from pluvian.session import written


def project_km(df: DataFrame, lat: str, lon: str, x: str = "x_km", y: str = "y_km") -> DataFrame:
    return project(df, lat, lon, x, y)


def cell_of(c: str, size: float) -> Column:
    return F.floor(F.col(c) / F.lit(float(size))).cast("bigint")


def within_radius(targets: DataFrame, sites: DataFrame, target_id: str, site_id: str, radius: float,
                  min_distance: float = 0.0, site_columns: Sequence[str] = (), x: str = "x_km", y: str = "y_km",
                  equal: Sequence[str] = (), hot_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs with min_distance <= d <= radius, with offsets (site - target): (target_id, site_id, dx, dy, dist, ...).

    Cells are as wide as the radius, so a site can only lie in the 3 x 3 cells around its target. The sites (the smaller
    side) are repeated nine times, the targets not at all. Cells with more than `hot_rows` of either are cut into blocks, and tasks
    are as many as the pairs need; pairs are neither stored nor shuffled. `equal` adds equi keys.
    """
    cx, cy = cell_of(x, radius), cell_of(y, radius)
    around = F.explode(F.array(*[F.struct((cx + i).alias("_cx"), (cy + j).alias("_cy"))
                                 for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = targets.select(*equal, target_id, F.col(x).alias("_tx"), F.col(y).alias("_ty"), cx.alias("_cx"),
                          cy.alias("_cy"))
    right = sites.select(*equal, site_id, *[c for c in site_columns if c != site_id], F.col(x).alias("_sx"),
                         F.col(y).alias("_sy"), around.alias("_c"))
    right = right.select("*", "_c._cx", "_c._cy").drop("_c")
    dx, dy = F.col("_sx") - F.col("_tx"), F.col("_sy") - F.col("_ty")
    pairs = block_join(left, right, [*equal, "_cx", "_cy"], hot_rows)
    return (pairs.withColumns({"dx": dx, "dy": dy}).withColumn("dist", F.sqrt(F.col("dx") * F.col("dx")
                                                                             + F.col("dy") * F.col("dy")))
            .where((F.col("dist") <= radius) & (F.col("dist") >= min_distance))
            .select(*equal, target_id, site_id, *[c for c in site_columns if c != site_id], "dx", "dy", "dist"))


def nearest_within(targets: DataFrame, sites: DataFrame, target_id: str, site_id: str, radius: float,
                   **kw) -> DataFrame:
    """Nearest site of each target not farther than `radius` (ties: smallest id): (target_id, site_id, dist).

    Tile by tile, so that neither the pairs within the radius nor an order of them are built.
    """
    found = nearest_of(targets, sites, target_id, site_id, radius, **kw)
    return found.groupBy(target_id).agg(
        F.min_by(F.struct(site_id, "dist"), F.struct("dist", site_id)).alias("_m")).select(target_id, "_m.*")


def finite_place(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(v.isNull() | (F.abs(v) < F.lit(float("inf"))), v).otherwise(
        F.raise_error(F.lit(f"coordinate {c} is not finite")).cast("double"))


def widest(frames: Sequence[DataFrame], x: str, y: str) -> float:
    """Largest absolute coordinate, 0 if there is none."""
    size = F.greatest(F.abs(finite_place(x)), F.abs(finite_place(y)))
    return max(df.agg(F.max(size).alias("m")).first()["m"] or 0.0 for df in frames)


def nearest_site(targets: DataFrame, sites: DataFrame, target_id: str, site_id: str, x: str = "lon", y: str = "lat",
                 leaf: float = 0.02, ratio: int = 8, extent: float = 360.0, keyed: float = 1.5,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Nearest site of every target at any distance, exactly: (target_id, site_id, dist).

    Sites are summarised by a pyramid of square cells, each with the tight box of its sites. A target starts from all
    cells of the top level and goes down level by level. At each level it keeps only the cells whose nearest corner is not
    farther than the best guarantee any cell gives (each side of a tight box holds at least one site). So a target carries
    a handful of cells at any time, however far away or crowded the sites are.

    Levels are added until the top cells are at least an eighth of `extent` wide, or of the largest coordinate there is if that is
    more (coordinates that are not finite fail the job). Cells wider than `keyed`, which grows along, are few whatever the data, at
    most (2 * extent / keyed)^2, and are looked up in scalar lists inside the row. Only below that do targets meet cells by key, and
    last the sites of a leaf; keys with over `hot_rows` targets are salted there.
    """
    largest = widest([targets, sites], x, y)
    keyed, extent = keyed * max(1.0, largest / extent), max(extent, largest)
    levels = max(1, math.ceil(math.log(extent / 8.0 / leaf, ratio)))
    bottom = max((v for v in range(levels + 1) if leaf * ratio ** v <= keyed), default=0)
    px, py = finite_place(x), finite_place(y)
    points = written(first_row(sites.where(px.isNotNull() & py.isNotNull()).select(site_id, px.alias("_sx"), py.alias("_sy")),
                               ["_sx", "_sy"], [F.col(site_id)]))
    places = targets.where(px.isNotNull() & py.isNotNull()).select(px.alias("_x"), py.alias("_y")).distinct()

    def key(level: int, cx: str = "_sx", cy: str = "_sy") -> Column:
        size = F.lit(leaf * float(ratio) ** level)
        return F.struct(F.floor(F.col(cx) / size).cast("bigint").alias("i"),
                        F.floor(F.col(cy) / size).cast("bigint").alias("j"))

    # the corner of a cell's box falls into the same parent cell as its sites
    cells = [written(points.groupBy(key(0).alias("cell")).agg(
        F.min("_sx").alias("x0"), F.max("_sx").alias("x1"), F.min("_sy").alias("y0"), F.max("_sy").alias("y1")))]
    for level in range(1, levels + 1):
        cells.append(cells[-1].groupBy(key(level, "x0", "y0").alias("cell")).agg(
            F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")))

    def lower_bound(b: Column) -> Column:
        ox = F.greatest(F.lit(0.0), b["x0"] - F.col("_x"), F.col("_x") - b["x1"])
        oy = F.greatest(F.lit(0.0), b["y0"] - F.col("_y"), F.col("_y") - b["y1"])
        return ox * ox + oy * oy

    def guarantee(b: Column) -> Column:
        to_x = F.abs(F.col("_x") - b["x0"]), F.abs(F.col("_x") - b["x1"])
        to_y = F.abs(F.col("_y") - b["y0"]), F.abs(F.col("_y") - b["y1"])
        near_x, far_x, near_y, far_y = F.least(*to_x), F.greatest(*to_x), F.least(*to_y), F.greatest(*to_y)
        return F.least(near_x * near_x + far_y * far_y, far_x * far_x + near_y * near_y)

    def reachable(lower: Column, best: Column) -> Column:
        return lower <= best * F.lit(1 + 1e-12) + F.lit(1e-18)  # a hair of slack keeps rounding from dropping the winner

    def prune_list(boxes: Column) -> Column:
        best = F.array_min(F.transform(boxes, guarantee))  # bound once, not anew for every box
        return F.transform(F.array(best), lambda m: F.filter(boxes, lambda b: reachable(lower_bound(b), m)))[0]

    box = F.struct("cell", "x0", "x1", "y0", "y1")
    frontier = places.withColumn("_boxes", cells[levels].agg(F.collect_list(box).alias("l")).select("l").scalar())
    for level in range(levels, bottom, -1):
        frontier = frontier.withColumn("_boxes", prune_list(F.col("_boxes")))
        by_parent = (cells[level - 1].groupBy(key(level, "x0", "y0").alias("p")).agg(F.collect_list(box).alias("l"))
                     .agg(F.map_from_entries(F.collect_list(F.struct("p", "l"))).alias("m")).select("m").scalar())
        frontier = frontier.withColumn("_kids", by_parent).select("_x", "_y", F.flatten(F.transform(
            "_boxes", lambda b: F.element_at(F.col("_kids"), b["cell"]))).alias("_boxes"))
    # written level by level: a salted join reads it twice
    frontier = written(frontier.select("_x", "_y", F.explode(prune_list(F.col("_boxes"))).alias("b")).select(
        "_x", "_y", F.col("b.cell").alias("parent")))
    for level in range(bottom - 1, -1, -1):
        children = cells[level].select(key(level + 1, "x0", "y0").alias("parent"), box.alias("b"))
        kept = (salted_join(frontier, children, ["parent"], hot_rows=hot_rows)
                .withColumn("_best", F.min(guarantee(F.col("b"))).over(Window.partitionBy("_x", "_y"))))
        frontier = written(kept.where(reachable(lower_bound(F.col("b")), F.col("_best"))).select(
            "_x", "_y", F.col("b.cell").alias("parent")))
    leaf_points = points.withColumn("parent", key(0))
    ddx, ddy = F.col("_sx") - F.col("_x"), F.col("_sy") - F.col("_y")
    found = (salted_join(frontier, leaf_points, ["parent"], hot_rows=hot_rows).withColumn("_d", ddx * ddx + ddy * ddy)
             .groupBy("_x", "_y").agg(F.min_by(F.struct(site_id, "_d"), F.struct("_d", site_id)).alias("_m")))
    return (targets.select(target_id, px.alias("_x"), py.alias("_y")).join(found, ["_x", "_y"])
            .select(target_id, F.col(f"_m.{site_id}").alias(site_id), F.sqrt("_m._d").alias("dist")))


def cells_of(forecast: DataFrame, cell: str = "grid_id") -> DataFrame:
    """(cell, lat, lon), one row per cell."""
    return first_row(forecast.select(cell, "lat", "lon"), [cell], [F.col("lat"), F.col("lon")])


def cell_terrain(cells: DataFrame, grid: DataFrame, cell: str = "grid_id") -> DataFrame:
    """Terrain of each cell: by cell name (grid made unique), else from the nearest centroid in degrees."""
    terrain = [c for c in K.TERRAIN_FEATURES if c in grid.columns]
    unique = first_row(grid, [cell], [F.col("legacy_grid_id")] if "legacy_grid_id" in grid.columns
                       else [F.col(c) for c in terrain])
    direct = cells.join(unique.select(cell, *terrain), cell, "left")
    missing = direct.where(F.col("elevation_m").isNull()).select(cell, "lat", "lon")
    centres = unique.select(F.col(cell).alias("_site"), F.col("centroid_lat").alias("lat"),
                            F.col("centroid_lon").alias("lon"))
    near = nearest_site(missing, centres, cell, "_site").select(cell, "_site")
    filled = missing.select(cell).join(near, cell, "left").join(
        unique.select(F.col(cell).alias("_site"), *terrain), "_site", "left").drop("_site")
    return direct.where(F.col("elevation_m").isNotNull()).select(cell, *terrain).unionByName(filled)


def attach_terrain(forecast: DataFrame, terrain: DataFrame, cell: str = "grid_id",
                   cycle: Sequence[str] = ("origin", "run_time")) -> DataFrame:
    """Terrain columns of each forecast row; what is still missing takes the cycle's median (10 if it has none) or 0.

    A row without terrain counts as missing whatever the reason: no such cell, or a cell with gaps. The medians are only
    worked out if there is such a row; they come from the value histogram (`exact_quantiles`), all columns in one pass.
    """
    measured = [c for c in ("elevation_m", "elevation_std", "slope_deg", "dist_coast_km") if c in terrain.columns]
    out = forecast.join(terrain, cell, "left")
    gaps = out.where(F.greatest(*[F.col(c).isNull() for c in measured], F.lit(False)))
    if not gaps.limit(1).isEmpty():
        stacked = out.select(*cycle, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v"))
                                                         for c in measured])).alias("_s")).select(*cycle, "_s.*")
        med = exact_quantiles(stacked, [*cycle, "name"], "v", [0.5], "_med").groupBy(*cycle).agg(
            *[F.max(F.when(F.col("name") == c, F.col("_med"))).alias(f"_m_{c}") for c in measured])
        out = out.join(med, list(cycle), "left").withColumns(
            {c: F.coalesce(c, f"_m_{c}", F.lit(10.0)) for c in measured}).drop(*[f"_m_{c}" for c in measured])
    return out.na.fill(0.0, [c for c in ("aspect_sin", "aspect_cos", "coriolis_param") if c in terrain.columns])


SATELLITE_COLUMNS = ["bt_mean_t0", "bt_min_t0", "bt_std", "bt_mean_lag10m", "bt_mean_lag20m", "bt_mean_lag30m",
                     "delta_bt_30", "is_rapid_cooling", "is_deep_convective", "wv_mean"]


def satellite_of_cell(cells: DataFrame, satellite: DataFrame, cell: str = "grid_id") -> DataFrame:
    """(cell, _sat): the nearest satellite cell, worked out once per cell."""
    layout = first_row(satellite.select(F.col("grid_id").alias("_sat"), "lat", "lon"), ["lat", "lon"], [F.col("_sat")])
    return nearest_site(cells, layout, cell, "_sat", leaf=0.1).select(cell, "_sat")


def attach_satellite(forecast: DataFrame, nearest: DataFrame, satellite: DataFrame, anchor: str = "run_time",
                     time: str = "timestamp", cell: str = "grid_id") -> DataFrame:
    """Satellite features of the nearest satellite cell at the run's anchor time, defaults where there are none."""
    present = [c for c in SATELLITE_COLUMNS if c in satellite.columns]
    values = first_row(satellite.select(F.col("grid_id").alias("_sat"), F.col(time).alias(anchor), *present),
                       ["_sat", anchor], [F.col(c) for c in present])
    joined = forecast.join(nearest, cell, "left").join(values, ["_sat", anchor], "left").drop("_sat")
    return joined.na.fill({k: v for k, v in K.SATELLITE_DEFAULTS.items() if k in present})


def regular_mesh(spark, step_m: float = 2000.0) -> DataFrame:
    """Master grid of projected points on land: names, rounded centroids and projected coordinates.

    Rows come from two integer ranges over the box corners, spread over the cluster by column.
    """
    s, n, w, e = K.GRID_CORNER_BOX
    one = spark.range(1)
    x0, y0 = utm_forward(F.lit(s), F.lit(w))
    x1, y1 = utm_forward(F.lit(n), F.lit(e))
    step = F.lit(float(step_m))
    corners = one.select(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    cols = corners.withColumn("_i", F.explode(F.sequence(F.lit(0), F.ceil((F.col("x1") - F.col("x0")) / step)
                                                         .cast("int") - 1)))
    points = (cols.repartition("_i")
              .withColumn("_j", F.explode(F.sequence(F.lit(0), F.ceil((F.col("y1") - F.col("y0")) / step)
                                                     .cast("int") - 1)))
              .select("_i", "_j", (F.col("x0") + F.col("_i") * step).alias("x"),
                      (F.col("y0") + F.col("_j") * step).alias("y")))
    lat, lon = utm_inverse("x", "y")
    land = points.withColumns({"lat": lat, "lon": lon}).where(in_land_mask("lat", "lon"))
    # running number by row, then column: rows of the mesh below, plus the place inside the row
    per_row = land.groupBy("_j").agg(F.count(F.lit(1)).alias("_n"))
    base = per_row.withColumn("_base", F.coalesce(F.sum("_n").over(
        Window.orderBy("_j").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_j", "_base")
    place = F.row_number().over(Window.partitionBy("_j").orderBy("_i"))
    return (land.join(base, "_j").withColumn("_k", F.col("_base") + place)
            .select(grid_id("lat", "lon").alias("grid_id"),
                    F.concat(F.lit("GRID_"), F.lpad(F.col("_k").cast("string"), 6, "0")).alias("legacy_grid_id"),
                    F.bround("lat", 5).alias("centroid_lat"), F.bround("lon", 5).alias("centroid_lon"),
                    F.bround("x", 1).alias("utm_x"), F.bround("y", 1).alias("utm_y")))


def inverse_distance(targets: DataFrame, sites: DataFrame, target_id: str, site_id: str, values: Sequence[str],
                     radius: float = 5.0, power: float = 2.0, floor_km: float = 1e-3) -> DataFrame:
    """Inverse-distance mean of site values within a radius (P1)."""
    pairs = within_radius(targets, sites, target_id, site_id, radius, site_columns=list(values))
    w = F.lit(1.0) / F.pow(F.greatest(F.col("dist"), F.lit(floor_km)), F.lit(power))

    def mean(v: str) -> Column:
        return (F.sum(w * F.col(v)) / F.sum(F.when(F.col(v).isNotNull(), w))).alias(v)
    return pairs.groupBy(target_id).agg(*[mean(v) for v in values], F.count(F.lit(1)).alias("n_sites"))


def grid_to_gauge_nearest(predictions: DataFrame, gauges: DataFrame, value: str, time: str = "valid_time",
                          cell: str = "grid_id", gauge: str = "station_code") -> DataFrame:
    """Prediction of the nearest cell at each gauge and valid time (P5). The cell is found once per gauge."""
    layout = first_row(predictions.select(cell, "lat", "lon"), [cell], [F.col("lat"), F.col("lon")])
    near = nearest_site(gauges.select(gauge, "lat", "lon"), layout, gauge, cell).select(gauge, cell)
    return predictions.select(cell, time, value).join(near, cell).select(gauge, time, cell, value)


def grid_to_gauge_bilinear(predictions: DataFrame, gauges: DataFrame, value: str, step: float, time: str = "valid_time",
                           gauge: str = "station_code") -> DataFrame:
    """Bilinear prediction at each gauge from the four corners of a regular degree lattice (P5).

    Corners are integer lattice keys, so this is an equi join; missing corners drop out of the weights.
    """
    s = F.lit(float(step))

    def index(c: str) -> Column:
        return F.rint(F.col(c) / s).cast("bigint")

    i, j = F.floor(F.col("lat") / s).cast("bigint"), F.floor(F.col("lon") / s).cast("bigint")
    fy, fx = F.col("lat") / s - i, F.col("lon") / s - j
    corners = F.explode(F.array(*[F.struct((i + a).alias("_i"), (j + b).alias("_j"),
                                           ((fy if a else 1 - fy) * (fx if b else 1 - fx)).alias("_w"))
                                  for a in (0, 1) for b in (0, 1)]))
    wanted = gauges.select(gauge, corners.alias("_c")).select(gauge, "_c.*").where(F.col("_w") > 1e-9)
    lattice = predictions.where(F.col(value).isNotNull()).select(time, F.col(value).cast("double").alias("_v"),
                                                                 index("lat").alias("_i"), index("lon").alias("_j"))
    return lattice.join(wanted, ["_i", "_j"]).groupBy(gauge, time).agg(
        (F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias(value), F.count(F.lit(1)).alias("n_corners"))

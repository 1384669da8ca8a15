"""Pixel tables: satellite pixels to cells, terrain patches to cell attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvian.functions import constants as K
from pluvian.functions.geo import in_satellite_crop, slope_aspect
from pluvian.functions.scalars import finite, grid_id


def satellite_cells(pixels: DataFrame, band: str = "bt", time: str = "timestamp", value: str = "val",
                    complete: bool = True) -> DataFrame:
    """Decoded pixels -> half-degree cells: mean, min, max, sample deviation (0 for a single pixel), two places.

    Pixels fold map-side. With `complete`, every cell of the grid appears for every time seen; its values are NULL where no
    pixel fell in.
    """
    g = K.SATELLITE_GRID

    def index(c: str, origin: float, n: int) -> Column:
        i = F.rint((F.col(c) - F.lit(origin)) / F.lit(g["step"])).cast("int")
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), i))

    cropped = pixels.where(in_satellite_crop("lat", "lon") & finite(value)).select(
        time, index("lat", g["lat0"], g["nlat"]).alias("_i"), index("lon", g["lon0"], g["nlon"]).alias("_j"),
        F.col(value).cast("double").alias("_v"))
    folded = cropped.groupBy(time, "_i", "_j").agg(
        F.avg("_v").alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"),
        F.stddev_samp("_v").alias("std"))
    if complete:
        times = cropped.select(time).distinct()
        full = (times.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(g["nlat"] - 1))))
                .withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(g["nlon"] - 1)))))
        folded = full.join(folded, [time, "_i", "_j"], "left")
    lat = F.bround(F.lit(g["lat0"]) + F.col("_i") * F.lit(g["step"]), 2)
    lon = F.bround(F.lit(g["lon0"]) + F.col("_j") * F.lit(g["step"]), 2)
    out = folded.withColumns({"lat": lat, "lon": lon}).withColumn("grid_id", grid_id("lat", "lon"))
    if band == "wv":
        return out.select(time, "grid_id", "lat", "lon", F.bround("mean", 2).alias("wv_mean"))
    return out.select(time, "grid_id", "lat", "lon", F.bround("mean", 2).alias("bt_mean"),
                      F.bround("min", 2).alias("bt_min"), F.bround("max", 2).alias("bt_max"),
                      F.bround(F.coalesce("std", F.lit(0.0)), 2).alias("bt_std"))


def terrain_patches(pixels: DataFrame, cells: DataFrame, cell: str = "grid_id", half: int = 33,
                    res_m: float = 30.0) -> DataFrame:
    """Mean and deviation of height, mean slope and aspect over the (2*half+1)-pixel square around each cell's pixel.

    pixels: tile_lat, tile_lon, row, col, elevation. cells: tile_lat, tile_lon, row, col (centre pixel) and the cell name.
    A square touches at most four blocks of its own width, so pixels keep one block key and only the few cells are
    repeated. Neighbours come from windows over one pixel row or column of one patch (at most 2*half+1 rows). Differences
    are centred, one-sided at the patch edge. Rows go south, so the northward gradient is the negative row gradient.
    """
    width = 2 * half + 1

    def block(c: Column) -> Column:
        return F.floor(c / F.lit(width)).cast("int")

    centres = cells.select(cell, "tile_lat", "tile_lon", F.col("row").alias("_r0"), F.col("col").alias("_c0"))
    centres = (centres.withColumn("_rb", F.explode(F.sequence(block(F.col("_r0") - half), block(F.col("_r0") + half))))
               .withColumn("_cb", F.explode(F.sequence(block(F.col("_c0") - half), block(F.col("_c0") + half)))))
    keyed = pixels.select("tile_lat", "tile_lon", "row", "col", F.col("elevation").cast("double").alias("z"),
                          block(F.col("row")).alias("_rb"), block(F.col("col")).alias("_cb"))
    patch = (keyed.join(centres, ["tile_lat", "tile_lon", "_rb", "_cb"])
             .where((F.abs(F.col("row") - F.col("_r0")) <= half) & (F.abs(F.col("col") - F.col("_c0")) <= half))
             .select(cell, "row", "col", "z"))

    def derivative(along: str, across: str) -> Column:
        w = Window.partitionBy(cell, across).orderBy(along)
        before, after = F.lag("z").over(w), F.lead("z").over(w)
        return (F.when(before.isNull(), F.lead("z").over(w) - F.col("z")).when(after.isNull(), F.col("z") - before)
                .otherwise((after - before) / F.lit(2.0))) / F.lit(float(res_m))

    valid = (F.col("z") > -100.0) & (F.col("z") < 9000.0)
    graded = patch.withColumn("_gx", derivative("col", "row")).withColumn("_gr", derivative("row", "col"))
    slope, asp_sin, asp_cos = slope_aspect(F.col("_gx"), -F.col("_gr"))
    graded = graded.withColumns({"_s": slope, "_as": asp_sin, "_ac": asp_cos})
    big = ((F.max("row") - F.min("row") >= 2) & (F.max("col") - F.min("col") >= 2))

    folded = graded.groupBy(cell).agg(
        F.count_if(valid).alias("_n"), F.avg(F.when(valid, F.col("z"))).alias("elevation_m"),
        F.stddev_pop(F.when(valid, F.col("z"))).alias("elevation_std"), big.alias("_big"),
        F.avg(F.when(valid, F.col("_s"))).alias("slope_deg"), F.avg(F.when(valid, F.col("_as"))).alias("aspect_sin"),
        F.avg(F.when(valid, F.col("_ac"))).alias("aspect_cos")).where(F.col("_n") > 0)
    return folded.select(cell, "elevation_m", "elevation_std", *[
        F.when(F.col("_big"), F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in ("slope_deg", "aspect_sin", "aspect_cos")])


def centre_pixels(cells: DataFrame, keep: Sequence[str] = ("grid_id",), pixels_per_degree: int = 3600) -> DataFrame:
    """Tile and centre pixel of each cell; tiles are one degree, row 0 in the north."""
    tile_lat, tile_lon = F.floor("lat").cast("int"), F.floor("lon").cast("int")
    row = F.least(F.lit(pixels_per_degree - 1),
                  F.floor((tile_lat + 1 - F.col("lat")) * F.lit(pixels_per_degree))).cast("int")
    column = F.least(F.lit(pixels_per_degree - 1), F.floor((F.col("lon") - tile_lon) * F.lit(pixels_per_degree))).cast("int")
    return cells.select(*keep, tile_lat.alias("tile_lat"), tile_lon.alias("tile_lon"), row.alias("row"),
                        column.alias("col"))

"""Space joins whose result is one row per target, without a table of pairs.

Targets are dealt to square tiles, sites to every tile they can reach, and a tile is worked out by one call over its arrays. Inside
a tile targets are taken box by box, so most sites are judged once for all targets of a box. What travels grows with targets and
sites, never with their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvian.session import written

#: Targets of a tile that one call takes; a tile with more is split, and its sites repeated.
TILE_ROWS = 100_000
#: Targets in a box, about; entries of a targets x sites matrix, at most.
BOX_ROWS, MATRIX = 24, 2_000_000
#: Keeps rounding from deciding without a look at the distances themselves.
SLACK = 1e-9


def by_tile(targets: DataFrame, sites: DataFrame, keys: Sequence[str], radius: float, tile: float,
            run: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType, tile_rows: int = TILE_ROWS) -> DataFrame:
    """`run(targets, sites)` for every tile and every value of the equi `keys`.

    Both sides have their place in _x and _y; rows without a place or a key meet nothing. `targets` is written, since it is read twice.
    """
    size = F.lit(float(tile))

    def at(v: Column) -> Column:
        return F.floor(v / size).cast("bigint")

    def off(c: str, i: str) -> Column:
        return F.greatest(F.col(i) * size - F.col(c), F.col(c) - (F.col(i) + 1) * size, F.lit(0.0))

    def known(df: DataFrame) -> DataFrame:
        return df.dropna(subset=[*keys, "_x", "_y"])
    on = [*keys, "_i", "_j"]
    left = written(known(targets).withColumns({"_i": at(F.col("_x")), "_j": at(F.col("_y"))}))
    right = known(sites)
    for c, i in (("_x", "_i"), ("_y", "_j")):
        right = right.withColumn(i, F.explode(F.sequence(at(F.col(c) - radius), at(F.col(c) + radius))))
    right = right.where(F.hypot(off("_x", "_i"), off("_y", "_j")) <= radius * (1 + SLACK))
    crowded = (left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tile_rows)
               .select(*on, F.ceil(F.col("_n") / F.lit(tile_rows)).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), salts.cast("bigint")).cast("int")
    left = left.join(crowded, on, "left").withColumn("_salt", spread).drop("_salts")
    right = right.join(crowded, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.groupBy(*on, "_salt").cogroup(right.groupBy(*on, "_salt")).applyInArrow(run, schema)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return pc.fill_null(table.column(name).cast(pa.float64()), float("nan")).to_numpy()


def in_order(sites: pa.Table, name: str) -> pa.Table:
    """Sites by identifier, so that the first of equally near ones is the smallest."""
    return sites.take(pc.sort_indices(sites, sort_keys=[(name, "ascending")], null_placement="at_start"))


def boxes(x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of the targets, box by box."""
    side = max(1, int(np.sqrt(len(x) / BOX_ROWS)))

    def band(v: np.ndarray) -> np.ndarray:
        width = (v.max() - v.min()) / side
        return np.minimum(side - 1, (v - v.min()) / width).astype(np.int64) if width > 0 else np.zeros(len(v), np.int64)
    number = band(x) * side + band(y)
    order = np.argsort(number, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(number[order])) + 1)


def bounds(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of each site from the box around targets, with some slack."""
    x0, x1, y0, y1 = x.min(), x.max(), y.min(), y.max()
    near = np.hypot(np.maximum(0.0, np.maximum(x0 - sx, sx - x1)), np.maximum(0.0, np.maximum(y0 - sy, sy - y1)))
    far = np.hypot(np.maximum(sx - x0, x1 - sx), np.maximum(sy - y0, y1 - sy))
    return near * (1 - SLACK) - SLACK, far * (1 + SLACK) + SLACK


def parts(rows: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """`rows` in pieces whose matrix with `width` sites is bounded."""
    step = max(1, MATRIX // max(1, width))
    for k in range(0, len(rows), step):
        yield rows[k:k + step]


def distances(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dx, dy = sx[None, :] - x[:, None], sy[None, :] - y[:, None]
    return dx, dy, np.sqrt(dx * dx + dy * dy)


def nearest_of(targets: DataFrame, sites: DataFrame, target_id: str, site_id: str, radius: float, min_distance: float = 0.0,
               x: str = "x_km", y: str = "y_km", equal: Sequence[str] = (), tile_rows: int = TILE_ROWS) -> DataFrame:
    """Nearest site of each target at min_distance..radius (ties: smallest id): (target_id, site_id, dx, dy, dist).

    A target given at several places has one row for each that has a site.
    """
    schema = T.StructType([targets.schema[target_id], T.StructField("_site", sites.schema[site_id].dataType),
                           *[T.StructField(c, T.DoubleType()) for c in ("dx", "dy", "dist")]])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = in_order(right, "_site")
        tx, ty, sx, sy = numbers(left, "_x"), numbers(left, "_y"), numbers(right, "_x"), numbers(right, "_y")
        best, place = np.full(len(tx), np.inf), np.zeros(len(tx), np.int64)
        for box in boxes(tx, ty) if len(tx) and len(sx) else ():
            near, far = bounds(tx[box], ty[box], sx, sy)
            sure = far[near >= min_distance]
            reach = min(radius, sure.min()) if len(sure) else radius  # some site is that near to all of the box
            at = np.flatnonzero((near <= reach) & (far >= min_distance))
            for rows in parts(box, len(at)) if len(at) else ():
                d = distances(tx[rows], ty[rows], sx[at], sy[at])[2]
                d[(d < min_distance) | (d > radius)] = np.inf
                first = d.argmin(axis=1)
                best[rows], place[rows] = d[np.arange(len(rows)), first], at[first]
        found = np.flatnonzero(np.isfinite(best))
        at = place[found]
        return pa.table({target_id: left.column(target_id).take(pa.array(found)), "_site": right.column("_site").take(pa.array(at)),
                         "dx": sx[at] - tx[found], "dy": sy[at] - ty[found], "dist": best[found]})

    left = targets.select(*equal, target_id, F.col(x).alias("_x"), F.col(y).alias("_y"))
    right = sites.select(*equal, F.col(site_id).alias("_site"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    found = by_tile(left, right, equal, radius, max(radius / 2, 20.0), run, schema, tile_rows)
    return found.withColumnRenamed("_site", site_id)

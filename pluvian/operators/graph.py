"""Neighbour graph of a snapshot and the smoothing it drives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvian.operators.spatial import within_radius
from pluvian.session import written

RADIUS_KM, DECAY_KM = 50.0, 25.0
KM_PER_DEG_LAT, KM_PER_DEG_LON = 111.0, 105.0
ROW_EPSILON = 1e-6


def places_of(rows: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Distinct node places with flat kilometre coordinates; the place is its own key."""
    return rows.select(lat, lon).distinct().select(
        F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon")).alias("place"),
        (F.col(lon) * F.lit(KM_PER_DEG_LON)).alias("x_km"), (F.col(lat) * F.lit(KM_PER_DEG_LAT)).alias("y_km"))


def neighbour_weights(rows: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(src, dst, weight) between places up to 50 km apart, exp(-d/25); a place is its own neighbour with weight 1."""
    places = places_of(rows, lat, lon)
    pairs = within_radius(places, places.withColumnRenamed("place", "dst"), "place", "dst", RADIUS_KM)
    return pairs.select(F.col("place").alias("src"), "dst", F.exp(-F.col("dist") / F.lit(DECAY_KM)).alias("weight"))


def neighbour_edges(rows: DataFrame, time: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Row-normalised weights between the occupied places of each snapshot (the adjacency as an edge table).

    Rows at the same place and time are folded to a count: every node of a place has the same weights.
    """
    nodes = rows.groupBy(F.col(time).alias("t"), F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon")).alias("dst")) \
        .agg(F.count(F.lit(1)).alias("n"))
    weights = neighbour_weights(rows, lat, lon)
    edges = nodes.select("t", F.col("dst").alias("src"), F.col("n").alias("n_src")).join(weights, "src") \
        .join(nodes, ["t", "dst"])
    total = edges.groupBy("t", "src").agg(F.sum(F.col("weight") * F.col("n")).alias("_row"))
    size = nodes.groupBy("t").agg(F.sum("n").alias("_size"))
    alone = F.col("_size") == 1
    return (edges.join(total, ["t", "src"]).join(size, "t")
            .select(F.col("t").alias(time), "src", "dst", "n_src", F.col("n").alias("n_dst"),
                    F.when(alone, F.lit(1.0)).otherwise(F.col("weight") / (F.col("_row") + F.lit(ROW_EPSILON)))
                    .alias("weight")))


def smooth(rows: DataFrame, time: str, features: Sequence[str], lat: str = "lat", lon: str = "lon",
           hops: int = 2, suffix: str = "_nb") -> DataFrame:
    """h <- h + A h, `hops` times, per snapshot: adds one smoothed column per feature.

    Only sums travel: rows fold to (time, place) sums first, and neighbours are added up without ever listing node pairs.
    All rows of a place gather the same neighbour mean, so each row's own value plus that mean is exact.
    """
    place = F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    keyed = rows.withColumns({"_t": F.col(time), "_place": place,
                              **{f"{f}{suffix}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}})
    cols = [f"{f}{suffix}" for f in features]
    weights = written(neighbour_weights(rows, lat, lon))
    nodes = written(keyed.groupBy("_t", "_place").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in cols]))
    size = nodes.groupBy("_t").agg(F.sum("_n").alias("_size"))
    # weights between places that have rows in the same snapshot; sums are folded before they travel on
    state = nodes.withColumns({f"{c}_g": F.lit(0.0) for c in cols})
    for _ in range(hops):
        sent = state.select("_t", F.col("_place").alias("src"), "_n", *cols).join(weights, "src")
        w = F.col("weight")
        folded = sent.groupBy("_t", F.col("dst").alias("_place")).agg(
            F.sum(w * F.col("_n")).alias("_row"), *[F.sum(w * F.col(c)).alias(f"{c}_s") for c in cols])
        met = state.join(folded, ["_t", "_place"]).join(size, "_t")

        def mean(c: str):
            return F.when(F.col("_size") == 1, F.col(f"{c}_s")).otherwise(F.col(f"{c}_s") / (F.col("_row") + F.lit(ROW_EPSILON)))
        state = written(met.select("_t", "_place", "_n", *[(F.col(c) + F.col("_n") * mean(c)).alias(c) for c in cols],
                                   *[(F.col(f"{c}_g") + mean(c)).alias(f"{c}_g") for c in cols]))
    gathered = state.select("_t", "_place", *[f"{c}_g" for c in cols])
    out = keyed.join(gathered, ["_t", "_place"], "left")
    return out.withColumns({c: F.col(c) + F.col(f"{c}_g") for c in cols}).select(*rows.columns, *cols)

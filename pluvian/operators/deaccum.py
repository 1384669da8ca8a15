"""Forecast run normalisation: units, de-accumulation of rain, sanity limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvian.functions import constants as K
from pluvian.functions.scalars import clip, grid_id, lead_hours

RUN = ("origin", "run_time")


def quantile_below(value: Column, limit: float, q: float) -> Column:
    """Whether the interpolated q-quantile of `value` lies below `limit`, as an aggregate.

    Only the neighbours of the limit matter: with k values below it, the target position either has both its neighbours
    on one side, or sits between the largest value below and the smallest value at or above. So a count, a maximum and a
    minimum decide it exactly, and they combine map-side; no group is ever sorted or held.
    """
    n = F.count(value)
    k = F.count_if(value < limit)
    under, over = F.max(F.when(value < limit, value)), F.min(F.when(value >= limit, value))
    pos = (n - 1) * F.lit(q)
    lo = F.floor(pos)
    frac = pos - lo
    straddling = under + (over - under) * frac < limit
    return (F.when(n == 0, F.lit(False)).when(k <= lo, F.lit(False))
            .when((k >= lo + 2) | (frac == 0.0), F.lit(True)).otherwise(straddling))


def unit_flags(runs: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Per run: is rain in metres, pressure in Pa, temperature in K (told from the values, or from a declared unit)."""
    tests = {}
    if "tp" in runs.columns:
        wet = F.when(F.col("tp") > 0, F.col("tp"))
        metres = (quantile_below(wet, 0.05, 0.5) & quantile_below(wet, 0.5, 0.95)
                  & F.coalesce(F.max("tp") < 2.0, F.lit(False)))
        if "tp_units" in runs.columns:
            declared = F.lower(F.trim("tp_units")).isin("m", "meter", "metre", "meters", "metres")
            metres = metres | F.coalesce(F.bool_or(declared), F.lit(False))
        tests["tp_in_m"] = metres
    if "sp" in runs.columns:
        tests["sp_in_pa"] = F.coalesce(F.avg("sp") > 2000.0, F.lit(False))
    if "t2m" in runs.columns:
        tests["t2m_in_k"] = F.coalesce(F.avg("t2m") > 200.0, F.lit(False))
    return runs.groupBy(*keys).agg(*[c.alias(n) for n, c in tests.items()])


def normalise_units(runs: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """m -> mm, Pa -> hPa, K -> C per run, then the sanity limits (rain is limited after de-accumulation)."""
    if "t2m" not in runs.columns and "2t" in runs.columns:
        runs = runs.withColumnRenamed("2t", "t2m")
    out = runs.join(unit_flags(runs, keys), list(keys))
    changes: dict[str, Column] = {}
    if "tp" in runs.columns:
        changes["tp"] = F.when(F.col("tp_in_m"), F.col("tp") * 1000.0).otherwise(F.col("tp"))
    if "sp" in runs.columns:
        changes["sp"] = clip(F.when(F.col("sp_in_pa"), F.col("sp") / 100.0).otherwise(F.col("sp")), *K.CLIP_LIMITS["sp"])
    if "t2m" in runs.columns:
        changes["t2m"] = clip(F.when(F.col("t2m_in_k"), F.col("t2m") - 273.15).otherwise(F.col("t2m")),
                              *K.CLIP_LIMITS["t2m"])
    return out.withColumns(changes).drop("tp_in_m", "sp_in_pa", "t2m_in_k", "tp_units")


def deaccumulate(runs: DataFrame, run_keys: Sequence[str] = RUN, cell: str = "grid_id",
                 lead: str = "lead_time_hours", tp: str = "tp") -> DataFrame:
    """Running rain totals -> interval rain, run by run, where the run looks cumulative.

    A run is cumulative when fewer than 2 % of all its rows fall by more than 0.01 against the previous lead of their
    cell, and it has more than one lead. Rows are partitioned by (run, cell): one cell's leads, never a whole run.
    """
    series = Window.partitionBy(*run_keys, cell).orderBy(lead)
    stepped = runs.withColumn("_diff", F.col(tp) - F.lag(tp).over(series))
    verdict = stepped.groupBy(*run_keys).agg(
        ((F.count_if(F.col("_diff") < -0.01) / F.count(F.lit(1)) < 0.02)
         & (F.min(lead) < F.max(lead))).alias("_cumulative"))
    interval = F.greatest(F.lit(0.0), F.coalesce("_diff", F.col(tp)))
    value = F.when(F.col("_cumulative") & F.coalesce("_diff", F.col(tp)).isNotNull(), interval).otherwise(F.col(tp))
    return (stepped.join(verdict, list(run_keys)).withColumn(tp, clip(value, *K.CLIP_LIMITS["tp"]))
            .drop("_diff", "_cumulative"))


def deaccumulate_buckets(runs: DataFrame, keys: Sequence[str] = ("origin", "run_time", "grid_id"),
                         lead: str = "lead_time_hours", tp: str = "tp", bucket_hours: int = 6) -> DataFrame:
    """Totals that restart every `bucket_hours`: subtract the previous lead only inside the same bucket."""
    series = Window.partitionBy(*keys).orderBy(lead)
    bucket_start = F.floor((F.col(lead) - 1) / F.lit(bucket_hours)) * bucket_hours
    prev, prev_lead = F.lag(tp).over(series), F.lag(lead).over(series)
    step = F.when(prev_lead > bucket_start, F.col(tp) - prev).otherwise(F.col(tp))
    return runs.withColumn("_step", step).withColumn(
        tp, F.when(F.col("_step").isNotNull(), F.greatest(F.lit(0.0), F.col("_step")))).drop("_step")


def normalise_runs(raw: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Raw run rows -> analysis-ready rows: units, lead time, cell name, interval rain, column order."""
    out = normalise_units(raw, keys).withColumn("lead_time_hours", lead_hours("run_time", "valid_time")) \
        .withColumn("grid_id", grid_id("lat", "lon"))
    if "tp" in out.columns:
        out = deaccumulate(out, keys)
    if "cape" not in out.columns:
        out = out.withColumn("cape", F.lit(0.0))
    return out.select(*[c for c in K.RUN_COLUMNS if c in out.columns])

"""Time joins: as-of lookback, accumulation-window labels, satellite lags, rolling cycles. All keys are equi keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvian.functions import constants as K
from pluvian.functions.scalars import clip, col, epoch_seconds, finite, floor_to, grid_id, shift, wind_uv


def covered_buckets(start: Column, end: Column, width: int) -> Column:
    """Numbers of the time buckets that [start, end] touches (seconds since 1970)."""
    def number(ts: Column) -> Column:
        return F.floor(epoch_seconds(ts) / F.lit(width)).cast("bigint")
    return F.sequence(number(start), number(end))


def bucket_of(ts: Column | str, width: int) -> Column:
    return F.floor(epoch_seconds(ts) / F.lit(width)).cast("bigint")


def latest(tiebreak: Sequence[str]) -> Column:
    """Order of observations: by time, then by the tiebreak, then by the value, so no result is left to chance."""
    return F.struct("_t", *tiebreak, "_v")


def asof_lookback(requests: DataFrame, observations: DataFrame, on: Sequence[str] = (), request_time: str = "run_time",
                  time: str = "observed_at", lookback_hours: int = 3, value: str = "value",
                  series: Sequence[str] = ("station_code", "variable_type"), tiebreak: Sequence[str] = (),
                  ignore_nulls: bool = False) -> DataFrame:
    """Latest observation of every series in [request - lookback, request], both ends included.

    The few request times are repeated over the (at most two) time buckets they touch; the many observations carry one
    bucket each and are never repeated. Since each series is folded by `max_by`, the result per (request, series) is
    combined map-side and a busy gauge adds no skew.
    """
    width = lookback_hours * 3600
    asks = requests.select(*on, request_time).distinct().withColumn(
        "_b", F.explode(covered_buckets(shift(request_time, hours=-lookback_hours), col(request_time), width)))
    extra = [c for c in [*series, *tiebreak] if c not in on]
    obs = observations.select(*on, *extra, F.col(time).alias("_t"), F.col(value).alias("_v"),
                              bucket_of(time, width).alias("_b"))
    if ignore_nulls:
        obs = obs.where(finite("_v"))
    hit = asks.join(obs, [*on, "_b"]).where(
        (F.col("_t") <= F.col(request_time)) & (F.col("_t") >= shift(request_time, hours=-lookback_hours)))
    keys = list(dict.fromkeys([*on, request_time, *series]))
    return hit.groupBy(*keys).agg(F.max_by("_v", latest(tiebreak)).alias(value), F.max("_t").alias(time))


def observations_at_runs(runs: DataFrame, telemetry: DataFrame, lookback_hours: int = 3,
                         ignore_nulls: bool = False) -> DataFrame:
    """Clean local-time telemetry as of each UTC run: one row per (run, station), one column per variable."""
    utc = telemetry.withColumn("observed_at", shift("observed_at", hours=-K.LOCAL_UTC_OFFSET_HOURS))
    latest = asof_lookback(runs, utc, lookback_hours=lookback_hours, ignore_nulls=ignore_nulls)

    def of(v: str) -> Column:
        return F.max(F.when(F.col("variable_type") == v, F.col("value")))
    return latest.groupBy("run_time", "station_code").agg(
        of("hourly_rain").alias("rain"), of("pressure").alias("pressure"), of("humidity").alias("humidity"))


def step_hours(runs: DataFrame, keys: Sequence[str] = ("origin", "run_time"), lead: str = "lead_time_hours") -> DataFrame:
    """Accumulation step of each run: second distinct lead minus the first (or the only lead), at least 1.

    Needs the two smallest distinct leads; leads per run are few, so the distinct set is folded before the fold to one
    row per run.
    """
    leads = runs.where(F.col(lead).isNotNull()).groupBy(*keys, lead).agg(F.count(F.lit(1)).alias("_n"))
    first = leads.groupBy(*keys).agg(F.sort_array(F.collect_list(lead)).alias("_l"))
    step = F.when(F.size("_l") >= 2, F.col("_l")[1] - F.col("_l")[0]).otherwise(F.col("_l")[0])
    return first.select(*keys, F.greatest(F.lit(1), step.cast("int")).alias("step_hours"))


def interval_labels(requests: DataFrame, observations: DataFrame, station: str = "station_code",
                    valid: str = "valid_time", step: str = "step_hours", time: str = "observed_at", value: str = "value",
                    tiebreak: Sequence[str] = (), late_minutes: int = 15, bucket_hours: int = 6) -> DataFrame:
    """Observed rain of (valid - step, valid + late]: last value for hourly steps, otherwise the sum.

    Requests are made distinct first (many cells share a gauge), so a label is computed once per (gauge, time, step).
    """
    width = bucket_hours * 3600
    lo = shift(valid, hours=-F.col(step))
    hi = shift(valid, minutes=late_minutes)
    asks = requests.select(station, valid, step).distinct().withColumn("_b", F.explode(covered_buckets(lo, hi, width)))
    obs = observations.select(station, *[c for c in tiebreak if c != station], F.col(time).alias("_t"),
                              F.col(value).alias("_v"), bucket_of(time, width).alias("_b"))
    hit = asks.join(obs, [station, "_b"]).where((F.col("_t") > lo) & (F.col("_t") <= hi))
    last = F.max_by("_v", latest(tiebreak))
    # a sum over missing values only is 0, as a plain skip-missing sum gives
    total = F.coalesce(F.sum("_v"), F.lit(0.0))
    return (hit.groupBy(station, valid, step).agg(last.alias("_last"), total.alias("_total"), F.count(F.lit(1)).alias("n_obs"))
            .select(station, valid, step, F.when(F.col(step) == 1, F.col("_last")).otherwise(F.col("_total"))
                    .cast("double").alias("observed_rain"), "n_obs"))


def satellite_evolution(band: DataFrame, vapour: DataFrame, time: str = "timestamp", cell: str = "grid_id",
                        anchors: DataFrame | None = None) -> DataFrame:
    """t0 with the 10, 20 and 30 minute lags of the same cell (all four must exist), vapour at t0 where present.

    One scan instead of four: each snapshot row is offered to the four anchor times it can serve, and a cell-time group
    folds at most four rows. Only anchors asked for are kept when `anchors` (a frame of times) is given.
    """
    keep = [c for c in ("lat", "lon", "bt_std") if c in band.columns]
    slots = F.explode(F.array(*[F.struct(shift(time, minutes=m).alias("_t"), F.lit(m).alias("_lag"))
                                for m in (0, 10, 20, 30)]))
    offered = band.select(cell, time, *keep, "bt_mean", "bt_min", slots.alias("_s")).select(
        cell, F.col("_s._t").alias("_anchor"), F.col("_s._lag").alias("_lag"), *keep, "bt_mean", "bt_min")
    if anchors is not None:
        wanted = anchors.select(F.col(anchors.columns[0]).alias("_anchor")).distinct()
        offered = offered.join(wanted, "_anchor", "left_semi")

    def at(lag: int, name: str) -> Column:
        return F.max(F.when(F.col("_lag") == lag, F.col(name)))

    folded = offered.groupBy(cell, "_anchor").agg(
        F.bit_or(F.expr("shiftleft(1, cast(_lag / 10 as int))")).alias("_seen"),
        *[at(0, c).alias(c) for c in keep],
        at(0, "bt_mean").alias("bt_mean_t0"), at(0, "bt_min").alias("bt_min_t0"),
        *[at(m, "bt_mean").alias(f"bt_mean_lag{m}m") for m in (10, 20, 30)])
    full = folded.where(F.col("_seen") == 15).drop("_seen").withColumnRenamed("_anchor", time)
    wv = vapour.groupBy(cell, time).agg(F.max("wv_mean").alias("wv_mean"))
    return convective_flags(full.join(wv, [cell, time], "left"))


def convective_flags(rows: DataFrame) -> DataFrame:
    delta = F.bround(F.col("bt_mean_t0") - F.col("bt_mean_lag30m"), 2)
    return rows.withColumn("delta_bt_30", delta).withColumns({
        "is_rapid_cooling": F.col("delta_bt_30") < -5.0,
        "is_deep_convective": (F.col("bt_min_t0") < 210.0) & (F.col("delta_bt_30") < -3.0)})


def rolling_cycles(hourly: DataFrame, cycles: Sequence[str] = ("00:00", "12:00"), max_lead: int = 24,
                   keys: Sequence[str] = ("origin", "lat", "lon"), dates: DataFrame | None = None,
                   rain_column: str | None = None) -> DataFrame:
    """Continuous hourly series -> forecast cycles: (run, lead) pairs whose valid hour is in the series.

    Nothing is joined: for each cycle hour an hour of the series fixes its own lead modulo 24, so every row yields exactly
    the pairs that end on it. Without `dates` the run days go from the first to the last day of each series.
    """
    d = K.HOURLY_DEFAULTS
    base = hourly
    if dates is None:
        base = hourly.join(hourly.groupBy(*keys).agg(F.min("time").alias("_first")), list(keys))
    minute_of_day = F.hour("time") * 60 + F.minute("time")
    pairs = []
    for cycle in cycles:
        start = int(cycle.split(":")[0]) * 60 + int(cycle.split(":")[1])
        behind = F.pmod(minute_of_day - F.lit(start), F.lit(1440))
        for day in range((max_lead + 23) // 24):
            lead = F.when(behind == 0, F.lit(24)).otherwise((behind / F.lit(60)).cast("int")) + F.lit(24 * day)
            pairs.append(F.when((behind % 60 == 0) & (F.second("time") == 0) & (lead <= max_lead), lead))
    offered = (base.withColumn("lead_time_hours", F.explode(F.array_compact(F.array(*pairs))))
               .withColumn("run_time", shift("time", hours=-F.col("lead_time_hours"))))
    run_day = floor_to("run_time", 86400)
    if dates is None:
        offered = offered.where(run_day >= floor_to("_first", 86400))
    else:
        days = dates.select(F.col(dates.columns[0]).cast("timestamp_ntz").alias("_day")).distinct()
        offered = offered.withColumn("_day", run_day).join(days, "_day", "left_semi")

    def filled(name: str | None, default: float) -> Column:
        if name is None or name not in hourly.columns:
            return F.lit(default)
        c = F.col(name).cast("double")
        return F.coalesce(F.when(~F.isnan(c), c), F.lit(default))

    rain_column = rain_column or next((c for c in ("precipitation", "rain") if c in hourly.columns), None)
    u, v = wind_uv(*[filled(c, d[c]) for c in ("wind_speed_10m", "wind_direction_10m")])
    return offered.select(
        *[k for k in keys if k not in ("lat", "lon")], "run_time", F.col("time").alias("valid_time"), "lead_time_hours",
        grid_id("lat", "lon").alias("grid_id"), F.bround("lat", 4).alias("lat"), F.bround("lon", 4).alias("lon"),
        F.bround(F.greatest(F.lit(0.0), filled(rain_column, 0.0)), 3).alias("tp"),
        F.bround(clip(filled("surface_pressure", d["surface_pressure"]), *K.CLIP_LIMITS["sp"]), 1).alias("sp"),
        F.bround(clip(filled("temperature_2m", d["temperature_2m"]), *K.CLIP_LIMITS["t2m"]), 2).alias("t2m"),
        F.bround(u, 3).alias("u10"), F.bround(v, 3).alias("v10"),
        F.bround(F.greatest(F.lit(0.0), filled("cape", 0.0)), 1).alias("cape"))

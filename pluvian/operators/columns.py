"""Column conventions of feature and prediction tables. Choices depend on column names only, so they cost no job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvian.functions import constants as K
from pluvian.functions.scalars import corrected_rain, iso_z, model_name, target_bias


def first_present(df: DataFrame, names: Sequence[str], otherwise: Column) -> Column:
    return next((F.col(n) for n in names if n in df.columns), otherwise)


def standard_columns(df: DataFrame) -> DataFrame:
    """Coordinates under both names, both lead names, station and basin ids, raw rain and the residual target."""
    zero, out = F.lit(0.0), df
    for short, names in (("lat", ("lat", "target_lat", "latitude")), ("lon", ("lon", "target_lon", "longitude"))):
        value = first_present(out, names, zero)
        for name in (short, f"target_{short}"):
            if name not in out.columns:
                out = out.withColumn(name, value)
    for name, sources in (("lead_time_hours", ("lead_time",)), ("lead_time", ("lead_time_hours",)),
                          ("station_id", ("grid_id",)), ("nwp_rain_raw", ("tp",))):
        if name not in out.columns and sources[0] in out.columns:
            out = out.withColumn(name, F.col(sources[0]))
    if "basin_id" not in out.columns:
        out = out.withColumn("basin_id", first_present(out, ("basin_name",), F.lit("General")))
    if "target_bias" not in out.columns and {"observed_rain", "nwp_rain_raw"} <= set(out.columns):
        out = out.withColumn("target_bias", F.col("observed_rain") - F.col("nwp_rain_raw"))
    return out


def observed_or_fallback(df: DataFrame) -> Column:
    """Observed rain, else raw + residual, else raw - by what the table has."""
    if "observed_rain" in df.columns:
        return F.col("observed_rain")
    if "target_bias" in df.columns:
        return F.col("nwp_rain_raw") + F.col("target_bias")
    return F.col("nwp_rain_raw")


def forecast_features(df: DataFrame) -> DataFrame:
    """Forecast names -> feature names, coordinates kept under both names, weather model from the origin."""
    out = df.withColumnsRenamed({k: v for k, v in K.NWP_RENAMES.items() if k in df.columns})
    if "target_lat" in out.columns:
        out = out.withColumns({"lat": F.col("target_lat"), "lon": F.col("target_lon")})
    if "weather_model" not in out.columns and "origin" in out.columns:
        out = out.withColumn("weather_model", F.col("origin"))
    return out


def labelled(df: DataFrame, target: str = "target_bias") -> DataFrame:
    return df.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))) if target in df.columns else df


def with_target(df: DataFrame, observed: str = "observed_rain", raw: str = "nwp_rain_raw") -> DataFrame:
    return df.withColumn("target_bias", target_bias(observed, raw))


def of_weather_model(df: DataFrame, name: str) -> DataFrame:
    """Rows of one weather model under any of its names; none if the table has none."""
    column = next((c for c in ("weather_model", "origin") if c in df.columns), None)
    if column is None:
        return df
    wanted = name.strip().lower()
    canonical = K.VERIFICATION_ALIASES.get(wanted, wanted)
    accepted = sorted({wanted, canonical, *(a for a, c in K.VERIFICATION_ALIASES.items() if c == canonical)})
    return df.where(F.lower(F.col(column).cast("string")).isin(accepted))


def ablation_features(df: DataFrame, ablation: str) -> list[str]:
    """Features of an ablation that the table has; the full list when it has none."""
    wanted = K.ABLATIONS.get(ablation, [])
    return [f for f in wanted if f in df.columns] or wanted


def ablation_matrix_input(df: DataFrame, ablation: str, keep: Sequence[str] = ()) -> DataFrame:
    """Model input: the ablation's features, missing values as 0, plus the columns to keep."""
    features = ablation_features(df, ablation)
    zeroed = [F.coalesce(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), F.lit(0.0)).alias(f)
              for f in features]
    return df.select(*[c for c in keep if c not in features], *zeroed)


def prediction_frame(df: DataFrame, model: str, ablation: str, weather_model: str = "ecmwf_ifs",
                     bias: str = "predicted_bias", quantiles: Sequence[str] = ()) -> DataFrame:
    """The exported prediction table: 14 columns plus corrected quantiles, floats as f32, times as ISO text."""
    rows = standard_columns(df)
    if "nwp_rain_raw" not in rows.columns:
        rows = rows.withColumn("nwp_rain_raw", F.lit(0.0))
    raw = F.col("nwp_rain_raw").cast("double")

    def time(name: str) -> Column:
        kind = dict(rows.dtypes).get(name)
        if kind is None:
            return F.lit("2021-01-01T00:00:00Z")
        return F.col(name) if kind == "string" else iso_z(name)

    return rows.select(
        time("valid_time").alias("valid_time"), time("run_time").alias("run_time"),
        first_present(rows, ("lead_time_hours", "lead_time"), F.lit(0)).cast("int").alias("lead_time"),
        F.lit(weather_model).alias("weather_model"),
        first_present(rows, ("station_id", "grid_id"), F.lit("STN_UNKNOWN")).cast("string").alias("station_id"),
        F.col("lat").cast("float").alias("lat"), F.col("lon").cast("float").alias("lon"),
        F.col("basin_id").cast("string").alias("basin_id"),
        observed_or_fallback(rows).cast("float").alias("observed_rain"), raw.cast("float").alias("nwp_raw_rain"),
        F.col(bias).cast("float").alias("predicted_bias"),
        corrected_rain(raw, F.col(bias).cast("double")).cast("float").alias("corrected_rain"),
        F.lit(model).alias("model_name"), F.lit(ablation).alias("ablation"),
        *[corrected_rain(raw, F.col(q).cast("double")).cast("float").alias(q) for q in quantiles])


def canonical_models(df: DataFrame, column: str = "weather_model", vocabulary: str = "verification") -> DataFrame:
    return df.withColumn(column, model_name(column, vocabulary))

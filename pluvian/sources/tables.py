"""Feature tables, satellite snapshots, predictions and report files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvian.functions import constants as K
from pluvian.functions.scalars import nan_to_null, narrow
from pluvian.operators.guards import before_frozen
from pluvian.sources.forecasts import prediction_tags


def scan_features(spark: SparkSession, path: str | Sequence[str], before_year: int | None = K.FROZEN_YEAR) -> DataFrame:
    """Feature Parquet up to the frozen year, narrowed to f32 and i32.

    The time predicate is pushed into the scan; where the table is laid out by year, later folders are not opened at all.
    """
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.option("mergeSchema", len(paths) > 1).parquet(*paths)
    if before_year is not None:
        df = before_frozen(df, year=before_year)
        if "year" in df.columns:
            df = df.where(F.col("year") < before_year)
    return nan_to_null(narrow(df))


def write_features(df: DataFrame, path: str, files_per_month: int = 32, mode: str = "overwrite") -> None:
    """Feature Parquet by year and month of the valid time, so year splits read only their folders."""
    out = df.withColumns({"year": F.year("valid_time"), "month": F.month("valid_time")})
    spread = F.pmod(F.xxhash64("grid_id", "run_time"), F.lit(files_per_month))
    out.repartition("year", "month", spread).write.mode(mode).partitionBy("year", "month").parquet(path)


def write_snapshots(df: DataFrame, path: str, time: str = "timestamp", mode: str = "overwrite") -> None:
    """Satellite snapshots by date."""
    out = df.withColumn("date", F.to_date(time))
    out.repartition("date", F.hour(time)).write.mode(mode).partitionBy("date").parquet(path)


def scan_snapshots(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
                   satellites: Sequence[str] | None = None, time: str = "timestamp") -> DataFrame:
    """Snapshots of a date range (folders pruned), of the wanted satellites."""
    from pluvian.functions.scalars import satellite_name
    df = spark.read.parquet(path)
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df.where(satellite_name(time).isin(list(satellites))) if satellites else df


def write_predictions(df: DataFrame, path: str, csv_path: str | None = None, mode: str = "overwrite") -> None:
    """Parquet by weather model, model and ablation; only the folders that `df` has rows for are replaced. CSV when asked for."""
    def writer():
        return (df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
                .partitionBy("weather_model", "model_name", "ablation"))
    writer().parquet(path)
    if csv_path:
        writer().option("header", True).csv(csv_path)


def scan_predictions(spark: SparkSession, path: str, models: Sequence[str] | None = None) -> DataFrame:
    """Partitioned predictions, or loose files that name weather model, model and ablation when `models` is given."""
    if models is None:
        return spark.read.parquet(path)
    df = spark.read.option("recursiveFileLookup", True).parquet(path)
    weather, model, ablation = prediction_tags(F.col("_metadata.file_path"), models)
    known = F.coalesce(weather, F.col("weather_model")) if "weather_model" in df.columns else weather
    return (df.withColumns({"weather_model": known, "model_name": model, "ablation": ablation})
            .where(F.col("model_name").isNotNull()))


def write_reports(reports: Mapping[str, DataFrame], folder: str) -> None:
    """One CSV folder per report table. A report is a folded table of bounded size, so one file holds it."""
    for name, df in reports.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")

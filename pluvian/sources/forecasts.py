"""Forecast runs: Parquet, hourly JSON series, per-lead JSON."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvian.functions import constants as K
from pluvian.functions.scalars import finite, grid_id, nan_to_null, shift
from pluvian.operators.deaccum import deaccumulate_buckets

LEAD_VARIABLES = ["t2m", "sp", "u10", "v10", "apcp", "cape"]


def run_tags(df: DataFrame, path: Column | str = "_metadata.file_path") -> DataFrame:
    """Run time from `..._YYYYMMDD_HHz` file names and the origin from the folder."""
    p = F.col(path) if isinstance(path, str) else path
    stamp = F.concat(F.regexp_extract(p, r"_(\d{8})_(\d{2})z", 1), F.regexp_extract(p, r"_(\d{8})_(\d{2})z", 2))
    return df.withColumns({"file_run_time": F.try_to_timestamp(stamp, F.lit("yyyyMMddHH")).cast("timestamp_ntz"),
                           "file_origin": F.regexp_extract(p, r"([^/=]+)/[^/]*$", 1)})


def prediction_tags(path: Column, models: Sequence[str], ablations: Sequence[str] = ("m1", "m2", "m3"),
                    weather_models: Sequence[str] = tuple(sorted(set(K.VERIFICATION_ALIASES.values())))) -> tuple[Column, Column, Column]:
    """(weather model, model, ablation) named by a prediction file; the longest matching name wins, none is NULL.

    The weather model stands in the file name, or in the folder the file lies in.
    """
    def one_of(names: Sequence[str]) -> str:
        return "(" + "|".join(sorted(names, key=len, reverse=True)) + ")"
    pattern = one_of(models) + "_" + one_of(ablations)
    low = F.lower(path)
    name = F.regexp_extract(low, r"([^/]+)$", 1)

    def found(text: Column, wanted: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(text, wanted, group), F.lit(""))
    weather = one_of(weather_models)
    return (F.coalesce(found(name, weather, 1), found(F.regexp_extract(low, r"([^/]*)/[^/]*$", 1), weather, 1)),
            found(name, pattern, 1), found(name, pattern, 2))


def scan_runs(spark: SparkSession, path: str, schema: T.StructType | None = None, tags: bool = False,
              recursive: bool = True) -> DataFrame:
    """Every Parquet file below a folder. With `tags`, run time and origin of the file name are added.

    `recursive=False` reads the layout of `write_runs`, whose folders name origin and run date.
    """
    reader = spark.read.option("recursiveFileLookup", recursive)
    df = (reader.schema(schema) if schema else reader).parquet(path)
    return nan_to_null(run_tags(df) if tags else df)


def write_runs(df: DataFrame, path: str, files_per_run: int = 8, mode: str = "overwrite") -> None:
    """Parquet by origin and run date; a run's cells are spread over several tasks."""
    out = df.withColumn("run_date", F.to_date("run_time"))
    spread = F.pmod(F.xxhash64("grid_id"), F.lit(files_per_run))
    (out.repartition("origin", "run_date", spread).sortWithinPartitions("run_time", "grid_id", "lead_time_hours")
     .write.mode(mode).partitionBy("origin", "run_date").parquet(path))


HOURLY_SCHEMA = T.StructType([
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("hourly", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])


def hourly_rows(documents: DataFrame, origin: str, variables: Sequence[str] = (
        "precipitation", "rain", "temperature_2m", "surface_pressure", "wind_speed_10m", "wind_direction_10m", "cape"),
        keep: Sequence[str] = ("latitude", "longitude")) -> DataFrame:
    """Documents with a map of aligned arrays -> one row per hour; text that is no number becomes NULL.

    A variable is looked up under its own name, then with the model's suffix.
    """
    d = documents.select(*keep, "hourly", F.posexplode(F.try_element_at("hourly", F.lit("time"))).alias("_p", "_t"))

    def at(name: str) -> Column:
        plain = F.try_element_at("hourly", F.lit(name))
        values = F.coalesce(plain, F.try_element_at("hourly", F.lit(f"{name}_{origin}")))
        v = F.get(values, F.col("_p")).try_cast("double")
        return F.when(finite(v), v).alias(name)
    return d.select(*keep, F.lit(origin).alias("origin"), F.col("_t").try_cast("timestamp_ntz").alias("time"),
                    *[at(v) for v in variables]).where(F.col("time").isNotNull())


def hourly_json_to_rows(spark: SparkSession, path: str | Sequence[str], origin: str, **kw) -> DataFrame:
    """Hourly JSON responses, one document per file."""
    docs = spark.read.schema(HOURLY_SCHEMA).option("multiLine", True).json(path)
    return hourly_rows(docs, origin, **kw)


LEAD_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()), T.StructField("cycle", T.StringType()), T.StructField("lead", T.IntegerType()),
    T.StructField("coords_count", T.IntegerType()),
    T.StructField("variables", T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))])


def lead_rows(documents: DataFrame, coordinates: DataFrame, origin: str = "gfs") -> DataFrame:
    """Per-lead documents -> analysis-ready rows.

    Arrays are aligned by position with `coordinates` (pos, lat, lon). A document that lacks a variable, or whose array is
    not exactly as long as the coordinate list, is left out as incomplete. Rain restarts every six hours.
    """
    n = coordinates.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    complete = reduce(lambda a, b: a & b, [F.coalesce(F.size(F.try_element_at("variables", F.lit(v))) == n, F.lit(False))
                                           for v in LEAD_VARIABLES])
    zipped = F.arrays_zip(*[F.try_element_at("variables", F.lit(v)).alias(v) for v in LEAD_VARIABLES])
    # the test is part of the exploded value: as a filter it would reach the source, and documents be parsed once for each variable
    rows = (documents.withColumn("run_time", F.concat_ws(" ", "date", "cycle").try_cast("timestamp_ntz"))
            .select("run_time", F.col("lead").alias("lead_time_hours"), F.posexplode(F.when(complete, zipped)).alias("pos", "_v")))
    flat = rows.select("run_time", "lead_time_hours", "pos",
                       *[F.col("_v").getField(v).alias(v) for v in LEAD_VARIABLES])
    rain = deaccumulate_buckets(flat, ["run_time", "pos"], tp="apcp")
    return rain.join(coordinates.select("pos", "lat", "lon"), "pos").select(
        F.lit(origin).alias("origin"), "run_time", shift("run_time", hours=F.col("lead_time_hours")).alias("valid_time"),
        "lead_time_hours", grid_id("lat", "lon").alias("grid_id"), "lat", "lon", F.bround("apcp", 2).alias("tp"),
        F.bround("sp", 2).alias("sp"), F.bround("t2m", 2).alias("t2m"), F.bround("u10", 3).alias("u10"),
        F.bround("v10", 3).alias("v10"), F.bround("cape", 1).alias("cape"))


def lead_json_to_rows(spark: SparkSession, path: str | Sequence[str], coordinates: DataFrame, origin: str = "gfs") -> DataFrame:
    return lead_rows(spark.read.schema(LEAD_SCHEMA).option("multiLine", True).json(path), coordinates, origin)


def combine_cycles(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of per-cycle tables by name; columns a cycle lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def prefer_source(sources: Sequence[DataFrame], keys: Sequence[str] = ("origin", "run_time")) -> DataFrame:
    """Per cycle, the rows of the first source that has any.

    The best source of a cycle is a minimum, joined back; no cycle is ranked row by row.
    """
    tagged = combine_cycles([df.withColumn("_src", F.lit(i)) for i, df in enumerate(sources)])
    best = tagged.groupBy(*keys).agg(F.min("_src").alias("_src"))
    return tagged.join(best, [*keys, "_src"]).drop("_src")

"""Gauge telemetry: raw CSV of two generations, clean Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvian.functions import constants as K
from pluvian.functions.skew import first_row

CLEAN_SCHEMA = T.StructType([
    T.StructField("station_code", T.StringType()), T.StructField("observed_at", T.TimestampNTZType()),
    T.StructField("variable_type", T.StringType()), T.StructField("value", T.FloatType()),
    T.StructField("quality_flag", T.StringType()), T.StructField("is_golden", T.BooleanType())])
RAW_COLUMNS = ["station_code", "observed_at", "variable_type", "raw_value", "raw_quality_flag"]


def scan_clean(spark: SparkSession, base: str, variables: Sequence[str] | None = None,
               years: Sequence[int] | None = None) -> DataFrame:
    """Clean telemetry; variable and year filters prune folders."""
    schema = T.StructType([*CLEAN_SCHEMA.fields, T.StructField("year", T.IntegerType())])
    df = spark.read.schema(schema).parquet(base)
    if variables:
        df = df.where(F.col("variable_type").isin(list(variables)))
    if years:
        df = df.where(F.col("year").isin([int(y) for y in years]))
    return df


def write_clean(df: DataFrame, base: str, files_per_folder: int = 32, mode: str = "overwrite") -> None:
    """Parquet by variable and year. Rows are spread by station and month, so a year is written by many tasks."""
    out = df.withColumn("year", F.year("observed_at"))
    spread = F.pmod(F.xxhash64("station_code", F.month("observed_at")), F.lit(files_per_folder))
    (out.repartition("variable_type", "year", spread).sortWithinPartitions("station_code", "observed_at")
     .write.mode(mode).partitionBy("variable_type", "year").parquet(base))


def parse_time(text: Column, formats: Sequence[str] = ()) -> Column:
    """Timestamp or NULL: ISO-like text first, then the given patterns."""
    tries = [text.try_cast("timestamp_ntz")]
    tries += [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)


def csv_cells(line: Column) -> Column:
    """Cells of a CSV line without leading blanks; quoted cells may hold commas and doubled quotes."""
    cut = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(\s*"(?:[^"]|"")*"\s*|[^,]*)'), F.lit(1))

    def bare(c: Column) -> Column:
        inner = F.replace(F.regexp_replace(c, r'^\s*"|"\s*$', ""), F.lit('""'), F.lit('"'))
        text = F.when(c.rlike(r'^\s*"'), inner).otherwise(F.ltrim(c))
        return F.nullif(text, F.lit(""))
    return F.transform(cut, bare)


def parse_telemetry(spark: SparkSession, paths: str | Sequence[str], station_pattern: str = r"([^/]+)\.csv$",
                    catalog_pattern: str = r"(hourly_rain|pressure|humidity)", formats: Sequence[str] = ("dd/MM/yyyy HH:mm",),
                    encoding: str = "UTF-8") -> DataFrame:
    """Raw CSV files of both generations -> long rows.

    The header row decides the generation of its file; rows may have any number of columns. All files are read in one scan
    of lines without headers; the header rows are one per file and meet the data rows of their file through an equi join, so
    files are never visited one by one. A file without a known header fails the job. Of rows with the same gauge, variable
    and time the first of the first file (by name) is kept, whatever its value.
    """
    lines = (spark.read.schema("_line string").option("sep", "\u0001").option("quote", "").option("encoding", encoding)
             .csv(paths).select("_line", F.col("_metadata.file_path").alias("_file"),
                                F.col("_metadata.file_block_start").alias("_block"),
                                F.monotonically_increasing_id().alias("_row")))  # ascends within a block
    raw = lines.where(F.col("_line").isNotNull()).select(csv_cells(F.col("_line")).alias("_cells"), "_file", "_block", "_row")
    clean = F.transform("_cells", lambda c: F.lower(F.trim(F.replace(c, F.lit("﻿"), F.lit("")))))
    raw = raw.withColumn("_names", clean)
    modern = F.array_contains("_names", "measure_datetime")
    legacy = F.array_contains("_names", "date") & F.array_contains("_names", "time")
    is_header = F.coalesce(modern | legacy, F.lit(False))
    headers = raw.where(is_header).groupBy("_file").agg(F.max("_names").alias("_h"))
    rows = raw.where(~is_header).drop("_names").join(headers, "_file", "left")

    def at(name: str) -> Column:
        place = F.array_position("_h", name).cast("int")
        return F.when(place > 0, F.trim(F.get("_cells", place - 1)))

    has_modern = F.array_contains("_h", "measure_datetime")
    known = F.array(*[F.lit(c) for c in K.VALUE_COLUMNS])
    kinds = F.create_map(*[F.lit(x) for kv in K.VALUE_COLUMNS.items() for x in kv])
    modern_value = F.coalesce(F.get(F.filter("_h", lambda c: F.array_contains(known, c)), F.lit(0)), F.get("_h", F.lit(2)))
    legacy_value = F.get(F.filter("_h", lambda c: ~c.isin("date", "time")), F.lit(0))
    value_name = F.when(has_modern, modern_value).otherwise(legacy_value)
    rows = rows.withColumn("_value_name", value_name)
    place = F.array_position("_h", F.col("_value_name")).cast("int")
    station_of_file = F.regexp_extract("_file", station_pattern, 1)
    catalog_of_file = F.nullif(F.regexp_extract("_file", catalog_pattern, 1), F.lit(""))
    # the check sits in the time text, which every row needs, so no filter can skip it
    unknown = F.raise_error(F.concat(F.lit("unrecognised telemetry header in "), "_file")).cast("string")
    stamp = F.when(F.col("_h").isNull(), unknown).when(has_modern, at("measure_datetime")).otherwise(F.concat_ws(" ", at("date"), at("time")))
    out = rows.select(
        F.when(has_modern, F.coalesce(at("station_code"), station_of_file)).otherwise(station_of_file).alias("station_code"),
        parse_time(stamp, formats).alias("observed_at"),
        F.coalesce(F.try_element_at(kinds, F.col("_value_name")), catalog_of_file).alias("variable_type"),
        F.get("_cells", place - 1).alias("raw_value"),
        F.when(has_modern & (F.array_position("_h", "quality_flag") > 0), at("quality_flag"))
        .otherwise(F.lit("VALID")).alias("raw_quality_flag"),
        "_file", "_block", "_row").where(F.col("observed_at").isNotNull())
    keys = ["station_code", "variable_type", "observed_at"]
    return first_row(out, keys, [F.col("_file"), F.col("_block"), F.col("_row")]).select(*RAW_COLUMNS)

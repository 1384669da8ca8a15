"""Station master data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvian.functions.geo import in_station_box
from pluvian.functions.scalars import parse_number, snake_case
from pluvian.functions.skew import first_row
from pluvian.operators.quality import station_flags

THAI_BYTES = "".join(chr(b) for b in range(0xA1, 0xFC))
THAI_LETTERS = "".join(chr(b + 0x0D60) for b in range(0xA1, 0xFC))  # single-byte Thai is an offset into the Thai block


def scan_station_csv(spark: SparkSession, path: str | Sequence[str], catalog: str, encoding: str = "auto") -> DataFrame:
    """Station CSV: every column as trimmed text, names in snake case, catalog tag.

    `encoding`: utf-8 (with or without a byte-order mark), tis-620 or cp874 (single-byte Thai), or auto, which takes each
    file as UTF-8 if all its bytes are and as Thai otherwise. Files are read as bytes once; a row per file holds the choice.
    """
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    wanted = encoding.lower()
    single = wanted in ("tis-620", "cp874")

    def named(c: str) -> str:
        try:
            text = None if single else c.encode("latin-1").decode("utf-8-sig")
        except UnicodeDecodeError:
            text = None
        return snake_case(text if text is not None else c.translate(str.maketrans(THAI_BYTES, THAI_LETTERS)))

    names = [named(c) for c in raw.columns]
    rows = raw.select("*", F.col("_metadata.file_path").alias("_file")).toDF(*names, "_file")
    thai = {c: F.translate(F.col(c), THAI_BYTES, THAI_LETTERS) for c in names}
    utf8 = {c: F.encode(F.col(c), "ISO-8859-1").cast("string") for c in names}
    if wanted == "auto":
        good = rows.groupBy("_file").agg(F.bool_and(F.coalesce(F.expr("AND".join(
            [f"(coalesce(is_valid_utf8(cast(encode(`{c}`, 'ISO-8859-1') as string)), true))" for c in names])), F.lit(True))).alias("_utf8"))
        rows = rows.join(good, "_file")
        texts = {c: F.when(F.col("_utf8"), utf8[c]).otherwise(thai[c]) for c in names}
    else:
        texts = thai if single else {c: F.make_valid_utf8(utf8[c]) for c in names}
    return rows.select([F.trim(texts[c]).alias(c) for c in names]).withColumn("catalog", F.lit(catalog))


def all_station_codes(catalogs: Sequence[DataFrame]) -> DataFrame:
    """Distinct codes over all catalogs."""
    out = catalogs[0].select("station_code")
    for df in catalogs[1:]:
        out = out.unionByName(df.select("station_code"))
    return out.distinct()


def station_master(catalogs: DataFrame) -> DataFrame:
    """Rain-catalog stations with availability flags, numeric coordinates and the coordinate check."""
    base = catalogs.where(F.col("catalog") == "hourly_rain").drop("catalog")
    one = first_row(base, ["station_code"], [F.col(c) for c in base.columns if c != "station_code"])
    out = one.join(station_flags(catalogs.select("station_code", "catalog")), "station_code")
    out = out.withColumns({"latitude": parse_number(F.col("latitude").cast("string")),
                           "longitude": parse_number(F.col("longitude").cast("string"))})
    return out.withColumn("valid_thailand_coords", in_station_box("latitude", "longitude"))


RECORD = ["station_code", "station_name", "latitude", "longitude", "basin_name", "sub_basin_name", "province_name",
          "amphoe_name", "tambon_name", "has_rain", "has_pressure", "has_humidity", "has_all_three"]


def cross_map_records(master: DataFrame) -> DataFrame:
    """One nested record per station; absent texts are empty."""
    def field(c: str):
        if c not in master.columns:
            return F.lit("").alias(c)
        return F.coalesce(F.col(c), F.lit("")).alias(c) if c.endswith("_name") else F.col(c)
    return master.select("station_code", F.struct(*[field(c) for c in RECORD]).alias("record"))


def cross_map_summary(master: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Counts of the cross map: one row."""
    def codes(c: str):
        return F.count_distinct(F.when(F.col("catalog") == c, F.col("station_code")))
    seen = catalogs.agg(codes("hourly_rain").alias("rain_stations_count"), codes("pressure").alias("pressure_stations_count"),
                        codes("humidity").alias("humidity_stations_count"))
    totals = master.agg(F.count(F.lit(1)).alias("total_stations"),
                        F.count_if("has_all_three").alias("stations_with_all_three_catalogs"),
                        F.count_if("valid_thailand_coords").alias("stations_with_valid_coords"))
    s = seen.select(F.struct("*").alias("s")).scalar()
    return totals.select("total_stations", *[s.getField(c).alias(c) for c in seen.columns],
                         "stations_with_all_three_catalogs", "stations_with_valid_coords")


def write_cross_map(master: DataFrame, catalogs: DataFrame, path: str) -> None:
    cross_map_summary(master, catalogs).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    cross_map_records(master).write.mode("overwrite").json(f"{path}/stations")


def scan_holdout_stations(spark: SparkSession, path: str) -> DataFrame:
    """Held-out network: every id stays text (leading zeros), coordinates become numbers."""
    df = scan_station_csv(spark, path, "holdout")
    return df.withColumns({c: parse_number(c) for c in ("latitude", "longitude") if c in df.columns})

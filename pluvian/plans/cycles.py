"""Forecast cycles built batch by batch: only what is missing, safe to stop and to repeat.

A table of cycles is a folder with `rows` (Parquet, a partition folder per cycle) and `finished` (the manifest: an entry per
cycle that was written whole, with the mark of the build that wrote it). Readers see the rows of finished builds only. A run that
breaks off leaves no entry for its last batch, so the next run writes those cycles again, over whatever is there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvian.session import exists, written
from pluvian.sources.inventory import plan_missing

KEYS = ["origin", "run_time"]
PLACE = ["part_origin", "part_cycle"]
MANIFEST = "origin string, run_time timestamp_ntz, n_rows bigint, build string, columns string, written_at timestamp"


def placed(df: DataFrame) -> DataFrame:
    """Adds the names of a cycle's folders."""
    return df.withColumns({"part_origin": F.col("origin"), "part_cycle": F.date_format("run_time", "yyyyMMdd-HHmm")})


def finished_cycles(spark: SparkSession, path: str) -> DataFrame:
    """The last entry of every finished cycle."""
    if not exists(spark, f"{path}/finished"):
        return spark.createDataFrame([], MANIFEST)
    log = spark.read.schema(MANIFEST).parquet(f"{path}/finished")
    rest = [c for c in log.columns if c not in KEYS]
    return log.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), F.struct("written_at", "build")).alias("e")).select(*KEYS, "e.*")


def extend_cycles(spark: SparkSession, requested: DataFrame, build: Callable[[DataFrame], DataFrame], path: str,
                  batch: int = 500, files_per_cycle: int = 4, rebuild: bool = False) -> int:
    """Build the requested cycles that are not finished; returns how many those were.

    `requested` has (origin, run_time). `build` gets such a table and returns rows with those two columns; rows of other cycles
    are dropped. About `batch` cycles are built between two entries in the manifest, so a broken run loses one batch at most;
    a batch overwrites just its own partition folders. A cycle without rows is finished too. With `rebuild`, finished cycles
    are built again.
    """
    wanted = requested.select(*KEYS).distinct()
    todo = written(wanted if rebuild else plan_missing(wanted, finished_cycles(spark, path), KEYS))
    n = todo.count()
    parts = -(-n // batch)
    # a hash cuts the cycles into batches, the same ones when a task is repeated
    todo = todo.withColumn("_batch", F.pmod(F.xxhash64(*KEYS), F.lit(max(1, parts))).cast("int"))
    for i in range(parts):
        _build_batch(spark, todo.where(F.col("_batch") == i).select(*KEYS), build, path, files_per_cycle)
    return n


def _build_batch(spark: SparkSession, cycles: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, files_per_cycle: int) -> None:
    mark = uuid.uuid4().hex
    rows = build(cycles).join(cycles, KEYS, "left_semi")
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(files_per_cycle))
    (placed(rows.withColumn("build", F.lit(mark))).repartition(*PLACE, spread)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(f"{path}/rows"))
    counts = (_rows(spark, path, rows.schema).join(placed(cycles), [*KEYS, *PLACE], "left_semi")
              .where(F.col("build") == mark).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows")))
    entry = cycles.join(counts, KEYS, "left").select(
        *KEYS, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.lit(mark).alias("build"), F.lit(rows.schema.json()).alias("columns"),
        F.current_timestamp().alias("written_at"))
    entry.coalesce(1).write.mode("append").parquet(f"{path}/finished")  # a row per cycle of the batch, entered together


def _rows(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    schema = T.StructType([*columns.fields, *[T.StructField(c, T.StringType()) for c in ("build", *PLACE)]])
    return spark.read.schema(schema).parquet(f"{path}/rows")


def scan_cycles(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all finished cycles, with the columns of the latest build; cycles that are not finished are not opened."""
    done = finished_cycles(spark, path)
    latest = done.agg(F.max_by("columns", F.struct("written_at", "build"))).first()[0]
    if latest is None:
        raise FileNotFoundError(f"no finished cycle in {path}")
    columns = T.StructType.fromJson(json.loads(latest))
    return _rows(spark, path, columns).join(placed(done.select(*KEYS, "build")), [*KEYS, "build", *PLACE], "left_semi").select(*columns.names)

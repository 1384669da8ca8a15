"""What is there and what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def requested_cycles(spark: SparkSession, models: Sequence[str], start: str | Column, end: str | Column,
                     cycles: Sequence[str] = ("00:00", "12:00")) -> DataFrame:
    """(model, run_time) of every date x cycle x model; grown by explode on one row, so nothing is joined."""
    def day(d):
        return F.lit(d).cast("timestamp_ntz") if isinstance(d, str) else d
    parts = [c.split(":") for c in cycles]
    offsets = F.array(*[F.make_dt_interval(F.lit(0), F.lit(int(p[0])), F.lit(int(p[1]))) for p in parts])
    return (spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
            .withColumn("_d", F.explode(F.sequence(day(start), day(end), F.expr("interval 1 day"))))
            .withColumn("_o", F.explode(offsets)).select("model", (F.col("_d") + F.col("_o")).alias("run_time")))


def plan_missing(requested: DataFrame, existing: DataFrame, keys: Sequence[str] = ("model", "run_time")) -> DataFrame:
    """Requested but not present (a set difference as an anti join)."""
    return requested.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def progress(requested: DataFrame, existing: DataFrame, keys: Sequence[str] = ("model", "run_time")) -> DataFrame:
    """Per model: requested, present (skipped), still to do, and percent done."""
    seen = existing.select(*keys).distinct().withColumn("_has", F.lit(True))
    marked = requested.join(seen, list(keys), "left")
    total, done = F.count(F.lit(1)), F.count("_has")
    return marked.groupBy("model").agg(total.alias("total"), done.alias("skipped"), (total - done).alias("todo"),
                                       F.bround(done / total * 100.0, 1).alias("done_pct"))


def yearly_coverage(existing: DataFrame, time: str = "run_time", per_day: int = 2) -> DataFrame:
    """Per year: snapshots present, expected, and whether the year is complete."""
    y = F.year(time)
    days = F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 366).otherwise(365)
    return (existing.select(time).distinct().groupBy(y.alias("year"))
            .agg(F.count(F.lit(1)).alias("present"), (F.max(days) * F.lit(per_day)).alias("expected"))
            .withColumn("complete", F.col("present") >= F.col("expected")))

"""Training splits, scaling and row budgets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvian.functions.skew import rows_below
from pluvian.operators.guards import assert_not_frozen, time_column


def chronological_split(df: DataFrame, time: str, key: Sequence[str], share: float = 0.7) -> DataFrame:
    """Adds `is_train`: the first floor(share * n) rows by (time, key), each in the order of its own type.

    No global sort. The rows per time give the cut time; the rows of that one time are cut by the first key column, the
    rows of that value by the next, and so on. Each step reads back one row (the cut value), so the split itself is a
    comparison with literals that can reach the scan. Rows equal in time and key stay together on the side of the first.
    """
    names = [time, *key]
    rows = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(names)])
    kinds = [f.dataType for f in rows.schema.fields]
    budget = math.floor(rows.count() * share)
    cuts: list[Column] = []
    part = rows
    for i, kind in enumerate(kinds):
        hist = part.groupBy(f"_o{i}").agg(F.count(F.lit(1)).alias("_n"))
        last = (rows_below(hist, [], f"_o{i}", "_n", "_before").where(F.col("_before") < budget)
                .agg(F.max(F.struct(f"_o{i}", "_before", "_n")).alias("c")).first())["c"]
        if last is None:
            return df.withColumn("is_train", F.lit(False))
        cuts.append(F.lit(last[f"_o{i}"]).cast(kind))
        budget -= last["_before"]
        if budget >= last["_n"]:
            break  # the cut falls between two values, so no tie is split
        part = part.where(F.col(f"_o{i}").eqNullSafe(cuts[-1]))
    inside = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(names[:len(cuts)])]) <= F.struct(
        *[v.alias(f"o{i}") for i, v in enumerate(cuts)])
    return df.withColumn("is_train", F.coalesce(inside, F.lit(False)))


def train_validation_split(df: DataFrame, key: Sequence[str], time: str | None = None, val_year: int = 2024) -> DataFrame:
    """Adds `is_train` and `is_val`: years before `val_year` against `val_year`.

    Falls back to the chronological 70/30 split when either side is empty. Raises when the frozen year is present. Runs one
    small aggregate to choose the branch.
    """
    c = time_column(df, time)
    if c is None:
        raise ValueError("a time column is needed to split")
    assert_not_frozen(df, c)
    start, end = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in (val_year, val_year + 1))
    train, val = F.col(c) < start, (F.col(c) >= start) & (F.col(c) < end)  # ranges, which reach the scan
    seen = df.agg(F.bool_or(train).alias("train"), F.bool_or(val).alias("val")).first()
    if seen["train"] and seen["val"]:
        return df.withColumns({"is_train": train, "is_val": val})
    return chronological_split(df, c, key).withColumn("is_val", ~F.col("is_train"))


def standardise(df: DataFrame, features: Sequence[str], train: str = "is_train") -> DataFrame:
    """(x - train mean) / train deviation for every row; missing is 0, a deviation under 1e-6 counts as 1.

    The statistics are one row, read as a scalar, so both splits are scaled without a join.
    """
    filled = {f: F.coalesce(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), F.lit(0.0))
              for f in features}
    stats = df.where(train).select([c.alias(f) for f, c in filled.items()]).agg(F.struct(
        *[F.avg(f).alias(f"{f}_m") for f in features], *[F.stddev_pop(f).alias(f"{f}_s") for f in features]).alias("s"))
    s = stats.select("s").scalar()

    def scaled(f: str):
        dev = s.getField(f"{f}_s")
        z = (filled[f] - s.getField(f"{f}_m")) / F.when(dev < 1e-6, F.lit(1.0)).otherwise(dev)
        return F.coalesce(F.when(~F.isnan(z), z), F.lit(0.0))
    return df.withColumns({f: scaled(f) for f in features})


def train_row_budget(df: DataFrame, max_rows: int, cycle: str = "run_time") -> DataFrame:
    """At most about `max_rows` training rows of a split table (`is_train`), as whole, evenly strided cycles.

    The bound is for the fit of a model only: rows that are not for training, and so every score, stay as they are. Reads the
    number of training cycles and the first one's size (two numbers).
    """
    sizes = df.where("is_train").groupBy(cycle).agg(F.count(F.lit(1)).alias("n"))
    seen = sizes.agg(F.count(F.lit(1)).alias("cycles"), F.min_by("n", cycle).alias("first")).first()
    if not seen["cycles"] or seen["cycles"] * seen["first"] <= max_rows:
        return df
    needed = min(seen["cycles"], max(1, -(-max_rows // max(1, seen["first"]))))
    stride = max(1, seen["cycles"] // needed)
    index = rows_below(sizes.withColumn("_one", F.lit(1)), [], cycle, "_one", "_i")
    chosen = index.where((F.col("_i") % stride == 0) & (F.col("_i") < stride * needed)).select(cycle)
    other = df.where(~F.col("is_train"))
    return df.where("is_train").join(chosen, cycle, "left_semi").select(*df.columns).unionByName(other)


def year_folds(df: DataFrame, folds: Sequence[tuple[int, int, int]] = ((2021, 2022, 2023), (2021, 2023, 2024)),
               time: str = "valid_time") -> DataFrame:
    """Expanding folds (P4): rows repeated per fold they belong to, marked train or validation.

    A fold is (first train year, last train year, validation year).
    """
    y = F.year(time)
    entries = [F.when(y.between(a, v), F.struct(F.lit(i + 1).alias("fold"), (y <= b).alias("is_train"),
                                                (y == v).alias("is_val")))
               for i, (a, b, v) in enumerate(folds)]
    return df.select("*", F.explode(F.array_compact(F.array(*entries))).alias("_f")).select(*df.columns, "_f.*")

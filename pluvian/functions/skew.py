"""Helpers that keep hot keys and global orders off a single task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvian.session import written

HOT_ROWS = 2_000_000
#: Rows of either side that one key of a `block_join` keeps together; a task looks at about the square of it in pairs.
BLOCK_ROWS = 4096


def salted_join(big: DataFrame, other: DataFrame, on: list[str], how: str = "inner",
                hot_rows: int | None = None) -> DataFrame:
    """Equi join that splits every key holding more than `hot_rows` rows of `big` (HOT_ROWS by default).

    Keys are counted with a map-side combine; only keys above the limit survive, so that table has at most
    |big| / hot_rows rows. Rows of a hot key get a salt from all their columns, and the matching rows of `other` are
    repeated once per salt. `inner` and `left` keep their meaning, because each row of `big` still meets each match
    exactly once.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    hot_rows = hot_rows or HOT_ROWS
    hot = (big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
           .select(*on, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_salts")))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), salts.cast("bigint")).cast("int")
    left = big.join(hot, on, "left").withColumn("_salt", spread).drop("_salts")
    right = (other.join(hot, on, "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - F.lit(1)))).drop("_salts"))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def block_join(left: DataFrame, right: DataFrame, on: list[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """Inner equi join for keys that both sides hold often, where the pairs are many and the rows read are few.

    A key with more than `rows` rows on a side is cut into blocks of about that many, and every block of one side meets every
    block of the other once; a row (by all its columns) is repeated once per block of the other side, so what is shuffled
    stays at one row in rows / 2 pairs, or at the input where keys are not crowded. Tasks are as many as the pairs need:
    Spark counts bytes, and would put the few rows of a large result into one task. They are never fewer than Spark's own
    number. The counts (one row per key) are worked out at once.
    """
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    counts = written(count(left, "_l").join(count(right, "_r"), on))
    pairs, most = counts.agg(F.sum(F.col("_l").cast("double") * F.col("_r")), F.max(F.greatest("_l", "_r"))).first()
    keys = list(on)
    if (most or 0) > rows:
        crowded = counts.where(F.greatest("_l", "_r") > rows).select(
            *on, *[F.ceil(F.col(c) / F.lit(rows)).cast("int").alias(c) for c in ("_l", "_r")])

        def cut(df: DataFrame, own: str, other: str) -> DataFrame:
            blocks, repeats = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
            mine = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), blocks.cast("bigint")).cast("int")
            return (df.join(crowded, on, "left")
                    .withColumns({f"_block{own}": mine, f"_block{other}": F.explode(F.sequence(F.lit(0), repeats - F.lit(1)))})
                    .drop("_l", "_r"))
        left, right = cut(left, "_l", "_r"), cut(right, "_r", "_l")
        keys += ["_block_l", "_block_r"]
    tasks = math.ceil((pairs or 0) / rows**2)
    if tasks > 1:
        tasks = max(tasks, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.join(right, keys).drop("_block_l", "_block_r")


def rows_below(hist: DataFrame, groups: list[str], order: str, count: str, out: str = "n_below") -> DataFrame:
    """Exact running count of smaller values inside each group, without ordering a group in one task.

    `hist` holds one row per (group, value) with its multiplicity. It is dealt by ranges of (group, value), as a global sort
    would, and stored with the number of its range, so every later step sees the same cut and the input is read once. Inside
    a range a window adds up; across ranges the totals (one row per group and range) are added and joined back. Works for any
    type that has an order; text is ordered as text.
    """
    tagged = written(hist.repartitionByRange(*groups, order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tagged.groupBy(*groups, "_range").agg(F.sum(count).alias("_n"))
               .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = Window.partitionBy(*groups, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (tagged.withColumn("_inside", F.coalesce(F.sum(count).over(inside), F.lit(0)))
            .join(offsets, [*groups, "_range"])
            .withColumn(out, F.col("_offset") + F.col("_inside")).drop("_range", "_offset", "_inside"))


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probs: list[float], out: str = "value",
                    label: str = "prob") -> DataFrame:
    """Linear-interpolation quantiles per group, exact, from the value histogram.

    One row per (group, prob). Each histogram value covers the 0-based ranks [n_below, n_below + n); a target position
    takes its lower and upper neighbour from the values covering those ranks.
    """
    hist = (df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
            .groupBy(*groups, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    ranked = rows_below(hist, groups, "_v", "_n", "_below")
    totals = hist.groupBy(*groups).agg(F.sum("_n").alias("_total"))
    targets = (totals.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
               .withColumn("_pos", F.col("_p") * (F.col("_total") - 1))
               .withColumn("_lo", F.floor("_pos").cast("bigint"))
               .withColumn("_hi", F.ceil("_pos").cast("bigint")))
    wanted = (targets.groupBy(*groups).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(
        F.array("_lo", "_hi"))))).alias("_ranks")))
    # a list of at most 2 * len(probs) ranks per group is matched by projection, so no value x target pairs arise
    joined = ranked.join(wanted, groups) if groups else ranked.withColumn("_ranks", wanted.select("_ranks").scalar())
    covered = joined.withColumn("_rank", F.explode(F.filter(
        F.col("_ranks"), lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_n")))))
    at = covered.select(*groups, "_rank", F.col("_v").cast("double").alias("_v"))
    low = at.select(*groups, F.col("_rank").alias("_lo"), F.col("_v").alias("_vlo"))
    high = at.select(*groups, F.col("_rank").alias("_hi"), F.col("_v").alias("_vhi"))
    frac = F.col("_pos") - F.col("_lo")
    return (targets.join(low, [*groups, "_lo"]).join(high, [*groups, "_hi"])
            .select(*groups, F.col("_p").alias(label),
                    (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * frac).alias(out)))


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the smallest under `order`.

    Uses `min_by`, which combines map-side, so a key with very many copies never lands in one sort.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = df.select(*keys, F.struct(*order).alias("_o"), F.struct(*rest).alias("_r"))
    return packed.groupBy(*keys).agg(F.min_by("_r", "_o").alias("_r")).select(*keys, "_r.*").select(*df.columns)

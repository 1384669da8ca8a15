"""Mixing sources to target weights by hash thresholds. [native]

Each document has a hash; a source's budget becomes the largest hash threshold whose documents fit it. Sizes are summed by
source and leading hash digit; running sums over those few buckets give the bucket in which a budget ends, and only that
bucket is summed again by the next digit. Documents are then kept by comparing their hash with the threshold: nothing is
sorted, and the thresholds of growing budgets are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvian.functions.skew import salted_join
from pluvian.llm.columns import own_names, words
from pluvian.session import written

#: Bits of the hash, read `DIGIT_BITS` at a time from the top.
HASH_BITS, DIGIT_BITS = 60, 12
#: Most sources whose thresholds are sent to every task, a name and four numbers each.
MOST_SENT = 10_000


def order_hash(key: Column, text: Column, seed: int) -> Column:
    """60 hash bits of the key; rows without a key are spread by their text."""
    name = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.concat(F.lit("#"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _named(source: Column) -> Column:
    """A join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def weighted(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """`weight` per source: `weights` dealt to the sources by code point, null last, again and again."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[F.pmod(place, F.lit(len(weights)))])


def capped_targets(sizes: DataFrame, share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """`target` per source: `share` of all sizes by weight, none above `cap` times its size, the excess reshared by weight.

    Resharing in closed form: rows in order of cap * size / weight reach their cap first. With the rows before it at their
    cap, a row and those behind share what is left by weight; the first row that so stays within its cap sets the level.
    The table has a row per source, so one task orders it.
    """
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    limit = F.lit(float(cap)) * F.col("source_size")
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(every)["_level"]
    return (sizes.withColumn("_limit", limit).withColumn("_ratio", F.col("_limit") / F.col("weight"))
            .withColumn("_level", left / F.sum("weight").over(rest))
            .withColumn("_share", level * F.col("weight"))
            .withColumn("target", F.least(F.coalesce("_share", "_limit"), F.col("_limit")))
            .drop("_limit", "_ratio", "_level", "_share"))


def thresholds(units: DataFrame, budgets: DataFrame) -> DataFrame:
    """`threshold` per (source, level): documents whose hash is at or below it are taken; -1 takes none.

    `units` has (source, size, h), `budgets` (source, level, budget). At each digit only the bucket that a budget ends in
    is summed again, so the rows summed shrink 4,096 times. Behind the last digit a single hash is left; it is taken if
    that comes nearer to the budget than leaving it.
    """
    top = F.lit((1 << HASH_BITS) - 1)
    open_ = budgets.select("source", "level", "budget", F.lit(0).cast("bigint").alias("prefix"), F.lit(0.0).alias("below"))
    whole = None
    for shift in range(HASH_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        ends_in = open_.select(F.col("source").alias("_source"), "prefix").distinct()
        digits = (units.join(ends_in, units["source"].eqNullSafe(F.col("_source"))
                             & (F.shiftright("h", shift + DIGIT_BITS) == F.col("prefix")), "left_semi")
                  .groupBy(F.col("source").alias("_source"), F.shiftright("h", shift).alias("_at"))
                  .agg(F.sum("size").cast("double").alias("_n")))
        running = Window.partitionBy("source", "level").orderBy("_at")
        steps = (open_.join(digits, F.col("source").eqNullSafe(F.col("_source"))
                            & (F.shiftright("_at", DIGIT_BITS) == F.col("prefix")))
                 .withColumn("_to", F.col("below") + F.sum("_n").over(running)))
        crossing = F.when(F.col("_to") > F.col("budget"), F.struct("_at", (F.col("_to") - F.col("_n")).alias("_from"), "_to"))
        ends = written(steps.groupBy("source", "level", "budget").agg(F.min(crossing).alias("_end")))
        fits = ends.where(F.col("_end").isNull()).select("source", "level", top.alias("threshold"))
        whole = fits if whole is None else whole.unionByName(fits)
        open_ = ends.where(F.col("_end").isNotNull()).select(
            "source", "level", "budget", F.col("_end._at").alias("prefix"), F.col("_end._from").alias("below"),
            F.col("_end._to").alias("_to"))
    nearer = F.col("_to") - F.col("budget") < F.col("budget") - F.col("below")
    return whole.unionByName(open_.select(
        "source", "level", (F.col("prefix") - F.when(nearer, 0).otherwise(1)).alias("threshold")))


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.0, cap: float = 3.0,
                seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """How often the mix takes each document: (key, size, source, source_size, target, copies, taken, then `carry`).

    A source whose target is r times its size takes every document floor(r) times, and once more those below the hash
    threshold of the rest. Null texts have size 0, null sources form one source of their own, rows with the same key (or,
    without a key, the same text) have one hash and are taken together, and a source of size 0 takes nothing. An empty
    table gives no rows. Columns beyond the named ones are ignored.
    """
    rows = own_names(docs, *dict.fromkeys([key, text, source, *carry]))
    units = written(rows.select(F.col(key).alias("key"), F.col(source).alias("source"),
                                F.size(words(F.col(text))).cast("bigint").alias("size"),
                                order_hash(F.col(key), F.col(text), seed).alias("h"), *carry))
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = written(capped_targets(weighted(sizes, weights), share, cap)
                   .withColumn("full", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("bigint")))
    budgets = plan.select("source", F.col("full").alias("level"),
                          (F.col("target") - F.col("full") * F.col("source_size")).alias("budget"))
    cut = thresholds(units.select("source", "size", "h"), budgets).select(F.col("source").alias("_source"), "threshold")
    per = written(plan.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        _named(F.col("source")).alias("_name"), "source_size", "target", "full",
        F.coalesce("threshold", F.lit(-1)).alias("threshold")))
    rows = units.withColumn("_name", _named(F.col("source")))
    # a few sources go to every task, so that documents stay where they are; a long list of sources is joined by salted key
    taken = (rows.join(F.broadcast(per), "_name") if per.count() <= MOST_SENT else salted_join(rows, per, ["_name"]))
    copies = F.col("full") + (F.col("h") <= F.col("threshold")).cast("bigint")
    return taken.select(F.col("key").alias(key), "size", "source", "source_size", "target", copies.alias("copies"),
                        (copies * F.col("size")).alias("taken"), *carry)

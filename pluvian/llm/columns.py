"""Column helpers that the text operators share. All are plain expressions; none runs Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` worked out once, however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column], zero: Column, block: int = 64) -> Column:
    """Results of `combine` from `zero` up to each element of an array, in a time that hardly grows faster than the array.

    Appending to one array for every element would copy it each time; here only arrays of `block` elements, and one of a
    `block`-th of the length, grow that way.
    """
    def both(x: Column, y: Column) -> Column:
        return combine(x, y)

    def grown(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda a, x: F.concat(a, F.array(both(F.element_at(a, F.lit(-1)), x))))

    def whole(v: Column) -> Column:
        def part(b: Column) -> Column:
            return F.slice(v, b * block + 1, F.lit(block))
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))
        totals = F.transform(blocks, lambda b: F.aggregate(part(b), zero, both))
        return let(grown(totals, zero), lambda starts: F.flatten(F.transform(
            blocks, lambda b: F.slice(grown(part(b), F.get(starts, b)), F.lit(2), F.lit(block)))))
    return F.when(F.size(values) == 0, F.slice(values, 1, 0)).otherwise(let(values, whole))


def words(text: Column) -> Column:
    """Runs of characters other than space and \\t to \\r, in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def own_names(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, by exact name; a missing one is an error, extra ones cannot clash with what is added."""
    return df.select(*[df[f"`{n}`"] for n in names])


def with_row(df: DataFrame, *names: str) -> DataFrame:
    """All columns packed into `_row`, beside the named ones: rows pass an operator whole, whatever their columns are called."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"), *[df[f"`{n}`"] for n in dict.fromkeys(names)])


def identity(key: Column, text_hash: Column) -> Column:
    """64 bits that rows with the same key and text share; null keys count as equal."""
    return F.xxhash64(key, text_hash)


def ln_gamma(x: Column) -> Column:
    """Natural log of the gamma function for x >= 1: Stirling's series past x + 8, the product of eight factors below it."""
    z = x + F.lit(8.0)
    low = x
    for k in range(1, 8):
        low = low * (x + F.lit(float(k)))
    series = (F.lit(1 / 12) / z - F.lit(1 / 360) / F.pow(z, F.lit(3.0)) + F.lit(1 / 1260) / F.pow(z, F.lit(5.0))
              - F.lit(1 / 1680) / F.pow(z, F.lit(7.0)))
    return (z - 0.5) * F.log(z) - z + F.lit(0.9189385332046727) + series - F.log(low)


def normal_tail(z: Column) -> Column:
    """P(N(0, 1) >= z): the rational approximation 26.2.17 of Abramowitz and Stegun, absolute error below 1e-7."""
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937)
                + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    upper = F.exp(-a * a / 2) * F.lit(0.3989422804014327) * poly
    return F.when(z >= 0, upper).otherwise(F.lit(1.0) - upper)

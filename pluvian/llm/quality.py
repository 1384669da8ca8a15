"""Quality rules with risk-controlled cutoffs. [native]

A rule rejects a document when one of its measures passes a cutoff. Cutoffs come from labelled documents: along a fixed
grid, from the laxest cutoff on, the number of good documents a cutoff would reject is tested with the exact binomial tail
against the allowed rate. The walk stops at the first cutoff that fails, so a grid costs no correction (fixed-sequence
testing); rules and strata are corrected by Bonferroni. With probability 1 - `delta`, in every stratum at once, the rules
together reject at most a share `alpha` of good documents. Strata with too few labels get no cutoff and reject nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvian.llm.columns import let, ln_gamma, own_names, words
from pluvian.session import written

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Rejects documents whose `measure` is above a cutoff (`high`) or below it, out of `steps` equal steps of [low, top]."""

    name: str
    measure: str
    low: float
    top: float
    high: bool = True
    steps: int = 100


RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", 0.0, 1.0),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", 0.0, 1.0),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", 0.0, 1.0),
    Rule("long_words", "word_chars / greatest(n_words, 1)", 0.0, 20.0),
    Rule("short_words", "word_chars / greatest(n_words, 1)", 0.0, 20.0, high=False),
)


def repeated_words(ws: Column, window: int = WINDOW) -> Column:
    """Number of words inside windows of `window` words that occur twice or more in the array."""

    def covered(hashes: Column) -> Column:
        def starts(pairs: Column) -> Column:
            def again(p: Column, k: Column) -> Column:
                return (p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"])
            return F.array_sort(F.transform(F.filter(pairs, lambda p, k: F.coalesce(again(p, k), F.lit(False))),
                                            lambda p: p["i"]))

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        total = F.aggregate(let(pairs, starts), zero, lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last")))["n"]
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total)

    def hashes(wh: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(wh) - (window - 1)), lambda i: F.xxhash64(F.slice(wh, i, window)))

    found = let(let(F.transform(ws, lambda w: F.xxhash64(w)), hashes), covered)
    return F.when(F.size(ws) <= window, F.lit(0)).otherwise(found).cast("bigint")


def profile(text: Column) -> Column:
    """Struct of the counts the rules use, from the whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("bigint").alias("n_words"),
            F.aggregate(ws, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)).alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"),
                                          (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))).alias("l"),
            repeated_words(ws).alias("n_repeat_words"),
        )
    return let(words(text), counts)


def measured(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """`keys` and the counts of every document, stored once: the only pass over the texts."""
    kept = own_names(docs, *dict.fromkeys([*keys, text]))
    wide = written(kept.select(*keys, profile(F.col(text)).alias("p")))
    return wide.select(*keys, "p.n_words", "p.word_chars", "p.n_symbols", F.col("p.l.n").alias("n_lines"),
                       F.col("p.l.dup").alias("n_dup_lines"), "p.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def step_of(rule: Rule) -> Column:
    """Grid step of a document under a rule: the larger, the nearer to rejection. Cutoff c rejects steps above c."""
    share = (F.expr(rule.measure).cast("double") - rule.low) / (rule.top - rule.low)
    at = F.least(F.greatest(F.floor(share * rule.steps), F.lit(0)), F.lit(rule.steps)).cast("int")
    return at if rule.high else F.lit(rule.steps) - at


def binomial_cdf(k: Column, n: Column, p: float, terms: int = 5000) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), from the largest term down; 1 when k >= n p, which no test below 1/2 passes.

    Below n p the terms shrink at a growing pace. Past `terms` of them the rest is replaced by its geometric upper bound,
    so the value never errs to the small side.
    """
    k, n = k.cast("double"), n.cast("double")
    log_top = (ln_gamma(n + 1) - ln_gamma(k + 1) - ln_gamma(n - k + 1) + k * F.log(F.lit(p))
               + (n - k) * F.log(F.lit(1 - p)))
    odds = (1 - p) / p
    ratio = lambda i: i / (n - i + 1) * odds  # noqa: E731  of the term at i - 1 to that at i
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    steps = F.sequence(F.lit(0), F.least(k, F.lit(float(terms))).cast("int"))

    def add(a: Column, j: Column) -> Column:
        t = a["t"] * ratio(k - j)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    def closed(a: Column) -> Column:
        r = ratio(F.greatest(k - terms - 1, F.lit(0.0)))
        return a["s"] + F.coalesce(F.try_divide(a["t"] * r, 1 - r), F.lit(0.0))
    total = let(F.aggregate(steps, start, add), closed)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(log_top) * total)


def risk_cutoffs(holdout: DataFrame, stratum: str, good: str, rules: tuple[Rule, ...] = RULES, alpha: float = 0.02,
                 delta: float = 0.05) -> DataFrame:
    """One row (stratum, rule, cutoff) per certified rule. `holdout` has a row per labelled document with its counts.

    Rows are folded into a histogram of at most strata x rules x steps cells first, so no group grows with the data.
    """
    cells = (holdout.where(F.col(good))
             .select(F.col(stratum).alias("stratum"), F.explode(F.array(*[
                 F.struct(F.lit(r.name).alias("rule"), step_of(r).alias("step")) for r in rules])).alias("c"))
             .groupBy("stratum", "c.rule", "c.step").agg(F.count(F.lit(1)).alias("n")))
    each = Window.partitionBy("stratum", "rule")
    above = each.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tests = cells.select("stratum", "rule", "step", F.sum("n").over(each).alias("total"),
                         F.coalesce(F.sum("n").over(above), F.lit(0)).alias("rejected"))
    strata = cells.agg(F.count_distinct(F.coalesce(F.concat(F.lit("="), F.col("stratum").cast("string")), F.lit("")))
                       .alias("v")).select("v").scalar()
    p = binomial_cdf(F.col("rejected"), F.col("total"), alpha / len(rules))
    # a cutoff at an observed step rejects the same good documents as any finer one up to the next observed step
    return (tests.where(p <= F.lit(delta) / (strata * F.lit(float(len(rules)))))
            .groupBy("stratum", "rule").agg(F.min("step").alias("cutoff")))


def judged(counts: DataFrame, cutoffs: DataFrame, stratum: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`counts` with `base_failed`, `rules_hit` (names, in rule order) and `kept`.

    `cutoffs` is folded to one row per stratum and joined; a null stratum is a stratum of its own.
    """
    per = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(*[
        F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"_cut_{r.name}") for r in rules])
    hits = F.array_compact(F.array(*[F.when(step_of(r) > F.col(f"_cut_{r.name}"), F.lit(r.name)) for r in rules]))
    return (counts.join(per, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
            .select(*counts.columns, base_failed().alias("base_failed"), hits.alias("rules_hit"))
            .withColumn("kept", ~F.col("base_failed") & (F.size("rules_hit") == 0)))


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
                  alpha: float = 0.02, delta: float = 0.05, rules: tuple[Rule, ...] = RULES,
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts and verdict of every document, with its key, stratum and the columns to `carry`.

    `labels` has `key` and `quality`; a document is good if any label says 1, unlabelled if its labels are all null. Null
    or empty texts have no words and fail the base rule; a null key has no label; repeated rows are judged one by one and
    each counts in the holdout; no labels at all means that only the base rule rejects. Columns beyond the named ones are
    ignored.
    """
    counts = measured(docs, [key, stratum, *carry], text)
    known = (own_names(labels, key, "quality").where(F.col("quality").isNotNull() & F.col(key).isNotNull())
             .groupBy(F.col(key).alias("_key")).agg((F.max("quality") == 1).alias("_good")))
    holdout = counts.drop(*carry).join(known, F.col(key) == F.col("_key"))
    cutoffs = written(risk_cutoffs(holdout, stratum, "_good", rules, alpha, delta))
    return judged(counts, cutoffs, stratum, rules)

"""Forecast verification.

Everything a report needs is a sum, a minimum or a maximum, so the verification rows are read once: `score_cells` folds
them into mergeable cells at the finest grain asked for, and each report rolls the cells up by its own keys. Thresholds
are columns of the cells, never extra rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvian.functions import constants as K
from pluvian.functions.scalars import clip, finite, safe_ratio, season
from pluvian.functions.skew import exact_quantiles, rows_below, salted_join
from pluvian.session import written

TINY = 1e-9


# ---- shape ----

def variants_long(wide: DataFrame, variants: Sequence[tuple[str, str, str]], keep: Sequence[str],
                  observed: str = "observed_rain", raw: str = "nwp_raw_rain") -> DataFrame:
    """One row per (forecast, model variant): variants are (model, ablation, column).

    The explode happens inside the scan stage and is folded by the map-side combine that follows.
    """
    entries = [F.struct(F.lit(m).alias("model"), F.lit(a).alias("ablation"), F.col(c).cast("double").alias("pred"))
               for m, a, c in variants]
    return (wide.select(*keep, F.col(observed).cast("double").alias("obs"), F.col(raw).cast("double").alias("raw"),
                        F.explode(F.array(*entries)).alias("_v"))
            .select(*keep, "obs", "raw", "_v.*"))


def align_variants(base: DataFrame, predictions: DataFrame, keys: Sequence[str], order: Sequence[str],
                   raw: str = "nwp_raw_rain", value: str = "corrected_rain") -> DataFrame:
    """Every base row meets every variant seen in `predictions`; a missing prediction falls back to the raw forecast.

    Duplicate predictions keep the first under `order`. The result says which values were imputed.
    """
    from pluvian.functions.skew import first_row
    names = ["model", "ablation"]
    preds = first_row(predictions.select(*keys, *names, F.col(value).alias("_pred"), *[
        c for c in order if c not in keys and c not in names and c != value]), [*keys, *names],
        [F.col(c) for c in order]).select(*keys, *names, "_pred")
    # variants form a bounded list (architectures x ablations): one array value, attached by projection
    listed = predictions.select(*names).distinct().agg(
        F.array_sort(F.collect_list(F.struct(*names))).alias("v")).select("v").scalar()
    full = base.withColumn("_v", F.explode(listed)).select(*base.columns, "_v.*")
    return (full.join(preds, [*keys, *names], "left")
            .withColumn("imputed", F.col("_pred").isNull())
            .withColumn("pred", F.coalesce("_pred", F.col(raw))).drop("_pred"))


# ---- mergeable cells ----

def tag(threshold: float) -> str:
    return f"{threshold:g}".replace(".", "p")


def score_cells(long: DataFrame, keys: Sequence[str], thresholds: Sequence[float] = K.RAIN_THRESHOLDS) -> DataFrame:
    """Sufficient statistics per key: one pass, combined map-side.

    Continuous sums need finite obs, pred and raw; the contingency counts need finite obs and pred only.
    """
    pair, triple = finite("obs", "pred"), finite("obs", "pred", "raw")
    # unusable values become NULL once, so every aggregate below is a plain skip-missing sum
    usable = long.select(
        *keys, F.when(triple, F.col("obs")).alias("o"), F.when(triple, F.col("pred")).alias("p"),
        F.when(triple, F.col("pred") - F.col("obs")).alias("e"), F.when(triple, F.col("raw") - F.col("obs")).alias("re"),
        F.when(pair, F.col("obs")).alias("po"), F.when(pair, F.col("pred")).alias("pp"),
        F.when(pair, F.least("obs", "pred")).alias("both"))
    o, p, e, re = F.col("o"), F.col("p"), F.col("e"), F.col("re")
    aggs = [
        F.count("e").alias("n"), F.count("po").alias("n_pair"),
        F.sum(e).alias("s_err"), F.sum(F.abs(e)).alias("s_abs"), F.sum(e * e).alias("s_sq"),
        F.sum(F.abs(re)).alias("s_raw_abs"), F.sum(re * re).alias("s_raw_sq"),
        F.sum(o).alias("s_o"), F.sum(p).alias("s_p"), F.sum(o * o).alias("s_oo"), F.sum(p * p).alias("s_pp"),
        F.sum(o * p).alias("s_op"), F.min(o).alias("min_o"), F.max(o).alias("max_o"), F.min(p).alias("min_p"),
        F.max(p).alias("max_p"),
    ]
    for t in thresholds:
        # observed events, warned events and hits (both sides reach t when the smaller one does)
        aggs += [F.count_if(F.col(c) >= F.lit(float(t))).alias(f"{name}_{tag(t)}")
                 for name, c in (("o", "po"), ("w", "pp"), ("h", "both"))]
    return usable.groupBy(*keys).agg(*aggs)


def roll_up(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge cells into coarser ones."""
    sums = [c for c in cells.columns if c.startswith(("s_", "o_", "w_", "h_")) or c in ("n", "n_pair")]
    if set(cells.columns) - set(sums) - {"min_o", "max_o", "min_p", "max_p"} == set(keys):
        return cells  # already at this grain
    return cells.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.min(c).alias(c) for c in ("min_o", "min_p")], *[F.max(c).alias(c) for c in ("max_o", "max_p")])


def roll_up_sets(cells: DataFrame, sets: dict[str, Sequence[str]]) -> DataFrame:
    """Merge cells into several coarser grains at once: `grain` names the set of keys, keys outside a set are NULL.

    One aggregation over grouping sets, so all grains come from a single exchange; `grouping_id` tells the sets apart, also
    where a key itself is NULL.
    """
    names = list(dict.fromkeys(k for keys in sets.values() for k in keys))
    measures = [F.sum(c).alias(c) for c in cells.columns if c.startswith(("s_", "o_", "w_", "h_")) or c in ("n", "n_pair")]
    measures += [F.min(c).alias(c) for c in ("min_o", "min_p")] + [F.max(c).alias(c) for c in ("max_o", "max_p")]
    number = {sum(1 << (len(names) - 1 - i) for i, k in enumerate(names) if k not in keys): grain for grain, keys in sets.items()}
    if len(number) < len(sets):
        raise ValueError("two grains have the same keys")
    grain = F.try_element_at(F.create_map(*[F.lit(x) for pair in number.items() for x in pair]), F.grouping_id().cast("int"))
    merged = cells.groupingSets([[F.col(k) for k in keys] for keys in sets.values()], *[F.col(k) for k in names])
    return merged.agg(*measures, grain.alias("grain"))


def grain_of(rolled: DataFrame, grain: str, keys: Sequence[str]) -> DataFrame:
    """The cells of one grain of `roll_up_sets`; `roll_up` takes them as they are."""
    measures = [c for c in rolled.columns if c.startswith(("s_", "o_", "w_", "h_", "min_", "max_")) or c in ("n", "n_pair")]
    return rolled.where(F.col("grain") == grain).select(*keys, *measures)


# ---- scores from cells ----

def continuous_columns() -> dict[str, Column]:
    """Error, correlation and skill columns of a cell; NULL where the cell has no usable row."""
    n = F.col("n")
    some = n > 0
    rmse, mae = F.sqrt(F.try_divide(F.col("s_sq"), n)), F.try_divide(F.col("s_abs"), n)
    raw_rmse, raw_mae = F.sqrt(F.try_divide(F.col("s_raw_sq"), n)), F.try_divide(F.col("s_raw_abs"), n)
    var_o = F.col("s_oo") * n - F.col("s_o") * F.col("s_o")
    var_p = F.col("s_pp") * n - F.col("s_p") * F.col("s_p")
    cov = F.col("s_op") * n - F.col("s_o") * F.col("s_p")
    spread = (varies("o", var_o) & varies("p", var_p))

    def skill(ours: Column, base: Column) -> Column:
        return F.when(some, F.when(base > TINY, (F.lit(1.0) - ours / base) * F.lit(100.0)).otherwise(F.lit(0.0)))

    return {
        "rmse": rmse, "mae": mae,
        "ratio": F.when(some, F.when(mae > TINY, rmse / mae).otherwise(F.lit(1.0))),
        "mbe": F.try_divide(F.col("s_err"), n),
        "pearson_r": F.when(some, F.when(spread, cov / (F.sqrt(var_o) * F.sqrt(var_p))).otherwise(F.lit(0.0))),
        "ss_rmse": skill(rmse, raw_rmse), "ss_mae": skill(mae, raw_mae),
    }


def varies(side: str, scaled_var: Column) -> Column:
    """Population deviation above the limit; a constant column is told by its extremes, not by cancelled sums."""
    return ((F.col(f"max_{side}") - F.col(f"min_{side}") > TINY)
            & (scaled_var > F.lit(TINY * TINY) * F.col("n") * F.col("n")))


def contingency_columns(threshold: float) -> dict[str, Column]:
    """Two-by-two table scores of a cell at one threshold."""
    wet, warned, h = (F.col(f"{x}_{tag(threshold)}") for x in "owh")
    m, f, any_event = wet - h, warned - h, wet + warned - h
    pod = safe_ratio(h * F.lit(100.0), wet, 0.0)
    far = safe_ratio(f * F.lit(100.0), warned, 0.0)
    return {
        "hits": h, "misses": m, "false_alarms": f, "correct_negatives": F.col("n_pair") - any_event,
        "pod": pod, "far": far, "miss_rate": F.when(wet > 0, F.lit(100.0) - pod).otherwise(F.lit(0.0)),
        "csi": safe_ratio(h, any_event, 0.0),
        # harmonic mean of precision and recall, written with counts
        "f1": safe_ratio(F.lit(2.0) * h, wet + warned, 0.0),
        "success_ratio": F.lit(1.0) - far / F.lit(100.0),
        "frequency_bias": safe_ratio(warned, wet, 1.0),
        "total_cases": F.col("n_pair"),
    }


def pick(columns: dict[str, Column], names: Sequence[str], suffix: str = "") -> list[Column]:
    return [columns[n].alias(n + suffix) for n in names]


def threshold_rows(cells: DataFrame, keys: Sequence[str], names: Sequence[str],
                   thresholds: Sequence[float] = K.RAIN_THRESHOLDS) -> DataFrame:
    """One row per (key, threshold), from the already folded cells."""
    per = [F.struct(F.lit(float(t)).alias("threshold"), *pick(contingency_columns(t), names)) for t in thresholds]
    return cells.select(*keys, F.explode(F.array(*per)).alias("_t")).select(*keys, "_t.*")


# ---- rank correlation and quantiles ----

def spearman(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank correlation per key with average ranks for ties; 0 where either side is constant.

    Average rank of a value = rows below it + (its copies + 1) / 2, taken from the value histogram, so no group is ever
    sorted in one task.
    """
    keys = list(keys)
    rows = long.where(finite("obs", "pred", "raw"))
    # copies of the same (obs, pred) fold into one weighted row before anything is shuffled further
    pairs = written(rows.groupBy(*keys, "obs", "pred").agg(F.count(F.lit(1)).alias("_w")))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("_side"), F.col(s).alias("_v")) for s in ("obs", "pred")]))
    hist = pairs.select(*keys, "_w", sides.alias("_s")).groupBy(*keys, "_s._side", "_s._v").agg(F.sum("_w").alias("_n"))
    ranks = rows_below(hist, [*keys, "_side"], "_v", "_n", "_below").withColumn(
        "_rank", F.col("_below") + (F.col("_n") + 1) / F.lit(2.0))

    def rank_of(side: str) -> DataFrame:
        return ranks.where(F.col("_side") == side).select(*keys, F.col("_v").alias(side), F.col("_rank").alias(f"_r_{side}"))

    # most rain is zero, so one value of `obs` may hold most pairs of a key
    ranked = salted_join(salted_join(pairs, rank_of("obs"), [*keys, "obs"]), rank_of("pred"), [*keys, "pred"])
    w, ro, rp = F.col("_w"), F.col("_r_obs"), F.col("_r_pred")
    sums = ranked.groupBy(*keys).agg(
        F.sum(w).alias("_t"), F.sum(w * ro * rp).alias("_op"), F.sum(w * ro * ro).alias("_oo"), F.sum(w * rp * rp).alias("_pp"),
        ((F.max(ro) > F.min(ro)) & (F.max(rp) > F.min(rp))).alias("_varies"))
    # the mean rank is (n + 1) / 2 on both sides
    square = F.col("_t") * F.pow((F.col("_t") + 1) / F.lit(2.0), F.lit(2.0))
    rho = (F.col("_op") - square) / (F.sqrt(F.col("_oo") - square) * F.sqrt(F.col("_pp") - square))
    return sums.select(*keys, F.when(F.col("_varies"), rho).otherwise(F.lit(0.0)).alias("spearman_rho"))


def qq_pairs(df: DataFrame, keys: Sequence[str], observed: str, predicted: str, points: int = 50) -> DataFrame:
    """Matched percentiles 1..99 of observations and predictions (exact, linear interpolation)."""
    probs = [(1.0 + 98.0 * i / (points - 1)) / 100.0 for i in range(points)]
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.col(c).cast("double").alias("v"))
                                for n, c in (("obs", observed), ("pred", predicted))]))
    stacked = df.where(finite(observed, predicted)).select(*keys, sides.alias("_s")).select(*keys, "_s.*")
    q = exact_quantiles(stacked, [*keys, "side"], "v", probs, "q")
    return q.groupBy(*keys, "prob").agg(*[F.max(F.when(F.col("side") == n, F.col("q"))).alias(f"q_{n}")
                                          for n in ("obs", "pred")])


# ---- reports ----

CROSS_SCORES = ["rmse", "mae", "ratio", "ss_rmse", "ss_mae", "mbe", "pearson_r"]


def leaderboard(cells: DataFrame, long: DataFrame | None = None) -> DataFrame:
    """Cross-model table with 10 and 20 mm scores, ranked by skill. `long` adds the rank correlation."""
    keys = ["model", "ablation"]
    merged = roll_up(cells, keys)
    ten, twenty = contingency_columns(10.0), contingency_columns(20.0)
    out = merged.select(*keys, *pick(continuous_columns(), CROSS_SCORES),
                        *pick(ten, ["pod", "far", "miss_rate", "csi"], "_10mm"),
                        *pick(twenty, ["pod", "far", "csi"], "_20mm"))
    if long is not None:
        out = out.join(spearman(long, keys), keys, "left")
    # one row per model variant, so a single ordered partition is a fixed small list
    by_skill = Window.orderBy(F.col("ss_rmse").desc_nulls_last(), "model", "ablation")
    return out.withColumn("skill_rank", F.row_number().over(by_skill))


def by_lead(cells: DataFrame) -> DataFrame:
    keys = ["lead_time", "model", "ablation"]
    return roll_up(cells, keys).select(
        *keys, "n", *pick(continuous_columns(), ["rmse", "mae", "ratio", "ss_rmse", "ss_mae"]),
        *pick(contingency_columns(10.0), ["csi", "pod"], "_10mm"))


def by_month(cells: DataFrame) -> DataFrame:
    keys = ["month", "model", "ablation"]
    return roll_up(cells, keys).select(*keys, season("month").alias("season"), *pick(
        continuous_columns(), ["rmse", "mae", "ratio", "ss_rmse", "ss_mae"]))


def by_month_threshold(cells: DataFrame) -> DataFrame:
    keys = ["month", "model", "ablation"]
    return threshold_rows(roll_up(cells, keys), keys, ["pod", "far", "miss_rate", "csi", "f1"]) \
        .withColumn("season", season("month"))


def intensity_table(cells: DataFrame) -> DataFrame:
    keys = ["model", "ablation"]
    return threshold_rows(roll_up(cells, keys), keys, [
        "hits", "misses", "false_alarms", "correct_negatives", "pod", "far", "miss_rate", "csi", "f1",
        "frequency_bias"])


def heavy_rain_table(cells: DataFrame) -> DataFrame:
    keys = ["model", "ablation"]
    columns = []
    for t in (10.0, 20.0):
        c = contingency_columns(t)
        columns += pick(c, ["pod", "far", "miss_rate"], f"_{t:.0f}mm") + [c["misses"].alias(f"missed_count_{t:.0f}mm")]
    return roll_up(cells, keys).select(*keys, *columns)


def generalization_gap(cells: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Hold-out minus in-network scores; a side without rows gives NULL, never a made-up sample."""
    keys = [*extra_keys, "model", "ablation"]
    scored = roll_up(cells, [*keys, "is_holdout"]).select(
        *keys, "is_holdout", *pick(continuous_columns(), ["rmse", "mae"]),
        *pick(contingency_columns(10.0), ["csi", "pod"]))

    def side(name: str, flag: bool) -> Column:
        return F.max(F.when(F.col("is_holdout") == F.lit(flag), F.col(name)))

    out = scored.groupBy(*keys).agg(
        *[side(s, flag).alias(f"{tier}_{s}") for tier, flag in (("innet", False), ("holdout", True))
          for s in ("rmse", "mae", "csi", "pod")])
    return out.withColumns({f"delta_{s}": F.col(f"holdout_{s}") - F.col(f"innet_{s}") for s in ("rmse", "mae")}) \
        .withColumnsRenamed({f"{t}_{s}": f"{t}_{s}_10" for t in ("innet", "holdout") for s in ("csi", "pod")})


def basin_table(cells: DataFrame, ablation: str = "m3") -> DataFrame:
    keys = ["basin_id", "model", "ablation"]
    return roll_up(cells.where(F.col("ablation") == ablation), keys).select(
        *keys, *pick(continuous_columns(), ["rmse", "mae", "ss_rmse", "ss_mae"]),
        *pick(contingency_columns(10.0), ["csi"], "_10mm"))


def basin_best(cells: DataFrame, model_order: Sequence[str], baseline: tuple[str, str],
               ablation: str = "m3") -> DataFrame:
    """Best model of each basin by RMSE skill; among equals the first in `model_order`."""
    table = basin_table(cells.where(F.col("model").isin(list(model_order))), ablation)
    place = F.array_position(F.array(*[F.lit(m) for m in model_order]), F.col("model"))
    best = (table.where(F.col("ss_rmse").isNotNull())
            .groupBy("basin_id").agg(F.max_by(F.struct("model", "rmse", "ss_rmse"),
                                              F.struct("ss_rmse", -place)).alias("_b")))
    raw = (roll_up(cells.where((F.col("model") == baseline[0]) & (F.col("ablation") == baseline[1])), ["basin_id"])
           .select("basin_id", continuous_columns()["rmse"].alias("raw_rmse"),
                   continuous_columns()["mae"].alias("raw_mae")))
    return raw.join(best, "basin_id", "left").select(
        "basin_id", "raw_rmse", "raw_mae", F.col("_b.model").alias("best_model"),
        F.col("_b.rmse").alias("best_rmse"), F.col("_b.ss_rmse").alias("best_ss_rmse"))


def ablation_matrix(cells: DataFrame, models: Sequence[str], baseline: tuple[str, str],
                    ablations: Sequence[str] = ("m1", "m2", "m3")) -> DataFrame:
    """One row per model with raw and M1..M3 columns; the best variant is computed."""
    wanted = F.col("model").isin(list(models)) & F.col("ablation").isin(list(ablations))
    scored = roll_up(cells.where(wanted), ["model", "ablation"]).select(
        "model", "ablation", *pick(continuous_columns(), ["rmse", "mae", "ss_rmse"]))

    def at(a: str, s: str) -> Column:
        return F.max(F.when(F.col("ablation") == a, F.col(s)))

    wide = scored.groupBy("model").agg(
        *[at(a, s).alias(f"{a}_{s}") for a in ablations for s in ("rmse", "mae", "ss_rmse")],
        F.max_by("ablation", F.struct("ss_rmse", F.col("ablation"))).alias("best_variant"),
        F.max("ss_rmse").alias("max_ss_rmse"))
    raw = roll_up(cells.where((F.col("model") == baseline[0]) & (F.col("ablation") == baseline[1])), []).select(
        continuous_columns()["rmse"].alias("r")).select("r").scalar()
    return wide.withColumn("raw_rmse", raw).withColumn("raw_ss_rmse", F.lit(0.0))


def against_baseline(cells: DataFrame, baseline: tuple[str, str]) -> DataFrame:
    """Raw-model comparison with the percentage change against the baseline model's row."""
    keys = ["model", "ablation"]
    scored = roll_up(cells, keys).select(*keys, *pick(continuous_columns(), ["rmse", "mae", "ratio", "ss_rmse"]),
                                         *pick(contingency_columns(10.0), ["pod", "csi"], "_10mm"))
    base = scored.where((F.col("model") == baseline[0]) & (F.col("ablation") == baseline[1]))
    base_rmse = base.select("rmse").scalar()
    return scored.withColumn("rmse_change_pct", F.when(base_rmse > 0, (base_rmse - F.col("rmse")) / base_rmse
                                                       * F.lit(100.0)))


def performance_points(board: DataFrame, ablations: Sequence[str] = ("m3", "raw", "raw_nwp")) -> DataFrame:
    """Performance-diagram coordinates at 10 mm."""
    sr, pod = (F.lit(100.0) - F.col("far_10mm")) / F.lit(100.0), F.col("pod_10mm") / F.lit(100.0)
    csi = F.when((sr > 0) & (pod > 0), F.lit(1.0) / (F.lit(1.0) / sr + F.lit(1.0) / pod - F.lit(1.0)))
    return board.where(F.col("ablation").isin(list(ablations))).select(
        "model", "ablation", sr.alias("success_ratio"), pod.alias("pod"), csi.alias("csi"))


def split_report(predictions: DataFrame, observed: str = "observed_rain", raw: str = "nwp_raw_rain",
                 corrected: str = "corrected_rain", keys: Sequence[str] = ()) -> DataFrame:
    """Validation RMSE before and after the correction, with the percentage gained."""
    long = predictions.select(*keys, F.col(observed).cast("double").alias("obs"),
                              F.col(raw).cast("double").alias("raw"), F.col(corrected).cast("double").alias("pred"))
    cells = score_cells(long, list(keys), [])
    c = continuous_columns()
    raw_rmse = F.sqrt(F.try_divide(F.col("s_raw_sq"), F.col("n")))
    return cells.select(*keys, "n", raw_rmse.alias("raw_rmse"), c["rmse"].alias("corrected_rmse"),
                        F.when(F.col("n") > 0, F.when(raw_rmse > 0, (raw_rmse - c["rmse"]) / raw_rmse * F.lit(100.0))
                               .otherwise(F.lit(0.0))).alias("skill_pct"))


# ---- chart-ready tables ----

def variant_label(model: Column, ablation: Column, weather_model: Column) -> Column:
    """Display text of a model variant."""
    shown = F.try_element_at(F.create_map(*[F.lit(x) for kv in K.MODEL_LABELS.items() for x in kv]), weather_model)
    raw = (ablation == "raw") | model.contains("raw")
    return (F.when(shown.isNotNull() & raw, F.concat(shown, F.lit(" (Raw)")))
            .when(shown.isNotNull(), F.concat(shown, F.lit(" + ML ("), F.upper(ablation), F.lit(")")))
            .when(model.contains("raw_"), F.concat(F.upper(F.regexp_replace(model, "raw_", "")), F.lit(" (Raw)")))
            .otherwise(F.concat(F.upper(model), F.lit(" ("), F.upper(ablation), F.lit(")"))))


def skill_series(board: DataFrame) -> DataFrame:
    """Bars of the skill chart: one per label (first by rank), with their order."""
    wm = F.col("weather_model") if "weather_model" in board.columns else F.lit(None).cast("string")
    labelled = (board.where(F.col("model") != "baseline_b0")
                .select(variant_label(F.col("model"), F.col("ablation"), wm).alias("label"), "ss_rmse", "ss_mae",
                        "rmse", "skill_rank"))
    one = labelled.groupBy("label").agg(F.min_by(F.struct("ss_rmse", "ss_mae", "rmse"), "skill_rank").alias("_r"))
    return one.select("label", "_r.*").withColumn(
        "bar", F.row_number().over(Window.orderBy(F.col("ss_rmse").asc_nulls_first(), "label")))


def gap_series(monthly_gap: DataFrame, ablation: str = "m3") -> DataFrame:
    names = F.array(*[F.lit(m) for m in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov",
                                         "Dec")])
    return monthly_gap.where(F.col("ablation") == ablation).select(
        "month", F.element_at(names, F.col("month").cast("int")).alias("month_label"), F.upper("model").alias("series"),
        "delta_rmse")


def lead_series(lead_table: DataFrame, ablation: str = "m3") -> DataFrame:
    return lead_table.where(F.col("ablation").isin(ablation, "raw_nwp")).select(
        "lead_time", F.upper("model").alias("series"), "rmse", "mae", "ratio")


def month_lead_series(cells: DataFrame, model: str, ablation: str, leads: Sequence[int] = (3, 6, 12, 24)) -> DataFrame:
    """RMSE by month at fixed lead times, measured."""
    chosen = cells.where((F.col("model") == model) & (F.col("ablation") == ablation)
                         & F.col("lead_time").isin(list(leads)))
    return roll_up(chosen, ["month", "lead_time"]).select("month", "lead_time", continuous_columns()["rmse"].alias("rmse"))


def progression(matrix: DataFrame) -> DataFrame:
    """Ablation matrix as (model, step, skill) rows in chart order."""
    steps = [("Raw Model", "raw_ss_rmse"), ("M1 (Ground Obs)", "m1_ss_rmse"), ("M2 (Satellite)", "m2_ss_rmse"),
             ("M3 (Multi-Modal)", "m3_ss_rmse")]
    rows = [F.struct(F.lit(i).alias("step"), F.lit(name).alias("label"), F.col(c).alias("ss_rmse"),
                     clip(c, -25.0, 35.0).alias("colour_value")) for i, (name, c) in enumerate(steps)]
    return matrix.select("model", F.explode(F.array(*rows)).alias("_s")).select("model", "_s.*")

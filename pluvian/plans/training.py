"""Load, split, fit, score and export one model."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvian.functions.scalars import corrected_rain
from pluvian.models import boosting, residual
from pluvian.models.boosting import BoostSettings
from pluvian.operators import columns, guards, split, verify


def training_rows(features: DataFrame, weather_model: str | None = None, held_out: Sequence[str] = ()) -> DataFrame:
    """Rows a model may learn from: before the frozen year, labelled, of one weather model, without held-out networks."""
    if held_out:
        guards.assert_not_held_out(features, list(held_out))
    rows = columns.labelled(columns.standard_columns(guards.before_frozen(features)))
    return columns.of_weather_model(rows, weather_model) if weather_model else rows


def train_and_score(rows: DataFrame, ablation: str, model: str, key: Sequence[str], weather_model: str = "ecmwf_ifs",
                    val_year: int = 2024, settings: residual.TreeSettings | BoostSettings | None = None, max_train_rows: int | None = None,
                    save_to: str | None = None):
    """(fitted model, prediction table of all validation rows).

    `gbt_l1` and `quantile` take BoostSettings, the others TreeSettings. `max_train_rows` bounds the rows a model learns from, never those it is scored on. `save_to` keeps the model below
    that folder, by weather model, model and ablation.
    """
    features = columns.ablation_features(rows, ablation)
    marked = split.train_validation_split(rows, key, val_year=val_year)
    if max_train_rows:
        marked = split.train_row_budget(marked, max_train_rows)
    table = columns.ablation_matrix_input(marked, ablation, [c for c in marked.columns if c not in features])
    fit = {"gbt_l1": partial(residual.leafwise_residual, loss="absolute"), "gbt_l2": partial(residual.boosted_residual, loss="squared"),
           "hurdle": residual.hurdle, "quantile": residual.quantile_boosting, "quantile_forest": residual.quantile_forest}
    if model not in fit:
        raise ValueError(f"unknown model {model!r}")
    fitted, scored = fit[model](table, features, **({"settings": settings} if settings else {}))
    if save_to:
        residual.save(fitted, residual.place(save_to, weather_model, model, ablation))
    quantiles = [c for c in scored.columns if c.startswith("q") and c[1:].isdigit()] if model.startswith("quantile") else []
    return fitted, columns.prediction_frame(scored, model, ablation, weather_model, quantiles=quantiles)


def fold_scores(rows: DataFrame, features: Sequence[str], folds: Sequence[tuple[int, int, int]], objectives: dict[str, boosting.Objective],
                target: str = "target_bias", time: str = "valid_time", settings: BoostSettings = BoostSettings()) -> DataFrame:
    """(fold, model_name, n, raw_rmse, corrected_rmse, skill_pct): expanding folds (P4), each with all models.

    A fold is (first train year, last train year, validation year). The rows are binned and stored once and all fits share their
    passes; a row is not repeated for each fold it is in.
    """
    year = F.year(time)
    conditions = [(year.between(a, b), year == v) for a, b, v in folds]
    fitted = boosting.fit_folds(rows, features, list(objectives.values()), target, conditions, settings)
    parts = []
    for k, ((_, val), models) in enumerate(zip(conditions, fitted)):
        scored = boosting.predictions(rows.where(val), models, features, [f"_m{i}" for i in range(len(models))])
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("model_name"), F.col(f"_m{i}").alias("predicted_bias")) for i, n in enumerate(objectives)]))
        parts.append(scored.select("observed_rain", F.col("nwp_rain_raw").alias("nwp_raw_rain"), each.alias("_e"))
                     .select(F.lit(k + 1).alias("fold"), "observed_rain", "nwp_raw_rain", "_e.*"))
    both = reduce(DataFrame.unionByName, parts).withColumn("corrected_rain", corrected_rain("nwp_raw_rain", "predicted_bias"))
    return verify.split_report(both, keys=["fold", "model_name"])


def validation_report(predictions: DataFrame) -> DataFrame:
    return verify.split_report(predictions, keys=["weather_model", "model_name", "ablation"])

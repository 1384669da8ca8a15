"""All report tables from one pass over the verification rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvian.operators import verify as V
from pluvian.session import stored, written

GRAIN = ["model", "ablation", "lead_time", "month", "basin_id", "is_holdout"]


def verification_cells(long: DataFrame, store: bool = True) -> DataFrame:
    """Score cells at the finest grain any report needs (variants x leads x months x basins x tiers: thousands of rows).

    With `store` the cells are written to the checkpoint folder, so the reports below read thousands of rows instead of
    scanning the forecasts again, and a lost executor costs nothing.
    """
    cells = V.score_cells(long, GRAIN)
    return stored(cells) if store else cells


#: The grains of all reports. Hold-out rows are told apart in each.
VARIANT = ["model", "ablation"]
GRAINS = {"variant": VARIANT, "lead": ["lead_time", *VARIANT], "month": ["month", *VARIANT], "basin": ["basin_id", *VARIANT]}


def report_cells(cells: DataFrame) -> DataFrame:
    """The cells of every grain, from one aggregation, written once."""
    return written(V.roll_up_sets(cells, {g: ["is_holdout", *keys] for g, keys in GRAINS.items()}))


def reports(cells: DataFrame, models: Sequence[str], baseline: tuple[str, str] = ("baseline_b0", "raw_nwp"),
            long: DataFrame | None = None, weather_models: Sequence[tuple[str, str]] = ()) -> dict[str, DataFrame]:
    """The twelve report tables, all read from one table of rolled-up cells. `long` (verification rows) is needed only for the
    rank correlation of the leaderboard."""
    rolled = report_cells(cells)

    def whole(grain: str) -> DataFrame:
        return V.grain_of(rolled, grain, ["is_holdout", *GRAINS[grain]])

    def of(grain: str) -> DataFrame:
        return whole(grain).where(~F.col("is_holdout")).drop("is_holdout")
    here = of("variant")
    variant = F.struct("model", "ablation")
    raw_variants = [F.struct(F.lit(m).alias("model"), F.lit(a).alias("ablation")) for m, a in (baseline, *weather_models)]
    in_network = long.where(~F.col("is_holdout")) if long is not None else None
    return {
        "cross_model_benchmark": V.leaderboard(here, in_network),
        "raw_weather_models_comparison": V.against_baseline(here.where(variant.isin(*raw_variants)), baseline),
        "lead_time_breakdown": V.by_lead(of("lead")),
        "monthly_benchmark": V.by_month(of("month")),
        "monthly_contingency_benchmark": V.by_month_threshold(of("month")),
        "generalization_gap_report": V.generalization_gap(whole("variant")),
        "monthly_generalization_gap": V.generalization_gap(whole("month"), ["month"]),
        "basin_breakdown": V.basin_table(of("basin")),
        "basin_skill_scores": V.basin_best(of("basin"), models, baseline),
        "rain_intensity_contingency_table": V.intensity_table(here),
        "heavy_rain_warning_stats": V.heavy_rain_table(here),
        "model_ablation_matrix": V.ablation_matrix(here, models, baseline),
    }

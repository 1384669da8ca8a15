"""Telemetry quality control: status labels, hourly completeness, gaps, tiers, presence and catalog roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvian.functions import constants as K
from pluvian.functions.scalars import epoch_seconds, is_null_token, parse_number
from pluvian.functions.skew import first_row


def bounds_of(variable: Column, bounds: dict[str, tuple[float, float]]) -> tuple[Column, Column]:
    """Physical limits by variable as literal maps; an unknown variable has none."""
    def lookup(i: int) -> Column:
        table = F.create_map(*[F.lit(x) for v, lim in bounds.items() for x in (v, float(lim[i]))])
        return F.try_element_at(table, variable)
    return lookup(0), lookup(1)


def classify(raw: DataFrame, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Adds `status`, `is_valid` and `value` (f32, only where valid) to long raw telemetry.

    The label of the last matching rule wins. A row is present, so an empty text is an explicit null; text that is no
    number and no null token gets its own label.
    """
    lo, hi = bounds_of(F.col("variable_type"), bounds or K.PHYSICAL_BOUNDS)
    number = parse_number("raw_value")
    text_null = F.col("raw_value").isNull() | is_null_token("raw_value")
    no_value = text_null | number.isNull()
    sentinel = F.coalesce(number.isin(K.SENTINELS), F.lit(False))
    flagged = F.coalesce(F.upper(F.trim("raw_quality_flag")).isin(K.ERROR_FLAGS), F.lit(False))
    outside = F.coalesce(~no_value & ~sentinel & ((number < lo) | (number > hi)), F.lit(False))
    # later rules override earlier ones, so they are tested first
    status = (F.when(outside, "OUT_OF_BOUNDS").when(flagged, "FLAG_ERROR").when(sentinel, "SENTINEL_ERROR")
              .when(text_null, "EXPLICIT_NULL").when(number.isNull(), "UNPARSEABLE").otherwise("VALID"))
    valid = ~no_value & ~sentinel & ~flagged & ~outside
    return raw.withColumns({
        "status": status, "is_valid": valid, "value": F.when(valid, number.cast("float")),
        "is_explicit_null": text_null, "is_sentinel": sentinel, "is_flag_error": flagged, "is_out_of_bounds": outside})


def latest_per_hour(raw: DataFrame, order: Sequence[Column], keys: Sequence[str] = ("station_code", "variable_type", "observed_at")) -> DataFrame:
    """Keep the last report of each key under `order` (combines map-side, so copies do not pile up in one task)."""
    keys = list(keys)
    rest = [c for c in raw.columns if c not in keys]
    packed = raw.select(*keys, F.struct(*order).alias("_o"), F.struct(*rest).alias("_r"))
    return packed.groupBy(*keys).agg(F.max_by("_r", "_o").alias("_r")).select(*keys, "_r.*")


def earliest_per_key(raw: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_row(raw, list(keys), list(order))


def hour_index(ts: Column | str, start: str) -> Column:
    return ((epoch_seconds(ts) - epoch_seconds(F.expr(f"timestamp_ntz'{start}'"))) / F.lit(3600)).cast("bigint")


def completeness(classified: DataFrame, start: str, end: str, universe: DataFrame | None = None,
                 keys: Sequence[str] = ("station_code", "variable_type")) -> DataFrame:
    """Hourly audit per station and variable against every hour of [start, end].

    One row per key-hour must be given (`latest_per_hour`). The full hour grid is never built: a missing hour is what the
    count lacks, and the longest invalid run is the largest distance between neighbouring valid hours, with one valid
    sentinel hour before the start and one after the end. `universe` lists keys that must appear even without any row.
    """
    keys = list(keys)
    in_range = classified.where(F.col("observed_at").between(F.expr(f"timestamp_ntz'{start}'"),
                                                             F.expr(f"timestamp_ntz'{end}'"))
                                & (F.minute("observed_at") == 0) & (F.second("observed_at") == 0)
                                & (F.date_format("observed_at", "SSSSSS") == "000000"))
    idx = hour_index("observed_at", start)
    expected = hour_index(F.expr(f"timestamp_ntz'{end}'"), start) + F.lit(1)
    valid_hours = in_range.where("is_valid").select(*keys, idx.alias("_h"))
    previous = F.lag("_h", 1, -1).over(Window.partitionBy(*keys).orderBy("_h"))
    gaps = (valid_hours.withColumn("_gap", F.col("_h") - previous - 1)
            .groupBy(*keys).agg(F.max("_gap").alias("_inner"), F.max("_h").alias("_last")))
    per_key = in_range.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("actual_hours_reported"),
        *[F.count_if(c).alias(n) for c, n in (
            ("is_explicit_null", "explicit_null_hours"), ("is_sentinel", "sentinel_error_hours"),
            ("is_flag_error", "flag_error_hours"), ("is_out_of_bounds", "out_of_bounds_hours"),
            ("is_valid", "valid_hours"))])
    if universe is not None:
        per_key = universe.select(*keys).distinct().join(per_key, keys, "left").na.fill(0)
    out = (per_key.join(gaps, keys, "left").withColumn("total_expected_hours", expected)
           .withColumn("missing_timestamp_hours", F.col("total_expected_hours") - F.col("actual_hours_reported"))
           .withColumn("max_consecutive_gap_hours",
                       F.coalesce(F.greatest("_inner", F.col("total_expected_hours") - 1 - F.col("_last")),
                                  F.col("total_expected_hours")))
           .withColumn("completeness_pct", F.bround(F.col("valid_hours") / F.col("total_expected_hours") * 100.0, 4)))
    return (out.withColumn("tier", tier("valid_hours", "total_expected_hours", "completeness_pct",
                                        "max_consecutive_gap_hours"))
            .withColumn("is_golden", F.col("tier") == K.TIER_GOLDEN)
            .select(*keys, "total_expected_hours", "actual_hours_reported", "missing_timestamp_hours",
                    "explicit_null_hours", "sentinel_error_hours", "flag_error_hours", "out_of_bounds_hours",
                    "valid_hours", "completeness_pct", "max_consecutive_gap_hours", "tier", "is_golden"))


def tier(valid: str, expected: str, pct: str, gap: str) -> Column:
    return (F.when(F.col(valid) == F.col(expected), K.TIER_GOLDEN)
            .when((F.col(pct) >= 99.5) & (F.col(gap) <= 3), K.TIER_SILVER)
            .when(F.col(pct) >= 95.0, K.TIER_BRONZE).otherwise(K.TIER_EXCLUDED))


def invalid_runs(classified: DataFrame, start: str, end: str,
                 keys: Sequence[str] = ("station_code", "variable_type")) -> DataFrame:
    """Every run of invalid or missing hours: first hour, last hour, length (between neighbouring valid hours)."""
    keys = list(keys)
    expected = hour_index(F.expr(f"timestamp_ntz'{end}'"), start) + F.lit(1)
    rows = classified.select(*keys, hour_index("observed_at", start).alias("_h"), "is_valid")
    rows = rows.where((F.col("_h") >= 0) & (F.col("_h") < expected))
    closing = rows.select(*keys).distinct().select(*keys, expected.alias("_h"))
    marks = rows.where("is_valid").select(*keys, "_h").unionByName(closing)
    prev = F.lag("_h", 1, -1).over(Window.partitionBy(*keys).orderBy("_h"))
    origin = F.expr(f"timestamp_ntz'{start}'")
    return (marks.withColumn("_p", prev).where(F.col("_h") - F.col("_p") > 1)
            .select(*keys, (origin + F.make_dt_interval(F.lit(0), (F.col("_p") + 1).cast("int"))).alias("gap_start"),
                    (origin + F.make_dt_interval(F.lit(0), (F.col("_h") - 1).cast("int"))).alias("gap_end"),
                    (F.col("_h") - F.col("_p") - 1).alias("gap_hours")))


def hourly_frame(classified: DataFrame, start: str, end: str,
                 keys: Sequence[str] = ("station_code", "variable_type")) -> DataFrame:
    """The annotated full hourly table (for export): every key meets every hour; an absent hour is MISSING_TIMESTAMP."""
    keys = list(keys)
    hours = F.explode(F.sequence(F.expr(f"timestamp_ntz'{start}'"), F.expr(f"timestamp_ntz'{end}'"),
                                 F.expr("interval 1 hour"))).alias("observed_at")
    grid = classified.select(*keys).distinct().select(*keys, hours)
    return (grid.join(classified, [*keys, "observed_at"], "left")
            .withColumn("status", F.coalesce("status", F.lit("MISSING_TIMESTAMP")))
            .withColumn("is_valid", F.coalesce("is_valid", F.lit(False)))
            .select(*keys, "observed_at", "value", F.col("status").alias("quality_flag"), "is_valid"))


def presence_matrix(rows: DataFrame, months: Sequence[str], keys: Sequence[str] = ("station_code", "catalog"),
                    time: str = "observed_at") -> DataFrame:
    """Station x month presence with count and rate. `months` are yyyy-MM texts and become the columns."""
    keys = list(keys)
    label = F.date_format(time, "yyyy-MM")
    flags = [F.max(F.when(label == m, 1).otherwise(0)).alias("m_" + m.replace("-", "_")) for m in months]
    wide = rows.groupBy(*keys).agg(*flags)
    total = sum((F.col("m_" + m.replace("-", "_")) for m in months), F.lit(0))
    return (wide.withColumn("months_present_count", total)
            .where(F.col("months_present_count") > 0)
            .withColumn("presence_rate_pct", F.bround(F.col("months_present_count") / F.lit(len(months)) * 100.0, 2)))


def joint_catalogs(audit: DataFrame, catalogs: Sequence[str] = tuple(K.CATALOGS)) -> DataFrame:
    """Stations audited in every catalog, with joint flags and one tier and percentage column per catalog."""
    good = F.col("tier").isin(K.TIER_GOLDEN, K.TIER_SILVER)

    def of(c: str, name: str) -> Column:
        return F.max(F.when(F.col("variable_type") == c, F.col(name)))

    return (audit.where(F.col("variable_type").isin(list(catalogs))).groupBy("station_code").agg(
        F.count_distinct("variable_type").alias("_n"), F.bool_and("is_golden").alias("all_three_golden"),
        F.bool_and(good).alias("all_three_silver_or_better"), F.min("completeness_pct").alias("min_completeness_pct"),
        F.bround(F.avg("completeness_pct"), 4).alias("avg_completeness_pct"),
        *[of(c, "tier").alias(f"{c}_tier") for c in catalogs],
        *[of(c, "completeness_pct").alias(f"{c}_completeness_pct") for c in catalogs])
        .where(F.col("_n") == len(catalogs)).drop("_n"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """Stations and tier counts per catalog, plus the total over all catalogs."""
    def tiers(name: str, text: str) -> Column:
        return F.count_if(F.col("tier") == text).alias(name)
    return (audit.rollup("variable_type").agg(
        F.count(F.lit(1)).alias("audited"), tiers("golden", K.TIER_GOLDEN), tiers("silver", K.TIER_SILVER),
        tiers("bronze", K.TIER_BRONZE), tiers("excluded", K.TIER_EXCLUDED))
        .withColumn("variable_type", F.coalesce("variable_type", F.lit("all"))))


def continuity_summary(presence: DataFrame, months: int) -> DataFrame:
    """Per catalog: stations, stations present in every month, and their rate."""
    full = F.count_if(F.col("months_present_count") == months)
    return presence.groupBy("catalog").agg(
        F.count(F.lit(1)).alias("stations"), full.alias("stations_all_months"),
        F.bround(full / F.count(F.lit(1)) * 100.0, 2).alias("continuity_pct"))


def top_stations(audit: DataFrame, n: int, golden_only: bool = True) -> DataFrame:
    """First n stations by code (a report excerpt)."""
    rows = audit.where("is_golden") if golden_only else audit
    return rows.orderBy("station_code", "variable_type").limit(n)


def enrich(rows: DataFrame, stations: DataFrame, columns: Sequence[str], key: str = "station_code") -> DataFrame:
    """Left join of station attributes, one master row per code."""
    master = first_row(stations.select(key, *columns), [key], [F.col(c) for c in columns])
    return rows.join(master, key, "left")


def station_flags(catalogs: DataFrame) -> DataFrame:
    """Availability flags of every station of the rain catalog; input has (station_code, catalog, ...)."""
    def has(c: str) -> Column:
        return F.bool_or(F.col("catalog") == c)
    flags = catalogs.groupBy("station_code").agg(
        has("hourly_rain").alias("has_rain"), has("pressure").alias("has_pressure"),
        has("humidity").alias("has_humidity")).where("has_rain")
    return flags.withColumn("has_all_three", F.col("has_rain") & F.col("has_pressure") & F.col("has_humidity"))


def fill_short_gaps(classified: DataFrame, max_gap_hours: int = 3, keys: Sequence[str] = ("station_code", "variable_type"),
                    curve: str = "line", chunk_hours: int = 1440) -> DataFrame:
    """Valid hours plus the hours of gaps up to `max_gap_hours` between them, the latter flagged INTERPOLATED (P2).

    `line` joins the known hours next to a gap. `cubic` bends with the known hours before and after those: a Hermite cubic
    with Fritsch-Carlson slopes, which keeps the shape of the series and never leaves the range of the two hours next to the
    gap. A known hour that is itself more than a fillable gap away has no say; an end without one is as steep as the line.

    A gauge is cut into chunks of `chunk_hours`, so it is never one window task; hours near an edge also go to the next
    chunk, as far as a gap and its neighbours can reach, so the cut changes nothing. Longer gaps stay empty.
    """
    if curve not in ("line", "cubic"):
        raise ValueError(f"unknown curve {curve!r}")
    keys = list(keys)
    reach = max_gap_hours + 2  # one more, since distances are whole hours
    valid = classified.where("is_valid").select(*keys, "observed_at", F.col("value").cast("double").alias("value"))
    hour = F.timestamp_diff("HOUR", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("observed_at"))

    def chunk(h: Column) -> Column:
        return F.floor(h / F.lit(chunk_hours)).cast("int")
    copies = valid.withColumn("_home", chunk(hour)).withColumn("_chunk", F.explode(F.sequence(chunk(hour - 2 * reach), chunk(hour + reach))))
    w = Window.partitionBy(*keys, "_chunk").orderBy("observed_at")
    around = {"_next": F.lead("observed_at").over(w), "_to": F.lead("value").over(w)}
    if curve == "cubic":
        around |= {"_t0": F.lag("observed_at").over(w), "_y0": F.lag("value").over(w),
                   "_t3": F.lead("observed_at", 2).over(w), "_y3": F.lead("value", 2).over(w)}
    placed = copies.withColumns(around).where("_home = _chunk")
    gap = F.timestamp_diff("HOUR", F.col("observed_at"), F.col("_next")) - 1
    steps = F.when(gap.between(1, max_gap_hours), gap).otherwise(0).cast("int")
    opened = placed.withColumn("_gap", steps).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_gap"))))
    value, k, width = F.col("value"), F.col("_k"), F.col("_gap") + 1
    if curve == "line":
        between = value + (F.col("_to") - value) * k / width
    else:
        before = F.timestamp_diff("HOUR", F.col("_t0"), F.col("observed_at"))
        after = F.timestamp_diff("HOUR", F.col("_next"), F.col("_t3"))
        rise = (F.col("_to") - value) / width
        left = shape_slope((value - F.col("_y0")) / before, before, rise, width, before.between(1, max_gap_hours + 1))
        right = shape_slope((F.col("_y3") - F.col("_to")) / after, after, rise, width, after.between(1, max_gap_hours + 1))
        s = k / width
        curved = ((2 * s * s * s - 3 * s * s + 1) * value + (s * s * s - 2 * s * s + s) * width * left
                  + (3 * s * s - 2 * s * s * s) * F.col("_to") + (s * s * s - s * s) * width * right)
        between = F.greatest(F.least(value, F.col("_to")), F.least(F.greatest(value, F.col("_to")), curved))
    filled = F.col("_k") > 0
    return opened.select(*keys, (F.col("observed_at") + F.make_dt_interval(F.lit(0), F.col("_k"))).alias("observed_at"),
                         F.when(filled, between).otherwise(value).alias("value"),
                         F.when(filled, "INTERPOLATED").otherwise("VALID").alias("quality_flag"))


def shape_slope(other: Column, other_width: Column, inner: Column, inner_width: Column, known: Column) -> Column:
    """Slope at a known hour: the weighted harmonic mean of the rises on either side, 0 at a turn, the inner rise if there is
    no other."""
    a, b = 2 * inner_width + other_width, inner_width + 2 * other_width
    mean = (a + b) / (a / other + b / inner)
    return F.when(~F.coalesce(known, F.lit(False)), inner).when(other * inner <= 0, 0.0).otherwise(mean)

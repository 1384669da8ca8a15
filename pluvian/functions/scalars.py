"""Scalar column expressions: missing values, numbers, text, time and weather-model names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvian.functions import constants as K


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- missing values and numbers ----

def finite(*cols: Column | str) -> Column:
    """True when every value is present and neither NaN nor infinite."""
    test = F.lit(True)
    for c in map(col, cols):
        test = test & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return test


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere inside the engine; files may carry NaN."""
    floats = [n for n, t in df.dtypes if t in ("float", "double")]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in floats}) if floats else df


def clip(c: Column | str, lo: float | None, hi: float | None) -> Column:
    """Clamp that keeps NULL as NULL (`greatest`/`least` alone would return the limit)."""
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(F.lit(float(lo)), out)
    if hi is not None:
        out = F.least(F.lit(float(hi)), out)
    return F.when(c.isNotNull(), out)


def safe_ratio(num: Column, den: Column, otherwise: float | None) -> Column:
    """num/den, or a fixed value where the denominator is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(otherwise).cast("double"))


def narrow(df: DataFrame) -> DataFrame:
    """f64 -> f32 and i64 -> i32."""
    target = {"double": "float", "bigint": "int"}
    return df.select([F.col(n).cast(target[t]).alias(n) if t in target else F.col(n) for n, t in df.dtypes])


def is_null_token(text: Column | str) -> Column:
    return F.lower(F.trim(col(text))).isin([t.strip() for t in K.NULL_TOKENS])


def parse_number(text: Column | str) -> Column:
    """Number or NULL; the text NaN is a null token, not a value."""
    v = F.trim(col(text)).try_cast("double")
    return F.when(~F.isnan(v), v)


# ---- text ----

def snake_case(name: str) -> str:
    return name.replace("﻿", "").strip().lower().replace(" ", "_")


def grid_id(lat: Column | str, lon: Column | str) -> Column:
    """2 km cell name: half-even rounding of degrees * 50."""
    def part(c):
        return F.rint(col(c) * F.lit(50.0)).cast("bigint").cast("string")
    return F.concat(F.lit("G_"), part(lat), F.lit("_"), part(lon))


def model_name(name: Column | str, vocabulary: str = "verification") -> Column:
    """Canonical weather-model name.

    `verification` lets unknown names pass (lower, trimmed); `acquisition` and `archive` raise on them.
    """
    table = {"verification": K.VERIFICATION_ALIASES, "acquisition": K.ACQUISITION_ALIASES,
             "archive": K.ARCHIVE_ALIASES}[vocabulary]
    clean = F.lower(F.trim(col(name)))
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(lookup, clean)
    if vocabulary == "verification":
        return F.coalesce(found, clean)
    unknown = F.raise_error(F.concat(F.lit("unsupported weather model: "), clean)).cast("string")
    return F.when(clean.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(found, unknown))


# ---- time (all timestamps are zone-less wall times) ----

def epoch_seconds(ts: Column | str) -> Column:
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), col(ts))


def shift(ts: Column | str, hours: Column | int = 0, minutes: Column | int = 0, seconds: Column | int = 0) -> Column:
    def as_col(v):
        return v if isinstance(v, Column) else F.lit(v)
    return col(ts) + F.make_dt_interval(F.lit(0), as_col(hours).cast("int"), as_col(minutes).cast("int"),
                                        as_col(seconds).cast("decimal(18,6)"))


def floor_to(ts: Column | str, seconds: int) -> Column:
    """Largest multiple of `seconds` not after ts, in zone-less arithmetic."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), col(ts))
    over = F.pmod(micros, F.lit(seconds * 1_000_000).cast("bigint"))
    return col(ts) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (over / F.lit(1e6)).cast("decimal(18,6)"))


def snap_10min(ts: Column | str, mode: str = "floor") -> Column:
    """10-minute observation slot. `nearest` sends 5..9 minutes up, so it can pass the run time; `floor` cannot."""
    base = floor_to(ts, 600)
    if mode == "floor":
        return base
    if mode != "nearest":
        raise ValueError(f"unknown snap mode {mode!r}")
    return F.when(F.pmod(F.minute(col(ts)), F.lit(10)) < 5, base).otherwise(shift(base, minutes=10))


def to_utc(ts: Column | str) -> Column:
    """Local gauge time (UTC+7) -> UTC."""
    return shift(ts, hours=-K.LOCAL_UTC_OFFSET_HOURS)


def to_local(ts: Column | str) -> Column:
    return shift(ts, hours=K.LOCAL_UTC_OFFSET_HOURS)


def zoned_to_utc(ts: Column | str) -> Column:
    """A zone-aware instant as UTC wall time."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), col(ts).cast("timestamp_ntz"))


def lead_hours(run: Column | str, valid: Column | str) -> Column:
    """Whole hours from run to valid time; a valid time before its run is an error."""
    secs = F.timestamp_diff("SECOND", col(run), col(valid))
    return F.when(col(valid) < col(run), F.raise_error(F.lit("valid_time earlier than run_time")).cast("int")) \
        .otherwise((secs / F.lit(3600)).cast("int"))


def iso_z(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def season(month: Column | str) -> Column:
    m = col(month)
    return F.when(m.between(5, 10), "Wet/Monsoon").when(m.between(3, 4), "Hot").otherwise("Dry/Cool")


def satellite_name(ts: Column | str) -> Column:
    return F.when(col(ts) < F.expr(f"timestamp_ntz'{K.SATELLITE_CUTOVER}'"), "H08").otherwise("H09")


# ---- weather ----

def wind_uv(speed: Column | str, direction_deg: Column | str) -> tuple[Column, Column]:
    rad = F.radians(col(direction_deg))
    return -col(speed) * F.sin(rad), -col(speed) * F.cos(rad)


def corrected_rain(raw: Column | str, bias: Column | str) -> Column:
    total = col(raw) + col(bias)
    return F.when(total.isNotNull(), F.greatest(F.lit(0.0), total))


def target_bias(observed: Column | str, raw: Column | str, places: int = 2) -> Column:
    """Residual to learn, half-even rounded."""
    return F.bround(col(observed).cast("double") - col(raw).cast("double"), places)


def wet(observed: Column | str, threshold: float = 0.1) -> Column:
    return col(observed) >= F.lit(threshold)


def sorted_quantiles(cols: list[str]) -> list[Column]:
    """Monotone rearrangement: the k-th output is the k-th smallest of the row's quantile predictions."""
    ordered = F.array_sort(F.array(*[F.col(c) for c in cols]))
    return [ordered.getItem(i).alias(c) for i, c in enumerate(cols)]


def first_usable_column(df: DataFrame, candidates: list[str]) -> str | None:
    """First candidate column with any value. Runs one aggregate over the present candidates."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        return None
    counts = df.agg(*[F.count(F.when(finite(c) if dict(df.dtypes)[c] in ("float", "double") else F.col(c).isNotNull(),
                                     1)).alias(c) for c in present]).first()
    return next((c for c in present if counts[c] > 0), None)

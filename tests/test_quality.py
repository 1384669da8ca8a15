from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pluvian.operators import quality as Q


def raw(spark, rows):
    return spark.createDataFrame(rows, "station_code string, variable_type string, observed_at string, raw_value string, raw_quality_flag string") \
        .withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))


def test_status_rules_and_priority(spark):
    t = "2024-01-01 00:00:00"
    cases = [("5.5", "N", "VALID"), (None, "N", "EXPLICIT_NULL"), (" NaN ", "N", "EXPLICIT_NULL"), ("n/a", "", "EXPLICIT_NULL"),
             ("-999", "N", "SENTINEL_ERROR"), ("-9999.0", None, "SENTINEL_ERROR"), ("5", " e ", "FLAG_ERROR"),
             ("301", "N", "OUT_OF_BOUNDS"), ("-1", "E", "OUT_OF_BOUNDS"), ("abc", "N", "UNPARSEABLE"), ("-", "B", "FLAG_ERROR")]
    df = Q.classify(raw(spark, [(str(i), "hourly_rain", t, v, f) for i, (v, f, _) in enumerate(cases)]))
    got = {int(r["station_code"]): (r["status"], r["value"]) for r in df.collect()}
    for i, (v, _, want) in enumerate(cases):
        assert got[i][0] == want
        assert (got[i][1] is not None) == (want == "VALID")
    free = Q.classify(raw(spark, [("s", "wind", t, "1e6", "N")])).first()
    assert free["status"] == "VALID"  # unknown variables have no limits


def series(spark, hours, missing):
    start = datetime(2021, 1, 1)
    pdf = pd.DataFrame({"observed_at": [start + timedelta(hours=h) for h in range(hours) if h not in missing]})
    df = spark.createDataFrame(pdf).select(F.lit("s").alias("station_code"), F.lit("hourly_rain").alias("variable_type"),
                                           F.col("observed_at").cast("timestamp_ntz").alias("observed_at"),
                                           F.lit("1.0").alias("raw_value"), F.lit("N").alias("raw_quality_flag"))
    return Q.completeness(Q.classify(df), "2021-01-01 00:00:00", "2025-12-31 23:00:00").first()


@pytest.mark.parametrize("block, tier", [(3, Q.K.TIER_SILVER), (4, Q.K.TIER_BRONZE)])
def test_silver_needs_short_gaps(spark, block, tier):
    # 24 hours lost: blocks of three against one block of four among them
    lost = {1000 * i + j for i in range(1, 9) for j in range(3)}
    if block == 4:
        lost = (lost - {1000}) | {2003}
    row = series(spark, 43824, lost)
    assert (row["total_expected_hours"], row["valid_hours"]) == (43824, 43800)
    assert row["max_consecutive_gap_hours"] == block
    assert row["tier"] == tier


def test_gap_at_both_ends_and_no_data(spark):
    row = series(spark, 43824 - 10, {0, 1, 2})
    assert row["max_consecutive_gap_hours"] == 10
    nothing = Q.classify(raw(spark, [("a", "hourly_rain", "2021-01-01 00:00:00", "-999", "N")]))
    universe = spark.createDataFrame([("a", "hourly_rain"), ("b", "hourly_rain")], "station_code string, variable_type string")
    rows = {r["station_code"]: r for r in Q.completeness(nothing, "2021-01-01 00:00:00", "2021-01-02 23:00:00", universe).collect()}
    assert rows["a"]["max_consecutive_gap_hours"] == 48 and rows["a"]["sentinel_error_hours"] == 1
    assert rows["b"]["missing_timestamp_hours"] == 48 and rows["b"]["tier"] == Q.K.TIER_EXCLUDED


def test_golden_means_no_gap(spark):
    row = series(spark, 43824, set())
    assert row["is_golden"] and row["max_consecutive_gap_hours"] == 0 and row["completeness_pct"] == 100.0


def plain_fill(points, max_gap, cubic):
    """points: {hour: value} -> {hour: value of a filled hour}."""
    hours, out = sorted(points), {}
    for i, (a, b) in enumerate(zip(hours, hours[1:])):
        h1 = b - a
        if not 2 <= h1 <= max_gap + 1:
            continue
        d1 = (points[b] - points[a]) / h1

        def slope(p, q):
            if p is None or not 1 <= q - p <= max_gap + 1:
                return d1
            h, d = q - p, (points[q] - points[p]) / (q - p)
            return 0.0 if d * d1 <= 0 else (3 * h + 3 * h1) / ((2 * h1 + h) / d + (h1 + 2 * h) / d1)
        ma = slope(hours[i - 1], a) if i else d1
        mb = slope(b, hours[i + 2]) if i + 2 < len(hours) else d1
        for k in range(1, h1):
            s = k / h1
            line = points[a] + d1 * k
            curve = ((1 + 2 * s) * (1 - s) ** 2 * points[a] + s * (1 - s) ** 2 * h1 * ma + s * s * (3 - 2 * s) * points[b] + s * s * (s - 1) * h1 * mb)
            out[a + k] = curve if cubic else line
    return out


@pytest.mark.parametrize("curve", ["line", "cubic"])
@pytest.mark.parametrize("chunk", [7, 48, 100000])
def test_filled_gaps_equal_the_plain_version(spark, curve, chunk):
    import random
    rng = random.Random(chunk)
    points = {g: {h: rng.choice([0.0, 0.0, rng.uniform(-3, 30)]) for h in range(-40, 300) if rng.random() < 0.55} for g in ("a", "b")}
    rows = [(g, "hourly_rain", h, v, True) for g, p in points.items() for h, v in p.items()] + [("a", "hourly_rain", 400, 1.0, False), ("c", "hourly_rain", 3, 2.0, True)]
    df = spark.createDataFrame(rows, "station_code string, variable_type string, h int, value double, is_valid boolean").withColumn(
        "observed_at", F.expr("timestamp_ntz'2021-01-01 00:00:00' + make_dt_interval(0, h)"))
    out = Q.fill_short_gaps(df, 3, curve=curve, chunk_hours=chunk).withColumn("h", F.timestamp_diff("HOUR", F.expr("timestamp_ntz'2021-01-01 00:00:00'"), "observed_at"))
    got = {(r["station_code"], r["h"]): (r["value"], r["quality_flag"]) for r in out.collect()}
    assert len(got) == out.count()
    for g, p in points.items():
        filled = plain_fill(p, 3, curve == "cubic")
        assert {h for s, h in got if s == g} == set(p) | set(filled)
        for h, v in filled.items():
            assert got[g, h][1] == "INTERPOLATED" and abs(got[g, h][0] - v) < 1e-9
            low, high = (p[max(x for x in p if x < h)], p[min(x for x in p if x > h)])
            assert min(low, high) - 1e-12 <= got[g, h][0] <= max(low, high) + 1e-12
        assert all(got[g, h] == (v, "VALID") for h, v in p.items())
    assert got["c", 3] == (2.0, "VALID")

"""Leakage guards. A guard exists as a plan (the offending rows) and as a check that raises."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pluvian.functions import constants as K
from pluvian.functions.scalars import col, shift
from pluvian.session import discard, publish

SAMPLES = 5


class LeakageError(Exception):
    """Data from after the forecast run, a frozen year or a held-out network reached a place it must not reach.

    `counts` has the rows against each guard, `samples` up to five of their values.
    """

    def __init__(self, message: str, counts: dict[str, int] | None = None, samples: dict[str, list[str]] | None = None) -> None:
        super().__init__(message)
        self.counts, self.samples = counts or {}, samples or {}


def leakage_violations(df: DataFrame, run_time: str = "run_time", time: str = "observed_at") -> DataFrame:
    return df.where(F.col(time) > F.col(run_time))


def assert_no_leakage(df: DataFrame, run_time: str = "run_time", time: str = "observed_at",
                      context: str = "general") -> None:
    """Count violations and show five of them. One aggregate; the samples are read only when there are any."""
    bad = leakage_violations(df, run_time, time)
    n = bad.count()
    if n:
        samples = [str(x[0]) for x in bad.select(time).orderBy(time).limit(5).collect()]
        raise LeakageError(f"{n} observations after run_time in {context}, e.g. {samples}")


def no_leakage(run_time: Column | str, time: Column | str) -> Column:
    """The inline form: passes `time` on, and fails the job on a value after its run."""
    return F.when(col(time) > col(run_time), F.raise_error(F.lit("observation after run_time")).cast("timestamp_ntz")) \
        .otherwise(col(time))


def lookback_filter(df: DataFrame, run_time: str = "run_time", time: str = "observed_at",
                    max_lookback_hours: int = 24) -> DataFrame:
    """Observations of [run - lookback, run]."""
    return df.where((F.col(time) <= F.col(run_time))
                    & (F.col(time) >= shift(run_time, hours=-max_lookback_hours)))


def invalid_runs_of(df: DataFrame, run_time: str = "run_time", valid_time: str = "valid_time") -> DataFrame:
    """Forecast rows that end before they start."""
    return df.where(F.col(valid_time) < F.col(run_time))


def time_column(df: DataFrame, wanted: str | None = None) -> str | None:
    for c in (wanted, "valid_time", "run_time", "timestamp"):
        if c and c in df.columns:
            return c
    return None


def assert_not_frozen(df: DataFrame, time: str | None = None, year: int = K.FROZEN_YEAR) -> None:
    """No row of the frozen year. A range test, so partitions and row groups are skipped."""
    c = time_column(df, time)
    if c and not df.where((F.col(c) >= F.lit(f"{year}-01-01").cast("timestamp_ntz"))
                          & (F.col(c) < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz"))).limit(1).isEmpty():
        raise LeakageError(f"rows of the frozen year {year} in column {c}")


def before_frozen(df: DataFrame, time: str | None = None, year: int = K.FROZEN_YEAR) -> DataFrame:
    """Rows before the frozen year, as a range predicate that reaches the scan."""
    c = time_column(df, time)
    return df.where(F.col(c) < F.lit(f"{year}-01-01").cast("timestamp_ntz")) if c else df


def assert_not_held_out(df: DataFrame, held_out: list[str], network: str = "network",
                        path_marks: list[str] | None = None) -> None:
    """Held-out networks may not feed training: neither by a network column nor by the files read."""
    marks = [m.lower() for m in (path_marks or held_out)]
    for path in df.inputFiles():
        if any(m in path.lower() for m in marks):
            raise LeakageError(f"held-out network file in training input: {path}")
    if network in df.columns and not df.where(F.lower(network).isin([h.lower() for h in held_out])).limit(1).isEmpty():
        raise LeakageError("held-out network rows in training input")


def row_guards(columns: Sequence[str], run_time: str = "run_time", observed: str = "observed_at", valid_time: str = "valid_time",
               frozen: str | None = None, year: int = K.FROZEN_YEAR, network: str = "network", held_out: Sequence[str] = ()) -> dict[str, tuple[Column, Column]]:
    """Guard -> (rows against it, what to show of them), for those guards whose columns there are."""
    found = {}
    if {run_time, observed} <= set(columns):
        found["observed after run"] = (F.col(observed) > F.col(run_time), F.col(observed))
    if {run_time, valid_time} <= set(columns):
        found["valid before run"] = (F.col(valid_time) < F.col(run_time), F.col(valid_time))
    frozen = frozen or next((c for c in (valid_time, run_time, "timestamp") if c in columns), None)
    if frozen in columns:
        found["frozen year"] = (F.year(frozen) == year, F.col(frozen))
    if held_out and network in columns:
        found["held-out network"] = (F.lower(F.col(network)).isin([h.lower() for h in held_out]), F.col(network))
    return found


def observed_guards(df: DataFrame, guards: dict[str, tuple[Column, Column]]) -> tuple[DataFrame, Callable[[], tuple[dict, dict]]]:
    """`df` and a reader of (rows against each guard, up to five samples of each), gathered while `df` is written or counted.

    The metrics are sums and minima (a sample is the least of its hash class), so they need no scan, shuffle or list of rows.
    The reader waits for the first action on the returned frame.
    """
    metrics, watch = [], Observation(f"guards-{uuid.uuid4().hex}")
    for i, (bad, shown) in enumerate(guards.values()):
        text = shown.cast("string")
        metrics.append(F.count_if(bad).alias(f"n{i}"))
        metrics += [F.min(F.when(bad & (F.pmod(F.xxhash64(text), F.lit(SAMPLES)) == k), text)).alias(f"s{i}_{k}") for k in range(SAMPLES)]
    if not guards:
        return df, lambda: ({}, {})

    def read() -> tuple[dict, dict]:
        got = watch.get
        return ({name: got[f"n{i}"] for i, name in enumerate(guards)},
                {name: sorted(x for k in range(SAMPLES) if (x := got[f"s{i}_{k}"]) is not None) for i, name in enumerate(guards)})
    return df.observe(watch, *metrics), read


def write_guarded(df: DataFrame, path: str, guards: dict[str, tuple[Column, Column]] | None = None, context: str = "general",
                  partition_by: Sequence[str] = ()) -> dict[str, int]:
    """Write `df` as Parquet and check its rows on the way; only a table without violations appears at `path`.

    The rows go to a folder beside `path`, which replaces `path` when every guard holds, and is removed with a typed error
    (counts and samples of all guards) when one does not. One job, one scan.
    """
    watched, read = observed_guards(df, row_guards(df.columns) if guards is None else guards)
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    watched.write.partitionBy(*partition_by).parquet(aside)
    counts, samples = read()
    if any(counts.values()):
        discard(df.sparkSession, aside)
        told = "; ".join(f"{n} rows: {name}, e.g. {samples[name]}" for name, n in counts.items() if n)
        raise LeakageError(f"{context}: {told}", counts, samples)
    publish(df.sparkSession, aside, path)
    return counts

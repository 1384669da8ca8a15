"""Cycles built in several runs, broken runs, and guards that watch a table while it is written."""

import pytest
from pyspark.sql import functions as F

from pluvian.operators import guards as G
from pluvian.operators import verify as V
from pluvian.plans import cycles as C


def frame(spark, rows, kinds="origin string, h int, x int"):
    df = spark.createDataFrame(rows, kinds)
    return df.withColumn("run_time", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h)")).drop("h")


@pytest.fixture(scope="module")
def rows(spark):
    return frame(spark, [(o, h, x) for o in ("gfs", "ecmwf") for h in range(0, 120, 12) for x in range(h % 5 + 1)]).cache()


class Builder:
    def __init__(self, rows, broken=()):
        self.rows, self.calls, self.broken = rows, [], set(broken)

    def __call__(self, wanted):
        self.calls.append(wanted.count())
        if len(self.calls) in self.broken:
            raise RuntimeError("the run breaks off")
        return self.rows.join(wanted, ["origin", "run_time"], "left_semi").select("origin", "run_time", "x")


def keys(df):
    return sorted(map(tuple, df.select("origin", "run_time", "x").collect()))


def test_second_run_writes_nothing(spark, rows, tmp_path):
    path, build = str(tmp_path / "t"), Builder(rows)
    wanted = rows.select("origin", "run_time")
    assert C.extend_cycles(spark, wanted.where("origin = 'gfs'"), build, path) == 10
    files = set((tmp_path / "t" / "rows").rglob("*.parquet"))
    assert C.extend_cycles(spark, wanted, build, path) == 10 and build.calls == [10, 10]
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    assert files <= set(before)
    assert C.extend_cycles(spark, wanted, build, path) == 0 and len(build.calls) == 2
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")} == before
    assert keys(C.scan_cycles(spark, path)) == keys(rows)


def test_broken_run_is_finished_by_the_next(spark, rows, tmp_path):
    path, wanted = str(tmp_path / "t"), rows.select("origin", "run_time")
    broken = Builder(rows, broken=[3])
    with pytest.raises(RuntimeError):
        C.extend_cycles(spark, wanted, broken, path, batch=5)
    done = C.finished_cycles(spark, path).count()
    assert 0 < done < 20
    # rows of a build that left no entry are not seen, and are replaced
    stray = frame(spark, [("gfs", 12, 777), ("ecmwf", 0, 778)]).withColumn("build", F.lit("stray"))
    C.placed(stray).write.mode("append").partitionBy(*C.PLACE).parquet(f"{path}/rows")
    assert not {777, 778} & {k[2] for k in keys(C.scan_cycles(spark, path))}
    again = Builder(rows)
    assert C.extend_cycles(spark, wanted, again, path, batch=5) == 20 - done
    assert sum(again.calls) == 20 - done and keys(C.scan_cycles(spark, path)) == keys(rows)


def test_rebuilt_and_empty_cycles(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    wanted = rows.select("origin", "run_time").unionByName(frame(spark, [("nobody", 0, 1)]).select("origin", "run_time"))
    assert C.extend_cycles(spark, wanted, Builder(rows), path) == 21
    entry = {r["origin"]: r["n_rows"] for r in C.finished_cycles(spark, path).where("origin = 'nobody'").collect()}
    assert entry == {"nobody": 0} and C.extend_cycles(spark, wanted, Builder(rows), path) == 0
    fewer = rows.where("origin = 'gfs' and x > 0").withColumn("x", F.col("x") + 100)
    assert C.extend_cycles(spark, rows.select("origin", "run_time"), Builder(fewer), path, rebuild=True) == 20
    assert keys(C.scan_cycles(spark, path)) == keys(fewer)
    with pytest.raises(FileNotFoundError):
        C.scan_cycles(spark, str(tmp_path / "none"))


def table(spark, late):
    kinds = "run string, seen string, network string"
    rows = [("2024-01-01 00:00", "2023-12-31 23:00", "hii")] * 50 + [("2024-01-01 00:00", f"2024-01-01 0{k}:00", "TMD") for k in range(1, late + 1)]
    df = spark.createDataFrame(rows, kinds)
    return df.select(F.col("run").cast("timestamp_ntz").alias("run_time"), F.col("seen").cast("timestamp_ntz").alias("observed_at"), "network")


def test_guards_refuse_a_table(spark, tmp_path):
    df, path = table(spark, 7), str(tmp_path / "t")
    guards = G.row_guards(df.columns, held_out=["tmd"])
    with pytest.raises(G.LeakageError) as e:
        G.write_guarded(df, path, guards, "features")
    assert e.value.counts == {"observed after run": 7, "frozen year": 0, "held-out network": 7}
    late = e.value.samples["observed after run"]
    assert 1 <= len(late) <= 5 and set(late) <= {f"2024-01-01 0{k}:00:00" for k in range(1, 8)} and e.value.samples["held-out network"] == ["TMD"]
    assert list(tmp_path.iterdir()) == []
    assert G.write_guarded(table(spark, 0), path, guards) == dict.fromkeys(guards, 0)
    assert spark.read.parquet(path).count() == 50
    with pytest.raises(G.LeakageError):
        G.write_guarded(df, path, guards)
    assert spark.read.parquet(path).count() == 50  # a refused table leaves the old one


def test_guards_need_no_scan_of_their_own(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = table(spark, 0)
    G.write_guarded(df.mapInArrow(touch, df.schema), str(tmp_path / "t"))
    assert seen.value == 50


def test_grains_are_told_apart_where_a_key_is_null(spark):
    rows = [("a", None, 1.0), ("a", 1, 2.0), ("b", None, 3.0)]
    long = spark.createDataFrame([(m, k, 0.0, 0.0, p) for m, k, p in rows], "model string, k int, obs double, raw double, pred double")
    cells = V.score_cells(long, ["model", "k"], [])
    rolled = V.roll_up_sets(cells, {"all": ["model"], "each": ["model", "k"]})
    assert sum("Exchange hash" in line for line in rolled._jdf.queryExecution().sparkPlan().toString().splitlines()) <= 1
    got = {"all": sorted((r["model"], r["s_abs"]) for r in V.grain_of(rolled, "all", ["model"]).collect()),
           "each": sorted((r["model"], r["k"] or 0, r["s_abs"]) for r in V.grain_of(rolled, "each", ["model", "k"]).collect())}
    assert got == {"all": [("a", 3.0), ("b", 3.0)], "each": [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)]}
    with pytest.raises(ValueError):
        V.roll_up_sets(cells, {"x": ["model"], "y": ["model"]})

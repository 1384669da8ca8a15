import json

import pytest
from pyspark.sql import functions as F

from pluvian.sources import forecasts as FS
from pluvian.sources import inventory as INV
from pluvian.sources import stations as ST
from pluvian.sources import tables as TB
from pluvian.sources import telemetry as TL


def test_parse_both_csv_generations(spark, tmp_path):
    old = tmp_path / "hourly_rain" / "202101"
    new = tmp_path / "pressure" / "202501"
    old.mkdir(parents=True), new.mkdir(parents=True)
    (old / "ABC1.csv").write_text("﻿Date, Time, Rain\n2021-01-01,00:00,1.5\n2021-01-01,01:00,-999\nbroken,xx,1\n2021-01-01,00:00,9.9\n")
    (new / "XYZ.csv").write_text("station_code,measure_datetime,press,quality_flag\n S9 ,2025-01-01 00:00:00,1008.2, E\nS9,2025-01-01 01:00:00,,N\n")
    (new / "Q.csv").write_text("station_code,measure_datetime,other\nS8,2025-01-01 00:00:00,7\n")
    rows = TL.parse_telemetry(spark, [str(old), str(new)]).orderBy("station_code", "observed_at").collect()
    got = [(r["station_code"], str(r["observed_at"]), r["variable_type"], r["raw_value"], r["raw_quality_flag"]) for r in rows]
    assert got == [("ABC1", "2021-01-01 00:00:00", "hourly_rain", "1.5", "VALID"), ("ABC1", "2021-01-01 01:00:00", "hourly_rain", "-999", "VALID"),
                   ("S8", "2025-01-01 00:00:00", "pressure", "7", "VALID"), ("S9", "2025-01-01 00:00:00", "pressure", "1008.2", "E"),
                   ("S9", "2025-01-01 01:00:00", "pressure", None, "N")]


def test_wide_rows_repeated_hours_and_quotes(spark, tmp_path):
    (tmp_path / "pressure").mkdir()
    filler = ",".join(f"c{i}" for i in range(16))
    blank = ",".join("1" for _ in range(16))
    (tmp_path / "pressure" / "W.csv").write_text(
        f"station_code,measure_datetime,{filler},rain,quality_flag\nW,2025-01-01 00:00:00,{blank},5.0,E\n"
        f"W,2025-01-01 01:00:00,{blank},,N\nW,2025-01-01 01:00:00,{blank},12.0,N\n"
        f"W,2025-01-01 02:00:00,{blank},12.0,N\nW,2025-01-01 02:00:00,{blank},5.0,N\n"
        f'"W",2025-01-01 03:00:00,{blank.replace("1", chr(34) + "a,""b" + chr(34), 1)},3.0,"N"\n')
    rows = TL.parse_telemetry(spark, str(tmp_path / "pressure")).orderBy("observed_at").collect()
    assert [(r["variable_type"], r["raw_value"], r["raw_quality_flag"]) for r in rows] == [
        ("hourly_rain", "5.0", "E"), ("hourly_rain", None, "N"), ("hourly_rain", "12.0", "N"), ("hourly_rain", "3.0", "N")]


def test_encoding_is_chosen_per_file(spark, tmp_path):
    text = "Station_Code,Station Name\n {} , กรุงเทพ \n"
    (tmp_path / "a.csv").write_bytes(text.format("A").encode("utf-8"))
    (tmp_path / "b.csv").write_bytes(text.format("B").encode("tis-620"))
    rows = {r["station_code"]: r["station_name"] for r in ST.scan_station_csv(spark, str(tmp_path), "x").collect()}
    assert rows == {"A": "กรุงเทพ", "B": "กรุงเทพ"}


def test_a_second_weather_model_erases_nothing(spark, tmp_path):
    def rows(name):
        return spark.createDataFrame([(1.0, name, "lightgbm", "m1")], "v double, weather_model string, model_name string, ablation string")
    path, csv = str(tmp_path / "p"), str(tmp_path / "c")
    for name in ("gfs", "ecmwf_ifs", "gfs"):
        TB.write_predictions(rows(name), path, csv)
    assert sorted(r["weather_model"] for r in TB.scan_predictions(spark, path).collect()) == ["ecmwf_ifs", "gfs"]
    assert spark.read.option("header", True).csv(csv).count() == 2


def test_shared_folder_rules():
    from pluvian.session import scratch_or_named
    assert scratch_or_named("s3a://x/y", "spark://h:7077") == "s3a://x/y" and scratch_or_named(None, "local[4]")
    for master in ("spark://h:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="shared folder"):
            scratch_or_named(None, master)


def test_unknown_header_fails(spark, tmp_path):
    (tmp_path / "x.csv").write_text("foo,bar\n1,2\n")
    with pytest.raises(Exception, match="unrecognised telemetry header"):
        TL.parse_telemetry(spark, str(tmp_path)).collect()


def test_clean_round_trip_prunes_folders(spark, tmp_path):
    df = spark.createDataFrame([("a", "2021-05-01 00:00:00", "hourly_rain", 1.0, "VALID", True), ("a", "2022-05-01 00:00:00", "pressure", 2.0, "VALID", False)],
                               "station_code string, observed_at string, variable_type string, value double, quality_flag string, is_golden boolean") \
        .withColumns({"observed_at": F.col("observed_at").cast("timestamp_ntz"), "value": F.col("value").cast("float")})
    base = str(tmp_path / "clean")
    TL.write_clean(df, base)
    back = TL.scan_clean(spark, base, ["hourly_rain"], [2021])
    assert back.count() == 1 and dict(back.dtypes)["value"] == "float"
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("encoding", ["utf-8-sig", "tis-620"])
def test_station_csv_encodings(spark, tmp_path, encoding):
    text = "Station_Code,Station Name,Latitude\n A1 , กรุงเทพ ,13.7\n"
    (tmp_path / "s.csv").write_bytes(text.encode(encoding))
    row = ST.scan_station_csv(spark, str(tmp_path / "s.csv"), "hourly_rain").first()
    assert (row["station_code"], row["station_name"], row["catalog"]) == ("A1", "กรุงเทพ", "hourly_rain")


def test_station_master_and_cross_map(spark, tmp_path):
    cat = spark.createDataFrame([("A", "hourly_rain", "13.7", "100.5"), ("A", "pressure", "13.7", "100.5"), ("A", "humidity", "13.7", "100.5"),
                                 ("B", "hourly_rain", "bad", "100.5"), ("C", "pressure", "13.0", "100.0")],
                                "station_code string, catalog string, latitude string, longitude string")
    master = ST.station_master(cat)
    got = {r["station_code"]: (r["has_all_three"], r["valid_thailand_coords"]) for r in master.collect()}
    assert got == {"A": (True, True), "B": (False, False)}
    s = ST.cross_map_summary(master, cat).first()
    assert (s["total_stations"], s["pressure_stations_count"], s["stations_with_all_three_catalogs"]) == (2, 2, 1)
    ST.write_cross_map(master, cat, str(tmp_path / "map"))
    rec = spark.read.json(str(tmp_path / "map" / "stations")).where("station_code = 'A'").first()["record"]
    assert rec["has_pressure"] and rec["station_name"] == ""


def test_run_files(spark, tmp_path):
    df = spark.createDataFrame([("gfs", "2024-01-01 12:00:00", "G_1_1", 1, float("nan"))], "origin string, run_time string, grid_id string, lead_time_hours int, tp double") \
        .withColumn("run_time", F.col("run_time").cast("timestamp_ntz"))
    FS.write_runs(df, str(tmp_path / "runs"))
    assert FS.scan_runs(spark, str(tmp_path / "runs")).first()["tp"] is None
    single = tmp_path / "tagged" / "gfs" / "run_20240101_12z.parquet"
    df.coalesce(1).write.parquet(str(single))
    row = spark.createDataFrame([(str(single),)], "p string")
    tag = FS.run_tags(row, F.col("p")).first()
    assert str(tag["file_run_time"]) == "2024-01-01 12:00:00" and tag["file_origin"] == "gfs"


def test_hourly_json(spark, tmp_path):
    doc = {"latitude": 13.7, "longitude": 100.5, "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "precipitation_gfs": [1.5, None], "rain": ["x", 2], "cape": [10]}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    rows = FS.hourly_json_to_rows(spark, str(tmp_path), "gfs").orderBy("time").collect()
    assert [(r["precipitation"], r["rain"], r["cape"]) for r in rows] == [(1.5, None, 10.0), (None, 2.0, None)]


def test_lead_json(spark, tmp_path):
    def doc(lead, apcp, n=2):
        v = {k: [1.0] * n for k in ("t2m", "sp", "u10", "v10", "cape")}
        return {"date": "2024-01-01", "cycle": "12:00", "lead": lead, "coords_count": 2, "variables": {**v, "apcp": apcp}}
    for i, d in enumerate([doc(1, [1.0, 0.0]), doc(2, [3.0, 0.5]), doc(3, [9.0]), doc(7, [2.0, 2.0])]):
        (tmp_path / f"lead_f{i}.json").write_text(json.dumps(d))
    coords = spark.createDataFrame([(0, 13.75, 100.5), (1, 14.0, 101.0)], "pos int, lat double, lon double")
    rows = FS.lead_json_to_rows(spark, str(tmp_path), coords).collect()
    got = {(r["lead_time_hours"], r["lat"]): r["tp"] for r in rows}
    assert got == {(1, 13.75): 1.0, (1, 14.0): 0.0, (2, 13.75): 2.0, (2, 14.0): 0.5, (7, 13.75): 2.0, (7, 14.0): 2.0}
    assert {str(r["valid_time"]) for r in rows if r["lead_time_hours"] == 7} == {"2024-01-01 19:00:00"}


def test_prediction_files_and_tags(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "gfs", "hurdle", "m1"), (2.0, "gfs", "gbt", "m3")], "corrected_rain double, weather_model string, model_name string, ablation string")
    TB.write_predictions(df, str(tmp_path / "p"), str(tmp_path / "c"))
    assert TB.scan_predictions(spark, str(tmp_path / "p")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    w, m, a = FS.prediction_tags(F.col("p"), ["lightgbm", "hurdle"])
    rows = spark.createDataFrame([("x/ecmwf_ifs_hurdle_m2_pred.parquet",), ("x/ncep_gfs/lightgbm_m1_pred.parquet",)], "p string")
    got = {(r["w"], r["m"], r["a"]) for r in rows.select(w.alias("w"), m.alias("m"), a.alias("a")).collect()}
    assert got == {("ecmwf_ifs", "hurdle", "m2"), ("ncep_gfs", "lightgbm", "m1")}


def test_features_scan_pushes_the_year(spark, tmp_path):
    df = spark.createDataFrame([("2024-12-31 23:00:00", "r", "g", 1.5, 7), ("2025-01-01 00:00:00", "r", "g", 2.5, 8)],
                               "valid_time string, run_time string, grid_id string, x double, n long").withColumn("valid_time", F.col("valid_time").cast("timestamp_ntz"))
    TB.write_features(df, str(tmp_path / "f"))
    back = TB.scan_features(spark, str(tmp_path / "f"))
    assert back.count() == 1 and dict(back.dtypes)["x"] == "float" and dict(back.dtypes)["n"] == "int"
    assert "LessThan(valid_time" in back._jdf.queryExecution().executedPlan().toString()


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("2021-06-01 00:10:00", 1.0), ("2024-06-01 00:10:00", 2.0)], "timestamp string, bt_mean double").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    TB.write_snapshots(df, str(tmp_path / "s"))
    assert TB.scan_snapshots(spark, str(tmp_path / "s"), satellites=["H08"]).count() == 1
    assert TB.scan_snapshots(spark, str(tmp_path / "s"), start="2024-01-01").count() == 1


def test_second_acquisition_finds_everything(spark):
    req = INV.requested_cycles(spark, ["gfs"], "2024-01-01", "2024-01-03")
    assert INV.plan_missing(req, req.limit(0)).count() == 6
    assert INV.plan_missing(req, req).count() == 0
    p = INV.progress(req, req.where("hour(run_time) = 12")).first()
    assert (p["total"], p["skipped"], p["todo"], p["done_pct"]) == (6, 3, 3, 50.0)


def test_prefer_source(spark):
    a = spark.createDataFrame([("g", 1, "x")], "origin string, run_time int, v string")
    b = spark.createDataFrame([("g", 1, "y"), ("g", 2, "z")], "origin string, run_time int, v string")
    assert {r["v"] for r in FS.prefer_source([a, b]).collect()} == {"x", "z"}

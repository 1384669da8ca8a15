"""Steps that must grow no faster than their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvian.models import boosting as B
from pluvian.models import residual as M
from pluvian.session import spread
from pluvian.sources import forecasts as FS


def test_lead_documents_are_parsed_once(spark):
    values = {v: [1.0, 2.0] for v in FS.LEAD_VARIABLES}
    texts = [{"date": "2024-01-01", "cycle": "00:00", "lead": 1, "variables": values},
             {"date": "2024-01-01", "cycle": "00:00", "lead": 2, "variables": values | {"cape": [1.0]}},  # too short
             {"date": "2024-01-01", "cycle": "00:00", "lead": 3, "variables": {k: v for k, v in values.items() if k != "sp"}}]
    import json
    docs = spark.createDataFrame([(json.dumps(t),) for t in texts], "t string").select(
        F.from_json("t", FS.LEAD_SCHEMA.simpleString()).alias("d")).select("d.*")
    out = FS.lead_rows(docs, spark.createDataFrame([(0, 13.0, 100.0), (1, 14.0, 101.0)], "pos int, lat double, lon double"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert sorted((r["lead_time_hours"], r["lat"]) for r in out.collect()) == [(1, 13.0), (1, 14.0)]


@pytest.fixture
def small_splits(spark):
    """Every small file is a split of its own, as large files are."""
    names = [f"spark.sql.files.{n}" for n in ("maxPartitionBytes", "openCostInBytes")]
    old = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "1m")
    yield
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def test_training_parts_grow_with_the_table(spark, small_splits, monkeypatch):
    df = spark.range(0, 600, 1, 6).select((F.col("id") % 7).cast("double").alias("x"), F.col("id").cast("double").alias("y"),
                                          (F.col("id") % 5 == 0).alias("is_val"), (F.col("id") % 5 != 0).alias("is_train"))
    assert M.assembled(df, ["x"], M.TreeSettings(partitions=2)).rdd.getNumPartitions() >= 6
    assert spread(df.coalesce(1), 3).rdd.getNumPartitions() >= 3
    seen, plain = [], B.Fit.__init__

    def watched(self, rows, *rest):
        seen.append(rows.getNumPartitions())
        plain(self, rows, *rest)
    monkeypatch.setattr(B.Fit, "__init__", watched)
    B.fit(df, ["x"], [B.Objective()], "y", B.BoostSettings(rounds=1, leaves=2, patience=None, partitions=2))
    assert seen[0] >= 6


def test_dense_sketches_count_alike():
    cells = B.sketch_cells(np.random.default_rng(1).normal(0, 9, 5000))
    a, b = B.Counts.of(cells), B.Counts.of_all(np.bincount(cells, minlength=B.WIDTH))
    assert (a.keys == b.keys).all() and (a.n == b.n).all()

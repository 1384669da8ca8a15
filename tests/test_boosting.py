"""The booster against closed forms, plain boosting and its own guarantees."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pluvian.models import boosting as B


def frame(spark, x, y, val=None, parts=4):
    pdf = pd.DataFrame({f"x{k}": x[:, k].astype(float) for k in range(x.shape[1])})
    pdf["y"], pdf["is_val"] = y.astype(float), np.zeros(len(y), bool) if val is None else val
    pdf["is_train"], pdf["id"] = ~pdf["is_val"], range(len(y))
    return spark.createDataFrame(pdf).repartition(parts), [f"x{k}" for k in range(x.shape[1])]


def fitted(spark, x, y, objective=B.Objective(), val=None, parts=4, **settings):
    df, names = frame(spark, x, y, val, parts)
    return B.fit(df, names, [objective], "y", B.BoostSettings(**{"step": 1.0, "least_rows": 1, "patience": None, **settings}))[0]


def test_squared_stump_is_the_closed_form(spark):
    x = np.repeat(np.arange(10), 7)[:, None]
    y = np.where(x[:, 0] < 4, 1.0, 5.0) + np.tile([-0.5, 0, 0.5, 0.25, -0.25, 0, 0], 10)
    m = fitted(spark, x, y, rounds=1, leaves=2)
    t = m.trees[0]
    assert t.feature.tolist() == [0, -1, -1] and m.edges[0][t.cut[0]] == 3.0
    assert np.allclose(m.predict(np.array([[3.0], [4.0], [-9.0], [99.0]])), [1, 5, 1, 5], atol=1e-5)


def test_best_leaf_first(spark):
    """A lopsided target: every split of value lies in one branch, where growth by level would waste half of its leaves."""
    x = np.repeat(np.arange(16), 8)[:, None]
    y = np.where(x[:, 0] >= 12, 0.0, 10.0 * 2.0 ** (12 - x[:, 0]))
    m = fitted(spark, x, y, rounds=1, leaves=13, least_rows=8)
    t = m.trees[0]
    depth = {0: 0}
    for i in range(len(t.feature)):
        if t.feature[i] >= 0:
            depth[t.left[i]] = depth[t.right[i]] = depth[i] + 1
    assert (t.feature < 0).sum() == 13 and max(depth.values()) >= 6  # four by level
    assert np.allclose(m.predict(np.arange(16)[:, None].astype(float)), np.where(np.arange(16) >= 12, 0, 10.0 * 2.0 ** (12 - np.arange(16))), rtol=1e-5, atol=1e-4)
    # with fewer leaves the largest gains are taken: the tree of k leaves is the start of that of k + 1
    few = fitted(spark, x, y, rounds=1, leaves=3, least_rows=8).trees[0]
    assert sorted(m.edges[0][few.cut[few.feature >= 0]]) == [0.0, 1.0]


def plain_leaves(x, g, leaves, least):
    """Best-first growth over all distinct values: the rows of each leaf."""
    held = [np.arange(len(g))]

    def best(rows):
        found = (0.0, None)
        for f in range(x.shape[1]):
            for c in np.unique(x[rows, f])[:-1]:
                left = x[rows, f] <= c
                n = left.sum()
                if least <= n <= len(rows) - least:
                    gain = g[rows][left].sum() ** 2 / n + g[rows][~left].sum() ** 2 / (len(rows) - n) - g[rows].sum() ** 2 / len(rows)
                    if gain > found[0] * (1 + 1e-12) + 1e-3:
                        found = (gain, (rows[left], rows[~left]))
        return found
    while len(held) < leaves:
        gains = [best(h) for h in held]
        k = int(np.argmax([a for a, _ in gains]))
        if gains[k][1] is None:
            break
        held.pop(k)
        held += gains[k][1]
    return held


@pytest.mark.parametrize("objective", [B.Objective(), B.Objective("absolute"), B.Objective("quantile", 0.9)])
def test_every_tree_is_that_of_plain_boosting(spark, objective):
    """Given the trees before it: the same gain as exact best-first growth, and leaves at the true mean or quantile."""
    def value(r):
        if objective.loss == "squared":
            return r.mean()
        level = 0.5 if objective.loss == "absolute" else objective.level
        return np.sort(r)[int(max(1, np.ceil(level * len(r)))) - 1]
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (400, 3))
    y = x[:, 0] * 1.7 - (x[:, 1] > 5) * 4 + rng.exponential(2, 400)
    m = fitted(spark, x, y, objective, rounds=4, leaves=6, step=0.3, least_rows=15)
    codes, out = B.coded(x.astype(float), m.edges), np.full(400, m.start)
    assert abs(m.start - value(y)) <= 0.0021 * abs(value(y)) + 1e-4 and len(m.trees) == 4
    for t in m.trees:
        r = y - out
        g, ends = objective.gradient(r), t.place(codes)
        own = [np.flatnonzero(ends == e) for e in np.unique(ends)]
        total = [sum(g[h].sum() ** 2 / len(h) for h in part) for part in (own, plain_leaves(x, g, 6, 15))]
        assert total[0] == pytest.approx(total[1], rel=1e-9)
        for h in own:
            assert len(h) >= 15 and abs(t.value[ends[h[0]]] - 0.3 * value(r[h])) <= 0.0021 * abs(value(r[h])) + 1e-4
        out += t.predict(codes)
    assert np.allclose(out, m.predict(x.astype(float)))


def test_cut_into_tasks_does_not_matter(spark):
    rng = np.random.default_rng(8)
    x, noise = rng.integers(0, 20, (500, 2)), rng.normal(0, 1, 500)
    models = [fitted(spark, x, x[:, 0] + noise, B.Objective("absolute"), parts=p, rounds=12, leaves=5, step=0.2).to_json() for p in (1, 7)]
    assert models[0] == models[1]


def test_sums_combined_on_executors(spark, monkeypatch):
    monkeypatch.setattr(B, "DIRECT", 1)
    x = np.arange(60)[:, None]
    assert len(fitted(spark, x, x[:, 0] > 30, rounds=2, leaves=3, parts=6).trees) == 2


def test_patience_waits_for_a_later_gain(spark, monkeypatch):
    """Round 2 is worse on the validation rows and round 4 better; patience 1 stops, patience 3 finds the later one."""
    x = np.arange(80)[:, None]
    val = np.arange(80) % 2 == 1
    true = B.Fit._pass
    planned = iter(())

    def scripted(self, growing):
        out = true(self, growing)
        if all(len(g.nodes) == 1 for g in growing.values()) and self.models[0].start:
            loss = next(planned)
            out = [(*o[:3], int(loss * o[4] * B.POINT), o[4]) for o in out]
        return out
    monkeypatch.setattr(B.Fit, "_pass", scripted)
    kept = {}
    for patience in (1, 3):
        planned = iter([10, 8, 9, 8.5, 6, 7, 7, 7, 7, 7, 7])
        m = fitted(spark, x, x[:, 0] + 1.0, B.Objective(), val, rounds=9, leaves=2, step=0.1, patience=patience)
        kept[patience] = (len(m.trees), m.curve)
    assert kept[1] == (1, [10, 8, 9]) and kept[3][0] == 4 and len(kept[3][1]) == 8


def test_quantiles_cover_what_they_say(spark):
    rng = np.random.default_rng(6)
    n = 6000
    x = rng.integers(0, 30, (n, 2))
    y = x[:, 0] * (1 + rng.exponential(1, n))
    val = rng.random(n) < 0.4
    df, names = frame(spark, x, y, val)
    levels = (0.1, 0.5, 0.9, 0.95)
    models = B.fit(df, names, [B.Objective("quantile", q) for q in levels], "y", B.BoostSettings(rounds=60, leaves=6, step=0.15, least_rows=60, patience=None))
    out = B.predictions(df.where("is_val"), models, names, ["q10", "q50", "q90", "q95"]).toPandas()
    for q, c in zip(levels, ("q10", "q50", "q90", "q95")):
        assert abs((out["y"] <= out[c]).mean() - q) <= 0.03
    from pluvian.models import residual as M
    forest = M.quantile_forest(df.withColumn("target_bias", F.col("y")), names)[1].toPandas()
    for q, c in zip(levels, ("q10", "q50", "q90", "q95")):
        loss = [np.mean(B.Objective("quantile", q).value((t["y"] - t[c]).to_numpy())) for t in (out, forest)]
        assert loss[0] < loss[1]


def test_saved_and_loaded(spark, tmp_path):
    x = np.arange(50)[:, None]
    m = fitted(spark, x, np.sin(x[:, 0]), rounds=4, leaves=4)
    m.save(spark, str(tmp_path / "m"))
    back = B.Booster.load(spark, str(tmp_path / "m"))
    assert back.to_json() == m.to_json() and np.array_equal(back.predict(x.astype(float)), m.predict(x.astype(float)))


def test_sketch():
    rng = np.random.default_rng(0)
    r = np.concatenate([rng.normal(0, 5, 1001), np.zeros(300), rng.exponential(100, 500), [1e-9, -1e12, 1e12]])
    counts = B.Counts.of(B.sketch_cells(r[:700])) + B.Counts.of(B.sketch_cells(r[700:]))
    for level in (0.05, 0.1, 0.37, 0.5, 0.9, 0.95):
        true = np.sort(r)[int(np.ceil(level * len(r))) - 1]
        assert abs(B.sketch_quantile(counts, level) - true) <= 0.0021 * abs(true) + B.FINEST


def test_constant_features_and_no_rows(spark):
    x = np.ones((30, 2))
    m = fitted(spark, x, np.arange(30), rounds=3)
    assert np.allclose(m.predict(x), 14.5, atol=1e-5) and all(len(t.feature) == 1 for t in m.trees)
    df, names = frame(spark, x, np.arange(30), np.ones(30, bool))
    with pytest.raises(ValueError):
        B.fit(df, names, [B.Objective()], "y")
    with pytest.raises(ValueError):
        B.Objective("cubic")


def test_rows_of_equal_bins_are_one_cell(spark):
    """Copies of the rows add no cells, so passes do not grow with them; a cell with most rows is dealt to several blocks."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (4000, 2))
    pdf = pd.DataFrame({"f0": x[:, 0] * 1.0, "f1": x[:, 1] * 1.0, "y": rng.normal(size=4000), "r0": np.where(x[:, 0] < 5, B.VALIDATE, B.TRAIN).astype(np.int8)})
    edges = [np.arange(19.0), np.arange(19.0)]
    one = spark.createDataFrame(pdf).repartition(3)
    for times in (1, 6):
        blocks = B.binned(one.crossJoin(spark.range(times)).drop("id").coalesce(2), 2, 1, edges, 4).collect()
        assert len(blocks) == 4 and sum(c.shape[1] for c, *_ in blocks) == len({(a, b) for a, b in x})
        got = sorted((*c[:, i].tolist(), int(r[0, i]), v) for c, r, n, y in blocks for i, own in enumerate(np.split(y, np.cumsum(n)[:-1])) for v in own.tolist())
        assert got == sorted([(a, b, int(r), v) for (a, b), r, v in zip(x.tolist(), pdf.r0, pdf.y)] * times)
    crowd = one.withColumns({c: F.when(F.col("y") < 1, 3.0).otherwise(F.col(c)) for c in ("f0", "f1")})
    sizes = [len(y) for *_, y in B.binned(crowd, 2, 1, edges, 4).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_many_features_keep_their_rows_apart(spark):
    """More columns than one number holds: cells are still told apart exactly."""
    codes = np.random.default_rng(5).integers(0, 2, (40, 500)).astype(np.uint8)
    codes[:, 250:] = codes[:, :250]
    found, n, y = B.cells_of(codes, np.ones(500, dtype=np.int64), np.arange(500.0))
    assert found.shape[1] == len(np.unique(codes, axis=1).T) == 250 and (n == 2).all()
    assert all((codes[:, y[2 * k:2 * k + 2].astype(int)] == found[:, [k]]).all() for k in range(250))


def test_leaves_by_bits_are_those_of_the_walk(spark):
    rng = np.random.default_rng(8)
    for leaves in (1, 2, 7, 64, 90):
        feature, cut, left, right, open_ = [-1], [-1], [-1], [-1], [0]
        while len(open_) < leaves:
            i = open_.pop(int(rng.integers(len(open_))))
            feature[i], cut[i], left[i], right[i] = int(rng.integers(3)), int(rng.integers(255)), len(feature), len(feature) + 1
            open_ += [left[i], right[i]]
            for column in (feature, cut, left, right):
                column += [-1, -1]
        t = B.Tree(*[np.array(c, dtype=np.int32) for c in (feature, cut, left, right)], np.zeros(len(feature)))
        codes = rng.integers(0, 256, (3, 3000)).astype(np.uint8)
        assert (t.place(codes) == t.walked(codes)).all()

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opsreliability.operators import boost as B
from opsreliability.operators.evaluate import roc_auc
from opsreliability.session import shared_folder


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    n = 4000
    d = pd.DataFrame({"id": np.arange(n), "c": r.choice(["u", "v", "w", None], n), "a": r.normal(size=n), "b": r.normal(size=n)})
    z = 1.5 * np.sin(2 * d.a) + (d.c == "u") * d.b
    d["y"] = (r.random(n) < 1 / (1 + np.exp(-z))).astype(float)
    d.loc[::50, "y"] = np.nan
    d.loc[::17, "a"] = np.nan
    s = spark.createDataFrame(d).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("y", "a")}).repartition(4)
    return s.where("id % 4 < 2").cache(), s.where("id % 4 = 2").cache(), s.where("id % 4 = 3").cache()


@pytest.fixture(scope="module")
def model(data):
    return B.fit_stopped(data[0], data[1], ["c"], ["a", "b"], "y", depth=3, step=0.3, patience=4, rewrite=3)


def test_growing_stops_by_validation_loss(model, data):
    losses = [h["valid_loss"] for h in model.history]
    best = int(np.argmin(losses))
    assert len(losses) - 1 - best == 4 and len(model.trees) == best > 2  # far below 400 trees
    assert losses[best] < losses[0] and all(np.diff([h["train_loss"] for h in model.history]) < 0)
    p = model.predict(data[1].where("y IS NOT NULL"), keep=["y"]).toPandas()
    loss = -np.log(np.where(p.y > 0, p.p, 1 - p.p)).mean()
    assert abs(loss - losses[best]) < 1e-9  # what is kept has the lowest loss
    assert roc_auc(model.predict(data[2].where("y IS NOT NULL")), y="y").first()[0] > 0.72


def test_one_task_fits_as_well(model, data):
    one = B.fit_stopped(data[0].coalesce(1), data[1].coalesce(1), ["c"], ["a", "b"], "y", depth=3, step=0.3, patience=4)
    # the cuts are approximate quantiles, so trees may differ a little
    assert abs(min(h["valid_loss"] for h in one.history) - min(h["valid_loss"] for h in model.history)) < 0.02


def test_saved_trees_predict_alike(spark, model, data):
    path = shared_folder(spark, "boosted")
    model.save(spark, path)
    again = B.BoostedTrees.load(spark, path)
    odd = data[2].withColumn("c", F.when(F.col("id") % 3 == 0, "unseen").otherwise(F.col("c")))
    a, b = (m.predict(odd, keep=["id"]).toPandas().sort_values("id").p for m in (model, again))
    assert np.array_equal(a, b) and a.between(0, 1).all() and again.history == model.history


def test_best_split_is_the_best_of_all():
    r = np.random.default_rng(5)
    bins, g, h = r.integers(0, 6, (200, 3)), r.normal(size=200), r.random(200)
    cells = np.zeros((3, 3, 6))
    for f in range(3):
        for i, v in enumerate((g, h, np.ones(200))):
            cells[i, f] = np.bincount(bins[:, f], weights=v, minlength=6)
    best = (-1, 0, 0)
    for f in range(3):
        for b in range(5):
            left = bins[:, f] <= b
            if min(left.sum(), (~left).sum()) >= 15:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
                best = max(best, (gain, f, b))
    got = B.best_split(*cells, 15, 1.0)
    assert got[1:] == best[1:] and abs(got[0] - best[0]) < 1e-9
    assert B.best_split(*cells, 150, 1.0) is None


def test_no_rows_and_no_validation(data):
    none = data[0].limit(0)
    m = B.fit_stopped(none, none, ["c"], ["a"], "y", max_trees=2)
    assert m.predict(data[2]).where("p = 0.5").count() == data[2].count()
    assert len(B.fit_stopped(data[0], none, ["c"], ["a"], "y", max_trees=2, depth=2).trees) == 2


def test_sisters_are_added_up_once_and_leaves_cost_no_pass(spark, monkeypatch):
    """Grown trees equal those of a plain boosting in memory; a tree of depth 3 takes a root and two more passes, which
    add up one sister of two."""
    r = np.random.default_rng(8)
    x = r.integers(0, 9, (3000, 3))
    y = (r.random(3000) < 1 / (1 + np.exp(-(x[:, 0] - 4.0) * (x[:, 1] > 4) + (x[:, 2] == 3)))).astype(float)
    d = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})).repartition(3)
    asked, passed = [], B._passed
    monkeypatch.setattr(B, "_passed", lambda *a: (asked.append(list(a[3])), passed(*a))[1])
    m = B.fit_stopped(d, d.limit(0), [], ["a", "b", "c"], "y", max_trees=3, depth=3, min_rows=5, weight=2.0)
    assert len(asked) == 3 * 3 + 1 and max(map(len, asked)) == 2
    bins = m.bins(x.tolist())
    margin, w = np.full(3000, m.prior), np.where(y == 1, 2.0, 1.0)
    for tree in m.trees:
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (y - p), w * p * (1 - p)
        reached = [np.arange(3000)]
        for at, (f, cut, left, right, value) in enumerate(tree):
            here = reached[at]
            assert abs(value - 0.1 * g[here].sum() / (h[here].sum() + 1)) < 1e-9
            if f >= 0:
                assert (left, right) == (len(reached), len(reached) + 1)
                cells = np.array([[np.bincount(bins[here, j], v[here], 64) for j in range(3)] for v in (g, h, np.ones(3000))])
                assert B.best_split(*cells, 5, 1.0)[1:] == (f, cut)
                reached += [here[bins[here, int(f)] <= cut], here[bins[here, int(f)] > cut]]
        margin += B.add_trees([tree], bins)


def test_walk_ends_in_leaves_of_any_depth():
    tree = np.array([[1, 3, 1, 2, 0], [-1, 0, -1, -1, 1.5], [0, 0, 3, 4, 0], [-1, 0, -1, -1, 2.5], [-1, 0, -1, -1, 3.5]])
    assert B.walk(tree, np.array([[0, 3], [0, 4], [1, 255]], np.uint8)).tolist() == [1, 3, 4]
    assert B.walk(tree[1:2], np.zeros((2, 2), np.uint8)).tolist() == [0, 0]

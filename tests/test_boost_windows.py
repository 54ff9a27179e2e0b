from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opsreliability.operators import boost_windows as BW
from opsreliability.operators.boost import add_trees

FEATURES = ["a", "b"]
DAY0 = date(2020, 1, 1)
ENDS = [DAY0 + timedelta(days=d) for d in (200, 207, 214)]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(7)
    n = 2400
    d = pd.DataFrame({"day": [DAY0 + timedelta(days=i // 10) for i in range(n)], "a": r.normal(size=n),
                      "b": r.normal(size=n)})
    d["y"] = 3 * np.sin(2 * d.a) + d.b * (d.a > 0) + r.normal(size=n) * 0.5
    d.loc[::40, "a"] = np.nan
    d.loc[::90, "y"] = np.nan
    s = spark.createDataFrame(d)
    return s.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("y", "a")}).repartition(4).cache()


def fit(rows, ends=ENDS, **more):
    return BW.fit_windows(rows, FEATURES, "y", "day", ends, depth=3, step=0.5, patience=3, **more)


@pytest.fixture(scope="module")
def models(rows):
    return fit(rows)


def grown_alone(d, cuts, end, trees):
    """Plain boosting of one window in numpy, ``trees`` trees."""
    d = d[d.y.notna()]
    x = np.stack([np.where(d[c].isna(), 0, 1 + np.searchsorted(e, d[c])) for c, e in zip(FEATURES, cuts)], 1)
    day = pd.to_datetime(d.day).dt.date
    t = (day <= end - timedelta(days=28)).to_numpy()
    m = np.zeros(len(d))
    for _ in range(trees):
        leaves = [np.ones(len(d), bool)]
        for _ in range(3):
            after = []
            for rows in leaves:
                best, e = (1e-9, None), d.y.to_numpy() - m
                worth = lambda s: e[s & t].sum() ** 2 / ((s & t).sum() + 1)
                for f in range(2):
                    for b in range(max(len(c) for c in cuts) + 1):
                        left = rows & (x[:, f] <= b)
                        right = rows & ~left
                        if min((left & t).sum(), (right & t).sum()) < 10:
                            continue
                        gain = worth(left) + worth(right) - worth(rows)
                        if gain > best[0] + 1e-7:
                            best = (gain, (left, right))
                after += [rows] if best[1] is None else list(best[1])
            leaves = after
        e = d.y.to_numpy() - m
        for rows in leaves:
            m[rows] += 0.5 * e[rows & t].sum() / ((rows & t).sum() + 1)
    return m, d, day


def test_windows_grown_together_equal_each_grown_alone(rows, models):
    d = rows.toPandas()
    for k, end in enumerate(ENDS):
        m, known, day = grown_alone(d, models.cuts, end, 2)
        x = np.stack([np.where(known[c].isna(), 0, 1 + np.searchsorted(e, known[c]))
                      for c, e in zip(FEATURES, models.cuts)], 1).astype(np.uint8)
        assert np.allclose(add_trees(models.trees[k][:2], x), m, atol=1e-6)
        held = ((day > end - timedelta(days=28)) & (day <= end)).to_numpy()
        assert abs(((known.y - m)[held] ** 2).mean() - models.history[k][2]) < 1e-5


def test_growing_stops_by_the_held_out_days(models):
    for trees, h in zip(models.trees, models.history):
        assert len(trees) == int(np.argmin(h)) > 2 and len(h) - 1 - len(trees) == 3 and min(h) < h[0] / 2


def test_same_models_for_any_partitioning(rows, models):
    other = fit(rows.repartition(7, "b"), cuts=models.cuts, rewrite=2)
    assert other.history == models.history
    assert all(np.array_equal(a, b) for x, y in zip(models.trees, other.trees) for a, b in zip(x, y))


def test_predictions_use_the_window_of_their_day(spark, rows, models):
    ask = rows.where("day > '2020-07-25'").withColumn("end", F.lit(ENDS[1]))
    one = models.predict(ask, "end", "p").agg(F.avg(F.abs(F.col("p") - F.col("y"))), F.avg(F.abs("y"))).first()
    assert one[0] < 0.6 * one[1]
    unknown = models.predict(ask.withColumn("end", F.lit(DAY0)), "end", "p")
    assert unknown.where("p IS NOT NULL").count() == 0


def test_later_rows_change_nothing(rows, models):
    spoiled = rows.withColumn("y", F.when(F.col("day") > F.lit(ENDS[0]), F.lit(99.0)).otherwise(F.col("y")))
    again = fit(spoiled, ENDS[:1], cuts=models.cuts)
    assert np.allclose(again.history[0], models.history[0])


def test_no_rows_and_a_gap_before_the_end(rows):
    none = fit(rows.limit(0), max_trees=3)
    assert none.trees == [[], [], []] and none.predict(rows.withColumn("end", F.lit(ENDS[0])), "end", "p").where(
        "p = 0").count() == rows.count()
    early = fit(rows.where("day < '2020-04-01'"), max_trees=2)
    assert early.train_ends == [date(2020, 3, 3)] * 3  # held out up to the last row, not to the end
    assert [len(h) for h in early.history] == [3, 3, 3] and early.history[0] == early.history[2]

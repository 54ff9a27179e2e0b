from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opsreliability.operators import explain as EX
from opsreliability.operators import learn as L
from opsreliability.operators import segment as SG
from opsreliability.operators.evaluate import roc_auc


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(2)
    n = 3000
    pdf = pd.DataFrame({"id": [f"i{i}" for i in range(n)], "c": r.choice(list("xyz"), n),
                        "a": r.normal(size=n), "b": r.normal(size=n)})
    z = 1.5 * pdf.a - pdf.b * (pdf.c == "x") + 0.5 * (pdf.c == "y")
    pdf["y"] = (r.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    df = spark.createDataFrame(pdf)
    return df.where("id < 'i6'").cache(), df.where("id >= 'i6'").cache()


def test_logistic_beats_the_prior_and_explains_itself(data):
    tr, te = data
    m = L.fit_logistic(tr, ["c"], ["a", "b"], "y", rare=50)
    assert roc_auc(L.predict(m, te)).first()[0] > 0.7
    c = EX.contributions_linear(m, te, ["a", "b"], ["c"], tr)
    gap = c.select(F.max(F.abs(F.col("base") + F.col("c_a") + F.col("c_b") + F.col("c_c")
                               - F.col("raw")))).first()[0]
    assert gap < 1e-9
    unseen = te.limit(5).withColumn("c", F.lit("never seen"))
    assert L.predict(m, unseen).where("p IS NULL").count() == 0


def test_tree_contributions_are_shapley_values(data):
    tr, te = data
    m = L.fit_boosted(tr, te, ["c"], ["a", "b"], "y", trees=3, depth=3)
    rows = EX.contributions_trees(m, te.limit(40), ["c", "a", "b"]).toPandas()
    total = rows[["c_c", "c_a", "c_b"]].sum(axis=1) + rows.base
    assert np.allclose(total, rows.raw, atol=1e-9)

    paths = EX.tree_paths(m)

    def value(x, known):
        v = 0.0
        for leaf, groups in paths:
            w = 1.0
            for f, share, steps in groups:
                if f in known:
                    w *= all(((x[f] in cats) if cats is not None else (x[f] <= cut)) == left
                             for left, cut, cats in steps)
                else:
                    w *= share
            v += leaf * w
        return v

    x = np.array([[1.0, 0.3, -0.7]])
    phi, base = EX.shapley_batch(x, paths, 3)
    assert base == pytest.approx(value(x[0], set()))
    for i in range(3):
        rest = [j for j in range(3) if j != i]
        want = sum(factorial(k) * factorial(2 - k) / 6 * (value(x[0], {*s, i}) - value(x[0], set(s)))
                   for k in range(3) for s in combinations(rest, k))
        assert phi[0, i] == pytest.approx(want)


def test_boosting_is_repeatable(data):
    tr, te = data
    p = [L.predict(L.fit_boosted(tr, te, ["c"], ["a", "b"], "y", trees=2, depth=2), te.orderBy("id"))
         .limit(20).toPandas().p.to_list() for _ in range(2)]
    assert p[0] == p[1]


def test_calibrators_are_monotone_and_bounded(spark):
    r = np.random.default_rng(4)
    p = r.random(2000)
    df = spark.createDataFrame(pd.DataFrame({"y": (r.random(2000) < p ** 2).astype(int), "p": p}))
    out = L.apply_isotonic(L.fit_isotonic(df, "y", "p"), df, "p", "q").orderBy("p").toPandas()
    assert (np.diff(out.q) >= -1e-12).all() and out.q.between(0, 1).all()
    a, b = L.fit_platt(df, "y", "p")
    s = L.apply_platt((a, b), df, "p", "q").orderBy("p").toPandas()
    assert a > 0 and (np.diff(s.q) >= 0).all() and abs(s.q.mean() - s.y.mean()) < 0.01


def test_quantile_tree_orders_its_quantiles(data):
    tr, te = data
    fit = L.fit_quantile_tree(tr.withColumn("m", F.col("a") * 10), ["c"], ["a", "b"], "m", depth=3)
    q = L.predict_quantiles(fit, te)
    assert q.where("q10 > q50 OR q50 > q90 OR q50 IS NULL").count() == 0
    assert q.select(F.corr("q50", "a")).first()[0] > 0.9


def test_segments_of_separate_groups(spark):
    r = np.random.default_rng(6)
    pdf = pd.DataFrame([{"item": f"{g}{i}", "log_departures": g + r.normal() * 0.05,
                         "evening_share": g * 2 + r.normal() * 0.05} for g in range(4)
                        for i in range(30)])
    items, scores = SG.segment_items(spark.createDataFrame(pdf), ["log_departures", "evening_share"],
                                     "log_departures", SG.SITE_TIERS, range(3, 6))
    assert max(scores, key=scores.get) == 4
    prof = SG.segment_profile(items, ["log_departures"])
    assert sorted(r.members for r in prof.collect()) == [30] * 4
    best = items.where("log_departures > 2.5").select("segment").distinct().collect()
    assert [r.segment for r in best] == ["Major hub - evening-heavy bank"]


def test_logistic_prepares_as_the_stages_of_spark_do(spark, monkeypatch):
    from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
    rows = [("ab"[i % 2] if i % 7 else None, f"r{i % 90}", None if i % 10 == 3 else float("nan") if i % 10 == 4 else float(i * i % 37),
             float(i % 5), 2.0, i % 3 % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "c string, r string, a double, b float, k double, y int").repartition(3)

    def not_used(self, *args):
        raise AssertionError("the preparation reads the rows through stages of vectors")

    with monkeypatch.context() as only:
        only.setattr(StringIndexer, "_fit", not_used)
        only.setattr(StandardScaler, "_fit", not_used)
        m = L.fit_logistic(df, ["c", "r"], ["a", "b", "k"], "y", rare=5)
    index = StringIndexer(inputCols=["c", "r"], outputCols=["ci", "ri"], handleInvalid="keep").fit(df)
    assert [list(s.labels) for s in m.stages[1:3]] == [list(x) for x in index.labelsArray]
    names = ["a", "b", "k"]
    doubles = df.selectExpr("*", *[f"CAST({c} AS DOUBLE) AS {c}d" for c in names])
    full = Imputer(inputCols=[f"{c}d" for c in names], outputCols=[f"{c}m" for c in names], strategy="median").fit(
        doubles).transform(doubles)
    v = VectorAssembler(inputCols=[f"{c}m" for c in names], outputCol="v").transform(full)
    z = StandardScaler(inputCol="v", outputCol="z", withMean=True).fit(v).transform(v)
    got = sorted(tuple(r.features.toArray()[:3]) for r in m.transform(df).select("features").collect())
    want = sorted(tuple(r.z.toArray()) for r in z.select("z").collect())
    assert np.allclose(got, want, atol=1e-12)
    # a, b, the pool and rows without a value; of the 90 labels of r those seen less than 5 times share one indicator
    often = df.groupBy("r").count().where("count >= 5").count()
    sizes = list(next(s for s in m.stages if s.__class__.__name__ == "OneHotEncoderModel").categorySizes)
    assert sizes == [4, often + (often < 90)] and m.stages[-1].numFeatures == 3 + sum(sizes)


def test_weights_share_the_labels(data, monkeypatch):
    tr, te = data
    passes, index = [], L.StringIndexer._fit
    monkeypatch.setattr(L.StringIndexer, "_fit", lambda self, d: (passes.append(1), index(self, d))[1])
    _, weight, log = L.search_weight(tr, te, ["c"], ["a", "b"], "y", weights=(1, 4), trees=2, depth=2)
    assert len(passes) == 1 and weight in (1.0, 4.0)
    for row in log:
        own = L.fit_boosted(tr, te, ["c"], ["a", "b"], "y", weight=row["weight"], trees=2, depth=2)
        assert row["pr_auc"] == pytest.approx(L.avg_precision(L.predict(own, te)).first()[0])

import numpy as np
import pandas as pd

from opsreliability.operators import anomaly as AN


def _days(spark, n=3000):
    r = np.random.default_rng(1)
    d = pd.DataFrame({"k": [f"d{i}" for i in range(n)], "a": r.normal(size=n), "b": r.normal(size=n)})
    d.loc[:29, "a"] += 9.0
    return spark.createDataFrame(d)


def test_samples_are_the_smallest_ranks_for_any_partitioning(spark):
    d = _days(spark)
    h = {r.k: r.h for r in d.selectExpr("k", "xxhash64(7, k) h").collect()}
    keys = sorted(h)
    ranks = [AN._ranks(np.array([h[k] for k in keys], np.int64).view(np.uint64), t) for t in range(5)]
    want = {t: {keys[i] for i in np.argsort(r)[:64]} for t, r in enumerate(ranks)}
    for parts in (1, 7):
        got = AN.tree_samples(d.repartition(parts), ["a", "b"], "k", 5, 64, 7).toPandas()
        assert got.groupby("tree").size().max() <= 64 * parts
        for t, rows in got.groupby("tree"):
            assert set(rows.sort_values(["rank", "_key"])["_key"][:64]) == want[t]
    nodes = [AN.fit_forest(d.repartition(p), ["a", "b"], "k", 5, 64, 7).toPandas().sort_values(["tree", "node"])
             for p in (1, 7)]
    assert np.array_equal(nodes[0].to_numpy(), nodes[1].to_numpy())


def test_forest_flags_its_share_and_finds_the_odd_days(spark):
    got = AN.isolation_forest(_days(spark), ["a", "b"], "k", trees=100).toPandas()
    assert abs(got.is_anomaly.mean() - 0.02) < 0.002
    odd = got.k.isin([f"d{i}" for i in range(30)])
    assert got[odd].is_anomaly.mean() > 0.9
    few = AN.isolation_forest(_days(spark, 20), ["a", "b"], "k", trees=10)  # fewer rows than a sample
    assert few.count() == 20

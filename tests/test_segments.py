"""K-means with all starts in one job, against a plain run of each start."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from opsreliability.operators import segment as SG


@pytest.fixture(scope="module")
def items(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(m, 0.6, size=(40, 3)) for m in ((0, 0, 0), (3, 0, 1), (0, 4, 0), (5, 5, 5))])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(3)
    return df.select(array_to_vector("x").alias("z")), x


def plain_cost(x, centers):
    """Lloyd's steps of one start; cost of the centres last used."""
    for _ in range(50):
        far = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
        at = far.argmin(axis=1)
        new = np.array([x[at == i].mean(axis=0) if (at == i).any() else c for i, c in enumerate(centers)])
        moved, centers = ((new - centers) ** 2).sum(axis=1).max(), new
        if moved <= 1e-8:
            break
    return far.min(axis=1).sum()


def test_every_start_reaches_the_cost_of_a_plain_run(items):
    z, x = items
    runs = SG.fit_all_starts(z, [2, 4], starts=5, seed=1)
    assert sorted(runs) == [(k, i) for k in (2, 4) for i in range(5)]
    rows = np.array([r["x"] for r in z.select(SG.vector_to_array("z").alias("x"))
                     .orderBy(SG.F.xxhash64("x"), "x").collect()])
    for (k, i), run in runs.items():
        first = SG._first_centers(rows, k, np.random.default_rng([1, k, i]))
        assert run.cost == pytest.approx(plain_cost(x, first), rel=1e-9)


def test_more_starts_never_cost_more_and_all_items_are_placed(items):
    z, x = items
    runs = SG.fit_all_starts(z, [4], starts=8)
    best = min(runs.values(), key=lambda m: m.cost)
    assert best.cost <= runs[4, 0].cost
    sizes = best.transform(z).groupBy("segment_id").count().collect()
    assert sum(r["count"] for r in sizes) == len(x) and {r["segment_id"] for r in sizes} == {0, 1, 2, 3}
    far = ((x[:, None] - best.centers[None]) ** 2).sum(axis=2)
    assert sorted(r["count"] for r in sizes) == sorted(np.bincount(far.argmin(axis=1)).tolist())


def test_equal_items_and_no_items(spark, items):
    same = spark.createDataFrame([([1.0, 2.0],)] * 5, "x array<double>").select(array_to_vector("x").alias("z"))
    run = SG.fit_all_starts(same, [3], starts=2)[3, 0]
    assert run.cost == 0 and {r["segment_id"] for r in run.transform(same).collect()} == {0}
    with pytest.raises(ValueError, match="no items"):
        SG.fit_all_starts(items[0].limit(0), [2])

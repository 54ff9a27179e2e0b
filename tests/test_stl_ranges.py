import datetime

import numpy as np
import pandas as pd

from opsreliability.operators import anomaly as AN


def test_ranges_give_the_parts_of_the_whole_series(spark):
    r, n = np.random.default_rng(4), 1000
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(n)]
    y = 20 + 3 * np.sin(np.arange(n) * 2 * np.pi / 7) + 4 * np.sin(np.arange(n) / 90) + r.normal(size=n)
    y[[100, 500, 501, 800]] += 25.0
    holes = y.copy()
    holes[[0, 250, 251, 999]] = np.nan
    rows = [("a", d, float(v)) for d, v in zip(days, y)]
    rows += [("b", d, None if np.isnan(v) else float(v)) for d, v in zip(days, holes)]
    rows += [("short", d, 1.0) for d in days[:9]] + [("none", d, None) for d in days[:30]]
    d = spark.createDataFrame(rows, "k string, day date, v double").repartition(5)
    got = AN.stl_ranges(d, "k", "day", "v", outer=3, cycles=50).toPandas().sort_values(["k", "day"])
    assert len(got) == len(rows)
    for k, series in (("a", y), ("b", pd.Series(holes).interpolate(limit_direction="both").to_numpy())):
        want = AN.stl_arrays(series, outer=3)
        part = got[got.k == k]
        for c, w in zip(("seasonal", "trend", "resid"), want):
            assert np.allclose(part[c], w, atol=1e-6), (k, c, np.abs(part[c] - w).max())
    assert got[got.k.isin(["short", "none"])].seasonal.isna().all()

"""Order-dependent and skew-safe operators against brute force."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opsreliability.operators import evaluate as EV
from opsreliability.operators.joins import attach_stats
from opsreliability.operators.prefix import (exact_quantiles, grouped_quantiles, hot_keys,
                                             one_row_quantiles, rank_values, running_sum,
                                             sequence_in_group)
from opsreliability.operators.sampling import fixed_sample
from opsreliability.operators.windows import gap_to_prev


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds half of the rows, some rows have no key, many ties."""
    r = np.random.default_rng(1)
    n = 6000
    pdf = pd.DataFrame({"id": [f"r{i}" for i in range(n)],
                        "k": np.where(r.random(n) < 0.5, "hot", [f"k{i % 700}" for i in range(n)]),
                        "o": r.integers(0, 40, n), "v": r.integers(0, 1000, n)})
    pdf.loc[pdf.index % 9 == 0, "k"] = None
    return spark.createDataFrame(pdf), pdf


def test_hot_keys_are_found(skewed):
    assert [r.k for r in hot_keys(skewed[0].where("k IS NOT NULL"), ["k"], 1000).collect()] == ["hot"]


@pytest.mark.parametrize("hot_rows", [1000, 1_000_000])
def test_sequence_in_hot_groups(skewed, hot_rows):
    df, pdf = skewed
    got = sequence_in_group(df, ["k"], "o", "id", "no", ("v", "prev"), "size", hot_rows).toPandas()
    pdf = pdf.assign(h=[hashlib.md5(i.encode()).hexdigest() for i in pdf["id"]])
    want = pdf.dropna(subset=["k"]).sort_values(["o", "h"])
    g = want.groupby("k")
    want = want.assign(no=g.cumcount() + 1, prev=g["v"].shift(), size=g["id"].transform("size"))
    m = got.merge(want, on="id", suffixes=("", "_w"))
    assert len(m) == len(want) and (m.no == m.no_w).all() and (m["size"] == m.size_w).all()
    assert (m.prev.fillna(-1) == m.prev_w.fillna(-1)).all()
    assert got[got.k.isna()][["no", "prev", "size"]].isna().all().all()


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_rows_without_an_order_value_come_last(spark, hot_rows):
    df = spark.range(300).selectExpr("cast(id AS string) AS id", "'x' AS k",
                                     "if(id % 10 = 0, NULL, 2000000000000 + id % 7) AS o")
    got = sequence_in_group(df, ["k"], "o", "id", "no", ("id", "prev"), "n", hot_rows).toPandas()
    h = [hashlib.md5(i.encode()).hexdigest() for i in got["id"]]
    want = got.assign(h=h).sort_values(["o", "h"], na_position="last")
    assert want.no.tolist() == list(range(1, 301)) and set(got.n) == {300}
    assert want.prev.iloc[1:].tolist() == want["id"].iloc[:-1].tolist() and pd.isna(want.prev.iloc[0])


def test_negative_gap_is_null(spark):
    d = spark.createDataFrame([("a", "x", 10, 50), ("b", "x", 60, 90), ("c", "x", 80, 95)],
                              "id string, k string, dep int, arr int")
    rows = {r.id: r.gap for r in gap_to_prev(d, ["k"], "dep", "id", "dep", "arr", "gap").collect()}
    assert rows == {"a": None, "b": 10, "c": None}


def test_salted_join_equals_broadcast_join(skewed):
    df, pdf = skewed
    stats = df.groupBy("k").agg(F.count("*").alias("n"))
    a = attach_stats(df, stats, ["k"], "id", df.select("k"), broadcast_bytes=0, hot_rows=1000)
    b = attach_stats(df, stats, ["k"], "id", df.select("k"))
    assert sorted(map(tuple, a.select("id", "n").collect()), key=str) == sorted(
        map(tuple, b.select("id", "n").collect()), key=str)
    assert a.where("k = 'hot'").select("n").distinct().count() == 1


def test_running_sum_rank_and_quantiles(spark, skewed):
    df, pdf = skewed
    c = df.groupBy("v").agg(F.count("*").alias("n"))
    got = {r.v: r.cum_n for r in running_sum(c, "v", ["n"]).collect()}
    want = pdf.groupby("v").size().cumsum()
    assert got == want.to_dict()
    q = {r.q: r.value for r in exact_quantiles(df, "v", (0.0, 0.1, 0.5, 0.987, 1.0)).collect()}
    for p, v in q.items():
        assert v == pytest.approx(np.quantile(pdf.v, p))
    r = rank_values(df, "v").select("id", "rank").toPandas().set_index("id")["rank"]
    assert (r.loc[pdf.id].to_numpy() == pdf.v.rank(method="min", ascending=False).to_numpy()).all()


def test_fixed_sample_is_exact_and_repeatable(skewed):
    df, pdf = skewed
    got = {r.id for r in fixed_sample(df, "id", 500, 42).collect()}
    order = sorted(pdf.id, key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    assert got == set(order[:500])
    assert fixed_sample(df, "id", 10 ** 6).count() == len(pdf)


def test_rank_metrics_against_definitions(spark):
    r = np.random.default_rng(3)
    p = np.round(r.random(800), 2)
    y = (r.random(800) < p * 0.7).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": [str(i) for i in range(800)], "y": y, "p": p}))
    pairs = (p[y == 1][:, None] > p[y == 0][None, :]) + 0.5 * (p[y == 1][:, None] == p[y == 0][None, :])
    assert EV.roc_auc(df).first()[0] == pytest.approx(pairs.mean())
    ap, last = 0.0, 0.0
    f1 = {}
    for t in sorted(set(p), reverse=True):
        c = p >= t
        prec, rec = y[c].mean(), y[c].sum() / y.sum()
        ap, last = ap + prec * (rec - last), rec
        f1[t] = 2 * prec * rec / max(prec + rec, 1e-12)
    assert EV.avg_precision(df).first()[0] == pytest.approx(ap)
    assert EV.best_threshold(df).first()["f1"] == pytest.approx(max(f1.values()))
    m = EV.classification_report(df, 0.5).first()
    assert m.n == 800 and m.brier == pytest.approx(((p - y) ** 2).mean())
    assert EV.calibration(df, 5).agg(F.sum("n")).first()[0] == 800


@pytest.fixture(scope="module")
def mostly_one_group(spark):
    """One of many groups holds nine tenths of the rows; continuous and tied values, NULLs in both keys."""
    r = np.random.default_rng(3)
    n = 5000
    pdf = pd.DataFrame({"g": np.where(r.random(n) < 0.9, "big", [f"g{i % 60}" for i in range(n)]),
                        "h": r.integers(0, 2, n).astype(object), "x": r.normal(size=n),
                        "y": r.integers(-5, 6, n).astype(float)})
    pdf.loc[pdf.index % 11 == 0, "h"] = None
    pdf.loc[pdf.index % 37 == 0, "g"] = None
    rows = [tuple(None if v is None or v != v else v for v in row) for row in pdf.itertuples(index=False)]
    rows = [(g, h, None if i % 7 == 0 else x, None if g == "g5" else y) for i, (g, h, x, y) in enumerate(rows)]
    return spark.createDataFrame(rows, "g string, h int, x double, y double")


def test_grouped_quantiles_equal_percentile(mostly_one_group):
    d, keys = mostly_one_group, ["g", "h"]
    wanted = {"x_lo": ("x", 0.0), "x_10": ("x", 0.1), "x_50": ("x", 0.5), "y_50": ("y", 0.5),
              "y_90": ("y", 0.9), "y_hi": ("y", 1.0)}
    got = grouped_quantiles(d, keys, wanted, rows="n")
    assert got.columns == [*keys, *wanted, "n"]
    want = d.groupBy(*keys).agg(*[F.percentile(c, p).alias(n) for n, (c, p) in wanted.items()],
                                F.count("*").alias("n"))
    order = lambda r: (r["g"] or "", -1 if r["h"] is None else r["h"])
    a, b = sorted(got.collect(), key=order), sorted(want.collect(), key=order)
    assert [order(r) for r in a] == [order(r) for r in b]
    assert any(r["y_50"] is None for r in a) and any(r["g"] is None and r["h"] is None for r in a)
    for r, s in zip(a, b):
        assert r["n"] == s["n"]
        for n in wanted:
            assert (r[n] is None) == (s[n] is None)
            assert r[n] is None or r[n] == pytest.approx(s[n], abs=1e-12)


def test_grouped_quantiles_without_rows_or_values(spark):
    d = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0)], "g string, x double")
    wanted = {"m": ("x", 0.5)}
    assert grouped_quantiles(d.limit(0), ["g"], wanted).collect() == []
    assert sorted(grouped_quantiles(d, ["g"], wanted, rows="n").collect()) == [("a", None, 2), ("b", 1.0, 1)]
    assert grouped_quantiles(d.where("g = 'a'"), ["g"], wanted).collect() == [("a", None)]
    assert one_row_quantiles(d.where("g = 'a'"), "x", wanted := {"m": 0.5}).collect() == [(None,)]
    assert one_row_quantiles(d, "x", wanted).collect() == [(1.0,)]


def test_no_window_orders_a_whole_group(mostly_one_group):
    """The rows with values are ordered inside ranges; whole groups are windowed by their range totals alone."""
    plan = grouped_quantiles(mostly_one_group, ["g"], {"m": ("x", 0.5)})._jdf.queryExecution().toString()
    optimized = plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    orders = [line for line in optimized.splitlines() if "Window [" in line and "_v#" in line]
    assert orders and all("_r#" in line.split("], [")[1] for line in orders)

import hashlib

import numpy as np
import pandas as pd
import pytest
from pandas.tseries.holiday import USFederalHolidayCalendar
from pyspark.sql import functions as F

from opsreliability.operators import anomaly as AN
from opsreliability.operators import features as FE
from opsreliability.operators import series as SE
from opsreliability.operators.calendar import holiday_calendar


def test_holiday_calendar_matches_the_published_rules(spark):
    got = holiday_calendar(spark).toPandas()
    days = pd.to_datetime(got.flight_date)
    hol = USFederalHolidayCalendar().holidays("2024-01-01", "2027-12-31")
    want = np.abs((days.to_numpy()[:, None] - hol.to_numpy()[None, :]).astype("timedelta64[D]")
                  .astype(int)).min(1)
    assert len(got) == 1461
    assert (got.days_to_holiday.to_numpy() == np.minimum(want, 30)).all()
    d = got.set_index("flight_date")
    assert d.loc[pd.Timestamp("2026-07-03").date(), "is_holiday"] == 1
    assert d.loc[pd.Timestamp("2026-07-05").date(), "days_to_holiday"] == 2


def test_no_outcome_or_rotation_column_before_departure():
    assert not set(FE.PRE_DEPARTURE) & {*FE.OUTCOMES, *FE.ROTATION, "day_of_month"}
    assert len(FE.PRE_DEPARTURE) == 22 and len(FE.DAY_OF_OPERATIONS) == 25


def test_out_of_fold_encoding_against_brute_force(spark):
    r = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({"id": [f"i{i}" for i in range(n)], "k": [f"k{i % 7}" for i in range(n)],
                        "train": np.arange(n) < 300, "y": r.integers(0, 2, n).astype(float)})
    pdf.loc[::11, "y"] = np.nan
    pdf.loc[399, "k"] = "unseen"
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    got = FE.target_encode(df, df, "id", F.col("train"), {"k": "k"}, {"t": "y"}, id_col="id")
    got = {x.id: x.te_k_t for x in got.collect()}
    pdf["fold"] = [int(hashlib.md5(i.encode()).hexdigest()[:7], 16) % 5 for i in pdf["id"]]
    tr = pdf[pdf.train]
    prior = tr.y.mean()
    for x in pdf.itertuples():
        same = tr[(tr.k == x.k) & ((tr.fold != x.fold) | (not x.train))]
        want = (same.y.sum() + 50 * prior) / (same.y.count() + 50)
        assert got[x.id] == pytest.approx(want, rel=1e-6), x


def test_prepare_gives_fixed_categories_and_single_precision(spark):
    from opsreliability.operators.learn import prepare
    d = prepare(spark.createDataFrame([("AA", 1.0), ("ZZ", 2.0)], "carrier string, x double"),
                {"carrier": ["AA", "DL"]}, ["x"])
    assert dict(d.dtypes)["x"] == "float"
    assert [r.carrier_idx for r in d.orderBy("x").collect()] == [0.0, 2.0]


def daily_frame(spark, days=90):
    d = pd.date_range("2026-01-01", periods=days)
    rows = [{"series": s, "flight_date": x.date(), "scheduled_departures": 100 + 10 * x.dayofweek + i,
             "arr_delay_rate": 0.2 + 0.01 * x.dayofweek}
            for i, s in enumerate("ab") for x in d if not (s == "b" and x.day == 13)]
    return spark.createDataFrame(pd.DataFrame(rows))


def test_naive_forecast_is_exact_on_a_weekly_pattern(spark):
    x = SE.series_features(daily_frame(spark), "scheduled_departures",
                           holiday_calendar(spark, "2025-12-01", "2026-12-31"))
    bt = SE.backtest_windows(x, folds=2)
    assert bt.select("origin").distinct().count() == 2 and bt.count() >= 14
    m = {r.model: r for r in SE.forecast_metrics(bt).collect()}
    assert m["seasonal_naive"].mae == 0 and m["mean_4wk_same_weekday"].mae == 0
    gap = x.where("series = 'b' AND flight_date = '2026-02-13'").first()
    assert gap.y is None and gap.lag7 is not None
    later = x.where("series = 'b' AND flight_date = '2026-02-20'").first()
    assert later.lag7 is None and later.roll7_lag7 is None


def test_future_rows_follow_the_last_day(spark):
    f = SE.future_features(daily_frame(spark), "scheduled_departures",
                           holiday_calendar(spark, "2025-12-01", "2026-12-31"))
    assert f.count() == 14 and f.where("lag7 IS NULL").count() == 0


def test_decomposition_adds_up_and_finds_a_shock():
    t = np.arange(140)
    # some noise: robust weights are relative to the median residual, which must not be zero
    y = 2 + 0.01 * t + np.sin(2 * np.pi * t / 7) + np.random.default_rng(0).normal(0, 0.05, 140)
    y[70] += 5
    s, tr, r = AN.stl_arrays(y)
    assert np.allclose(s + tr + r, y)
    assert np.argmax(np.abs(r)) == 70 and r[70] > 4
    assert np.abs(np.delete(r, 70)).max() < 0.4


def test_robust_z_with_zero_spread_and_flags(spark):
    d = spark.createDataFrame([(1.0, 5.0)] * 5 + [(9.0, 5.0)], "a double, b double")
    z = AN.robust_z(AN.robust_z(d, "a"), "b")
    assert z.agg(F.max("a_z")).first()[0] == 8.0 and z.agg(F.max("b_z")).first()[0] == 0.0
    f = AN.flag_days(z, "b_z", "a_z").where("is_anomaly = 1").collect()
    assert [r.anomaly_driver for r in f] == ["cancellations"]


def test_isolation_forest_ranks_planted_outliers_first(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 2))
    x[:6] += 9
    df = spark.createDataFrame(pd.DataFrame({"row_key": [f"x{i}" for i in range(600)],
                                             "a": x[:, 0], "b": x[:, 1]}))
    s = AN.isolation_forest(df, ["a", "b"], trees=40, contamination=0.01)
    flagged = {q.row_key for q in s.where("is_anomaly = 1").collect()}
    assert flagged == {f"x{i}" for i in range(6)}

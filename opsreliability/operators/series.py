"""Daily series: features, naive forecasts, backtests and the learned correction.

A fact of any size is reduced to one row per series and day before anything here runs, so a
series is bounded by the length of the calendar and its windows stay small.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsreliability.functions.scalar import round_away
from opsreliability.operators.boost_windows import WindowModels, fit_windows
from opsreliability.operators.sampling import keep_top_groups
from opsreliability.operators.windows import rolling
from opsreliability.session import cut_lineage

LAGS = (7, 14, 21, 28)
HORIZON = 7
BASELINES = ("seasonal_naive", "mean_4wk_same_weekday")
MODEL_FEATURES = ["series_idx", "dow", "days_to_holiday", "lag7", "lag14", "lag21", "lag28",
                  "roll7_lag7", "roll28_lag7", "std28_lag7"]


def daily_series(legs: DataFrame, by: str, name: str = "series") -> DataFrame:
    return legs.groupBy(F.col(by).alias(name), "flight_date").agg(
        F.count("*").alias("scheduled_departures"),
        round_away(F.avg("arr_del15"), 5).alias("arr_delay_rate"))


def top_series(daily: DataFrame, n: int, key: str = "series",
               weight: str = "scheduled_departures") -> DataFrame:
    return keep_top_groups(daily, key, weight, n)


def densify(df: DataFrame, key: str = "series", day: str = "flight_date") -> DataFrame:
    """A row for every day between the first and last of each series; gaps are NULL."""
    span = df.groupBy(key).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    grid = span.select(key, F.explode(F.sequence("_a", "_b")).alias(day))
    return grid.join(df, [key, day], "left")


def lag_days(dense: DataFrame, value: str, k: int, name: str, key: str = "series",
             day: str = "flight_date") -> DataFrame:
    return dense.withColumn(name, F.lag(value, k).over(W.partitionBy(key).orderBy(day)))


def series_features(daily: DataFrame, target: str, calendar: DataFrame,
                    key: str = "series", day: str = "flight_date") -> DataFrame:
    """Lags and rolling statistics of ``target``, all at least a week old."""
    d = densify(daily.select(key, day, F.col(target).alias("y")), key, day)
    for k in LAGS:
        d = lag_days(d, "y", k, f"lag{k}", key, day)
    d = rolling(d, [key], day, "y", 7, 7, F.avg, "roll7_lag7")
    d = rolling(d, [key], day, "y", 28, 7, F.avg, "roll28_lag7")
    d = rolling(d, [key], day, "y", 28, 7, F.stddev_samp, "std28_lag7")
    names = daily.agg(F.sort_array(F.collect_set(key)).alias("n"))      # the chosen series only
    d = d.withColumn("_n", names.scalar())
    d = d.withColumn("series_idx", (F.array_position("_n", F.col(key)) - 1).cast("int")).drop("_n")
    d = d.withColumn("dow", F.weekday(day))
    return d.join(calendar.select(F.col("flight_date").alias(day), "days_to_holiday"), day, "left")


def seasonal_naive() -> Column:
    return F.col("lag7")


def weekday_mean(weeks: int = 4) -> Column:
    """Mean of the available values of the last ``weeks`` same weekdays."""
    lags = F.array_compact(F.array(*[F.col(f"lag{7 * (i + 1)}") for i in range(weeks)]))
    total = F.aggregate(lags, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(lags) > 0, total / F.size(lags))


def usable(features: DataFrame) -> DataFrame:
    return features.where("lag28 IS NOT NULL AND roll28_lag7 IS NOT NULL")


def backtest_windows(features: DataFrame, folds: int = 8, step: int = 7, horizon: int = HORIZON,
                     day: str = "flight_date") -> DataFrame:
    """Test rows of every rolling origin, with the naive forecasts.

    Origins are found by date arithmetic (a day belongs to horizon / step of them), so rows are
    not paired with all origins.
    """
    x = usable(features)
    d = x.withColumn("_last", x.agg(F.max(day).alias("d")).scalar())
    back = F.datediff(F.col("_last"), F.col(day))             # 0 on the last day
    first = F.greatest(F.ceil((back - horizon + 1) / step), F.lit(0)).cast("int")
    last = F.least(F.floor(back / step), F.lit(folds - 1)).cast("int")
    folds_of_day = F.when(first <= last, F.sequence(first, last))
    d = d.withColumn("_i", F.explode(folds_of_day))
    return (d.withColumn("origin", F.date_sub("_last", F.col("_i") * step + horizon))
            .where("y IS NOT NULL")
            .withColumn("seasonal_naive", seasonal_naive())
            .withColumn("mean_4wk_same_weekday", weekday_mean(4)).drop("_i", "_last"))


def forecast_metrics(bt: DataFrame, models: Sequence[str] = BASELINES) -> DataFrame:
    """MAE, RMSE and MAPE per model."""
    long = bt.select("y", *models).unpivot(["y"], list(models), "model", "forecast")
    err = F.col("forecast") - F.col("y")
    return long.groupBy("model").agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.abs(err) / F.greatest(F.abs("y"), F.lit(1e-9))) * 100).alias("mape_pct"))


# ------------------------------------------------------------------ learned correction

def _residual(features: DataFrame) -> DataFrame:
    return usable(features).where("y IS NOT NULL AND lag7 IS NOT NULL").withColumn(
        "_residual", F.col("y") - F.col("lag7"))


def fit_residual(features: DataFrame, ends: Sequence[date], **params) -> WindowModels:
    """Boosted trees for y - lag7, one model for all series and each end of the training window."""
    return fit_windows(_residual(features), MODEL_FEATURES, "_residual", "flight_date", ends, **params)


def predict_residual(model: WindowModels, features: DataFrame, name: str, end: str = "origin") -> DataFrame:
    d = model.predict(features.where("lag7 IS NOT NULL"), end, "_r")
    return d.withColumn(name, F.col("lag7") + F.col("_r")).drop("_r")


def origins_of(test: DataFrame) -> list[date]:
    """The rolling origins, oldest first: as many as folds."""
    return sorted(r[0] for r in test.select("origin").distinct().collect())


def backtest_learned(features: DataFrame, folds: int = 8, step: int = 7, horizon: int = HORIZON,
                     name: str = "learned", **params) -> DataFrame:
    """Test rows of every origin with the forecast of the model trained up to it; all origins are fitted together."""
    x = cut_lineage(features)
    test = backtest_windows(x, folds, step, horizon)
    origins = origins_of(test)
    if not origins:
        return test.withColumn(name, F.lit(None).cast("double"))
    return predict_residual(fit_residual(x, origins, **params), test, name)


def future_features(daily: DataFrame, target: str, calendar: DataFrame, horizon: int = HORIZON,
                    key: str = "series", day: str = "flight_date") -> DataFrame:
    """Feature rows of the next ``horizon`` days of every series."""
    last = daily.agg(F.max(day).alias("d"))
    ahead = daily.select(key).distinct().withColumn("_last", last.scalar())
    ahead = ahead.select(key, F.explode(F.sequence(F.date_add("_last", 1),
                                                   F.date_add("_last", horizon))).alias(day))
    full = daily.select(key, day, target).unionByName(
        ahead.withColumn(target, F.lit(None).cast("double")))
    f = series_features(full, target, calendar, key, day)
    return f.withColumn("_last", last.scalar()).where(F.col(day) > F.col("_last")).drop("_last")


def forecast_future(model: WindowModels, daily: DataFrame, target: str,
                    calendar: DataFrame) -> DataFrame:
    """Forecast of the model whose window ends last."""
    f = future_features(daily, target, calendar).withColumn("_end", F.lit(model.ends[-1]))
    return predict_residual(model, f, "forecast", "_end").select("flight_date", "series", "forecast")


def tail_days(df: DataFrame, n: int, day: str = "flight_date") -> DataFrame:
    """Rows of the last n days."""
    last = df.agg(F.max(day).alias("d"))
    return (df.withColumn("_last", last.scalar())
            .where(F.col(day) > F.date_sub("_last", n)).drop("_last"))

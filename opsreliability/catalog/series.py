"""Daily series, backtests and disruption days."""

from pyspark.sql import functions as F

from opsreliability.catalog.base import query, rnd, view
from opsreliability.catalog.relational import calendar
from opsreliability.functions import scalar as S
from opsreliability.operators import anomaly as AN
from opsreliability.operators import marts as M
from opsreliability.operators import series as SE
from opsreliability.operators import windows as WN
from opsreliability.operators.sampling import keep_top_groups
from opsreliability.session import cut_lineage, materialise

view("daily", f"""SELECT origin_state AS series, flight_date, count(1) AS scheduled_departures,
    {rnd('avg(arr_del15)', 5)} AS arr_delay_rate FROM legs GROUP BY origin_state, flight_date""")
view("top10", """SELECT series FROM daily GROUP BY series
  ORDER BY sum(scheduled_departures) DESC, series LIMIT 10""")
view("grid", """SELECT g.series, g.flight_date, d.scheduled_departures, d.arr_delay_rate FROM (
    SELECT series, CAST(unnest(generate_series(min(flight_date), max(flight_date), INTERVAL 1 DAY))
      AS DATE) AS flight_date FROM daily WHERE series IN (SELECT series FROM top10) GROUP BY series) g
  LEFT JOIN daily d USING (series, flight_date)""")


def x_view(name: str, target: str, grid: str = "grid") -> None:
    def roll(f: str, n: int) -> str:
        w = f"(PARTITION BY series ORDER BY flight_date ROWS BETWEEN {n + 6} PRECEDING AND 7 PRECEDING)"
        return f"CASE WHEN count(y) OVER {w} = {n} THEN {f}(y) OVER {w} END"

    lags = ", ".join(f"lag(y, {k}) OVER (PARTITION BY series ORDER BY flight_date) AS lag{k}"
                     for k in SE.LAGS)
    view(name, f"""SELECT s.*, isodow(flight_date) - 1 AS dow, c.days_to_holiday,
      dense_rank() OVER (ORDER BY series) - 1 AS series_idx FROM (
      SELECT series, flight_date, y, {lags}, {roll('avg', 7)} AS roll7_lag7,
      {roll('avg', 28)} AS roll28_lag7, {roll('stddev_samp', 28)} AS std28_lag7
      FROM (SELECT series, flight_date, CAST({target} AS DOUBLE) AS y FROM {grid})) s
      LEFT JOIN cal c USING (flight_date)""")


x_view("x_volume", "scheduled_departures")
x_view("x_rate", "arr_delay_rate")
MEAN4 = ("(ifnull(lag7, 0) + ifnull(lag14, 0) + ifnull(lag21, 0) + ifnull(lag28, 0)) / "
         "nullif((lag7 IS NOT NULL)::INT + (lag14 IS NOT NULL)::INT + (lag21 IS NOT NULL)::INT "
         "+ (lag28 IS NOT NULL)::INT, 0)")
for _n in ("volume", "rate"):
    view(f"bt_{_n}", f"""SELECT last - CAST(7 * (i + 1) AS INT) AS origin, flight_date, series, y,
      lag7 AS seasonal_naive, {MEAN4} AS mean_4wk_same_weekday
    FROM (SELECT *, max(flight_date) OVER () AS last FROM x_{_n}
          WHERE lag28 IS NOT NULL AND roll28_lag7 IS NOT NULL), range(8) o(i)
    WHERE flight_date > last - CAST(7 * (i + 1) AS INT) AND flight_date <= last - CAST(7 * i AS INT)
      AND y IS NOT NULL""")

TARGETS = {"volume": "scheduled_departures", "rate": "arr_delay_rate"}


def daily(t):
    return SE.top_series(materialise(SE.daily_series(t.once, "origin_state"), "daily"), 10)


def x(t, n):
    return SE.series_features(daily(t), TARGETS[n], calendar(t))


_FITTED: dict[tuple[str, str, str], tuple] = {}


def fitted(t, n):
    """Features, and the models of the eight origins and of the last day, fitted once per session and folder."""
    key = (t.spark.sparkContext.applicationId, t.folder, n)
    if key not in _FITTED:
        f = cut_lineage(x(t, n))
        last = f.where("y IS NOT NULL").agg(F.max("flight_date")).first()[0]
        ends = [*SE.origins_of(SE.backtest_windows(f)), last]
        _FITTED[key] = f, SE.fit_residual(f, ends, patience=5, step=0.3, depth=3, bins=32)
    return _FITTED[key]


@query("wn6_shift_by_days", "series:s flight_date:s n:l n_7:d n_28:d",
       """SELECT a.series, a.flight_date, a.scheduled_departures AS n, b.scheduled_departures AS n_7,
       c.scheduled_departures AS n_28 FROM daily a
       LEFT JOIN daily b ON b.series = a.series AND b.flight_date = a.flight_date - 7
       LEFT JOIN daily c ON c.series = a.series AND c.flight_date = a.flight_date - 28""")
def _(t):
    d = SE.daily_series(t.staged, "origin_state").withColumnRenamed("scheduled_departures", "n")
    d7 = WN.shift(d, ["series"], "flight_date", "n", 7, "n_7")
    past = d.select("series", F.date_add("flight_date", 28).alias("flight_date"),
                    F.col("n").alias("n_28"))
    return d7.join(past, ["series", "flight_date"], "left")


@query("wn7_rolling_full_window", "series:s flight_date:s roll7:r6 std28:r6",
       """SELECT series, flight_date, roll7_lag7 AS roll7, std28_lag7 AS std28 FROM x_volume""")
def _(t):
    d = SE.densify(daily(t))
    d = WN.rolling(d, ["series"], "flight_date", "scheduled_departures", 7, 7, F.avg, "roll7")
    return WN.rolling(d, ["series"], "flight_date", "scheduled_departures", 28, 7, F.stddev_samp,
                      "std28")


@query("se1_top_series", "series:s flight_date:s scheduled_departures:l arr_delay_rate:r5",
       "SELECT * FROM daily WHERE series IN (SELECT series FROM top10)")
def _(t):
    return daily(t)


@query("se2_densify", "series:s flight_date:s scheduled_departures:d arr_delay_rate:r5",
       "SELECT * FROM grid")
def _(t):
    return SE.densify(daily(t))


X_SPEC = ("series:s flight_date:s y:r5 lag7:r5 lag14:r5 lag21:r5 lag28:r5 roll7_lag7:r7 "
          "roll28_lag7:r7 std28_lag7:r6 dow:i days_to_holiday:i series_idx:i")

for _n in TARGETS:
    @query(f"se3_series_features_{_n}", X_SPEC, f"SELECT * FROM x_{_n}")
    def _(t, n=_n):
        return x(t, n)

    @query(f"se6_backtest_baselines_{_n}",
           "origin:s flight_date:s series:s y:r5 seasonal_naive:r5 mean_4wk_same_weekday:r6",
           f"SELECT * FROM bt_{_n}")
    def _(t, n=_n):
        return SE.backtest_windows(x(t, n))

    @query(f"se8_forecast_metrics_{_n}", "model:s mae:r6 rmse:r6 mape_pct:r4",
           " UNION ALL ".join(f"""SELECT '{m}' AS model, avg(abs({m} - y)) AS mae,
           sqrt(avg(({m} - y) * ({m} - y))) AS rmse,
           100 * avg(abs({m} - y) / CASE WHEN abs(y) < 1e-9 THEN 1e-9 ELSE abs(y) END) AS mape_pct
           FROM bt_{_n}""" for m in SE.BASELINES))
    def _(t, n=_n):
        return SE.forecast_metrics(SE.backtest_windows(x(t, n)))

    @query(f"se7_learned_backtest_{_n}", "model:s mae:r6 rmse:r6 mape_pct:r4")
    def _(t, n=_n):
        f, m = fitted(t, n)
        bt = SE.predict_residual(m, SE.backtest_windows(f), "learned")
        return SE.forecast_metrics(bt, ("learned", *SE.BASELINES))

    @query(f"se7_training_windows_{_n}",
           "origin:s n_train:l n_held:l n_test:l first_loss:r6 trees_after_best:i best_is_lowest:b "
           "never_above_first:b",
           f"""SELECT origin, sum(tr) AS n_train, sum(he) AS n_held, sum(te) AS n_test,
           avg(CASE he WHEN 1 THEN (y - lag7) * (y - lag7) END) AS first_loss,
           5 AS trees_after_best, true AS best_is_lowest, true AS never_above_first
           FROM (SELECT origin, y, lag7, (flight_date <= seen - 28)::INT AS tr,
             (flight_date > seen - 28 AND flight_date <= origin)::INT AS he,
             (flight_date > origin AND flight_date <= origin + 7)::INT AS te
             FROM (SELECT *, max(CASE WHEN flight_date <= origin THEN flight_date END)
                     OVER (PARTITION BY origin) AS seen
                   FROM x_{_n}, (SELECT DISTINCT origin FROM bt_{_n})
                   WHERE lag28 IS NOT NULL AND roll28_lag7 IS NOT NULL AND lag7 IS NOT NULL AND y IS NOT NULL)
             WHERE lag28 IS NOT NULL AND roll28_lag7 IS NOT NULL AND lag7 IS NOT NULL AND y IS NOT NULL)
           GROUP BY origin""")
    def _(t, n=_n):
        """Rows that each origin trains on, holds out and forecasts, and how its growing ended."""
        f, m = fitted(t, n)
        rows = [(o, e, h[0], len(h) - 1 - len(k), bool(h[len(k)] == min(h)), bool(h[len(k)] <= h[0]))
                for o, e, h, k in zip(m.ends[:-1], m.train_ends, m.history, m.trees)]
        ends = t.spark.createDataFrame(rows, "origin date, train_end date, first_loss double, "
                                             "trees_after_best int, best_is_lowest boolean, never_above_first boolean")
        used = SE.usable(f).where("y IS NOT NULL AND lag7 IS NOT NULL").select("flight_date").withColumn(
            "origin", F.explode(F.array(*[F.lit(o) for o in m.ends[:-1]]))).join(F.broadcast(ends), "origin")
        day, count = F.col("flight_date"), lambda p: F.sum(p.cast("long"))
        return used.groupBy(*ends.columns).agg(
            count(day <= F.col("train_end")).alias("n_train"),
            count((day > F.col("train_end")) & (day <= F.col("origin"))).alias("n_held"),
            count((day > F.col("origin")) & (day <= F.date_add("origin", 7))).alias("n_test"))


@query("se4_seasonal_naive", "series:s flight_date:s forecast:d",
       "SELECT series, flight_date, lag7 AS forecast FROM x_volume")
def _(t):
    return x(t, "volume").withColumn("forecast", SE.seasonal_naive())


@query("se5_weekday_mean", "series:s flight_date:s forecast:r6",
       f"SELECT series, flight_date, {MEAN4} AS forecast FROM x_rate")
def _(t):
    return x(t, "rate").withColumn("forecast", SE.weekday_mean(4))


view("next7", """SELECT t.series, m.last + CAST(k AS INT) AS flight_date,
    d.scheduled_departures AS forecast
  FROM top10 t, (SELECT max(flight_date) AS last FROM daily) m, range(1, 8) r(k)
  LEFT JOIN daily d ON d.series = t.series AND d.flight_date = m.last + CAST(k AS INT) - 7""")


@query("se9_future_naive", "series:s flight_date:s forecast:d",
       """SELECT series, flight_date, forecast FROM next7""")
def _(t):
    f = SE.future_features(daily(t), "scheduled_departures", calendar(t))
    return f.withColumn("forecast", SE.seasonal_naive())


@query("se9_future_learned", "series:s flight_date:s forecast:r6")
def _(t):
    d = daily(t)
    return SE.forecast_future(fitted(t, "volume")[1], d, "scheduled_departures", calendar(t))


@query("se10_tail_days", "series:s flight_date:s scheduled_departures:l",
       """SELECT series, flight_date, scheduled_departures FROM daily
       WHERE flight_date > (SELECT max(flight_date) FROM daily) - 40""")
def _(t):
    return SE.tail_days(SE.daily_series(t.staged, "origin_state"), 40)


# ---------------------------------------------------------------- disruption days

view("net", f"""SELECT flight_date, count(1) AS n, {rnd('avg(arr_del15)', 5)} AS arr_delay_rate,
    {rnd('avg(cancelled)', 5)} AS cancellation_rate FROM legs GROUP BY flight_date""")


def _logit(c):
    p = f"greatest(0.0001, least(0.9999, {c}))"
    return f"CASE WHEN {c} IS NOT NULL THEN ln({p} / (1 - {p})) END"


view("net_logit", f"""SELECT *, {_logit('arr_delay_rate')} AS arr_delay_rate_logit,
    {_logit('cancellation_rate')} AS cancellation_rate_logit FROM net""")


def _z(c):
    return (f"({c} - m_{c}) / CASE WHEN mad_{c} > 0 THEN mad_{c} ELSE 1 END")


_cols = ("arr_delay_rate_logit", "cancellation_rate_logit")
view("net_med", "SELECT *, " + ", ".join(f"(SELECT median({c}) FROM net_logit) AS m_{c}"
                                         for c in _cols) + " FROM net_logit")
view("net_z", "SELECT flight_date, arr_delay_rate, cancellation_rate, " + ", ".join(
    f"{_z(c)} AS z{i}" for i, c in enumerate(_cols)) + " FROM (SELECT *, " + ", ".join(
    f"(SELECT 1.4826 * median(abs({c} - m_{c})) FROM net_med) AS mad_{c}" for c in _cols)
    + " FROM net_med)")
view("net_flags", """SELECT *, CASE WHEN z0 > 1.5 OR z1 > 1.5 THEN 1 ELSE 0 END AS is_anomaly,
    CASE WHEN z0 > 1.5 AND z1 > 1.5 THEN 'delays + cancellations' WHEN z0 > 1.5 THEN 'delays'
    WHEN z1 > 1.5 THEN 'cancellations' ELSE '' END AS anomaly_driver FROM net_z""")


def net_z(t):
    d = AN.logit_rate(M.daily_network(t.staged), ["arr_delay_rate", "cancellation_rate"])
    for i, c in enumerate(_cols):
        d = AN.robust_z(d, c, name=f"z{i}")
    return d


def net_flags(t):
    """Days flagged by the z-score of the logit itself, with a limit that flags some."""
    return AN.flag_days(net_z(t), "z0", "z1", 1.5)


@query("an1_logit_rates", "flight_date:s arr_delay_rate_logit:r6 cancellation_rate_logit:r6",
       "SELECT * FROM net_logit")
def _(t):
    return AN.logit_rate(M.daily_network(t.legs), ["arr_delay_rate", "cancellation_rate"])


@query("an2_network_disruption_days",
       "flight_date:s arr_delay_rate:r5 cancellation_rate:r5 arr_delay_rate_z:r4 "
       "cancellation_rate_z:r4 is_anomaly:i anomaly_driver:s")
def _(t):
    return AN.network_anomalies(M.daily_network(t.staged))


@query("an2_stl_by_series", "series:s flight_date:s arr_delay_rate_trend:r4 arr_delay_rate_resid:r4")
def _(t):
    d = SE.densify(SE.daily_series(t.staged, "origin_state"))
    return AN.stl(d, "series", "flight_date", ["arr_delay_rate"])


@query("an2_stl_parts", "series:s days:l parts_off:l",
       "SELECT series, count(1) AS days, 0 AS parts_off FROM grid GROUP BY series")
def _(t):
    """Parts of the volume of each series, decomposed in ranges of days: they add up, and none is missing."""
    d = AN.stl_ranges(SE.densify(daily(t)), "series", "flight_date", "scheduled_departures", cycles=60)
    whole = F.abs(F.col("seasonal") + F.col("trend") + F.col("resid") - F.col("value")) < 1e-6
    return d.groupBy("series").agg(F.count("*").alias("days"), F.count(
        F.when(~F.coalesce(whole, F.lit(False)), 1)).alias("parts_off"))


@query("an3_robust_z", "flight_date:s z0:r6 z1:r6", "SELECT * FROM net_z")
def _(t):
    return net_z(t)


@query("an3_robust_z_by_series", "series:s flight_date:s z:r6",
       """WITH m AS (SELECT series, median(scheduled_departures) AS md FROM daily GROUP BY 1),
       a AS (SELECT series, 1.4826 * median(abs(scheduled_departures - md)) AS mad FROM daily JOIN m
             USING (series) GROUP BY 1)
       SELECT series, flight_date, (scheduled_departures - md) / CASE mad WHEN 0 THEN 1 ELSE mad END
       AS z FROM daily JOIN m USING (series) JOIN a USING (series)""")
def _(t):
    return AN.robust_z(SE.daily_series(t.staged, "origin_state"), "scheduled_departures",
                       ["series"], "z")


@query("an4_flag_days", "flight_date:s is_anomaly:i anomaly_driver:s", "SELECT * FROM net_flags")
def _(t):
    return net_flags(t)


view("site_day", f"""SELECT flight_date, origin AS airport_code, count(1) AS scheduled_departures,
    {rnd('avg(arr_del15)', 5)} AS arr_delay_rate, {rnd('avg(cancelled)', 5)} AS cancellation_rate,
    {rnd('avg(CASE cancelled WHEN 0 THEN dep_delay_min END)', 3)} AS avg_dep_delay_min,
    {rnd('avg(taxi_out_min)', 3)} AS avg_taxi_out_min,
    {rnd('''sum(weather_delay_min) / nullif(sum(carrier_delay_min + weather_delay_min +
    nas_delay_min + security_delay_min + late_aircraft_delay_min), 0)''', 5)} AS weather_share
  FROM legs GROUP BY flight_date, origin""")
view("busy30", """SELECT airport_code FROM site_day GROUP BY 1
  ORDER BY sum(scheduled_departures) DESC, 1 LIMIT 30""")
_own = lambda c: f"{c} - median({c}) OVER (PARTITION BY airport_code)"
view("site_rel", "SELECT airport_code, flight_date, scheduled_departures, " + ", ".join(
    f"ifnull({_own(c)}, 0) AS {c}" for c in ("arr_delay_rate", "cancellation_rate",
                                             "avg_dep_delay_min", "avg_taxi_out_min"))
    + """, scheduled_departures / median(scheduled_departures) OVER (PARTITION BY airport_code)
    AS volume_ratio, ifnull(weather_share, 0) AS weather_share
  FROM site_day WHERE airport_code IN (SELECT airport_code FROM busy30)""")


def site_days(t):
    d = keep_top_groups(M.daily_airport(t.staged), "airport_code", "scheduled_departures", 30)
    return d.withColumn("row_key", S.key("airport_code", "flight_date"))


REL = ("airport_code:s flight_date:s arr_delay_rate:r5 cancellation_rate:r5 avg_dep_delay_min:r3 "
       "avg_taxi_out_min:r3 volume_ratio:r6 weather_share:r5")


@query("an5_relative_features", REL, "SELECT * FROM site_rel")
def _(t):
    return AN.relative_features(site_days(t))


@query("an6_isolation_forest", REL + " anomaly_score:r6 is_anomaly:i")
def _(t):
    return AN.isolation_forest(AN.relative_features(site_days(t)))


@query("an6_flag_share", "site_days:l share_off:b scores_off:l flagged_below_others:b",
       "SELECT count(1) AS site_days, false AS share_off, 0 AS scores_off, false AS flagged_below_others FROM site_rel")
def _(t):
    """Two in a hundred site days are flagged, those with the highest scores."""
    d = AN.isolation_forest(AN.relative_features(site_days(t)))
    s, flag = F.col("anomaly_score"), F.col("is_anomaly") == 1
    return d.agg(F.count("*").alias("site_days"),
                 (F.abs(F.avg("is_anomaly") - 0.02) > 0.002).alias("share_off"),
                 F.count(F.when(~F.coalesce((s > 0) & (s < 1), F.lit(False)), 1)).alias("scores_off"),
                 (F.min(F.when(flag, s)) <= F.max(F.when(~flag, s))).alias("flagged_below_others"))


@query("an7_flag_contrast",
       "flagged:l all_rows:l flagged_arr_delay_rate:r6 normal_arr_delay_rate:r6 "
       "flagged_cancellation_rate:r6 normal_cancellation_rate:r6",
       """SELECT sum(f) AS flagged, count(1) AS all_rows,
       avg(arr_delay_rate) FILTER (f = 1) AS flagged_arr_delay_rate,
       avg(arr_delay_rate) FILTER (f = 0) AS normal_arr_delay_rate,
       avg(cancellation_rate) FILTER (f = 1) AS flagged_cancellation_rate,
       avg(cancellation_rate) FILTER (f = 0) AS normal_cancellation_rate
       FROM (SELECT *, CASE WHEN volume_ratio > 1.8 THEN 1 ELSE 0 END AS f FROM site_rel)""")
def _(t):
    d = AN.relative_features(site_days(t)).withColumn(
        "f", (F.col("volume_ratio") > 1.8).cast("int"))
    return AN.flag_contrast(d, "f", ["arr_delay_rate", "cancellation_rate"])

"""Star dimensions, report visuals and app views."""

from pyspark.sql import functions as F

from opsreliability.catalog.base import TRAIN_END, VALID_END, query, rnd, view
from opsreliability.catalog.marts import C5, DONE, OTP, ROUTE_SPEC, ROUTE_SQL
from opsreliability.catalog.measures import (BT, BT_SPEC, BT_SQL, SQL, backtests, score_star,
                                             segments_airports, segments_routes, select_sql, spec,
                                             star)
from opsreliability.catalog.relational import calendar
from opsreliability.catalog.scoring import scores
from opsreliability.catalog.series import daily, net_flags, site_days
from opsreliability.operators import anomaly as AN
from opsreliability.operators import dims as D
from opsreliability.operators import marts as M
from opsreliability.operators import measures as ME
from opsreliability.operators import report as RP
from opsreliability.operators import scoring as SC
from opsreliability.operators import series as SE


@query("sg5_date_dim",
       "date_key:i date:s year:i month:i month_label:s year_month:s quarter:i iso_dow:i dow_name:s "
       "is_weekend:b is_federal_holiday:b days_to_holiday:i model_split:s",
       f"""SELECT year(d) * 10000 + month(d) * 100 + day(d) AS date_key, d AS date, year(d) AS year,
       month(d) AS month, strftime(d, '%b %Y') AS month_label, left(d::VARCHAR, 7) AS year_month,
       quarter(d) AS quarter, isodow(d) AS iso_dow, strftime(d, '%a') AS dow_name,
       isodow(d) IN (6, 7) AS is_weekend, is_holiday > 0 AS is_federal_holiday, days_to_holiday,
       CASE WHEN d > DATE '{VALID_END}' THEN 'test' WHEN d > DATE '{TRAIN_END}' THEN 'valid'
       ELSE 'train' END AS model_split FROM (SELECT flight_date AS d, * FROM cal WHERE flight_date
       BETWEEN (SELECT min(flight_date) FROM legs) AND (SELECT max(flight_date) FROM legs))""")
def _(t):
    return D.date_dim(calendar(t), t.staged, TRAIN_END, VALID_END)


@query("sg6_route_dim",
       "route:s origin:s dest:s distance_mi:d scheduled_flights:l route_segment:s",
       """SELECT route, min(origin) AS origin, min(dest) AS dest, median(distance_mi) AS distance_mi,
       count(1) AS scheduled_flights, min(segment) AS route_segment FROM legs
       LEFT JOIN seg_routes USING (route) GROUP BY route""")
def _(t):
    return D.route_dim(t.staged, segments_routes(t))


@query("sg7_airport_dim_with_segment",
       "airport_code:s airport_name:s city:s state:s airport_type:s ops_segment:s",
       "SELECT *, segment AS ops_segment FROM airports LEFT JOIN seg_airports USING (airport_code)")
def _(t):
    return D.airport_dim_with_segment(t.airports, segments_airports(t))


EXTRA = {"carrier_otp_rank": ("carrier_otp_rank", "l"),
         "route_otp_vs_network_pp": ("100 * (1 - sum(arr_del15) / nullif(sum(completed), 0) - "
                                     "(SELECT 1 - sum(arr_del15) / sum(completed) FROM star))", "r4")}
SQL.update(EXTRA)

for _rq, (_by, _names) in RP.VISUALS.items():
    _sql = select_sql([n for n in _names if n != "carrier_otp_rank"], _by, "star")
    if "carrier_otp_rank" in _names:
        _sql = ("SELECT *, rank() OVER (ORDER BY on_time_pct DESC NULLS LAST) AS carrier_otp_rank "
                f"FROM ({_sql})")

    @query(f"{_rq}_by_{'_and_'.join(_by)}", spec(_names, _by), _sql)
    def _(t, rq=_rq, by=_by):
        return RP.visual(rq, star(t, "carrier_name" in by, "airport_code" in by))


@query("rq3_minutes_per_cause", "measure:s value:r4",
       " UNION ALL ".join(f"SELECT '{c}_delay_total_min' AS measure, sum({c}_delay_min) AS value "
                          f"FROM star" for c in C5))
def _(t):
    return RP.long_measures(star(t, False, False), RP.CAUSE_TOTALS)


@query("rq18_risk_bands", "risk_band:s mean_predicted:r6 observed_rate:r6",
       "SELECT risk_band, mean_predicted, observed_rate FROM bands")
def _(t):
    return RP.mean_by(SC.risk_bands(scores(t)), ["risk_band"], ["mean_predicted", "observed_rate"])


@query("rq19_score_by_hour", "dep_hour:i mean_delay_prob:r6 observed_delay_rate:r6",
       "SELECT dep_hour, mean_delay_prob, observed_delay_rate FROM hour_scores")
def _(t):
    return RP.mean_by(SC.score_hour(scores(t)), ["dep_hour"],
                      ["mean_delay_prob", "observed_delay_rate"])


@query("rq20_route_risk",
       "route:s completed_flights:l mean_delay_prob:r6 observed_delay_rate:r6 mean_p90_min:r4",
       "SELECT * FROM route_scores")
def _(t):
    return RP.mean_by(SC.route_risk(scores(t), 10), ["route"],
                      ["mean_delay_prob", "observed_delay_rate", "mean_p90_min"],
                      ["completed_flights"])


RQ21 = ["avg_predicted_delay_risk", "observed_delay_rate"]


@query("rq21_predicted_vs_observed_by_carrier", spec(RQ21, ["carrier_name"]),
       select_sql(RQ21, ["carrier_name"], "score_star"))
def _(t):
    return ME.measures(score_star(t), RQ21, ["carrier_name"])


@query("rq22_anomaly_rates_by_day", "flight_date:s arr_delay_rate:r5 cancellation_rate:r5",
       "SELECT flight_date, arr_delay_rate, cancellation_rate FROM net_flags")
def _(t):
    return RP.mean_by(net_flags(t), ["flight_date"], ["arr_delay_rate", "cancellation_rate"])


@query("rq23_flagged_days", "flight_date:s anomaly_driver:s arr_delay_rate:r5 cancellation_rate:r5",
       "SELECT * FROM net_flags WHERE is_anomaly = 1")
def _(t):
    return RP.flagged_days(net_flags(t)).select("flight_date", "anomaly_driver", "arr_delay_rate",
                                                "cancellation_rate")


def next7(t):
    f = SE.future_features(daily(t), "scheduled_departures", calendar(t))
    return f.select("series", "flight_date", SE.seasonal_naive().alias("forecast"),
                    F.lit("scheduled_departures").alias("target"))


@query("rq24_forecast_by_day", "flight_date:s forecast:r5",
       "SELECT flight_date, avg(forecast) AS forecast FROM next7 GROUP BY 1")
def _(t):
    return RP.mean_by(next7(t), ["flight_date"], ["forecast"])


@query("rq25_backtest_mae_by_target", BT_SPEC, BT_SQL)
def _(t):
    return ME.measures(backtests(t), BT, ["target"])


_cards = [*RP.LEG_CARDS]


@query("rq26_leg_cards", spec(_cards), select_sql(_cards, [], "star"))
def _(t):
    return ME.measures(star(t, False, False), RP.LEG_CARDS)


@query("rq26_score_cards", spec(RP.SCORE_CARDS), select_sql(RP.SCORE_CARDS, [], "score_star"))
def _(t):
    return ME.measures(score_star(t), RP.SCORE_CARDS)


RQ27 = ["flights", "on_time_pct", "cancellation_rate_pct"]


@query("rq27_slicers", spec(RQ27, ["month_label"]),
       select_sql(RQ27, ["month_label"], "star",
                  "state IN ('R1', 'R3') AND ops_segment <> 'Major hub' AND airport_code <> 'N05' AND "
                  "carrier_name LIKE 'F%' AND month_label IN ('Jan 1997', 'Feb 1997', 'Mar 1998')"))
def _(t):
    a = D.airport_dim_with_segment(t.airports, segments_airports(t))
    f = ME.slice_by(t.staged, a, "origin", "airport_code", F.expr(
        "state IN ('R1', 'R3') AND ops_segment <> 'Major hub' AND airport_code <> 'N05'"))
    f = ME.slice_by(f, t.carriers, "carrier", "carrier_code", F.expr("carrier_name LIKE 'F%'"))
    return ME.measures(ME.star_frame(f), RQ27, ["month_label"], having=F.col("month_label").isin(
        "Jan 1997", "Feb 1997", "Mar 1998"))


# ---------------------------------------------------------------- app views

@query("rq28_carrier_ranking", "carrier:s carrier_name:s on_time_pct:r5 scheduled_flights:l",
       f"""SELECT carrier, carrier_name, sum(o * done) / sum(done) AS on_time_pct,
       sum(n) AS scheduled_flights FROM (SELECT year_month, carrier, carrier_name, count(1) AS n,
       sum(completed) AS done, {rnd(f'({OTP})', 2)} AS o FROM star GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(t):
    return RP.carrier_ranking(M.kpi_carrier_month(t.staged, t.carriers))


@query("rq28_cause_totals", "cause:s minutes:r4",
       " UNION ALL ".join(f"SELECT '{c}_min' AS cause, sum({c}_delay_min) AS minutes FROM legs"
                          for c in C5))
def _(t):
    return RP.cause_totals(M.delay_causes_month(t.legs))


@query("rq28_hour_profile", "dep_hour:i arr_delay_rate_pct:r5 scheduled_flights:l",
       f"""SELECT dep_hour, sum(r * n) / sum(n) AS arr_delay_rate_pct, sum(n) AS scheduled_flights
       FROM (SELECT dep_hour, day_of_week, count(1) AS n, {rnd('(100 * avg(arr_del15))', 2)} AS r
       FROM legs GROUP BY 1, 2) GROUP BY 1 HAVING sum(n) > 2450""")
def _(t):
    return RP.hour_profile(M.kpi_hour_dow(t.legs), 2450)


@query("rq28_worst_routes", ROUTE_SPEC,
       f"SELECT * FROM ({ROUTE_SQL}) ORDER BY {rnd('on_time_pct', 2)}, route LIMIT 12")
def _(t):
    return RP.worst_routes(M.kpi_route(t.legs, 80))


@query("rq29_forecast_view", "flight_date:s kind:s value:r4",
       """SELECT flight_date, 'actual' AS kind, scheduled_departures::DOUBLE AS value FROM daily
       WHERE series = 'R2' AND flight_date > (SELECT max(flight_date) FROM daily WHERE series = 'R2') - 90
       UNION ALL SELECT flight_date, 'learned', learned FROM bt_all
       WHERE series = 'R2' AND target = 'scheduled_departures'
       UNION ALL SELECT flight_date, 'seasonal_naive', seasonal_naive FROM bt_all
       WHERE series = 'R2' AND target = 'scheduled_departures'
       UNION ALL SELECT flight_date, 'next days', forecast FROM next7 WHERE series = 'R2'""")
def _(t):
    return RP.forecast_view(SE.daily_series(t.staged, "origin_state"), backtests(t), next7(t), "R2",
                            "scheduled_departures")


@query("rq30_segment_box", "segment:s items:l low:r6 q1:r6 median:r6 q3:r6 high:r6",
       """SELECT segment, count(1) AS items, min(o) AS low, quantile_cont(o, 0.25) AS q1,
       quantile_cont(o, 0.5) AS median, quantile_cont(o, 0.75) AS q3, max(o) AS high FROM
       (SELECT route, 1 - avg(arr_del15) AS o FROM legs GROUP BY 1) JOIN seg_routes USING (route)
       GROUP BY segment""")
def _(t):
    r = t.staged.groupBy("route").agg((1 - F.avg("arr_del15")).alias("otp"))
    return RP.segment_box(r.join(segments_routes(t), "route"), "otp")


@query("rq30_segment_scatter", "airport_code:s segment:s pc1:r4 pc2:r4 scheduled_departures:l")
def _(t):
    from opsreliability.catalog.learning import site_segments
    return site_segments(t)[0]


@query("rq31_flagged_days", "flight_date:s anomaly_driver:s cancellation_rate:r5",
       "SELECT flight_date, anomaly_driver, cancellation_rate FROM net_flags WHERE is_anomaly = 1")
def _(t):
    return RP.flagged_days(net_flags(t))


MONTHS = [f"1998-{m:02d}" for m in range(1, 13)]


@query("rq31_flagged_site_days_by_month",
       "airport_code:s total:l " + " ".join(f"m{m[-2:]}:l" for m in MONTHS),
       "SELECT airport_code, sum(hit) AS total, " + ", ".join(
           f"sum(hit) FILTER (m = '{m}') AS m{m[-2:]}" for m in MONTHS).replace(
           "sum(hit) FILTER", "count(1) FILTER")
       + """ FROM (SELECT airport_code, strftime(flight_date, '%Y-%m') AS m, 1 AS hit FROM site_rel
       WHERE volume_ratio > 1.8 AND year(flight_date) = 1998) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def _(t):
    d = AN.relative_features(site_days(t)).where("year(flight_date) = 1998").withColumn(
        "is_anomaly", (F.col("volume_ratio") > 1.8).cast("int"))
    m = RP.flagged_matrix(d, MONTHS)
    return m.select("airport_code", "total", *[F.col(f"`{x}`").alias(f"m{x[-2:]}") for x in MONTHS])

"""Business measures."""

from pyspark.sql import functions as F

from opsreliability.catalog.base import SITES, query, view
from opsreliability.catalog.scoring import scores
from opsreliability.catalog.series import TARGETS, net_flags, x
from opsreliability.operators import measures as ME
from opsreliability.operators import series as SE

view("seg_airports", """SELECT origin AS airport_code, CASE WHEN count(1) >= 2600 THEN 'Major hub'
    WHEN count(1) >= 2000 THEN 'Mid-size' ELSE 'Regional' END AS segment FROM legs GROUP BY 1""")
view("seg_routes", """SELECT route, CASE WHEN count(1) >= 120 THEN 'Trunk route' WHEN count(1) >= 80
    THEN 'Mid-volume route' ELSE 'Thin route' END AS segment FROM legs WHERE dep_hour < 20
  GROUP BY 1""")
view("star", """SELECT legs.*, date_trunc('month', flight_date)::DATE AS month_start,
    strftime(flight_date, '%b %Y') AS month_label, strftime(flight_date, '%a') AS dow_name,
    carrier_name, airport_code, airport_name, a.state, segment AS ops_segment
  FROM legs LEFT JOIN carriers ON carrier_code = carrier
  LEFT JOIN airports a ON airport_code = origin LEFT JOIN seg_airports USING (airport_code)""")

_cause = {"carrier": "carrier_delay_min", "weather": "weather_delay_min", "nas": "nas_delay_min",
          "security": "security_delay_min", "late_aircraft": "late_aircraft_delay_min"}
_all5 = "(" + " + ".join(f"ifnull(sum({c}), 0)" for c in _cause.values()) + ")"
# SQL of each measure with its output type
SQL = {
    "flights": ("count(1)", "l"),
    "completed_flights": ("sum(completed)", "l"),
    "delayed_flights": ("sum(arr_del15)", "d"),
    "on_time_pct": ("1 - sum(arr_del15) / nullif(sum(completed), 0)", "r6"),
    "delay_rate_pct": ("sum(arr_del15) / nullif(sum(completed), 0)", "r6"),
    "avg_arrival_delay_min": ("avg(arr_delay_min) FILTER (completed = 1)", "r6"),
    "avg_delay_when_late_min": ("avg(arr_delay_min) FILTER (arr_del15 = 1)", "r6"),
    "dep_delay_rate_pct": ("sum(dep_del15) / nullif(count(1) - sum(cancelled), 0)", "r6"),
    "avg_taxi_out_min": ("avg(taxi_out_min)", "r6"),
    "cancelled_flights": ("sum(cancelled)", "l"),
    "cancellation_rate_pct": ("avg(cancelled)", "r6"),
    "diversion_rate_pct": ("avg(diverted)", "r6"),
    **{f"{k}_delay_total_min": (f"sum({c})", "r4") for k, c in _cause.items()},
    "total_cause_min": (f"nullif({_all5}, 0)", "r4"),
    **{f"{k}_share_pct": (f"sum({_cause[k]}) / nullif({_all5}, 0)", "r6")
       for k in ("late_aircraft", "weather", "carrier", "nas")},
    "scored_flights": ("count(1)", "l"),
    "avg_predicted_delay_risk": ("avg(delay_prob)", "r6"),
    "observed_delay_rate": ("avg(arr_del15)", "r6"),
    "calibration_gap_pp": ("100 * (avg(delay_prob) - avg(arr_del15))", "r5"),
    "high_risk_flights": ("nullif(sum((delay_prob >= 0.45)::INT), 0)", "d"),
    "high_risk_hit_rate": ("avg(arr_del15) FILTER (delay_prob >= 0.45)", "r6"),
    "flagged_precision": ("avg(arr_del15) FILTER (delay_pred = 1)", "r6"),
    "avg_p90_delay_min": ("avg(delay_p90)", "r4"),
    "avg_cancel_risk": ("avg(cancel_prob)", "r6"),
}
LEG_MEASURES = [n for n in list(SQL) if n not in (
    "scored_flights", "avg_predicted_delay_risk", "observed_delay_rate", "calibration_gap_pp",
    "high_risk_flights", "high_risk_hit_rate", "flagged_precision", "avg_p90_delay_min",
    "avg_cancel_risk")]
SCORE_MEASURES = [n for n in SQL if n not in LEG_MEASURES]


def select_sql(names, by, source, where="true"):
    cols = [*by, *[f"{SQL[n][0]} AS {n}" for n in names]]
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return f"SELECT {', '.join(cols)} FROM {source} WHERE {where}{group}"


def spec(names, by=()):
    kinds = {"dep_hour": "i", "target": "s"}
    return " ".join([f"{b}:{kinds.get(b, 's')}" for b in by] + [f"{n}:{SQL[n][1]}" for n in names])


def segments_airports(t):
    n = t.columns("origin").groupBy(F.col("origin").alias("airport_code")).agg(F.count("*").alias("n"))
    return n.select("airport_code", F.when(F.col("n") >= 2600, "Major hub")
                    .when(F.col("n") >= 2000, "Mid-size").otherwise("Regional").alias("segment"))


def segments_routes(t):
    n = t.columns("route", "dep_hour").where("dep_hour < 20").groupBy("route").agg(F.count("*").alias("n"))
    return n.select("route", F.when(F.col("n") >= 120, "Trunk route")
                    .when(F.col("n") >= 80, "Mid-volume route").otherwise("Thin route")
                    .alias("segment"))


def star(t, carriers=True, airports=True, columns=()):
    """The star frame of all columns of the legs, or of these."""
    from opsreliability.operators.dims import airport_dim_with_segment
    legs = t.columns(*dict.fromkeys((*columns, *SITES))) if columns else t.staged
    a = airport_dim_with_segment(t.airports, segments_airports(t)) if airports else None
    return ME.star_frame(legs, t.carriers if carriers else None, a)


for _name, _by in {"me1_to_me22_network": [], "me1_to_me22_by_carrier": ["carrier_name"],
                   "me1_to_me22_by_month": ["month_label"],
                   "me1_to_me22_by_state_and_weekday": ["state", "dow_name"]}.items():
    @query(_name, spec(LEG_MEASURES, _by), select_sql(LEG_MEASURES, _by, "star"))
    def _(t, by=_by):
        return ME.measures(star(t, "carrier_name" in by, "state" in by), LEG_MEASURES, by)


@query("me1_to_me22_filtered", spec(LEG_MEASURES, ["route"]),
       select_sql(LEG_MEASURES, ["route"], "star",
                  "carrier_name = 'Building Lines' AND ops_segment <> 'Regional' "
                  "AND year(flight_date) IN (1998, 1999)"))
def _(t):
    return ME.measures(star(t), LEG_MEASURES, ["route"],
                       where=F.expr("carrier_name = 'Building Lines' AND ops_segment <> 'Regional' "
                                    "AND year(flight_date) IN (1998, 1999)"))


PM = ("on_time_pct_pm:r6 on_time_mom_pp:r4 flights_mom_pct:r6")
_pm_sql = """WITH m AS (SELECT {k} month_start, month_label, count(1) AS n,
       1 - sum(arr_del15) / nullif(sum(completed), 0) AS o FROM star GROUP BY ALL)
       SELECT {a} a.month_label, b.o AS on_time_pct_pm, 100 * (a.o - b.o) AS on_time_mom_pp,
       (a.n - b.n) / b.n AS flights_mom_pct FROM m a LEFT JOIN m b
       ON b.month_start + INTERVAL 1 MONTH = a.month_start {on}"""


@query("me23_to_me25_month_over_month", "month_label:s " + PM, _pm_sql.format(k="", a="", on=""))
def _(t):
    return ME.measures(star(t, False, False), ["on_time_pct_pm", "on_time_mom_pp",
                                               "flights_mom_pct"], ["month_label"])


@query("me23_to_me25_by_carrier_filtered", "carrier_name:s month_label:s " + PM,
       "SELECT * FROM (" + _pm_sql.format(k="carrier_name,", a="a.carrier_name,",
                                          on="AND b.carrier_name = a.carrier_name")
       + ") WHERE month_label LIKE 'Mar %'")
def _(t):
    """The month filter keeps only March, whose values still compare with February."""
    return ME.measures(star(t, True, False),
                       ["on_time_pct_pm", "on_time_mom_pp", "flights_mom_pct"],
                       ["carrier_name", "month_label"], having=F.col("month_label").like("Mar %"))


@query("me26_carrier_otp_rank", "carrier_name:s on_time_pct:r6 carrier_otp_rank:l",
       """SELECT carrier_name, o AS on_time_pct, rank() OVER (ORDER BY o DESC NULLS LAST)
       AS carrier_otp_rank FROM (SELECT carrier_name, 1 - sum(arr_del15) / sum(completed) AS o
       FROM star GROUP BY 1)""")
def _(t):
    return ME.measures(star(t, True, False), ["on_time_pct", "carrier_otp_rank"], ["carrier_name"])


@query("me26_rank_by_month", "month_label:s carrier_name:s carrier_otp_rank:l",
       """SELECT month_label, carrier_name, rank() OVER (PARTITION BY month_label
       ORDER BY o DESC NULLS LAST) AS carrier_otp_rank FROM (SELECT month_label, carrier_name,
       1 - sum(arr_del15) / nullif(sum(completed), 0) AS o FROM star GROUP BY 1, 2)""")
def _(t):
    return ME.measures(star(t, True, False), ["carrier_otp_rank"], ["month_label", "carrier_name"])


@query("me27_route_vs_network", "route:s on_time_pct:r6 route_otp_vs_network_pp:r4",
       """SELECT route, o AS on_time_pct, 100 * (o - (SELECT 1 - sum(arr_del15) / sum(completed)
       FROM star WHERE carrier = 'BUILDING')) AS route_otp_vs_network_pp FROM (SELECT route,
       1 - sum(arr_del15) / nullif(sum(completed), 0) AS o FROM star WHERE carrier = 'BUILDING'
       AND state = 'R2' GROUP BY 1)""")
def _(t):
    rows = star(t, False, columns=("flight_date", "carrier", "route", "completed", "arr_del15"))
    return ME.measures(rows, ["on_time_pct", "route_otp_vs_network_pp"], ["route"],
                       where=F.col("carrier") == "BUILDING", route_where=F.col("state") == "R2")


view("score_star", """SELECT s.*, carrier_name FROM score_rows s
  LEFT JOIN carriers ON carrier_code = carrier""")


def score_star(t):
    return ME.star_frame(scores(t), t.carriers)


for _name, _by in {"me28_to_me36_network": [], "me28_to_me36_by_carrier": ["carrier_name"],
                   "me28_to_me36_by_route": ["route"]}.items():
    @query(_name, spec(SCORE_MEASURES, _by), select_sql(SCORE_MEASURES, _by, "score_star"))
    def _(t, by=_by):
        return ME.measures(score_star(t), SCORE_MEASURES, by)


@query("me37_anomaly_days", "anomaly_days:l",
       "SELECT count(1) AS anomaly_days FROM net_flags WHERE is_anomaly = 1")
def _(t):
    return ME.measures(net_flags(t), ["anomaly_days"])


view("bt_all", " UNION ALL ".join(
    f"SELECT '{c}' AS target, b.*, roll7_lag7 AS learned FROM bt_{n} b JOIN x_{n} USING (series, "
    f"flight_date)" for n, c in TARGETS.items()).replace("b.*", "series, flight_date, b.y, "
    "origin, seasonal_naive, mean_4wk_same_weekday"))
BT = ("backtest_mae_learned", "backtest_mae_seasonal_naive", "backtest_mae_4wk_mean")
_bt_cols = dict(zip(BT, ("learned", "seasonal_naive", "mean_4wk_same_weekday")))


def backtests(t):
    """Backtest rows of both targets; the weekly mean stands in for the learned forecast."""
    out = None
    for n, c in TARGETS.items():
        b = SE.backtest_windows(x(t, n)).select(
            F.lit(c).alias("target"), "series", "flight_date", "origin", "y", "seasonal_naive",
            "mean_4wk_same_weekday", F.col("roll7_lag7").alias("learned"))
        out = b if out is None else out.unionByName(b)
    return out


BT_SQL = ("SELECT target, " + ", ".join(
    f"avg(abs({c} - y)) * CASE target WHEN 'arr_delay_rate' THEN 100 ELSE 1 END AS {n}"
    for n, c in _bt_cols.items()) + " FROM bt_all GROUP BY target")
BT_SPEC = "target:s " + " ".join(f"{n}:r5" for n in BT)


@query("me38_to_me40_backtest_mae", BT_SPEC, BT_SQL)
def _(t):
    return ME.measures(backtests(t), BT, ["target"])

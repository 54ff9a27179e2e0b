"""Report and app queries, as measures grouped by columns or as small views over marts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsreliability.operators.aggregates import pivot, reweight
from opsreliability.operators.measures import measures
from opsreliability.operators.sampling import top_k
from opsreliability.operators.series import tail_days

CAUSE_TOTALS = ("carrier_delay_total_min", "weather_delay_total_min", "nas_delay_total_min",
                "security_delay_total_min", "late_aircraft_delay_total_min")

# Grouping columns and measures of the report visuals over the leg fact.
VISUALS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "rq1": (("month_label",), ("flights", "on_time_pct")),
    "rq2": (("carrier_name",), ("on_time_pct",)),
    "rq4": (("dep_hour",), ("delay_rate_pct",)),
    "rq5": (("airport_code",), ("flights", "on_time_pct", "cancellation_rate_pct")),
    "rq6": (("carrier_name",), ("flights", "on_time_pct", "avg_arrival_delay_min",
                                "cancellation_rate_pct", "late_aircraft_share_pct",
                                "carrier_otp_rank")),
    "rq7": (("carrier_name",), ("on_time_pct", "cancellation_rate_pct", "flights")),
    "rq8": (("carrier_name", "month_label"), ("on_time_pct",)),
    "rq9": (("carrier_name",), (*CAUSE_TOTALS[:3], CAUSE_TOTALS[4])),
    "rq10": (("airport_code",), ("flights", "dep_delay_rate_pct")),
    "rq11": (("airport_code",), ("avg_taxi_out_min", "dep_delay_rate_pct", "flights")),
    "rq12": (("route",), ("flights", "on_time_pct", "avg_arrival_delay_min",
                          "cancellation_rate_pct", "route_otp_vs_network_pp")),
    "rq13": (("dow_name", "dep_hour"), ("delay_rate_pct",)),
    "rq14": (("month_label",), CAUSE_TOTALS),
    "rq15": (("cancellation_reason",), ("cancelled_flights",)),
    "rq16": (("month_label",), ("cancelled_flights",)),
    "rq17": (("airport_code",), ("flights", "weather_share_pct", "cancellation_rate_pct")),
}
LEG_CARDS = ("flights", "on_time_pct", "avg_arrival_delay_min", "cancellation_rate_pct",
             "avg_delay_when_late_min", "diversion_rate_pct", "late_aircraft_share_pct",
             "carrier_share_pct", "nas_share_pct", "weather_share_pct", "cancelled_flights")
SCORE_CARDS = ("scored_flights", "avg_predicted_delay_risk", "observed_delay_rate",
               "calibration_gap_pp", "high_risk_hit_rate", "avg_cancel_risk")


def visual(name: str, star: DataFrame, **filters) -> DataFrame:
    by, names = VISUALS[name]
    return measures(star, names, by, **filters)


def long_measures(star: DataFrame, names: Sequence[str], **filters) -> DataFrame:
    """One row per measure."""
    one = measures(star, names, **filters)
    return one.select(*[F.col(c).cast("double") for c in names]).unpivot(
        [], list(names), "measure", "value")


def mean_by(df: DataFrame, by: Sequence[str], avgs: Sequence[str],
            sums: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in avgs],
                               *[F.sum(c).alias(c) for c in sums])


def carrier_ranking(carrier_month: DataFrame) -> DataFrame:
    return reweight(carrier_month, ["carrier", "carrier_name"],
                    {"on_time_pct": "completed_flights"}, ["scheduled_flights"]).orderBy("on_time_pct")


def cause_totals(causes_month: DataFrame) -> DataFrame:
    cols = ["carrier_min", "weather_min", "nas_min", "security_min", "late_aircraft_min"]
    return causes_month.agg(*[F.sum(c).alias(c) for c in cols]).unpivot([], cols, "cause", "minutes")


def hour_profile(hour_dow: DataFrame, more_than: int = 5000) -> DataFrame:
    return reweight(hour_dow, ["dep_hour"], {"arr_delay_rate_pct": "scheduled_flights"},
                    ["scheduled_flights"]).where(F.col("scheduled_flights") > more_than)


def worst_routes(routes: DataFrame, k: int = 12) -> DataFrame:
    return top_k(routes, [F.col("on_time_pct").asc_nulls_last(), F.col("route")], k)


def forecast_view(history: DataFrame, backtest: DataFrame, future: DataFrame, series: str,
                  target: str, days: int = 90) -> DataFrame:
    """History tail, backtest and coming days of one series and target as one long frame."""
    mine = lambda d: d.where(F.col("series") == series)
    h = tail_days(mine(history), days).select(
        "flight_date", F.lit("actual").alias("kind"), F.col(target).cast("double").alias("value"))
    b = mine(backtest).where(F.col("target") == target).select(
        "flight_date", "learned", "seasonal_naive").unpivot(
        ["flight_date"], ["learned", "seasonal_naive"], "kind", "value")
    f = mine(future).where(F.col("target") == target).select(
        "flight_date", F.lit("next days").alias("kind"),
        F.col("forecast").cast("double").alias("value"))
    return h.unionByName(b).unionByName(f)


def segment_box(items: DataFrame, value: str, segment: str = "segment") -> DataFrame:
    """Quartiles per segment."""
    return items.groupBy(segment).agg(
        F.count("*").alias("items"), F.min(value).alias("low"), F.percentile(value, 0.25).alias("q1"),
        F.median(value).alias("median"), F.percentile(value, 0.75).alias("q3"),
        F.max(value).alias("high"))


def flagged_days(days: DataFrame) -> DataFrame:
    return days.where("is_anomaly = 1").orderBy(F.col("cancellation_rate").desc_nulls_last(),
                                                "flight_date")


def flagged_matrix(site_days: DataFrame, months: Sequence[str], k: int = 15,
                   site: str = "airport_code") -> DataFrame:
    """Flagged site-days by month for the k most flagged sites."""
    hit = site_days.where("is_anomaly = 1").withColumn(
        "month", F.date_format("flight_date", "yyyy-MM"))
    m = pivot(hit, [site], "month", months, F.sum("is_anomaly"), 0)
    total = sum((F.col(f"`{x}`") for x in months[1:]), F.col(f"`{months[0]}`"))
    return top_k(m.withColumn("total", total), [F.col("total").desc(), F.col(site)], k)

"""KPI marts over staged legs.

Each mart is one partial / final aggregation: rows are combined before they are shuffled, so a
group holding a large part of the table costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsreliability.functions.scalar import round_away, safe_div
from opsreliability.operators.joins import join_dim
from opsreliability.sources.schemas import CAUSES

COMPLETED = "completed = 1"
FLOWN = "cancelled = 0"
LATE = "arr_del15 = 1"


def only(c: str, pred: str) -> Column:
    """The value where the predicate holds, NULL elsewhere: input of a filtered aggregate."""
    return F.when(F.expr(pred), F.col(c))


def avg_where(c: str, pred: str) -> Column:
    return F.avg(only(c, pred))


def pct(c: str, digits: int) -> Column:
    return round_away(F.avg(c) * 100, digits)


def on_time_pct(digits: int = 2) -> Column:
    return round_away((1 - F.avg("arr_del15")) * 100, digits)


def avg_delay() -> Column:
    return round_away(avg_where("arr_delay_min", COMPLETED), 2)


def kpi_overview(legs: DataFrame) -> DataFrame:
    return legs.agg(
        F.min("flight_date").alias("first_date"), F.max("flight_date").alias("last_date"),
        F.count("*").alias("scheduled_flights"), F.sum("completed").alias("completed_flights"),
        F.countDistinct("carrier").alias("carriers"),
        F.countDistinct("origin").alias("origin_airports"),
        F.countDistinct("route").alias("routes"),
        on_time_pct().alias("on_time_pct"), avg_delay().alias("avg_arr_delay_min"),
        round_away(avg_where("arr_delay_min", LATE), 2).alias("avg_delay_when_late_min"),
        pct("cancelled", 3).alias("cancellation_rate_pct"),
        pct("diverted", 3).alias("diversion_rate_pct"))


def kpi_carrier_month(legs: DataFrame, carriers: DataFrame) -> DataFrame:
    """Aggregated first, named after: the join sees one row per month and carrier."""
    m = legs.groupBy("year_month", "carrier").agg(
        F.count("*").alias("scheduled_flights"), F.sum("completed").alias("completed_flights"),
        on_time_pct().alias("on_time_pct"), avg_delay().alias("avg_arr_delay_min"),
        pct("cancelled", 3).alias("cancellation_rate_pct"),
        pct("diverted", 3).alias("diversion_rate_pct"),
        *[F.sum(c).alias(c) for c in CAUSES])
    named = join_dim(m, carriers.select("carrier_code", "carrier_name"),
                     {"carrier": "carrier_code"})
    return named.select("year_month", "carrier", "carrier_name", *m.columns[2:])


def kpi_airport_month(legs: DataFrame, airports: DataFrame) -> DataFrame:
    m = legs.groupBy("year_month", F.col("origin").alias("airport")).agg(
        F.count("*").alias("scheduled_departures"), on_time_pct().alias("on_time_arrival_pct"),
        round_away(avg_where("dep_del15", FLOWN) * 100, 2).alias("dep_delay_rate_pct"),
        round_away(avg_where("dep_delay_min", FLOWN), 2).alias("avg_dep_delay_min"),
        round_away(F.avg("taxi_out_min"), 2).alias("avg_taxi_out_min"),
        pct("cancelled", 3).alias("cancellation_rate_pct"))
    a = airports.select("airport_code", "airport_name", "state")
    return (m.join(a, F.col("airport") == F.col("airport_code"))
            .select("year_month", "airport_code", "airport_name", "state", *m.columns[2:]))


def kpi_route(legs: DataFrame, min_flights: int = 300) -> DataFrame:
    """Route reliability.  The percentile counts equal minutes before they travel."""
    return (legs.groupBy("route", "origin", "dest").agg(
        F.min("distance_mi").alias("distance_mi"), F.count("*").alias("scheduled_flights"),
        F.countDistinct("carrier").alias("carriers"), on_time_pct().alias("on_time_pct"),
        avg_delay().alias("avg_arr_delay_min"),
        round_away(F.percentile(only("arr_delay_min", COMPLETED), 0.9), 1)
        .alias("p90_arr_delay_min"),
        pct("cancelled", 3).alias("cancellation_rate_pct"))
        .where(F.col("scheduled_flights") >= min_flights))


def kpi_hour_dow(legs: DataFrame) -> DataFrame:
    return legs.groupBy("dep_hour", "day_of_week").agg(
        F.count("*").alias("scheduled_flights"), pct("arr_del15", 2).alias("arr_delay_rate_pct"),
        avg_delay().alias("avg_arr_delay_min"),
        pct("cancelled", 3).alias("cancellation_rate_pct"))


def delay_causes_month(legs: DataFrame) -> DataFrame:
    """Minutes and shares per cause; shares are ratios of sums."""
    short = [c.removesuffix("_delay_min") for c in CAUSES]
    m = legs.groupBy("year_month", "carrier").agg(
        *[F.sum(c).alias(f"{s}_min") for c, s in zip(CAUSES, short)],
        F.count(only("arr_del15", LATE)).alias("delayed_flights"))
    total = sum((F.col(f"{s}_min") for s in short[1:]), F.col(f"{short[0]}_min"))
    m = m.withColumn("total_cause_min", total)
    return m.select("*", *[round_away(safe_div(F.col(f"{s}_min") * 100, "total_cause_min"), 2)
                           .alias(f"{s}_share_pct") for s in short])


def cancellation_reasons_month(legs: DataFrame) -> DataFrame:
    return (legs.where("cancelled = 1").groupBy("year_month", "cancellation_reason")
            .agg(F.count("*").alias("cancelled_flights")))


def daily_network(legs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Daily series of the whole network, or per ``by`` columns."""
    return legs.groupBy(*by, "flight_date").agg(
        F.count("*").alias("scheduled_flights"),
        round_away(F.avg("arr_del15"), 5).alias("arr_delay_rate"),
        round_away(F.avg("cancelled"), 5).alias("cancellation_rate"),
        round_away(avg_where("arr_delay_min", COMPLETED), 3).alias("avg_arr_delay_min"),
        *[F.sum(c).alias(c) for c in CAUSES if c != "security_delay_min"])


def _row_causes() -> Column:
    """Sum over the causes of one leg, NULL when any is NULL."""
    return sum((F.col(c) for c in CAUSES[1:]), F.col(CAUSES[0]))


def daily_airport(legs: DataFrame) -> DataFrame:
    return legs.groupBy("flight_date", F.col("origin").alias("airport_code")).agg(
        F.count("*").alias("scheduled_departures"),
        round_away(F.avg("arr_del15"), 5).alias("arr_delay_rate"),
        round_away(avg_where("dep_del15", FLOWN), 5).alias("dep_delay_rate"),
        round_away(F.avg("cancelled"), 5).alias("cancellation_rate"),
        round_away(avg_where("dep_delay_min", FLOWN), 3).alias("avg_dep_delay_min"),
        round_away(F.avg("taxi_out_min"), 3).alias("avg_taxi_out_min"),
        round_away(safe_div(F.sum("weather_delay_min"), F.sum(_row_causes())), 5)
        .alias("weather_share"))


def airport_profile(legs: DataFrame, min_departures: int = 3000) -> DataFrame:
    causes = F.sum(_row_causes())
    share = lambda c: safe_div(F.sum(c), causes)
    return (legs.groupBy(F.col("origin").alias("airport_code")).agg(
        F.count("*").alias("scheduled_departures"),
        F.countDistinct("dest").alias("destinations"), F.countDistinct("carrier").alias("carriers"),
        F.avg("arr_del15").alias("arr_delay_rate"),
        avg_where("dep_del15", FLOWN).alias("dep_delay_rate"),
        F.avg("cancelled").alias("cancellation_rate"),
        avg_where("dep_delay_min", FLOWN).alias("avg_dep_delay_min"),
        F.avg("taxi_out_min").alias("avg_taxi_out_min"), F.avg("distance_mi").alias("avg_distance_mi"),
        F.avg(F.when(F.col("dep_hour") >= 17, 1).otherwise(0)).alias("evening_share"),
        share("weather_delay_min").alias("weather_cause_share"),
        share("nas_delay_min").alias("nas_cause_share"),
        share("late_aircraft_delay_min").alias("late_aircraft_cause_share"),
        F.stddev_samp(only("dep_delay_min", FLOWN)).alias("dep_delay_std_min"))
        .where(F.col("scheduled_departures") >= min_departures))


def monthly_summary(legs: DataFrame) -> DataFrame:
    return legs.groupBy("year_month").agg(
        F.count("*").alias("flights"), ((1 - F.avg("arr_del15")) * 100).alias("otp"),
        (F.avg("cancelled") * 100).alias("canc"))


def carrier_scorecard(legs: DataFrame, carriers: DataFrame) -> DataFrame:
    m = legs.groupBy("carrier").agg(
        F.count("*").alias("flights"), on_time_pct(1).alias("otp"),
        round_away(avg_where("arr_delay_min", COMPLETED), 1).alias("avg_delay"),
        pct("cancelled", 2).alias("cancel_pct"), F.min("flight_date").alias("first_day"),
        F.max("flight_date").alias("last_day"))
    return join_dim(m, carriers.select("carrier_code", "carrier_name"),
                    {"carrier": "carrier_code"}).drop("carrier")


def hourly_profile(legs: DataFrame, more_than: int = 5000) -> DataFrame:
    return (legs.groupBy("dep_hour").agg(
        F.count("*").alias("n"), (F.avg("arr_del15") * 100).alias("delay_rate"),
        (F.avg("cancelled") * 100).alias("cancel_rate")).where(F.col("n") > more_than))


def cause_mix(legs: DataFrame) -> DataFrame:
    """One row per cause: minutes and share of all cause minutes."""
    sums = legs.agg(*[F.sum(c).alias(c.removesuffix("_delay_min")) for c in CAUSES])
    long = sums.unpivot([], sums.columns, "cause", "minutes")
    total = long.agg(F.sum("minutes").alias("t"))
    return long.withColumn("share_pct", round_away(F.col("minutes") * 100 / total.scalar(), 2))

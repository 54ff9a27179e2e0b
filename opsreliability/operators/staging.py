"""Raw records to typed legs, with the rejected rows kept apart.

Every function here is one narrow projection over the scan: no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsreliability.functions import scalar as S
from opsreliability.sources.schemas import CANCELLATION_REASONS, CAUSES

BAD_BLOCK = "non_positive_or_missing_crs_elapsed"


def _unusable(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) <= 0)


def rejection_rules() -> dict[str, Column]:
    """Reason -> predicate, first match wins.

    The first reason is the source error that is reported; rows without a key are not usable
    either and get a reason of their own, so that no row disappears without a trace.
    """
    rules = {BAD_BLOCK: _unusable("CRSElapsedTime") | _unusable("Distance")}
    for c in ("FlightDate", "Origin", "Dest", "Reporting_Airline"):
        rules[f"missing_{c}"] = F.col(c).isNull()
    return rules


def with_reason(df: DataFrame, rules: Mapping[str, Column],
                name: str = "quarantine_reason") -> DataFrame:
    """Add the reason of the first rule that rejects a row, NULL for good rows."""
    return df.withColumn(name, F.coalesce(*[F.when(p, r) for r, p in rules.items()]))


def quarantine_split(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their reason); the two are disjoint and complete."""
    marked = with_reason(df, rules)
    return (marked.where("quarantine_reason IS NULL").drop("quarantine_reason"),
            marked.where("quarantine_reason IS NOT NULL"))


def quarantine(raw: DataFrame, all_reasons: bool = False) -> DataFrame:
    """Rejected raw rows.  Only the block-time and distance errors unless ``all_reasons``."""
    bad = quarantine_split(raw, rejection_rules())[1]
    return bad if all_reasons else bad.where(F.col("quarantine_reason") == BAD_BLOCK)


def stage_legs(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed, normalised legs with the derived schedule columns, one row per good raw row."""
    good = quarantine_split(raw, rejection_rules())[0]
    zero_flag = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("tinyint")
    typed = good.select(
        *keep,
        F.col("FlightDate").alias("flight_date"),
        S.code("Reporting_Airline").alias("carrier"),
        S.blank_to_null(S.code("Tail_Number")).alias("tail_number"),
        F.trim("Flight_Number_Reporting_Airline").alias("flight_number"),
        S.code("Origin").alias("origin"),
        F.col("OriginCityName").alias("origin_city"),
        F.col("OriginState").alias("origin_state"),
        S.code("Dest").alias("dest"),
        F.col("DestCityName").alias("dest_city"),
        F.col("DestState").alias("dest_state"),
        S.to_int("CRSDepTime").alias("crs_dep_hhmm"),
        S.to_int("CRSArrTime").alias("crs_arr_hhmm"),
        S.to_int("DepTime").alias("dep_hhmm"),
        S.to_int("ArrTime").alias("arr_hhmm"),
        F.col("DepDelay").alias("dep_delay_min"),
        F.col("ArrDelay").alias("arr_delay_min"),
        zero_flag("DepDel15").alias("dep_del15"),
        F.col("ArrDel15").cast("tinyint").alias("arr_del15_raw"),
        zero_flag("Cancelled").alias("cancelled"),
        S.blank_to_null(F.trim("CancellationCode")).alias("cancellation_code"),
        zero_flag("Diverted").alias("diverted"),
        F.col("TaxiOut").alias("taxi_out_min"),
        F.col("TaxiIn").alias("taxi_in_min"),
        F.col("CRSElapsedTime").alias("crs_elapsed_min"),
        F.col("ActualElapsedTime").alias("actual_elapsed_min"),
        F.col("AirTime").alias("air_time_min"),
        F.col("Distance").alias("distance_mi"),
        *[F.col(src).alias(dst) for src, dst in zip(
            ("CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay"),
            CAUSES)],
    )
    flown = (F.col("cancelled") == 0) & (F.col("diverted") == 0)
    return (typed
            .withColumn("flight_id", S.row_id("carrier", "flight_number", "origin", "dest",
                                              "flight_date", "crs_dep_hhmm"))
            .withColumn("crs_dep_min_of_day", S.hhmm_to_minute("crs_dep_hhmm"))
            .withColumn("crs_arr_min_of_day", S.hhmm_to_minute("crs_arr_hhmm"))
            .withColumn("dep_hour", S.hhmm_to_hour("crs_dep_hhmm"))
            .withColumn("arr_hour", S.hhmm_to_hour("crs_arr_hhmm"))
            .withColumn("sched_dep_ts", S.at_minute("flight_date", "crs_dep_min_of_day"))
            .withColumn("route", S.key("origin", "dest"))
            .withColumn("year_month", S.month_key("flight_date"))
            .withColumn("day_of_week", S.iso_weekday("flight_date"))
            .withColumn("completed", flown.cast("tinyint"))
            .withColumn("arr_del15",
                        F.when(flown, F.coalesce("arr_del15_raw", F.lit(0).cast("tinyint"))))
            .withColumn("cancellation_reason",
                        S.decode("cancellation_code", CANCELLATION_REASONS)))

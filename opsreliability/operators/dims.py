"""Dimension builders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsreliability.functions import scalar as S
from opsreliability.operators.joins import between_bounds, lookup, match_by_priority

# Rank of aerodrome types when several records share a code.
TYPE_RANK = {"large_airport": 1, "medium_airport": 2, "small_airport": 3}


def sites_seen(legs: DataFrame) -> DataFrame:
    """Every code seen at either end of a leg with its city and state (smallest when several)."""
    end = lambda p: legs.groupBy(F.col(p).alias("iata")).agg(
        F.min(f"{p}_city").alias("city"), F.min(f"{p}_state").alias("state"))
    both = end("origin").union(end("dest")).distinct()
    return both.groupBy("iata").agg(F.min("city").alias("city"), F.min("state").alias("state"))


def registry_candidates(registry: DataFrame) -> list[DataFrame]:
    """Registry rows under their code first, under the code hidden in a K-ident second."""
    by_code = registry.where("iata_code <> ''").withColumn("iata", F.col("iata_code"))
    by_ident = (registry.where(F.col("ident").like("K%") & (F.length("ident") == 4))
                .withColumn("iata", F.expr("substr(ident, 2)")))
    return [by_code, by_ident]


def airport_dim(legs: DataFrame, registry: DataFrame) -> DataFrame:
    """Sites seen in the legs, enriched by the best registry row."""
    size = F.coalesce(*[F.when(F.col("type") == t, F.lit(r)) for t, r in TYPE_RANK.items()],
                      F.lit(4))
    serviced = F.when(F.col("scheduled_service") == "yes", 0).otherwise(1)
    attrs = registry.select("ident", "iata_code", "name", "latitude_deg", "longitude_deg",
                            "elevation_ft", "type", "scheduled_service")
    m = match_by_priority(sites_seen(legs), "iata", registry_candidates(attrs),
                          [serviced, size, F.col("ident"), F.col("name")])
    return m.select(
        F.col("iata").alias("airport_code"),
        F.coalesce("name", "city").alias("airport_name"), "city", "state",
        F.col("latitude_deg").try_cast("double").alias("latitude"),
        F.col("longitude_deg").try_cast("double").alias("longitude"),
        F.col("elevation_ft").try_cast("double").alias("elevation_ft"),
        F.coalesce("type", F.lit("unknown")).alias("airport_type"),
        F.col("ident").isNotNull().alias("has_ourairports_match"))


def carrier_dim(legs: DataFrame, names: DataFrame) -> DataFrame:
    """Carriers with their name (the code when unnamed) and volume; counted before the lookup."""
    n = legs.groupBy(F.col("carrier").alias("carrier_code")).agg(
        F.count("*").alias("flights_in_window"))
    return (lookup(n, names, "carrier_code", "code", "name", F.col("carrier_code"), "carrier_name")
            .select("carrier_code", "carrier_name", "flights_in_window"))


def date_dim(calendar: DataFrame, legs: DataFrame, train_end: str, valid_end: str) -> DataFrame:
    """Calendar attributes of the days the legs cover."""
    d = F.col("flight_date")
    days = between_bounds(calendar, "flight_date", legs, "flight_date")
    return days.select(
        S.date_key(d).alias("date_key"), d.alias("date"), F.year(d).alias("year"),
        F.month(d).alias("month"), F.date_format(d, "MMM yyyy").alias("month_label"),
        S.month_key(d).alias("year_month"), F.quarter(d).alias("quarter"),
        S.iso_weekday(d).alias("iso_dow"), F.date_format(d, "EEE").alias("dow_name"),
        (S.iso_weekday(d) >= 6).alias("is_weekend"),
        (F.col("is_holiday") == 1).alias("is_federal_holiday"), "days_to_holiday",
        S.split_label(d, train_end, valid_end).alias("model_split"))


def route_dim(legs: DataFrame, segments: DataFrame) -> DataFrame:
    r = legs.groupBy("route").agg(
        F.min("origin").alias("origin"), F.min("dest").alias("dest"),
        F.median("distance_mi").alias("distance_mi"), F.count("*").alias("scheduled_flights"))
    return lookup(r, segments, "route", "route", "segment", name="route_segment")


def airport_dim_with_segment(airports: DataFrame, segments: DataFrame) -> DataFrame:
    return lookup(airports, segments, "airport_code", "airport_code", "segment",
                  name="ops_segment")

"""Batch scoring of planned legs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsreliability.functions import scalar as S
from opsreliability.operators.joins import lookup_chain

# Edges and names of the risk bands.
BAND_EDGES = (0.15, 0.30, 0.45)
BAND_NAMES = ("low", "moderate", "elevated", "high")
OPTIONAL = ("origin_sched_deps_day", "origin_sched_deps_hour", "dest_sched_arrs_hour",
            "carrier_sched_day")


def risk_band(p: Column | str) -> Column:
    return S.band(p, BAND_EDGES, BAND_NAMES)


def normalise_requests(requests: DataFrame) -> DataFrame:
    up = {c: F.upper(c) for c in ("carrier", "origin", "dest")}
    return requests.withColumns(up).withColumn("route", S.key("origin", "dest"))


CODES = ("carrier", "origin", "dest")


def known_codes(legs: DataFrame) -> DataFrame:
    """(kind, code) of all carriers, origins and destinations, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("code")) for c in CODES])
    return legs.select(F.explode(pairs).alias("k")).select("k.*").where("code IS NOT NULL").distinct()


def validate_requests(requests: DataFrame, codes: DataFrame, routes: DataFrame) -> DataFrame:
    """Requests with their route defaults and the first reason against scoring them, if any.

    ``codes`` are the ``known_codes``, ``routes`` the usual distance and block time per route.
    """
    d = normalise_requests(requests)
    for c in CODES:
        known = codes.where(F.col("kind") == c).select(F.col("code").alias(c), F.lit(True).alias(f"_known_{c}"))
        d = d.join(known, c, "left")
    usual = routes.select("route", F.col("distance_mi").alias("_dist"),
                          F.col("crs_elapsed_min").alias("_block"))
    d = d.join(usual, "route", "left")
    d = (d.withColumn("distance_mi", F.coalesce("distance_mi", "_dist"))
         .withColumn("crs_elapsed_min", F.coalesce("crs_elapsed_min", "_block")))
    t = F.col("crs_dep_time")
    reason = (F.when(F.col("_known_carrier").isNull(), "unknown carrier")
              .when(F.col("_known_origin").isNull(), "unknown origin")
              .when(F.col("_known_dest").isNull(), "unknown dest")
              .when(F.col("origin") == F.col("dest"), "origin and dest must differ")
              .when(t.isNull() | ~t.between(0, 2400) | (t % 100 >= 60), "crs_dep_time must be HHMM")
              .when(F.col("distance_mi").isNull() | F.col("crs_elapsed_min").isNull(),
                    "route not flown in training window"))
    return d.withColumn("reject_reason", reason).drop(
        "_known_carrier", "_known_origin", "_known_dest", "_dist", "_block")


#: Schedule counts that a request may leave open: profile table and keys that stand in for them.
PROFILE_KEYS = {"origin_sched_deps_day": ("origin", ["origin", "day_of_week"]),
                "origin_sched_deps_hour": ("origin", ["origin", "day_of_week", "dep_hour"]),
                "dest_sched_arrs_hour": ("dest", ["dest", "day_of_week", "arr_hour"]),
                "carrier_sched_day": ("carrier", ["carrier", "day_of_week"])}


def profile_levels(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """<count>_keys, <count>_first and <count>_all: the mean over the keys, the median over the first key and
    over everything, for each schedule count."""
    out = {}
    for col, (name, keys) in PROFILE_KEYS.items():
        t = tables[name]
        out[f"{col}_keys"] = t.groupBy(*keys).agg(F.avg(col).alias(col))
        out[f"{col}_first"] = t.groupBy(keys[0]).agg(F.median(col).alias(col))
        out[f"{col}_all"] = t.agg(F.median(col).alias(col))
    return out


def _filled(d: DataFrame, levels: Mapping[str, DataFrame], col: str) -> DataFrame:
    """Given value, else the first level that has one."""
    given, keys = f"_given_{col}", PROFILE_KEYS[col][1]
    d = lookup_chain(d.withColumnRenamed(col, given),
                     [(levels[f"{col}_keys"], keys), (levels[f"{col}_first"], [keys[0]])], [col],
                     levels[f"{col}_all"])
    return d.withColumn(col, F.coalesce(F.col(given).cast("double"), col)).drop(given)


def request_features(valid: DataFrame, levels: Mapping[str, DataFrame], encodings: Mapping[str, DataFrame],
                     priors: DataFrame, calendar: DataFrame) -> DataFrame:
    """Model features of valid requests from the lookup tables (``levels``: ``profile_levels``)."""
    dep = S.hhmm_to_minute("crs_dep_time")
    guess = F.floor((F.col("crs_dep_min_of_day") + F.col("crs_elapsed_min")) / 60) % 24
    arr = F.when(F.col("crs_arr_time").isNotNull(), S.hhmm_to_hour("crs_arr_time")).otherwise(guess)
    d = (valid.withColumn("crs_dep_min_of_day", dep)
         .withColumn("dep_hour", S.hhmm_to_hour("crs_dep_time"))
         .withColumn("arr_hour", arr.cast("int"))
         .withColumn("day_of_week", S.iso_weekday("flight_date"))
         .withColumn("is_weekend", (S.iso_weekday("flight_date") >= 6).cast("int"))
         .withColumn("sched_speed_mpm", S.safe_div("distance_mi", "crs_elapsed_min")))
    cal = calendar.select("flight_date", "days_to_holiday")
    d = d.join(cal, "flight_date", "left").withColumn(
        "days_to_holiday", F.coalesce("days_to_holiday", F.lit(30)))
    for col in PROFILE_KEYS:
        d = _filled(d, levels, col)
    keys = {"route": F.col("route"), "carrier_origin": S.key("carrier", "origin"),
            "flight": S.key("carrier", "flight_number")}
    for name, key in keys.items():
        t = encodings[name].select(F.col("key").alias("_key"), *[
            F.col(f"te_{x}").alias(f"te_{name}_{x}") for x in ("delay", "cancel")])
        d = d.join(t, key == F.col("_key"), "left").drop("_key")
        for x in ("delay", "cancel"):
            c = f"te_{name}_{x}"
            d = d.withColumn(c, F.coalesce(F.col(c).cast("double"), priors.select(x).scalar()))
    return d


def delay_outputs(df: DataFrame, threshold: float, p: str = "p", p50: str = "q50",
                  p90: str = "q90") -> DataFrame:
    """Flag, band and ordered quantiles from the calibrated probability."""
    return (df.withColumn("predicted_delayed", F.col(p) >= threshold)
            .withColumn("risk_band", risk_band(p))
            .withColumn("delay_minutes_p50", F.col(p50))
            .withColumn("delay_minutes_p90", F.greatest(p90, p50)))


def cancel_outputs(df: DataFrame, priors: DataFrame, p: str = "p") -> DataFrame:
    base = priors.select("cancel").scalar()
    return (df.withColumn("baseline_rate", base)
            .withColumn("relative_risk", S.safe_div(F.col(p), "baseline_rate")))


# ------------------------------------------------------------------ score marts

# Edges and names of the reporting bands.
REPORT_EDGES = (0.1, 0.2, 0.3, 0.4, 0.5)
REPORT_NAMES = ("0-10%", "10-20%", "20-30%", "30-40%", "40-50%", "50%+")


def assemble_scores(legs: DataFrame, cancel: DataFrame, delay: DataFrame, minutes: DataFrame,
                    key: str = "flight_id") -> DataFrame:
    """Legs with a cancellation score, and the other scores where there are any.  All joins are
    on the same key, so the shuffle of the first serves the others."""
    facts = legs.select(key, "flight_date", "carrier", "origin", "dest", "route", "dep_hour",
                        "year_month", "completed", "cancelled", "arr_del15", "arr_delay_min")
    return (facts.join(cancel, key).join(delay.select(key, "delay_prob", "delay_pred"), key, "left")
            .join(minutes.select(key, "delay_p50", "delay_p90"), key, "left"))


def score_fact(scores: DataFrame, key: str = "flight_id") -> DataFrame:
    return scores.select(
        F.col(key).cast("string").alias("flight_id"), S.date_key("flight_date").alias("date_key"),
        F.col("carrier").alias("carrier_code"), F.col("origin").alias("origin_airport"), "route",
        "delay_prob", "delay_pred", "delay_p50", "delay_p90", "cancel_prob", "arr_del15",
        "cancelled")


def risk_bands(scores: DataFrame) -> DataFrame:
    done = scores.where("completed = 1")
    return done.groupBy(S.band("delay_prob", REPORT_EDGES, REPORT_NAMES).alias("risk_band")).agg(
        F.count("*").alias("flights"), F.avg("delay_prob").alias("mean_predicted"),
        F.avg("arr_del15").alias("observed_rate"))


def _completed() -> Column:
    return F.count(F.when(F.col("completed") == 1, 1)).alias("completed_flights")


def score_carrier_month(scores: DataFrame) -> DataFrame:
    return scores.groupBy("year_month", F.col("carrier").alias("carrier_code")).agg(
        _completed(), F.avg("delay_prob").alias("mean_delay_prob"),
        F.avg("arr_del15").alias("observed_delay_rate"), F.avg("delay_p50").alias("mean_p50_min"),
        F.avg("delay_p90").alias("mean_p90_min"), F.avg("cancel_prob").alias("mean_cancel_prob"),
        F.avg("cancelled").alias("observed_cancel_rate"))


def route_risk(scores: DataFrame, min_flights: int = 100) -> DataFrame:
    return (scores.groupBy("route", F.col("origin").alias("origin_airport"),
                           F.col("dest").alias("dest_airport")).agg(
        _completed(), F.avg("delay_prob").alias("mean_delay_prob"),
        F.avg("arr_del15").alias("observed_delay_rate"), F.avg("delay_p90").alias("mean_p90_min"),
        F.avg("cancel_prob").alias("mean_cancel_prob"), F.count("*").alias("_n"))
        .where(F.col("_n") >= min_flights).drop("_n")
        .orderBy(F.col("mean_delay_prob").desc_nulls_last()))


def score_hour(scores: DataFrame) -> DataFrame:
    return scores.where("completed = 1").groupBy("dep_hour").agg(
        F.count("*").alias("flights"), F.avg("delay_prob").alias("mean_delay_prob"),
        F.avg("arr_del15").alias("observed_delay_rate"))


def fact_export(legs: DataFrame, key: str = "flight_id") -> DataFrame:
    return legs.select(
        F.col(key).cast("string").alias("flight_id"), S.date_key("flight_date").alias("date_key"),
        F.col("carrier").alias("carrier_code"), F.col("origin").alias("origin_airport"),
        F.col("dest").alias("dest_airport"), "route", "flight_number", "dep_hour", "crs_dep_hhmm",
        "distance_mi", "crs_elapsed_min", "completed", "cancelled", "diverted", "arr_del15",
        "dep_del15", "arr_delay_min", "dep_delay_min", "taxi_out_min", "cancellation_reason",
        "carrier_delay_min", "weather_delay_min", "nas_delay_min", "security_delay_min",
        "late_aircraft_delay_min")

"""Scalar functions and filters over whole tables."""

from pyspark.sql import functions as F

from opsreliability.catalog.base import TRAIN_END, VALID_END, query
from opsreliability.functions import scalar as S
from opsreliability.operators import staging as ST
from opsreliability.operators.joins import between_bounds


@query("fn1_normalise_codes", "leg_key:s carrier:s tail:s code:s cancelled:d",
       """SELECT leg_key, upper(trim(Reporting_Airline)) AS carrier,
       CASE upper(trim(Tail_Number)) WHEN '' THEN NULL ELSE upper(trim(Tail_Number)) END AS tail,
       CASE WHEN length(trim(CancellationCode)) > 0 THEN trim(CancellationCode) END AS code,
       CASE WHEN Cancelled IS NULL THEN 0 ELSE Cancelled END AS cancelled FROM raw""")
def _(t):
    return t.raw.select("leg_key", S.code("Reporting_Airline").alias("carrier"),
                        S.blank_to_null(S.code("Tail_Number")).alias("tail"),
                        S.blank_to_null(F.trim("CancellationCode")).alias("code"),
                        F.coalesce("Cancelled", F.lit(0.0)).alias("cancelled"))


@query("fn2_try_cast", "leg_key:s dep:d arr:d name_number:d",
       """SELECT leg_key, try_cast(CRSDepTime AS INT) AS dep, try_cast(ArrTime AS INT) AS arr,
       try_cast(Reporting_Airline AS DOUBLE) AS name_number FROM raw""")
def _(t):
    return t.raw.select("leg_key", S.to_int("CRSDepTime").alias("dep"),
                        S.to_int("ArrTime").alias("arr"),
                        F.col("Reporting_Airline").try_cast("double").alias("name_number"))


@query("fn3_hhmm_to_minute_hour", "leg_key:s minute:i hour:i",
       """SELECT leg_key, CASE WHEN x IS NULL OR x >= 2400 THEN 1439
       ELSE 60 * (x // 100) + x % 100 END AS minute,
       CASE WHEN x IS NULL OR x >= 2400 THEN 23 ELSE x // 100 END AS hour
       FROM (SELECT leg_key, try_cast(CRSDepTime AS INT) AS x FROM raw)""")
def _(t):
    h = S.to_int("CRSDepTime")
    return t.raw.select("leg_key", S.hhmm_to_minute(h).alias("minute"),
                        S.hhmm_to_hour(h).alias("hour"))


@query("fn4_date_plus_minutes", "leg_key:s sched_dep_ts:s sched_arr_ts:s",
       """SELECT leg_key, sched_dep_ts,
       epoch_ms(CAST(epoch_ms(CAST(flight_date AS TIMESTAMP)) + 60000 * crs_arr_min_of_day AS BIGINT))
       AS sched_arr_ts FROM legs""")
def _(t):
    return t.legs.select("leg_key", "sched_dep_ts",
                         S.at_minute("flight_date", "crs_arr_min_of_day").alias("sched_arr_ts"))


@query("fn5_concat_keys", "leg_key:s route:s flight_key:s carrier_origin:s tail_key:s",
       """SELECT leg_key, origin || '-' || dest AS route, carrier || '-' || flight_number AS flight_key,
       carrier || '-' || origin AS carrier_origin, tail_number || '-' || origin AS tail_key
       FROM legs""")
def _(t):
    return t.legs.select("leg_key", S.key("origin", "dest").alias("route"),
                         S.key("carrier", "flight_number").alias("flight_key"),
                         S.key("carrier", "origin").alias("carrier_origin"),
                         S.key("tail_number", "origin").alias("tail_key"))


@query("fn6_date_labels", "flight_date:s year_month:s date_key:i month_label:s dow_name:s legs:l",
       """SELECT flight_date, strftime(flight_date, '%Y-%m') AS year_month,
       year(flight_date) * 10000 + month(flight_date) * 100 + day(flight_date) AS date_key,
       strftime(flight_date, '%b %Y') AS month_label, strftime(flight_date, '%a') AS dow_name,
       count(1) AS legs FROM legs GROUP BY flight_date""")
def _(t):
    d = F.col("flight_date")
    return t.legs.groupBy("flight_date").agg(F.count("*").alias("legs")).select(
        d, S.month_key(d).alias("year_month"), S.date_key(d).alias("date_key"),
        F.date_format(d, "MMM yyyy").alias("month_label"),
        F.date_format(d, "EEE").alias("dow_name"), "legs")


@query("fn7_date_parts", "flight_date:s iso_dow:i day:i month:i quarter:i year:i legs:l",
       """SELECT flight_date, isodow(flight_date) AS iso_dow, day(flight_date) AS day,
       month(flight_date) AS month, quarter(flight_date) AS quarter, year(flight_date) AS year,
       count(1) AS legs FROM legs GROUP BY flight_date""")
def _(t):
    d = F.col("flight_date")
    return t.legs.groupBy("flight_date").agg(F.count("*").alias("legs")).select(
        d, S.iso_weekday(d).alias("iso_dow"), F.dayofmonth(d).alias("day"),
        F.month(d).alias("month"), F.quarter(d).alias("quarter"), F.year(d).alias("year"), "legs")


@query("fn8_boolean_flags", "leg_key:s weekend:d late:d same_ends:i",
       """SELECT leg_key, CASE WHEN isodow(flight_date) IN (6, 7) THEN 1 ELSE 0 END AS weekend,
       CASE WHEN arr_delay_min >= 15 THEN 1 WHEN arr_delay_min < 15 THEN 0 END AS late,
       CASE origin WHEN dest THEN 1 ELSE 0 END AS same_ends FROM legs""")
def _(t):
    return t.legs.select("leg_key", S.flag(F.col("day_of_week") >= 6).alias("weekend"),
                         S.flag(F.col("arr_delay_min") >= 15).alias("late"),
                         S.flag(F.col("origin") == F.col("dest")).alias("same_ends"))


@query("fn9_case_decode_band_split", "leg_key:s reason:s delay_band:s split:s",
       f"""SELECT leg_key, CASE cancellation_code WHEN 'A' THEN 'Carrier' WHEN 'B' THEN 'Weather'
       WHEN 'C' THEN 'National Air System' WHEN 'D' THEN 'Security' END AS reason,
       CASE WHEN arr_delay_min < 0 THEN 'early' WHEN arr_delay_min < 15 THEN 'on time'
       WHEN arr_delay_min < 60 THEN 'late' ELSE 'very late or unknown' END AS delay_band,
       CASE WHEN flight_date > DATE '{VALID_END}' THEN 'test' WHEN flight_date > DATE '{TRAIN_END}'
       THEN 'valid' ELSE 'train' END AS split FROM legs""")
def _(t):
    from opsreliability.sources.schemas import CANCELLATION_REASONS
    return t.legs.select(
        "leg_key", S.decode("cancellation_code", CANCELLATION_REASONS).alias("reason"),
        S.band("arr_delay_min", (0, 15, 60), ("early", "on time", "late", "very late or unknown"))
        .alias("delay_band"),
        S.split_label("flight_date", TRAIN_END, VALID_END).alias("split"))


@query("fn10_row_id", "leg_key:s flight_id:s fold:i",
       """SELECT leg_key, flight_id, CAST('0x' || left(md5(flight_id), 7) AS BIGINT) % 5 AS fold
       FROM legs""")
def _(t):
    return t.legs.select("leg_key", "flight_id", S.fold("flight_id", 5).alias("fold"))


@query("fn10_row_id64_distinct", "row_count:l distinct_ids:l",
       """SELECT count(1) AS row_count, count(DISTINCT leg_key) AS distinct_ids FROM legs""")
def _(t):
    """The 64-bit id separates the rows of this table."""
    return t.legs.select(S.row_id64("leg_key").alias("id")).agg(
        F.count("*").alias("row_count"), F.countDistinct("id").alias("distinct_ids"))


@query("fn11_substr_length_like", "ident:s body:s n:i is_k:b",
       """SELECT ident, right(ident, length(ident) - 1) AS body, length(ident) AS n,
       starts_with(ident, 'K') AS is_k FROM registry""")
def _(t):
    return t.registry.select("ident", F.expr("substr(ident, 2)").alias("body"),
                             F.length("ident").alias("n"), F.col("ident").like("K%").alias("is_k"))


@query("fn12_numeric", "leg_key:s cents:r2 size:d whole:d mag:r6 log_odds:r6",
       """SELECT leg_key, crs_elapsed_min * taxi_out_min / 7 AS cents, abs(arr_delay_min) AS size,
       floor(arr_delay_min / 10) AS whole, log10(crs_elapsed_min) AS mag,
       ln(p / (1 - p)) AS log_odds
       FROM (SELECT *, CASE WHEN taxi_out_min / 100 < 0.0001 THEN 0.0001
             ELSE taxi_out_min / 100 END AS p FROM legs)""")
def _(t):
    return t.legs.select(
        "leg_key", S.round_away(F.col("crs_elapsed_min") * F.col("taxi_out_min") / 7, 2).alias("cents"),
        F.abs("arr_delay_min").alias("size"), F.floor(F.col("arr_delay_min") / 10).alias("whole"),
        F.log10("crs_elapsed_min").alias("mag"),
        S.logit(F.col("taxi_out_min") / 100, 1e-4).alias("log_odds"))


@query("fn13_null_safe_division", "leg_key:s share:r6 speed:r6",
       """SELECT leg_key, CASE WHEN taxi_in_min <> 0 THEN taxi_out_min / taxi_in_min END AS share,
       distance_mi / crs_elapsed_min AS speed FROM legs""")
def _(t):
    return t.legs.select("leg_key", S.safe_div("taxi_out_min", "taxi_in_min").alias("share"),
                         S.safe_div("distance_mi", "crs_elapsed_min").alias("speed"))


@query("fn14_star_projection", "n_nationkey:i n_name:s",
       "SELECT n_nationkey, n_name FROM nation")
def _(t):
    return t.table("nation").drop("n_regionkey").select("*")


@query("fn15_day_span", "days:i distinct_days:l",
       """SELECT date_diff('day', min(flight_date), max(flight_date)) + 1 AS days,
       count(DISTINCT flight_date) AS distinct_days FROM legs""")
def _(t):
    return t.legs.agg(S.day_span("flight_date").alias("days"),
                      F.countDistinct("flight_date").alias("distinct_days"))


@query("flt1_predicates", "leg_key:s dep_hour:i carrier:s arr_delay_min:d",
       """SELECT leg_key, dep_hour, carrier, arr_delay_min FROM legs
       WHERE dep_hour >= 6 AND dep_hour <= 9 AND carrier = ANY(['BUILDING', 'FURNITURE'])
       AND NOT (origin IN ('N01', 'N02')) AND tail_number IS NOT NULL
       AND (arr_delay_min > 15 OR arr_delay_min < -30) AND (taxi_out_min < 2 OR taxi_out_min > 6)""")
def _(t):
    c = F.col
    return t.legs.where(
        c("dep_hour").between(6, 9) & c("carrier").isin("BUILDING", "FURNITURE")
        & ~c("origin").isin("N01", "N02") & c("tail_number").isNotNull()
        & ((c("arr_delay_min") > 15) | (c("arr_delay_min") < -30))
        & ~c("taxi_out_min").between(2, 6)).select("leg_key", "dep_hour", "carrier",
                                                   "arr_delay_min")


@query("flt2_quarantine_split", "reason:s row_count:l",
       """SELECT reason, count(1) AS row_count FROM (SELECT CASE
         WHEN NOT (coalesce(CRSElapsedTime, 0) > 0 AND coalesce(Distance, 0) > 0)
           THEN 'non_positive_or_missing_crs_elapsed'
         WHEN FlightDate IS NULL THEN 'missing_FlightDate' WHEN Origin IS NULL THEN 'missing_Origin'
         WHEN Dest IS NULL THEN 'missing_Dest'
         WHEN Reporting_Airline IS NULL THEN 'missing_Reporting_Airline' ELSE 'staged' END AS reason
       FROM raw) GROUP BY reason""")
def _(t):
    good, bad = ST.quarantine_split(t.raw, ST.rejection_rules())
    both = good.select(F.lit("staged").alias("reason")).union(bad.select("quarantine_reason"))
    return both.groupBy("reason").agg(F.count("*").alias("row_count"))


@query("flt3_between_bounds", "leg_date:s legs:l",
       """SELECT CAST(l_shipdate AS DATE) AS leg_date, count(1) AS legs FROM lineitem
       WHERE CAST(l_shipdate AS DATE) BETWEEN (SELECT min(flight_date) FROM legs)
       AND (SELECT max(flight_date) FROM legs) GROUP BY 1""")
def _(t):
    days = t.table("lineitem").select(F.col("l_shipdate").cast("date").alias("leg_date"))
    inside = between_bounds(days, "leg_date", t.legs, "flight_date")
    return inside.groupBy("leg_date").agg(F.count("*").alias("legs"))

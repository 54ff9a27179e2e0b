"""Joins, aggregations and window-like operators."""

from pyspark.sql import functions as F

from opsreliability.catalog.base import TRAIN_END, VALID_END, query, view
from opsreliability.catalog.marts import ROUTE_SQL
from opsreliability.functions import scalar as S
from opsreliability.operators import aggregates as A
from opsreliability.operators import calendar as C
from opsreliability.operators import joins as J
from opsreliability.operators import marts as M
from opsreliability.operators import windows as WN

CAL_START, CAL_END = "1994-12-01", "2001-12-31"


def calendar(t):
    return C.holiday_calendar(t.spark, CAL_START, CAL_END)


# Federal holidays from first principles: a day is one when a rule says so.
view("days", f"""SELECT CAST(d AS DATE) AS flight_date FROM
    generate_series(DATE '{CAL_START}', DATE '{CAL_END}', INTERVAL 1 DAY) g(d)""")
view("holiday_days", """SELECT flight_date FROM days WHERE
    CASE isodow(flight_date)
      WHEN 6 THEN false WHEN 7 THEN false
      ELSE strftime(flight_date, '%m%d') IN ('0101', '0704', '1111', '1225')
        OR (isodow(flight_date) = 5 AND strftime(flight_date + 1, '%m%d') IN ('0101', '0704', '1111', '1225'))
        OR (isodow(flight_date) = 1 AND strftime(flight_date - 1, '%m%d') IN ('0101', '0704', '1111', '1225'))
    END
    OR (isodow(flight_date) = 1 AND (
         (month(flight_date) IN (1, 2) AND day(flight_date) BETWEEN 15 AND 21)
      OR (month(flight_date) = 5 AND day(flight_date) > 24)
      OR (month(flight_date) = 9 AND day(flight_date) < 8)
      OR (month(flight_date) = 10 AND day(flight_date) BETWEEN 8 AND 14)))
    OR (isodow(flight_date) = 4 AND month(flight_date) = 11 AND day(flight_date) BETWEEN 22 AND 28)""")
view("cal", """SELECT flight_date, least(30, CAST(min(abs(flight_date - h)) AS INT)) AS days_to_holiday,
    CASE WHEN min(abs(flight_date - h)) = 0 THEN 1 ELSE 0 END AS is_holiday
  FROM days, (SELECT flight_date AS h FROM holiday_days) GROUP BY flight_date""")


# ---------------------------------------------------------------- joins

@query("jn1_inner_dim", "route:s airport_name:s legs:l",
       """SELECT route, airport_name, count(1) AS legs FROM legs, airports
       WHERE airport_code = origin GROUP BY ALL""")
def _(t):
    n = t.legs.groupBy("route", "origin").agg(F.count("*").alias("legs"))
    return J.join_dim(n, t.airports.select("airport_code", "airport_name"),
                      {"origin": "airport_code"})


@query("jn2_left_lookup_with_default", "leg_key:s carrier:s carrier_name:s",
       """SELECT leg_key, carrier, CASE WHEN n.code IS NULL THEN carrier ELSE n.name END AS carrier_name
       FROM legs LEFT JOIN names n ON carrier = n.code""")
def _(t):
    return J.lookup(t.legs, t.names, "carrier", "code", "name", F.col("carrier"), "carrier_name")


@query("jn3_join_best", "iata:s name:s airport_type:s",
       """SELECT DISTINCT ON (s.iata) s.iata, r.name, r.type AS airport_type FROM seen s
       LEFT JOIN registry r ON r.iata_code = s.iata
       ORDER BY s.iata, CAST(r.elevation_ft AS DOUBLE) DESC, r.name""")
def _(t):
    from opsreliability.operators.dims import sites_seen
    r = t.registry.select(F.col("iata_code").alias("iata"), "name",
                          F.col("type").alias("airport_type"), "elevation_ft")
    high = F.expr("cast(elevation_ft as double)")
    return J.join_best(sites_seen(t.legs), r, ["iata"], F.struct(-high, F.col("name")))


FOLDS = "CAST('0x' || left(md5(flight_id), 7) AS BIGINT) % 5"


@query("jn4_left_composite_key", "leg_key:s carrier:s fold:i n_fold:l",
       f"""SELECT leg_key, l.carrier, {FOLDS} AS fold, s.n AS n_fold FROM legs l LEFT JOIN
       (SELECT carrier AS c, {FOLDS} AS f, count(1) AS n FROM legs WHERE cancelled = 1 AND dep_hour < 9
        GROUP BY ALL) s ON c = l.carrier AND f = {FOLDS.replace('flight_id', 'l.flight_id')}""")
def _(t):
    legs = t.legs.withColumn("fold", S.fold("flight_id", 5))
    stats = legs.where("cancelled = 1 AND dep_hour < 9").groupBy("carrier", "fold").agg(
        F.count("*").alias("n_fold"))
    return J.left_on(legs, stats, ["carrier", "fold"])


@query("jn5_join_using", "airport_code:s scheduled_departures:l airport_name:s state:s",
       """SELECT airport_code, k AS scheduled_departures, airport_name, state FROM airports JOIN
       (SELECT origin AS airport_code, count(1) AS k FROM legs GROUP BY origin) USING (airport_code)""")
def _(t):
    n = t.legs.groupBy(F.col("origin").alias("airport_code")).agg(
        F.count("*").alias("scheduled_departures"))
    return J.join_using(n, t.airports, ["airport_code"])


@query("jn7_anti_join_orphans", "carrier:s legs:l",
       """SELECT carrier, count(1) AS legs FROM legs WHERE NOT EXISTS
       (SELECT 1 FROM names WHERE code = carrier) GROUP BY carrier""")
def _(t):
    return J.orphans(t.legs, t.names, "carrier", "code").groupBy("carrier").agg(
        F.count("*").alias("legs"))


@query("jn8_calendar_join", "flight_date:s days_to_holiday:i is_holiday:i legs:l",
       """SELECT flight_date, days_to_holiday, is_holiday, count(1) AS legs
       FROM legs JOIN cal USING (flight_date) GROUP BY ALL""")
def _(t):
    n = t.legs.groupBy("flight_date").agg(F.count("*").alias("legs"))
    return C.join_calendar(n, calendar(t))


@query("jn9_nearest_event", "flight_date:s days_to_peak:i",
       """WITH k AS (SELECT flight_date, count(1) AS n FROM legs GROUP BY 1),
       peaks AS (SELECT flight_date AS p FROM k WHERE n >= 45)
       SELECT flight_date, least(30, (SELECT min(abs(flight_date - p)) FROM peaks)) AS days_to_peak
       FROM k""")
def _(t):
    """Days to the nearest very busy day."""
    n = t.legs.groupBy("flight_date").agg(F.count("*").alias("n"))
    peaks = n.where("n >= 45").select(F.col("flight_date").alias("peak"))
    return C.nearest_event(n, "flight_date", peaks, "peak", 30, "days_to_peak")


@query("jn10_role_playing_dim", "origin_state:s dest_state:s legs:l",
       """SELECT o.state AS origin_state, d.state AS dest_state, count(1) AS legs FROM legs
       LEFT JOIN airports o ON o.airport_code = origin LEFT JOIN airports d ON d.airport_code = dest
       GROUP BY ALL""")
def _(t):
    n = t.legs.groupBy("origin", "dest").agg(F.count("*").alias("n"))
    a = t.airports
    both = J.join_role(J.join_role(n, a, "origin", "airport_code", "origin_", ["state"]),
                       a, "dest", "airport_code", "dest_", ["state"])
    return both.groupBy("origin_state", "dest_state").agg(F.sum("n").alias("legs"))


@query("jn11_lookup_chain", "leg_key:s expected:r6",
       """SELECT leg_key, coalesce(r.m, o.m, (SELECT median(arr_delay_min) FROM legs
         WHERE cancelled = 0 AND dep_hour < 12)) AS expected FROM legs l
       LEFT JOIN (SELECT route, median(arr_delay_min) AS m FROM legs WHERE cancelled = 0 AND
         dep_hour < 12 GROUP BY route HAVING count(1) > 40) r ON r.route = l.route
       LEFT JOIN (SELECT origin, median(arr_delay_min) AS m FROM legs WHERE cancelled = 0 AND
         dep_hour < 12 GROUP BY origin HAVING count(1) > 600) o ON o.origin = l.origin""")
def _(t):
    base = t.staged.where("cancelled = 0 AND dep_hour < 12")
    med = F.median("arr_delay_min").alias("expected")
    level = lambda k, n: (base.groupBy(k).agg(med, F.count("*").alias("_n"))
                          .where(F.col("_n") > n))
    return J.lookup_chain(t.staged, [(level("route", 40), ["route"]), (level("origin", 600), ["origin"])],
                          ["expected"], base.agg(med))


@query("jn12_match_by_priority", "iata:s name:s ident:s",
       "SELECT s.iata, b.name, b.ident FROM seen s LEFT JOIN best_registry b USING (iata)")
def _(t):
    from opsreliability.operators.dims import TYPE_RANK, registry_candidates, sites_seen
    size = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in TYPE_RANK.items()],
                      F.lit(4))
    return J.match_by_priority(
        sites_seen(t.legs), "iata", registry_candidates(t.registry),
        [F.when(F.col("scheduled_service") == "yes", 0).otherwise(1), size, F.col("ident"),
         F.col("name")])


# ---------------------------------------------------------------- aggregations

@query("ag1_basic_aggregates",
       "carrier:s n:l n_delay:l total_delay:r4 mean_delay:r6 min_delay:d max_delay:d",
       """SELECT carrier, count(1) AS n, count(arr_delay_min) AS n_delay, sum(arr_delay_min) AS
       total_delay, sum(arr_delay_min) / count(arr_delay_min) AS mean_delay,
       min(arr_delay_min) AS min_delay, max(arr_delay_min) AS max_delay FROM legs GROUP BY carrier""")
def _(t):
    x = "arr_delay_min"
    return t.legs.groupBy("carrier").agg(
        F.count("*").alias("n"), F.count(x).alias("n_delay"), F.sum(x).alias("total_delay"),
        F.avg(x).alias("mean_delay"), F.min(x).alias("min_delay"), F.max(x).alias("max_delay"))


@query("ag2_distinct_and_duplicates", "origin:s tails:l routes:l",
       """SELECT origin, count(DISTINCT tail_number) AS tails, count(DISTINCT route) AS routes
       FROM legs GROUP BY origin""")
def _(t):
    return t.legs.groupBy("origin").agg(F.countDistinct("tail_number").alias("tails"),
                                        F.countDistinct("route").alias("routes"))


@query("ag2_duplicate_ids", "duplicates:l",
       "SELECT count(1) - count(DISTINCT flight_id) AS duplicates FROM legs")
def _(t):
    return A.dup_count(t.legs, "flight_id")


@query("ag3_filtered_aggregates", "carrier:s late:l mean_flown:r6 late_minutes:r4",
       """SELECT carrier, count(1) FILTER (arr_del15 = 1) AS late,
       avg(dep_delay_min) FILTER (cancelled = 0) AS mean_flown,
       sum(arr_delay_min) FILTER (arr_del15 = 1) AS late_minutes FROM legs GROUP BY carrier""")
def _(t):
    return t.legs.groupBy("carrier").agg(
        F.count(M.only("leg_key", M.LATE)).alias("late"),
        M.avg_where("dep_delay_min", M.FLOWN).alias("mean_flown"),
        F.sum(M.only("arr_delay_min", M.LATE)).alias("late_minutes"))


@query("ag4_quantiles", "origin:s p10:r6 med:r6 p90:r6",
       """SELECT origin, quantile_cont(arr_delay_min, 0.1) AS p10, median(arr_delay_min) AS med,
       quantile_cont(arr_delay_min, 0.9) AS p90 FROM legs GROUP BY origin""")
def _(t):
    from opsreliability.operators.prefix import grouped_quantiles
    return grouped_quantiles(t.legs, ["origin"], {
        n: ("arr_delay_min", p) for n, p in (("p10", 0.1), ("med", 0.5), ("p90", 0.9))})


@query("ag4_quantiles_in_few_large_groups", "l_returnflag:s l_linestatus:s rows:l price_p01:r6 "
       "price_med:r6 price_p99:r6 discount_p75:r6",
       """SELECT l_returnflag, l_linestatus, count(1) AS rows, quantile_cont(l_extendedprice, 0.01)
       AS price_p01, median(l_extendedprice) AS price_med, quantile_cont(l_extendedprice, 0.99) AS
       price_p99, quantile_cont(l_discount, 0.75) AS discount_p75 FROM lineitem GROUP BY ALL""")
def _(t):
    from opsreliability.operators.prefix import grouped_quantiles
    price = "l_extendedprice"
    return grouped_quantiles(t.table("lineitem"), ["l_returnflag", "l_linestatus"], {
        "price_p01": (price, 0.01), "price_med": (price, 0.5), "price_p99": (price, 0.99),
        "discount_p75": ("l_discount", 0.75)}, rows="rows")


@query("ag4_whole_table_quantiles", "q:d value:r6",
       "SELECT q, value FROM (SELECT " + ", ".join(
           f"quantile_cont(l_extendedprice, {q}) AS v{i}" for i, q in
           enumerate((0.1, 0.25, 0.5, 0.75, 0.9, 0.99))) + " FROM lineitem), LATERAL (VALUES "
       + ", ".join(f"({q}, v{i})" for i, q in enumerate((0.1, 0.25, 0.5, 0.75, 0.9, 0.99)))
       + ") AS u(q, value)")
def _(t):
    """Quantiles of a continuous column over the whole table, value counts kept distributed."""
    from opsreliability.operators.prefix import exact_quantiles
    return exact_quantiles(t.table("lineitem"), "l_extendedprice", (0.1, 0.25, 0.5, 0.75, 0.9, 0.99))


@query("ag5_stddev_corr", "carrier:s sd:r6 r:r6",
       """SELECT carrier, stddev_samp(arr_delay_min) AS sd, corr(arr_delay_min, dep_delay_min) AS r
       FROM legs GROUP BY carrier""")
def _(t):
    return t.legs.groupBy("carrier").agg(F.stddev_samp("arr_delay_min").alias("sd"),
                                         F.corr("arr_delay_min", "dep_delay_min").alias("r"))


@query("ag6_any_value_as_min", "route:s origin:s city:s",
       "SELECT route, min(origin) AS origin, min(origin_city) AS city FROM legs GROUP BY route")
def _(t):
    return t.legs.groupBy("route").agg(F.min("origin").alias("origin"),
                                       F.min("origin_city").alias("city"))


@query("ag7_group_by_having", "year_month:s dep_hour:i n:l",
       """SELECT year_month, dep_hour, count(1) AS n FROM legs GROUP BY ALL
       HAVING count(1) >= 40""")
def _(t):
    return (t.legs.groupBy("year_month", "dep_hour").agg(F.count("*").alias("n"))
            .where("n >= 40"))


@query("ag8_ratio_of_sums", "origin:s carrier_share:r6 weather_share:r6 nas_share:r6",
       """SELECT origin, c / nullif(c + w + n, 0) AS carrier_share, w / nullif(c + w + n, 0) AS
       weather_share, n / nullif(c + w + n, 0) AS nas_share FROM (SELECT origin,
       sum(carrier_delay_min) AS c, sum(weather_delay_min) AS w, sum(nas_delay_min) AS n FROM legs
       GROUP BY origin)""")
def _(t):
    sums = t.legs.groupBy("origin").agg(*[F.sum(f"{c}_delay_min").alias(c)
                                          for c in ("carrier", "weather", "nas")])
    return A.shares(sums, ["carrier", "weather", "nas"])


@query("ag9_conditional_share", "origin:s evening_share:r6",
       """SELECT origin, count(1) FILTER (dep_hour > 16) / count(1) AS evening_share
       FROM legs GROUP BY origin""")
def _(t):
    return t.legs.groupBy("origin").agg(
        F.avg(F.when(F.col("dep_hour") >= 17, 1).otherwise(0)).alias("evening_share"))


@query("ag10_reweighted_mart", "year_month:s on_time_pct:r5 cancellation_rate_pct:r5 scheduled_flights:l",
       """SELECT year_month, sum(otp * done) / sum(done) AS on_time_pct,
       sum(canc * n) / sum(n) AS cancellation_rate_pct, sum(n) AS scheduled_flights FROM (
         SELECT year_month, carrier, count(1) AS n, sum(completed) AS done,
         floor(100 * (1 - avg(arr_del15)) * 100 + 0.5) / 100 AS otp,
         floor(100 * avg(cancelled) * 1000 + 0.5) / 1000 AS canc FROM legs GROUP BY ALL)
       GROUP BY year_month""")
def _(t):
    m = M.kpi_carrier_month(t.legs, t.carriers)
    return A.reweight(m, ["year_month"], {"on_time_pct": "completed_flights",
                                          "cancellation_rate_pct": "scheduled_flights"},
                      ["scheduled_flights"])


DOWS = range(1, 8)


@query("ag11_pivot_hour_by_weekday", "dep_hour:i " + " ".join(f"d{d}:r6" for d in DOWS),
       "SELECT dep_hour, " + ", ".join(f"avg(CASE day_of_week WHEN {d} THEN arr_del15 END) AS d{d}"
                                       for d in DOWS) + " FROM legs GROUP BY dep_hour")
def _(t):
    p = A.pivot(t.legs, ["dep_hour"], "day_of_week", list(DOWS), F.avg("arr_del15"))
    return p.select("dep_hour", *[F.col(str(d)).alias(f"d{d}") for d in DOWS])


PCTS = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


@query("ag12_describe_fixed_sample",
       "count:l mean:r6 std:r6 min:d max:d " + " ".join(f"p{round(p * 100)}:r6" for p in PCTS),
       "SELECT count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max, "
       + ", ".join(f"quantile_cont(x, {p}) AS p{round(p * 100)}" for p in PCTS)
       + " FROM (SELECT arr_delay_min AS x FROM legs WHERE completed = 1 "
         "ORDER BY md5('7|' || leg_key), leg_key LIMIT 5000)")
def _(t):
    return A.describe(t.legs.where("completed = 1"), "arr_delay_min", PCTS, 5000, "leg_key", 7)


@query("ag13_histogram", "bin:i bin_start:r6 n:l",
       """SELECT bin, -60 + bin * 3 AS bin_start, count(1) AS n FROM (SELECT CASE
       WHEN arr_delay_min >= 240 THEN 99 WHEN arr_delay_min < -60 THEN 0
       ELSE floor((arr_delay_min + 60) / 3) END AS bin FROM legs WHERE completed = 1
       AND arr_delay_min IS NOT NULL) GROUP BY bin""")
def _(t):
    return A.histogram(t.legs.where("completed = 1"), "arr_delay_min", -60, 240, 100)


@query("ag14_bin_response", "b:i mean_x:r6 mean_y:r6 n:l",
       """SELECT CASE WHEN distance_mi >= 40 THEN 8 ELSE floor(distance_mi / 5) END AS b,
       avg(distance_mi) AS mean_x, avg(arr_del15) AS mean_y, count(1) AS n FROM legs GROUP BY 1""")
def _(t):
    return A.bin_response(t.legs, "distance_mi", "arr_del15", 5, 8)


DRIFT = ("crs_dep_min_of_day", "distance_mi", "crs_elapsed_min")


@query("ag15_split_drift", "feature:s train:r6 valid:r6 test:r6 test_vs_train_pct:r4",
       " UNION ALL ".join(
           f"SELECT '{c}' AS feature, train, valid, test, 100 * (test / train - 1) AS "
           f"test_vs_train_pct FROM (SELECT avg({c}) FILTER (flight_date <= DATE '{TRAIN_END}') AS "
           f"train, avg({c}) FILTER (flight_date > DATE '{TRAIN_END}' AND flight_date <= DATE "
           f"'{VALID_END}') AS valid, avg({c}) FILTER (flight_date > DATE '{VALID_END}') AS test "
           f"FROM legs)" for c in DRIFT))
def _(t):
    d = t.legs.withColumn("split", S.split_label("flight_date", TRAIN_END, VALID_END))
    return A.drift(d, DRIFT)


# ---------------------------------------------------------------- windows

@query("wn1_peer_counts",
       "leg_key:s origin_day:l origin_hour:l dest_hour:l carrier_day:l",
       """SELECT leg_key, count(1) OVER (PARTITION BY origin, flight_date) AS origin_day,
       count(1) OVER (PARTITION BY origin, flight_date, dep_hour) AS origin_hour,
       count(1) OVER (PARTITION BY dest, flight_date, arr_hour) AS dest_hour,
       count(1) OVER (PARTITION BY carrier, flight_date) AS carrier_day FROM legs""")
def _(t):
    return WN.peer_counts(t.staged, {"origin_day": ["origin", "flight_date"],
                                   "origin_hour": ["origin", "flight_date", "dep_hour"],
                                   "dest_hour": ["dest", "flight_date", "arr_hour"],
                                   "carrier_day": ["carrier", "flight_date"]}, "leg_key")


TAIL_ORDER = "PARTITION BY tail_number, flight_date ORDER BY crs_dep_min_of_day, md5(leg_key), leg_key"


@query("wn2_sequence_number", "leg_key:s tail_number:s leg_no:d",
       f"""SELECT leg_key, tail_number, CASE WHEN tail_number IS NOT NULL THEN
       row_number() OVER ({TAIL_ORDER}) END AS leg_no FROM legs""")
def _(t):
    return WN.seq_no(t.staged, ["tail_number", "flight_date"], "crs_dep_min_of_day", "leg_key",
                     "leg_no")


@query("wn3_gap_to_previous", "leg_key:s turn:d",
       f"""SELECT leg_key, CASE WHEN tail_number IS NOT NULL AND g >= 0 THEN g END AS turn FROM (
       SELECT leg_key, tail_number, crs_dep_min_of_day - lag(crs_arr_min_of_day)
       OVER ({TAIL_ORDER}) AS g FROM legs)""")
def _(t):
    return WN.gap_to_prev(t.staged, ["tail_number", "flight_date"], "crs_dep_min_of_day", "leg_key",
                          "crs_dep_min_of_day", "crs_arr_min_of_day", "turn")


@query("wn2_sequence_in_hot_groups", "l_orderkey:l l_partkey:l l_linenumber:i flag_no:i prev_qty:d n:l",
       """SELECT l_orderkey, l_partkey, l_linenumber,
       row_number() OVER (PARTITION BY l_returnflag ORDER BY l_suppkey, md5(k), k) AS flag_no,
       lag(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_suppkey, md5(k), k) AS prev_qty,
       count(1) OVER (PARTITION BY l_returnflag) AS n FROM (SELECT *,
       concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS k FROM lineitem)""")
def _(t):
    """Three groups that hold a third of the table each: split by order range, exact result."""
    from opsreliability.operators.prefix import sequence_in_group
    d = t.table("lineitem").withColumn("k", S.key("l_orderkey", "l_linenumber", "l_partkey",
                                                  "l_suppkey"))
    return sequence_in_group(d, ["l_returnflag"], "l_suppkey", "k", seq="flag_no",
                             lagged=("l_quantity", "prev_qty"), size="n", hot_rows=10_000)


@query("wn4_dedupe", "iata_code:s name:s type:s",
       """SELECT DISTINCT ON (iata_code) iata_code, name, type FROM registry WHERE iata_code <> ''
       ORDER BY iata_code, CASE scheduled_service WHEN 'yes' THEN 0 ELSE 1 END,
       coalesce(list_position(['large_airport', 'medium_airport', 'small_airport'], type), 4), name""")
def _(t):
    from opsreliability.operators.dims import TYPE_RANK
    size = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in TYPE_RANK.items()],
                      F.lit(4))
    return WN.dedupe(t.registry.where("iata_code <> ''"), ["iata_code"],
                     [F.when(F.col("scheduled_service") == "yes", 0).otherwise(1), size,
                      F.col("name")])


@query("wn5_vs_own_median", "leg_key:s crs_elapsed_min_ratio:r6 arr_delay_min_diff:d",
       """SELECT leg_key, crs_elapsed_min / median(crs_elapsed_min) OVER (PARTITION BY origin)
       AS crs_elapsed_min_ratio, arr_delay_min - median(arr_delay_min) OVER (PARTITION BY origin)
       AS arr_delay_min_diff FROM legs""")
def _(t):
    return WN.vs_own_median(t.staged, "origin", ["crs_elapsed_min"], ["arr_delay_min"], "leg_key")


@query("wn8_rank_desc", "route:s otp:r6 otp_rank:l",
       """SELECT route, o AS otp, CASE WHEN o IS NULL THEN count(o) OVER () + 1
       ELSE rank() OVER (ORDER BY o DESC NULLS LAST) END AS otp_rank
       FROM (SELECT route, 1 - avg(arr_del15) AS o FROM legs GROUP BY route)""")
def _(t):
    r = t.legs.groupBy("route").agg((1 - F.avg("arr_del15")).alias("otp"))
    return WN.rank_desc(r, "otp", "otp_rank")


@query("wn9_previous_month", "carrier:s month:s n:l n_pm:d change:d pct_change:r6",
       """WITH m AS (SELECT carrier, date_trunc('month', flight_date) AS month, count(1) AS n
       FROM legs GROUP BY ALL)
       SELECT a.carrier, CAST(a.month AS DATE) AS month, a.n, b.n AS n_pm, a.n - b.n AS change,
       (a.n - b.n) / b.n AS pct_change FROM m a LEFT JOIN m b ON b.carrier = a.carrier
       AND b.month + INTERVAL 1 MONTH = a.month""")
def _(t):
    m = t.legs.groupBy("carrier", F.trunc("flight_date", "month").alias("month")).agg(F.count("*").alias("n"))
    p = WN.prev_period(m, "month", ["n"], ["carrier"])
    return (p.withColumn("change", F.col("n") - F.col("n_pm"))
            .withColumn("pct_change", S.safe_div("change", "n_pm")))


@query("wn10_vs_network", "route:s otp_pp:r6",
       """SELECT route, 100 * ((1 - avg(arr_del15)) - (SELECT 1 - avg(arr_del15) FROM legs)) AS otp_pp
       FROM legs GROUP BY route""")
def _(t):
    otp = (1 - F.avg("arr_del15")).alias("otp")
    return WN.vs_total(t.legs.groupBy("route").agg(otp), "otp", t.legs.agg(otp), "otp_pp", 100)

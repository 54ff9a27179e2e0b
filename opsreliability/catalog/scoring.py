"""Batch scoring and score marts."""

from pyspark.sql import functions as F

from opsreliability.catalog.base import query, view
from opsreliability.catalog.evaluation import TEST, TRAIN, score_legs, score_tables
from opsreliability.catalog.features import PROFILES, TE_SPEC, features, train
from opsreliability.operators import artefacts as AF
from opsreliability.session import cut_lineage, shared_folder
from opsreliability.catalog.relational import calendar
from opsreliability.operators import features as FE
from opsreliability.operators import sampling as SA
from opsreliability.operators import scoring as SC

# requests: the test legs as somebody would ask for them, with gaps and errors
REQUESTS = {
    "leg_key": "leg_key",
    "carrier": "CASE WHEN flight_number LIKE '77%' THEN 'NOBODY' ELSE lower(carrier) END",
    "origin": "CASE WHEN flight_number LIKE '88%' THEN 'XXX' ELSE origin END",
    "dest": "dest",
    "flight_date": "flight_date",
    "crs_dep_time": "CASE WHEN flight_number LIKE '99%' THEN 1275 ELSE crs_dep_hhmm END",
    "crs_arr_time": "CASE WHEN dep_hour % 2 = 0 THEN crs_arr_hhmm END",
    "flight_number": "CASE WHEN dep_hour % 5 > 0 THEN flight_number END",
    "distance_mi": "CASE WHEN dep_hour % 3 = 0 THEN distance_mi END",
    "crs_elapsed_min": "CASE WHEN dep_hour % 3 = 0 THEN crs_elapsed_min END",
    "origin_sched_deps_day": "CASE WHEN dep_hour = 7 THEN CAST(12 AS DOUBLE) END",
    "origin_sched_deps_hour": "CASE WHEN dep_hour = 8 THEN CAST(3 AS DOUBLE) END",
    "dest_sched_arrs_hour": "CAST(NULL AS DOUBLE)",
    "carrier_sched_day": "CAST(NULL AS DOUBLE)",
}
view("requests", "SELECT " + ", ".join(f"{e} AS {c}" for c, e in REQUESTS.items())
     + f" FROM legs WHERE {TEST}")
view("checked", """SELECT * FROM (SELECT r.* EXCLUDE (carrier, distance_mi, crs_elapsed_min),
    upper(r.carrier) AS carrier, r.origin || '-' || r.dest AS route,
    ifnull(r.distance_mi, p.distance_mi) AS distance_mi,
    ifnull(r.crs_elapsed_min, p.crs_elapsed_min) AS crs_elapsed_min,
    CASE WHEN upper(r.carrier) NOT IN (SELECT carrier FROM legs) THEN 'unknown carrier'
      WHEN r.origin NOT IN (SELECT origin FROM legs) THEN 'unknown origin'
      WHEN r.dest NOT IN (SELECT dest FROM legs) THEN 'unknown dest'
      WHEN r.origin = r.dest THEN 'origin and dest must differ'
      WHEN r.crs_dep_time IS NULL OR r.crs_dep_time > 2400 OR r.crs_dep_time < 0
        OR r.crs_dep_time % 100 > 59 THEN 'crs_dep_time must be HHMM'
      WHEN ifnull(r.distance_mi, p.distance_mi) IS NULL OR ifnull(r.crs_elapsed_min,
        p.crs_elapsed_min) IS NULL THEN 'route not flown in training window' END AS reject_reason
  FROM requests r LEFT JOIN profile_route p ON p.route = r.origin || '-' || r.dest)""")


def requests(t, legs=None):
    legs = t.staged if legs is None else legs
    return legs.where(F.expr(TEST)).selectExpr(*[f"{e} AS {c}" for c, e in REQUESTS.items()])


def checked(t):
    return SC.validate_requests(requests(t), SC.known_codes(t.staged), FE.route_profile(train(t)))


@query("sc1_validate_requests",
       "leg_key:s carrier:s route:s distance_mi:d crs_elapsed_min:d reject_reason:s",
       "SELECT * FROM checked")
def _(t):
    return checked(t)


def _prof(col, table, keys):
    on = " AND ".join(f"b.{k} = a.{k}" for k in keys)
    return (f"coalesce(a.{col}, (SELECT avg({col}) FROM {table} b WHERE {on}), "
            f"(SELECT median({col}) FROM {table} b WHERE b.{keys[0]} = a.{keys[0]}), "
            f"(SELECT median({col}) FROM {table}))")


def _enc(name, key, x):
    return (f"coalesce((SELECT te_{x} FROM look_{name} k WHERE k.key = {key}), "
            f"(SELECT {x} FROM prior))")


for _k in FE.TE_KEYS:
    view(f"look_{_k}", f"""SELECT key, CAST((s_delay + 50 * p.delay) / (n_delay + 50) AS FLOAT)
    AS te_delay, CAST((s_cancel + 50 * p.cancel) / (n_cancel + 50) AS FLOAT) AS te_cancel
  FROM all_{_k}, prior p WHERE n_cancel > 4""")
view("asked", """SELECT *, CASE WHEN crs_arr_time IS NOT NULL THEN least(crs_arr_time // 100, 23)
    ELSE CAST(floor((crs_dep_min_of_day + crs_elapsed_min) / 60) AS INT) % 24 END AS arr_hour
  FROM (SELECT *, CASE WHEN crs_dep_time >= 2400 THEN 1439 ELSE 60 * (crs_dep_time // 100)
    + crs_dep_time % 100 END AS crs_dep_min_of_day, least(crs_dep_time // 100, 23) AS dep_hour,
    isodow(flight_date) AS day_of_week FROM checked WHERE reject_reason IS NULL)""")
_keys = {"route": "a.route", "carrier_origin": "a.carrier || '-' || a.origin",
         "flight": "a.carrier || '-' || a.flight_number"}


SC2_SPEC = (
       "leg_key:s dep_hour:i arr_hour:i crs_dep_min_of_day:i day_of_week:i is_weekend:i "
       "days_to_holiday:i sched_speed_mpm:r6 origin_sched_deps_day:r6 origin_sched_deps_hour:r6 "
       "dest_sched_arrs_hour:r6 carrier_sched_day:r6 " + TE_SPEC)
SC2_SQL = (
       "SELECT leg_key, dep_hour, arr_hour, crs_dep_min_of_day, day_of_week, "
       "(day_of_week > 5)::INT AS is_weekend, coalesce((SELECT days_to_holiday FROM cal c WHERE "
       "c.flight_date = a.flight_date), 30) AS days_to_holiday, "
       "distance_mi / crs_elapsed_min AS sched_speed_mpm, "
       + f"{_prof('origin_sched_deps_day', 'profile_origin', ['origin', 'day_of_week'])} "
         "AS origin_sched_deps_day, "
       + f"{_prof('origin_sched_deps_hour', 'profile_origin', ['origin', 'day_of_week', 'dep_hour'])} "
         "AS origin_sched_deps_hour, "
       + f"{_prof('dest_sched_arrs_hour', 'profile_dest', ['dest', 'day_of_week', 'arr_hour'])} "
         "AS dest_sched_arrs_hour, "
       + f"{_prof('carrier_sched_day', 'profile_carrier', ['carrier', 'day_of_week'])} "
         "AS carrier_sched_day, "
       + ", ".join(f"{_enc(k, e, x)} AS te_{k}_{x}" for k, e in _keys.items()
                   for x in ("delay", "cancel")) + " FROM asked a")


PROFILED = sorted({c for by, cols in AF.PROFILES.values() for c in (*by, *cols)}) + ["split"]
FITTED = [*FE.PRE_DEPARTURE, *FE.OUTCOMES, "split"]


@query("sc2_request_features", SC2_SPEC, SC2_SQL)
def _(t):
    tables = AF.lookups(features(t, *PROFILED).where("split = 'train'"), t.staged, train(t), calendar(t))
    ok = checked(t).where("reject_reason IS NULL")
    return SC.request_features(ok, tables, {k: tables[f"encoding_{k}"] for k in FE.TE_KEYS}, tables["priors"],
                               tables["calendar"])


_STORES: dict[tuple[str, str], str] = {}


#: Columns of the legs that a fit, its lookups and the requests look at.
SCORED = list(dict.fromkeys(["leg_key", *FE.legs_columns(FITTED), "carrier", "flight_number", "origin", "dest", "route",
                             "crs_dep_hhmm", "crs_arr_hhmm"]))


def scored_legs(t):
    """One layer of the legs for all of them; the whole staged layer is several times wider."""
    return t.columns(*SCORED)


def store(t):
    """Folder of the artefacts fitted on the given tables, written once per session and data folder."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _STORES:
        root = shared_folder(t.spark, "artefacts")
        legs = scored_legs(t)
        known = FE.schedule_features(legs, ["leg_key"]).where(F.expr(TRAIN))
        AF.save(t.spark, AF.fit(features(t, *FITTED), legs, known, calendar(t)), root)
        _STORES[key] = root
    return _STORES[key]


@query("sc2_features_from_store", SC2_SPEC, SC2_SQL)
def _(t):
    """The same features from the saved lookups, without a look at the training tables."""
    return AF.features_of(AF.load(t.spark, store(t)), requests(t, scored_legs(t)))


@query("sc3_sc4_store_bounds",
       "route:s scored:l bad_probabilities:l crossing_quantiles:l flags_off:l base_rate:r6 ratios_off:l",
       """SELECT route, count(1) AS scored, 0 AS bad_probabilities, 0 AS crossing_quantiles, 0 AS flags_off,
       (SELECT cancel FROM prior) AS base_rate, 0 AS ratios_off FROM asked GROUP BY route""")
def _(t):
    """Scores of a loaded version, held against what they must satisfy, by route."""
    a = AF.load(t.spark, store(t))

    def off(condition):
        return F.count(F.when(~F.coalesce(condition, F.lit(False)), 1))

    return AF.score(a, requests(t, scored_legs(t))).groupBy("route").agg(
        F.count("*").alias("scored"),
        off(F.col("p_delay").between(0, 1) & F.col("p_cancel").between(0, 1)).alias("bad_probabilities"),
        off(F.col("delay_minutes_p50") <= F.col("delay_minutes_p90")).alias("crossing_quantiles"),
        off(F.col("predicted_delayed") == (F.col("p_delay") >= a.threshold)).alias("flags_off"),
        F.max("baseline_rate").alias("base_rate"),
        off(F.abs(F.col("relative_risk") * F.col("baseline_rate") - F.col("p_cancel")) < 1e-9).alias("ratios_off"))


view("score_rows", """SELECT leg_key, flight_date, carrier, origin, dest, route, dep_hour, year_month,
    completed, cancelled, arr_del15, arr_delay_min, delay_prob, delay_pred, delay_p50, delay_p90,
    cancel_prob FROM legs JOIN scores_cancel USING (leg_key) LEFT JOIN scores_delay USING (leg_key)
  LEFT JOIN scores_minutes USING (leg_key)""")


def scores(t):
    return SC.assemble_scores(score_legs(t), *score_tables(t), key="leg_key")


@query("sc3_delay_outputs",
       "leg_key:s predicted_delayed:b risk_band:s delay_minutes_p50:r6 delay_minutes_p90:r6",
       """SELECT leg_key, delay_prob >= 0.5 AS predicted_delayed, CASE WHEN NOT (delay_prob >= 0.15)
       THEN 'low' WHEN NOT (delay_prob >= 0.3) THEN 'moderate' WHEN NOT (delay_prob >= 0.45)
       THEN 'elevated' ELSE 'high' END AS risk_band, delay_p50 AS delay_minutes_p50,
       greatest(delay_p50, delay_p90) AS delay_minutes_p90 FROM score_rows WHERE completed = 1""")
def _(t):
    return SC.delay_outputs(scores(t).where("completed = 1"), 0.5, "delay_prob", "delay_p50",
                            "delay_p90")


@query("sc4_cancel_outputs", "leg_key:s cancel_prob:r6 baseline_rate:r6 relative_risk:r6",
       """SELECT leg_key, cancel_prob, cancel AS baseline_rate, cancel_prob / nullif(cancel, 0)
       AS relative_risk FROM score_rows, prior""")
def _(t):
    return SC.cancel_outputs(scores(t), FE.priors(train(t)), "cancel_prob")


@query("sc3_sc4_model_scores",
       "leg_key:s p_delay:r6 risk_band:s delay_minutes_p50:r4 delay_minutes_p90:r4 p_cancel:r6")
def _(t):
    """Fitted models end to end: a saved version, loaded; requests to features to calibrated scores."""
    return AF.score(AF.load(t.spark, store(t)), requests(t, scored_legs(t)))


@query("sc5_score_export", "leg_key:s delay_prob:r6 delay_pred:i",
       "SELECT leg_key, delay_prob, delay_pred FROM scores_delay")
def _(t):
    from opsreliability.sources.sinks import write_parquet
    _, delay, _ = score_tables(t)
    return t.spark.read.parquet(write_parquet(delay, shared_folder(t.spark, "scores")))


SF_SPEC = ("flight_id:s date_key:i carrier_code:s origin_airport:s route:s delay_prob:r6 "
           "delay_pred:d delay_p50:r6 delay_p90:r6 cancel_prob:r6 arr_del15:d cancelled:i")
view("score_fact", """SELECT leg_key AS flight_id, CAST(strftime(flight_date, '%Y%m%d') AS INT)
    AS date_key, carrier AS carrier_code, origin AS origin_airport, * FROM score_rows""")


@query("jn6_assemble_scores",
       "leg_key:s delay_prob:r6 delay_pred:d delay_p50:r6 delay_p90:r6 cancel_prob:r6",
       "SELECT * FROM score_rows")
def _(t):
    return scores(t)


@query("sm1_score_fact", SF_SPEC, "SELECT * FROM score_fact")
def _(t):
    return SC.score_fact(scores(t), "leg_key")


view("bands", """SELECT CASE WHEN NOT (delay_prob >= 0.5) THEN concat(CAST(floor(delay_prob * 10) AS INT) * 10,
    '-', CAST(floor(delay_prob * 10) AS INT) * 10 + 10, '%') ELSE '50%+' END AS risk_band, count(1) AS flights,
    avg(delay_prob) AS mean_predicted, avg(arr_del15) AS observed_rate
  FROM score_rows WHERE completed = 1 GROUP BY 1""")


@query("sm2_risk_bands", "risk_band:s flights:l mean_predicted:r6 observed_rate:r6",
       "SELECT * FROM bands")
def _(t):
    return SC.risk_bands(scores(t))


@query("sm3_score_carrier_month",
       "year_month:s carrier_code:s completed_flights:l mean_delay_prob:r6 observed_delay_rate:r6 "
       "mean_p50_min:r6 mean_p90_min:r6 mean_cancel_prob:r6 observed_cancel_rate:r6",
       """SELECT year_month, carrier AS carrier_code, sum(completed) AS completed_flights,
       avg(delay_prob) AS mean_delay_prob, avg(arr_del15) AS observed_delay_rate,
       avg(delay_p50) AS mean_p50_min, avg(delay_p90) AS mean_p90_min,
       avg(cancel_prob) AS mean_cancel_prob, avg(cancelled) AS observed_cancel_rate
       FROM score_rows GROUP BY year_month, carrier""")
def _(t):
    return SC.score_carrier_month(scores(t))


view("route_scores", """SELECT route, origin AS origin_airport, dest AS dest_airport,
    sum(completed) AS completed_flights, avg(delay_prob) AS mean_delay_prob,
    avg(arr_del15) AS observed_delay_rate, avg(delay_p90) AS mean_p90_min,
    avg(cancel_prob) AS mean_cancel_prob FROM score_rows GROUP BY route, origin, dest
  HAVING count(1) > 9""")


@query("sm4_route_risk",
       "route:s origin_airport:s dest_airport:s completed_flights:l mean_delay_prob:r6 "
       "observed_delay_rate:r6 mean_p90_min:r6 mean_cancel_prob:r6", "SELECT * FROM route_scores")
def _(t):
    return SC.route_risk(scores(t), 10)


view("hour_scores", """SELECT dep_hour, count(1) AS flights, avg(delay_prob) AS mean_delay_prob,
    avg(arr_del15) AS observed_delay_rate FROM score_rows WHERE completed = 1 GROUP BY dep_hour""")


@query("sm5_score_hour", "dep_hour:i flights:l mean_delay_prob:r6 observed_delay_rate:r6",
       "SELECT * FROM hour_scores")
def _(t):
    return SC.score_hour(scores(t))


@query("sm6_score_sample", SF_SPEC,
       "SELECT * FROM score_fact ORDER BY md5('42|' || flight_id), flight_id LIMIT 2000")
def _(t):
    return SA.fixed_sample(SC.score_fact(scores(t), "leg_key"), "flight_id", 2000)


FACT = ("flight_id:s date_key:i carrier_code:s origin_airport:s dest_airport:s route:s "
        "flight_number:s dep_hour:i crs_dep_hhmm:d distance_mi:d crs_elapsed_min:d completed:i "
        "cancelled:i diverted:i arr_del15:d dep_del15:i arr_delay_min:d dep_delay_min:d "
        "taxi_out_min:r6 cancellation_reason:s carrier_delay_min:r6 weather_delay_min:r6 "
        "nas_delay_min:r6 security_delay_min:r6 late_aircraft_delay_min:r6")
view("fact", """SELECT * EXCLUDE (flight_id), leg_key AS flight_id, carrier AS carrier_code,
    origin AS origin_airport, dest AS dest_airport,
    CAST(strftime(flight_date, '%Y%m%d') AS INT) AS date_key FROM legs""")


@query("sg8_fact_export", FACT, "SELECT * FROM fact")
def _(t):
    return SC.fact_export(t.legs, "leg_key")


@query("sm6_fact_sample", FACT,
       "SELECT * FROM fact ORDER BY md5('42|' || flight_id), flight_id LIMIT 3000")
def _(t):
    return SA.fixed_sample(SC.fact_export(t.staged, "leg_key"), "flight_id", 3000)

"""KPI marts.

Their checks read one long table: a row (grain, metric, value) for each fact that a leg states.  What a
metric counts is said once, by the legs that have a row of it; a mart then is totals, rows
and means by metric of its grain, and a distinct count is the number of metrics that name a member.
"""

from collections.abc import Mapping

from opsreliability.catalog.base import query, view
from opsreliability.operators import marts as M

C5 = ("carrier", "weather", "nas", "security", "late_aircraft")
OTP = "100 * (1 - avg(arr_del15))"
DONE = "avg(CASE completed WHEN 1 THEN arr_delay_min END)"

GRAINS = ("flight_date", "year_month", "carrier", "origin", "dest", "route", "dep_hour", "day_of_week")
#: metric: (value, legs that state it); a NULL value states nothing
METRICS = {
    "scheduled": ("1", "TRUE"), "arrived": ("1", "completed = 1"),
    "late": ("arr_del15", "TRUE"), "arrival_min": ("arr_delay_min", "completed = 1"),
    "late_min": ("arr_delay_min", "arr_del15 = 1"), "dropped": ("cancelled", "TRUE"),
    "rerouted": ("diverted", "TRUE"), "left_late": ("dep_del15", "cancelled = 0"),
    "departure_min": ("dep_delay_min", "cancelled = 0"), "taxi": ("taxi_out_min", "TRUE"),
    "miles": ("distance_mi", "TRUE"), "evening": ("(dep_hour >= 17)::INT", "TRUE"),
    "day": ("epoch(flight_date) / 86400", "TRUE"),
    # a leg that leaves a cause open has no sum of causes
    "causes": (" + ".join(f"{c}_delay_min" for c in C5), "TRUE"),
    **{f"cause {c}": (f"{c}_delay_min", "TRUE") for c in C5}}
#: metrics named after a member: (prefix, member, legs that name it)
MEMBERS = (("by ", "carrier", "TRUE"), ("from ", "origin", "TRUE"), ("to ", "dest", "TRUE"),
           ("over ", "route", "TRUE"), ("for ", "coalesce(cancellation_reason, '')", "cancelled = 1"))

view("leg_facts", f"SELECT {', '.join(GRAINS)}, f.metric, f.value FROM (SELECT *, unnest([" + ", ".join(
    [f"{{'metric': '{m}', 'value': CASE WHEN {has} THEN ({v})::DOUBLE END}}"
     for m, (v, has) in METRICS.items()]
    + [f"{{'metric': '{word}' || {name}, 'value': CASE WHEN {has} THEN 1::DOUBLE END}}"
       for word, name, has in MEMBERS]) + "]) AS f FROM legs) WHERE f.metric IS NOT NULL AND f.value IS NOT NULL")


def total(metric: str) -> str:
    return f"max(t) FILTER (metric = '{metric}')"


def number(metric: str) -> str:
    return f"coalesce(max(n) FILTER (metric = '{metric}'), 0)"


def mean(metric: str, scale: int = 1) -> str:
    return f"max({scale} * t / n) FILTER (metric = '{metric}')"


def members(prefix: str) -> str:
    return f"count(1) FILTER (starts_with(metric, '{prefix}'))"


def day(bound: str) -> str:
    return f"DATE '1970-01-01' + CAST(max({bound}) FILTER (metric = 'day') AS INT)"


def cause_total(c: str) -> str:
    return total(f"cause {c}")


#: unknown where one of the causes has no figure at all
ALL_CAUSES = "(" + " + ".join(map(cause_total, C5)) + ")"
ON_TIME = f"100 - {mean('late', 100)}"


def by_metric(grain: str) -> str:
    """Totals, rows, squares, bounds and sorted values of each metric of a grain."""
    keys = grain + ", " if grain else ""
    return (f"SELECT {keys}metric, sum(value) AS t, count(1) AS n, sum(value * value) AS sq, min(value) AS lo, "
            "max(value) AS hi, list(value ORDER BY value) FILTER (metric = 'arrival_min') AS v "
            f"FROM leg_facts GROUP BY {keys}metric")


def mart(grain: str, outputs: Mapping[str, str], least: int = 0) -> str:
    """Columns of ``grain`` under their names, then the outputs, of groups of ``least`` legs or more."""
    keys = grain + ", " if grain else ""
    cols = ", ".join(f"{e} AS {n}" for n, e in outputs.items())
    return (f"SELECT {keys}{cols} FROM ({by_metric(grain)}) AS metrics "
            + (f"GROUP BY {grain} " if grain else "") + f"HAVING {number('scheduled')} >= {least}")


def named(sql: str) -> str:
    """A mart with the carrier's name, its code where no name is known."""
    return ("SELECT m.*, ifnull((SELECT max(name) FROM names WHERE code = m.carrier), m.carrier) AS carrier_name "
            f"FROM ({sql}) AS m")


def p90(v: str) -> str:
    """Value at nine tenths of the way from the first to the last of a sorted list."""
    at = f"(0.9 * (len({v}) - 1))"
    low, high = f"{v}[floor({at})::INT + 1]", f"{v}[ceil({at})::INT + 1]"
    return f"{low} + ({high} - {low}) * ({at} - floor({at}))"


@query("km1_kpi_overview",
       "first_date:s last_date:s scheduled_flights:l completed_flights:l carriers:l "
       "origin_airports:l routes:l on_time_pct:r2 avg_arr_delay_min:r2 avg_delay_when_late_min:r2 "
       "cancellation_rate_pct:r3 diversion_rate_pct:r3",
       mart("", {"first_date": day("lo"), "last_date": day("hi"), "scheduled_flights": number("scheduled"),
                 "completed_flights": number("arrived"), "carriers": members("by "),
                 "origin_airports": members("from "), "routes": members("over "), "on_time_pct": ON_TIME,
                 "avg_arr_delay_min": mean("arrival_min"), "avg_delay_when_late_min": mean("late_min"),
                 "cancellation_rate_pct": mean("dropped", 100),
                 "diversion_rate_pct": mean("rerouted", 100)}))
def _(t):
    return M.kpi_overview(t.legs)


@query("km2_kpi_carrier_month",
       "year_month:s carrier:s carrier_name:s scheduled_flights:l completed_flights:l "
       "on_time_pct:r2 avg_arr_delay_min:r2 cancellation_rate_pct:r3 diversion_rate_pct:r3 "
       + " ".join(f"{c}_delay_min:r4" for c in C5),
       named(mart("year_month, carrier", {
           "scheduled_flights": number("scheduled"), "completed_flights": number("arrived"),
           "on_time_pct": ON_TIME, "avg_arr_delay_min": mean("arrival_min"),
           "cancellation_rate_pct": mean("dropped", 100), "diversion_rate_pct": mean("rerouted", 100),
           **{f"{c}_delay_min": cause_total(c) for c in C5}})))
def _(t):
    return M.kpi_carrier_month(t.legs, t.carriers)


@query("km3_kpi_airport_month",
       "year_month:s airport_code:s airport_name:s state:s scheduled_departures:l "
       "on_time_arrival_pct:r2 dep_delay_rate_pct:r2 avg_dep_delay_min:r2 avg_taxi_out_min:r2 "
       "cancellation_rate_pct:r3",
       "SELECT m.*, airport_code, airport_name, state FROM airports JOIN (" + mart("year_month, origin", {
           "scheduled_departures": number("scheduled"), "on_time_arrival_pct": ON_TIME,
           "dep_delay_rate_pct": mean("left_late", 100), "avg_dep_delay_min": mean("departure_min"),
           "avg_taxi_out_min": mean("taxi"), "cancellation_rate_pct": mean("dropped", 100)})
       + ") AS m ON airport_code = m.origin")
def _(t):
    return M.kpi_airport_month(t.legs, t.airports)


ROUTE_SPEC = ("route:s origin:s dest:s distance_mi:d scheduled_flights:l carriers:l on_time_pct:r2 "
              "avg_arr_delay_min:r2 p90_arr_delay_min:r1 cancellation_rate_pct:r3")
ROUTE_SQL = mart("route, origin, dest", {
    "distance_mi": "max(lo) FILTER (metric = 'miles')", "scheduled_flights": number("scheduled"),
    "carriers": members("by "), "on_time_pct": ON_TIME, "avg_arr_delay_min": mean("arrival_min"),
    "p90_arr_delay_min": p90("any_value(v) FILTER (metric = 'arrival_min')"),
    "cancellation_rate_pct": mean("dropped", 100)}, least=80)


@query("km4_kpi_route", ROUTE_SPEC, ROUTE_SQL)
def _(t):
    return M.kpi_route(t.legs, min_flights=80)


@query("km5_kpi_hour_dow",
       "dep_hour:i day_of_week:i scheduled_flights:l arr_delay_rate_pct:r2 avg_arr_delay_min:r2 "
       "cancellation_rate_pct:r3",
       mart("dep_hour, day_of_week", {
           "scheduled_flights": number("scheduled"), "arr_delay_rate_pct": mean("late", 100),
           "avg_arr_delay_min": mean("arrival_min"), "cancellation_rate_pct": mean("dropped", 100)}))
def _(t):
    return M.kpi_hour_dow(t.legs)


@query("km6_delay_causes_month",
       "year_month:s carrier:s " + " ".join(f"{c}_min:r4" for c in C5)
       + " delayed_flights:l total_cause_min:r4 " + " ".join(f"{c}_share_pct:r2" for c in C5),
       mart("year_month, carrier", {
           **{f"{c}_min": cause_total(c) for c in C5}, "delayed_flights": f"coalesce({total('late')}, 0)",
           "total_cause_min": ALL_CAUSES,
           **{f"{c}_share_pct": f"100 * {cause_total(c)} / nullif({ALL_CAUSES}, 0)" for c in C5}}))
def _(t):
    return M.delay_causes_month(t.legs)


@query("km7_cancellation_reasons_month", "year_month:s cancellation_reason:s cancelled_flights:l",
       "SELECT year_month, nullif(substr(metric, 5), '') AS cancellation_reason, n AS cancelled_flights FROM ("
       + by_metric("year_month") + ") AS metrics WHERE starts_with(metric, 'for ')")
def _(t):
    return M.cancellation_reasons_month(t.legs)


@query("km8_daily_network",
       "flight_date:s scheduled_flights:l arr_delay_rate:r5 cancellation_rate:r5 "
       "avg_arr_delay_min:r3 weather_delay_min:r4 nas_delay_min:r4 carrier_delay_min:r4 "
       "late_aircraft_delay_min:r4",
       mart("flight_date", {
           "scheduled_flights": number("scheduled"), "arr_delay_rate": mean("late"),
           "cancellation_rate": mean("dropped"), "avg_arr_delay_min": mean("arrival_min"),
           **{f"{c}_delay_min": cause_total(c) for c in C5 if c != "security"}}))
def _(t):
    return M.daily_network(t.legs)


DAILY_AIRPORT_SPEC = ("flight_date:s airport_code:s scheduled_departures:l arr_delay_rate:r5 "
                      "dep_delay_rate:r5 cancellation_rate:r5 avg_dep_delay_min:r3 "
                      "avg_taxi_out_min:r3 weather_share:r5")


@query("km9_daily_airport", DAILY_AIRPORT_SPEC,
       "SELECT *, origin AS airport_code FROM (" + mart("flight_date, origin", {
           "scheduled_departures": number("scheduled"), "arr_delay_rate": mean("late"),
           "dep_delay_rate": mean("left_late"), "cancellation_rate": mean("dropped"),
           "avg_dep_delay_min": mean("departure_min"), "avg_taxi_out_min": mean("taxi"),
           "weather_share": f"{cause_total('weather')} / nullif({total('causes')}, 0)"}) + ") AS m")
def _(t):
    return M.daily_airport(t.legs)


PROFILE_SPEC = ("airport_code:s scheduled_departures:l destinations:l carriers:l arr_delay_rate:r6 "
                "dep_delay_rate:r6 cancellation_rate:r6 avg_dep_delay_min:r6 avg_taxi_out_min:r6 "
                "avg_distance_mi:r6 evening_share:r6 weather_cause_share:r6 nas_cause_share:r6 "
                "late_aircraft_cause_share:r6 dep_delay_std_min:r6")


@query("km10_airport_profile", PROFILE_SPEC,
       "SELECT *, origin AS airport_code FROM (" + mart("origin", {
           "scheduled_departures": number("scheduled"), "destinations": members("to "),
           "carriers": members("by "), "arr_delay_rate": mean("late"), "dep_delay_rate": mean("left_late"),
           "cancellation_rate": mean("dropped"), "avg_dep_delay_min": mean("departure_min"),
           "avg_taxi_out_min": mean("taxi"), "avg_distance_mi": mean("miles"),
           "evening_share": mean("evening"),
           **{f"{c}_cause_share": f"{cause_total(c)} / nullif({total('causes')}, 0)"
              for c in ("weather", "nas", "late_aircraft")},
           "dep_delay_std_min": "max(CASE WHEN n > 1 THEN sqrt((sq - t * t / n) / (n - 1)) END) "
                                "FILTER (metric = 'departure_min')"}, least=2000) + ") AS m")
def _(t):
    return M.airport_profile(t.legs, min_departures=2000)


@query("km11_monthly_summary", "year_month:s flights:l otp:r6 canc:r6",
       mart("year_month", {"flights": number("scheduled"), "otp": ON_TIME, "canc": mean("dropped", 100)}))
def _(t):
    return M.monthly_summary(t.legs)


@query("km12_carrier_scorecard",
       "carrier_name:s flights:l otp:r1 avg_delay:r1 cancel_pct:r2 first_day:s last_day:s",
       named(mart("carrier", {
           "flights": number("scheduled"), "otp": ON_TIME, "avg_delay": mean("arrival_min"),
           "cancel_pct": mean("dropped", 100), "first_day": day("lo"), "last_day": day("hi")})))
def _(t):
    return M.carrier_scorecard(t.legs, t.carriers)


@query("km13_hourly_profile", "dep_hour:i n:l delay_rate:r6 cancel_rate:r6",
       mart("dep_hour", {"n": number("scheduled"), "delay_rate": mean("late", 100),
                         "cancel_rate": mean("dropped", 100)}, least=2001))
def _(t):
    return M.hourly_profile(t.legs, more_than=2000)


@query("km14_cause_mix", "cause:s minutes:r4 share_pct:r2",
       "SELECT substr(metric, 7) AS cause, t AS minutes, 100 * t / sum(t) OVER () AS share_pct FROM ("
       + by_metric("") + ") AS metrics WHERE starts_with(metric, 'cause ')")
def _(t):
    return M.cause_mix(t.legs)

"""Data-quality gate."""

from opsreliability.catalog.base import SITES, query, view
from opsreliability.operators import quality as Q
from opsreliability.operators.dims import carrier_dim

CHECK_SPEC = "name:s category:s observed:r6 threshold:s status:s"

_n = "(SELECT count(1) FROM legs WHERE {})"
_a = "(SELECT avg(CASE WHEN {} THEN 1 ELSE 0 END) FROM legs WHERE {})"
_causes = " + ".join(f"ifnull({c}_delay_min, 0)" for c in
                     ("carrier", "weather", "nas", "security", "late_aircraft"))
ROWS = [("row_count_positive", "completeness", "(SELECT count(1) FROM legs)", "> 0", "FAIL"),
        ("rows_retained_vs_raw", "completeness",
         "(SELECT count(1) FROM legs) / (SELECT count(1) FROM raw)", ">= 0.999", "FAIL"),
        ("duplicate_flight_id", "uniqueness",
         "(SELECT sum(k - 1) FROM (SELECT count(1) AS k FROM legs GROUP BY flight_id))", "== 0",
         "FAIL")]
ROWS += [(f"not_null_{c}", "completeness", _n.format(f"{c} IS NULL"), "== 0", "FAIL")
         for c in Q.NOT_NULL]
ROWS += [
    ("valid_scheduled_dep_time", "validity",
     _n.format("crs_dep_hhmm < 0 OR crs_dep_hhmm > 2400 OR crs_dep_hhmm % 100 > 59"), "== 0",
     "FAIL"),
    ("origin_differs_from_dest", "validity", _n.format("origin = dest"), "== 0", "FAIL"),
    ("binary_status_flags", "validity",
     _n.format("NOT (cancelled IN (0, 1) AND diverted IN (0, 1))"), "== 0", "FAIL"),
    ("cancelled_has_reason_code", "consistency",
     _n.format("cancellation_code IS NULL AND cancelled = 1"), "== 0", "FAIL"),
    ("reason_code_only_when_cancelled", "consistency",
     _n.format("cancellation_code IS NOT NULL AND cancelled = 0"), "== 0", "FAIL"),
    ("completed_has_arrival_delay", "completeness",
     _a.format("arr_delay_min IS NULL", "completed = 1"), "<= 0.001", "FAIL"),
    ("arr_del15_matches_delay_minutes", "consistency",
     _a.format("(arr_delay_min >= 15) <> (arr_del15 = 1)",
               "arr_delay_min IS NOT NULL AND completed = 1"), "<= 0.0005", "FAIL"),
    ("delay_causes_sum_to_arrival_delay", "consistency",
     _a.format(f"abs({_causes} - arr_delay_min) > 1", "arr_del15 = 1"), "<= 0.01", "WARN"),
    ("positive_distance_and_block_time", "validity",
     _n.format("least(distance_mi, crs_elapsed_min) <= 0"), "== 0", "FAIL"),
    ("taxi_out_plausible_0_240", "validity",
     _a.format("taxi_out_min < 0 OR taxi_out_min > 240", "taxi_out_min IS NOT NULL"), "<= 0.001",
     "WARN"),
    ("arrival_delay_over_24h_share", "validity", _a.format("arr_delay_min > 1440", "completed = 1"),
     "<= 0.0005", "WARN"),
    ("origin_in_airport_dim", "referential",
     "(SELECT count(1) FROM legs WHERE origin NOT IN (SELECT airport_code FROM airports))", "== 0",
     "FAIL"),
    ("airport_dim_has_coordinates", "enrichment",
     "(SELECT count(1) FROM airports WHERE latitude IS NULL)", "== 0", "WARN"),
    ("carrier_dim_named", "enrichment",
     "(SELECT count(1) FROM carriers WHERE carrier_name = carrier_code)", "== 0", "WARN"),
]


def _row(name, category, value, limit, bad):
    op, lim = limit.split()
    return (f"SELECT '{name}' AS name, '{category}' AS category, "
            f"coalesce(CAST({value} AS DOUBLE), 0) AS observed, '{limit}' AS threshold, "
            f"CASE WHEN coalesce(CAST({value} AS DOUBLE), 0) {op.replace('==', '=')} {lim} "
            f"THEN 'PASS' ELSE '{bad}' END AS status")


_span = "(SELECT max(flight_date) - min(flight_date) + 1 FROM legs)"
DAYS = (f"SELECT 'calendar_coverage_days', 'completeness', CAST(d AS DOUBLE), concat('== ', s), "
        f"CASE WHEN d = s THEN 'PASS' ELSE 'FAIL' END FROM (SELECT count(DISTINCT flight_date) AS d, "
        f"{_span} AS s FROM legs)")
view("gate_rows", "\n  UNION ALL ".join([_row(*r) for r in ROWS] + [DAYS]))


def all_checks(t):
    legs = t.columns(*dict.fromkeys((*Q.COLUMNS, *SITES)))
    return Q.run_checks(legs, t.airports, carrier_dim(legs, t.names), t.raw, expect_all_days=True)


@query("dq1_to_dq26_checks", CHECK_SPEC, "SELECT * FROM gate_rows")
def _(t):
    return all_checks(t)


@query("dq27_gate_summary", "passed:l warned:l failed:l gate:s",
       """SELECT sum(CASE status WHEN 'PASS' THEN 1 ELSE 0 END) AS passed,
       sum(CASE status WHEN 'WARN' THEN 1 ELSE 0 END) AS warned,
       sum(CASE status WHEN 'FAIL' THEN 1 ELSE 0 END) AS failed,
       CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' ELSE 'PASS' END AS gate FROM gate_rows""")
def _(t):
    return Q.summary(all_checks(t))


@query("dq28_checks_of_legs_only", CHECK_SPEC,
       """SELECT * FROM gate_rows WHERE name NOT IN ('rows_retained_vs_raw',
       'calendar_coverage_days', 'origin_in_airport_dim', 'airport_dim_has_coordinates',
       'carrier_dim_named')""")
def _(t):
    return Q.run_checks(t.columns(*Q.COLUMNS))

import pytest
from pyspark.sql import functions as F

from opsreliability.operators import marts as M
from opsreliability.operators import quality as Q
from opsreliability.operators.dims import airport_dim, carrier_dim
from opsreliability.operators.staging import quarantine, stage_legs


def test_rows_are_conserved(raw):
    staged, bad = stage_legs(raw), quarantine(raw, all_reasons=True)
    assert staged.count() + bad.count() == raw.count() == 11
    reasons = {r[0]: r[1] for r in bad.groupBy("quarantine_reason").count().collect()}
    assert reasons == {"non_positive_or_missing_crs_elapsed": 3, "missing_Origin": 1}
    assert quarantine(raw).count() == 3


def test_derived_columns(raw):
    rows = {r.flight_number: r for r in stage_legs(raw).collect()}
    assert (rows["100"].crs_dep_min_of_day, rows["100"].dep_hour) == (17 * 60 + 30, 17)
    assert (rows["101"].crs_dep_min_of_day, rows["101"].dep_hour) == (1439, 23)
    assert str(rows["100"].sched_dep_ts) == "2026-01-05 17:30:00"
    assert (rows["7"].carrier, rows["7"].route) == ("DL", "ATL-LGA")
    assert rows["102"].tail_number is None
    assert rows["103"].arr_del15 is None and rows["103"].cancellation_reason == "Weather"
    assert rows["104"].completed == 0 and rows["104"].arr_del15 is None
    assert rows["105"].crs_dep_hhmm is None and rows["105"].dep_hour == 23
    assert rows["100"].day_of_week == 1 and rows["100"].year_month == "2026-01"


@pytest.fixture(scope="module")
def clean(raw):
    return stage_legs(raw.where("CRSDepTime <> '12a4'"))


def dims(spark, legs):
    registry = spark.createDataFrame(
        [("KORD", "ORD", "O'Hare", "41.9", "-87.9", "672", "large_airport", "yes"),
         ("KORD2", "ORD", "Old field", "1", "1", "1", "small_airport", "no"),
         ("KLGA", "", "LaGuardia", "40.7", "-73.8", "21", "large_airport", "yes")],
        "ident string, iata_code string, name string, latitude_deg string, longitude_deg string, "
        "elevation_ft string, type string, scheduled_service string")
    names = spark.createDataFrame([("AA", "American")], "code string, name string")
    return airport_dim(legs, registry), carrier_dim(legs, names)


def test_dimensions(spark, clean):
    airports, carriers = dims(spark, clean)
    a = {r.airport_code: r for r in airports.collect()}
    assert a["ORD"].airport_name == "O'Hare" and a["ORD"].latitude == 41.9
    assert a["LGA"].airport_name == "LaGuardia"          # known by its ident only
    assert a["ATL"].airport_type == "unknown" and not a["ATL"].has_ourairports_match
    assert {r.carrier_code: r.carrier_name for r in carriers.collect()} == {"AA": "American", "DL": "DL"}


def status(checks):
    return {r["name"]: r.status for r in checks.collect()}


def test_gate_passes_clean_legs_and_stops_bad_ones(spark, clean):
    airports, carriers = dims(spark, clean)
    s = status(Q.run_checks(clean, airports, carriers, expect_all_days=True))
    assert not [n for n, v in s.items() if v == "FAIL"]
    assert s["carrier_dim_named"] == "WARN" and len(s) == 25
    assert Q.gate(Q.run_checks(clean))["gate"] == "PASS"

    bad = clean.unionByName(clean.limit(2)).withColumn("crs_dep_hhmm", F.lit(2575))
    s = status(Q.run_checks(bad))
    assert s["duplicate_flight_id"] == "FAIL" and s["valid_scheduled_dep_time"] == "FAIL"
    assert "rows_retained_vs_raw" not in s and "origin_in_airport_dim" not in s
    with pytest.raises(Q.GateFailed):
        Q.gate(Q.run_checks(bad))


def test_marts_agree_with_each_other(spark, clean):
    _, carriers = dims(spark, clean)
    o = M.kpi_overview(clean).first()
    assert o.scheduled_flights == M.kpi_carrier_month(clean, carriers).agg(
        F.sum("scheduled_flights")).first()[0]
    assert o.scheduled_flights == M.daily_network(clean).agg(F.sum("scheduled_flights")).first()[0]
    assert 0 <= o.on_time_pct <= 100

from opsreliability.operators.quality import GateFailed
from opsreliability.plans import driver_view as V
from opsreliability.plans.job import run

import pytest

FOLDER = "/root/testdata/sf0.001"


def test_job_writes_every_table_and_stops_at_the_gate(spark, tmp_path):
    raw = V.raw_legs(spark, FOLDER)
    args = (raw, V.registry(spark, FOLDER), V.carrier_names(spark, FOLDER), str(tmp_path / "out"),
            "1999-12-31", "2000-09-30")
    with pytest.raises(GateFailed):                      # legs with equal ends and times like 12a4
        run(*args, row_key="leg_key")
    r = run(*args, calendar_span=("1994-12-01", "2001-12-31"), row_key="leg_key", stop_on_fail=False)
    assert r.gate["gate"] == "FAIL"
    assert r.features.count() == r.staged.count()
    over = spark.read.parquet(r.written["kpi_overview"]).first()
    assert over.scheduled_flights == spark.read.parquet(r.written["daily_network"]).agg(
        {"scheduled_flights": "sum"}).first()[0] == r.staged.count()

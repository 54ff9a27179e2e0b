import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import write_raw
from opsreliability.session import cut_lineage
from opsreliability.sources import readers as R
from opsreliability.sources import sinks as K
from opsreliability.sources.schemas import RAW_COLUMNS


def test_csv_scan_ignores_the_unnamed_column(raw):
    assert raw.columns == list(RAW_COLUMNS)
    assert dict(raw.dtypes)["FlightDate"] == "date" and dict(raw.dtypes)["CRSDepTime"] == "string"


def test_first_available_and_missing(spark, tmp_path):
    p = str(tmp_path / "x.csv")
    K.write_csv(spark.createDataFrame([(1, "a")], "i int, s string"), p)
    d = R.scan_first_available(spark, [str(tmp_path / "no.parquet"), p], {"i": "bigint"})
    assert d.first().i == 1 and dict(d.dtypes)["i"] == "bigint"
    with pytest.raises(FileNotFoundError):
        R.scan_first_available(spark, [str(tmp_path / "no")], {"i": "int"})


def test_months_are_ingested_once(spark, tmp_path):
    for m in (1, 2):
        write_raw(tmp_path / f"in_2026_{m}", [{}, {}][:m])
    src, dst = str(tmp_path / "in_{year}_{month}"), str(tmp_path / "out")
    R.ingest_months(spark, [(2026, 1)], src, dst, RAW_COLUMNS)
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "out/year=2026/month=1").iterdir()}
    got = R.ingest_months(spark, [(2026, 1), (2026, 2)], src, dst, RAW_COLUMNS)
    assert {r.month: r.row_count for r in got.collect()} == {1: 1, 2: 2}
    after = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "out/year=2026/month=1").iterdir()}
    assert before == after
    with pytest.raises(FileNotFoundError):
        R.ingest_months(spark, [(2026, 3)], src, dst, RAW_COLUMNS)


def test_manifest_hashes_files(spark, tmp_path):
    d = K.write_parquet(spark.range(7).repartition(1), str(tmp_path / "t"))
    row = R.manifest(spark, R.file_digests(spark, d + "/*.parquet", chunk=100), spark.read.parquet(d)).first()
    f = next((tmp_path / "t").glob("*.parquet"))
    assert row.sha256 == hashlib.sha256(f.read_bytes()).hexdigest()
    assert row.row_count == 7 and row.bytes == f.stat().st_size


def test_registry_replaces_the_entry_of_a_model(spark, tmp_path):
    p = str(tmp_path / "registry")
    entry = lambda m, v, t: spark.createDataFrame([(m, v, t)], "model string, version string, trained_at string")
    K.register_model(spark, p, entry("delay", "v1", "2026-01-01"))
    K.register_model(spark, p, entry("cancel", "v1", "2026-01-02"))
    K.register_model(spark, p, entry("delay", "v2", "2026-01-03"))
    assert {r.model: r.version for r in spark.read.json(p).collect()} == {"delay": "v2", "cancel": "v1"}


def test_tables_and_lineage(spark):
    t = K.save_table(spark.range(3), "reliability_tests.small")
    K.save_table(spark.range(5), "reliability_tests.small")
    assert spark.table("reliability_tests.small").count() == 5 and t.columns == ["id"]
    K.drop_table(spark, "reliability_tests.small")
    assert not spark.catalog.tableExists("reliability_tests.small")
    d = cut_lineage(spark.range(10).withColumn("r", F.rand()))
    assert d.collect() == d.collect()


def test_manifest_query_returns_sizes_and_digests(spark):
    from opsreliability.catalog import load
    folder = "/root/testdata/sf0.001"
    got = load()[0]["src7_manifest_digests"](spark, folder).collect()
    assert len(got) == 14
    for row in got:
        with open(f"{folder}/{row.file}", "rb") as f:
            data = f.read()
        assert (row.bytes, row.sha256) == (len(data), hashlib.sha256(data).hexdigest()) and row.row_count > 0

"""Scans and the ingest manifest."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGEST_CHUNK = 1 << 20      # bytes of a file held at a time


def scan_csv(spark: SparkSession, path: str | Sequence[str],
             types: Mapping[str, str]) -> DataFrame:
    """CSV with header, read as text and cast; columns that are not asked for are ignored
    (a trailing comma makes one without a name)."""
    text = spark.read.csv(path, header=True, inferSchema=False, escape='"')
    return text.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


def scan_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Parquet files by glob; filters and columns are pushed into the scan."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def scan_lookup(spark: SparkSession, path: str, rename: Mapping[str, str]) -> DataFrame:
    """Reference CSV, all text, with renamed columns."""
    text = spark.read.csv(path, header=True, escape='"')
    return text.select(*[F.col(a).alias(b) for a, b in rename.items()])


def scan_csv_auto(spark: SparkSession, path: str) -> DataFrame:
    """CSV with inferred types: an extra pass over the file, for small exports only."""
    return spark.read.csv(path, header=True, inferSchema=True, escape='"')


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    matches = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return matches is not None and len(matches) > 0


def scan_first_available(spark: SparkSession, paths: Sequence[str],
                         types: Mapping[str, str]) -> DataFrame:
    """The first path that exists, as Parquet or CSV by its suffix, cast to the same types."""
    for p in paths:
        if exists(spark, p):
            if p.rstrip("/").endswith(".csv"):
                return scan_csv(spark, p, types)
            return spark.read.parquet(p).select(*[F.col(c).cast(t) for c, t in types.items()])
    raise FileNotFoundError(f"none of {list(paths)} exists")


def register(df: DataFrame, name: str) -> DataFrame:
    """Make a frame known to SQL under a name."""
    df.createOrReplaceTempView(name)
    return df


def file_digests(spark: SparkSession, path: str, chunk: int = DIGEST_CHUNK) -> DataFrame:
    """Per file: name, bytes and SHA-256.

    Spark lists the files and deals them out; a task streams each in chunks, whatever its size.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")

    def digest(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            sums = []
            for uri in b["path"]:
                where, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
                total = hashlib.sha256()
                with where.open_input_stream(name) as f:
                    while data := f.read(chunk):
                        total.update(data)
                sums.append(total.hexdigest())
            yield pd.DataFrame({"file": b["path"].str.rsplit("/", n=1).str[-1], "bytes": b["length"],
                                "sha256": sums})

    return files.repartition("path").mapInPandas(digest, "file string, bytes long, sha256 string")


def manifest(spark: SparkSession, digests: DataFrame, data: DataFrame) -> DataFrame:
    """File rows with their row counts; ``data`` is a scan of the same files."""
    rows = data.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count("*").alias("row_count"))
    return digests.join(rows, "file", "left").withColumn(
        "row_count", F.coalesce("row_count", F.lit(0).cast("bigint")))


def month_done(spark: SparkSession, target: str, year: int, month: int) -> bool:
    return exists(spark, f"{target}/year={year}/month={month}")


def ingest_months(spark: SparkSession, months: Iterable[tuple[int, int]], source: str,
                  target: str, types: Mapping[str, str]) -> DataFrame:
    """Ingest months that are not in ``target`` yet; returns rows per wanted month.

    ``source`` is a path with {year} and {month}.  Every missing input is found before anything
    is written.  All new months go through one job and only their partitions are written.
    """
    months = list(months)
    new = [m for m in months if not month_done(spark, target, *m)]
    paths = {m: source.format(year=m[0], month=m[1]) for m in new}
    lost = [p for p in paths.values() if not exists(spark, p)]
    if lost:
        raise FileNotFoundError(f"missing input: {lost}")
    frames = [scan_csv(spark, p, types).withColumn("year", F.lit(y)).withColumn("month", F.lit(m))
              for (y, m), p in paths.items()]
    if frames:
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.unionByName(f)
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("compression", "zstd").partitionBy("year", "month").parquet(target))
    wanted = spark.createDataFrame(months, "year int, month int")
    have = spark.read.parquet(target).groupBy("year", "month").agg(F.count("*").alias("row_count"))
    return wanted.join(have, ["year", "month"], "left")

"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsreliability.session import cut_lineage
from opsreliability.sources.readers import exists


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, order: Sequence[Column | str] = (),
              single_file: bool = False) -> str:
    """CSV with header.  ``single_file`` is for report-sized frames only; otherwise an ordered
    frame is written as range-partitioned parts whose names follow the order."""
    out = df.orderBy(*order) if order else df
    if single_file:
        out = out.coalesce(1) if not order else df.repartition(1).sortWithinPartitions(*order)
    out.write.mode("overwrite").csv(path, header=True, escape='"')
    return path


def save_table(df: DataFrame, table: str) -> DataFrame:
    """Create or replace ``layer.table``."""
    spark = df.sparkSession
    if "." in table:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {table.split('.')[0]}")
    df.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(table)
    return spark.table(table)


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def write_json(df: DataFrame, path: str) -> str:
    """JSON lines of a small result."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def vocabularies(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the sorted distinct values of each column, in one pass."""
    return df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in cols])


def register_model(spark: SparkSession, path: str, entries: DataFrame) -> DataFrame:
    """Upsert registry rows (model, version, trained_at, path, metrics): the newest per model.

    The registry holds one row per model.  It is read and cut from its files before they are
    replaced.
    """
    both = entries
    if exists(spark, path):
        both = spark.read.schema(entries.schema).json(path).withColumn("_new", F.lit(0)).unionByName(
            entries.withColumn("_new", F.lit(1)))
    else:
        both = entries.withColumn("_new", F.lit(1))
    rest = [c for c in entries.columns if c != "model"]
    latest = (both.groupBy("model").agg(
        F.max_by(F.struct(*rest), F.struct("_new", "trained_at")).alias("_r"))
        .select("model", "_r.*"))
    latest = cut_lineage(latest)
    write_json(latest, path)
    return latest

"""Top-k and sampling."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def top_groups(df: DataFrame, group: str, weight: str, k: int) -> DataFrame:
    """The k groups with the largest sum of ``weight``, ties by group name."""
    return (df.groupBy(group).agg(F.sum(weight).alias("_w"))
            .orderBy(F.col("_w").desc_nulls_last(), F.col(group).asc_nulls_last())
            .limit(k).select(group))


def keep_top_groups(df: DataFrame, group: str, weight: str, k: int) -> DataFrame:
    """Rows of the k largest groups (semi join; the k keys are bounded by k)."""
    return df.join(F.broadcast(top_groups(df, group, weight, k)), group, "left_semi")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of an order that must be total; planned as TakeOrderedAndProject."""
    return df.orderBy(*order).limit(k)


def fixed_sample(df: DataFrame, key: str, n: int | Column, seed: int = 42) -> DataFrame:
    """Exactly n rows (all when there are fewer), repeatable, uniform over distinct keys.

    The rows with the n smallest md5(seed | key) are taken.  Instead of sorting, a histogram of
    the first five hex digits (at most 1,048,576 rows, whatever the input) tells which hash
    buckets are in entirely; only the one bucket at the boundary is ordered.
    """
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))
    d = df.withColumn("_h", h).withColumn("_p", F.substring("_h", 1, 5))
    counts = d.groupBy("_p").agg(F.count("*").alias("_n"))
    cum = counts.withColumn("_c", F.sum("_n").over(
        W.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)))
    n = n if isinstance(n, Column) else F.lit(n)
    edge = (cum.where(F.col("_c") >= n)
            .agg(F.min_by(F.struct("_p", (n - F.col("_c") + F.col("_n")).alias("_left")),
                          "_p").alias("_e")))
    d = d.withColumn("_e", edge.scalar())
    inside = d.where(F.col("_e").isNull() | (F.col("_p") < F.col("_e._p")))
    at_edge = d.where(F.col("_p") == F.col("_e._p")).withColumn(
        "_rn", F.row_number().over(W.partitionBy("_p").orderBy("_h", key)))
    return (inside.unionByName(at_edge.where(F.col("_rn") <= F.col("_e._left")).drop("_rn"))
            .drop("_h", "_p", "_e"))


def row_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows (all when there are fewer), other ones on every call."""
    return fixed_sample(df, key, n, seed=random.randrange(1 << 31))

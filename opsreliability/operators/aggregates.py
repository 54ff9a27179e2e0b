"""Aggregation shapes used by the marts, the reports and the exploratory checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsreliability.functions.scalar import safe_div
from opsreliability.operators.sampling import fixed_sample


def dup_count(df: DataFrame, key: str, name: str = "duplicates") -> DataFrame:
    """Rows minus distinct keys, through counted keys rather than a distinct over rows."""
    k = df.groupBy(key).agg(F.count("*").alias("_n"))
    return k.agg((F.sum("_n") - F.count(key)).alias(name))


def shares(df: DataFrame, parts: Sequence[str], suffix: str = "_share") -> DataFrame:
    """Add part / sum of parts per row, NULL when the sum is zero."""
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return df.select("*", *[safe_div(p, total).alias(p + suffix) for p in parts])


def reweight(df: DataFrame, by: Sequence[str], rates: dict[str, str],
             sums: Sequence[str] = ()) -> DataFrame:
    """Roll a mart up one level: rate -> sum(rate * weight) / sum(weight)."""
    return df.groupBy(*by).agg(
        *[safe_div(F.sum(F.col(r) * F.col(w)), F.sum(w)).alias(r) for r, w in rates.items()],
        *[F.sum(s).alias(s) for s in sums])


def pivot(df: DataFrame, row: Sequence[str], col: str, values: Sequence, agg: Column,
          fill=None) -> DataFrame:
    """Matrix with the listed column values; listing them saves a pass over the data."""
    out = df.groupBy(*row).pivot(col, list(values)).agg(agg)
    return out.fillna(fill) if fill is not None else out


def describe(df: DataFrame, col: str, pcts: Sequence[float], sample: int | None = None,
             key: str | None = None, seed: int = 42) -> DataFrame:
    """Count, mean, standard deviation, extremes and percentiles, on a fixed sample if asked."""
    d = fixed_sample(df, key, sample, seed) if sample else df
    return d.agg(F.count(col).alias("count"), F.avg(col).alias("mean"),
                 F.stddev_samp(col).alias("std"), F.min(col).alias("min"),
                 F.max(col).alias("max"),
                 *[F.percentile(col, p).alias(f"p{round(p * 100)}") for p in pcts])


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts in equal bins of the value clipped to [lo, hi]; the last bin includes hi."""
    x = F.greatest(F.least(F.col(col), F.lit(hi)), F.lit(lo))
    width = (hi - lo) / bins
    b = F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int")
    return (df.where(F.col(col).isNotNull()).groupBy(b.alias("bin"))
            .agg(F.count("*").alias("n"))
            .select("bin", (F.col("bin") * width + lo).alias("bin_start"), "n"))


def bin_response(df: DataFrame, x: str, y: str, width: float, last: int) -> DataFrame:
    """Mean of x and y per bin of x; everything from bin ``last`` on is one bin."""
    b = F.least(F.floor(F.col(x) / width), F.lit(last)).cast("int")
    return df.groupBy(b.alias("b")).agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
                                        F.count("*").alias("n"))


def drift(df: DataFrame, cols: Sequence[str], split: str = "split") -> DataFrame:
    """One row per column: mean per split and percent change test against train."""
    names = ("train", "valid", "test")
    one = df.agg(*[F.avg(F.when(F.col(split) == s, F.col(c))).alias(f"{c}|{s}")
                   for c in cols for s in names])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"),
                              *[F.col(f"`{c}|{s}`").alias(s) for s in names]) for c in cols])
    return (one.select(F.inline(rows))
            .withColumn("test_vs_train_pct", (safe_div("test", "train") - 1) * 100))

"""Window-like operators, built so that a hot group does not become one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from opsreliability.operators.joins import attach_stats
from opsreliability.operators.prefix import grouped_quantiles, rank_values, sequence_in_group


def _not_null(key: str, kind: str) -> Column:
    """The key in a form without NULL, equal where the keys are: days and integers stay numbers, the rest is text."""
    if kind == "date":
        return F.coalesce(F.unix_date(key).cast("bigint"), F.lit(-1 << 63))
    if kind in ("tinyint", "smallint", "int"):
        return F.coalesce(F.col(key).cast("bigint"), F.lit(-1 << 63))
    return F.coalesce(F.col(key).cast("string"), F.lit("\u0000"))


def peer_counts(df: DataFrame, specs: Mapping[str, Sequence[str]], row_key: str,
                source: DataFrame | None = None, packed: Mapping[str, str] | None = None) -> DataFrame:
    """Rows that share the keys with this row, for several key sets: {output name: keys}.

    Counted by aggregates over ``source`` (the rows of ``df`` before other features were attached;
    ``df`` itself by default), combined map-side, and joined back; a window would send
    each group whole to one task.  NULL keys form a group of their own, as in a window.

    ``packed`` names for an output the key that has few values, such as the hour: its counts travel as one
    map for each value of the other keys, a small table where the full one would be too large to broadcast.
    """
    d, types = df, dict(df.dtypes)
    for i, (name, keys) in enumerate(specs.items()):
        safe = {f"_k{i}{j}": _not_null(k, types[k]) for j, k in enumerate(keys)}
        slim = (df if source is None else source).select(*[c.alias(n) for n, c in safe.items()])
        counts = slim.groupBy(*safe).agg(F.count("*").alias(name))
        few = (packed or {}).get(name)
        if few is None:
            d = attach_stats(d.withColumns(safe), counts, list(safe), row_key, slim).drop(*safe)
            continue
        inner = f"_k{i}{list(keys).index(few)}"
        rest = [k for k in safe if k != inner]
        maps = counts.groupBy(*rest).agg(F.map_from_entries(F.collect_list(F.struct(inner, name))).alias("_by"))
        d = attach_stats(d.withColumns(safe), maps, rest, row_key, slim.select(*rest))
        d = d.withColumn(name, F.element_at("_by", F.col(inner))).drop(*safe, "_by")
    return d


def seq_no(df: DataFrame, keys: Sequence[str], order: str, row_key: str, name: str) -> DataFrame:
    return sequence_in_group(df, keys, order, row_key, seq=name)


def gap_to_prev(df: DataFrame, keys: Sequence[str], order: str, row_key: str, start: str,
                end: str, name: str) -> DataFrame:
    """start - previous row's end inside the group; negative gaps are NULL."""
    d = sequence_in_group(df, keys, order, row_key, lagged=(end, "_e"))
    gap = F.col(start) - F.col("_e")
    return d.withColumn(name, F.when(gap >= 0, gap)).drop("_e")


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in a total order, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
            .select(*keys, "_r.*"))


def group_median(df: DataFrame, keys: Sequence[str], cols: dict[str, str]) -> DataFrame:
    """Exact medians per group: {column: output name}."""
    return grouped_quantiles(df, keys, {n: (c, 0.5) for c, n in cols.items()})


def vs_own_median(df: DataFrame, key: str, ratio: Sequence[str], difference: Sequence[str],
                  row_key: str) -> DataFrame:
    """Add c_ratio = c / group median and c_diff = c - group median."""
    cols = {c: f"_m_{c}" for c in (*ratio, *difference)}
    d = attach_stats(df, group_median(df, [key], cols), [key], row_key, df.select(key))
    for c in ratio:
        d = d.withColumn(f"{c}_ratio", F.col(c) / F.nullif(F.col(f"_m_{c}"), F.lit(0.0)))
    for c in difference:
        d = d.withColumn(f"{c}_diff", F.col(c) - F.col(f"_m_{c}"))
    return d.drop(*cols.values())


def shift(df: DataFrame, key: Sequence[str], day: str, value: str, k: int, name: str) -> DataFrame:
    """Value k days earlier, by an equi join on the shifted day: gaps give NULL by themselves,
    so no dense grid is needed."""
    past = df.select(*key, F.date_add(day, k).alias(day), F.col(value).alias(name))
    return df.join(past, [*key, day], "left")


def rolling(df: DataFrame, key: Sequence[str], day: str, value: str, n: int, lag: int,
            f: Callable[[Column], Column], name: str) -> DataFrame:
    """f over n days that end ``lag`` days ago, NULL unless all n values are present.

    ``df`` must be a dense daily grid; a group is one series, bounded by the calendar.
    """
    w = W.partitionBy(*key).orderBy(day).rowsBetween(-(n + lag - 1), -lag)
    return df.withColumn(name, F.when(F.count(value).over(w) == n, f(F.col(value)).over(w)))


def rank_desc(df: DataFrame, value: str, name: str, within: Sequence[str] = ()) -> DataFrame:
    """Rank by value, largest first, ties equal."""
    if within:
        w = W.partitionBy(*within).orderBy(F.col(value).desc_nulls_last())
        return df.withColumn(name, F.rank().over(w))
    return rank_values(df, value, descending=True, name=name)


def null_safe_left(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on equal keys where NULL equals NULL: no group is lost for a missing key."""
    right = other.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                         *[c for c in other.columns if c not in keys])
    on = [df[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    return df.join(right, on, "left").drop(*[f"_r_{k}" for k in keys])


def prev_period(df: DataFrame, month: str, cols: Sequence[str], keys: Sequence[str] = (),
                suffix: str = "_pm") -> DataFrame:
    """Values of the month before; ``month`` is a first-of-month date."""
    past = df.select(*keys, F.add_months(month, 1).alias(month),
                     *[F.col(c).alias(c + suffix) for c in cols])
    return null_safe_left(df, past, [*keys, month])


def vs_total(df: DataFrame, value: str, total: DataFrame, name: str, scale: float = 1.0) -> DataFrame:
    """Difference to a one-row total."""
    return df.withColumn(name, (F.col(value) - total.scalar()) * scale)

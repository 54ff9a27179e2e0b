"""Order-dependent work without a global sort in one task.

Spark evaluates a window without PARTITION BY in a single task, and a window whose group is hot
in one task per group.  The operators below split the order into ranges first, work inside the
ranges in parallel, and add what the earlier ranges contribute.  The per-range totals are tiny
(one row per range), so they may be broadcast and windowed in one task.  Tables with a row per
hot key are written first, so that the planner sees their size and chooses their join by it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from opsreliability.session import materialise

RANGES = 64
#: Rows of one group that one task may sort; larger groups are split.
HOT_ROWS = 1_000_000


def _range_count(df: DataFrame) -> int:
    return max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def range_bounds(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """One row with the inner bounds of about equally filled ranges of ``order``: as many as the
    session has shuffle partitions, ``RANGES`` at least."""
    ranges = ranges or _range_count(df)
    probs = [i / ranges for i in range(1, ranges)]
    return df.agg(F.percentile_approx(order, probs, 10000).alias("_bounds"))


def with_range(df: DataFrame, order: str, bounds: DataFrame, name: str = "_range") -> DataFrame:
    """Index of the range of ``order``; equal values always share a range."""
    return (df.withColumn("_b", bounds.scalar())
            .withColumn(name, F.size(F.filter("_b", lambda b: b < F.col(order))))
            .drop("_b"))


def running_sum(df: DataFrame, order: str, cols: Sequence[str], descending: bool = False,
                prefix: str = "cum_") -> DataFrame:
    """Running totals of ``cols`` over the whole frame in the order of ``order``.

    ``order`` must be unique and not NULL: compact equal values with a groupBy before.
    """
    d = with_range(df, order, range_bounds(df, order))
    totals = d.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    rng = F.col("_range").desc() if descending else F.col("_range").asc()
    before = W.orderBy(rng).rowsBetween(W.unboundedPreceding, -1)     # one row per range
    offsets = totals.select("_range", *[
        F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in cols])
    o = F.col(order).desc() if descending else F.col(order).asc()
    inside = W.partitionBy("_range").orderBy(o).rowsBetween(W.unboundedPreceding, 0)
    out = d
    for c in cols:
        out = out.withColumn(f"_i_{c}", F.sum(c).over(inside))
    out = out.join(F.broadcast(offsets), "_range")
    for c in cols:
        out = out.withColumn(prefix + c, F.col(f"_i_{c}") + F.col(f"_o_{c}"))
    return out.drop("_range", *[f"_i_{c}" for c in cols], *[f"_o_{c}" for c in cols])


def rank_values(df: DataFrame, col: str, descending: bool = True,
                name: str = "rank") -> DataFrame:
    """Competition rank of every row by ``col`` (ties share a rank), NULLs last.

    Rows are counted per distinct value first, so the order is taken over distinct values.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n"))
    cum = running_sum(counts, col, ["_n"], descending=descending)
    ranks = cum.select(F.col(col).alias("_v"),
                       (F.col("cum__n") - F.col("_n") + 1).alias(name))
    below = df.agg((F.count(col) + 1).alias("_k"))
    return (df.join(ranks, F.col(col) == F.col("_v"), "left").drop("_v")
            .withColumn(name, F.coalesce(F.col(name), below.scalar())))


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float],
                    weight: str | None = None) -> DataFrame:
    """Interpolated quantiles of one column over the whole frame: rows (q, value).

    Equal to ``percentile`` but the value counts stay spread over the cluster instead of in one
    aggregation buffer.
    """
    n = F.sum(weight) if weight else F.count("*")
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(
        n.cast("bigint").alias("_n"))
    cum = running_sum(counts, "_v", ["_n"])
    total = counts.agg(F.sum("_n").alias("_t"))
    want = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("q")) for p in probs]))
    d = cum.withColumn("_total", total.scalar()).withColumn("_w", want)
    pos = F.col("_w.q") * (F.col("_total") - 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    # zero-based positions covered by this value: [cum - n, cum - 1]
    covers = lambda p: (p >= F.col("cum__n") - F.col("_n")) & (p < F.col("cum__n"))
    hit = d.where(covers(lo) | covers(hi))
    out = hit.groupBy(F.col("_w.q").alias("q")).agg(
        F.max(F.when(covers(lo), F.col("_v"))).alias("_lo"),
        F.max(F.when(covers(hi), F.col("_v"))).alias("_hi"),
        F.max(pos - lo).alias("_f"))
    return out.select("q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("value"))


def one_row_quantiles(df: DataFrame, col: str, wanted: Mapping[str, float]) -> DataFrame:
    """``exact_quantiles`` as one row: {output name: probability}; NULLs where there is no value."""
    rows = exact_quantiles(df, col, sorted(set(wanted.values())))
    return rows.agg(*[F.max(F.when(F.col("q") == float(p), F.col("value"))).alias(n)
                      for n, p in wanted.items()])


def value_counts(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Written rows (_k keys, _c place of the column in ``cols``, _v value, _n rows that hold it, _all rows)."""
    values = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v"))
                       for i, c in enumerate(cols)])
    return materialise(
        df.select(F.struct(*keys).alias("_k"), F.inline(values)).groupBy("_k", "_c", "_v").agg(
            F.count("_v").alias("_n"), F.count("*").alias("_all")), "value-counts")


def grouped_quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]],
                      rows: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Interpolated quantiles per group: {output name: (column, probability)}.

    Equal to ``percentile`` per group, without a buffer of all values of a group.  Equal values are
    counted first.  Ranges that each hold an equal share of those counts, whatever their group, then
    cut every group; a group's totals by range tell which range holds a wanted position, and
    only those ranges are ordered.  So no task orders more than one range, however hot a group is.

    NULL keys form a group, as in ``groupBy``.  NULL values count for nothing; a group with no other has
    NULL quantiles.  ``rows`` names an output with the rows of the group.  ``counts`` are those of
    ``value_counts`` for these keys and the columns of ``wanted`` in their order, if there already.
    """
    cols = list(dict.fromkeys(c for c, _ in wanted.values()))
    counts = value_counts(df, keys, cols) if counts is None else counts
    d = with_range(counts, "_v", range_bounds(counts.where("_v IS NOT NULL"), "_v"), "_r")

    group = W.partitionBy("_k", "_c")
    earlier = group.orderBy("_r").rowsBetween(W.unboundedPreceding, W.currentRow)
    places = F.array(*[F.struct(F.lit(cols.index(c)).alias("c"), F.lit(n).alias("name"),
                                F.lit(float(p)).alias("p")) for n, (c, p) in wanted.items()])

    def at(frame: DataFrame) -> DataFrame:
        """Rows of ``frame`` (its values end before position _end and number _n) by place in it."""
        pos = F.col("_w.p") * (F.col("_t") - 1)
        out = (frame.withColumn("_w", F.explode(F.filter(places, lambda x: x["c"] == F.col("_c"))))
               .withColumn("_pos", pos))
        inside = lambda x: (x >= F.col("_end") - F.col("_n")) & (x < F.col("_end"))
        return (out.withColumns({"_lo": inside(F.floor("_pos")), "_hi": inside(F.ceil("_pos"))})
                .where("_lo OR _hi"))

    totals = d.groupBy("_k", "_c", "_r").agg(F.sum("_n").alias("_n")).select(
        "*", F.sum("_n").over(earlier).alias("_end"), F.sum("_n").over(group).alias("_t"))
    holding = at(totals).select("_k", "_c", "_r", "_t", (F.col("_end") - F.col("_n")).alias("_o")).distinct()
    in_range = W.partitionBy("_k", "_c", "_r").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = d.where("_n > 0").join(holding, ["_k", "_c", "_r"]).withColumn(
        "_end", F.sum("_n").over(in_range) + F.col("_o"))
    found = at(ordered).groupBy("_k", F.col("_w.name").alias("_name")).agg(
        F.max(F.when(F.col("_lo"), F.col("_v"))).alias("a"),
        F.max(F.when(F.col("_hi"), F.col("_v"))).alias("b"),
        F.max(F.col("_pos") - F.floor("_pos")).alias("f"))
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("f")
    by_group = found.groupBy("_k").agg(*[F.max(F.when(F.col("_name") == n, value)).alias(n) for n in wanted])
    groups = counts.where("_c = 0").groupBy("_k").agg(F.sum("_all").alias(rows or "_rows"))
    return groups.join(by_group, "_k", "left").select(
        *[F.col("_k").getField(k).alias(k) for k in keys], *wanted, *([rows] if rows else []))


# ------------------------------------------------------------------ hot groups

def hot_keys(df: DataFrame, keys: Sequence[str], rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``rows`` rows: too many for one task."""
    return hot_of(df.groupBy(*keys).agg(F.count("*").alias("_n")), keys, "_n", rows)


def hot_of(counts: DataFrame, keys: Sequence[str], n: str, rows: int = HOT_ROWS) -> DataFrame:
    """Hot keys from a frame that already holds the rows per key."""
    return counts.where(F.col(n) > rows).select(*keys)


def tie_break(order: Column, digest: Column) -> Column:
    """Number that never falls along the order of an integer column and then of an md5 text."""
    frac = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return order.cast("double") + frac / F.lit(float(1 << 32))


def _split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Add ``_hot`` and ``_part``: 0 for ordinary groups; for hot groups the range of ``_ord``
    within the group's own order, rows without an order value after all others."""
    marked = df.join(hot.withColumn("_hot", F.lit(True)), list(keys), "left")
    ranges = _range_count(df)
    probs = [i / ranges for i in range(1, ranges)]
    bounds = materialise(marked.where("_hot").groupBy(*keys, "_nul").agg(
        F.percentile_approx("_ord", probs, 10000).alias("_b")), "hot-bounds")
    rng = F.size(F.filter("_b", lambda b: b < F.col("_ord"))) + F.col("_nul") * ranges
    return (marked.join(bounds, [*keys, "_nul"], "left")
            .withColumn("_part", F.when(F.col("_hot"), rng).otherwise(F.lit(0))).drop("_b"))


def sequence_in_group(df: DataFrame, keys: Sequence[str], order: str, row_key: str,
                      seq: str | None = None, lagged: tuple[str, str] | None = None,
                      size: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Row number, group size and/or the previous row's value inside each group.

    ``lagged`` is (value column, output name).  Rows are ordered by the integer column ``order``,
    NULL last, then by the md5 of ``row_key``, then by ``row_key``.  Rows with a NULL key belong to
    no group: they get NULLs and are spread over all tasks instead of being sent to one.  Groups of
    more than ``hot_rows`` rows are split by ranges; the result does not depend on that number.
    """
    no_key = None
    for k in keys:
        no_key = F.col(k).isNull() if no_key is None else no_key | F.col(k).isNull()
    # a group can only be hot if its first key is: few rows to count by that, combined map-side
    keyed = df.where(~no_key)
    hot, split = None, bool(hot_keys(keyed, keys[:1], hot_rows).take(1))
    if split:
        hot = materialise(hot_keys(keyed, keys, hot_rows), "hot-keys")
        split = bool(hot.take(1))
    d = (df.withColumn("_spread", F.when(no_key, F.xxhash64(row_key)))
         .withColumn("_md", F.unhex(F.md5(F.col(row_key).cast("binary")))))
    part = ["_part"] if split else []
    if split:
        d = (d.withColumn("_nul", F.col(order).isNull().cast("int"))
             .withColumn("_ord", tie_break(F.coalesce(order, F.lit(0)), F.hex("_md"))))
        d = _split_hot(d, keys, hot)
    inside = W.partitionBy(*keys, "_spread", *part).orderBy(F.col(order).asc_nulls_last(), "_md", row_key)
    if seq:
        d = d.withColumn("_rn", F.row_number().over(inside))
    if lagged:
        d = d.withColumn("_prev", F.lag(lagged[0]).over(inside)) \
             .withColumn("_pos", F.lag(F.lit(True)).over(inside))
    if size:
        d = d.withColumn("_sz", F.count("*").over(W.partitionBy(*keys, "_spread", *part)))
    if split:
        d = _with_earlier_parts(d, keys, F.struct(order, "_md", row_key), lagged)
    if seq:
        rn = F.col("_rn") + F.coalesce("_before", F.lit(0)) if split else F.col("_rn")
        d = d.withColumn(seq, F.when(~no_key, rn.cast("int")))
    if lagged:
        prev = F.when(F.col("_pos"), F.col("_prev"))
        d = d.withColumn(lagged[1], F.when(~no_key, prev.otherwise(F.col("_carry")) if split else prev))
    if size:
        d = d.withColumn(size, F.when(~no_key, F.coalesce("_all", "_sz") if split else F.col("_sz")))
    return d.drop("_nul", "_ord", "_md", "_spread", "_hot", "_part", "_rn", "_prev", "_pos", "_sz",
                  "_before", "_carry", "_all")


def _with_earlier_parts(d: DataFrame, keys: Sequence[str], place: Column,
                        lagged: tuple[str, str] | None) -> DataFrame:
    """Add what the earlier parts of a hot group contribute: one row per range and hot key."""
    last = F.col(lagged[0]) if lagged else F.lit(None).cast("int")
    parts = d.where("_hot").groupBy(*keys, "_part").agg(
        F.count("*").alias("_n"), F.max_by(last, place).alias("_last"))
    by_part = W.partitionBy(*keys).orderBy("_part")
    parts = materialise(parts.select(
        *keys, "_part",
        F.coalesce(F.sum("_n").over(by_part.rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"),
        F.lag("_last").over(by_part).alias("_carry"),
        F.sum("_n").over(W.partitionBy(*keys)).alias("_all")), "hot-parts")
    return d.join(parts, [*keys, "_part"], "left")

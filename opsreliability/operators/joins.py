"""Join shapes.

No side is broadcast by hint unless its size has a proven bound: the planner broadcasts a side
when its measured size is under spark.sql.autoBroadcastJoinThreshold and shuffles it otherwise.
Joins that attach per-key values to a fact keep the fact on the left, so that adaptive execution
may split a skewed fact partition (inner, left, semi and anti joins all allow that).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsreliability.operators.prefix import HOT_ROWS, hot_keys
from opsreliability.session import materialise

SALTS = 32
#: Bytes of per-key statistics that may be broadcast.
BROADCAST_BYTES = 64 << 20


def join_dim(fact: DataFrame, dim: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Inner equi join fact -> dimension; ``on`` maps fact columns to dimension columns."""
    cond = [fact[f] == dim[d] for f, d in on.items()]
    return fact.join(dim, cond, "inner").drop(*[dim[d] for d in on.values()])


def lookup(fact: DataFrame, table: DataFrame, fk: str, pk: str, value: str,
           default: Column | None = None, name: str | None = None) -> DataFrame:
    """Left lookup of one value with a default for missing keys."""
    t = table.select(F.col(pk).alias("_k"), F.col(value).alias("_v"))
    out = fact.join(t, F.col(fk) == F.col("_k"), "left")
    v = F.col("_v") if default is None else F.coalesce(F.col("_v"), default)
    return out.withColumn(name or value, v).drop("_k", "_v")


def left_on(fact: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on equally named columns; table rows are unique per key."""
    return fact.join(table, list(keys), "left")


def join_using(a: DataFrame, b: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    return a.join(b, list(cols), how)


def join_best(left: DataFrame, right: DataFrame, on: Sequence[str], rank: Column) -> DataFrame:
    """Left join to the best right row per key, best = smallest ``rank``.

    The best row is found by an aggregate (combined map-side), not by ranking whole groups.
    """
    rest = [c for c in right.columns if c not in on]
    best = (right.groupBy(*on).agg(F.min_by(F.struct(*rest), rank).alias("_b"))
            .select(*on, "_b.*"))
    return left.join(best, list(on), "left")


def orphans(fact: DataFrame, dim: DataFrame, fk: str, pk: str) -> DataFrame:
    """Rows of the fact without a dimension row."""
    return fact.join(dim.select(F.col(pk).alias("_pk")), F.col(fk) == F.col("_pk"), "left_anti")


def join_role(fact: DataFrame, dim: DataFrame, fk: str, pk: str, prefix: str,
              attributes: Sequence[str]) -> DataFrame:
    """Second role of a dimension: attributes come in with a prefix."""
    d = dim.select(F.col(pk).alias("_pk"), *[F.col(a).alias(prefix + a) for a in attributes])
    return fact.join(d, F.col(fk) == F.col("_pk"), "left").drop("_pk")


def lookup_chain(fact: DataFrame, levels: Sequence[tuple[DataFrame, Sequence[str]]],
                 values: Sequence[str], total: DataFrame | None = None) -> DataFrame:
    """First value found along levels of falling detail, e.g. key -> parent key -> whole.

    Each level is (table, keys); ``total`` is a one-row frame used last.
    """
    out = fact
    for i, (table, keys) in enumerate(levels):
        t = table.select(*keys, *[F.col(v).alias(f"_l{i}_{v}") for v in values])
        out = out.join(t, list(keys), "left")
    for v in values:
        options = [F.col(f"_l{i}_{v}") for i in range(len(levels))]
        if total is not None:
            options.append(total.select(v).scalar())
        out = out.withColumn(v, F.coalesce(*options))
    return out.drop(*[f"_l{i}_{v}" for i in range(len(levels)) for v in values])


def match_by_priority(keys: DataFrame, key: str, candidates: Sequence[DataFrame],
                      rank: Sequence[Column]) -> DataFrame:
    """Best registry row per key from candidate sets in order of priority.

    Every candidate frame carries ``key`` and the same attributes; lower position wins, then
    the ``rank`` columns.
    """
    both = None
    for i, c in enumerate(candidates):
        c = c.withColumn("_prio", F.lit(i))
        both = c if both is None else both.unionByName(c)
    return join_best(keys, both, [key], F.struct("_prio", *rank)).drop("_prio")


def byte_size(df: DataFrame) -> int:
    """Bytes of all values of a written table: texts by their length, 32 an entry of a map, 16 a column besides."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t == "string"]
    texts += [32 * F.coalesce(F.cardinality(c), F.lit(0)) for c, t in df.dtypes if t.startswith("map")]
    row = sum(texts, F.lit(16 * len(df.columns)))
    return df.agg(F.sum(row.cast("bigint"))).first()[0] or 0


def attach_stats(fact: DataFrame, stats: DataFrame, keys: Sequence[str], row_key: str,
                 source: DataFrame, broadcast_bytes: int = BROADCAST_BYTES,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join of per-key values to a fact whose keys may be hot.

    ``stats`` is written and its bytes are added up first.  Up to ``broadcast_bytes`` it is
    broadcast, and the fact is not shuffled at all.  Beyond that, rows of hot keys (more than
    ``hot_rows`` rows in ``source``, the frame with the keys the statistics were taken from) are
    spread over SALTS sub-keys and only the few hot rows of ``stats`` are repeated, so one key
    holding a third of the fact still fills many tasks.
    """
    stats = materialise(stats, "stats")
    if byte_size(stats) <= broadcast_bytes:
        return fact.join(F.broadcast(stats), list(keys), "left")
    hot = materialise(hot_keys(source, keys, hot_rows).withColumn("_hot", F.lit(True)), "hot-keys")
    spread = F.pmod(F.xxhash64(row_key), F.lit(SALTS)).cast("int")
    f = (fact.join(hot, list(keys), "left")
         .withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))).drop("_hot"))
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    s = (stats.join(hot, list(keys), "left")
         .withColumn("_salt", F.explode(F.when(F.col("_hot"), every)
                                        .otherwise(F.array(F.lit(0))))).drop("_hot"))
    return f.join(s, [*keys, "_salt"], "left").drop("_salt")


def between_bounds(df: DataFrame, col: str, ref: DataFrame, ref_col: str) -> DataFrame:
    """Rows whose value lies between the smallest and largest value of another frame."""
    lo = ref.agg(F.min(ref_col).alias("v")).scalar()
    hi = ref.agg(F.max(ref_col).alias("v")).scalar()
    return df.where((F.col(col) >= lo) & (F.col(col) <= hi))

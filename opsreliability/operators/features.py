"""Leak-free features for scheduled legs.

Schedule features use only what the published schedule shows.  Key encodings are out of fold on
the training window and training-window statistics elsewhere.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from opsreliability.functions import scalar as S
from opsreliability.operators.joins import BROADCAST_BYTES, attach_stats
from opsreliability.operators.prefix import HOT_ROWS, hot_keys, sequence_in_group
from opsreliability.operators.sampling import fixed_sample
from opsreliability.operators.windows import peer_counts

# Feature names, key columns, targets, smoothing weight and number of folds.
CATEGORIES = ["carrier", "origin", "dest"]
SCHEDULE = ["dep_hour", "arr_hour", "crs_dep_min_of_day", "day_of_week", "is_weekend",
            "days_to_holiday", "distance_mi", "crs_elapsed_min", "sched_speed_mpm",
            "origin_sched_deps_day", "origin_sched_deps_hour", "dest_sched_arrs_hour",
            "carrier_sched_day"]
ROTATION = ["tail_leg_of_day", "tail_legs_day", "sched_turn_min"]
TE_KEYS = {"route": "route", "carrier_origin": "carrier_origin", "flight": "flight_key"}
TE_TARGETS = {"delay": "arr_del15", "cancel": "cancelled"}
ENCODED = [f"te_{k}_{t}" for k in TE_KEYS for t in TE_TARGETS]
CONGESTION = {"origin_sched_deps_day": ["origin", "flight_date"],
              "origin_sched_deps_hour": ["origin", "flight_date", "dep_hour"],
              "dest_sched_arrs_hour": ["dest", "flight_date", "arr_hour"],
              "carrier_sched_day": ["carrier", "flight_date"]}
PACKED = {"origin_sched_deps_hour": "dep_hour", "dest_sched_arrs_hour": "arr_hour"}
PRE_DEPARTURE = CATEGORIES + SCHEDULE + ENCODED
DAY_OF_OPERATIONS = PRE_DEPARTURE + ROTATION
SMOOTHING = 50.0
FOLDS = 5
OUTCOMES = ["completed", "cancelled", "arr_del15", "arr_delay_min"]


def legs_columns(columns: Collection[str]) -> list[str]:
    """Columns of the legs that these features are made of; those of the row key and the split come with them."""
    sources = {"flight_key": ["carrier", "flight_number"], "carrier_origin": ["carrier", "origin"],
               "day_of_month": ["flight_date"], "is_weekend": ["day_of_week"], "split": ["flight_date"],
               "days_to_holiday": ["flight_date"], "sched_speed_mpm": ["distance_mi", "crs_elapsed_min"], **CONGESTION}
    sources |= {c: ["tail_number", "flight_date", "crs_dep_min_of_day", "crs_arr_min_of_day"] for c in ROTATION}
    sources |= {f"te_{k}_{t}": ["flight_id", "flight_date", *sources.get(c, [c]), *TE_TARGETS.values()]
                for k, c in TE_KEYS.items() for t in TE_TARGETS}
    return list(dict.fromkeys(["flight_date", *[s for c in columns for s in sources.get(c, [c])]]))


def schedule_features(legs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Per-leg schedule features: one projection.  Legs that lack columns give the features the others make."""
    made = {"flight_key": (S.key("carrier", "flight_number"), {"carrier", "flight_number"}),
            "carrier_origin": (S.key("carrier", "origin"), {"carrier", "origin"}),
            "day_of_month": (F.dayofmonth("flight_date"), {"flight_date"}),
            "is_weekend": ((F.col("day_of_week") >= 6).cast("tinyint"), {"day_of_week"}),
            "sched_speed_mpm": (F.col("distance_mi") / F.col("crs_elapsed_min"), {"distance_mi", "crs_elapsed_min"})}
    have = set(legs.columns)
    order = ["flight_id", "flight_date", "carrier", "flight_number", "flight_key", "origin", "dest", "route",
             "carrier_origin", "tail_number", "dep_hour", "arr_hour", "crs_dep_min_of_day", "crs_arr_min_of_day",
             "day_of_week", "day_of_month", "is_weekend", "distance_mi", "crs_elapsed_min", "sched_speed_mpm", *OUTCOMES]
    return legs.select(*keep, *[made[c][0].alias(c) if c in made else c for c in order
                                if (made[c][1] <= have if c in made else c in have)])


def congestion_features(df: DataFrame, row_key: str, source: DataFrame | None = None,
                        only: Collection[str] | None = None) -> DataFrame:
    """Planned traffic around the leg, later-cancelled legs included; all counts or ``only`` some."""
    specs = {n: k for n, k in CONGESTION.items() if only is None or n in only}
    return peer_counts(df, specs, row_key, source, PACKED)


def rotation_features(base: DataFrame, row_key: str) -> DataFrame:
    """Leg number, legs that day and planned turn time of the tail; NULL without a tail.

    Known only on the day of operations: a missing tail tells that the leg was cancelled.
    """
    d = sequence_in_group(base, ["tail_number", "flight_date"], "crs_dep_min_of_day", row_key,
                          seq="tail_leg_of_day", lagged=("crs_arr_min_of_day", "_prev_arr"),
                          size="tail_legs_day")
    turn = F.col("crs_dep_min_of_day") - F.col("_prev_arr")
    return d.withColumn("sched_turn_min", F.when(turn >= 0, turn)).drop("_prev_arr")


# ------------------------------------------------------------------ target encoding

def priors(train: DataFrame, targets: Mapping[str, str] = TE_TARGETS) -> DataFrame:
    """One row with the training rate of every target."""
    return train.agg(*[F.avg(c).alias(t) for t, c in targets.items()])


def te_stats(train: DataFrame, key: Sequence[str | Column],
             targets: Mapping[str, str] = TE_TARGETS) -> DataFrame:
    """Per key: rows with a target (n_) and their sum (s_)."""
    return train.groupBy(*key).agg(
        *[F.count(c).alias(f"n_{t}") for t, c in targets.items()],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"s_{t}") for t, c in targets.items()])


def _smooth(s: Column, n: Column, prior: Column, m: float) -> Column:
    return ((s + m * prior) / (n + m)).cast("float")


def te_fold_table(train: DataFrame, key: str, fold: Column, prior: DataFrame,
                  targets: Mapping[str, str] = TE_TARGETS, m: float = SMOOTHING,
                  prefix: str = "te_") -> DataFrame:
    """Encodings by (key, fold): every fold sees the sums of the other folds; fold -1 sees all.

    One grouping of the training rows by key and fold gives both, because the folds add up.
    """
    by_fold = te_stats(train, [F.col(key).alias("key"), fold.alias("fold")], targets)
    total = by_fold.groupBy("key").agg(*[F.sum(f"{a}_{t}").alias(f"{a}a_{t}")
                                         for t in targets for a in "ns"])
    own = by_fold.unionByName(total.select("key", F.lit(-1).alias("fold"), *[
        F.lit(0).cast("bigint").alias(f"{a}_{t}") for t in targets for a in "ns"]))
    both = own.join(total, "key")
    return both.select("key", "fold", *[
        _smooth(F.col(f"sa_{t}") - F.col(f"s_{t}"), F.col(f"na_{t}") - F.col(f"n_{t}"),
                prior.select(t).scalar(), m).alias(f"{prefix}{t}") for t in targets])


def _encode_many(df: DataFrame, key: str, row_key: str, prior: DataFrame, targets: Mapping[str, str],
                 m: float, prefix: str) -> DataFrame:
    """Encodings of a key with about as many values as rows: sums over the key less those over its fold.

    The rows meet their sums in the one shuffle by key; a table of sums would be as long as the fact.  Rows
    without a key are spread over all tasks.
    """
    known = F.col("fold") >= 0
    d = df.withColumn("_spread", F.when(F.col(key).isNull(), F.xxhash64(row_key)))
    whole, own = W.partitionBy(key, "_spread"), W.partitionBy(key, "_spread", "fold")
    # by the shorter key, ordered for the longer: one shuffle and one sort serve both windows
    d = d.repartition(key, "_spread").sortWithinPartitions(key, "_spread", "fold")
    said = {t: F.when(known, F.col(c)) for t, c in targets.items()}
    d = d.withColumns({f"_{a}_{t}": v.over(own) for t, y in said.items()
                       for a, v in (("n", F.count(y)), ("s", F.sum(y)))})
    d = d.withColumns({"_seen": F.count(F.when(known, 1)).over(whole)} | {
        f"_{a}a_{t}": v.over(whole) for t, y in said.items() for a, v in (("n", F.count(y)), ("s", F.sum(y)))})
    there = F.col(key).isNotNull() & F.col("fold").isNotNull() & (F.col("_seen") > 0)

    def encoded(t: str) -> Column:
        s = F.coalesce(f"_sa_{t}", F.lit(0)) - F.coalesce(f"_s_{t}", F.lit(0))
        return F.when(there, _smooth(s, F.col(f"_na_{t}") - F.col(f"_n_{t}"), prior.select(t).scalar(), m))

    return d.withColumns({f"{prefix}{t}": encoded(t) for t in targets}).drop(
        "_spread", "_seen", *[f"_{a}_{t}" for t in targets for a in ("n", "s", "na", "sa")])


def target_encode(df: DataFrame, source: DataFrame, row_key: str, train: Column,
                  keys: Mapping[str, str] = TE_KEYS, targets: Mapping[str, str] = TE_TARGETS,
                  m: float = SMOOTHING, folds: int = FOLDS, id_col: str = "flight_id",
                  broadcast_bytes: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add te_<key>_<target> to ``df``.

    ``source`` is the light base table the statistics are taken from (same rows, without the
    features already attached to ``df``).  Keys whose table would be too large to broadcast are encoded in
    one shuffle of the rows, unless one of them is hot.
    """
    fold = F.when(train, S.fold(id_col, folds)).otherwise(F.lit(-1))
    base = source.withColumn("fold", fold)
    known = base.where(train & F.col(id_col).isNotNull())   # the rows with a fold, told without their digests
    p = priors(known, targets)
    out = df.withColumn("fold", fold)
    sizes = known.agg(*[F.approx_count_distinct(c).alias(c) for c in dict.fromkeys(keys.values())]).first()
    for name, col in keys.items():
        many = sizes[col] * (folds + 1) * 16 * (2 + len(targets)) > broadcast_bytes
        if many and not hot_keys(base.where(F.col(col).isNotNull()), [col], hot_rows).take(1):
            out = _encode_many(out, col, row_key, p, targets, m, f"te_{name}_")
            for t in targets:
                c = f"te_{name}_{t}"
                out = out.withColumn(c, F.coalesce(F.col(c), p.select(t).scalar().cast("float")))
            continue
        table = te_fold_table(known, col, F.col("fold"), p, targets, m, prefix=f"te_{name}_")
        table = table.withColumnRenamed("key", col)
        out = attach_stats(out, table, [col, "fold"], row_key,
                           base.select(col, "fold"))
        for t in targets:
            c = f"te_{name}_{t}"
            out = out.withColumn(c, F.coalesce(F.col(c), p.select(t).scalar().cast("float")))
    return out.drop("fold")


def feature_table(legs: DataFrame, calendar: DataFrame, train_end: str, valid_end: str,
                  row_key: str = "flight_id", keep: Sequence[str] = (),
                  columns: Sequence[str] | None = None) -> DataFrame:
    """All features, outcomes and the split label, one row per leg with a calendar day.

    With ``columns`` only these, and no step is taken for features that are not among them.
    """
    wanted = lambda names: [n for n in names if columns is None or n in columns]
    base = schedule_features(legs, keep)
    train = F.col("flight_date") <= F.lit(train_end).cast("date")
    d = rotation_features(base, row_key) if wanted(ROTATION) else base
    d = congestion_features(d, row_key, base, wanted(CONGESTION))
    d = d.join(F.broadcast(calendar.select("flight_date", "days_to_holiday")), "flight_date")
    keys = {k: c for k, c in TE_KEYS.items() if wanted([f"te_{k}_{t}" for t in TE_TARGETS])}
    if keys:
        d = target_encode(d, base, row_key, train, keys)
    d = d.withColumn("split", S.split_label("flight_date", train_end, valid_end))
    return d if columns is None else d.select(*columns)


# ------------------------------------------------------------------ lookups for scoring

def te_lookup(train: DataFrame, key: str, min_rows: int = 5, m: float = SMOOTHING,
              prior: DataFrame | None = None) -> DataFrame:
    """Encodings by key from all training rows; ``prior`` are their ``priors``, if there already."""
    p = priors(train) if prior is None else prior
    s = te_stats(train, [F.col(key).alias("key")]).where(F.col("n_cancel") >= min_rows)
    return s.select("key", *[_smooth(F.col(f"s_{t}"), F.col(f"n_{t}"), p.select(t).scalar(), m)
                             .alias(f"te_{t}") for t in TE_TARGETS], F.col("n_cancel").alias("n"))


def schedule_profile(train: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return train.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def route_profile(train: DataFrame) -> DataFrame:
    return train.groupBy("route", "origin", "dest").agg(
        F.median("distance_mi").alias("distance_mi"),
        F.median("crs_elapsed_min").alias("crs_elapsed_min"), F.count("*").alias("flights"))


# ------------------------------------------------------------------ reading splits, audits

def load_split(features: DataFrame, split: str, sample: int | None = None, where: str = "",
               columns: Sequence[str] | None = None, row_key: str = "flight_id",
               seed: int = 42) -> DataFrame:
    """Rows of a split, filtered first and sampled after."""
    d = features.where(F.col("split") == split)
    if where:
        d = d.where(where)
    if sample:
        d = fixed_sample(d, row_key, sample, seed)
    return d.select(*columns) if columns else d


def split_summary(features: DataFrame) -> DataFrame:
    return features.groupBy("split").agg(
        F.min("flight_date").alias("first_day"), F.max("flight_date").alias("last_day"),
        F.count("*").alias("n"), F.avg("arr_del15").alias("delay_rate"),
        F.avg("cancelled").alias("cancel_rate"))


def rate_by(features: DataFrame, by: Mapping[str, Column], rates: Mapping[str, str]) -> DataFrame:
    """Leakage audits: outcome rates by an indicator."""
    return features.groupBy(*[c.alias(n) for n, c in by.items()]).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(n) for n, c in rates.items()])


def leakage_report(features: DataFrame) -> dict[str, DataFrame]:
    cancel = {"cancel_rate": "cancelled"}
    both = {"delay_rate": "arr_del15", "cancel_rate": "cancelled"}
    return {
        "missing_tail": rate_by(features, {"missing_tail": F.col("tail_number").isNull()}, cancel),
        "rotation": rate_by(features, {"no_turn": F.col("sched_turn_min").isNull(),
                                       "first_leg": F.col("tail_leg_of_day") == 1}, cancel),
        "day_of_month": rate_by(features.where("split = 'train'"),
                                {"day_of_month": F.col("day_of_month")}, cancel),
        "encoding": features.groupBy("split").agg(
            F.avg("te_route_delay").alias("mean_te"),
            F.corr("te_route_delay", "arr_del15").alias("corr_with_target")),
        "holiday": rate_by(features, {"days_to_holiday": F.col("days_to_holiday")}, both),
    }

"""Disruption days: decomposition residuals, robust z-scores and an isolation forest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsreliability.functions.scalar import logit
from opsreliability.operators.prefix import exact_quantiles
from opsreliability.operators.windows import vs_own_median
from opsreliability.session import cut_lineage

Z_LIMIT = 3.5
MAD_SCALE = 1.4826
FOREST_FEATURES = ["arr_delay_rate", "cancellation_rate", "avg_dep_delay_min", "avg_taxi_out_min",
                   "volume_ratio", "weather_share"]


def logit_rate(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_logit": logit(c, 1e-4) for c in cols})


# ------------------------------------------------------------------ STL

def _loess(y: np.ndarray, q: int, at: np.ndarray, rw: np.ndarray, whole: int | None = None) -> np.ndarray:
    """Local linear fit with tricube and robustness weights on an even grid, at points ``at``.

    ``whole`` is the length of the series that ``y`` is a range of."""
    n = len(y)
    m = min(q, n)
    left = np.clip(np.round(at - (m - 1) / 2).astype(int), 0, n - m)
    idx = left[:, None] + np.arange(m)[None, :]
    h = np.maximum(at - left, left + m - 1 - at) + (max(q - n, 0) // 2)
    r = np.abs(idx - at[:, None]) / np.maximum(h, 1e-12)[:, None]
    w = np.where(r <= 0.999, (1 - np.minimum(r, 1) ** 3) ** 3, 0.0)
    w = np.where(r <= 0.001, 1.0, w) * rw[idx]
    total = w.sum(1, keepdims=True)
    w = np.where(total > 0, w / np.where(total > 0, total, 1), 1.0 / m)
    mean = (w * idx).sum(1, keepdims=True)
    spread = (w * (idx - mean) ** 2).sum(1, keepdims=True)
    slope = np.where(np.sqrt(spread) > 0.001 * (whole or n), (at[:, None] - mean)
                     / np.where(spread > 0, spread, 1), 0.0)
    return (w * (1 + slope * (idx - mean)) * y[idx]).sum(1)


def _moving_average(x: np.ndarray, k: int) -> np.ndarray:
    c = np.cumsum(np.concatenate([[0.0], x]))
    return (c[k:] - c[:-k]) / k


def _smoothed(y: np.ndarray, trend: np.ndarray, rw: np.ndarray, period: int, seasonal: int, inner: int,
              whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal and trend after ``inner`` rounds from a given trend; ``whole``: length of the series."""
    n = len(y)
    odd = lambda v: int(np.ceil(v)) | 1
    q_trend, q_low = odd(1.5 * period / (1 - 1.5 / seasonal)), odd(period + 1)
    at = np.arange(n, dtype=float)
    seas = np.zeros(n)
    for _ in range(inner):
        cycle = np.empty(n + 2 * period)
        d = y - trend
        for p in range(period):
            sub, w = d[p::period], rw[p::period]
            cycle[p::period] = _loess(sub, seasonal, np.arange(-1.0, len(sub) + 1), w, -(-(whole - p) // period))
        low = _moving_average(_moving_average(_moving_average(cycle, period), period), 3)
        seas = cycle[period:period + n] - _loess(low, q_low, at, np.ones(n), whole)
        trend = _loess(y - seas, q_trend, at, rw, whole)
    return seas, trend


def _robustness(resid: np.ndarray, median: float) -> np.ndarray:
    """Bisquare weights of absolute residuals."""
    u = resid / (6 * median) if median > 0 else np.zeros(len(resid))
    return np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - np.minimum(u, 1) ** 2) ** 2, 0.0))


def stl_arrays(y: np.ndarray, period: int = 7, seasonal: int = 7, inner: int = 2,
               outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seasonal, trend, residual) of one evenly spaced series, robust version.

    Cleveland et al., "STL: A Seasonal-Trend Decomposition Procedure Based on Loess", 1990.
    """
    n = len(y)
    trend, seas, rw = np.zeros(n), np.zeros(n), np.ones(n)
    for step in range(outer + 1):
        seas, trend = _smoothed(y, trend, rw, period, seasonal, inner, n)
        if step < outer:
            resid = np.abs(y - seas - trend)
            rw = _robustness(resid, np.median(resid))
    return seas, trend, y - seas - trend


def stl(daily: DataFrame, key: str, day: str, cols: Sequence[str], period: int = 7) -> DataFrame:
    """Add <c>_trend and <c>_resid.  One series is one group, bounded by the calendar; many
    series run in parallel.  The input is one row per series and day on a gap-free calendar."""
    keep = daily.select(key, day, *[F.col(c).cast("double") for c in cols])
    out = ", ".join(f"{c}_trend double, {c}_resid double" for c in cols)
    key_type = keep.schema[key].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        res = pdf[[key, day]].copy()
        for c in cols:
            y = pdf[c].interpolate(limit_direction="both").to_numpy(float)
            if len(y) < 2 * period or np.isnan(y).any():
                res[f"{c}_trend"], res[f"{c}_resid"] = np.nan, np.nan
            else:
                _, res[f"{c}_trend"], res[f"{c}_resid"] = stl_arrays(y, period)
        return res

    parts = keep.groupBy(key).applyInPandas(fit, f"{key} {key_type}, {day} date, {out}")
    return daily.join(parts, [key, day])


def stl_ranges(daily: DataFrame, key: str, day: str, col: str, period: int = 7, seasonal: int = 7,
               inner: int = 2, outer: int = 15, cycles: int = 300) -> DataFrame:
    """(key, day, value, seasonal, trend, resid) of series of any length, each cut into ranges of days.

    A round of smoothing reaches a bounded number of cycles, so each range is smoothed with ``margin``
    cycles of its neighbours on both sides and only its own days are kept; ranges begin at whole cycles.
    Trend and robustness weights go from one outer step to the next as columns, and only the median of the
    absolute residuals is taken over the whole series.  The result is that of the series as one group, but
    for rounding, if no run of missing values is longer than the margin.  The input is one row per series and day on
    a gap-free calendar; series below two cycles, or without values, have NULL parts.
    """
    margin, size = period * 10 * (inner + 1), period * cycles
    if size < margin:
        raise ValueError(f"ranges of {10 * (inner + 1)} cycles at least")
    kind = daily.schema[key].dataType.simpleString()
    span = daily.groupBy(key).agg(F.min(day).alias("_first"), (F.datediff(F.max(day), F.min(day)) + 1).alias("_n"))
    d = daily.select(key, day, F.col(col).cast("double").alias("value")).join(span, key).select(
        key, day, "value", F.datediff(day, "_first").alias("i"), "_n",
        F.lit(0.0).alias("trend"), F.lit(1.0).alias("rw"), F.lit(0.0).alias("seasonal"))
    schema = (f"{key} {kind}, {day} date, value double, i int, _n int, trend double, rw double, seasonal double")

    def each(f):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("i")
            own = (pdf["i"] // size == pdf["_range"]).to_numpy()
            return f(pdf)[own][list(pdf.columns[:-1])]
        return run

    def filled(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(value=pdf["value"].interpolate(limit_direction="both"))

    def smoothed(pdf: pd.DataFrame) -> pd.DataFrame:
        y, n = pdf["value"].to_numpy(float), int(pdf["_n"].iloc[0])
        if n < 2 * period or np.isnan(y).any():
            return pdf.assign(seasonal=np.nan, trend=np.nan)
        seas, trend = _smoothed(y, pdf["trend"].to_numpy(), pdf["rw"].to_numpy(), period, seasonal, inner, n)
        return pdf.assign(seasonal=seas, trend=trend)

    def over_ranges(rows: DataFrame, f) -> DataFrame:
        at = F.floor(F.col("i") / size).cast("int")
        near = F.array_compact(F.array(at, F.when(F.col("i") % size < margin, at - 1),
                                       F.when(F.col("i") % size >= size - margin, at + 1)))
        out = rows.withColumn("_range", F.explode(near)).groupBy(key, "_range").applyInPandas(each(f), schema)
        return cut_lineage(out)

    d = over_ranges(d, filled)
    resid = F.col("value") - F.col("seasonal") - F.col("trend")
    for step in range(outer + 1):
        d = over_ranges(d, smoothed)
        if step < outer:
            medians = d.groupBy(key).agg(F.median(F.abs(resid)).alias("_m"))
            u = F.when(F.col("_m") > 0, F.abs(resid) / (6 * F.col("_m"))).otherwise(F.lit(0.0))
            weight = F.when(u <= 0.001, 1.0).when(u <= 0.999, F.pow(1 - u * u, 2)).otherwise(0.0)
            d = d.join(medians, key).withColumn("rw", weight).drop("_m")
    parts = [F.when(~F.isnan(c), c).alias(n) for n, c in (
        ("seasonal", F.col("seasonal")), ("trend", F.col("trend")), ("resid", resid))]
    return d.select(key, day, "value", *parts)


# ------------------------------------------------------------------ robust z

def robust_z(df: DataFrame, col: str, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """(x - median) / (1.4826 MAD), a MAD of zero counting as one."""
    name = name or f"{col}_z"
    if by:
        med = df.groupBy(*by).agg(F.median(col).alias("_med"))
        d = df.join(med, list(by))
        mad = d.groupBy(*by).agg((F.median(F.abs(F.col(col) - F.col("_med"))) * MAD_SCALE)
                                 .alias("_mad"))
        d = d.join(mad, list(by))
    else:
        d = df.withColumn("_med", df.agg(F.median(col).alias("m")).scalar())
        mad = d.agg((F.median(F.abs(F.col(col) - F.col("_med"))) * MAD_SCALE).alias("m"))
        d = d.withColumn("_mad", mad.scalar())
    unit = F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(F.lit(1.0))
    return d.withColumn(name, (F.col(col) - F.col("_med")) / unit).drop("_med", "_mad")


def flag_days(df: DataFrame, delay_z: str, cancel_z: str, limit: float = Z_LIMIT) -> DataFrame:
    late = F.coalesce(F.col(delay_z) > limit, F.lit(False))
    gone = F.coalesce(F.col(cancel_z) > limit, F.lit(False))
    return (df.withColumn("is_anomaly", (late | gone).cast("int"))
            .withColumn("anomaly_driver", F.when(late & gone, "delays + cancellations")
                        .when(gone, "cancellations").when(late, "delays").otherwise("")))


def network_anomalies(daily: DataFrame, limit: float = Z_LIMIT) -> DataFrame:
    """Flagged network days from one daily series."""
    cols = ["arr_delay_rate", "cancellation_rate"]
    d = logit_rate(daily.withColumn("series", F.lit("network")), cols)
    d = cut_lineage(stl(d, "series", "flight_date", [f"{c}_logit" for c in cols]))
    for c in cols:
        d = robust_z(d, f"{c}_logit_resid", name=f"{c}_z")
    return flag_days(d, "arr_delay_rate_z", "cancellation_rate_z", limit).drop("series")


# ------------------------------------------------------------------ site days

def relative_features(daily: DataFrame, key: str = "airport_code",
                      row_key: str = "row_key") -> DataFrame:
    """Site-day features relative to the site's own median; NULLs are zero afterwards."""
    diff = ["arr_delay_rate", "cancellation_rate", "avg_dep_delay_min", "avg_taxi_out_min"]
    d = vs_own_median(daily, key, ["scheduled_departures"], diff, row_key)
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return d.select(*[c for c in daily.columns if c not in (*diff, "weather_share")],
                    *[zero(f"{c}_diff").alias(c) for c in diff],
                    zero("scheduled_departures_ratio").alias("volume_ratio"),
                    zero("weather_share").alias("weather_share"))


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (id, feature, threshold, left, right, path length) of one isolation tree."""
    nodes: list[tuple] = []
    todo = [(0, np.arange(len(x)), 0)]
    free = 1
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        lo, hi = part.min(0), part.max(0)
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append((node, -1, 0.0, -1, -1, depth + _expected_path(len(rows))))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        below = part[:, f] <= cut
        nodes.append((node, f, cut, free, free + 1, 0.0))
        todo += [(free, rows[below], depth + 1), (free + 1, rows[~below], depth + 1)]
        free += 2
    return nodes


def _expected_path(n: int) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _ranks(h: np.ndarray, tree: int) -> np.ndarray:
    """The place of rows in the draw of a tree: their hash, mixed anew for each tree."""
    x = h + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tree_samples(df: DataFrame, features: Sequence[str], row_key: str, trees: int, psi: int,
                 seed: int) -> DataFrame:
    """(tree, rank, key, features): of each tree the rows that may be among its ``psi`` smallest ranks.

    A task keeps the ``psi`` smallest of each tree while its rows go by, so it holds and hands on trees * psi
    rows at most; the smallest of these lists, merged by tree, are the sample.  Ranks depend on seed, tree and
    row key alone: any partitioning gives the same sample.
    """
    names = list(features)
    d = df.select(F.col(row_key).cast("string").alias("_key"), F.xxhash64(F.lit(seed), row_key).alias("_h"),
                  *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    xs = [f"x{i}" for i in range(len(names))]

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pd.DataFrame(columns=["rank", "_key", *xs])] * trees
        for b in batches:
            if not len(b):
                continue
            h = b["_h"].to_numpy(np.int64).view(np.uint64)
            for t in range(trees):
                r = _ranks(h, t)
                edge = held[t]["rank"].iloc[-1] if len(held[t]) == psi else None
                low = np.flatnonzero(r <= edge) if edge is not None else np.arange(len(r))
                if len(low) > psi:
                    low = low[np.argpartition(r[low], psi - 1)[:psi]]
                if len(low):
                    new = b.iloc[low][["_key", *xs]].assign(rank=r[low])
                    both = pd.concat([held[t], new]) if len(held[t]) else new
                    held[t] = both.sort_values(["rank", "_key"]).head(psi)
        for t, rows in enumerate(held):
            if len(rows):
                ranks = rows["rank"].to_numpy(np.uint64) >> np.uint64(1)  # fits a long
                yield rows.assign(tree=t, rank=ranks.view(np.int64))[["tree", "rank", "_key", *xs]]

    kinds = ", ".join(f"{x} double" for x in xs)
    return d.mapInPandas(keep, f"tree int, rank long, _key string, {kinds}")


def fit_forest(df: DataFrame, features: Sequence[str], row_key: str, trees: int = 300,
               psi: int = 256, seed: int = 42) -> DataFrame:
    """Node table of an isolation forest: at most trees * 2 * psi rows, grown in parallel, a tree a group."""
    limit = int(np.ceil(np.log2(psi)))
    xs = [f"x{i}" for i in range(len(features))]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(["rank", "_key"])[xs].to_numpy(float)[:psi]
        nodes = _grow(x, limit, np.random.default_rng((seed, t)))
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "lo", "hi", "path"])
        out.insert(0, "tree", t)
        return out.assign(size=len(x))

    return tree_samples(df, features, row_key, trees, psi, seed).groupBy("tree").applyInPandas(
        grow, "tree int, node int, feature int, cut double, lo int, hi int, path double, size int")


def score_forest(df: DataFrame, nodes: DataFrame, features: Sequence[str],
                 name: str = "anomaly_score") -> DataFrame:
    """2 ** (-mean path / expected path); the node table is bounded and sent to the tasks."""
    table = nodes.orderBy("tree", "node").toPandas()       # at most trees * 2 * psi rows
    shared = df.sparkSession.sparkContext.broadcast(
        [g.sort_values("node")[["feature", "cut", "lo", "hi", "path", "size"]].to_numpy(float)
         for _, g in table.groupby("tree")])
    names = list(features)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].to_numpy(float)
            total, unit = np.zeros(len(x)), 0.0
            for t in shared.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    f = t[at, 0].astype(int)
                    inner = f >= 0
                    if not inner.any():
                        break
                    below = x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1]
                    at = np.where(inner, np.where(below, t[at, 2], t[at, 3]), at).astype(int)
                total += t[at, 4]
                unit += _expected_path(int(t[0, 5]))
            yield pdf.assign(**{name: np.power(2.0, -total / max(unit, 1e-12))})

    from pyspark.sql import types as T
    schema = T.StructType(df.schema.fields + [T.StructField(name, T.DoubleType())])
    return df.mapInPandas(score, schema)


def isolation_forest(df: DataFrame, features: Sequence[str] = FOREST_FEATURES,
                     row_key: str = "row_key", trees: int = 300, contamination: float = 0.02,
                     psi: int = 256, seed: int = 42) -> DataFrame:
    """Add anomaly_score and is_anomaly (score above the 1 - contamination quantile)."""
    base = cut_lineage(df)
    scored = cut_lineage(score_forest(base, fit_forest(base, features, row_key, trees, psi, seed),
                                      features))
    edge = exact_quantiles(scored, "anomaly_score", [1 - contamination]).select("value")
    return scored.withColumn("is_anomaly", (F.col("anomaly_score") > edge.scalar()).cast("int"))


def flag_contrast(df: DataFrame, flag: str, cols: Sequence[str]) -> DataFrame:
    """Means of flagged and other rows, side by side."""
    aggs = [F.count(F.when(F.col(flag) == 1, 1)).alias("flagged"),
            F.count("*").alias("all_rows")]
    for c in cols:
        aggs += [F.avg(F.when(F.col(flag) == 1, F.col(c))).alias(f"flagged_{c}"),
                 F.avg(F.when(F.col(flag) == 0, F.col(c))).alias(f"normal_{c}")]
    return df.agg(*aggs)

"""Segments of sites and routes from their operating profiles."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsreliability.session import cut_lineage

# Profile columns, tier names and trait names (high, low).
SITE_FEATURES = ["log_departures", "destinations", "arr_delay_rate", "cancellation_rate",
                 "avg_taxi_out_min", "avg_distance_mi", "evening_share", "weather_cause_share",
                 "nas_cause_share", "late_aircraft_cause_share", "dep_delay_std_min"]
ROUTE_FEATURES = ["log_flights", "distance_mi", "carriers", "on_time_pct", "avg_arr_delay_min",
                  "p90_arr_delay_min", "cancellation_rate_pct"]
SITE_TIERS = ("Major hub", "Mid-size", "Regional")
ROUTE_TIERS = ("Trunk route", "Mid-volume route", "Thin route")
TRAITS = {
    "arr_delay_rate": ("delay-prone", "punctual"),
    "cancellation_rate": ("cancellation-prone", "rarely cancels"),
    "avg_taxi_out_min": ("long taxi-out / congested", "quick turn"),
    "avg_distance_mi": ("long-haul mix", "short-haul mix"),
    "evening_share": ("evening-heavy bank", "morning-heavy bank"),
    "weather_cause_share": ("weather-exposed", "low weather exposure"),
    "nas_cause_share": ("ATC/NAS-constrained", "few NAS delays"),
    "late_aircraft_cause_share": ("knock-on (late aircraft) delays", "few knock-on delays"),
    "dep_delay_std_min": ("volatile delays", "stable delays"),
    "on_time_pct": ("reliable", "unreliable"),
    "avg_arr_delay_min": ("high average delay", "low average delay"),
    "p90_arr_delay_min": ("long delay tail", "short delay tail"),
    "cancellation_rate_pct": ("cancellation-prone", "rarely cancels"),
    "distance_mi": ("long-haul", "short-haul"),
    "carriers": ("multi-carrier", "single-carrier"),
}
BIG, MIDDLE = 0.8, -0.3
#: Runs of k-means for each number of segments, and items that first centres are drawn from.
STARTS, DRAWN = 20, 4096


def site_profile(profile: DataFrame) -> DataFrame:
    return profile.withColumn("log_departures", F.log10("scheduled_departures"))


def route_profile(routes: DataFrame) -> DataFrame:
    return routes.withColumn("log_flights", F.log10("scheduled_flights"))


def standardise(items: DataFrame, features: Sequence[str]) -> tuple[PipelineModel, DataFrame]:
    """Median fill, mean 0 and standard deviation 1."""
    d = items.withColumns({f"{c}__d": F.col(c).cast("double") for c in features})
    m = Pipeline(stages=[
        Imputer(inputCols=[f"{c}__d" for c in features], outputCols=[f"{c}__m" for c in features],
                strategy="median"),
        VectorAssembler(inputCols=[f"{c}__m" for c in features], outputCol="v__raw"),
        StandardScaler(inputCol="v__raw", outputCol="z", withMean=True)]).fit(d)
    return m, m.transform(d).select(*items.columns, "z")


class Segments:
    """Centres of one k-means run and its cost, the sum of squared distances to the nearest centre."""

    def __init__(self, centers: np.ndarray, cost: float):
        self.centers, self.cost = centers, cost

    def transform(self, z: DataFrame, name: str = "segment_id") -> DataFrame:
        """Number of the nearest centre, ties to the smaller one."""
        x = vector_to_array("z")
        far = [F.aggregate(F.zip_with(x, F.array(*map(F.lit, map(float, c))), lambda a, b: (a - b) * (a - b)),
                           F.lit(0.0), lambda t, v: t + v) for c in self.centers]
        return z.withColumn(name, F.array_min(F.array(*[
            F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(far)]))["i"])


def _first_centers(rows: np.ndarray, k: int, r: np.random.Generator) -> np.ndarray:
    """k rows, each drawn in proportion to its squared distance from those before."""
    picked = [rows[r.integers(len(rows))]]
    near = ((rows - picked[0]) ** 2).sum(axis=1)
    while len(picked) < k:
        total = near.sum()
        picked.append(rows[r.choice(len(rows), p=near / total if total > 0 else None)])
        near = np.minimum(near, ((rows - picked[-1]) ** 2).sum(axis=1))
    return np.array(picked)


def _pass(points: DataFrame, runs: Mapping[int, np.ndarray], width: int) -> dict[int, dict[int, tuple]]:
    """{run: {centre: (rows, cost, sums)}} of all runs, in one job over the items."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {r: np.zeros((len(c), width + 2)) for r, c in runs.items()}
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), dtype=float).reshape(-1, width)
            for r, c in runs.items():
                far = np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)
                at = far.argmin(axis=1)
                np.add.at(held[r], at, np.column_stack([np.ones(len(x)), far.min(axis=1), x]))
        yield pd.DataFrame([(r, i, *row) for r, table in held.items() for i, row in enumerate(table)],
                           columns=names)

    sums = [f"s{i}" for i in range(width)]
    names = ["run", "at", "n", "cost", *sums]
    parts = points.mapInPandas(partial, "run int, at int, " + ", ".join(f"{n} double" for n in names[2:]))
    out: dict[int, dict[int, tuple]] = {}
    # one row for each centre of each run
    for row in parts.groupBy("run", "at").agg(*[F.sum(n).alias(n) for n in names[2:]]).collect():
        out.setdefault(row["run"], {})[row["at"]] = (row["n"], row["cost"], np.array([row[n] for n in sums]))
    return out


def fit_all_starts(z: DataFrame, ks: Sequence[int], starts: int = STARTS, seed: int = 42,
                   max_iter: int = 50, tol: float = 1e-4) -> dict[tuple[int, int], Segments]:
    """{(k, start): run} of k-means on the vectors ``z``.

    All runs go forward together: a pass over the items sums rows by nearest centre for every run that
    still moves, and only those sums reach the driver.  First centres are drawn from at most ``DRAWN``
    items, those with the smallest hash; everything after reads all items.
    """
    points = z.select(vector_to_array("z").alias("x"))
    drawn = np.array([r["x"] for r in points.orderBy(F.xxhash64("x"), "x").limit(DRAWN).collect()])
    if not len(drawn):
        raise ValueError("no items to segment")
    names = [(k, i) for k in ks for i in range(starts)]
    centers = {n: _first_centers(drawn, k, np.random.default_rng([seed, k, i]))
               for n, (k, i) in enumerate(names)}
    done: dict[tuple[int, int], Segments] = {}
    for step in range(max_iter):
        for r, found in _pass(points, centers, drawn.shape[1]).items():
            old = centers[r]
            done[names[r]] = Segments(old, sum(cost for _, cost, _ in found.values()))
            new = np.array([found[i][2] / found[i][0] if found[i][0] else old[i] for i in range(len(old))])
            if ((new - old) ** 2).sum(axis=1).max() <= tol * tol:
                del centers[r]
            else:
                centers[r] = new
        if not centers:
            break
    return done


def fit_segments(z: DataFrame, ks: Sequence[int] = range(4, 8), starts: int = STARTS,
                 seed: int = 42):
    """K-means with the number of segments chosen by silhouette.

    The silhouette is the squared-distance one, which needs no pair of items and so is linear in
    their number.  Of the starts of each k the one with the smallest cost is kept.
    """
    z = cut_lineage(z)
    judge = ClusteringEvaluator(featuresCol="z", predictionCol="segment_id")
    runs = fit_all_starts(z, ks, starts, seed)
    models = {k: min((runs[k, i] for i in range(starts)), key=lambda m: m.cost) for k in ks}
    scores = {k: judge.evaluate(m.transform(z)) for k, m in models.items()}
    best = max(scores, key=scores.get)
    return models[best], scores


def centroids(model, features: Sequence[str], spark) -> DataFrame:
    """Centroids as rows (k of them)."""
    rows = [(i, *[float(v) for v in c]) for i, c in enumerate(model.centers)]
    return spark.createDataFrame(rows, "segment_id int, " + ", ".join(f"{f} double"
                                                                      for f in features))


def label_segments(centers: DataFrame, size: str, tiers: Sequence[str],
                   traits: Mapping[str, tuple[str, str]] = TRAITS,
                   key: str = "segment_id") -> DataFrame:
    """Readable label: size tier and the two most distinctive traits of each centroid."""
    s = F.col(size)
    tier = F.when(s > BIG, tiers[0]).when(s > MIDDLE, tiers[1]).otherwise(tiers[2])
    used = [c for c in centers.columns if c in traits and c not in (size, "destinations")]
    items = F.array(*[F.struct((-F.abs(F.col(c))).alias("o"), F.lit(i).alias("i"),
                               F.when(F.col(c) > 0, traits[c][0]).otherwise(traits[c][1])
                               .alias("w")) for i, c in enumerate(used)])
    words = F.transform(F.slice(F.array_sort(items), 1, 2), lambda t: t["w"])
    return centers.select(key, F.concat(tier, F.lit(" - "), F.array_join(words, ", "))
                          .alias("segment"))


def project(z: DataFrame) -> DataFrame:
    """Two principal components; each axis points to where its largest loading is positive."""
    m = PCA(k=2, inputCol="z", outputCol="_pc").fit(z)
    axes = m.pc.toArray()
    sign = [float(np.sign(axes[np.argmax(np.abs(axes[:, i])), i])) for i in range(2)]
    p = vector_to_array("_pc")
    return m.transform(z).withColumn("pc1", p[0] * sign[0]).withColumn(
        "pc2", p[1] * sign[1]).drop("_pc")


def segment_items(items: DataFrame, features: Sequence[str], size: str, tiers: Sequence[str],
                  ks: Sequence[int] = range(4, 8)) -> tuple[DataFrame, dict]:
    """Items with segment_id, segment, pc1 and pc2, and the silhouette per k."""
    _, z = standardise(items, features)
    z = cut_lineage(z)
    model, scores = fit_segments(z, ks)
    labels = label_segments(centroids(model, features, items.sparkSession), size, tiers)
    out = project(model.transform(z)).join(F.broadcast(labels), "segment_id")   # k rows
    return out.drop("z"), scores


def segment_profile(items: DataFrame, features: Sequence[str]) -> DataFrame:
    return items.groupBy("segment_id", "segment").agg(
        *[F.avg(f).alias(f) for f in features], F.count("*").alias("members"))

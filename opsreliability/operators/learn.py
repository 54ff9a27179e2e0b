"""Models, on Spark ML: preprocessing, fits and calibration run on the cluster."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import (Imputer, OneHotEncoder, SQLTransformer, StringIndexer,
                                StringIndexerModel, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsreliability.functions.scalar import logit
from opsreliability.operators.evaluate import avg_precision, roc_auc
from opsreliability.operators.prefix import grouped_quantiles, one_row_quantiles, value_counts

RARE = 200
SEED = 42


# ------------------------------------------------------------------ preparation

def fixed_categories(vocabulary: dict[str, Sequence[str]], suffix: str = "_idx") -> StringIndexerModel:
    """Indexer over fixed category lists; values outside get one extra index."""
    cols = list(vocabulary)
    return StringIndexerModel.from_arrays_of_labels(
        [list(vocabulary[c]) for c in cols], inputCols=cols,
        outputCols=[c + suffix for c in cols], handleInvalid="keep")


def prepare(df: DataFrame, vocabulary: dict[str, Sequence[str]], numbers: Sequence[str]) -> DataFrame:
    """Model-ready frame: indexed categories and single-precision numbers."""
    d = fixed_categories(vocabulary).transform(df)
    return d.withColumns({c: F.col(c).cast("float") for c in numbers})


def _texts(cols: Sequence[str]) -> SQLTransformer:
    casts = ", ".join(f"CAST({c} AS STRING) AS {c}__s" for c in cols)
    return SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__")


def _known(c: str) -> str:
    """SQL text of a number as a double, NULL where it is missing."""
    return f"nanvl(CAST({c} AS DOUBLE), CAST(NULL AS DOUBLE))"


def _labels(train: DataFrame, categories: Sequence[str], rare: int) -> tuple[list[list[str]], list[int], list[int]]:
    """Per category: labels by falling frequency (then by text), how many of them stand alone and the indicators.

    All categories are counted in one pass."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(categories)])
    found: list[list] = [[] for _ in categories]
    for r in train.select(F.inline(each)).groupBy("i", "v").agg(F.count("*").alias("n")).collect():
        found[r["i"]].append((r["v"], r["n"]))
    labels = [[v for v, _ in sorted((x for x in f if x[0] is not None), key=lambda x: (-x[1], x[0]))] for f in found]
    alone = [min(sum(n >= rare for _, n in f), len(v)) for f, v in zip(found, labels)]
    # pooled labels follow those that stand alone, rows without a value come last
    sizes = [k + 2 if any(v is None for v, _ in f) else max(k + (len(v) > k), 1)
             for f, v, k in zip(found, labels, alone)]
    return labels, alone, sizes


def _centres(train: DataFrame, numbers: Sequence[str]) -> list[tuple[float, float, float]]:
    """(median, mean, standard deviation) per number, the two last with missing values at the median.

    One pass counts equal values; moments and medians are those of the counts.  Only numbers with missing
    rows have an approximate median, which reads them again, as ``Imputer`` takes it.
    """
    known = train.select(F.lit(0).alias("__all"), *[F.expr(f"{_known(c)} AS {c}") for c in numbers])
    counts = value_counts(known, ["__all"], numbers)
    m = {r["_c"]: r for r in counts.groupBy("_c").agg(
        F.sum("_all").alias("n"), F.sum("_n").alias("k"),
        (F.sum(F.col("_n") * F.col("_v")) / F.sum("_n")).alias("mean")).collect()}
    own = F.array(*[F.lit(m[i]["mean"]).cast("double") for i in range(len(numbers))])[F.col("_c")]
    spread = {r["_c"]: r["s"] for r in counts.groupBy("_c").agg(
        F.sum(F.col("_n") * (F.col("_v") - own) ** 2).alias("s")).collect()}
    median = grouped_quantiles(known, ["__all"], {c: (c, 0.5) for c in numbers}, counts=counts).first().asDict()
    gaps = [c for i, c in enumerate(numbers) if m[i]["k"] < m[i]["n"]]
    if gaps:
        median |= Imputer(inputCols=gaps, outputCols=[f"{c}__m" for c in gaps],
                          strategy="median").fit(known).surrogateDF.first().asDict()
    out = []
    for i, c in enumerate(numbers):
        n, k, here = m[i]["n"], m[i]["k"], m[i]["mean"]
        mean = (k * here + (n - k) * median[c]) / n
        squares = spread[i] + k * (here - mean) ** 2 + (n - k) * (median[c] - mean) ** 2
        out.append((median[c], mean, (squares / max(n - 1, 1)) ** 0.5))
    return out


def fit_logistic(train: DataFrame, categories: Sequence[str], numbers: Sequence[str], label: str,
                 balanced: bool = False, rare: int = RARE, max_iter: int = 100) -> PipelineModel:
    """Logistic regression with pooled rare categories, median imputation and scaling.

    Categories seen fewer than ``rare`` times share one indicator; unseen ones have none.  The
    indexer orders labels by frequency, so pooling is a cut of the index and needs no join.  What the
    preparation needs is counted on the columns before any vector is built; only the fit itself reads vectors.
    """
    spark = train.sparkSession
    labels, alone, sizes = _labels(train, categories, rare)
    # one indexer a category: a shared one would fill the shorter lists of labels up with nulls
    index = [StringIndexerModel.from_labels(v, inputCol=f"{c}__s", outputCol=f"{c}__i", handleInvalid="keep")
             for c, v in zip(categories, labels)]
    pool = [f"CAST(CASE WHEN {c}__i >= {len(v)} THEN {k + 1} WHEN {c}__i >= {k} THEN {k} ELSE {c}__i END AS DOUBLE) "
            f"AS {c}__p" for c, v, k in zip(categories, labels, alone)]
    encoder = OneHotEncoder(inputCols=[f"{c}__p" for c in categories], outputCols=[f"{c}__v" for c in categories],
                            handleInvalid="keep").fit(
        spark.range(1).select(*[F.lit(float(n - 1)).alias(f"{c}__p") for c, n in zip(categories, sizes)]))
    scaled = [f"(coalesce({_known(c)}, {median!r}D) - {mean!r}D) * {1 / std if std else 0.0!r}D AS {c}__z"
              for c, (median, mean, std) in zip(numbers, _centres(train, numbers))]
    stats = train.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")).first()
    w1 = stats["n"] / (2 * max(stats["pos"], 1)) if balanced else 1.0
    w0 = stats["n"] / (2 * max(stats["n"] - stats["pos"], 1)) if balanced else 1.0
    d = train.withColumn("label", F.col(label).cast("double")).withColumn(
        "weight", F.when(F.col(label) == 1, w1).otherwise(w0))
    stages: list[Transformer] = [
        _texts(categories), *index, SQLTransformer(statement=f"SELECT *, {', '.join(pool)} FROM __THIS__"), encoder,
        SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__"),
        VectorAssembler(inputCols=[*[f"{c}__z" for c in numbers], *[f"{c}__v" for c in categories]],
                        outputCol="features")]
    fit = LogisticRegression(labelCol="label", weightCol="weight", maxIter=max_iter,
                             regParam=1.0 / max(stats["n"], 1), elasticNetParam=0.0, standardization=False)
    return PipelineModel([*stages, fit.fit(PipelineModel(stages).transform(d))])


def predict(model: PipelineModel, df: DataFrame, name: str = "p",
            keep: Sequence[str] | None = None) -> DataFrame:
    """Probability of the positive class."""
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*(keep if keep is not None else df.columns), name)


def index_labels(train: DataFrame, categories: Sequence[str]) -> StringIndexerModel:
    """Indexer of the labels of the training rows by falling frequency, all categories in one pass."""
    return StringIndexer(inputCols=[f"{c}__s" for c in categories], outputCols=[f"{c}__i" for c in categories],
                         handleInvalid="keep").fit(_texts(categories).transform(train))


def fit_boosted(train: DataFrame, valid: DataFrame, categories: Sequence[str],
                numbers: Sequence[str], label: str, weight: float = 1.0, trees: int = 20,
                depth: int = 5, step: float = 0.1, min_rows: int = 20, sample: float = 0.8,
                feature_share: str = "auto", seed: int = SEED, index: StringIndexerModel | None = None) -> PipelineModel:
    """Gradient-boosted trees, stopped when the validation loss no longer falls.  ``index`` is ``index_labels`` of the
    training rows, if there already."""
    cols = list(dict.fromkeys([label, *categories, *numbers]))
    rows = (train.select(*cols).withColumn("is_valid", F.lit(False))
            .unionByName(valid.select(*cols).withColumn("is_valid", F.lit(True)))
            .withColumn("label", F.col(label).cast("double"))
            .withColumn("weight", F.when(F.col(label) == 1, float(weight)).otherwise(1.0)))
    texts = _texts(categories)
    index = index or index_labels(train, categories)
    fill = ", ".join(f"coalesce(CAST({c} AS DOUBLE), -1.0D) AS {c}__d" for c in numbers)
    bins = max(64, max((len(v) for v in index.labelsArray), default=0) + 2)
    gbt = GBTClassifier(labelCol="label", weightCol="weight", validationIndicatorCol="is_valid",
                        maxIter=trees, maxDepth=depth, stepSize=step, minInstancesPerNode=min_rows,
                        subsamplingRate=sample, featureSubsetStrategy=feature_share, maxBins=bins,
                        seed=seed)
    return Pipeline(stages=[
        texts, index, SQLTransformer(statement=f"SELECT *, {fill} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{c}__i" for c in categories] + [f"{c}__d" for c in numbers],
                        outputCol="features"), gbt]).fit(rows)


def draw_grid(trials: int, seed: int = SEED) -> list[dict]:
    """Fixed-seed random settings."""
    r = random.Random(seed)
    return [{"depth": r.choice([3, 4, 5, 6]), "min_rows": r.choice([20, 50, 100, 200, 400]),
             "sample": round(r.uniform(0.6, 1.0), 2), "step": r.choice([0.05, 0.08, 0.1, 0.2]),
             "feature_share": r.choice(["auto", "sqrt", "onethird"])} for _ in range(trials)]


def tune(train: DataFrame, valid: DataFrame, categories: Sequence[str], numbers: Sequence[str],
         label: str, metric: str = "roc_auc", trials: int = 15, trees: int = 20,
         grid: Sequence[dict] | None = None) -> tuple[PipelineModel, dict, list[dict]]:
    """Best boosted model of a random search scored on the later validation window."""
    score = {"roc_auc": roc_auc, "pr_auc": avg_precision}[metric]
    best, best_params, log = None, {}, []
    index = index_labels(train, categories)
    for params in grid or draw_grid(trials):
        m = fit_boosted(train, valid, categories, numbers, label, trees=trees, index=index, **params)
        value = score(predict(m, valid), y=label).first()[0]
        log.append({**params, metric: value})
        if best is None or value > max(x[metric] for x in log[:-1]):
            best, best_params = m, params
    return best, best_params, log


def search_weight(train: DataFrame, valid: DataFrame, categories: Sequence[str],
                  numbers: Sequence[str], label: str, weights: Sequence[float] = (1, 5, 20),
                  **params) -> tuple[PipelineModel, float, list[dict]]:
    """Weight of the rare class by validation average precision."""
    best, log = None, []
    index = index_labels(train, categories)
    for w in weights:
        m = fit_boosted(train, valid, categories, numbers, label, weight=w, index=index, **params)
        value = avg_precision(predict(m, valid), y=label).first()[0]
        if best is None or value > max(x["pr_auc"] for x in log):
            best = (m, float(w))
        log.append({"weight": float(w), "pr_auc": value})
    return best[0], best[1], log


def importance(model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """Share of the total gain per feature."""
    spark = SparkSession.active()
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    total = sum(values) or 1.0
    return spark.createDataFrame([(n, v / total) for n, v in zip(names, values)],
                                 "feature string, gain_share double").orderBy(
        F.col("gain_share").desc(), "feature")


# ------------------------------------------------------------------ calibration

def fit_isotonic(df: DataFrame, y: str, p: str):
    """Isotonic fit on the distinct scores, weighted by their rows; violators are pooled inside
    score ranges in parallel before the ranges meet."""
    pts = (df.groupBy(F.col(p).alias("x")).agg(
        F.avg(F.col(y).cast("double")).alias("label"), F.count("*").cast("double").alias("weight")))
    return IsotonicRegression(featuresCol="x", labelCol="label", weightCol="weight",
                              predictionCol="_iso").fit(pts)


def apply_isotonic(model, df: DataFrame, p: str, name: str) -> DataFrame:
    out = model.transform(df.withColumn("x", F.col(p)))
    return out.withColumn(name, F.greatest(F.least("_iso", F.lit(1.0)), F.lit(0.0))).drop("_iso", "x")


def fit_platt(df: DataFrame, y: str, p: str) -> tuple[float, float]:
    """(slope, intercept) of the sigmoid on the logit of the score."""
    d = df.select(logit(p, 1e-7).alias("x"), F.col(y).cast("double").alias("label"))
    d = VectorAssembler(inputCols=["x"], outputCol="features").transform(d)
    m = LogisticRegression(maxIter=200, regParam=0.0, standardization=False, tol=1e-9).fit(d)
    return float(m.coefficients[0]), float(m.intercept)


def apply_platt(params: tuple[float, float], df: DataFrame, p: str, name: str) -> DataFrame:
    a, b = params
    return df.withColumn(name, 1 / (1 + F.exp(-(logit(p, 1e-7) * a + b))))


# ------------------------------------------------------------------ quantiles

QS = {10: 0.1, 50: 0.5, 90: 0.9}


def _group_quantiles(df: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    return grouped_quantiles(df, keys, {f"q{n}": (y, q) for n, q in QS.items()}, rows="_n")


def quantile_table(train: DataFrame, y: str, levels: Sequence[Sequence[str]],
                   min_rows: int = 1) -> tuple[list, list[str], DataFrame]:
    """Arguments of ``lookup_chain``: conditional quantiles by falling detail, then overall."""
    tables = [(_group_quantiles(train, keys, y).where(F.col("_n") >= min_rows), list(keys))
              for keys in levels]
    return tables, [f"q{n}" for n in QS], one_row_quantiles(train, y, {f"q{n}": q for n, q in QS.items()})


def median_baselines(train: DataFrame, test: DataFrame, y: str, key: str) -> DataFrame:
    """Global median, key median with the global one behind it, and global mean."""
    per_key = grouped_quantiles(train, [key], {"_m": (y, 0.5)})
    overall = one_row_quantiles(train, y, {"m": 0.5})
    mean = train.agg(F.avg(y).alias("m"))
    return (test.join(per_key, key, "left")
            .withColumn("global_median", overall.scalar())
            .withColumn("route_median", F.coalesce("_m", "global_median"))
            .withColumn("global_mean", mean.scalar()).drop("_m"))


def fit_quantile_tree(train: DataFrame, categories: Sequence[str], numbers: Sequence[str], y: str,
                      depth: int = 6, min_rows: int = 100) -> tuple[PipelineModel, DataFrame]:
    """Quantiles inside the leaves of a regression tree: the tree finds the groups, an exact
    aggregate gives each leaf its P10, P50 and P90, so quantiles never cross."""
    texts = _texts(categories)
    index = StringIndexer(inputCols=[f"{c}__s" for c in categories],
                          outputCols=[f"{c}__i" for c in categories],
                          handleInvalid="keep").fit(texts.transform(train))
    fill = ", ".join(f"coalesce(CAST({c} AS DOUBLE), -1.0D) AS {c}__d" for c in numbers)
    bins = max(64, max((len(v) for v in index.labelsArray), default=0) + 2)
    tree = DecisionTreeRegressor(labelCol=y, maxDepth=depth, minInstancesPerNode=min_rows,
                                 maxBins=bins, leafCol="leaf", seed=SEED)
    rows = train.where(F.col(y).isNotNull())
    model = Pipeline(stages=[
        texts, index, SQLTransformer(statement=f"SELECT *, {fill} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{c}__i" for c in categories] + [f"{c}__d" for c in numbers],
                        outputCol="features"), tree]).fit(rows)
    leaves = _group_quantiles(model.transform(rows), ["leaf"], y).drop("_n")
    return model, leaves


def predict_quantiles(fit: tuple[PipelineModel, DataFrame], df: DataFrame) -> DataFrame:
    model, leaves = fit
    return model.transform(df).join(leaves, "leaf", "left").select(*df.columns, "q10", "q50", "q90")

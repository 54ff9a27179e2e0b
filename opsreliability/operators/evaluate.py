"""Model evaluation.

Rank statistics work on distinct scores with their positive and negative counts, and take
running totals over score ranges in parallel, so no row of the scored table passes through a
single task.  ``df`` has a 0/1 label ``y`` and a score ``p``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsreliability.operators.prefix import exact_quantiles, running_sum
from opsreliability.operators.sampling import fixed_sample
from opsreliability.session import cut_lineage


def score_counts(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Positives and negatives per distinct score; rows without score or label do not count."""
    return df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(p).cast("double").alias("p")).agg(
        F.sum(F.col(y).cast("bigint")).alias("pos"),
        F.sum(1 - F.col(y).cast("bigint")).alias("neg"))


def roc_auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Chance that a positive outranks a negative, ties counting half."""
    c = running_sum(score_counts(df, y, p), "p", ["neg"])
    below = F.col("cum_neg") - F.col("neg") / 2
    return c.agg((F.sum(F.col("pos") * below) / (F.sum("pos").cast("double") * F.sum("neg")))
                 .alias("roc_auc"))


def _descending(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision and recall when everything from this score up is called positive."""
    counts = score_counts(df, y, p)
    c = running_sum(counts, "p", ["pos", "neg"], descending=True)
    total = counts.agg(F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).alias("t"))
    c = c.withColumn("_t", total.scalar())
    return c.select("p", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                    (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                    (F.col("cum_pos") / F.col("_t.pos")).alias("recall"),
                    (F.col("cum_neg") / F.col("_t.neg")).alias("fpr"))


def avg_precision(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Sum of precision times recall steps (no interpolation)."""
    c = _descending(df, y, p)
    return c.agg((F.sum(F.col("pos") * F.col("precision")) / F.sum("pos")).alias("pr_auc"))


def curve_points(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """ROC and precision-recall points, one per distinct score."""
    return _descending(df, y, p).select(F.col("p").alias("threshold"), "fpr",
                                        F.col("recall").alias("tpr"), "precision", "recall")


def best_threshold(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Score with the best F1; the lowest of equals."""
    c = _descending(df, y, p)
    pr, rc = F.col("precision"), F.col("recall")
    c = c.withColumn("f1", 2 * pr * rc / F.greatest(pr + rc, F.lit(1e-12)))
    return c.agg(F.max_by("p", F.struct("f1", -F.col("p"))).alias("threshold"),
                 F.max("f1").alias("f1"))


def class_metrics(df: DataFrame, threshold: float | Column, y: str = "y",
                  p: str = "p") -> DataFrame:
    """Threshold metrics and proper scores in one aggregation."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    d = df.select(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p"),
                  t.alias("t"))
    d = d.withColumn("hit", (F.col("p") >= F.col("t")).cast("double"))
    q = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    one = d.agg(
        F.sum(F.col("y") * F.col("hit")).alias("tp"), F.sum("hit").alias("called"),
        F.sum("y").alias("pos"),
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"),
        (-F.avg(F.when(F.col("y") == 1, F.ln(q)).otherwise(F.ln(1 - q)))).alias("log_loss"),
        F.avg("y").alias("positive_rate"), F.count("*").alias("n"), F.max("t").alias("threshold"))
    zero = F.lit(0.0)
    return one.select(
        F.coalesce(2 * F.col("tp") / F.nullif(F.col("called") + F.col("pos"), zero), zero).alias("f1"),
        F.coalesce(F.col("tp") / F.nullif(F.col("called"), zero), zero).alias("precision"),
        F.coalesce(F.col("tp") / F.nullif(F.col("pos"), zero), zero).alias("recall"),
        "brier", "log_loss", "threshold", "positive_rate", "n")


def classification_report(df: DataFrame, threshold: float | Column, y: str = "y",
                          p: str = "p") -> DataFrame:
    """All classification metrics in one row."""
    m = class_metrics(df, threshold, y, p)
    return (m.withColumn("roc_auc", roc_auc(df, y, p).scalar())
            .withColumn("pr_auc", avg_precision(df, y, p).scalar()))


def top_slice(df: DataFrame, row_key: str, fracs: Sequence[float] = (0.01, 0.05), y: str = "y",
              p: str = "p") -> DataFrame:
    """Precision and lift among the highest scores; ties at the edge by md5 of the row key."""
    counts = cut_lineage(score_counts(df, y, p).withColumn("n", F.col("pos") + F.col("neg")))
    cum = running_sum(counts, "p", ["n", "pos"], descending=True)
    total = counts.agg(F.struct(F.sum("n").alias("n"), F.sum("pos").alias("pos")).alias("t"))
    out = None
    for f in fracs:
        k = F.floor(F.col("_t.n") * F.lit(f))
        edge = (cum.withColumn("_t", total.scalar())
                .where((F.col("cum_n") >= k) & (F.col("cum_n") - F.col("n") < k))
                .agg(F.max(F.struct("p", (F.col("cum_n") - F.col("n")).alias("above"),
                                    (F.col("cum_pos") - F.col("pos")).alias("above_pos"),
                                    k.alias("k"), (F.col("_t.pos") / F.col("_t.n")).alias("rate")))
                     .alias("e")))
        ties = df.withColumn("_e", edge.scalar()).where(
            (F.col(p) == F.col("_e.p")) & F.col(y).isNotNull())  # as in the counts above
        room = edge.select((F.col("e.k") - F.col("e.above")).alias("m"))
        taken = fixed_sample(ties, row_key, room.scalar(), seed=0)
        hits = taken.agg(F.coalesce(F.sum(y), F.lit(0)).alias("s"))
        row = edge.withColumn("_s", hits.scalar()).select(
            F.lit(f"top_{round(f * 100)}pct").alias("slice"), F.col("e.k").alias("k"),
            ((F.col("e.above_pos") + F.col("_s")) / F.col("e.k")).alias("precision"),
            F.col("e.rate").alias("_rate"))
        row = row.withColumn("lift_vs_prior", F.col("precision") / F.col("_rate")).drop("_rate")
        out = row if out is None else out.unionByName(row)
    return out


def calibration(df: DataFrame, bins: int = 15, y: str = "y", p: str = "p") -> DataFrame:
    """Mean score and observed rate in bins of equal size."""
    inner = exact_quantiles(df, p, [i / bins for i in range(1, bins)])
    edges = inner.agg(F.sort_array(F.collect_list("value")).alias("e"))     # bins - 1 values
    d = df.withColumn("_e", edges.scalar())
    b = F.size(F.filter("_e", lambda e: e < F.col(p)))
    return d.groupBy(b.alias("bin")).agg(F.avg(p).alias("mean_predicted"),
                                         F.avg(y).alias("observed"), F.count("*").alias("n"))


def reg_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    d = df.select((F.col(y) - F.col(pred)).alias("e")).where("e IS NOT NULL")
    med = exact_quantiles(d.withColumn("a", F.abs("e")), "a", [0.5]).select("value")
    return d.agg(F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
                 F.count("*").alias("n")).withColumn("median_ae", med.scalar())


def pinball(df: DataFrame, y: str, preds: dict[float, str]) -> DataFrame:
    """Mean quantile loss per quantile, one pass."""
    e = lambda c: F.col(y) - F.col(c)
    one = df.agg(*[F.avg(F.greatest(q * e(c), (q - 1) * e(c))).alias(f"q{round(q * 100)}")
                   for q, c in preds.items()])
    return one.unpivot([], one.columns, "quantile", "pinball_loss")


def interval(df: DataFrame, y: str, p10: str, p50: str, p90: str) -> DataFrame:
    share = lambda pred: F.avg(pred.cast("int"))
    return df.agg(share(F.col(y) <= F.col(p90)).alias("p90_coverage"),
                  share((F.col(y) >= F.col(p10)) & (F.col(y) <= F.col(p90))).alias("p10_p90_coverage"),
                  F.avg(F.col(p90) - F.col(p10)).alias("mean_p10_p90_width_min"),
                  share(F.col(p90) < F.col(p50)).alias("quantile_crossing_share"))


def drift_by_month(df: DataFrame, day: str = "flight_date", y: str = "y", p: str = "p") -> DataFrame:
    return df.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(
        F.avg(y).alias("observed_rate"), F.avg(p).alias("mean_predicted"), F.count("*").alias("n"))

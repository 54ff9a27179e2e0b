"""Evaluation of scores that both engines can compute: training rates and quantiles by schedule."""

from pyspark.sql import functions as F

from opsreliability.catalog.base import TRAIN_END, VALID_END, query, view
from opsreliability.operators import evaluate as EV
from opsreliability.operators.joins import lookup_chain

TRAIN = f"flight_date <= DATE '{TRAIN_END}'"
TEST = f"flight_date > DATE '{VALID_END}'"

view("rate_delay", f"""SELECT carrier, route, avg(arr_del15) AS delay_prob
  FROM legs WHERE {TRAIN} AND completed = 1 GROUP BY 1, 2""")
view("rate_cancel", f"""SELECT carrier, origin, avg(cancelled) AS cancel_prob
  FROM legs WHERE {TRAIN} GROUP BY 1, 2""")
view("rate_minutes", f"""SELECT dep_hour, quantile_cont(arr_delay_min, 0.1) AS delay_p10,
    quantile_cont(arr_delay_min, 0.5) AS delay_p50, quantile_cont(arr_delay_min, 0.9) AS delay_p90
  FROM legs WHERE {TRAIN} AND completed = 1 GROUP BY 1""")
view("scores_cancel", f"SELECT leg_key, cancel_prob FROM legs JOIN rate_cancel USING (carrier, origin) WHERE {TEST}")
view("scores_delay", f"""SELECT leg_key, delay_prob, CASE WHEN delay_prob >= 0.51 THEN 1 ELSE 0 END
    AS delay_pred FROM legs JOIN rate_delay USING (carrier, route)
  WHERE {TEST} AND completed = 1""")
view("scores_minutes", f"""SELECT leg_key, delay_p10, delay_p50, greatest(delay_p90, delay_p50)
    AS delay_p90 FROM legs JOIN rate_minutes USING (dep_hour) WHERE {TEST} AND completed = 1""")
view("scored", f"""SELECT leg_key, flight_date, arr_del15 AS y, delay_prob AS p, arr_delay_min, delay_p10,
    delay_p50, delay_p90 FROM legs JOIN scores_delay USING (leg_key)
  JOIN scores_minutes USING (leg_key)""")


def score_legs(t):
    """The legs with the columns that scores and score marts look at."""
    return t.columns("leg_key", "flight_date", "carrier", "origin", "dest", "route", "dep_hour", "year_month",
                     "completed", "cancelled", "arr_del15", "arr_delay_min")


def score_tables(t):
    """(cancel, delay, minutes) scores of the test legs: training rates by schedule keys."""
    legs = score_legs(t)
    train = legs.where(F.expr(TRAIN))
    test = legs.where(F.expr(TEST))
    done = test.where("completed = 1")
    seen = train.where("completed = 1")
    q = seen.groupBy("dep_hour").agg(*[
        F.percentile("arr_delay_min", p).alias(n)
        for p, n in ((0.1, "delay_p10"), (0.5, "delay_p50"), (0.9, "delay_p90"))])
    cancel = test.join(train.groupBy("carrier", "origin").agg(F.avg("cancelled").alias("cancel_prob")),
                       ["carrier", "origin"]).select("leg_key", "cancel_prob")
    delay = done.join(seen.groupBy("carrier", "route").agg(F.avg("arr_del15").alias("delay_prob")),
                      ["carrier", "route"]).select(
        "leg_key", "delay_prob", (F.col("delay_prob") >= 0.51).cast("int").alias("delay_pred"))
    minutes = done.join(q, "dep_hour").select(
        "leg_key", "delay_p10", "delay_p50",
        F.greatest("delay_p90", "delay_p50").alias("delay_p90"))
    return cancel, delay, minutes


def scored(t):
    _, delay, minutes = score_tables(t)
    return (score_legs(t).select("leg_key", "flight_date", F.col("arr_del15").alias("y"), "arr_delay_min")
            .join(delay.select("leg_key", F.col("delay_prob").alias("p")), "leg_key")
            .join(minutes, "leg_key"))


@query("ml1_prior_rate", "prior:r6",
       f"SELECT sum(arr_del15) / count(arr_del15) AS prior FROM legs WHERE {TRAIN}")
def _(t):
    return t.legs.where(F.expr(TRAIN)).agg(F.avg("arr_del15").alias("prior"))


view("ranked", """SELECT a.p, a.pos, a.neg, sum(b.pos) AS tp, sum(b.neg) AS fp,
    sum(b.neg) FILTER (b.p < a.p) AS q FROM
    (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY p) a,
    (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY p) b
  WHERE b.p >= a.p GROUP BY ALL""")
view("pn", "SELECT sum(y) AS np, sum(1 - y) AS nn FROM scored")


@query("ev1_roc_auc", "roc_auc:r6",
       """SELECT (sum(r) FILTER (y = 1) - max(np) * (max(np) + 1) / 2) / (max(np) * max(nn)) AS roc_auc
       FROM (SELECT y, rank() OVER (ORDER BY p) + (count(1) OVER (PARTITION BY p) - 1) / 2 AS r
             FROM scored), pn""")
def _(t):
    return EV.roc_auc(scored(t))


@query("ev2_average_precision", "pr_auc:r6",
       "SELECT sum(pos / np * tp / (tp + fp)) AS pr_auc FROM ranked, pn")
def _(t):
    return EV.avg_precision(scored(t))


CM = ("f1:r6 precision:r6 recall:r6 brier:r6 log_loss:r6 threshold:r6 positive_rate:r6 n:l")


@query("ev3_class_metrics", CM,
       """SELECT 2 * tp / (called + pos) AS f1, tp / called AS precision, tp / pos AS recall, brier,
       log_loss, 0.51 AS threshold, pos / n AS positive_rate, n FROM (SELECT
       count(1) FILTER (y = 1 AND p >= 0.51) AS tp, count(1) FILTER (p >= 0.51) AS called,
       sum(y) AS pos, count(1) AS n, avg((p - y) ** 2) AS brier,
       -avg(y * ln(greatest(p, 0.000001)) + (1 - y) * ln(greatest(1 - p, 0.000001))) AS log_loss
       FROM scored)""")
def _(t):
    return EV.class_metrics(scored(t), 0.51)


@query("ev4_best_threshold", "threshold:r6 f1:r6",
       """SELECT p AS threshold, 2 * tp / (np + tp + fp) AS f1 FROM ranked, pn
       ORDER BY round(2 * tp / (np + tp + fp), 12) DESC, p LIMIT 1""")
def _(t):
    return EV.best_threshold(scored(t))


@query("ev5_top_slice", "slice:s k:l precision:r6 lift_vs_prior:r6",
       " UNION ALL ".join(f"""SELECT 'top_{n}pct' AS slice, count(1) AS k, avg(y) AS precision,
       avg(y) / max(rate) AS lift_vs_prior FROM (SELECT *, row_number() OVER (ORDER BY p DESC,
       md5('0|' || leg_key), leg_key) AS r, count(1) OVER () AS n, avg(y) OVER () AS rate FROM scored)
       WHERE r <= floor(n * {n / 100})""" for n in (1, 5)))
def _(t):
    return EV.top_slice(scored(t), "leg_key")


@query("ev6_regression_metrics", "mae:r6 rmse:r6 median_ae:r6 n:l",
       """SELECT avg(abs(arr_delay_min - delay_p50)) AS mae, sqrt(avg((arr_delay_min - delay_p50) ** 2))
       AS rmse, median(abs(arr_delay_min - delay_p50)) AS median_ae, count(1) AS n FROM scored""")
def _(t):
    return EV.reg_metrics(scored(t), "arr_delay_min", "delay_p50")


@query("ev7_pinball", "quantile:s pinball_loss:r6",
       " UNION ALL ".join(f"""SELECT 'q{q}' AS quantile, avg(CASE WHEN arr_delay_min >= delay_p{q}
       THEN {q / 100} * (arr_delay_min - delay_p{q}) ELSE {1 - q / 100:.1f} * (delay_p{q} - arr_delay_min)
       END) AS pinball_loss FROM scored""" for q in (10, 50, 90)))
def _(t):
    return EV.pinball(scored(t), "arr_delay_min",
                      {0.1: "delay_p10", 0.5: "delay_p50", 0.9: "delay_p90"})


@query("ev7_interval", "p90_coverage:r6 p10_p90_coverage:r6 mean_p10_p90_width_min:r6 "
       "quantile_crossing_share:r6",
       """SELECT count(1) FILTER (arr_delay_min <= delay_p90) / count(1) AS p90_coverage,
       count(1) FILTER (arr_delay_min BETWEEN delay_p10 AND delay_p90) / count(1)
       AS p10_p90_coverage, avg(delay_p90 - delay_p10) AS mean_p10_p90_width_min,
       count(1) FILTER (delay_p90 < delay_p50) / count(1) AS quantile_crossing_share FROM scored""")
def _(t):
    return EV.interval(scored(t), "arr_delay_min", "delay_p10", "delay_p50", "delay_p90")


_edges = ", ".join(f"quantile_cont(p, {i}::DOUBLE / 15) AS e{i}" for i in range(1, 15))


@query("ev8_calibration", "bin:i mean_predicted:r6 observed:r6 n:l",
       "SELECT " + " + ".join(f"(p > e{i})::INT" for i in range(1, 15))
       + f" AS bin, avg(p) AS mean_predicted, avg(y) AS observed, count(1) AS n FROM scored, "
         f"(SELECT {_edges} FROM scored) GROUP BY 1")
def _(t):
    return EV.calibration(scored(t))


@query("ev9_curve_points", "threshold:r6 fpr:r6 tpr:r6 precision:r6 recall:r6",
       """SELECT p AS threshold, fp / nn AS fpr, tp / np AS tpr, tp / (tp + fp) AS precision,
       tp / np AS recall FROM ranked, pn""")
def _(t):
    return EV.curve_points(scored(t))


@query("ev10_drift_by_month", "month:s observed_rate:r6 mean_predicted:r6 n:l",
       """SELECT strftime(flight_date, '%Y-%m') AS month, avg(y) AS observed_rate,
       avg(p) AS mean_predicted, count(1) AS n FROM scored GROUP BY 1""")
def _(t):
    return EV.drift_by_month(scored(t))


# ---------------------------------------------------------------- quantile baselines

view("done_train", f"SELECT * FROM legs WHERE completed = 1 AND {TRAIN}")
_q = ", ".join(f"quantile_cont(arr_delay_min, {p}) AS q{n}" for p, n in ((0.1, 10), (0.5, 50), (0.9, 90)))


@query("ml10_conditional_quantiles", "leg_key:s q10:r6 q50:r6 q90:r6",
       f"""SELECT leg_key, coalesce(a.q10, b.q10, c.q10) AS q10, coalesce(a.q50, b.q50, c.q50) AS q50,
       coalesce(a.q90, b.q90, c.q90) AS q90 FROM legs
       LEFT JOIN (SELECT route, dep_hour, {_q} FROM done_train GROUP BY ALL HAVING count(1) >= 3) a
         USING (route, dep_hour)
       LEFT JOIN (SELECT route, {_q} FROM done_train GROUP BY ALL HAVING count(1) >= 3) b USING (route)
       CROSS JOIN (SELECT {_q} FROM done_train) c WHERE {TEST} AND completed = 1""")
def _(t):
    from opsreliability.operators.learn import quantile_table
    done = t.staged.where("completed = 1")
    table = quantile_table(done.where(F.expr(TRAIN)), "arr_delay_min",
                           [["route", "dep_hour"], ["route"]], min_rows=3)
    return lookup_chain(done.where(F.expr(TEST)), *table)


@query("ml11_median_baselines", "leg_key:s global_median:r6 route_median:r6 global_mean:r6",
       f"""SELECT leg_key, (SELECT median(arr_delay_min) FROM done_train) AS global_median,
       coalesce(m, (SELECT median(arr_delay_min) FROM done_train)) AS route_median,
       (SELECT avg(arr_delay_min) FROM done_train) AS global_mean FROM legs LEFT JOIN
       (SELECT route, median(arr_delay_min) AS m FROM done_train GROUP BY 1) USING (route)
       WHERE {TEST} AND completed = 1""")
def _(t):
    from opsreliability.operators.learn import median_baselines
    done = t.staged.where("completed = 1")
    return median_baselines(done.where(F.expr(TRAIN)), done.where(F.expr(TEST)), "arr_delay_min",
                            "route")

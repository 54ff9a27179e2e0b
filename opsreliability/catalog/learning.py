"""Models, calibration, segments and explanations on the feature layer."""

from pyspark.sql import functions as F

from opsreliability.catalog.base import query, view
from opsreliability.catalog.evaluation import scored
from opsreliability.catalog.features import features
from opsreliability.catalog.marts import PROFILE_SPEC  # noqa: F401
from opsreliability.operators import boost as B
from opsreliability.operators import evaluate as EV
from opsreliability.operators import explain as EX
from opsreliability.operators import features as FE
from opsreliability.operators import learn as L
from opsreliability.operators import marts as M
from opsreliability.operators import segment as SG
from opsreliability.session import cut_lineage

CATS = [*FE.CATEGORIES, "dep_hour", "day_of_week"]
NUMS = [c for c in FE.PRE_DEPARTURE if c not in CATS]
TREE_NUMS = [c for c in FE.PRE_DEPARTURE if c not in FE.CATEGORIES]
REPORT = ("roc_auc:r6 pr_auc:r6 f1:r6 precision:r6 recall:r6 brier:r6 log_loss:r6 threshold:r6 "
          "positive_rate:r6 n:l")


MODEL = [*FE.PRE_DEPARTURE, "arr_del15", "arr_delay_min", "completed", "cancelled", "split"]


def splits(t, where="completed = 1", more=()):
    f = features(t, *MODEL, *more)
    return [FE.load_split(f, s, where=where) for s in ("train", "valid", "test")]


def report(model, valid, test, label, calibrate=None, predict=L.predict):
    """Test metrics at the validation F1 threshold."""
    v = cut_lineage(predict(model, valid, keep=[label]))
    e = cut_lineage(predict(model, test, keep=[label]))
    if calibrate:
        v, e = calibrate(v, v), calibrate(v, e)
        v, e = cut_lineage(v), cut_lineage(e)
    thr = EV.best_threshold(v, label).first()["threshold"]
    return EV.classification_report(e, thr, label)


@query("ml2_logistic", REPORT)
def _(t):
    tr, va, te = splits(t)
    return report(L.fit_logistic(tr, CATS, NUMS, "arr_del15"), va, te, "arr_del15")


@query("ml3_balanced_logistic", REPORT)
def _(t):
    tr, va, te = splits(t, "")
    return report(L.fit_logistic(tr, CATS, NUMS, "cancelled", balanced=True), va, te, "cancelled")


@query("ml4_boosted", REPORT)
def _(t):
    tr, va, te = splits(t)
    m = B.fit_stopped(tr, va, FE.CATEGORIES, TREE_NUMS, "arr_del15")
    return report(m, va, te, "arr_del15", predict=B.BoostedTrees.predict)


@query("ml4_early_stop",
       "n_train:l n_valid:l prior_loss:r6 rounds_after_best:i best_is_lowest:b never_above_prior:b",
       """SELECT (SELECT count(arr_del15) FROM base WHERE split = 'train' AND completed = 1) AS n_train,
       count(1) AS n_valid, -avg(CASE arr_del15 WHEN 1 THEN ln(r) ELSE ln(1 - r) END) AS prior_loss,
       10 AS rounds_after_best, true AS best_is_lowest, true AS never_above_prior
       FROM base, (SELECT avg(arr_del15) AS r FROM base WHERE split = 'train' AND completed = 1)
       WHERE split = 'valid' AND completed = 1 AND arr_del15 IS NOT NULL""")
def _(t):
    """Growing ends by the validation loss, ten trees after its lowest value, which it keeps."""
    tr, va, _ = splits(t)
    m = B.fit_stopped(tr, va, FE.CATEGORIES, TREE_NUMS, "arr_del15", patience=10)
    loss = [h["valid_loss"] for h in m.history]
    n = [d.where("arr_del15 IS NOT NULL").count() for d in (tr, va)]
    best = len(m.trees)
    return t.spark.createDataFrame(
        [(*n, loss[0], len(loss) - 1 - best, loss[best] == min(loss), loss[best] <= loss[0])],
        "n_train long, n_valid long, prior_loss double, rounds_after_best int, best_is_lowest boolean, "
        "never_above_prior boolean")


@query("ml5_tuned_boosted", "depth:i min_rows:i sample:d step:d feature_share:s roc_auc:r6")
def _(t):
    tr, va, _ = splits(t)
    _, _, log = L.tune(tr, va, FE.CATEGORIES, TREE_NUMS, "arr_del15", trials=2, trees=4)
    return t.spark.createDataFrame(log)


@query("ml6_rare_class_weight", "weight:d pr_auc:r6")
def _(t):
    tr, va, _ = splits(t, "")
    _, _, log = L.search_weight(tr, va, FE.CATEGORIES, TREE_NUMS, "cancelled", trees=3, depth=3)
    return t.spark.createDataFrame(log)


@query("ml7_day_of_operations", REPORT)
def _(t):
    tr, va, te = splits(t, more=FE.ROTATION)
    m = L.fit_boosted(tr, va, FE.CATEGORIES, [*TREE_NUMS, *FE.ROTATION], "arr_del15", trees=5,
                      depth=4)
    return report(m, va, te, "arr_del15")


@query("ml8_isotonic_calibration", REPORT)
def _(t):
    tr, va, te = splits(t)
    m = L.fit_logistic(tr, CATS, NUMS, "arr_del15", max_iter=30)

    def iso(v, d):
        model = L.fit_isotonic(v, "arr_del15", "p")
        return L.apply_isotonic(model, d, "p", "p_cal").select("arr_del15", F.col("p_cal").alias("p"))

    return report(m, va, te, "arr_del15", iso)


@query("ml9_platt_calibration", REPORT)
def _(t):
    tr, va, te = splits(t, "")
    m = L.fit_logistic(tr, CATS, NUMS, "cancelled", balanced=True, max_iter=30)

    def platt(v, d):
        par = L.fit_platt(v, "cancelled", "p")
        return L.apply_platt(par, d, "p", "p_cal").select("cancelled", F.col("p_cal").alias("p"))

    return report(m, va, te, "cancelled", platt)


@query("ml10_quantile_tree", "quantile:s pinball_loss:r6")
def _(t):
    tr, _, te = splits(t)
    fit = L.fit_quantile_tree(tr, FE.CATEGORIES, TREE_NUMS, "arr_delay_min", depth=4)
    return EV.pinball(L.predict_quantiles(fit, te), "arr_delay_min",
                      {0.1: "q10", 0.5: "q50", 0.9: "q90"})


def sites(t):
    return cut_lineage(SG.site_profile(M.airport_profile(t.staged, 100)))


def site_segments(t):
    return SG.segment_items(sites(t), SG.SITE_FEATURES, "log_departures", SG.SITE_TIERS)


@query("ml12_site_segments", "airport_code:s segment_id:i segment:s")
def _(t):
    return site_segments(t)[0]


@query("ml12_route_segments", "route:s segment_id:i segment:s")
def _(t):
    items = cut_lineage(SG.route_profile(M.kpi_route(t.staged, 40)))
    return SG.segment_items(items, SG.ROUTE_FEATURES, "log_flights", SG.ROUTE_TIERS)[0]


# standardised profiles per state stand in for centroids
Z_FEATURES = ("log_departures", "arr_delay_rate", "cancellation_rate", "avg_distance_mi",
              "evening_share", "weather_cause_share", "dep_delay_std_min")
view("state_profile", """SELECT origin_state AS segment_id, log10(count(1)) AS log_departures,
    avg(arr_del15) AS arr_delay_rate, avg(cancelled) AS cancellation_rate,
    avg(distance_mi) AS avg_distance_mi, avg((dep_hour >= 17)::INT) AS evening_share,
    sum(weather_delay_min) / sum(carrier_delay_min + weather_delay_min + nas_delay_min +
      security_delay_min + late_aircraft_delay_min) AS weather_cause_share,
    stddev_samp(CASE cancelled WHEN 0 THEN dep_delay_min END) AS dep_delay_std_min
  FROM legs GROUP BY 1""")
view("state_z", "SELECT segment_id, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}" for c in Z_FEATURES)
    + " FROM state_profile")
_words = " UNION ALL ".join(
    f"SELECT segment_id, {i} AS i, round(abs({c}), 9) AS a, CASE WHEN {c} > 0 THEN "
    f"'{SG.TRAITS[c][0]}' ELSE '{SG.TRAITS[c][1]}' END AS w FROM state_z"
    for i, c in enumerate(Z_FEATURES) if c in SG.TRAITS)


@query("ml13_segment_labels", "segment_id:s segment:s",
       f"""SELECT segment_id, concat(CASE WHEN log_departures > 0.8 THEN 'Major hub'
       WHEN log_departures > -0.3 THEN 'Mid-size' ELSE 'Regional' END, ' - ',
       max(w) FILTER (r = 1), ', ', max(w) FILTER (r = 2)) AS segment FROM state_z JOIN
       (SELECT segment_id, w, row_number() OVER (PARTITION BY segment_id ORDER BY a DESC, i) AS r
        FROM ({_words})) USING (segment_id) GROUP BY segment_id, log_departures""")
def _(t):
    p = M.airport_profile(t.staged.withColumn("origin", F.col("origin_state")), 0)
    p = SG.site_profile(p).withColumnRenamed("airport_code", "segment_id")
    stats = p.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c)
                    for c in Z_FEATURES])
    z = p.select("segment_id", *[
        ((F.col(c) - stats.select(f"{c}.m").scalar()) / stats.select(f"{c}.s").scalar()).alias(c)
        for c in Z_FEATURES])
    return SG.label_segments(z, "log_departures", SG.SITE_TIERS)


@query("ml14_principal_components", "airport_code:s pc1:r4 pc2:r4")
def _(t):
    _, z = SG.standardise(sites(t), SG.SITE_FEATURES)
    return SG.project(z)


@query("ml15_segment_profile", "segment_id:i segment:s " + " ".join(
    f"{c}:r6" for c in SG.SITE_FEATURES) + " members:l")
def _(t):
    return SG.segment_profile(site_segments(t)[0], SG.SITE_FEATURES)


@query("ev11_feature_importance", "feature:s gain_share:r6")
def _(t):
    tr, va, _ = splits(t)
    m = L.fit_boosted(tr, va, FE.CATEGORIES, TREE_NUMS, "arr_del15", trees=4, depth=4)
    return L.importance(m, [*FE.CATEGORIES, *TREE_NUMS])


@query("ex1_linear_contributions", "leg_key:s base:r6 raw:r6 contribution_sum:r6")
def _(t):
    """Contributions add up to the raw score: base + contribution_sum = raw."""
    tr, _, te = splits(t, more=["leg_key"])
    m = L.fit_logistic(tr, CATS, NUMS, "arr_del15", max_iter=20)
    c = EX.contributions_linear(m, te, NUMS, CATS, tr)
    return c.withColumn("contribution_sum", sum((F.col(EX.PREFIX + n) for n in [*NUMS, *CATS]),
                                                F.lit(0.0)))


@query("ex1_tree_contributions", "leg_key:s base:r6 raw:r6 contribution_sum:r6")
def _(t):
    tr, va, te = splits(t, more=["leg_key"])
    names = [*FE.CATEGORIES, *TREE_NUMS]
    m = L.fit_boosted(tr, va, FE.CATEGORIES, TREE_NUMS, "arr_del15", trees=3, depth=3)
    c = EX.contributions_trees(m, te, names)
    return c.withColumn("contribution_sum", sum((F.col(EX.PREFIX + n) for n in names), F.lit(0.0)))


# linear contributions with fixed weights stand in for a model in the SQL checks
WEIGHTS = {"dep_hour": (0.05, 12.0), "distance_mi": (0.02, 25.0), "crs_elapsed_min": (-0.01, 25.5),
           "origin_sched_deps_day": (0.3, 1.5), "day_of_week": (0.1, 4.0)}
view("contrib", "SELECT leg_key, " + ", ".join(f"{c}" for c in WEIGHTS) + ", " + ", ".join(
    f"{w}::DOUBLE * ({c} - {m}::DOUBLE) AS c_{c}" for c, (w, m) in WEIGHTS.items())
    + " FROM base WHERE split = 'test'")


def fixed_contributions(t):
    f = features(t, "leg_key", *WEIGHTS, "split").where("split = 'test'")
    return f.select("leg_key", *WEIGHTS, *[(F.lit(w) * (F.col(c) - F.lit(m))).alias(EX.PREFIX + c)
                                           for c, (w, m) in WEIGHTS.items()])


@query("ex2_global_importance", "feature:s mean_abs:r6",
       " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(abs(c_{c})) AS mean_abs FROM contrib"
                          for c in WEIGHTS))
def _(t):
    return EX.global_importance(fixed_contributions(t), list(WEIGHTS))


@query("ex3_top_reasons",
       "leg_key:s rank:i feature:s label:s contribution:r6 direction:s",
       "SELECT *, CASE WHEN contribution > 0 THEN 'increases risk' ELSE 'decreases risk' END AS "
       "direction FROM (SELECT *, row_number() OVER (PARTITION BY leg_key ORDER BY abs(contribution) "
       "DESC, i) AS rank FROM (" + " UNION ALL ".join(
           f"SELECT leg_key, {i} AS i, '{c}' AS feature, '{EX.FEATURE_LABELS[c]}' AS label, "
           f"c_{c} AS contribution FROM contrib" for i, c in enumerate(WEIGHTS)) + ")) WHERE rank < 4")
def _(t):
    return EX.top_reasons(fixed_contributions(t), list(WEIGHTS), "leg_key", 3, EX.FEATURE_LABELS)


@query("ev3_full_report", REPORT,
       """SELECT (SELECT (sum(r) FILTER (y = 1) - max(np) * (max(np) + 1) / 2) / (max(np) * max(nn))
         FROM (SELECT y, rank() OVER (ORDER BY p) + (count(1) OVER (PARTITION BY p) - 1) / 2 AS r
               FROM scored), pn) AS roc_auc,
       (SELECT sum(pos / np * tp / (tp + fp)) FROM ranked, pn) AS pr_auc,
       2 * tp / (called + pos) AS f1, tp / called AS precision, tp / pos AS recall, brier,
       log_loss, 0.5 AS threshold, pos / n AS positive_rate, n FROM (SELECT
       count(1) FILTER (y = 1 AND p >= 0.5) AS tp, count(1) FILTER (p >= 0.5) AS called,
       sum(y) AS pos, count(1) AS n, avg((p - y) ** 2) AS brier,
       -avg(y * ln(greatest(p, 0.000001)) + (1 - y) * ln(greatest(1 - p, 0.000001))) AS log_loss
       FROM scored)""")
def _(t):
    return EV.classification_report(scored(t), 0.5)

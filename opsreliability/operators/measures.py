"""Business measures for any grouping and any filters.

A request compiles to one aggregation of the base values it needs, followed by expressions over
the aggregated rows.  A missing value behaves as in the reports: it counts as nothing in a sum
and makes a ratio missing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsreliability.functions.scalar import safe_div
from opsreliability.operators.windows import null_safe_left, prev_period, rank_desc
from opsreliability.sources.schemas import CAUSES


def _where(c: str, pred: str) -> Column:
    return F.when(F.expr(pred), F.col(c))


# aggregates over the leg fact, the score fact, the anomaly days and the backtest rows
BASE: dict[str, Callable[[], Column]] = {
    "n": lambda: F.count("*"),
    "done": lambda: F.sum("completed"), "late": lambda: F.sum("arr_del15"),
    "delay": lambda: F.avg(_where("arr_delay_min", "completed = 1")),
    "delay_late": lambda: F.avg(_where("arr_delay_min", "arr_del15 = 1")),
    "dep_late": lambda: F.sum("dep_del15"), "taxi": lambda: F.avg("taxi_out_min"),
    "gone": lambda: F.sum("cancelled"), "away": lambda: F.sum("diverted"),
    **{c: (lambda c=c: F.sum(c)) for c in CAUSES},
    "p_delay": lambda: F.avg("delay_prob"), "seen_late": lambda: F.avg("arr_del15"),
    "risky": lambda: F.count(_where("delay_prob", "delay_prob >= 0.45")),
    "risky_hit": lambda: F.avg(_where("arr_del15", "delay_prob >= 0.45")),
    "called_hit": lambda: F.avg(_where("arr_del15", "delay_pred = 1")),
    "p90": lambda: F.avg("delay_p90"), "p_cancel": lambda: F.avg("cancel_prob"),
    "flagged": lambda: F.count(_where("is_anomaly", "is_anomaly = 1")),
    "target": lambda: F.when(F.min("target") == F.max("target"), F.min("target")),
    **{f"mae_{m}": (lambda m=m: F.avg(F.abs(F.col(m) - F.col("y"))))
       for m in ("learned", "seasonal_naive", "mean_4wk_same_weekday")},
}


@dataclass(frozen=True)
class Measure:
    label: str
    needs: tuple[str, ...]
    value: Callable[..., Column]


def _sum_causes(*cols: Column) -> Column:
    total = F.coalesce(cols[0], F.lit(0.0))
    for c in cols[1:]:
        total = total + F.coalesce(c, F.lit(0.0))
    return F.when(F.coalesce(*cols).isNotNull(), total)


def _on_time(done: Column, late: Column) -> Column:
    return safe_div(done - F.coalesce(late, F.lit(0)), done)


def _share(i: int) -> Callable[..., Column]:
    return lambda *c: safe_div(c[i], _sum_causes(*c))


def _mae(target: Column, mae: Column) -> Column:
    return mae * F.when(target == "arr_delay_rate", 100).otherwise(1)


_same = lambda c: c
MEASURES: dict[str, Measure] = {
    "flights": Measure("Flights", ("n",), _same),
    "completed_flights": Measure("Completed Flights", ("done",), _same),
    "delayed_flights": Measure("Delayed Flights", ("late",), _same),
    "on_time_pct": Measure("On-Time %", ("done", "late"), _on_time),
    "delay_rate_pct": Measure("Delay Rate %", ("late", "done"), safe_div),
    "avg_arrival_delay_min": Measure("Avg Arrival Delay (min)", ("delay",), _same),
    "avg_delay_when_late_min": Measure("Avg Delay When Late (min)", ("delay_late",), _same),
    "dep_delay_rate_pct": Measure("Dep Delay Rate %", ("dep_late", "n", "gone"),
                                  lambda d, n, g: safe_div(d, n - F.coalesce(g, F.lit(0)))),
    "avg_taxi_out_min": Measure("Avg Taxi-Out (min)", ("taxi",), _same),
    "cancelled_flights": Measure("Cancelled Flights", ("gone",), _same),
    "cancellation_rate_pct": Measure("Cancellation Rate %", ("gone", "n"), safe_div),
    "diversion_rate_pct": Measure("Diversion Rate %", ("away", "n"), safe_div),
    "carrier_delay_total_min": Measure("Carrier Delay Min", (CAUSES[0],), _same),
    "weather_delay_total_min": Measure("Weather Delay Min", (CAUSES[1],), _same),
    "nas_delay_total_min": Measure("NAS Delay Min", (CAUSES[2],), _same),
    "security_delay_total_min": Measure("Security Delay Min", (CAUSES[3],), _same),
    "late_aircraft_delay_total_min": Measure("Late Aircraft Delay Min", (CAUSES[4],), _same),
    "total_cause_min": Measure("Total Cause Min", tuple(CAUSES), _sum_causes),
    "late_aircraft_share_pct": Measure("Late Aircraft Share %", tuple(CAUSES), _share(4)),
    "weather_share_pct": Measure("Weather Share %", tuple(CAUSES), _share(1)),
    "carrier_share_pct": Measure("Carrier Share %", tuple(CAUSES), _share(0)),
    "nas_share_pct": Measure("NAS Share %", tuple(CAUSES), _share(2)),
    "scored_flights": Measure("Scored Flights", ("n",), _same),
    "avg_predicted_delay_risk": Measure("Avg Predicted Delay Risk", ("p_delay",), _same),
    "observed_delay_rate": Measure("Observed Delay Rate (Scored)", ("seen_late",), _same),
    "calibration_gap_pp": Measure("Calibration Gap (pp)", ("p_delay", "seen_late"),
                                  lambda p, o: (p - o) * 100),
    "high_risk_flights": Measure("High-Risk Flights", ("risky",), lambda c: F.nullif(c, F.lit(0))),
    "high_risk_hit_rate": Measure("High-Risk Hit Rate", ("risky_hit",), _same),
    "flagged_precision": Measure("Flagged Precision", ("called_hit",), _same),
    "avg_p90_delay_min": Measure("Avg P90 Delay (min)", ("p90",), _same),
    "avg_cancel_risk": Measure("Avg Cancel Risk", ("p_cancel",), _same),
    "anomaly_days": Measure("Anomaly Days", ("flagged",), lambda c: F.nullif(c, F.lit(0))),
    "backtest_mae_learned": Measure("Backtest MAE Learned", ("target", "mae_learned"), _mae),
    "backtest_mae_seasonal_naive": Measure("Backtest MAE Seasonal Naive",
                                           ("target", "mae_seasonal_naive"), _mae),
    "backtest_mae_4wk_mean": Measure("Backtest MAE 4-Week Mean",
                                     ("target", "mae_mean_4wk_same_weekday"), _mae),
}
# measures that look beyond their own group
MONTH_BEFORE = {"on_time_pct_pm", "on_time_mom_pp", "flights_mom_pct"}
RANK, NETWORK = "carrier_otp_rank", "route_otp_vs_network_pp"
ROUTE_COLUMNS = ("route", "origin", "dest", "airport_code", "airport_name", "state", "ops_segment",
                 "route_segment")


def star_frame(legs: DataFrame, carriers: DataFrame | None = None,
               airports: DataFrame | None = None) -> DataFrame:
    """Fact with the attributes of the date, carrier and origin site dimensions.

    Date attributes are functions of the day, so they need no join.
    """
    d = (legs.withColumn("month_start", F.trunc("flight_date", "month"))
         .withColumn("month_label", F.date_format("flight_date", "MMM yyyy"))
         .withColumn("dow_name", F.date_format("flight_date", "EEE")))
    if carriers is not None:
        c = carriers.select(F.col("carrier_code").alias("_cc"), "carrier_name")
        d = d.join(c, F.col("carrier") == F.col("_cc"), "left").drop("_cc")
    if airports is not None:
        extra = [c for c in ("airport_name", "state", "ops_segment") if c in airports.columns]
        a = airports.select("airport_code", *extra)
        d = d.join(a, F.col("origin") == F.col("airport_code"), "left")
    return d


def slice_by(fact: DataFrame, dim: DataFrame, fk: str, pk: str, pred: Column) -> DataFrame:
    """Slicer: keep the rows whose dimension row satisfies the predicate."""
    return fact.join(dim.where(pred).select(F.col(pk).alias(fk)), fk, "left_semi")


def _simple(frame: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    needs = list(dict.fromkeys(b for n in names for b in MEASURES[n].needs))
    agg = frame.groupBy(*by).agg(*[BASE[b]().alias(f"_{b}") for b in needs])
    return agg.select(*by, *[MEASURES[n].value(*[F.col(f"_{b}") for b in MEASURES[n].needs])
                             .alias(n) for n in names])


def measures(frame: DataFrame, names: Sequence[str], by: Sequence[str] = (),
             where: Column | None = None, route_where: Column | None = None,
             having: Column | None = None, carrier: str = "carrier_name",
             month: str = "month_start") -> DataFrame:
    """Evaluate measures per group.

    ``where`` filters rows; ``route_where`` filters them too but is ignored by the network value
    of the route comparison; ``having`` filters finished groups, so month and rank measures still
    see the months and carriers it removes.
    """
    base = frame if where is None else frame.where(where)
    own = base if route_where is None else base.where(route_where)
    plain = [n for n in names if n in MEASURES]
    extra = [n for n in names if n not in MEASURES]
    keys = list(by)
    if MONTH_BEFORE & set(extra) and month not in keys:
        keys.append(month)
    helpers = [n for n in ("on_time_pct", "flights") if extra and n not in plain]
    d = _simple(own, [*plain, *helpers], keys)
    if MONTH_BEFORE & set(extra):
        past = [k for k in keys if k not in (month, "month_label", "year_month")]
        d = prev_period(d, month, ["on_time_pct", "flights"], past)
        d = (d.withColumn("on_time_mom_pp", (F.col("on_time_pct") - F.col("on_time_pct_pm")) * 100)
             .withColumn("flights_mom_pct",
                         safe_div(F.col("flights") - F.col("flights_pm"), "flights_pm")))
    if RANK in extra:
        d = rank_desc(d, "on_time_pct", RANK, [k for k in keys if k != carrier])
    if NETWORK in extra:
        shared = [k for k in keys if k not in ROUTE_COLUMNS]
        net = _simple(base, ["on_time_pct"], shared).withColumnRenamed("on_time_pct", "_net")
        d = (null_safe_left(d, net, shared) if shared else
             d.withColumn("_net", net.select("_net").scalar()))
        d = d.withColumn(NETWORK, (F.col("on_time_pct") - F.col("_net")) * 100)
    if having is not None:
        d = d.where(having)
    return d.select(*by, *names)

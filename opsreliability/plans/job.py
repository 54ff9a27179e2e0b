"""The whole daily job over raw records, as a sequence of operators.

Every layer that is used more than once is written as a table of its own and scanned from there;
the stages themselves are the functions of ``opsreliability.operators``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from opsreliability.operators import features as FE
from opsreliability.operators import marts as M
from opsreliability.operators import quality as Q
from opsreliability.operators.calendar import holiday_calendar
from opsreliability.operators.dims import airport_dim, carrier_dim, date_dim, route_dim
from opsreliability.operators.scoring import fact_export
from opsreliability.operators.staging import quarantine, stage_legs
from opsreliability.session import materialise
from opsreliability.sources.sinks import write_parquet


@dataclass
class Result:
    staged: DataFrame
    gate: dict
    features: DataFrame | None = None
    written: dict[str, str] = field(default_factory=dict)


def run(raw: DataFrame, registry: DataFrame, names: DataFrame, out: str, train_end: str,
        valid_end: str, calendar_span: tuple[str, str] = ("2024-01-01", "2027-12-31"),
        row_key: str = "flight_id", with_features: bool = True, stop_on_fail: bool = True) -> Result:
    """Stage, check, aggregate, build features and export.

    ``row_key`` must be unique; rows that share a leg id fail the gate before features are built.
    """
    keep = [] if row_key == "flight_id" else [row_key]
    legs = materialise(stage_legs(raw, keep), "legs")
    airports = materialise(airport_dim(legs, registry), "airports")
    carriers = materialise(carrier_dim(legs, names), "carriers")
    checks = materialise(Q.run_checks(legs, airports, carriers, raw, expect_all_days=True), "checks")
    state = Q.gate(checks) if stop_on_fail else Q.summary(checks).first().asDict()

    calendar = materialise(holiday_calendar(raw.sparkSession, *calendar_span), "calendar")
    routes = M.kpi_route(legs)
    tables = {
        "quarantine": quarantine(raw), "checks": checks, "kpi_overview": M.kpi_overview(legs),
        "kpi_carrier_month": M.kpi_carrier_month(legs, carriers),
        "kpi_airport_month": M.kpi_airport_month(legs, airports), "kpi_route": routes,
        "kpi_hour_dow": M.kpi_hour_dow(legs), "delay_causes_month": M.delay_causes_month(legs),
        "cancellation_reasons_month": M.cancellation_reasons_month(legs),
        "daily_network": M.daily_network(legs), "daily_airport": M.daily_airport(legs),
        "airport_profile": M.airport_profile(legs), "dim_airport": airports, "dim_carrier": carriers,
        "dim_date": date_dim(calendar, legs, train_end, valid_end),
        "dim_route": route_dim(legs, routes.selectExpr("route", "cast(null as string) segment")),
        "fact": fact_export(legs)}
    written = {n: write_parquet(d, f"{out}/{n}") for n, d in tables.items()}
    features = None
    if with_features:
        path = write_parquet(FE.feature_table(legs, calendar, train_end, valid_end, row_key, keep),
                             f"{out}/features", ["split"])
        features = raw.sparkSession.read.parquet(path)
        written["features"] = path
    return Result(legs, state, features, written)

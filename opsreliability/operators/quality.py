"""Data-quality gate.

All row-level checks of a table are one aggregation over one scan.  Only the checks that need
another key (duplicates, distinct days, orphans) shuffle, and they shuffle counted keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsreliability.functions.scalar import round_away
from opsreliability.operators.joins import orphans
from opsreliability.sources.schemas import CAUSES

NOT_NULL = ("flight_date", "carrier", "flight_number", "origin", "dest", "crs_dep_hhmm",
            "crs_arr_hhmm", "distance_mi")


#: Columns of the legs that the checks look at.
COLUMNS = ("flight_id", *NOT_NULL, "cancelled", "diverted", "cancellation_code", "completed", "arr_delay_min",
           "arr_del15", *CAUSES, "crs_elapsed_min", "taxi_out_min")


@dataclass(frozen=True)
class Check:
    """``value`` is an aggregate; the check passes when ``value op limit`` holds."""

    name: str
    category: str
    value: Column
    op: str
    limit: float | Column
    warn_only: bool = False
    detail: str | Column = ""
    limit_text: str | Column | None = None


def _number(pred: str) -> Column:
    """Rows for which the predicate holds (NULL counts as not)."""
    return F.sum(F.when(F.expr(pred), 1).otherwise(0)).cast("double")


def _share(pred: str, where: str) -> Column:
    """Share of rows with ``pred`` among the rows ``where``."""
    return F.avg(F.when(F.expr(where), F.expr(pred).cast("int")))


def row_checks() -> list[Check]:
    causes = " + ".join(f"coalesce({c}, 0)" for c in CAUSES)
    checks = [Check("row_count_positive", "completeness", F.count("*").cast("double"), ">", 0)]
    checks += [Check(f"not_null_{c}", "completeness", _number(f"{c} IS NULL"), "==", 0)
               for c in NOT_NULL]
    checks += [
        Check("valid_scheduled_dep_time", "validity",
              _number("crs_dep_hhmm NOT BETWEEN 0 AND 2400 OR crs_dep_hhmm % 100 >= 60"), "==", 0),
        Check("origin_differs_from_dest", "validity", _number("origin = dest"), "==", 0),
        Check("binary_status_flags", "validity",
              _number("cancelled NOT IN (0, 1) OR diverted NOT IN (0, 1)"), "==", 0),
        Check("cancelled_has_reason_code", "consistency",
              _number("cancelled = 1 AND cancellation_code IS NULL"), "==", 0),
        Check("reason_code_only_when_cancelled", "consistency",
              _number("cancelled = 0 AND cancellation_code IS NOT NULL"), "==", 0),
        Check("completed_has_arrival_delay", "completeness",
              _share("arr_delay_min IS NULL", "completed = 1"), "<=", 0.001),
        Check("arr_del15_matches_delay_minutes", "consistency",
              _share("CAST(arr_delay_min >= 15 AS INT) <> arr_del15",
                     "completed = 1 AND arr_delay_min IS NOT NULL"), "<=", 0.0005),
        Check("delay_causes_sum_to_arrival_delay", "consistency",
              _share(f"abs({causes} - arr_delay_min) > 1", "arr_del15 = 1"), "<=", 0.01, True,
              "cause minutes are only reported from a delay of 15 minutes on"),
        Check("positive_distance_and_block_time", "validity",
              _number("distance_mi <= 0 OR crs_elapsed_min <= 0"), "==", 0),
        Check("taxi_out_plausible_0_240", "validity",
              _share("taxi_out_min NOT BETWEEN 0 AND 240", "taxi_out_min IS NOT NULL"),
              "<=", 0.001, True),
        Check("arrival_delay_over_24h_share", "validity",
              _share("arr_delay_min > 1440", "completed = 1"), "<=", 0.0005, True),
    ]
    return checks


def _rows(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Evaluate the checks in one aggregation and turn the one row into one row per check."""
    aggs, items = [], []
    for i, c in enumerate(checks):
        aggs.append(c.value.alias(f"v{i}"))
        if isinstance(c.limit, Column):
            aggs.append(c.limit.alias(f"l{i}"))
        if isinstance(c.detail, Column):
            aggs.append(c.detail.alias(f"d{i}"))
    one = df.agg(*aggs)
    for i, c in enumerate(checks):
        limit = F.col(f"l{i}") if isinstance(c.limit, Column) else F.lit(float(c.limit))
        v = F.coalesce(F.col(f"v{i}").cast("double"), F.lit(0.0))
        ok = {">": v > limit, "==": v == limit, "<=": v <= limit, ">=": v >= limit}[c.op]
        shown = (F.concat(F.lit(f"{c.op} "), limit.cast("int").cast("string"))
                 if isinstance(c.limit, Column) else F.lit(f"{c.op} {c.limit:g}"))
        items.append(F.struct(
            F.lit(c.name).alias("name"), F.lit(c.category).alias("category"),
            round_away(v, 6).alias("observed"), shown.alias("threshold"),
            F.when(ok, "PASS").otherwise("WARN" if c.warn_only else "FAIL").alias("status"),
            (F.col(f"d{i}") if isinstance(c.detail, Column) else F.lit(c.detail)).alias("detail")))
    return one.select(F.inline(F.array(*items)))


def duplicates(legs: DataFrame, key: str = "flight_id") -> DataFrame:
    """One row: rows minus distinct keys.  Keys are counted map-side before they are shuffled."""
    return legs.groupBy(key).agg(F.count("*").alias("_n")).agg(
        (F.sum("_n") - F.count(key)).cast("double").alias("dup"))


def run_checks(legs: DataFrame, airports: DataFrame | None = None,
               carriers: DataFrame | None = None, raw: DataFrame | None = None,
               expect_all_days: bool = False) -> DataFrame:
    """All applicable checks as rows; inputs that are not given skip their checks."""
    out = [_rows(legs, row_checks())]
    if raw is not None:
        n = legs.agg(F.count("*").alias("_staged"))
        both = raw.agg(F.count("*").alias("_raw")).withColumn("_staged", n.scalar())
        ratio = F.max(F.when(F.col("_raw") > 0, F.col("_staged") / F.col("_raw")))
        text = F.max(F.concat(F.lit("raw="), F.col("_raw").cast("string"), F.lit(" staged="),
                              F.col("_staged").cast("string")))
        out.append(_rows(both, [Check("rows_retained_vs_raw", "completeness", ratio, ">=", 0.999,
                                      detail=text)]))
    out.append(_rows(duplicates(legs), [
        Check("duplicate_flight_id", "uniqueness", F.max("dup"), "==", 0)]))
    if expect_all_days:
        days = legs.groupBy("flight_date").agg(F.count("*").alias("_n"))
        span = F.datediff(F.max("flight_date"), F.min("flight_date")) + 1
        out.append(_rows(days, [Check("calendar_coverage_days", "completeness",
                                      F.count("flight_date").cast("double"), "==", span)]))
    if airports is not None:
        ends = legs.groupBy("origin").agg(F.count("*").alias("_n"))
        lost = orphans(ends, airports, "origin", "airport_code")
        out.append(_rows(lost, [Check("origin_in_airport_dim", "referential",
                                      F.sum("_n").cast("double"), "==", 0)]))
        out.append(_rows(airports, [Check("airport_dim_has_coordinates", "enrichment",
                                          _number("latitude IS NULL"), "==", 0, True)]))
    if carriers is not None:
        out.append(_rows(carriers, [Check("carrier_dim_named", "enrichment",
                                          _number("carrier_name = carrier_code"), "==", 0, True)]))
    rows = out[0]
    for r in out[1:]:
        rows = rows.unionByName(r)
    return rows


def summary(checks: DataFrame) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return checks.agg(n("PASS").alias("passed"), n("WARN").alias("warned"),
                      n("FAIL").alias("failed"),
                      F.when(n("FAIL") == 0, "PASS").otherwise("FAIL").alias("gate"))


class GateFailed(RuntimeError):
    """A blocking check failed."""


def gate(checks: DataFrame) -> dict:
    """Stop the job on any FAIL; warnings pass.  Brings one row to the driver."""
    s = summary(checks).first().asDict()
    if s["gate"] != "PASS":
        raise GateFailed(f"data-quality gate failed: {s}")
    return s

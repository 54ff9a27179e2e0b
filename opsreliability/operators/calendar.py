"""Day spine with federal holidays.

The span of days is a parameter (a few thousand rows at most), built on the cluster from
``sequence``; holidays follow the published rules, with the observed day for fixed dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed-date holidays (month, day) and floating ones (month, ISO weekday, which;
# 0 = last of the month).
FIXED = {"New Year's Day": (1, 1), "Juneteenth": (6, 19), "Independence Day": (7, 4),
         "Veterans Day": (11, 11), "Christmas Day": (12, 25)}
FLOATING = {"Martin Luther King Jr. Day": (1, 1, 3), "Washington's Birthday": (2, 1, 3),
            "Memorial Day": (5, 1, 0), "Labor Day": (9, 1, 1), "Columbus Day": (10, 1, 2),
            "Thanksgiving Day": (11, 4, 4)}
SINCE = {"Juneteenth": 2021, "Martin Luther King Jr. Day": 1986}
CAP_DAYS = 30


def day_spine(spark: SparkSession, start: str, end: str, name: str = "flight_date") -> DataFrame:
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return spark.range(1).select(F.explode(days).alias(name))


def _observed(day: Column) -> Column:
    """Saturday moves to Friday, Sunday to Monday."""
    w = F.weekday(day)
    return F.when(w == 5, F.date_sub(day, 1)).when(w == 6, F.date_add(day, 1)).otherwise(day)


def _nth_weekday(year: Column, month: int, iso_dow: int, nth: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    if nth == 0:
        last = F.last_day(first)
        return F.date_sub(last, (F.weekday(last) - (iso_dow - 1) + 7) % 7)
    return F.date_add(first, (F.lit(iso_dow - 1) - F.weekday(first) + 7) % 7 + 7 * (nth - 1))


def federal_holidays(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Observed federal holidays inside [start, end]: rows (holiday_date, holiday)."""
    years = spark.range(1).select(F.explode(F.sequence(
        F.year(F.lit(start).cast("date")), F.year(F.lit(end).cast("date")) + 1)).alias("y"))
    y = F.col("y")
    days = [(n, _observed(F.make_date(y, F.lit(m), F.lit(d)))) for n, (m, d) in FIXED.items()]
    days += [(n, _nth_weekday(y, *rule)) for n, rule in FLOATING.items()]
    items = [F.struct(F.lit(n).alias("holiday"),
                      F.when(y >= SINCE.get(n, 0), d).alias("holiday_date")) for n, d in days]
    return (years.select(F.inline(F.array(*items)))
            .where(F.col("holiday_date").between(F.lit(start).cast("date"),
                                                 F.lit(end).cast("date")))
            .select("holiday_date", "holiday"))


def nearest_event(days: DataFrame, day: str, events: DataFrame, event: str, cap: int,
                  name: str) -> DataFrame:
    """Days to the nearest event, at most ``cap``.

    Every event is spread over the 2 * cap + 1 days it can influence and met by an equi join;
    no day is compared with all events.
    """
    near = events.select(F.explode(F.sequence(F.lit(-cap), F.lit(cap))).alias("_off"),
                         F.col(event).alias("_e"))
    near = (near.select(F.date_add("_e", F.col("_off")).alias(day), F.abs("_off").alias("_dist"))
            .groupBy(day).agg(F.min("_dist").alias("_dist")))
    return (days.join(near, day, "left")
            .withColumn(name, F.coalesce("_dist", F.lit(cap))).drop("_dist"))


def holiday_calendar(spark: SparkSession, start: str = "2024-01-01",
                     end: str = "2027-12-31") -> DataFrame:
    """Rows (flight_date, days_to_holiday, is_holiday)."""
    spine = day_spine(spark, start, end)
    hol = federal_holidays(spark, start, end)
    cal = nearest_event(spine, "flight_date", hol, "holiday_date", CAP_DAYS, "days_to_holiday")
    return cal.withColumn("is_holiday", (F.col("days_to_holiday") == 0).cast("int"))


def join_calendar(df: DataFrame, calendar: DataFrame, day: str = "flight_date") -> DataFrame:
    return df.join(calendar, day)

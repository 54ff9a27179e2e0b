"""The given tables seen as raw on-time records.

``RAW_VIEW`` is text that both engines understand ({delay} is the one spelling that differs), so
that the operators and their SQL checks start from the same rows: padded and lower-case codes,
blank tails, 2400 times, non-numeric times, bad block times, missing keys, cancellations and
diversions all occur in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsreliability.session import apart, file_bytes, spread

#: Bytes of a dimension file up to which its few columns in use are broadcast.
DIM_BYTES = 128 << 20

CODE = "concat('N', lpad(CAST({k} AS VARCHAR(20)), 2, '0'))"
DELAY = {"spark": "datediff(l_shipdate, o_orderdate)",
         "duckdb": "datediff('day', o_orderdate, l_shipdate)"}

RAW_VIEW = {
    "leg_key": "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)",
    "FlightDate": "CASE WHEN l_orderkey % 499 = 7 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
    "Reporting_Airline": "CASE WHEN l_linenumber = 2 THEN concat(' ', lower(c_mktsegment), ' ') "
                         "ELSE c_mktsegment END",
    "Tail_Number": "CASE WHEN l_returnflag = 'R' THEN '  ' ELSE concat('t', l_suppkey) END",
    "Flight_Number_Reporting_Airline": "CAST(l_partkey AS VARCHAR(20))",
    "Origin": "CASE WHEN l_partkey % 997 = 11 THEN NULL "
              "WHEN l_linenumber = 3 THEN concat(lower({origin}), ' ') ELSE {origin} END",
    "OriginCityName": "concat('City ', sn.n_name)",
    "OriginState": "concat('R', sn.n_regionkey)",
    "Dest": "CASE WHEN l_linenumber = 4 THEN lower({dest}) ELSE {dest} END",
    "DestCityName": "concat('City ', cn.n_name)",
    "DestState": "concat('R', cn.n_regionkey)",
    "CRSDepTime": "CASE WHEN l_partkey % 1000 = 999 THEN '12a4' "
                  "WHEN l_orderkey % 24 = 0 AND l_partkey % 60 < 4 THEN '2400' "
                  "ELSE CAST((l_orderkey % 24) * 100 + l_partkey % 60 AS VARCHAR(20)) END",
    "DepTime": "CASE WHEN l_returnflag <> 'R' THEN "
               "CAST(((l_orderkey + 1) % 24) * 100 + l_suppkey % 60 AS VARCHAR(20)) END",
    "DepDelay": "CASE WHEN l_returnflag <> 'R' THEN CAST({delay} - l_linenumber AS DOUBLE) END",
    "DepDel15": "CASE WHEN l_returnflag <> 'R' THEN CAST(CAST({delay} - l_linenumber >= 15 AS INT) "
                "AS DOUBLE) END",
    "TaxiOut": "CASE WHEN l_returnflag <> 'R' THEN l_tax * 100 END",
    "TaxiIn": "CASE WHEN l_returnflag <> 'R' THEN l_discount * 100 END",
    "CRSArrTime": "CAST(((l_orderkey + l_linenumber) % 24) * 100 + l_suppkey % 60 AS VARCHAR(20))",
    "ArrTime": "CASE WHEN l_returnflag <> 'R' THEN "
               "CAST(((l_orderkey + 2) % 24) * 100 + l_partkey % 60 AS VARCHAR(20)) END",
    "ArrDelay": "CASE WHEN l_returnflag <> 'R' THEN CAST({delay} AS DOUBLE) END",
    "ArrDel15": "CASE WHEN l_returnflag <> 'R' AND l_partkey % 700 <> 3 "
                "THEN CAST(CAST({delay} >= 15 AS INT) AS DOUBLE) END",
    "Cancelled": "CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) "
                 "WHEN l_linenumber < 7 THEN CAST(0 AS DOUBLE) END",
    "CancellationCode": "CASE WHEN l_returnflag <> 'R' THEN ' ' WHEN l_partkey % 300 = 5 THEN '' "
                        "ELSE substr('ABCD', CAST(1 + (l_orderkey + l_linenumber) % 4 AS INT), 1) "
                        "END",
    "Diverted": "CAST(CAST(l_returnflag <> 'R' AND l_discount > 0.095 AS INT) AS DOUBLE)",
    "CRSElapsedTime": "CASE WHEN l_partkey % 401 = 1 THEN CAST(0 AS DOUBLE) "
                      "WHEN l_partkey % 401 = 2 THEN NULL ELSE l_quantity END",
    "ActualElapsedTime": "CASE WHEN l_returnflag <> 'R' THEN l_quantity + 5 END",
    "AirTime": "CASE WHEN l_returnflag <> 'R' THEN l_quantity * 0.75 END",
    "Distance": "CASE WHEN l_partkey % 503 = 3 THEN CAST(-1 AS DOUBLE) "
                "ELSE CAST(p_size AS DOUBLE) END",
    "CarrierDelay": "CASE WHEN {late} THEN {delay} * l_discount END",
    "WeatherDelay": "CASE WHEN {late} THEN {delay} * l_tax END",
    "NASDelay": "CASE WHEN {late} THEN {delay} * (0.5 - l_discount) END",
    "SecurityDelay": "CASE WHEN {late} AND l_linenumber < 7 THEN {delay} * (0.1 - l_tax) END",
    "LateAircraftDelay": "CASE WHEN {late} THEN {delay} * 0.4 END",
}

# aerodrome records: one per supplier, coded by nation; a third are only known by the longer ident
REGISTRY_VIEW = {
    "ident": "concat(CASE WHEN s_nationkey % 4 = 0 THEN 'K' ELSE 'X' END, {site})",
    "iata_code": "CASE WHEN s_nationkey % 4 = 0 THEN '' ELSE {site} END",
    "name": "s_name",
    "latitude_deg": "CASE WHEN s_suppkey % 11 = 5 THEN 'n/a' "
                    "ELSE CAST(s_suppkey % 90 AS VARCHAR(20)) END",
    "longitude_deg": "CAST(-(s_suppkey % 170) AS VARCHAR(20))",
    "elevation_ft": "CAST(s_suppkey * 3 AS VARCHAR(20))",
    "type": "CASE s_suppkey % 5 WHEN 0 THEN 'large_airport' WHEN 1 THEN 'medium_airport' "
            "WHEN 2 THEN 'small_airport' WHEN 3 THEN 'heliport' ELSE 'closed' END",
    "scheduled_service": "CASE WHEN s_suppkey % 3 = 0 THEN 'yes' ELSE 'no' END",
}

CARRIER_VIEW = {
    "code": "c_mktsegment",
    "name": "concat(substr(c_mktsegment, 1, 1), lower(substr(c_mktsegment, 2)), ' Lines')",
}


def _fill(expr: str, engine: str) -> str:
    late = "l_returnflag <> 'R' AND {delay} >= 15"
    code = "{k}.code" if engine == "spark" else CODE.replace("{k}", "{k}.n_nationkey")
    return (expr.replace("{late}", late).replace("{delay}", DELAY[engine])
            .replace("{origin}", code.format(k="sn")).replace("{dest}", code.format(k="cn"))
            .replace("{site}", CODE.format(k="s_nationkey")))


def view_sql(view: dict[str, str], engine: str) -> list[str]:
    return [f"{_fill(e, engine)} AS {name}" for name, e in view.items()]


def raw_legs(spark: SparkSession, folder: str) -> DataFrame:
    """Raw records joined from the given tables.

    The lines are shuffled once, to their orders, which bring their customers along; suppliers and
    parts are two numbers a row and are broadcast while their files are below ``DIM_BYTES``.  Site codes
    are made for nations, not for lines.
    """
    path = lambda name: f"{folder}/{name}.parquet"
    t = lambda name: spark.read.parquet(path(name))

    def dim(name: str, *cols: str) -> DataFrame:
        d = t(name).select(*cols)
        return F.broadcast(d) if file_bytes(spark, path(name)) <= DIM_BYTES else d

    nation = t("nation").withColumn("code", F.expr(CODE.format(k="n_nationkey")))
    lines = spread(t("lineitem"), path("lineitem"))
    orders = t("orders").join(t("customer"), _eq("o_custkey", "c_custkey"))
    joined = (lines.join(orders, _eq("l_orderkey", "o_orderkey"))
              .join(nation.alias("cn"), _eq("c_nationkey", "cn.n_nationkey"))
              .join(dim("supplier", "s_suppkey", "s_nationkey"), _eq("l_suppkey", "s_suppkey"))
              .join(nation.alias("sn"), _eq("s_nationkey", "sn.n_nationkey"))
              .join(dim("part", "p_partkey", "p_size"), _eq("l_partkey", "p_partkey")))
    return apart(joined).selectExpr(*view_sql(RAW_VIEW, "spark"))


def registry(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/supplier.parquet").selectExpr(
        *view_sql(REGISTRY_VIEW, "spark"))


def carrier_names(spark: SparkSession, folder: str) -> DataFrame:
    """Lookup of carrier names; one carrier is missing on purpose."""
    c = spark.read.parquet(f"{folder}/customer.parquet").where("c_mktsegment <> 'MACHINERY'")
    return c.selectExpr(*view_sql(CARRIER_VIEW, "spark")).distinct()


def _eq(a: str, b: str):
    return F.col(a) == F.col(b)

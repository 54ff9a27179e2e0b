"""Sort, top-k, sampling and set operations."""

from pyspark.sql import functions as F

from opsreliability.catalog.base import query
from opsreliability.operators import sampling as SA


@query("or1_order_by", "origin:s carrier:s n:l",
       """SELECT origin, carrier, count(1) AS n FROM legs GROUP BY origin, carrier
       ORDER BY n DESC NULLS LAST, origin NULLS LAST, carrier NULLS LAST""")
def _(t):
    n = t.legs.groupBy("origin", "carrier").agg(F.count("*").alias("n"))
    return n.orderBy(F.col("n").desc_nulls_last(), F.col("origin").asc_nulls_last(),
                     F.col("carrier").asc_nulls_last())


@query("or2_rows_of_top_groups", "leg_key:s origin:s",
       """SELECT leg_key, origin FROM legs WHERE origin IN (SELECT origin FROM legs GROUP BY origin
       ORDER BY count(1) DESC, origin LIMIT 3)""")
def _(t):
    return SA.keep_top_groups(t.legs.withColumn("one", F.lit(1)), "origin", "one", 3)


@query("or3_worst_routes", "route:s on_time:r6 n:l",
       """SELECT route, 1 - avg(arr_del15) AS on_time, count(1) AS n FROM legs GROUP BY route
       HAVING count(1) >= 50 ORDER BY round(1 - avg(arr_del15), 6), route LIMIT 12""")
def _(t):
    r = t.legs.groupBy("route").agg((1 - F.avg("arr_del15")).alias("on_time"),
                                    F.count("*").alias("n")).where("n >= 50")
    return SA.top_k(r, [F.round("on_time", 6).asc_nulls_last(), F.col("route")], 12)


@query("or4_fixed_sample_after_filter", "leg_key:s carrier:s",
       """SELECT leg_key, carrier FROM legs WHERE completed = 1 AND dep_hour > 5
       ORDER BY md5('42|' || leg_key), leg_key LIMIT 2500""")
def _(t):
    return SA.fixed_sample(t.legs.where("completed = 1 AND dep_hour > 5"), "leg_key", 2500, 42)


@query("or5_row_sample", "leg_key:s carrier:s")
def _(t):
    return SA.row_sample(t.legs, "leg_key", 5000)


@query("st1_union_distinct", "site:s state:s",
       "SELECT origin AS site, origin_state AS state FROM legs UNION SELECT dest, dest_state FROM legs")
def _(t):
    a = t.legs.select(F.col("origin").alias("site"), F.col("origin_state").alias("state")).distinct()
    b = t.legs.select(F.col("dest").alias("site"), F.col("dest_state").alias("state")).distinct()
    return a.union(b).distinct()


@query("st2_union_all", "kind:s site:s n:l",
       """SELECT kind, site, count(1) AS n FROM (SELECT 'origin' AS kind, origin AS site FROM legs
       UNION ALL SELECT 'dest', dest FROM legs) GROUP BY kind, site""")
def _(t):
    end = lambda c: t.legs.select(F.lit(c).alias("kind"), F.col(c).alias("site"))
    return end("origin").unionByName(end("dest")).groupBy("kind", "site").agg(
        F.count("*").alias("n"))

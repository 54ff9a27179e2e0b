"""Plans that must not change with the size of the tables, and the ways taken for large ones."""

import hashlib

from pyspark.sql import functions as F

from opsreliability.operators import features as FE
from opsreliability.operators import windows as WN


def folder_of(spark, root, **change):
    """The given tables as folders of several files."""
    from opsreliability.catalog.sources import ALL_TABLES
    for n in ALL_TABLES:
        d = spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet")
        d.repartition(change.get(n, 1)).write.parquet(f"{root}/{n}.parquet")
    return str(root)


def test_manifest_of_tables_in_folders(spark, tmp_path):
    from opsreliability.catalog import load
    folder = folder_of(spark, tmp_path / "t", lineitem=3, orders=2)
    got = {r.file: (r.row_count, r.has_digest, r.has_bytes) for r in load()[0]["src7_manifest"](spark, folder).collect()}
    assert len(got) == 14
    assert got["lineitem.parquet"] == (spark.read.parquet(f"{folder}/lineitem.parquet").count(), 1, 1)


def test_key_with_many_values_is_encoded_like_a_key_with_few(spark):
    rows = [(f"i{i}", None if i % 13 == 0 else f"k{i % 40}", i < 300, None if i % 11 == 0 else i % 2)
            for i in range(400)] + [("new", "unseen", False, 1), (None, "k1", True, 1), ("i5", "k5", True, 0)]
    df = spark.createDataFrame(rows, "id string, k string, train boolean, y int")

    def run(**limits):
        d = FE.target_encode(df, df, "id", F.col("train"), {"k": "k"}, {"t": "y"}, id_col="id", **limits)
        return sorted(map(repr, d.select("id", "k", "y", "te_k_t").collect()))

    assert run() == run(broadcast_bytes=0) == run(broadcast_bytes=0, hot_rows=3)


def plan_of(spark, make):
    """Physical plan without adaptive execution and size-driven broadcasts, as for tables of any size."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rows_of_a_many_valued_key_are_shuffled_once(spark):
    df = spark.createDataFrame([(f"i{i}", f"k{i}", True, 1) for i in range(50)],
                               "id string, k string, train boolean, y int")
    df = df.withColumn("fold", F.length("id") % 5)
    text = plan_of(spark, lambda: FE._encode_many(df, "k", "id", df.agg(F.avg("y").alias("t")), {"t": "y"}, 50.0, "te_k_"))
    assert text.count("Exchange hashpartitioning") == 1


def test_packed_counts_are_the_same(spark):
    rows = [(i, "a" if i % 3 else None, i % 5, None if i % 7 == 0 else i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, site string, day int, hour int")
    specs = {"n": ["site", "day", "hour"], "m": ["site", "day"]}
    plain = WN.peer_counts(df, specs, "id")
    packed = WN.peer_counts(df, specs, "id", packed={"n": "hour"})
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, packed.select(plain.columns).collect()))


def test_some_columns_of_the_feature_table(spark):
    from opsreliability.catalog.base import Tables
    from opsreliability.catalog.features import calendar
    t = Tables(spark, "/root/testdata/sf0.001")
    whole = FE.feature_table(t.legs, calendar(t), "1999-12-31", "2000-09-30", "leg_key", ["leg_key"])
    for want in (["leg_key", "route", "split"], ["leg_key", "dest_sched_arrs_hour"], ["leg_key", "te_flight_delay"],
                 ["leg_key", "tail_leg_of_day", "sched_speed_mpm"]):
        legs = t.legs.select("leg_key", *FE.legs_columns([c for c in want if c != "leg_key"]))
        some = FE.feature_table(legs, calendar(t), "1999-12-31", "2000-09-30", "leg_key", ["leg_key"], want)
        assert sorted(map(repr, some.collect())) == sorted(map(repr, whole.select(want).collect())), want
    bare = FE.feature_table(t.legs.select("leg_key", "flight_date", "route"), calendar(t), "1999-12-31", "2000-09-30",
                            "leg_key", ["leg_key"], ["leg_key", "route", "split"])
    assert "Window" not in bare._jdf.queryExecution().executedPlan().toString()


def test_lines_are_shuffled_to_their_orders_only(spark):
    from opsreliability.plans.driver_view import raw_legs
    text = plan_of(spark, lambda: raw_legs(spark, "/root/testdata/sf0.001"))
    assert text.count("hashpartitioning(l_orderkey") == 1
    assert not any(f"hashpartitioning({k}" in text for k in ("l_partkey", "l_suppkey"))


def test_sums_by_key_and_by_fold_share_a_sort(spark):
    rows = [(i, None if i % 11 == 0 else f"k{i % 40}", i % 5 - (i % 3 == 0), i % 2, i % 4 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, key string, fold int, late int, gone boolean").withColumn(
        "gone", F.col("gone").cast("int"))
    targets = {"delay": "late", "cancel": "gone"}
    p = FE.priors(df, targets)
    many = FE._encode_many(df, "key", "id", p, targets, 50.0, "te_")
    table = FE.te_fold_table(df.where("fold >= 0"), "key", F.col("fold"), p, targets, prefix="te_")
    want = df.join(table, ["key", "fold"], "left").select(many.columns)
    text = many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, many.collect())) == sorted(map(repr, want.collect()))
    assert text.count("Window [") == 2 and text.count("Sort [") == 1 and text.count("hashpartitioning(") == 1


def test_days_and_hours_are_counted_as_numbers(spark):
    df = spark.sql("SELECT id, if(id % 4 = 0, NULL, date_add(DATE '1999-12-30', CAST(id % 3 AS INT))) AS day, "
                   "if(id % 5 = 0, NULL, CAST(id % 2 AS INT)) AS hour, if(id % 7 = 0, NULL, 'a') AS site FROM range(200)")
    got = WN.peer_counts(df, {"n": ["site", "day", "hour"]}, "id")
    want = df.selectExpr("*", "count(1) OVER (PARTITION BY site, day, hour) AS n")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "as string" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_wide_projections_are_compiled_in_any_session(spark):
    from opsreliability.catalog.base import Tables
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "65535")
        Tables(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(limit) == "8000"
        spark.conf.set(limit, "4000")
        Tables(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(limit) == "4000"
    finally:
        spark.conf.set(limit, before)


def test_checks_join_the_tables_for_the_layer_and_the_count_only(spark):
    from opsreliability.catalog.base import Tables
    from opsreliability.catalog.gate import all_checks
    text = all_checks(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join Inner, (l_orderkey") == 1


def test_joins_of_the_lines_are_compiled_apart_from_the_projections(spark):
    """What is made of the raw records may be too wide to compile; the joins below it stay in methods of their own."""
    from opsreliability.catalog.base import Tables
    legs = Tables(spark, "/root/testdata/sf0.001").legs
    plan = plan_of(spark, lambda: legs.select("leg_key", "flight_id", "origin", "dest"))
    wide, joins = plan.split("CollectMetrics", 1)
    assert "Join" not in wide and "md5" in wide and "md5" not in joins
    assert "BroadcastHashJoin" in joins and "lpad" not in wide  # site codes are made for nations, not for lines
    # columns that nobody asks for are not read
    few = plan_of(spark, lambda: legs.select("distance_mi"))
    assert "l_quantity" in few and "l_extendedprice" not in few and "l_returnflag" not in few


def test_site_codes_and_nations_are_those_of_the_lines(spark, tmp_path):
    from opsreliability.plans import driver_view as V
    folder = folder_of(spark, tmp_path / "t")
    for n in ("lineitem", "orders", "customer", "nation", "supplier", "part"):
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)
    sql = ", ".join(V.view_sql(V.RAW_VIEW, "duckdb")).replace("datediff('day', o_orderdate, l_shipdate)", V.DELAY["spark"])
    want = spark.sql(f"""SELECT {sql} FROM lineitem, orders, customer, nation cn, supplier, nation sn, part
        WHERE o_orderkey = l_orderkey AND c_custkey = o_custkey AND cn.n_nationkey = c_nationkey
          AND s_suppkey = l_suppkey AND sn.n_nationkey = s_nationkey AND p_partkey = l_partkey""")
    got = V.raw_legs(spark, folder)
    assert got.columns == want.columns and got.count() > 1000
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0

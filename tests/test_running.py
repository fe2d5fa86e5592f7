import random

from pyspark.sql import functions as F

from tillroll.operators.running import join_heavy, running_totals


def test_running_totals_equal_sorting(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 50), k, rng.choice([0, 1, 1, None])) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, v bigint, t bigint, x int").repartition(7)
    found = running_totals(df, ["g"], [F.desc("v"), F.asc("t")], {"before": "x"}, "test").collect()
    so_far, wanted = {}, {}
    for g, v, t, x in sorted(rows, key=lambda r: (-r[1], r[2])):
        wanted[t] = so_far.get(g, 0)
        so_far[g] = so_far.get(g, 0) + (x or 0)
    assert len(found) == 3000 and {r.t: r.before for r in found} == wanted


def test_no_group_and_no_rows(spark):
    df = spark.range(1000).withColumn("one", F.lit(1))
    assert all(r.at == r.id for r in running_totals(df, [], [F.asc("id")], {"at": "one"}, "test").collect())
    assert running_totals(df.limit(0), [], [F.asc("id")], {"at": "one"}, "test").count() == 0


def test_a_heavy_key_is_spread(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("key"))
    lookup = rows.select("key").distinct().withColumn("length", F.length("key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_heavy(rows, lookup, ["key"]).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(joined) == 5000 and all(r.length == len(r.key) for r in joined)
    assert join_heavy(rows.limit(0), lookup, ["key"]).count() == 0

"""Distributed ranks against plain sorting: groups over many partitions, NULLs, ties, empty."""
import random

from pyspark.sql import functions as F

from eventide.operators.ranks import global_rank, group_rank

KIND = "id long, g string, x int"


def some(n=500):
    rnd = random.Random(1)
    return [(i, rnd.choice(["hot"] * 6 + ["a", "b", None, ""]), rnd.choice([None, 1, 2, 3])) for i in range(n)]


def plain(rows):
    """(g NULL first, x descending NULL last, id): the order of the tests."""
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2] is None, -(r[2] or 0), r[0]))


def test_global_rank(spark):
    rows = some()
    df = spark.createDataFrame(rows, KIND).repartition(7)
    got = global_rank(df, ["g", F.col("x").desc(), "id"]).collect()
    assert {r.id: r["rank"] for r in got} == {r[0]: i for i, r in enumerate(plain(rows), 1)}
    assert global_rank(df.limit(0), ["g", "id"]).count() == 0


def test_group_rank_goes_on_over_partitions(spark):
    rows = some()
    df = spark.createDataFrame(rows, KIND)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = group_rank(df, ["g"], [F.col("x").desc(), "id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, seen = {}, {}
    for r in plain(rows):
        seen[r[1]] = want[r[0]] = seen.get(r[1], 0) + 1
    assert {r.id: r["rank"] for r in got} == want
    assert group_rank(df.limit(0), ["g"], ["id"]).count() == 0
    assert [r["rank"] for r in group_rank(df.filter("g = 'hot'"), ["g"], ["id"]).orderBy("id").collect()] == list(
        range(1, sum(r[1] == "hot" for r in rows) + 1))


def test_no_window_without_a_key_and_no_python(spark):
    df = spark.createDataFrame(some(20), KIND)
    for out in (global_rank(df, ["id"]), group_rank(df, ["g"], ["id"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "SinglePartition" not in plan
        assert plan.count("Window") == 0 or "windowspecdefinition(_pid" in plan

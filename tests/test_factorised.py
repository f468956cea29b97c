"""Aggregates without pairs against the same over the pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tideweave.operators import factorised as X
from tideweave.operators import joins as J
from tideweave.operators import queryset as Q
from tideweave.operators import stats as S
from tideweave.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def sides(spark, seed, n=120):
    r = random.Random(seed)
    row = lambda i: (i, r.choice([0, 0, 0, 1, 2, None]), r.randrange(-30, 90), r.choice([1, 5, None]), r.choice("xy"), r.randrange(1, 16))
    make = lambda p: spark.createDataFrame([row(i) for i in range(n)], f"{p}_id int, {p}_key int, {p}_ms bigint, {p}_v bigint, {p}_g string, {p}_qmask bigint")
    return make("a"), make("b")


@pytest.mark.parametrize("size, slide", [(10, 10), (10, 3), (3, 5), (24, 3), (25, 3)])
@pytest.mark.parametrize("by", [["a_key"], ["b_g"], ["a_g", "b_g"], []])
def test_window_join_sums(spark, size, slide, by):
    a, b = sides(spark, size)
    got = X.window_join_sums(a, b, ("a_key", "b_key"), ("a_ms", "b_ms"), size, slide, by, ["a_v", "b_v"], ("a_qmask", "b_qmask"), 4)
    pairs = J.window_join(a, b, [("a_key", "b_key")], ("a_ms", "b_ms"), size, slide, ("a_qmask", "b_qmask"))
    pairs = Q.per_query(J.in_each_window(pairs.filter("first_window <= last_window"), slide), 4)
    want = pairs.groupBy("qid", "window_start", *by).agg(F.count("*").alias("n"), F.sum("a_v").alias("sum_a_v"), F.count("a_v").alias("n_a_v"), F.sum("b_v").alias("sum_b_v"), F.count("b_v").alias("n_b_v"))
    assert values(got.select(want.columns)) == values(want) != []


def test_many_queries_and_none(spark):
    a, b = sides(spark, 3, 40)
    wide = lambda d, p: d.withColumn(f"{p}_qmask", F.array(F.col(f"{p}_qmask"), (F.col(f"{p}_qmask") * 2).cast("bigint")))
    args = (("a_key", "b_key"), ("a_ms", "b_ms"), 12, 4, [], [])
    got = X.window_join_sums(wide(a, "a"), wide(b, "b"), *args, ("a_qmask", "b_qmask"), 100)
    low = X.window_join_sums(a, b, *args, ("a_qmask", "b_qmask"), 4)
    assert values(got.filter("qid < 63")) == values(low) and values(got.filter("qid >= 63").withColumn("qid", F.col("qid") - 64)) == values(low)
    plain = X.window_join_sums(a, b, *args)
    floats = [X.window_join_sums(d, b, ("a_key", "b_key"), ("a_ms", "b_ms"), 24, 2, ["b_g"], ["a_v"]) for d in (a, a.withColumn("a_v", F.col("a_v").cast("double")))]
    assert values(floats[0]) == values(floats[1].withColumn("sum_a_v", F.col("sum_a_v").cast("bigint"))) != []
    pairs = J.in_each_window(J.window_join(a, b, [("a_key", "b_key")], ("a_ms", "b_ms"), 12, 4), 4)
    assert values(plain) == values(pairs.groupBy("window_start").agg(F.count("*").alias("n")))
    assert X.window_join_sums(a.limit(0), b, *args).count() == 0


@pytest.mark.parametrize("reach, step", [(0, None), (7, None), (7, 3), (25, 1000)])
def test_band_matches(spark, reach, step):
    a, b = (d.select(F.col(f"{p}_key").alias("key"), F.col(f"{p}_ms").alias("at"), F.col(f"{p}_g").alias(f"g{p}")) for d, p in zip(sides(spark, 9), "ab"))
    rows = a.select("key", "at", F.lit(1).alias("one"), (F.col("ga") == "x").cast("int").alias("x"))
    got = X.band_matches(rows, b, ["key"], "at", reach, ["one", "x"], ["gb"], step, gaps=True)
    apart = F.abs(F.col("at") - F.col("bt"))
    pairs = a.join(b.withColumnRenamed("at", "bt"), "key").filter(apart <= reach)
    is_x = (F.col("ga") == "x").cast("int")
    want = pairs.groupBy("gb").agg(F.count("*").alias("n_one"), F.sum(is_x).alias("n_x"), F.sum(apart).alias("gap_one"), F.sum(apart * is_x).alias("gap_x"))
    assert values(got.select(want.columns)) == values(want) != []
    flat = X.band_matches(rows, b, ["key"], "at", reach, ["one"], [], step)
    assert flat.first().n_one == pairs.count()


def test_partners_before(spark):
    a, b = (d.select(F.col(f"{p}_key").alias("key"), F.col(f"{p}_ms").alias("at"), F.col(f"{p}_id").alias(f"{p}_id")) for d, p in zip(sides(spark, 4), "ab"))
    for strictly in (False, True):
        got = X.partners_before(a, b, ["key"], "at", 9, strictly, 5).groupBy("a_id").agg(F.sum("partners").alias("n")).filter("n > 0")
        earlier = F.col("bt") < F.col("at") if strictly else F.col("bt") <= F.col("at")
        want = a.join(b.withColumnRenamed("at", "bt"), "key").filter(earlier & (F.col("at") - F.col("bt") <= 9)).groupBy("a_id").agg(F.count("*").alias("n"))
        assert values(got) == values(want) != []


def test_first_k(spark):
    df = spark.createDataFrame([(i % 3, -i, i) for i in range(90)], "k int, t int, id int")
    got = S.first_k(df, ["k"], ["t", "id"], 4)
    assert values(got) == sorted(((i % 3, -i, i) for i in range(78, 90)), key=str)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["shared_join_mean", "shared_join_count", "shared_join_100", "shared_three_way_count", "window_join_agg", "workload_family", "join_match_matrix", "split_stats"])
def test_plans_join_aggregates_alone(spark, name):
    """Every join's inputs come out of aggregates or of a sweep: none holds rows of the tables."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan()

    def grouped(node):
        kind = node.nodeName()
        if kind in ("Aggregate", "Window"):
            return True
        return all(grouped(node.children().apply(i)) for i in range(node.children().size())) if node.children().size() else False

    def joins(node):
        if node.nodeName() == "Join":
            yield node
        for i in range(node.children().size()):
            yield from joins(node.children().apply(i))

    assert all(grouped(j) for j in joins(plan))

"""Users' aggregates, sketches and joins that are written once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tideweave.operators import aggregates as A
from tideweave.operators import custom as U
from tideweave.operators import queryset as Q
from tideweave.operators import stats as S
from tideweave.plans.queries import QUERIES, GeometricMean

SF = "/root/testdata/sf0.001"


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


class Longest(U.Aggregate):
    """The longest text and how many rows there are: a state of two kinds, a result of two fields."""

    returns = "struct<text:string,n:bigint>"

    def init(self):
        return ("", 0)

    def update(self, state, texts, _):
        best = max([state[0], *(t for t in texts if t is not None)], key=lambda t: (len(t), t))
        return (best, state[1] + len(texts))

    def merge(self, one, two):
        return (max(one[0], two[0], key=lambda t: (len(t), t)), one[1] + two[1])

    def finish(self, state):
        return {"text": state[0], "n": state[1]}


@pytest.mark.parametrize("parts", [1, 64])
def test_user_aggregate(spark, monkeypatch, parts):
    r = random.Random(2)
    data = [(r.choice([1, 1, 1, 2, None]), r.choice("ab"), r.choice(["x" * r.randrange(9), None]), i) for i in range(700)]
    df = spark.createDataFrame(data, "k int, g string, t string, i int").repartition(parts)
    got = {(x.k, x.g): (x.value.text, x.value.n) for x in U.aggregate(df, ["k", "g"], ["t", "i"], Longest()).collect()}
    want = {}
    for k, g, t, _ in data:
        text, n = want.get((k, g), ("", 0))
        want[k, g] = (max(text, t or "", key=lambda x: (len(x), x)), n + 1)
    assert got == want
    whole = U.aggregate(df, [], ["t", "i"], Longest()).collect()
    assert len(whole) == 1 and whole[0].value.n == 700
    assert U.aggregate(df.limit(0), [], ["t", "i"], Longest()).first().value.n == 0
    assert U.aggregate(df.limit(0), ["k"], ["t", "i"], Longest()).count() == 0


def test_user_aggregate_of_any_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), (F.col("id") + 1).alias("v"))
    runs = [values(U.aggregate(df.repartition(n), ["k"], ["v"], GeometricMean())) for n in (1, 64)]
    assert runs[0] == runs[1] and len(runs[0]) == 7


def test_sketches(spark):
    """Ranks within the bound, merged sketches as those of all rows, a size that doesn't follow the rows."""
    df = spark.range(400_000).select((F.col("id") % 40 * 1000).alias("ms"), (F.col("id") % 40 * 1000 - (F.xxhash64("id") % 100_000)).alias("emitted")).repartition(16)
    for sketches, n in ((S.latency_sketches(df, "ms", "emitted", 1000), 40), (S.merged(S.latency_sketches(df, "ms", "emitted", 1000), 10_000), 4)):
        rows = S.sketched(sketches).collect()
        assert len(rows) == n
        for x in rows:
            for p in (50, 95, 99):
                assert abs((x[f"p{p}"] + 100_000) / 200_000 - p / 100) < 3 * S.RANK_ERROR
        assert sketches.agg(F.max(F.length("sketch"))).first()[0] < 8000
    exact = S.latency_percentiles(df, "ms", "emitted", 40_000).first()
    assert abs(exact.p50) < 2000


def test_span_median(spark):
    r = random.Random(11)
    data = [(i, r.choice([1, 2, None]), r.choice([5, 6, 6, 7, None]), 10 * r.randrange(3), r.randrange(16)) for i in range(160)]
    df = spark.createDataFrame([(i, k, v, f, f + 10 * (i % 3), m) for i, k, v, f, m in data], "id int, k int, v int, first_window int, last_window int, qmask bigint")
    got = A.span_median(df, ["k"], "v", ["id"], 10, "qmask", 4).select("qid", "window_start", "k", "id", "v")
    each = Q.per_query(df.withColumn("window_start", F.explode(F.sequence("first_window", "last_window", F.lit(10)))), 4)
    assert values(got) == values(A.upper_median(each, ["qid", "window_start", "k"], "v", ["id"]).select("qid", "window_start", "k", "id", "v")) != []
    words = df.withColumn("qmask", F.array(F.lit(0).cast("bigint"), "qmask"))
    assert values(A.span_median(words, ["k"], "v", ["id"], 10, "qmask", 70).select((F.col("qid") - 63).alias("qid"), "window_start", "k", "id", "v")) == values(got)


@pytest.mark.parametrize("name, joins", [("window_join_joint", 2), ("nexmark_q4_q6_joint", 0), ("shared_join_median", 1), ("interval_join_median", 1)])
def test_joins_run_once(spark, name, joins):
    """The plan that is left has only the joins after the written one: rows to their key's peak or median."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"^\W*Join ", plan, re.M)) == joins and "events.parquet" not in plan

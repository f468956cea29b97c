import random
import re
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from tideweave.llm import mixing
from tideweave.llm.mixing import mix_sources, mixed
from tideweave.llm.oracles import ORACLES


def shares(sizes, cap=3):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(full.values())
        goal = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if goal[s] > cap * sizes[s]]
        if not over:
            return full | goal
        full |= {s: cap * sizes[s] for s in over}


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, text string, source string, size int")
    got = mix_sources(df, **more).collect()
    assert len(got) == len(rows)
    sizes, of = defaultdict(int), {}
    for d, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
        of[d] = s
    goal, taken = shares(sizes), defaultdict(int)
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - goal[s]) <= 1e-6 * max(1, goal[s])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 1
    return sorted(got, key=str)


def test_documents(spark, documents):
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    a = check(spark, rows)
    random.Random(2).shuffle(rows)
    assert check(spark, rows, range_size=3) == a


def test_edges(spark):
    rows = [(i, "a b c " * (i % 7), "big") for i in range(300)] + [(1000, None, None), (1001, "x y", None), (1002, "z", "a"), (1002, "z", "a"), (1003, "", "empty"), (1004, "\x0b\x1c  w", "b"), (1005, "l " * 50_000, "c")]
    check(spark, rows)
    assert mix_sources(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0
    assert mix_sources(spark.createDataFrame([(1, None, "a"), (1, None, None)], "doc_id bigint, text string, source string")).filter("taken = 0").count() == 2


def test_sql(spark, documents):
    documents = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{documents}'")
    want = sorted(con.execute(f"select doc_id, size, source_size, target, taken from ({ORACLES['op2_mix_sources']})").fetchall())
    assert sorted(map(tuple, mix_sources(spark.read.parquet(documents)).collect())) == want


def test_mixed_keeps_columns(spark):
    rows = [(i, "a b c d", f"s{i % 3}", i) for i in range(60)] + [(7, "a b c d", "s1", 7), (None, "x", None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, words int").withColumn("doc", F.lit("kept"))
    got = mixed(df)
    assert got.columns == df.columns and got.filter("doc <> 'kept'").count() == 0
    assert set(map(tuple, got.drop("doc").collect())) <= set(rows)
    assert mixed(df.limit(0)).count() == 0


def test_low_weights_spread(spark):
    """Keys of texts full of symbols crowd at the far end of 1 - exp(-key); their ranges hold no more rows than others."""
    rows = [(i, "a #$% b " + "@" * 40, "low") for i in range(20_000)] + [(i, "a b c", "high") for i in range(20_000, 30_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    placed = mixing._mix(mixing.sized(df), 3, 64)
    most = placed.groupBy("of", "coarse", "fine").count().groupBy("of").agg(F.max("count").alias("n"), F.count("*").alias("ranges")).collect()
    assert {r.of for r in most} == {".low", ".high"} and all(r.n <= 100 and r.ranges > 200 for r in most)


def test_one_document_many_times(spark):
    rows = [(7, "a b c", "s")] * 5000 + [(None, "x y " * (i % 3), "s") for i in range(900)] + [(i, "w " * 5, "t") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    goal = shares({"s": 15_000 + 1800, "t": 1500})
    for s, n in (("s", 16_800), ("t", 1500)):
        assert abs(sum(r.taken for r in got if r.source_size == n) - goal[s]) <= 1
    whole = mixed(df.filter("source = 's'").unionByName(df.filter("source = 't'"))).groupBy("source").count().collect()
    assert {r.source for r in whole} <= {"s", "t"}


def test_many_sources(spark):
    rows = [(i, "w " * (1 + i % 9), f"source{i % 997:04d}") for i in range(6000)]
    check(spark, rows)


def test_mixed_tells_texts_apart(spark):
    """A doc_id that stands on two texts of one size: each has its own number of copies."""
    rows = [(i // 2, f"a b c {i}", "s") for i in range(400)] + [(1000 + i, "q " * 3, "t") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixed(df).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("words")).collect()
    goal = shares({"s": 1600, "t": 150})
    assert all(abs(r.words - goal[r.source]) <= 8 for r in got)

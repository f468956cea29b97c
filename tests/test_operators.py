"""Operators on small rows: edges, ties, nulls, empty inputs; and properties against the plain forms."""

import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tideweave.functions import chance, codec, masks
from tideweave.functions.windows import starts, with_windows
from tideweave.operators import aggregates as A
from tideweave.operators import joins as J
from tideweave.operators import queryset as Q
from tideweave.operators import stats as S
from tideweave.operators.etl import parse_entities
from tideweave.plans import specs as P
from tideweave.plans.queries import MIXED, QUERIES
from tideweave.sources import generate as G
from tideweave.sources import lines as L
from tideweave.sources import views as V
from tideweave.sources.sinks import discard, write_text

SF = "/root/testdata/sf0.001"


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("size,slide", [(10, 10), (10, 3), (12, 4), (7, 2), (3, 5)])
def test_window_starts(spark, size, slide):
    got = spark.range(-30, 30).select("id", starts("id", size, slide).alias("w")).collect()
    for r in got:
        assert sorted(r.w) == [s for s in range(-200 * slide, 200 * slide, slide) if s <= r.id < s + size]


@pytest.mark.parametrize("size,slide", [(10, 10), (10, 3), (12, 4), (7, 2)])
def test_pair_once_is_the_window_join(spark, size, slide):
    r = random.Random(size * slide)
    a = spark.createDataFrame([(i, r.randrange(4), r.randrange(-20, 60)) for i in range(80)] + [(99, None, 5)], "a bigint, ka int, ta bigint")
    b = spark.createDataFrame([(i, r.randrange(4), r.randrange(-20, 60)) for i in range(80)], "b bigint, kb int, tb bigint")
    got = values(J.in_each_window(J.window_join(a, b, [("ka", "kb")], ("ta", "tb"), size, slide), slide).select("a", "b", "window_start"))
    plain = with_windows(a, "ta", size, slide, "wa").join(with_windows(b, "tb", size, slide, "wb"), F.expr("ka = kb and wa = wb"))
    assert got == values(plain.select("a", "b", "wa")) and got
    near = values(J.interval_join(a, b, [("ka", "kb")], ("ta", "tb"), size).select("a", "b"))
    assert near == values(a.join(b, F.expr(f"ka = kb and abs(ta - tb) <= {size}")).select("a", "b"))
    assert J.window_join(a.limit(0), b, [("ka", "kb")], ("ta", "tb"), size, slide).count() == 0


def test_panes_are_windows(spark):
    r = random.Random(5)
    df = spark.createDataFrame([(r.randrange(-50, 50), r.randrange(3), r.randrange(100)) for _ in range(200)], "ms bigint, k int, v bigint")
    got = A.sliding_sum(df, "ms", 12, 4, ["k"], "v")
    assert values(got) == values(with_windows(df, "ms", 12, 4).groupBy("window_start", "k").agg(F.sum("v")))
    with pytest.raises(ValueError):
        A.sliding_sum(df, "ms", 10, 4, ["k"], "v")


def test_upper_median(spark):
    rows = [(1, 5, 1), (1, 5, 2), (1, 7, 3), (2, 4, 1), (2, 9, 2), (3, 1, 1), (4, 3, 2), (4, 3, 1), (4, 3, 3), (4, 3, 4)]
    got = values(A.upper_median(spark.createDataFrame(rows, "k int, v int, id int"), ["k"], "v", ["id"]))
    assert got == [(1, 5, 2), (2, 9, 2), (3, 1, 1), (4, 3, 3)]
    for k, v, _ in got:
        assert v == statistics.median_high([x for q, x, _ in rows if q == k])


def test_rising_and_peaks(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 2, 3), (1, 3, 5), (1, 4, 4), (2, 1, -2), (2, 2, None), (2, 3, -1)], "k int, t int, v int")
    assert values(A.rising(df, ["k"], "v", ["t"])) == [(1, 1, 3), (1, 3, 5), (2, 1, -2), (2, 3, -1)]
    assert [r.peak for r in A.running_peak(df, ["k"], "v", ["t"]).orderBy("k", "t").collect()] == [3, 3, 5, 5, 0, 0, 0]


def test_window_records(spark):
    df = spark.createDataFrame([(1, 0, 1, 4, 1), (1, 5, 2, 4, 2), (1, 12, 3, 4, 4), (1, 23, 4, 6, 8), (2, 3, 5, 0, 16)], "k int, ms bigint, id bigint, v bigint, qmask bigint")
    got = values(A.window_records(df, "ms", 10, ["k"], "v", ["ms", "id"], ["qmask"]))
    assert got == [(1, 0, 4, 1), (1, 20, 6, 8)]


def test_top_mean(spark):
    df = spark.createDataFrame([(1, x) for x in range(15)] + [(2, 7)], "k int, v int")
    assert values(A.top_mean(df, ["k"], "v", 10)) == [(1, 9.5), (2, 7.0)]


def test_masks(spark):
    df = spark.createDataFrame([(0,), (5,), (99,), (100,), (None,)], "filter_attr int")
    ranges = [(0, 0, 5), (1, 5, 99), (62, 99, 99)]
    got = [(r.filter_attr, r.qmask) for r in Q.assign(df, ranges).orderBy("filter_attr").collect()]
    assert got == [(0, 1), (5, 3), (99, 2 | 1 << 62)]
    assert values(Q.per_query(Q.assign(df, ranges), 63).select("filter_attr", "qid")) == [(0, 0), (5, 0), (5, 1), (99, 1), (99, 62)]
    assert Q.assign(df, []).count() == 0
    floats = df.withColumn("filter_attr", F.col("filter_attr").cast("double"))
    wide = [*ranges, (3, -(2**40), 2**40)]
    assert [r.qmask for r in Q.assign(floats, ranges).orderBy("filter_attr").collect()] == [m for _, m in got]
    assert [r.qmask for r in Q.assign(df, wide).orderBy("filter_attr").collect()] == [9, 11, 8 | 2 | 1 << 62, 8]
    many = [(q, q, q + 1) for q in range(99)]
    words = df.withColumn("w", masks.mask_words("filter_attr", many)).withColumn("q", masks.words_in("w", 99))
    assert {r.filter_attr: r.q for r in words.collect()} == {0: [0], 5: [4, 5], 99: [98], 100: [], None: []}


def test_predicate_tables_of_any_size(spark, monkeypatch):
    r = random.Random(8)
    df = spark.createDataFrame([(i, r.randrange(-40, 140)) for i in range(150)] + [(999, None)], "id int, filter_attr int")
    table = spark.createDataFrame([(q, lo, lo + r.randrange(0, 50)) for q, lo in enumerate(r.randrange(-80, 160) for _ in range(40))] + [(40, -(2**40), 2**40)], "qid int, lo bigint, hi bigint")
    small = values(Q.assign_by_table(df, table, "id"))
    monkeypatch.setattr(Q, "SMALL", 0)
    assert values(Q.assign_by_table(df, table, "id")) == small and len(small) == 150
    assert Q.assign_by_table(df.limit(0), table, "id").count() == 0


def test_activation(spark):
    df = spark.createDataFrame([(1, 10, 3), (2, 20, 3), (3, 30, 1)], "id int, ms bigint, qmask bigint")
    control = spark.createDataFrame([(0, 0, 20), (0, 30, 40), (1, 20, 21)], "qid int, active_from bigint, active_to bigint")
    assert values(Q.active_at(df, control, 2).select("id", "qid")) == [(1, 0), (2, 1), (3, 0)]


def test_shared_is_alone(spark):
    """Each query's part of a shared run is what it gives alone."""
    e = V.entity(spark, SF)
    for q, lo, hi in MIXED[3:6]:
        mine = lambda k: J.named(e.filter((F.col("type") == k) & F.col("filter_attr").between(lo, hi)), k.lower())
        alone = J.in_each_window(J.window_join(mine("A"), mine("B"), [("a_pk", "b_fk")], ("a_ms", "b_ms"), 259_200_000, 86_400_000), 86_400_000)
        alone = A.upper_median(alone, ["window_start", "b_long1"], "b_long2", ["a_id", "b_id"]).select("window_start", "b_long1", "a_id", "b_id", "b_long2")
        assert values(QUERIES["shared_join_median"](spark, SF).filter(f"qid = {q}").drop("qid")) == values(alone)


def test_winning_bid_edges(spark):
    auctions = spark.createDataFrame([(1, 7, 1, 50, 10, 100, False), (2, 7, 1, 50, 10, 100, False), (3, 7, 1, 50, 10, 100, True), (4, 7, 1, 1, 10, 100, False)], "id bigint, seller bigint, category bigint, reserve bigint, ms bigint, expires_ms bigint, sell_below_reserve boolean")
    bids = spark.createDataFrame([(1, 1, 50, 5), (1, 2, 80, 100), (1, 3, 50, 20), (2, 1, 49, 20), (3, 1, 49, 20), (9, 1, 49, 20)], "auction bigint, bidder bigint, price bigint, ms bigint")
    assert values(J.winning_bids(auctions, bids)) == [(1, 50, 1, 7, 100), (3, 49, 1, 7, 100)]


def test_entity_lines(spark):
    pad = "AAEC"
    good = ["A", "1", "1000", "1001", "5", "-1", "3", "4", "10", "20", "42", "txt", "", "", pad, "2"]
    lines = ["\t".join(good) + "\r", "\t".join(["JSON", "2", "2000", "2001", '{"a":1}', "2"]), "\t".join(good[:-1]), "X\t1", ""]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = L.entity_lines(df, strict=False).collect()
    assert (rows[0].type, rows[0].id, rows[0].ms, rows[0].pk, rows[0].fk, rows[0].filter_attr, rows[0].text, rows[0].json, bytes(rows[0].padding), rows[0].corrupt) == ("A", 1, 1000, 5, -1, 42, "txt", None, b"\x00\x01\x02", None)
    assert (rows[1].type, rows[1].json, rows[1].pk, rows[1].ms) == ("JSON", '{"a":1}', None, 2000)
    assert [r.corrupt is not None for r in rows] == [False, False, True, True, True]
    with pytest.raises(Exception, match="malformed"):
        L.entity_lines(df).collect()
    assert values(L.narrow_lines(df.limit(1))) == [(True, 5, 42)]


def test_auction_lines(spark):
    at = "2024-01-01T00:00:01Z"
    lines = [f"0,1,Ann,a@b.c,1234,Rome,RM,{at},", f"1,7,cup,big,10,20,{at},{at},3,11,x,true", f"2,7,1,500,{at},y", "2,7"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = L.auction_lines(df, strict=False)
    assert [r.type for r in rows.collect()] == ["person", "auction", "bid", None]
    a = L.of_type(rows, "auction").first()
    assert (a.id, a.category, a.sell_below_reserve, a.extra) == (7, 11, True, "x")
    assert L.of_type(rows, "bid").first().price == 500 and L.of_type(rows, "person").first().extra is None


def test_json(spark):
    e = V.entity(spark, SF)
    back = parse_entities(V.json_entity(e)).select("type", "id", "ms", "pk", "fk", "sel1", "sel2", "long1", "long2", "filter_attr")
    assert values(back) == values(e.select(back.columns))
    bad = spark.createDataFrame([(1, "not json")], "id int, json string")
    with pytest.raises(Exception):
        parse_entities(bad).collect()
    assert parse_entities(bad, strict=False).count() == 0
    names = spark.createDataFrame([('{"firstName":"A","lastName":"B"}',), ("{}",)], "j string").select(codec.full_name(F.col("j"))).collect()
    assert [r[0] for r in names] == ["A B", "null null"]


def zigzag(n):
    z, out = (n << 1) ^ (n >> 63), b""
    z &= 2**64 - 1
    while True:
        out += bytes([z & 127 | (128 if z > 127 else 0)])
        z >>= 7
        if not z:
            return out


def test_avro(spark):
    xs = [0, -1, 1, 63, 64, -64, -65, 8191, 8192, 10**12, -(10**15), 2**63 - 1, -(2**63)]
    got = spark.createDataFrame([(x,) for x in xs], "x bigint").select("x", codec.varint_hex(F.col("x")).alias("h")).collect()
    assert {r.x: bytes.fromhex(r.h) for r in got} == {x: zigzag(x) for x in xs}


def test_selectivity(spark):
    df = spark.createDataFrame([(1,), (5,), (5,), (50,), (None,)], "filter_attr int")
    assert values(S.selectivity(df, [(0, 9), (10, 19)])) == [(0, 0, 9, 3, 5), (1, 10, 19, 0, 5)]


def test_distributions(spark):
    for kind, n, more in (("uniform", 7, {}), ("zipf", 9, {"exponent": 1.1, "first": 4}), ("binomial", 5, {"chance": 0.3}), ("beta", 6, {"a": 2, "b": 5}), ("given", 3, {"shares": [1, 2, 1]})):
        cdf = chance.cumulative(kind, n, **more)
        assert len(cdf) == n and cdf[-1] == 1 and all(a <= b for a, b in zip(cdf, cdf[1:]))
        got = spark.range(20_000).select(chance.drawn(cdf, chance.unit(1, kind, F.col("id"))).alias("x")).groupBy("x").count().collect()
        for r in got:
            share = cdf[r.x] - (cdf[r.x - 1] if r.x else 0)
            assert math.isclose(r["count"] / 20_000, share, abs_tol=0.02)
    assert max(range(9), key=lambda i: chance.cumulative("zipf", 9, first=4)[i] - ([0] + chance.cumulative("zipf", 9, first=4))[i]) == 4


def test_generators_dont_depend_on_partitions(spark):
    plan = G.AuctionPlan(gaps_us=[100, 300], rate_period=500, out_of_order=50, padding=80)
    one, eight = (G.auction_events(G.numbered(spark, 5000, n), plan) for n in (1, 8))
    assert values(one) == values(eight)
    kinds = {r.type: r["count"] for r in one.groupBy("type").count().collect()}
    assert kinds == {"person": 100, "auction": 300, "bid": 4600}
    assert one.filter("type = 'auction'").select("auction_id").distinct().count() == 300
    assert one.filter("length(extra) < 64 or length(extra) > 96").count() == 0
    assert one.filter("type = 'bid' and (auction < 1000 or bidder < 1000)").count() == 0
    ordered = G.auction_events(G.numbered(spark, 3000), G.AuctionPlan(gaps_us=[100, 300], rate_period=500)).orderBy("event_id").collect()
    assert [r.ms for r in ordered][:2] == [0, 0] and ordered[1000].ms == 200 and ordered[2999].ms == 500 + 99


def test_entities(spark):
    plan = [G.Scenario(0, 1000, 1, 1, 2), G.Scenario(2000, 2000, 1, 0, 0)]
    one, eight = (G.entity_events(G.numbered(spark, 4000, n), plan, padding=10) for n in (1, 8))
    assert values(one) == values(eight)
    kinds = {r.type: r["count"] for r in one.groupBy("type").count().collect()}
    assert kinds == {"A": 500 + 2000, "B": 500, "C": 1000}
    b = one.filter("type = 'B'").select("fk").distinct()
    assert b.join(one.filter("type = 'A'").select(F.col("pk").alias("fk")).distinct(), "fk", "left_anti").count() == 0
    at = {r.id: r.ms for r in one.collect()}
    assert (at[0], at[1999], at[2000], at[3999]) == (0, 1999, 2000, 2999)
    parsed = parse_entities(G.entity_events(G.numbered(spark, 50), plan, as_json=True))
    assert parsed.count() == 50 and parsed.filter("pk is null").count() == 0


def test_specs(spark):
    got = P.from_json(json.dumps({"dataAnalyticsQueries": [{"joinOperators": {"joinType": "TWO_WAY_EQUI_JOIN", "windowSizeMs": 5, "windowSlideMs": 5}, "downstreamOperator": {"metaTypeInfo": "RollingReduce", "groupByField": "f0"}}], "streamingETLQueries": [{"extractOperation": {"operationType": "EXTRACT_JSON"}, "downstreamOperator": {"metaTypeInfo": "RollingSumAndPOJOToX", "windowSizeMs": 259_200_000, "windowSlideMs": 86_400_000, "filterField": "B"}}, {"extractOperation": {"operationType": "EXTRACT_JSON"}, "downstreamOperator": {"metaTypeInfo": "DataEnrichmentFunction", "filterField": "A"}}]}))
    assert [len(g) for g in P.groups(got).values()] == [1, 2]
    e = V.entity(spark, SF)
    one, two, three = P.build(got, e, V.json_entity(e), V.dimension(spark, SF))
    assert two.columns == ["window_start", "key", "total", "payload"] and two.count() > 0
    assert three.count() == e.filter("type = 'A'").count()
    mixed = P.family(32, None)
    assert len(P.groups(mixed)) == 1 and len({q.ranges for q in mixed}) > 5 and len({q.ranges for q in P.family(32, 10)}) == 1


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    write_text(df, str(tmp_path / "x"))
    with pytest.raises(Exception):
        write_text(df, str(tmp_path / "x"))
    discard(df)


def test_shedding(spark):
    df = spark.range(1000).select("id", (F.col("id") * 10).alias("ms"))
    rates = spark.createDataFrame([(0, 0.0, 10**6), (1000, 1.0, -(10**6)), (2000, 0.5, 0)], "interval_ms bigint, rate double, backlog bigint")
    got = S.shed(df, rates, "ms", 1000, "id", 100, 4)
    n = {r.b: r["count"] for r in got.groupBy(F.floor(F.col("ms") / 1000).alias("b")).count().collect()}
    assert 0 not in n and n[1] == 100 and 30 < n[2] < 70 and n[3] == 100


def test_three_way_pairs_as_spans(spark, monkeypatch):
    """Pairs that stay spans through the second join give the rows that pairs per window give; so for masks of any size."""
    import random

    from tideweave.operators import joins as J
    from tideweave.operators import queryset as Q

    r = random.Random(4)
    rows = [(i, r.randrange(5), r.randrange(5), r.randrange(400), r.randrange(10)) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, pk int, fk int, ms bigint, filter_attr int")
    for n in (5, 70):
        sides = [J.named(Q.assign(df, [(q, q % 4, q % 4 + 5) for q in range(n)]), k) for k in "abc"]

        def triples(size, slide, sides=sides):
            t = J.three_way(*sides, ("a_pk", "b_fk"), ("b_pk", "c_fk"), ("a_ms", "b_ms", "c_ms"), size, slide, ("a_qmask", "b_qmask", "c_qmask"))
            return t.groupBy("a_id", "b_id", "c_id", "pair_ms", "window_start", "qmask").count()

        for size, slide in ((60, 10), (35, 10), (40, 4)):
            monkeypatch.setattr(J, "SPANS", 10**9)
            want = sorted(map(str, triples(size, slide).collect()))
            monkeypatch.setattr(J, "SPANS", 0)
            assert sorted(map(str, triples(size, slide).collect())) == want and want


def test_more_than_63_queries(spark):
    from tideweave.operators import queryset as Q

    df = spark.range(100).selectExpr("id", "cast(id as int) as filter_attr")
    ranges = [(q, q, q + 1) for q in range(0, 130, 3)]
    got = Q.per_query(Q.assign(df, ranges), 130).collect()
    assert sorted((x.id, x.qid) for x in got) == sorted((v, q) for v in range(100) for q, lo, hi in ranges if lo <= v <= hi)
    assert Q.of_query(Q.assign(df, ranges), 66).count() == 2 and Q.per_query(Q.stamp(df, [0, 64]), 65).count() == 200


@pytest.fixture
def wide(spark):
    """Partitions stay apart, however small."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("false", "-1")):
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("keys", [1, 4])
def test_ranges_and_values_are_the_plain_forms(wide, keys):
    """Running maxima by ranges and medians by counts give what one sorted window per key gives, with nulls anywhere."""
    from pyspark.sql import Window

    r = random.Random(keys)
    maybe = lambda x: None if r.random() < 0.1 else x
    rows = [(i, maybe(r.randrange(keys)), r.randrange(-300, 900), maybe(r.randrange(-5, 40 + i // 9))) for i in range(400)]
    df = wide.createDataFrame(rows, "id int, k int, ms bigint, v int")
    by = Window.partitionBy("k")
    order = by.orderBy("ms", "id").rowsBetween(Window.unboundedPreceding, -1)
    plain = df.withColumn("p", F.max("v").over(order)).filter("p is null or v > p").drop("p")
    assert values(A.rising(df, ["k"], "v", ["ms", "id"], 50)) == values(plain)
    plain = df.withColumn("peak", F.greatest(F.max("v").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(3)))
    assert values(A.running_peak(df, ["k"], "v", ["ms", "id"], 3, step=50)) == values(plain)
    placed = df.withColumn("p", F.row_number().over(by.orderBy("v", "ms", "id"))).withColumn("n", F.count(F.lit(1)).over(by)).filter("p = floor(n / 2) + 1").drop("p", "n")
    assert values(A.upper_median(df, ["k"], "v", ["ms", "id"])) == values(placed)
    none = df.limit(0)
    assert not A.rising(none, ["k"], "v", ["ms", "id"]).count() + A.running_peak(none, ["k"], "v", ["ms", "id"]).count() + A.upper_median(none, ["k"], "v", ["id"]).count()


def test_one_key_is_many_tasks(wide):
    df = wide.range(4000).selectExpr("id", "1 as k", f"id * {3_600_000} as ms", "id % 97 as v")
    for got in (A.running_peak(df, ["k"], "v", ["ms"]), A.rising(df.withColumn("v", F.col("id")), ["k"], "v", ["ms"])):
        tasks = [x["count"] for x in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == 4000 and len(tasks) > 4 and max(tasks) < 1500

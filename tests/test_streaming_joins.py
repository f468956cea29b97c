"""Stateful joins, order statistics, switches and hand-overs on streams, against the batch operators."""

import pytest
from pyspark.sql import functions as F

from tideweave.functions.windows import DAY
from tideweave.operators import aggregates as A
from tideweave.operators import joins as J
from tideweave.operators import queryset as Q
from tideweave.plans.queries import MIXED, SIZE, SLIDE, _pairs, _triples
from tideweave.sources import views as V
from tideweave.streaming import control as C
from tideweave.streaming import joins as W
from tideweave.streaming import order as O
from tideweave.streaming import stateful as S

from .test_streaming import result, rocks, rows, stream, with_last  # noqa: F401

SF = "/root/testdata/sf0.001"


def sides(spark, tmp_path, kinds="AB", parts=3):
    e = V.entity(spark, SF)
    return [J.named(stream(spark, e.filter(F.col("type") == k), tmp_path / k, parts).withWatermark("ts", "1 day"), k.lower()) for k in kinds]


def state_rows(name, query):
    return [sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress]


@pytest.mark.parametrize("slide", [SIZE, SLIDE])
def test_pairs_once(rocks, tmp_path, slide):  # noqa: F811
    """Pairs and their spans are those of the batch join."""
    a, b = sides(rocks, tmp_path)
    got = result(W.window_pairs_once(a, b, ("a_pk", "b_fk"), ("a_ts", "b_ts"), SIZE, slide), f"once{slide}", tmp_path)
    e = V.entity(rocks, SF)
    want = J.window_join(*(J.named(e.filter(F.col("type") == k), k.lower()) for k in "AB"), [("a_pk", "b_fk")], ("a_ms", "b_ms"), SIZE, slide)
    assert rows(got, "one.a_id", "two.b_id", "first_window", "last_window") == rows(want, "a_id", "b_id", "first_window", "last_window") != []


def test_state_has_rows_once(rocks, tmp_path):  # noqa: F811
    """Windows of 60 hours every hour: state has a list per key, side and bucket, not a row per window; old buckets go."""
    hour = DAY // 24
    a, b = sides(rocks, tmp_path, parts=6)
    pairs = W.window_pairs_once(a, b, ("a_pk", "b_fk"), ("a_ts", "b_ts"), 60 * hour, hour)
    q = pairs.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    total = V.entity(rocks, SF).filter("type in ('A', 'B')").count()
    seen = [sum(o.numRowsTotal for o in p.stateOperators) for p in q.recentProgress]
    assert 0 < max(seen) <= 3 * total and seen[-1] < max(seen)


def test_join_then_aggregate(rocks, tmp_path):  # noqa: F811
    """Counts per window and key behind the join, in one query."""
    e = V.entity(rocks, SF)
    x = {k: with_last(rocks, e.filter(F.col("type") == k), pk=-1, fk=-1, id=-1)[0] for k in "AB"}
    a, b = (J.named(stream(rocks, x[k], tmp_path / k, 3).withWatermark("ts", "0 seconds"), k.lower()) for k in "AB")
    pairs = W.window_pairs_once(a, b, ("a_pk", "b_fk"), ("a_ts", "b_ts"), SIZE, SLIDE, each=True)
    counts = pairs.groupBy(F.window("ts", "1 day").alias("w"), "first_window", "key").agg(F.count("*").alias("n"))
    got = result(counts, "behind", tmp_path).filter("key >= 0")
    assert rows(got, "first_window", "key", "n") == rows(_pairs(rocks, SF).groupBy("window_start", "a_pk").agg(F.count("*").alias("n")), "window_start", "a_pk", "n") != []


def test_three_way(rocks, tmp_path):  # noqa: F811
    a, b, c = sides(rocks, tmp_path, "ABC", 2)
    got = result(W.three_way_once(a, b, c, ("a_pk", "b_fk"), ("b_pk", "c_fk"), ("a_ts", "b_ts", "c_ts"), SIZE, SLIDE), "three", tmp_path)
    want = _triples(rocks, SF)
    assert rows(got, "one.a_id", "two.b_id", "three.c_id", "pair_ms", "window_start") == rows(want, "a_id", "b_id", "c_id", "pair_ms", "window_start") != []


def test_late_rows_join_nothing(rocks, tmp_path):  # noqa: F811
    e = V.entity(rocks, SF)
    a = e.filter("type = 'A'")
    x, top = with_last(rocks, a, pk=-1, fk=-1, id=-1)
    late = a.orderBy("ms").limit(20).withColumn("id", F.col("id") + 1_000_000)
    path = tmp_path / "late"
    stream(rocks, x, path, 2)
    rocks.createDataFrame(late.collect(), late.schema).coalesce(1).write.mode("append").parquet(str(path))
    one = J.named(rocks.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(str(path)).withWatermark("ts", "0 seconds"), "a")
    two = J.named(stream(rocks, with_last(rocks, e.filter("type = 'B'"), pk=-1, fk=-1, id=-1)[0], tmp_path / "b", 2).withWatermark("ts", "0 seconds"), "b")
    got = result(W.window_pairs_once(one, two, ("a_pk", "b_fk"), ("a_ts", "b_ts"), SIZE, SLIDE), "latejoin", tmp_path)
    assert got.filter("one.a_id >= 1000000").count() == 0


def test_order_statistics(rocks, tmp_path):  # noqa: F811
    e = V.entity(rocks, SF).filter("type = 'A'").withColumn("v", F.col("long2") % 40)
    x, _ = with_last(rocks, e, sel2=-1, v=0)
    s = stream(rocks, x, tmp_path / "o").withWatermark("ts", "0 seconds")
    got = result(O.median_stream(s, ["sel2"], "v", "ts", "3 days", "1 day"), "medians", tmp_path).filter("sel2 >= 0")
    from tideweave.functions.windows import with_windows

    w = with_windows(e, "ms", SIZE, SLIDE)
    mid = A.upper_median(w, ["window_start", "sel2"], "v", ["id"])
    n = w.groupBy("window_start", "sel2").agg(F.count("*").alias("n"))
    assert rows(got, "window_start", "sel2", "median", "n") == rows(mid.join(n, ["window_start", "sel2"]), "window_start", "sel2", "v", "n") != []
    top = result(O.top_mean_stream(s, "sel2", "v", "ts", 3 * DAY, DAY, 4), "tops", tmp_path).filter("key >= 0")
    want = A.top_mean(w, ["window_start", "sel2"], "v", 4)
    assert [(a, b, round(c, 9)) for a, b, c in rows(top, "window_start", "key", "mean")] == [(a, b, round(c, 9)) for a, b, c in rows(want, "window_start", "sel2", "mean")] != []


def test_streamed_switches(rocks, tmp_path):  # noqa: F811
    """A query switched on or off within the stream gets the rows from that time on only, as with spans in a table."""
    e = Q.assign(V.entity(rocks, SF).filter("type = 'A'"), MIXED)
    lo, hi = e.agg(F.min("ms"), F.max("ms")).first()
    t = lambda share: lo + int((hi - lo) * share)
    switches = [(q, t(0.1 * (q % 5)), True) for q in range(8)] + [(q, t(0.5), False) for q in range(0, 8, 2)] + [(4, t(0.7), True), (4, t(0.9), False), (9, t(0.3), False)]
    spans = [(q, t(0.1 * (q % 5)), t(0.5) if q % 2 == 0 else 2**60) for q in range(8)] + [(4, t(0.7), t(0.9))]
    want = Q.active_at(e, rocks.createDataFrame([s for s in spans if s[1] < s[2]], "qid int, active_from bigint, active_to bigint"), 32)
    control = rocks.createDataFrame(switches, "qid int, ms bigint, active boolean").withColumn("ts", F.timestamp_millis("ms"))
    far = rocks.createDataFrame([(-1, hi + 20 * DAY, True)], "qid int, ms bigint, active boolean").withColumn("ts", F.timestamp_millis("ms"))
    data, _ = with_last(rocks, e, 20 * DAY, pk=-1, qmask=0, id=-1)
    got = C.active_stream(stream(rocks, data, tmp_path / "d", 4).withWatermark("ts", "2 days"), stream(rocks, control.unionByName(far), tmp_path / "c", 4).withWatermark("ts", "2 days"), 32, salts=3)
    got = result(got, "switched", tmp_path)
    assert rows(got, "row.id", "qid") == rows(want, "id", "qid") != []


def test_hand_over(rocks, tmp_path):  # noqa: F811
    """Batch to noon, a stream after it: together they are one batch."""
    e = V.entity(rocks, SF).filter("type = 'A'")
    noon = e.agg(F.percentile_approx("ms", 0.5)).first()[0]
    before, after = e.filter(F.col("ms") <= noon), e.filter(F.col("ms") > noon)
    peaks = before.groupBy("pk").agg(F.max("long2").alias("long2"))
    got = result(S.rising_stream(stream(rocks, after, tmp_path / "r"), "pk", "long2", initial=peaks), "handed", tmp_path)
    early = A.rising(before, ["pk"], "long2", ["ms", "id"]).select("pk", "id", "long2")
    want = A.rising(e, ["pk"], "long2", ["ms", "id"])
    assert sorted(rows(got, "key", "id", "value") + rows(early, "pk", "id", "long2"), key=str) == rows(want, "pk", "id", "long2") != []

    m = Q.assign(e, MIXED)
    day = noon // DAY * DAY
    one, two = m.filter(F.col("ms") < day), m.filter(F.col("ms") >= day)
    x, _ = with_last(rocks, two, pk=-1, long1=1, qmask=1, id=0)
    highs = A.window_records(one, "ms", DAY, ["pk"], "long1", ["ms", "id"], ["qmask"])
    s = stream(rocks, x, tmp_path / "w").withWatermark("ts", "0 seconds")
    got = result(S.window_records_stream(s, "1 day", "pk", "long1", initial=one.groupBy("pk").agg(F.max("long1").alias("long1"))), "highs", tmp_path).filter("key >= 0")
    want = A.window_records(m, "ms", DAY, ["pk"], "long1", ["ms", "id"], ["qmask"])
    assert sorted(rows(got, "key", "window_start", "value", "qmask") + rows(highs, "pk", "window_start", "long1", "qmask"), key=str) == rows(want, "pk", "window_start", "long1", "qmask") != []


def test_winning_bids_hand_over(rocks, tmp_path):  # noqa: F811
    """Auctions and bids of a table, then more of both from streams: the winners are those of one batch."""
    a = V.auction(rocks, SF).filter("id % 3 = 0").withColumn("ts", F.timestamp_millis("ms"))
    b = V.bid(rocks, SF).filter("auction % 3 = 0").withColumn("ts", F.timestamp_millis("ms"))
    noon = a.agg(F.percentile_approx("ms", 0.5)).first()[0]
    want = J.winning_bids(a, b)
    far = 40 * 365 * DAY
    la, _ = with_last(rocks, a.filter(F.col("ms") > noon), far, id=-1, expires_ms=2**50, reserve=0, seller=0, category=0)
    lb, _ = with_last(rocks, b.filter(F.col("ms") > noon), far, auction=-2, bidder=0, price=0)
    state = S.auction_state(a.filter(F.col("ms") <= noon), b.filter(F.col("ms") <= noon))
    got = result(S.winning_bids_stream(stream(rocks, la, tmp_path / "a", 1), stream(rocks, lb, tmp_path / "b", 1), "20 years", initial=state), "wonlater", tmp_path)
    cols = ("auction", "price", "category", "seller", "expires_ms")
    assert rows(got, *cols) == rows(want, *cols) and want.count() > 100

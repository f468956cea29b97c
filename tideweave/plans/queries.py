"""Named queries over the tables: name -> function of (spark, folder of tables)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import full_name
from ..functions.masks import mask_words, words_in
from ..functions.windows import DAY, emitted_at, first_start, floor_to, starts
from ..operators import aggregates as A
from ..operators import custom as U
from ..operators import factorised as X
from ..operators import joins as J
from ..operators import queryset as Q
from ..operators import stats as S
from ..operators.etl import parse_entities, serialised_sums
from ..sources import generate as G
from ..sources import lines as L
from ..sources import views as V
from ..sources.sinks import once, scratch, write_stream, write_text
from . import specs as P

SIZE, SLIDE = 3 * DAY, DAY
LONG, STEP = 60 * DAY, 10 * DAY
N = 32
#: query, lo, hi: mixed selectivity from 0, and a tenth of the domain each
MIXED = [(q, 0, (37 * q + 11) % 100) for q in range(N)]
TENTHS = [(q, (29 * q) % 91, (29 * q) % 91 + 9) for q in range(N)]
# Rows of A and of B in a sample for splitting queries.
SAMPLE = (850, 150)
FIFTHS = [(20 * i, 20 * i + 19) for i in range(5)]

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _side(spark, sf_dir, kind: str, mask=None) -> DataFrame:
    rows = V.entity(spark, sf_dir).filter(F.col("type") == kind)
    return J.named(mask(rows) if mask else rows, kind.lower())


def _pairs(spark, sf_dir, size=SIZE, slide=SLIDE, mask=None) -> DataFrame:
    a, b = (_side(spark, sf_dir, k, mask) for k in "AB")
    masks = ("a_qmask", "b_qmask") if mask else None
    return J.in_each_window(J.window_join(a, b, [("a_pk", "b_fk")], ("a_ms", "b_ms"), size, slide, masks), slide)


THREE = (("a_pk", "b_fk"), ("b_pk", "c_fk"), ("a_ms", "b_ms", "c_ms"))


# projections and filters


@query
def pass_through(spark, sf_dir):
    return V.bid(spark, sf_dir)


@query
def filter_bids(spark, sf_dir):
    """One type of the event stream."""
    return V.events(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", F.unix_millis("ts").alias("ms"), "user_id", "value", "props")


@query
def map_long(spark, sf_dir):
    return V.bid(spark, sf_dir).select("auction", F.floor(F.col("price") * F.lit(0.92).cast("double") + F.lit(0.5).cast("double")).alias("euros"))


@query
def map_string(spark, sf_dir):
    return V.bid(spark, sf_dir).select("auction", F.substring("extra", 1, 10).alias("extra"))


@query
def narrow_entities(spark, sf_dir):
    """Only what a join needs: side, key, filter attribute and query set."""
    rows = Q.assign(V.entity(spark, sf_dir).filter("type <> 'C'"), MIXED)
    is_a = F.col("type") == "A"
    return rows.select(is_a.alias("is_a"), F.when(is_a, F.col("pk")).otherwise(F.col("fk")).cast("int").alias("key"), "filter_attr", "qmask")


@query
def json_extract(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    json = F.to_json(F.struct(F.col("c_name").alias("firstName"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).alias("lastName")))
    return c.select("c_custkey", full_name(json).alias("full_name"))


@query
def entity_wire(spark, sf_dir):
    """Entities as tab-separated lines, parsed again."""
    e, empty = V.entity(spark, sf_dir), F.lit("")
    whole = [F.col(c).cast("string") for c in ("id", "ms", "ms", "pk", "fk", "sel1", "sel2", "long1", "long2", "filter_attr")]
    lines = e.select(F.concat_ws("\t", "type", *whole, F.concat(F.lit("text"), F.col("id").cast("string")), *[empty] * 4).alias("value"))
    return L.entity_lines(lines).select("type", "id", "ms", "pk", "fk", "sel1", "sel2", "long1", "long2", "filter_attr", "text", "json")


@query
def narrow_wire(spark, sf_dir):
    """Of the lines of A and B, only what a join needs."""
    e = V.entity(spark, sf_dir).filter("type <> 'C'")
    whole = [F.col(c).cast("string") for c in ("id", "ms", "ms", "pk", "fk", "sel1", "sel2", "long1", "long2", "filter_attr")]
    return L.narrow_lines(e.select(F.concat_ws("\t", "type", *whole, *[F.lit("")] * 5).alias("value")))


@query
def auction_wire(spark, sf_dir):
    """Bids and auctions as comma-separated lines, parsed again with their event time: prices per auction that has both."""
    at = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd HH:mm:ss")
    line = lambda *c: F.concat_ws(",", *c).alias("value")
    text = lambda *names: [F.col(n).cast("string") for n in names]
    bids = V.bid(spark, sf_dir).select(line(F.lit("2"), *text("auction", "bidder", "price"), at("ms"), "extra"))
    sold = V.auction(spark, sf_dir).select(line(F.lit("1"), *text("id"), F.lit("item"), F.lit(""), *text("reserve", "reserve"), at("ms"), at("expires_ms"), *text("seller", "category"), F.lit(""), *text("sell_below_reserve")))
    events = L.auction_lines(bids.unionByName(sold))
    b = L.with_event_time(L.of_type(events, "bid")).groupBy("auction").agg(F.sum("price").alias("total"), F.max(F.unix_millis("ts")).alias("last_ms"))
    a = L.of_type(events, "auction").select("id", "reserve", "category", "seller", F.unix_millis("expires").alias("expires_ms"))
    return a.join(b, a.id == b.auction).drop("auction")


@query
def file_stream(spark, sf_dir):
    """Bids into the text sink; its files as a stream of lines with event time, into a file sink; per auction and day of that."""
    folder = scratch(spark)
    at = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd HH:mm:ss")
    write_text(V.bid(spark, sf_dir).select(F.lit(2), "auction", "bidder", "price", at, "extra"), f"{folder}/lines")
    lines = spark.readStream.text(f"{folder}/lines")
    bids = L.with_event_time(L.of_type(L.auction_lines(lines), "bid"), "1 day")
    write_stream(bids, f"{folder}/bids", f"{folder}/checkpoint").awaitTermination()
    rows = spark.read.schema(bids.schema).parquet(f"{folder}/bids")
    return rows.groupBy("auction", floor_to(F.unix_millis("ts"), DAY).alias("day")).agg(F.count("*").alias("n"), F.sum("price").alias("total"))


# window joins


def _peak_rows(pairs: DataFrame) -> DataFrame:
    """Rows that raise the maximum of their key."""
    return A.rising(pairs, ["a_long1"], "a_long2", ["window_start", "a_id", "b_id"]).select("a_long1", "window_start", "a_id", "b_id", "a_long2")


def _median_pairs(pairs: DataFrame) -> DataFrame:
    """The median pair per key over sliding windows of the join's results."""
    at = emitted_at("window_start", SIZE)
    rows = pairs.select("a_id", "b_id", "b_long1", "b_long2", at.alias("out_ms"), first_start(at, SIZE, SLIDE).alias("first_window"), floor_to(at, SLIDE).alias("last_window"))
    return A.span_median(rows, ["b_long1"], "b_long2", ["a_id", "b_id", "out_ms"], SLIDE, name="out_window").select("out_window", "b_long1", "a_id", "b_id", "b_long2")


def _tumbling(spark, sf_dir) -> DataFrame:
    return once(_pairs(spark, sf_dir, SIZE, SIZE).select("window_start", "a_id", "b_id", "a_long1", "a_long2", "b_long1", "b_long2"))


@query
def window_join_q1(spark, sf_dir):
    """Tumbling join, then rows that raise the maximum of their key."""
    return _peak_rows(_pairs(spark, sf_dir, SIZE, SIZE))


@query
def window_join_q2(spark, sf_dir):
    """Tumbling join, then the median pair per key over sliding windows of the join's results."""
    return _median_pairs(_tumbling(spark, sf_dir))


@query
def window_join_sliding(spark, sf_dir):
    """The sliding join itself: each pair and how many windows it shares."""
    a, b = (_side(spark, sf_dir, k) for k in "AB")
    pairs = J.window_join(a, b, [("a_pk", "b_fk")], ("a_ms", "b_ms"), SIZE, SLIDE)
    return pairs.select("a_id", "b_id", "first_window", "last_window", J.shared_windows(SLIDE).cast("bigint").alias("n_windows"))


@query
def window_join_narrow(spark, sf_dir):
    """Pairs per window of keys and query sets only."""
    cols = lambda k, key: J.named(Q.assign(V.entity(spark, sf_dir).filter(F.col("type") == k), MIXED).select(F.col(key).cast("int").alias("key"), "ms", "qmask"), k.lower())
    pairs = J.window_join(cols("A", "pk"), cols("B", "fk"), [("a_key", "b_key")], ("a_ms", "b_ms"), SIZE, SLIDE, ("a_qmask", "b_qmask"))
    return J.in_each_window(pairs, SLIDE).groupBy("window_start", "a_key", "qmask").agg(F.count("*").alias("n"))


@query
def window_join_joint(spark, sf_dir):
    """Both queries over one join: `which` tells them apart."""
    pairs = _tumbling(spark, sf_dir)
    one = _peak_rows(pairs).select(F.lit("peak").alias("which"), "window_start", F.col("a_long1").alias("key"), "a_id", "b_id", F.col("a_long2").alias("value"))
    two = _median_pairs(pairs).select(F.lit("median").alias("which"), F.col("out_window").alias("window_start"), F.col("b_long1").alias("key"), "a_id", "b_id", F.col("b_long2").alias("value"))
    return one.unionByName(two)


@query
def three_way_q1(spark, sf_dir):
    """Rows of the tumbling three-way join that raise the maximum of their key: of a row of A only its first triple can."""
    a, b, c = (_side(spark, sf_dir, k) for k in "ABC")
    return _peak_triples(a, b, c).select("a_long1", "window_start", "a_id", "c_id", "a_long2")


def _peak_triples(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    firsts = X.first_triples(a.select("a_id", "a_pk", "a_ms", "a_long1", "a_long2"), b, c, *THREE, SIZE, ("b_id", "c_id"))
    high = A.rising(firsts, ["a_long1"], "a_long2", ["window_start", "a_id", "b_id", "c_id"]).select("a_long1", "window_start", "a_pk", "a_ms", "a_id", "b_id", "c_id", "a_long2")
    # before a key's first value a null exceeds nothing and nothing exceeds it: all triples of such a row stay
    high = once(high)
    whole = J.three_way(high.filter("a_long2 is null").drop("window_start", "b_id", "c_id"), b, c, *THREE, SIZE, SIZE)
    return high.filter("a_long2 is not null").drop("a_pk", "a_ms").unionByName(whole.select("a_long1", "window_start", "a_id", "b_id", "c_id", "a_long2"))


@query
def three_way_q2(spark, sf_dir):
    """The median triple per window and key of the sliding three-way join, from the three sides' counts."""
    a, b, c = (_side(spark, sf_dir, k) for k in "ABC")
    return X.three_way_median(a, b, c, *THREE, SIZE, SLIDE, ["c_long1"], "c_long2", ("a_id", "b_id", "c_id"))


@query
def three_way_joint(spark, sf_dir):
    one = three_way_q1(spark, sf_dir).select(F.lit("peak").alias("which"), "window_start", F.col("a_long1").alias("key"), "a_id", "c_id", F.col("a_long2").alias("value"))
    two = three_way_q2(spark, sf_dir).select(F.lit("median").alias("which"), "window_start", F.col("c_long1").alias("key"), "a_id", "c_id", F.col("c_long2").alias("value"))
    return one.unionByName(two)


# many queries over one join


def _shared(spark, sf_dir) -> DataFrame:
    return Q.per_query(_pairs(spark, sf_dir, mask=lambda r: Q.assign(r, MIXED)), N)


def _sums(spark, sf_dir, ranges, slide, by: list[str], sums: list[str]) -> DataFrame:
    """Counts and sums of the shared join, from both sides' counts."""
    n = len(ranges)
    a, b = (_side(spark, sf_dir, k, lambda r: Q.assign(r, ranges)) for k in "AB")
    return X.window_join_sums(a, b, ("a_pk", "b_fk"), ("a_ms", "b_ms"), SIZE, slide, by, sums, ("a_qmask", "b_qmask"), n)


@query
def shared_join_mean(spark, sf_dir):
    return _sums(spark, sf_dir, MIXED, SLIDE, ["a_pk"], ["b_long2"]).select("qid", "window_start", "a_pk", X.mean_of("b_long2").alias("mean"))


@query
def shared_join_count(spark, sf_dir):
    return _sums(spark, sf_dir, MIXED, SLIDE, ["a_pk"], [])


@query
def shared_join_median(spark, sf_dir):
    a, b = (_side(spark, sf_dir, k, lambda r: Q.assign(r, MIXED)) for k in "AB")
    pairs = once(J.window_join(a, b, [("a_pk", "b_fk")], ("a_ms", "b_ms"), SIZE, SLIDE, ("a_qmask", "b_qmask")).select("a_id", "b_id", "b_long1", "b_long2", "qmask", "first_window", "last_window"))
    return A.span_median(pairs, ["b_long1"], "b_long2", ["a_id", "b_id"], SLIDE, "qmask", N).select("qid", "window_start", "b_long1", "a_id", "b_id", "b_long2")


@query
def shared_join_max(spark, sf_dir):
    return A.rising(_shared(spark, sf_dir), ["qid", "a_long1"], "a_long2", ["window_start", "a_id", "b_id"]).select("qid", "a_long1", "window_start", "a_id", "b_id", "a_long2")


@query
def shared_three_way_count(spark, sf_dir):
    sides = [_side(spark, sf_dir, k, lambda r: Q.assign(r, MIXED)) for k in "ABC"]
    return X.three_way_counts(*sides, ("a_pk", "b_fk"), ("b_pk", "c_fk"), ("a_ms", "b_ms", "c_ms"), SIZE, ("a_qmask", "b_qmask", "c_qmask"), N)


@query
def shared_aggregation_median(spark, sf_dir):
    rows = Q.assign(V.entity(spark, sf_dir).filter("type = 'A'"), TENTHS).select("id", "filter_attr", "long2", "qmask", first_start("ms", SIZE, SLIDE).alias("first_window"), floor_to("ms", SLIDE).alias("last_window"))
    return A.span_median(rows, ["filter_attr"], "long2", ["id"], SLIDE, "qmask", N).select("qid", "window_start", "filter_attr", "id", "long2")


@query
def shared_aggregation_mean(spark, sf_dir):
    """Sliding means for all queries by panes."""
    rows = Q.per_query(Q.assign(V.entity(spark, sf_dir).filter("type = 'A'"), TENTHS), N)
    return A.sliding_mean(rows, "ms", SIZE, SLIDE, ["qid", "filter_attr"], "long2")


@query
def many_queries(spark, sf_dir):
    """A hundred queries: sets of several words."""
    ranges = [(q, q % 90, q % 90 + 9) for q in range(100)]
    rows = V.entity(spark, sf_dir).withColumn("words", mask_words("filter_attr", ranges, integral=True))
    return rows.withColumn("qid", F.explode(words_in("words", 100))).groupBy("qid", "type").agg(F.count("*").alias("n"), F.sum("long2").alias("total"))


@query
def predicate_table(spark, sf_dir):
    """Query sets from a table of predicates."""
    table = spark.createDataFrame([(q, lo, hi) for q, lo, hi in MIXED], "qid int, lo int, hi int")
    rows = Q.assign_by_table(V.entity(spark, sf_dir), table, "id")
    return rows.select("id", "type", F.array_join("qids", ",").alias("qids"))


@query
def query_activation(spark, sf_dir):
    """Queries that a control table switches on and off: counts per query and day."""
    days = 1_704_067_200_000
    control = spark.createDataFrame([(q, days + (q % 7) * DAY, days + (q % 7 + 3 + q % 11) * DAY) for q in range(N)], "qid int, active_from bigint, active_to bigint")
    rows = Q.active_at(Q.assign(V.entity(spark, sf_dir), MIXED), control, N)
    return rows.groupBy("qid", floor_to("ms", DAY).alias("day")).agg(F.count("*").alias("n"))


@query
def spec_queries(spark, sf_dir):
    """Queries from a JSON configuration: two share a join, a third has its own."""
    specs = P.from_json(SPECS)
    return P.together(P.build(specs, V.entity(spark, sf_dir)))


SPECS = """{"dataAnalyticsQueries": [
 {"joinOperators": {"joinType": "TWO_WAY_EQUI_JOIN", "windowSizeMs": 259200000, "windowSlideMs": 259200000},
  "downstreamOperator": {"metaTypeInfo": "RollingReduce", "aggregationType": "MAX", "groupByField": "f0"}},
 {"joinOperators": {"joinType": "TWO_WAY_EQUI_JOIN", "windowSizeMs": 259200000, "windowSlideMs": 259200000},
  "filter": {"startForEntityA": 0, "endForEntityA": 59, "startForEntityB": 20, "endForEntityB": 99},
  "downstreamOperator": {"metaTypeInfo": "WindowAggregation", "windowSizeMs": 259200000, "windowSlideMs": 86400000, "aggregationType": "MEAN", "groupByField": "f1"}},
 {"joinOperators": {"joinType": "THREE_WAY_EQUI_JOIN", "windowSizeMs": 86400000, "windowSlideMs": 86400000},
  "downstreamOperator": {"metaTypeInfo": "WindowAggregation", "windowSizeMs": 86400000, "windowSlideMs": 86400000, "aggregationType": "COUNT", "groupByField": "f0"}}],
 "streamingETLQueries": []}"""


@query
def shared_join_100(spark, sf_dir):
    """A hundred range queries over one join: query sets of several words."""
    ranges = [(q, q % 90, q % 90 + 9 + q % 7) for q in range(100)]
    return _sums(spark, sf_dir, ranges, SIZE, [], [])


@query
def workload_family(spark, sf_dir):
    """Queries of one generated workload, windows of 60 hours every hour: pairs per query, counted in each shared window."""
    n, hour = 12, 3_600_000
    specs = P.family(n, None, size=60 * hour, slide=hour)
    ranges = lambda i: [(q, *s.ranges[i]) for q, s in enumerate(specs)]
    pane = (floor_to("ms", hour) / hour).cast("bigint").alias("pane")
    a, b = (Q.per_query(Q.assign(V.entity(spark, sf_dir).filter(F.col("type") == k), ranges(i)), n).select("qid", F.col(key).alias("key"), pane, F.lit(1).cast("bigint").alias("one")) for i, (k, key) in enumerate((("A", "pk"), ("B", "fk"))))
    # a row is in the 60 windows up to its pane: two rows d panes apart share 60 - d
    got = X.band_matches(a, b, ["qid", "key"], "pane", 59, ["one"], ["qid"], gaps=True)
    return got.select("qid", F.col("n_one").alias("pairs"), (60 * F.col("n_one") - F.col("gap_one")).alias("matches")).filter("pairs > 0")


# interval joins


def _interval(spark, sf_dir, mask=None) -> DataFrame:
    a, b = (_side(spark, sf_dir, k, mask) for k in "AB")
    return J.interval_join(a, b, [("a_pk", "b_fk")], ("a_ms", "b_ms"), SIZE, ("a_qmask", "b_qmask") if mask else None)


@query
def interval_join_pairs(spark, sf_dir):
    return _interval(spark, sf_dir).select("a_id", "b_id")


@query
def interval_join_mean(spark, sf_dir):
    rows = Q.per_query(_interval(spark, sf_dir, lambda r: Q.assign(r, MIXED)), N)
    return rows.groupBy("qid", floor_to(F.greatest("a_ms", "b_ms"), SLIDE).alias("window_start"), "a_pk").agg(F.avg("b_long2").alias("mean"))


@query
def interval_join_median(spark, sf_dir):
    late = floor_to(F.greatest("a_ms", "b_ms"), SLIDE)
    pairs = once(_interval(spark, sf_dir, lambda r: Q.assign(r, TENTHS)).select("a_pk", "a_id", "b_id", "qmask", late.alias("window_start")))
    return A.upper_median(Q.per_query(pairs, N), ["qid", "window_start"], "a_pk", ["a_id", "b_id"]).select("qid", "window_start", "a_pk", "a_id", "b_id")


# auctions


def _won(spark, sf_dir) -> DataFrame:
    auctions, bids = V.auction(spark, sf_dir), V.bid(spark, sf_dir)
    return J.winning_bids(auctions, bids, auctions.count() + bids.count())


@query
def winning_bids(spark, sf_dir):
    return _won(spark, sf_dir)


@query
def nexmark_q4(spark, sf_dir):
    """Mean winning price per category and sliding window of closing times."""
    return A.sliding_mean(_won(spark, sf_dir), "expires_ms", LONG, STEP, ["category"], "price")


@query
def nexmark_q6(spark, sf_dir):
    """Mean of each seller's ten highest winning prices per sliding window."""
    return A.sliding_top_mean(_won(spark, sf_dir), "expires_ms", LONG, STEP, ["seller"], "price")


@query
def nexmark_q4_q6_joint(spark, sf_dir):
    """Both queries over one run of the winning bids."""
    won = once(_won(spark, sf_dir))
    four = A.sliding_mean(won, "expires_ms", LONG, STEP, ["category"], "price").select(F.lit("category").alias("which"), "window_start", F.col("category").alias("key"), "mean")
    six = A.sliding_top_mean(won, "expires_ms", LONG, STEP, ["seller"], "price").select(F.lit("seller").alias("which"), "window_start", F.col("seller").alias("key"), "mean")
    return four.unionByName(six)


@query
def window_join_agg(spark, sf_dir):
    """Auctions with bids in shared windows, then the mean price per category in the windows of the results.

    Sums per window and category come first; only those few rows are copied into the later windows.
    """
    a = V.auction(spark, sf_dir).select("id", "category", F.col("ms").alias("a_ms"))
    b = V.bid(spark, sf_dir).select("auction", "price", F.col("ms").alias("b_ms"))
    sums = X.window_join_sums(a, b, ("id", "auction"), ("a_ms", "b_ms"), LONG, STEP, ["category"], ["price"])
    later = sums.select("window_start", "category", F.col("sum_price").alias("s"), "n").withColumn("out_window", F.explode(starts(emitted_at("window_start", LONG), LONG, STEP)))
    return later.groupBy("out_window", "category").agg((F.sum("s").cast("double") / F.sum("n")).alias("mean"))


# JSON to enriched rows and serialised sums


def _parsed(spark, sf_dir) -> DataFrame:
    return parse_entities(V.json_entity(V.entity(spark, sf_dir)))


def _enriched(spark, sf_dir, parsed: DataFrame) -> DataFrame:
    return J.lookup(parsed.filter("type = 'A'"), V.dimension(spark, sf_dir), ("pk", "user_id")).select("id", "ms", "pk", "long2", "name", "nation")


@query
def etl_enrich(spark, sf_dir):
    return _enriched(spark, sf_dir, _parsed(spark, sf_dir))


@query
def etl_window_sum(spark, sf_dir):
    return serialised_sums(_parsed(spark, sf_dir).filter("type = 'B'"), "ms", SIZE, SIZE, "pk", "long2")


@query
def etl_joint(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    one = _enriched(spark, sf_dir, parsed).select(F.lit("enrich").alias("which"), F.col("id").alias("key"), "ms", F.concat_ws("/", "name", "nation").alias("out"))
    two = serialised_sums(parsed.filter("type = 'B'"), "ms", SIZE, SIZE, "pk", "long2").select(F.lit("sum").alias("which"), "key", F.col("window_start").alias("ms"), F.col("payload").alias("out"))
    return one.unionByName(two)


@query
def etl_shared(spark, sf_dir):
    """Sums for many range queries over one parse."""
    rows = Q.per_query(Q.assign(_parsed(spark, sf_dir).filter("type = 'B'"), TENTHS), N)
    return rows.groupBy("qid", floor_to("ms", SIZE).alias("window_start"), "pk").agg(F.sum("long1").alias("total"))


@query
def etl_spec_filtered(spark, sf_dir):
    """ETL queries from a JSON configuration, two of them with ranges, over one parse."""
    specs = P.from_json(ETL_SPECS)
    enriched, sums, every = P.build(specs, None, V.json_entity(V.entity(spark, sf_dir)), V.dimension(spark, sf_dir))
    rows = [enriched.select(F.lit(0).alias("qid"), F.col("id").alias("key"), "ms", F.concat_ws("/", "name", "nation").alias("out"))]
    rows += [x.select(F.lit(q).alias("qid"), "key", F.col("window_start").alias("ms"), F.col("payload").alias("out")) for q, x in ((1, sums), (2, every))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


ETL_SPECS = """{"dataAnalyticsQueries": [], "streamingETLQueries": [
 {"extractOperation": {"operationType": "EXTRACT_JSON"}, "filter": {"startForEntityB": 10, "endForEntityB": 49},
  "downstreamOperator": {"metaTypeInfo": "DataEnrichmentFunction", "filterField": "A"}},
 {"extractOperation": {"operationType": "EXTRACT_JSON"}, "filter": {"startForEntityB": 30, "endForEntityB": 79},
  "downstreamOperator": {"metaTypeInfo": "RollingSumAndPOJOToX", "filterField": "B", "windowSizeMs": 259200000, "windowSlideMs": 86400000}},
 {"extractOperation": {"operationType": "EXTRACT_JSON"},
  "downstreamOperator": {"metaTypeInfo": "RollingSumAndPOJOToX", "filterField": "B", "windowSizeMs": 259200000, "windowSlideMs": 259200000}}]}"""


# running maxima


@query
def running_max_sum(spark, sf_dir):
    """Every row's running maximum, then per query and tumbling window the sum of equal maxima."""
    rows = A.running_peak(V.entity(spark, sf_dir).filter("type = 'A'"), ["pk"], "long1", ["ms", "id"])
    rows = Q.per_query(Q.stamp(rows, [0, 1]), 2).withColumn("window_start", floor_to("ms", DAY))
    return A.total(rows, ["qid", "window_start", "peak"], "peak")


@query
def window_record_high(spark, sf_dir):
    """Windows whose maximum is a record of their key, then per query and window the sum of equal records."""
    rows = Q.assign(V.entity(spark, sf_dir).filter("type = 'A'"), MIXED)
    high = A.window_records(rows, "ms", DAY, ["pk"], "long1", ["ms", "id"], ["qmask"])
    return A.total(Q.per_query(high, N), ["qid", "window_start", "long1"], "long1")


@query
def sliding_panes(spark, sf_dir):
    """Sums per user over 60 hours, every hour, by panes."""
    return A.sliding_sum(V.entity(spark, sf_dir), "ms", 60 * 3_600_000, 3_600_000, ["sel2"], "long2")


# statistics


@query
def range_selectivity(spark, sf_dir):
    return S.selectivity(V.entity(spark, sf_dir), FIFTHS)


def _matrix(spark, sf_dir) -> DataFrame:
    return S.match_matrix(_side(spark, sf_dir, "A"), _side(spark, sf_dir, "B"), ("a_pk", "b_fk"), ("a_ms", "b_ms"), SIZE, ("a_filter_attr", "b_filter_attr"), FIFTHS)


@query
def join_match_matrix(spark, sf_dir):
    """Joined pairs per pair of ranges."""
    return _matrix(spark, sf_dir)


@query
def join_match_matrix_all(spark, sf_dir):
    """The same by its earlier name."""
    return _matrix(spark, sf_dir)


@query
def split_stats(spark, sf_dir):
    """Per query and ten days: rows of A that it selects, and its joined pairs, by the later row's time."""
    step = 10 * DAY
    side = lambda k, key: Q.per_query(Q.assign(V.entity(spark, sf_dir).filter(F.col("type") == k), MIXED).select(F.col(key).alias("key"), "ms", "qmask"), N)
    a, b = side("A", "pk"), side("B", "fk")
    at = floor_to("ms", step).alias("window_start")
    chosen = a.groupBy("qid", at).agg(F.count("*").alias("selected"), F.lit(0).cast("bigint").alias("matches"))
    later = [X.partners_before(x, y, ["qid", "key"], "ms", SIZE, strictly).groupBy("qid", at).agg(F.lit(0).cast("bigint").alias("selected"), F.sum("partners").alias("matches")) for x, y, strictly in ((a, b, False), (b, a, True))]
    both = chosen.unionByName(later[0]).unionByName(later[1]).groupBy("qid", "window_start").agg(F.sum("selected").alias("selected"), F.sum("matches").alias("matches"))
    return both.filter("selected > 0 or matches > 0")


@query
def split_sample_stats(spark, sf_dir):
    """Per query and ten days, of the first 850 rows of A and 150 of B that it selects: how many there are, and their joined pairs."""
    side = lambda k, key, most: S.first_k(Q.per_query(Q.assign(V.entity(spark, sf_dir).filter(F.col("type") == k), MIXED).select("id", F.col(key).alias("key"), "ms", "qmask", floor_to("ms", 10 * DAY).alias("window_start")), N), ["qid", "window_start"], ["ms", "id"], most).drop("id")
    a, b = side("A", "pk", SAMPLE[0]), side("B", "fk", SAMPLE[1])
    zero = lambda c: F.lit(0).cast("bigint").alias(c)
    parts = [a.groupBy("qid", "window_start").agg(F.count("*").alias("sampled_a"), zero("sampled_b"), zero("matches")), b.groupBy("qid", "window_start").agg(zero("sampled_a"), F.count("*").alias("sampled_b"), zero("matches"))]
    pairs = X.band_matches(a.withColumn("one", F.lit(1).cast("bigint")), b, ["qid", "window_start", "key"], "ms", SIZE, ["one"], ["qid", "window_start"])
    parts.append(pairs.select("qid", "window_start", zero("sampled_a"), zero("sampled_b"), F.col("n_one").alias("matches")))
    return reduce(DataFrame.unionByName, parts).groupBy("qid", "window_start").agg(*[F.sum(c).alias(c) for c in ("sampled_a", "sampled_b", "matches")])


@query
def latency_samples(spark, sf_dir):
    rows = V.events(spark, sf_dir).select("event_id", F.unix_millis("ts").alias("ms"), (F.unix_millis("ts") - F.round("value").cast("bigint")).alias("emitted"))
    return S.latency(rows, "ms", "emitted", DAY, ["ms", "event_id"])


@query
def latency_percentiles(spark, sf_dir):
    rows = V.events(spark, sf_dir).select(F.unix_millis("ts").alias("ms"), (F.unix_millis("ts") - F.round("value").cast("bigint")).alias("emitted"))
    return S.latency_percentiles(rows, "ms", "emitted", DAY)


@query
def latency_sketch(spark, sf_dir):
    """Percentiles from a sketch of fixed size per day: whether each one's rank is as near as the sketch promises."""
    rows = V.events(spark, sf_dir).select(F.unix_millis("ts").alias("ms"), (F.unix_millis("ts") - F.round("value").cast("bigint")).alias("emitted"))
    late, day = F.col("ms") - F.col("emitted"), floor_to("ms", DAY).alias("interval_ms")
    got = S.sketched(S.latency_sketches(rows, "ms", "emitted", DAY))
    places = rows.select(day, late.alias("late")).join(got, "interval_ms").groupBy("interval_ms", "p50", "p95", "p99")
    near = places.agg(F.count("*").alias("n"), *[c for p in (50, 95, 99) for c in (F.sum((F.col("late") < F.col(f"p{p}")).cast("bigint")).alias(f"below{p}"), F.sum((F.col("late") <= F.col(f"p{p}")).cast("bigint")).alias(f"upto{p}"))])
    within = lambda p: ((F.col(f"below{p}") <= (p / 100 + S.RANK_ERROR) * F.col("n")) & (F.col(f"upto{p}") >= (p / 100 - S.RANK_ERROR) * F.col("n"))).alias(f"near{p}")
    return near.select("interval_ms", "n", *[within(p) for p in (50, 95, 99)])


class GeometricMean(U.Aggregate):
    """exp of the mean logarithm: a sum of logarithms and a number as the state."""

    def init(self):
        return [0.0, 0]

    def update(self, state, values):
        logs = [math.log(v) for v in values if v is not None and v > 0]
        return [state[0] + math.fsum(logs), state[1] + len(logs)]

    def merge(self, one, two):
        return [one[0] + two[0], one[1] + two[1]]

    def finish(self, state):
        return round(math.exp(state[0] / state[1]), 6) if state[1] else None


@query
def user_aggregate(spark, sf_dir):
    """A user's own aggregate, in two phases: the geometric mean of values per kind and key."""
    return U.aggregate(V.entity(spark, sf_dir), ["type", "sel2"], ["long2"], GeometricMean(), "mean")


@query
def throughput(spark, sf_dir):
    return S.throughput(V.telemetry(spark, sf_dir))


@query
def smoothed_throughput(spark, sf_dir):
    return S.smoothed(V.telemetry(spark, sf_dir))


@query
def shed_sample(spark, sf_dir):
    t = S.throughput(V.telemetry(spark, sf_dir))
    rates = t.groupBy("interval_ms").agg((F.max("backlog") / F.lit(100000.0) + F.pmod((F.col("interval_ms") / DAY).cast("bigint"), F.lit(5)) / F.lit(10.0)).alias("rate"), (F.max("backlog") - 40).alias("backlog"))
    return S.shed(V.entity(spark, sf_dir), rates, "ms", DAY, "id", 4000, 4).select("id", "type", "ms")


@query
def shed_rate_series(spark, sf_dir):
    t = S.throughput(V.telemetry(spark, sf_dir))
    job = t.groupBy("interval_ms").agg(F.sum("consumed").alias("throughput"))
    wish = t.groupBy("interval_ms").agg((F.sum("produced") * F.when(F.pmod((F.col("interval_ms") / DAY).cast("bigint"), F.lit(10)) < 5, 1).otherwise(2)).alias("desired"))
    desired = wish.groupBy(F.floor(F.col("interval_ms") / (5 * DAY)).alias("block")).agg(F.max("desired").alias("desired"), F.collect_list("interval_ms").alias("i")).select("desired", F.explode("i").alias("interval_ms"))
    rows = t.join(job, "interval_ms").select("subtask", "interval_ms", "throughput", (F.col("produced") - F.col("consumed") - 18 * F.col("produced") / F.lit(100.0)).alias("backlog"))
    return S.shedding_rates(rows, desired)


# generators, one row per event of the table


@query
def gen_nexmark(spark, sf_dir):
    ids = V.events(spark, sf_dir).select(F.col("event_id").alias("id"))
    return G.auction_events(ids).select("event_id", "type", "ms", "person_id", "name", "card", "auction_id", "item", "initial_bid", "reserve", "expires_ms", "seller", "category", "sell_below_reserve", "auction", "bidder", "price")


@query
def gen_entities(spark, sf_dir):
    ids = V.events(spark, sf_dir).select(F.col("event_id").alias("id"))
    plan = [G.Scenario(0, 10_000, 1, 1, 1), G.Scenario(3000, 20_000, 1, 3, 0, {"sel1": ("zipf", 10, {"exponent": 1.2, "first": 3}), "long1": ("binomial", 20, {"chance": 0.3})})]
    return G.entity_events(ids, plan).drop("ts")

"""Streams over files give what the batch operators give over the same rows; a last far row closes all windows."""

import pytest
from pyspark.sql import functions as F

from tideweave.functions.windows import DAY, with_windows
from tideweave.operators import aggregates as A
from tideweave.operators import joins as J
from tideweave.operators import queryset as Q
from tideweave.plans.queries import MIXED, SIZE, SLIDE, _pairs
from tideweave.operators.etl import parse_entities, serialised_sums
from tideweave.sources import lines as L
from tideweave.sources import views as V
from tideweave.streaming import etl as E
from tideweave.streaming import stateful as S
from tideweave.streaming import windows as W

SF = "/root/testdata/sf0.001"
FAR = 10 * 365 * DAY


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    S.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def stream(spark, df, path, parts=4, order="ms"):
    """df as a file stream of `parts` batches in time order."""
    rows = df.orderBy(order).collect()
    n = -(-len(rows) // parts)
    for i in range(0, len(rows), n):
        spark.createDataFrame(rows[i : i + n], df.schema).coalesce(1).write.mode("append").parquet(str(path))
    files = spark.read.parquet(str(path)).schema
    return spark.readStream.schema(files).option("maxFilesPerTrigger", 1).parquet(str(path))


def result(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def with_last(spark, df, far=FAR, **fields):
    """df and one row far in the future, all null else."""
    top = df.agg(F.max("ms")).first()[0] + far
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    last = spark.createDataFrame([tuple(fields.get(c) if c not in ("ms", "ts") else None for c in df.columns)], schema).withColumn("ms", F.lit(top))
    return df.unionByName(last.withColumn("ts", F.timestamp_millis("ms"))), top


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_window_join_and_mean(rocks, tmp_path):
    e = V.entity(rocks, SF)
    a, _ = with_last(rocks, e.filter("type = 'A'"), pk=-1, fk=-1)
    b, _ = with_last(rocks, e.filter("type = 'B'"), pk=-1, fk=-1)
    sa, sb = (J.named(stream(rocks, x, tmp_path / n).withWatermark("ts", "0 seconds"), n) for n, x in (("a", a), ("b", b)))
    got = W.aggregate(W.window_pairs(sa, sb, ("a_pk", "b_fk"), ("a_ts", "b_ts"), "3 days", "1 day"), ["a_pk"], {"mean": F.avg("b_long2"), "n": F.count("*")})
    want = _pairs(rocks, SF).groupBy("window_start", "a_pk").agg(F.avg("b_long2").alias("mean"), F.count("*").alias("n"))
    cols = ("window_start", "a_pk", "mean", "n")
    assert rows(result(got, "joined", tmp_path).filter("a_pk >= 0"), *cols) == rows(want, *cols)


def test_interval_join(rocks, tmp_path):
    e = V.entity(rocks, SF)
    a, b = (Q.assign(e.filter(f"type = '{k}'"), MIXED) for k in "AB")
    sa, sb = (J.named(stream(rocks, x, tmp_path / n).withWatermark("ts", "0 seconds"), n) for n, x in (("a", a), ("b", b)))
    got = result(W.interval_pairs(sa, sb, ("a_pk", "b_fk"), ("a_ts", "b_ts"), "3 days", ("a_qmask", "b_qmask")), "near", tmp_path)
    want = J.interval_join(J.named(a, "a"), J.named(b, "b"), [("a_pk", "b_fk")], ("a_ms", "b_ms"), SIZE, ("a_qmask", "b_qmask"))
    assert rows(got, "a_id", "b_id", "qmask") == rows(want, "a_id", "b_id", "qmask")


def test_median_and_top_mean(rocks, tmp_path):
    e = V.entity(rocks, SF).filter("type = 'A'")
    x, _ = with_last(rocks, e, sel2=-1)
    s = stream(rocks, x, tmp_path / "m").withWatermark("ts", "0 seconds")
    got = W.aggregate(s, ["sel2"], {"mid": W.median("long2", ["id"]), "top": W.top_mean("long2", 3)}, "ts", "3 days", "1 day")
    got = result(got, "mid", tmp_path).filter("sel2 >= 0")
    w = with_windows(e, "ms", SIZE, SLIDE)
    mid = A.upper_median(w, ["window_start", "sel2"], "long2", ["id"])
    assert rows(got, "window_start", "sel2", "mid.long2", "mid.id") == rows(mid, "window_start", "sel2", "long2", "id")
    top = A.top_mean(w, ["window_start", "sel2"], "long2", 3)
    assert [(r[0], r[1], round(r[2], 6)) for r in rows(got, "window_start", "sel2", "top")] == [(r[0], r[1], round(r[2], 6)) for r in rows(top, "window_start", "sel2", "mean")]


def test_etl(rocks, tmp_path):
    e = V.entity(rocks, SF)
    env = V.json_entity(e)
    last = rocks.createDataFrame([(-1, '{"type":"B","PK":-1,"longAttribute2":0}')], "id bigint, json string").withColumn("ms", F.lit(e.agg(F.max("ms")).first()[0] + FAR)).withColumn("ts", F.timestamp_millis("ms")).select("id", "ts", "ms", "json")
    s = parse_entities(stream(rocks, env.unionByName(last), tmp_path / "j").withWatermark("ts", "0 seconds"))
    dim = V.dimension(rocks, SF)
    cols = ("id", "pk", "name", "nation")
    got = result(J.lookup(s.filter("type = 'A'"), dim, ("pk", "user_id")).select(*cols), "enriched", tmp_path)
    assert rows(got, *cols) == rows(J.lookup(e.filter("type = 'A'"), dim, ("pk", "user_id")), *cols)
    cols = ("window_start", "key", "total", "payload")
    got = result(E.serialised_sums_stream(s.filter("type = 'B'"), "ts", "3 days", None, "pk", "long2"), "sums", tmp_path)
    assert rows(got.filter("key >= 0"), *cols) == rows(serialised_sums(e.filter("type = 'B'"), "ms", SIZE, SIZE, "pk", "long2"), *cols)


def test_lines(rocks, tmp_path):
    (tmp_path / "t").mkdir()
    for i in range(3):
        (tmp_path / "t" / f"{i}.txt").write_text("".join("\t".join(["A", str(10 * i + j), str(1000 * j), "0", "5", "-1", "3", "4", "10", "20", "42", "x", "", "", "", "2"]) + "\n" for j in range(4)))
    s = L.with_event_time(L.entity_lines(rocks.readStream.text(str(tmp_path / "t"))), "1 minute")
    assert rows(result(s.select("id", "pk", "filter_attr"), "lines", tmp_path), "id", "pk", "filter_attr") == sorted(((10 * i + j, 5, 42) for i in range(3) for j in range(4)), key=str)


def test_rising(rocks, tmp_path):
    e = V.entity(rocks, SF).filter("type = 'A'")
    s = stream(rocks, e, tmp_path / "r")
    got = result(S.rising_stream(s, "pk", "long2"), "rise", tmp_path)
    want = A.rising(e, ["pk"], "long2", ["ms", "id"])
    assert rows(got, "key", "id", "value") == rows(want, "pk", "id", "long2")
    got = result(S.rising_stream(s, "pk", "long2", every=True), "peak", tmp_path)
    assert rows(got, "id", "value") == rows(A.running_peak(e, ["pk"], "long2", ["ms", "id"]), "id", "peak")


def test_window_records(rocks, tmp_path):
    e = Q.assign(V.entity(rocks, SF).filter("type = 'A'"), MIXED)
    x, _ = with_last(rocks, e, pk=-1, long1=1, qmask=1, id=0)
    s = stream(rocks, x, tmp_path / "w").withWatermark("ts", "0 seconds")
    got = result(S.window_records_stream(s, "1 day", "pk", "long1"), "high", tmp_path).filter("key >= 0")
    want = A.window_records(e, "ms", DAY, ["pk"], "long1", ["ms", "id"], ["qmask"])
    assert rows(got, "key", "window_start", "value", "qmask") == rows(want, "pk", "window_start", "long1", "qmask")


def test_winning_bids(rocks, tmp_path):
    a = V.auction(rocks, SF).filter("id % 3 = 0").withColumn("ts", F.timestamp_millis("ms"))
    b = V.bid(rocks, SF).filter("auction % 3 = 0").withColumn("ts", F.timestamp_millis("ms"))
    want = J.winning_bids(a, b)
    la, _ = with_last(rocks, a, 4 * FAR, id=-1, expires_ms=2**50, reserve=0, seller=0, category=0)
    lb, _ = with_last(rocks, b, 4 * FAR, auction=-2, bidder=0, price=0)
    # one file each, and a delay that keeps all rows in time; then the watermark passes every expiry at once
    got = result(S.winning_bids_stream(stream(rocks, la, tmp_path / "a", 1), stream(rocks, lb, tmp_path / "b", 1), "20 years"), "won", tmp_path)
    cols = ("auction", "price", "category", "seller", "expires_ms")
    assert rows(got, *cols) == rows(want, *cols) and want.count() > 100


def test_late_rows_change_nothing(rocks, tmp_path):
    e = V.entity(rocks, SF).filter("type = 'A'")
    x, top = with_last(rocks, e, sel2=-1)
    path = tmp_path / "late"
    s = stream(rocks, x, path).withWatermark("ts", "0 seconds")
    count = lambda name: rows(result(W.aggregate(s, ["sel2"], {"n": F.count("*")}, "ts", "1 day"), name, tmp_path), "window_start", "sel2", "n")
    before = count("one")
    assert sum(r[2] for r in before) == e.count()
    old = e.orderBy("ms").limit(1).collect()
    last = x.orderBy(F.desc("ms")).limit(1).collect()
    rocks.createDataFrame(last, x.schema).coalesce(1).write.mode("append").parquet(str(path))
    rocks.createDataFrame(old, x.schema).coalesce(1).write.mode("append").parquet(str(path))
    assert count("two") == before

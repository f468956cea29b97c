"""Peaks and medians of three-way joins without their triples."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tideweave.functions.windows import DAY
from tideweave.operators import aggregates as A
from tideweave.operators import factorised as X
from tideweave.operators import joins as J
from tideweave.plans import queries as P

SIZE, SLIDE, N = P.SIZE, P.SLIDE, 1200


def odd_sides(spark, seed):
    """Nulls everywhere but in times, equal values, a hot key, numbers below 0."""
    r = random.Random(seed)
    key = lambda: r.choice([None, 1, 1, 1, 2, 3])
    some = lambda n: r.choice([None, *range(n)])
    rows = [[(i - 20, key(), key(), r.randrange(-3 * DAY, 9 * DAY), some(2), some(4)) for i in range(n)] for n in (40, 40, 40)]
    rows[0][:4] = [[i - 20, 1, None, -3 * DAY + i, i % 2, None] for i in range(4)]
    names = "id bigint, pk bigint, fk bigint, ms bigint, long1 bigint, long2 bigint"
    return [J.named(spark.createDataFrame(x, names), k) for x, k in zip(rows, "abc")]


def ordered(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_peaks(spark, seed):
    a, b, c = odd_sides(spark, seed)
    names = ["a_long1", "window_start", "a_id", "b_id", "c_id", "a_long2"]
    want = A.rising(J.three_way(a, b, c, *P.THREE, SIZE, SIZE), ["a_long1"], "a_long2", names[1:5]).select(*names)
    got = ordered(P._peak_triples(a, b, c).select(*names))
    assert got == ordered(want) and any(r[-1] is None for r in got) and any(r[-1] is not None for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_median(spark, monkeypatch, seed):
    monkeypatch.setattr(X, "ID_RANGES", 4)
    a, b, c = odd_sides(spark, seed)
    want = A.upper_median(J.three_way(a, b, c, *P.THREE, SIZE, SLIDE), ["window_start", "c_long1"], "c_long2", ["a_id", "b_id", "c_id", "pair_ms"])
    got = X.three_way_median(a, b, c, *P.THREE, SIZE, SLIDE, ["c_long1"], "c_long2", ("a_id", "b_id", "c_id"))
    assert got.columns == ["window_start", "c_long1", "a_id", "c_id", "c_long2"]
    assert ordered(got) == ordered(want.select(*got.columns)) and got.count() > 5


@pytest.mark.parametrize("size, slide", [(5 * DAY, 2 * DAY), (2 * DAY, 2 * DAY), (DAY, 2 * DAY)])
def test_median_in_other_windows(spark, monkeypatch, size, slide):
    monkeypatch.setattr(X, "ID_RANGES", 4)
    a, b, c = odd_sides(spark, 7)
    want = A.upper_median(J.three_way(a, b, c, *P.THREE, size, slide), ["window_start", "c_long1"], "c_long2", ["a_id", "b_id", "c_id", "pair_ms"])
    got = X.three_way_median(a, b, c, *P.THREE, size, slide, ["c_long1"], "c_long2", ("a_id", "b_id", "c_id"))
    assert ordered(got) == ordered(want.select(*got.columns)) and got.count() > 3


def copied_into_joins(plan):
    """How many tables of an optimized plan are copied by an explode and go into a join uncounted."""
    above, copied = [], 0
    for line in plan.splitlines():
        depth = re.search("[A-Za-z]", line).start()
        above = [x for x in above if x[0] < depth] + [(depth, line[depth:].split()[0])]
        if above[-1][1] in ("Relation", "LogicalRDD"):
            over = [n for _, n in reversed(above) if n in ("Generate", "Join", "Aggregate")]
            copied += over[:1] == ["Generate"] and next((n for n in over if n != "Generate"), None) == "Join"
    return copied


def test_median_looks_rows_up_uncopied(spark, monkeypatch):
    """Windows times pairs' windows a row of A were shuffled to find a few; now the few are copied and rows are not."""
    plans, once = [], X.once
    monkeypatch.setattr(X, "once", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or once(df))
    P.three_way_q2(spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and [copied_into_joins(p) for p in plans] == [0, 0, 0]


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Events of one user at one time, N of each kind: N cubed triples, for each window."""
    folder = str(tmp_path_factory.mktemp("hot"))
    at = dt.datetime(2024, 1, 5, 12)
    kinds = (("view", 10_000), ("click", 100_007), ("purchase", 1_000_000))
    rows = [(first + 50 * i, at, 7, kind, float(i), '{"k": 3}') for kind, first in kinds for i in range(N)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


def peaks_of_hot():
    return [(10_000 + 50 * i, 1_000_000, 100 * i) for i in range(N)]


def medians_of_hot():
    out = []
    for k in (1, 2, 3):  # of the first window's pairs only one has its end there
        place = k * N**3 // 2
        c, rest = divmod(place, N * N * k)
        out.append((10_000 + 50 * (rest // (N * k)), 1_000_000 + 50 * c, 100 * c))
    return out


def test_q1_on_a_hot_key(spark, hot):
    assert sorted(tuple(r)[2:] for r in P.three_way_q1(spark, hot).collect()) == peaks_of_hot()


def test_q2_on_a_hot_key(spark, hot):
    got = P.three_way_q2(spark, hot).orderBy("window_start").collect()
    assert [tuple(r)[2:] for r in got] == medians_of_hot() and {r.c_long1 for r in got} == {3}


def test_joint_on_a_hot_key(spark, hot):
    got = P.three_way_joint(spark, hot).orderBy("which", "window_start", "a_id").select("which", "a_id", "c_id", F.col("value")).collect()
    assert list(map(tuple, got)) == [("median", *r) for r in medians_of_hot()] + [("peak", *r) for r in peaks_of_hot()]

"""What queries shuffle, sort and evaluate grows with their input and no faster."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tideweave.functions.windows import DAY, with_windows
from tideweave.operators import aggregates as A
from tideweave.operators import factorised as X
from tideweave.operators import joins as J
from tideweave.plans import queries as P

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name, branches", [("auction_wire", 2), ("entity_wire", 1), ("narrow_wire", 1)])
def test_lines_are_split_once(spark, name, branches):
    """Once per branch that reads them, not once per mention of a field in a pushed condition."""
    plan = optimized(P.QUERIES[name](spark, SF))
    assert plan.count("split(") == branches and plan.count("regexp_replace(") == branches


@pytest.mark.parametrize("seed", range(2))
def test_sliding_top_mean(spark, seed):
    """As the means of the rows in each window, with nulls, equal values and more rows in a pane than count."""
    r = random.Random(seed)
    rows = [(r.choice([None, 1, 1, 2]), r.choice([None, *range(12)]), r.choice([None, r.randrange(-9 * DAY, 30 * DAY), r.randrange(DAY)])) for _ in range(150)]
    df = spark.createDataFrame([*rows, (7, None, 5)], "k bigint, v bigint, ms bigint")
    want = A.top_mean(with_windows(df, "ms", 6 * DAY, DAY), ["window_start", "k"], "v", 4)
    got = A.sliding_top_mean(df, "ms", 6 * DAY, DAY, ["k"], "v", 4)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("name", ["nexmark_q6", "nexmark_q4_q6_joint"])
def test_top_means_copy_no_rows_before_a_sort(spark, name):
    """The copies in windows are all above the last sort by seller, and the best bid is no sorted aggregate."""
    plan = P.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    six = plan[plan.index("near_") if "near_" in plan else 0 :]
    assert "near_" in plan and "Generate" not in six[six.index("Sort [") :].split("Union")[0] and "SortAggregate" not in plan


def test_winning_bids_have_tasks_for_their_rows(spark, monkeypatch):
    """More rows are more tasks, whatever the number of shuffle partitions (8 here), not more rows a task."""
    want = sorted(map(tuple, P.winning_bids(spark, SF).collect()))
    monkeypatch.setattr(J, "ROWS", 200)
    won = P.winning_bids(spark, SF)
    tasks = won.groupBy(F.spark_partition_id()).count().collect()
    assert sorted(map(tuple, won.collect())) == want != [] and len(tasks) > 24 and max(r["count"] for r in tasks) < 200
    for rows, n in ((30, 200), (3, 313)):  # 7,500 rows
        monkeypatch.setattr(J, "ROWS", rows)
        assert len(re.findall(rf"RepartitionByExpression .*, {n}\b", optimized(P.winning_bids(spark, SF)))) == 2


def test_panes_are_narrow_and_mostly_one_copy(spark):
    """Panes have one end, not two, and are copied into the buckets that they reach, not into three each."""
    plan = optimized(P.window_join_agg(spark, SF))
    assert "first_a" not in plan and "first_b" not in plan and "explode(sequence(" in plan
    rows = spark.range(2000).select((F.col("id") % 9).alias("k"), (F.col("id") * DAY).alias("t"))
    other = rows.select(F.col("k").alias("k_"), F.col("t").alias("t_"))
    within = F.abs(F.col("t") - F.col("t_")) <= 60 * DAY
    got = J.near_in_time(rows, other, [("k", "k_")], ("t", "t_"), 60 * DAY, within, step=X.BUCKET * 60 * DAY)
    want = J.near_in_time(rows, other, [("k", "k_")], ("t", "t_"), 60 * DAY, within)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

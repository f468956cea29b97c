"""Declarative queries: JSON or dataclasses to DataFrames, grouped by what they can share."""

from __future__ import annotations

import json
import random
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import emitted_at, with_windows
from ..operators import aggregates as A
from ..operators.etl import parse_entities, serialised_sums
from ..operators.joins import in_each_window, lookup, named, three_way, window_join
from ..operators.queryset import assign, of_query, stamp
from ..sources.sinks import once

EVERYTHING = (-(2**63), 2**63 - 1)
FIELDS = {"f0": "a", "f1": "b"}


@dataclass(frozen=True)
class Join:
    kind: str = "TWO_WAY_EQUI_JOIN"
    size: int = 3000
    slide: int = 3000


@dataclass(frozen=True)
class Downstream:
    """kind: RollingReduce, WindowAggregation, DataEnrichmentFunction or RollingSumAndPOJOToX."""

    kind: str
    aggregation: str | None = None
    group_by: str | None = None
    size: int | None = None
    slide: int | None = None
    only: str | None = None


@dataclass(frozen=True)
class Analytics:
    join: Join
    downstream: Downstream | None = None
    ranges: tuple[tuple[int, int], ...] | None = None  # of A, B and C

    @property
    def share_key(self):
        return ("analytics", self.join.kind, self.join.size, self.join.slide)


@dataclass(frozen=True)
class Etl:
    extract: str = "EXTRACT_JSON"
    downstream: Downstream | None = None
    ranges: tuple[tuple[int, int], ...] | None = None  # of A, B and C; extraction has one stream, which B's range selects from

    @property
    def share_key(self):
        return ("etl", self.extract)


def _downstream(d: dict | None) -> Downstream | None:
    return d and Downstream(d["metaTypeInfo"], d.get("aggregationType"), d.get("groupByField"), d.get("windowSizeMs"), d.get("windowSlideMs"), d.get("filterField"))


def _ranges(f: dict | None):
    return f and tuple((f.get(f"startForEntity{e}", EVERYTHING[0]), f.get(f"endForEntity{e}", EVERYTHING[1])) for e in "ABC")


def from_json(text: str) -> list[Analytics | Etl]:
    """Queries of a JSON configuration with the lists dataAnalyticsQueries and streamingETLQueries."""
    got = json.loads(text)
    out: list[Analytics | Etl] = []
    for q in got.get("dataAnalyticsQueries") or []:
        j = q["joinOperators"]
        out.append(Analytics(Join(j["joinType"], j["windowSizeMs"], j["windowSlideMs"]), _downstream(q.get("downstreamOperator")), _ranges(q.get("filter"))))
    for q in got.get("streamingETLQueries") or []:
        out.append(Etl(q["extractOperation"]["operationType"], _downstream(q.get("downstreamOperator")), _ranges(q.get("filter"))))
    return out


def groups(specs: list[Analytics | Etl]) -> dict[tuple, list[tuple[int, Analytics | Etl]]]:
    """(number, query) by what they can share: equal join kinds and windows, or equal extraction."""
    out: dict[tuple, list] = {}
    for i, s in enumerate(specs):
        out.setdefault(s.share_key, []).append((i, s))
    return out


def shared_join(entities: DataFrame, group: list[tuple[int, Analytics]]) -> DataFrame:
    """One join for a group of queries: pairs (a_, b_ and, of three, c_ columns) per window with their query set."""
    join = group[0][1].join
    sides = []
    for i, e in enumerate("ABC" if join.kind.startswith("THREE") else "AB"):
        rows = entities.filter(F.col("type") == e)
        if any(q.ranges for _, q in group):
            rows = assign(rows, [(n, *(q.ranges[i] if q.ranges else EVERYTHING)) for n, q in group])
        else:
            rows = stamp(rows, [n for n, _ in group])
        sides.append(named(rows, e.lower()))
    masks = ("a_qmask", "b_qmask", "c_qmask")
    if len(sides) == 3:
        return three_way(*sides, ("a_pk", "b_fk"), ("b_pk", "c_fk"), ("a_ms", "b_ms", "c_ms"), join.size, join.slide, masks)
    return in_each_window(window_join(*sides, [("a_pk", "b_fk")], ("a_ms", "b_ms"), join.size, join.slide, masks[:2]), join.slide)


def answer(pairs: DataFrame, number: int, q: Analytics) -> DataFrame:
    """(qid, window_start, key, value) of one query over its group's pairs."""
    rows = of_query(pairs, number)
    second = "c" if "c_id" in pairs.columns else "b"
    d = q.downstream
    if d is None:
        return rows.select(F.lit(number).alias("qid"), "window_start", F.col("a_pk").alias("key"), F.col(f"{second}_long2").alias("value"))
    key = f"{second if FIELDS[d.group_by or 'f0'] == 'b' else 'a'}_long1"
    if d.kind == "RollingReduce":
        out = A.rising(rows, [key], "a_long2", ["window_start", "a_id", f"{second}_id"])
        return out.select(F.lit(number).alias("qid"), "window_start", F.col(key).alias("key"), F.col("a_long2").alias("value"))
    size, slide = d.size or q.join.size, d.slide or q.join.slide
    rows = with_windows(rows.withColumn("out_ms", emitted_at("window_start", q.join.size)), "out_ms", size, slide, "window_start")
    keys, value = ["window_start", key], f"{second}_long2"
    if d.aggregation == "MEDIAN":
        out = A.upper_median(rows, keys, value, ["a_id", f"{second}_id", "out_ms"]).withColumnRenamed(value, "value")
    elif d.aggregation == "MEAN":
        out = A.mean(rows, keys, value, "value")
    elif d.aggregation == "COUNT":
        out = A.count(rows, keys, "value")
    else:
        raise ValueError(f"unknown aggregation {d.aggregation}")
    return out.select(F.lit(number).alias("qid"), "window_start", F.col(key).alias("key"), F.col("value"))


def build(specs: list[Analytics | Etl], entities: DataFrame, envelopes: DataFrame | None = None, dimension: DataFrame | None = None) -> list[DataFrame]:
    """A DataFrame per query, in order; queries of a group read the same join or the same parse."""
    out: dict[int, DataFrame] = {}
    for key, group in groups(specs).items():
        if key[0] == "analytics":
            pairs = shared_join(entities, group)
            needed = ["window_start", "qmask", *[c for c in pairs.columns if c[1:] in ("_id", "_pk", "_long1", "_long2")]]
            pairs = once(pairs.select(needed)) if len(group) > 1 else pairs
            out |= {i: answer(pairs, i, q) for i, q in group}
            continue
        parsed = parse_entities(envelopes)
        ranged = any(q.ranges for _, q in group)
        if ranged:
            parsed = assign(parsed, [(i, *(q.ranges[1] if q.ranges else EVERYTHING)) for i, q in group])
        for i, q in group:
            d = q.downstream
            rows = of_query(parsed, i).drop("qmask") if ranged else parsed
            rows = rows if d is None or d.only is None else rows.filter(F.col("type") == d.only)
            if d is not None and d.kind == "DataEnrichmentFunction":
                rows = lookup(rows, dimension, ("pk", "user_id"))
            elif d is not None:
                rows = serialised_sums(rows, "ms", d.size, d.slide or d.size, "pk", "long1")
            out[i] = rows
    return [out[i] for i in range(len(specs))]


def together(answers: list[DataFrame]) -> DataFrame:
    """Answers of several queries as one table with qid."""
    return reduce(DataFrame.unionByName, [a.withColumn("value", F.col("value").cast("double")) for a in answers])


def family(n: int, selectivity: int | None = 10, domain: int = 100, size: int = 60_000, slide: int = 1_000, kind: str = "TWO_WAY_EQUI_JOIN", seed: int = 1) -> list[Analytics]:
    """n queries over one join: each selects `selectivity` percent of the domain, or a random share if that is None."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        share = r.randint(1, 100) if selectivity is None else selectivity
        inside = (0, domain * share // 100 - 1)
        out.append(Analytics(Join(kind, size, slide), None, (inside, inside, EVERYTHING)))
    return out

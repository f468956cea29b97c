"""Queries by the names under which benchmark runners know them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .queries import QUERIES

# Benchmark name and the query that answers it here.
NAMES = {
    "LOAD_TEST": "pass_through",
    "SCALABILITY": "pass_through",
    "MAP_LONG_MICRO_BENCHMARK": "map_long",
    "MAP_STRING_MICRO_BENCHMARK": "map_string",
    "FILTER_MICRO_BENCHMARK": "filter_bids",
    "MAP_EXTRACT_JSON": "json_extract",
    "WINDOW_JOIN_WITH_AGGREGATION": "window_join_agg",
    "AVERAGE_PRICE_FOR_CATEGORY": "nexmark_q4",
    "AVERAGE_SELLING_PRICE_BY_SELLER": "nexmark_q6",
    "AVERAGE_PRICE_JOINT_EXECUTION": "nexmark_q4_q6_joint",
    "TWO_WAY_WINDOW_JOIN_Q1": "window_join_q1",
    "TWO_WAY_WINDOW_JOIN_Q2": "window_join_q2",
    "TWO_WAY_WINDOW_JOIN_JOINT_EXECUTION": "window_join_joint",
    "THREE_WAY_WINDOW_JOIN_Q1": "three_way_q1",
    "THREE_WAY_WINDOW_JOIN_Q2": "three_way_q2",
    "THREE_WAY_WINDOW_JOIN_JOINT_EXECUTION": "three_way_joint",
    "STREAMING_ETL_Q1": "etl_enrich",
    "STREAMING_ETL_Q2": "etl_window_sum",
    "STREAMING_ETL_JOINT_EXECUTION": "etl_joint",
    "TEST_QUERY": "running_max_sum",
    "WINDOW_TEST_QUERY": "window_record_high",
    "CONFIGURABLE_DATA_ANALYTICS_QUERY": "spec_queries",
    "CONFIGURABLE_STREAMING_ETL_QUERY": "etl_shared",
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named query over the tables of a folder."""
    try:
        return QUERIES[NAMES.get(name, name)](spark, sf_dir)
    except KeyError:
        raise ValueError(f"unknown query {name}; known: {', '.join(sorted({*NAMES, *QUERIES}))}") from None

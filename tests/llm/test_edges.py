"""Every operator and pipeline stage on tables with clashing columns, nulls in every column, repeated rows and none."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tideweave.llm.queries import vocabulary
from tideweave.llm.hmm import score_documents
from tideweave.llm.jaccard import similar_groups
from tideweave.llm.langid import identify
from tideweave.llm.licences import scan_licences
from tideweave.llm.media import text_media
from tideweave.llm.merkle import merkle_proofs
from tideweave.llm.mixing import mix_sources
from tideweave.llm.pii import find_personal_data
from tideweave.llm.quality import quality_rules
from tideweave.llm.spm import encode_documents
from tideweave.llm.urls import judge_urls

SF = "/root/testdata/sf0.001"
#: Names of results and of columns inside.
NAMES = ["key", "size", "n", "of", "id", "doc", "none", "print", "first", "node", "root", "component_id", "t_id", "room", "epochs", "ids", "spans", "parts", "marks", "word", "row", "lang_pred", "score", "host", "ruled", "part", "row", "path", "slot", "idx", "g", "m", "p", "name", "leaf", "changed", "a.b", "select"]
OPERATORS = {
    "op1": scan_licences, "op2": mix_sources, "op3": find_personal_data, "op4": quality_rules, "op5": lambda d: encode_documents(d, vocabulary()),
    "op6": similar_groups, "op7": score_documents, "op8": identify, "op9": text_media, "op10": judge_urls, "op12": merkle_proofs,
}


def rows_of(spark, name):
    """A few rows of the operator's table, one twice, one null in every column; all plain and with clashing columns."""
    table, id_ = ("pages", "page_id") if name == "op10" else ("documents", "doc_id")
    rows = spark.read.parquet(f"{SF}/{table}.parquet").orderBy(id_).limit(40)
    rows = rows.unionByName(rows.limit(1)).unionByName(rows.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    more = {c: F.lit(f"own {c}") if i % 3 else F.lit(i % 7) for i, c in enumerate(NAMES) if c not in rows.columns}
    return rows, rows.select("*", *[v.alias(c) for c, v in more.items()])


def sorted_rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, name):
    plain, clashing = rows_of(spark, name)
    run = OPERATORS[name]
    want = sorted_rows(run(plain))
    assert len(want) == 42 and sorted_rows(run(clashing)) == want
    none = run(clashing.limit(0))
    assert none.columns == run(plain).columns and none.count() == 0


@pytest.mark.parametrize("stage", P.STAGES, ids=[n for n, _ in P.STAGES])
def test_pipeline_stages(spark, stage):
    name, run = stage
    plain, clashing = rows_of(spark, name)
    want, got = run(spark, plain, SF), run(spark, clashing, SF)
    assert sorted_rows(got.select(*want.columns)) == sorted_rows(want) != []
    if name != "encoding":
        own = [F.col(f"`{c}`") for c in NAMES if c not in plain.columns]
        assert got.columns == clashing.columns and got.select(*own).distinct().collect() == clashing.select(*own).distinct().collect()
    assert run(spark, clashing.limit(0), SF).count() == 0

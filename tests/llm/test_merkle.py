import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tideweave.llm import merkle

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def framed(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(r, text):
    return sha("".join(framed(x) for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def climb(hashes):
    """The root, and for each node its siblings as (left, right) from its level up."""
    paths, below = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        runs = [range(i, min(i + 3, len(hashes))) for i in range(0, len(hashes), 3)]
        for run in runs:
            for k in run:
                for i in below[k]:
                    paths[i].append(("".join(hashes[j] for j in run if j < k), "".join(hashes[j] for j in run if j > k)))
        hashes, below = [sha("".join(hashes[k] for k in run)) for run in runs], [[i for k in run for i in below[k]] for run in runs]
    return hashes[0], paths


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        by[s].sort(key=lambda x: x[:3])
        trees.append(climb([x[2] for x in by[s]]))
    root, tops = climb([t[0] for t in trees])
    out = []
    for s, (subroot, paths), top in zip(names, trees, tops, strict=True):
        for (_, _, leaf, r), path in zip(by[s], paths, strict=True):
            path = path + top
            text = r["text"]
            if zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            h = leaf_of(r, text)
            for left, right in path:
                h = sha(left + h + right)
            out.append((r["doc_id"], leaf, subroot, root, sha("".join(a + b for a, b in path)), h, h == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_brute_force(spark):
    docs = [(i, f"line {i}\nof {i % 5}", "en" if i % 3 else None, "big", i) for i in range(0, 400, 2)]
    docs += [(1000 + i, None if i % 4 == 0 else "é\n" * i, "fr", f"s{i % 11}", None) for i in range(40)]
    docs += [(7, "x\ny", "de", None, 3), (7, "x\ny", "de", None, 3), (None, "n\nn", None, None, None), (None, "m", None, None, None), (5, "\n", "", "", 1), (8, "one", "en", "Ünique", 3), (9, "w\n" * 200_000, "en", "a", 1)]
    df = spark.createDataFrame(docs, SCHEMA)
    want = brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), d, strict=True)) for d in docs])
    assert rows_of(merkle.merkle_proofs(df)) == want
    assert {r[6] for r in want} == {True, False}


@pytest.mark.parametrize("n, sources", [(1, 1), (3, 1), (10, 1), (5, 4), (28, 28)])
def test_heights(spark, n, sources):
    docs = [(i, f"{i}\n", "en", f"s{i % sources}", i) for i in range(n)]
    want = brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), d, strict=True)) for d in docs])
    assert rows_of(merkle.merkle_proofs(spark.createDataFrame(docs, SCHEMA))) == want


def test_any_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = rows_of(merkle.merkle_proofs(docs))
    try:
        for n in ("1", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert rows_of(merkle.merkle_proofs(docs.repartition(5))) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tampering_is_found(spark):
    """Any other leaf, or a sibling changed, gives another root."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "source", merkle.digest(merkle.framed(F.col("text"))).alias("leaf"))
    got = merkle.with_proofs(rows, "source", ["doc_id"], "leaf")
    good = merkle.folded(F.col("leaf"), F.col("path")) == merkle.hexed(F.col("root"))
    swapped = F.transform("path", lambda p: F.struct(p["slot"].alias("slot"), F.reverse(p["others"].cast("string")).cast("binary").alias("others")))
    other = merkle.folded(merkle.digest(F.lit("x")), F.col("path")) == merkle.hexed(F.col("root"))
    n = docs.count()
    counts = got.agg(F.count(F.when(good, 1)), F.count(F.when(other, 1)), F.count(F.when(merkle.folded(F.col("leaf"), swapped) == merkle.hexed(F.col("root")), 1))).first()
    assert tuple(counts) == (n, 0, 0)


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = merkle.merkle_proofs(spark.read.parquet(f"{SF}/documents.parquet"))
    want = con.execute(f"select {', '.join(got.columns)} from ({merkle.duckdb_sql()})").fetchall()
    assert rows_of(got) == sorted(want, key=str) and len(want) == 1000

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tideweave.llm import trie

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32], role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(int(c / 100) * 100, [])[:h] + turns[c][h:])
    return nodes_of(whole)


def nodes_of(whole):
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in kids[node])
    ends = defaultdict(list)
    for c, seq in whole.items():
        ends[seq].append(c)
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], sha(",".join(map(str, sorted(ends[n]))))) for n, m in members.items()), key=str)


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def some_rows(seed, n=150):
    r = random.Random(seed)
    texts = ["", None, "a", "hello", "é" * 7, "long " * 200]
    roles = ["user", "assistant", "system", None]
    rows = []
    for c in range(n):
        common = r.random() < 0.4
        for t in range(r.randrange(1, 9) if not common else 7):
            rows.append((c * 7 % 997, None if t == 0 and c % 11 == 0 else t // 2 if c % 13 == 0 else t, "user" if common else r.choice(roles[: 1 + t]), "same" if common else r.choice(texts[: 2 + t % 5])))
    rows += [(1000 + i, t, "user", f"deep {t}") for i in range(3) for t in range(40 + i)]
    rows += [(200, 0, "user", "x"), (200, 0, "user", "x"), (-250, 1, "user", "neg"), (-301, 1, "user", "neg"), (None, 0, "user", "lost"), (901, 0, "user", "short")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = some_rows(seed)
    assert got(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(7))) == brute(rows)


@pytest.mark.parametrize("block, fan, parts", [(1, 2, 37), (7, 3, 10), (30, 64, 1), (10**6, 2, 8)])
def test_blocks_and_rounds(spark, block, fan, parts):
    """Any block length, partitions and fan, with a sequence that many conversations have: nodes are the same."""
    r = random.Random(block)
    whole = {c: tuple((x, f"t{x}") for x in (1, 2, 3)) if c % 3 == 0 else tuple((x, f"t{x}") for x in (r.randrange(3) for _ in range(r.randrange(6)))) for c in range(300)}
    rows = [(c, [x for x, _ in s], [len(t) for _, t in s]) for c, s in whole.items()]
    df = spark.createDataFrame(rows, "conv_id bigint, ids array<bigint>, chars array<int>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert got(trie.trie(df, block, fan, 20)) == nodes_of(whole)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tree_is_balanced():
    n = 1023
    tree = trie.Tree()
    for i in trie.medians(n):
        tree.insert([i], [1], 1, i, trie.NONE)

    def height(x):
        return 1 + max(height(tree.lower[x]), height(tree.higher[x])) if x else 0

    assert height(tree.next[0]) == 10 and sorted(trie.medians(n)) == list(range(n))
    deep = trie.Tree()
    deep.insert(range(50_000), [1] * 50_000, 1, 1, trie.NONE)
    assert len(deep.order()) == 50_001


def test_edges(spark):
    rows = spark.createDataFrame(some_rows(3, 30), SCHEMA)
    want = got(trie.conversation_trie(rows))
    clash = rows.select("*", *[F.lit("own").alias(c) for c in ("ids", "chars", "key", "word", "h", "base", "part", "a.b")])
    assert got(trie.conversation_trie(clash)) == want
    assert got(trie.conversation_trie(clash.limit(0))) == []
    one = spark.createDataFrame([(7, 0, None, None)], SCHEMA)
    assert got(trie.conversation_trie(one)) == brute([(7, 0, None, None)])


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    df = trie.conversation_trie(spark.read.parquet(f"{SF}/conversations.parquet"))
    want = con.execute(f"select {', '.join(COLUMNS)} from ({trie.duckdb_sql()})").fetchall()
    assert got(df) == sorted(want, key=str) and len(want) > 300

import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideweave.llm import chat

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
PIECES = ["<", "[", "\\", "/", "s>", "INST]", "ROLE]", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<\\s>", "[\\\\/INST]", "a", "\n", "é", "$1"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        replies = [x for _, _, role, x in turns if role == "assistant"]
        out[conv] = (len(turns), sha("".join(f"{role}\n{x}\n" for _, _, role, x in turns)), sum(map(len, replies)), sha("".join(replies)), len(replies))
    return out


def of(r):
    return (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_examples)


def tricky():
    texts = ["", None, "</s>[INST] ok [/INST]", "<\\/s>", "[\\\\INST]", "[[INST]]<<s>s>", "\\" * 50 + "[/ROLE]", "é\n\U0001f600", "x" * 300_000 + "</s>", "[" * 100_000, "[" + "\\" * 100_000]
    roles = ["user", "assistant", "system", None, "", "[/ROLE]x", "User", "assistant", "</s>"]
    rows = [(c, t if (c + t) % 7 else None, roles[(c * 5 + t) % 9], texts[(c * 3 + t) % 11]) for c in range(25) for t in range(1 + c % 9)]
    return rows + rows[-2:] + [(None, 1, "user", "n"), (None, 2, "assistant", "m"), (-1, 5, "assistant", "own"), (90, 0, "user", "only"), (91, 3, "assistant", "b"), (91, 3, "assistant", "a")]


def test_brute_force(spark):
    rows = tricky()
    got = {r.conv_id: of(r) for r in chat.chat_examples(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == brute(rows + chat.PROBE)
    stored = spark.createDataFrame(chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect(), chat.FORMATTED).repartition(7)
    assert {r.conv_id: of(r) for r in chat.read_back(stored).collect()} == brute(rows)


def test_one_shuffle(spark):
    plan = chat.chat_examples(spark.read.parquet(f"{SF}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_rendered_examples(spark):
    """Each whole example parses into its context and its reply, and the mask covers the reply alone."""
    rows = [r for r in tricky() if r[0] != 24]
    stored = chat.formatted(spark.createDataFrame(rows, SCHEMA)).cache()
    n = 0
    for r in chat.rendered(stored).collect():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        at = [i for i, x in enumerate(turns) if x[2] == "assistant"][r.example]
        assert chat.turns_in(r.text) == [x[2:] for x in turns[: at + 1]]
        assert chat.unescaped(r.text[r.loss_start : r.loss_end]) == turns[at][3] and r.text[r.loss_end :] == chat.END
        n += 1
    assert n == sum(r[2] == "assistant" for r in rows)
    lengths = {(r.conv_id, r.example): r.chars for r in chat.examples(stored).collect()}
    assert lengths == {(r.conv_id, r.example): len(r.text) for r in chat.rendered(stored).collect()}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=30))
def test_escaping(spark, texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    for r in df.select("i", chat.escaped(F.col("x")).alias("e")).collect():
        assert not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"))
        assert chat.unescaped(r.e) == texts[r.i]


def test_edges(spark):
    rows = spark.createDataFrame(tricky()[:30], SCHEMA)
    want = sorted(map(tuple, chat.chat_examples(rows).collect()), key=str)
    clash = rows.select("*", *[F.lit("own").alias(c) for c in ("segment", "place", "example", "reply", "loss_start", "of", "a.b")])
    assert sorted(map(tuple, chat.chat_examples(clash).collect()), key=str) == want
    assert [r.conv_id for r in chat.chat_examples(clash.limit(0)).collect()] == [-1]


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    got = chat.chat_examples(spark.read.parquet(f"{SF}/conversations.parquet"))
    want = con.execute(f"select {', '.join(got.columns)} from ({chat.duckdb_sql()})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 101

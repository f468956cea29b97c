from pyspark.sql import functions as F

from tideweave.llm import chat

from .test_chat import SCHEMA, tricky


def test_query_expands_examples(spark):
    """Every reply is an example with all turns before it, and the only one of them under its mask; the query reads these."""
    rows = [r for r in tricky() if r[0] != 24]
    got: dict = {}
    for r in chat.expanded(chat.formatted(spark.createDataFrame(rows, SCHEMA))).orderBy("conv_id", "example", "place").collect():
        got.setdefault((r.conv_id, r.example), []).append(r)
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        ends = [i + 1 for i, x in enumerate(turns) if x[2] == "assistant"]
        rest = [len(turns)] if not ends or ends[-1] < len(turns) else []
        assert sorted(e for c, e in got if c == conv) == list(range(len(ends + rest)))
        for e, n in enumerate(ends + rest):
            parts = got[conv, e]
            text = "".join(p.segment for p in parts)
            assert chat.turns_in(text) == [x[2:] for x in turns[:n]]
            masked = [chat.unescaped(text[p.loss_start : p.loss_end]) for p in parts if p.loss_start is not None]
            assert masked == ([turns[n - 1][3]] if e < len(ends) else [])
    plan = chat.chat_examples(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "explode(sequence(own_" in plan


def test_a_long_conversation(spark):
    """400 turns, half of them replies: 40,200 rows of 200 examples, and each reply under one mask."""
    rows = spark.range(400).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.col("id").cast("string").alias("text"))
    assert chat.expanded(chat.formatted(rows)).count() == sum(range(2, 401, 2)) == 40_200
    own = {r.conv_id: r for r in chat.chat_examples(rows).collect()}[5]
    assert (own.n_turns, own.n_examples, own.loss_chars) == (400, 200, 5 + 45 * 2 + 150 * 3)

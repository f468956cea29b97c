"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own, whose context is all turns
before it and whose loss mask covers that reply alone.

`formatted` gives a conversation's text once, a row per turn, and `expanded` makes the examples of it: all turns up to a
reply, of which that reply is the target. The query reads its results back from these. An example is a run of rows, never
one value, so memory is bounded; together they have the square of a conversation's turns, which is what the method makes.
They are expanded where the conversation lies, after the only shuffle. `rendered` writes each as one text. Turns after the
last reply are context of one more example without a reply, so that nothing is lost.

A turn is a mark, its text, and END. Control strings inside texts and roles get a backslash after their first character,
and those that have some already get one more, so a text never holds a control string and comes back as it was.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_arrow

# The marks of a user's and an assistant's turn, around any other role, and the end of a turn.
USER, REPLY, ROLE, NAMED, END = "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "</s>"
#: A control string, with the backslashes that make it plain text.
CONTROL = r"([<\[])(\\*+)(/?(?:s>|INST\]|ROLE\]))"
PLAINER = r"([<\[])\\(\\*+)(/?(?:s>|INST\]|ROLE\]))"
_PLAIN = re.compile(PLAINER.replace("*+", "*"))
_TURN = re.compile(r"(?:\[INST\]|(\[/INST\])|\[ROLE\](.*?)\[/ROLE\])(.*?)</s>", re.S)
#: The conversation that comes with every table: its texts look like control strings.
PROBE = [(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
FORMATTED = "conv_id bigint, place bigint, example bigint, segment string, context_chars bigint, loss_start bigint, loss_end bigint"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1$2\\$3"))


def unescaped(text: str) -> str:
    return _PLAIN.sub(r"\1\2\3", text)


def turns_in(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    return [("assistant" if m[1] else "user" if m[2] is None else unescaped(m[2]), unescaped(m[3])) for m in _TURN.finditer(text)]


def formatted(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) to FORMATTED, a row per turn: its place, the example that it belongs to
    (as the reply or as context that no earlier example has), its part of the text, and the text's length before it;
    replies also have their loss mask, in code points of the whole text.

    One shuffle by conversation, of texts as they are, before they are formatted; a conversation's rows are sorted and
    summed with spilling, never held.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text")).repartition("conv_id")
    reply = F.col("role") == "assistant"
    mark = F.when(reply, F.lit(REPLY)).when(F.col("role") == "user", F.lit(USER)).otherwise(F.concat(F.lit(ROLE), escaped(F.col("role")), F.lit(NAMED)))
    rows = rows.withColumn("segment", F.concat(mark, escaped(F.col("text")), F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    out = rows.select(
        "conv_id", (F.row_number().over(order) - 1).cast("bigint").alias("place"), F.coalesce(F.count(F.when(reply, 1)).over(before), zero).alias("example"), "segment",
        F.coalesce(F.sum(F.length("segment")).over(before), zero).cast("bigint").alias("context_chars"), reply.alias("reply"),
    )
    start, end = F.col("context_chars") + len(REPLY), F.col("context_chars") + F.length("segment") - len(END)
    return out.select("conv_id", "place", "example", "segment", "context_chars", F.when(F.col("reply"), start).alias("loss_start"), F.when(F.col("reply"), end).alias("loss_end"))


EXPANDED = "conv_id bigint, example bigint, place bigint, segment string, context_chars bigint, loss_start bigint, loss_end bigint"


def expanded(rows: DataFrame) -> DataFrame:
    """FORMATTED to EXPANDED, a row per example and turn: a turn is context of all later examples of its conversation, and
    a reply is the target, with a loss mask, of its own alone."""
    last = F.max("example").over(Window.partitionBy("conv_id"))
    own = rows.withColumn("own_", F.col("example")).withColumn("last_", last)
    each = own.withColumn("example", F.explode(F.sequence("own_", "last_")))
    target = lambda c: F.when(F.col("example") == F.col("own_"), F.col(c)).alias(c)
    return each.select("conv_id", "example", "place", "segment", "context_chars", target("loss_start"), target("loss_end"))


def examples(rows: DataFrame) -> DataFrame:
    """FORMATTED to (conv_id, example, context_turns, context_chars, loss_start, loss_end, chars), a row per reply: the
    example's text is the first `chars` code points of its conversation's text."""
    return rows.filter("loss_start is not null").select("conv_id", "example", F.col("place").alias("context_turns"), "context_chars", "loss_start", "loss_end", (F.col("context_chars") + F.length("segment")).alias("chars"))


def rendered(rows: DataFrame) -> DataFrame:
    """FORMATTED to (conv_id, example, text, loss_start, loss_end): whole examples as one text each. Their size is the
    square of a conversation's, so this is for those that are about to be used."""
    sorted_parts = F.sort_array(F.collect_list(F.struct("place", "segment"))).alias("parts")
    parts = expanded(rows).groupBy("conv_id", "example").agg(F.max("loss_start").alias("loss_start"), F.max("loss_end").alias("loss_end"), sorted_parts).filter("loss_start is not null")
    return parts.select("conv_id", "example", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("text"), "loss_start", "loss_end")


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint, example_chars bigint"


def _read(batches):
    names = [f.split()[0] for f in READ.split(", ")]
    done: list[tuple] = []
    last: object = ()
    state: list = []
    text: list = []  # of the example that is being read: its number, turns, digest and length

    def close():
        if state:  # the last example has all turns
            loss_chars, loss, targets, example_chars = state
            done.append((last, text[1], text[2].hexdigest(), loss_chars, loss.hexdigest(), text[3], targets, example_chars))

    def emit():
        got = list(zip(*done, strict=True)) if done else [[] for _ in names]
        kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(got, kinds, strict=True)], names)

    for b in batches:
        for conv, example, segment, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "example", "segment", "loss_start", "loss_end")), strict=True):
            if not state or conv != last:
                close()
                last, state, text = conv, [0, hashlib.sha256(), 0, 0], []
            if not text or example != text[0]:
                text = [example, 0, hashlib.sha256(), 0]
            for role, said in turns_in(segment):
                text[1] += 1
                text[2].update(f"{role}\n{said}\n".encode())
            if start is not None:
                said = unescaped(segment[start - text[3] : end - text[3]])
                state[0] += len(said)
                state[1].update(said.encode())
                state[2] += 1
            text[3] += len(segment)
            if start is not None:
                state[3] += text[3]
        if done:
            yield emit()
    close()
    yield emit()


def read_back(rows: DataFrame) -> DataFrame:
    """FORMATTED, expanded, to READ, a row per conversation: the turns parsed from its longest example, and what the masks cover in
    the text of each. A digest takes a conversation's examples in order, so they stream through one task, which holds a
    batch of rows. Rows that come from `formatted` lie there already and are only sorted; those of a stored table are
    shuffled first."""
    order = Window.partitionBy("conv_id").orderBy("example", "place")  # asks for them in order, wherever they are
    in_order = expanded(rows).select("conv_id", "example", "segment", "loss_start", "loss_end", F.row_number().over(order).alias("nth"))
    return map_arrow(in_order, _read, READ)


def chat_examples(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) and PROBE to READ, read back from the formatted examples.

    Turns are in order of turn (null first), then role and text, so ties and repeated rows have a place each. A null role or
    text is empty; rows of a null conv_id are one conversation. A conversation without replies has no example but keeps its
    text. A text of any length is one value; an empty table gives PROBE alone. Other columns are ignored, so their names
    can't clash.
    """
    probe = conversations.sparkSession.createDataFrame(PROBE, "conv_id bigint, turn bigint, role string, text string")
    plain = conversations.select(*[F.col(c).cast(t).alias(c) for c, t in probe.dtypes])
    return read_back(formatted(plain.unionByName(probe)))


def duckdb_sql() -> str:
    """The same over a table conversations."""
    plain = lambda x: f"regexp_replace({x}, '([<\\[])(\\\\*)(/?(?:s>|INST\\]|ROLE\\]))', '\\1\\2\\\\\\3', 'g')"
    return f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values {', '.join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in PROBE)})
), s as (
  select *, length(case role when 'user' then '{USER}' when 'assistant' then '{REPLY}' else '{ROLE}' || {plain('role')} || '{NAMED}' end || {plain('text')} || '{END}') as chars from c
), o as (
  select *, row_number() over w as k, sum(chars) over (w rows between unbounded preceding and current row) as upto from s window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars, count(*) filter (role = 'assistant') as n_examples, coalesce(sum(upto) filter (role = 'assistant'), 0)::bigint as example_chars
from o group by conv_id
"""

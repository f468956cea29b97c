"""Prefix trie of conversations: ternary search trees over turn ids per range shard, merged along their boundaries.

1. A dictionary gives each distinct (role, text) an id; conversations become arrays of ids with the texts' lengths.
2. Conversations are sorted by (ids, conv_id) over ranges, so those under a trie node are a run of the order. A task reads
   its range in blocks of BLOCK turns. A block's distinct sequences go into a ternary search tree, the middle one first,
   then the middles of both halves, so that its searches are balanced; a walk with a stack of its own, from the leaves
   up, sums children, leaves and savings.
3. Only nodes on the path of a block's first and last sequence can go on in another block. They stay open: blocks of a task
   are merged at once, tasks in rounds of FAN neighbours, and what is no longer on an outer path is closed and counted for
   its parent. A round holds two paths per input, whatever the number of conversations.
4. Equal conversations stand together, ascending: their ids are hashed as they stream by. Where a node's own conversations
   lie in several tasks, they come as chunks of text, which are hashed by node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import parts_of
from .shared import cut, map_arrow

#: Turns, about, of a block's distinct sequences; shards that a round merges; bytes of a chunk of conversation ids.
BLOCK, FAN, CHUNK = 200_000, 64, 1 << 16
EVERY, HEADS = 100, 6
NONE = hashlib.sha256(b"").hexdigest()
NODE, OPEN, ENDS = 0, 1, 2
FIELDS = [
    ("kind", pa.int32(), "int"), ("part", pa.int64(), "bigint"), ("seq", pa.int64(), "bigint"), ("key", pa.binary(), "binary"), ("parent", pa.binary(), "binary"), ("depth", pa.int64(), "bigint"),
    ("chars", pa.int64(), "bigint"), ("members", pa.int64(), "bigint"), ("low", pa.int64(), "bigint"), ("parent_low", pa.int64(), "bigint"), ("kids", pa.int64(), "bigint"), ("leaves", pa.int64(), "bigint"),
    ("saved", pa.int64(), "bigint"), ("first", pa.bool_(), "boolean"), ("last", pa.bool_(), "boolean"), ("ends", pa.string(), "string"),
]
SCHEMA = ", ".join(f"{n} {t}" for n, _, t in FIELDS)


class Tree:
    """A block's ternary search tree: each node has a turn id, links to smaller and greater ids at its place, and to the
    ids that come next. Node 0 is the root, without an id."""

    def __init__(self):
        self.id, self.lower, self.next, self.higher, self.parent = [None], [0], [0], [0], [0]
        self.members, self.low, self.chars, self.ends = [0], [None], [0], [NONE]

    def _new(self, id_, parent, chars):
        for column, value in ((self.id, id_), (self.lower, 0), (self.next, 0), (self.higher, 0), (self.parent, parent), (self.members, 0), (self.low, None), (self.chars, chars), (self.ends, NONE)):
            column.append(value)
        return len(self.id) - 1

    def child(self, node: int, id_: int, chars: int) -> int:
        """The node's child by an id, which is made if it is new."""
        at = self.next[node]
        if not at:
            self.next[node] = made = self._new(id_, node, chars)
            return made
        while self.id[at] != id_:
            side = self.lower if id_ < self.id[at] else self.higher
            if not side[at]:
                side[at] = made = self._new(id_, node, chars)
                return made
            at = side[at]
        return at

    def insert(self, ids, chars, members, low, ends) -> list[int]:
        """Adds a sequence and gives its path."""
        path = [0]
        for id_, c in zip(ids, chars, strict=True):
            path.append(self.child(path[-1], id_, c))
        for node in path:
            self.members[node] += members
            self.low[node] = low if self.low[node] is None else min(low, self.low[node])
        self.ends[path[-1]] = ends
        return path

    def order(self) -> list[int]:
        """All nodes, parents before children."""
        out, stack = [], [0]
        while stack:
            node = stack.pop()
            out.append(node)
            at = [self.next[node]] if self.next[node] else []
            while at:
                x = at.pop()
                stack.append(x)
                at += [y for y in (self.lower[x], self.higher[x]) if y]
        return out


def medians(n: int):
    """0 to n - 1, the middle first, then the middles of both halves, and so on."""
    stack = [(0, n)]
    while stack:
        lo, hi = stack.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            stack += [(lo, mid), (mid + 1, hi)]


def prefix_key(parent: bytes, id_: int) -> bytes:
    """The name of a node across shards: 128 bits over its ids."""
    return hashlib.sha256(parent + id_.to_bytes(8, "big", signed=True)).digest()[:16]


def key_of(ids) -> bytes:
    key = b""
    for id_ in ids:
        key = prefix_key(key, id_)
    return key


def block_nodes(sequences: list[tuple]) -> tuple[list[dict], list[dict]]:
    """Sorted distinct (ids, chars, members, low, ends) to closed nodes and to the open ones on the outer paths; ends is a
    digest, or the node's key if chunks of it are hashed later."""
    tree, paths = Tree(), {}
    last = len(sequences) - 1
    for i in medians(len(sequences)):
        path = tree.insert(*sequences[i])
        if i in (0, last):
            paths[i] = path
    keys = {0: b""}
    for path in (paths[0], paths[last]):
        for up, node in zip(path, path[1:], strict=False):
            keys.setdefault(node, prefix_key(keys[up], tree.id[node]))
    n = len(tree.id)
    kids, leaves, saved, depth = [0] * n, [0] * n, [0] * n, [0] * n
    digest = [None if isinstance(e, bytes) else e for e in tree.ends]
    closed, order = [], tree.order()
    for node in order[1:]:
        depth[node] = depth[tree.parent[node]] + 1
    for node in reversed(order):
        if node in keys:
            continue
        up = tree.parent[node]
        leaves[node], saved[node] = leaves[node] or 1, saved[node] + (tree.members[node] - 1) * tree.chars[node]
        kids[up], leaves[up], saved[up] = kids[up] + 1, leaves[up] + leaves[node], saved[up] + saved[node]
        open_up = up in keys
        closed.append({"kind": NODE, "depth": depth[node], "members": tree.members[node], "low": tree.low[node], "parent": keys.get(up), "parent_low": None if open_up else tree.low[up], "kids": kids[node], "leaves": leaves[node], "saved": saved[node], "ends": digest[node], "key": tree.ends[node] if digest[node] is None else None})
    first, final = set(paths[0]), set(paths[last])
    open_ = [{"kind": OPEN, "key": k, "parent": keys[tree.parent[x]] if x else None, "depth": depth[x], "chars": tree.chars[x], "members": tree.members[x], "low": tree.low[x], "kids": kids[x], "leaves": leaves[x], "saved": saved[x], "first": x in first, "last": x in final, "ends": digest[x]} for x, k in keys.items()]
    return closed, open_


def merge(before: list[dict], after: list[dict]) -> tuple[list[dict], list[dict]]:
    """Open nodes of two neighbours to (closed, open): those on the first one's first path or the second one's last path
    stay open."""
    held = {r["key"]: r | {"last": False} for r in before}
    for r in after:
        if (mine := held.get(r["key"])) is None:
            held[r["key"]] = r | {"first": False}
        else:
            held[r["key"]] = mine | {x: mine[x] + r[x] for x in ("members", "kids", "leaves", "saved")} | {"low": min(mine["low"], r["low"]), "last": r["last"], "ends": r["ends"] if mine["ends"] == NONE else mine["ends"] if r["ends"] == NONE else None}
    return settle(held, lambda r: not (r["first"] or r["last"]))


def settle(held: dict[bytes, dict], shut) -> tuple[list[dict], list[dict]]:
    """Closes the nodes that `shut` names, the deepest first, and counts them for their parents."""
    closed = []
    for r in sorted((r for r in held.values() if shut(r)), key=lambda r: -r["depth"]):
        del held[r["key"]]
        r["leaves"], r["saved"], r["kind"] = r["leaves"] or 1, r["saved"] + (r["members"] - 1) * r["chars"], NODE
        if (up := held.get(r["parent"])) is not None:
            up["kids"], up["leaves"], up["saved"] = up["kids"] + 1, up["leaves"] + r["leaves"], up["saved"] + r["saved"]
        closed.append(r)
    return closed, list(held.values())


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t, _ in FIELDS], [n for n, _, _ in FIELDS])


class Run:
    """The conversation ids of one sequence: hashed as they come; chunks of their text where other tasks may have more."""

    def __init__(self, ids, chars, low, shared, chunk):
        self.ids, self.chars, self.low, self.members, self.chunk = ids, chars, low, 0, chunk
        self.hash, self.text, self.chunks, self.shared = hashlib.sha256(), "", [], shared

    def add(self, conv: int) -> None:
        more = f"{conv}" if not self.members else f",{conv}"
        self.members, self.text = self.members + 1, self.text + more
        if len(self.text) >= self.chunk:
            self.flush()

    def flush(self) -> None:
        if not self.text:
            return
        self.hash.update(self.text.encode())
        self.chunks.append(self.text)
        self.text = ""


def _shard(block, chunk):
    def run(batches):
        out, sequences, open_, turns, part, seq = [], [], None, 0, 0, 0
        now: Run | None = None

        def chunks(r: Run):
            nonlocal seq
            key = key_of(r.ids)
            for text in r.chunks:
                out.append({"kind": ENDS, "key": key, "part": part, "seq": seq, "ends": text})
                seq += 1
            r.chunks = []

        def close(r: Run, last: bool):
            """The sequence with its digest, or with its node's key where its chunks are hashed later."""
            nonlocal turns
            r.flush()
            if r.shared or last:
                chunks(r)
            sequences.append((r.ids, r.chars, r.members, r.low, key_of(r.ids) if r.shared or last else r.hash.hexdigest()))
            turns += len(r.ids) + 1

        def end_block():
            nonlocal open_, sequences, turns
            closed, fresh = block_nodes(sequences)
            out.extend(closed)
            if open_ is None:
                open_ = fresh
            else:
                closed, open_ = merge(open_, fresh)
                out.extend(closed)
            sequences, turns = [], 0

        for b in batches:
            part = b.column("part")[0].as_py() if b.num_rows else part
            for conv, ids, chars in zip(b.column("conv_id").to_pylist(), b.column("ids").to_pylist(), b.column("chars").to_pylist(), strict=True):
                if now is None or now.ids != ids:
                    if now is not None:
                        close(now, False)
                        if turns >= block:
                            end_block()
                    now = Run(ids, chars, conv, now is None, chunk)
                now.add(conv)
                if now.chunks:
                    if not now.shared:
                        now.shared = True  # long: its chunks are written as they fill, and hashed with those of other tasks
                    chunks(now)
            if len(out) >= 10_000:
                yield _batch(out)
                out.clear()
        if now is not None:
            close(now, True)
            end_block()
            for r in open_:
                out.append(r | {"part": part})
        yield _batch(out)

    return run


def _round(final):
    """Neighbours' open nodes, in order of (group, part): one list of open nodes for each group, none at the end."""

    def run(batches):
        out: list[dict] = []
        group, part, held, piece = None, None, None, []

        def join():
            nonlocal held, piece
            if piece:
                closed, held = ([], piece) if held is None else merge(held, piece)
                out.extend(closed)
            piece = []

        def finish():
            nonlocal held
            if held and final:
                closed, _ = settle({r["key"]: r for r in held}, lambda r: True)
                out.extend(closed)
            elif held:
                out.extend(r | {"part": group} for r in held)
            held = None

        for b in batches:
            for r in b.to_pylist():
                if r["group"] != group:
                    join()
                    finish()
                    group = r["group"]
                elif r["part"] != part:
                    join()
                part = r["part"]
                piece.append(r)
            if len(out) >= 10_000:
                yield _batch(out)
                out.clear()
        join()
        finish()
        yield _batch(out)

    return run


def _hash_chunks(batches):
    key, state, done = None, None, []
    for b in batches:
        for k, text in zip(b.column("key").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if k != key or state is None:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode() if not text.startswith(",") else text.encode())
    if state is not None:
        done.append((key, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["node", "digest"])


def sequences_of(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) to (conv_id, ids, chars): the dictionary's ids of its turns in order, and
    their texts' code points. Rows without a conv_id are no conversation's."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = cut(conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), key.alias("key"), F.length(text).alias("chars")))
    words = cut(turns.groupBy(F.col("key").alias("word")).agg(F.count(F.lit(1)).alias("seen")).select("word", F.monotonically_increasing_id().alias("id")))
    items = F.sort_array(F.collect_list(F.struct(F.col("turn").isNotNull().alias("given"), "turn", "key", "id", "chars"))).alias("items")
    rows = turns.join(words, F.col("key") == F.col("word")).groupBy("conv_id").agg(items)
    return rows.select("conv_id", F.transform("items", lambda x: x["id"]).alias("ids"), F.transform("items", lambda x: x["chars"]).alias("chars"))


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Each conversation with its first h turns replaced by those of the one that its hundred begins with."""
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    heads = sequences.filter(F.col("conv_id") % EVERY == 0).select(F.col("conv_id").alias("base"), *[F.slice(c, 1, HEADS - 1).alias(f"head_{c}") for c in ("ids", "chars")])
    rows = sequences.join(heads, F.col("conv_id") - F.col("conv_id") % EVERY == F.col("base"), "left").withColumn("h", h.cast("int"))
    whole = lambda c, t: F.concat(F.slice(F.coalesce(f"head_{c}", F.array().cast(t)), F.lit(1), F.col("h")), F.slice(c, F.col("h") + 1, F.size(c))).alias(c)
    return rows.select("conv_id", whole("ids", "array<bigint>"), whole("chars", "array<int>"))


def trie(sequences: DataFrame, block: int = BLOCK, fan: int = FAN, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, ids, chars) to the trie's nodes: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256)."""
    parts = parts_of(sequences)
    ranged = sequences.repartitionByRange(parts, "ids", "conv_id").sortWithinPartitions("ids", "conv_id").withColumn("part", F.spark_partition_id().cast("bigint"))
    shards = cut(map_arrow(ranged, _shard(block, chunk), SCHEMA))
    open_, nodes = shards.filter(F.col("kind") == OPEN), shards.filter(F.col("kind") == NODE)
    while True:
        final = parts <= fan
        grouped = open_.withColumn("group", F.expr(f"part div {fan}")).repartition("group").sortWithinPartitions("group", "part", "depth")
        step = cut(map_arrow(grouped, _round(final), SCHEMA))
        nodes = nodes.unionByName(step.filter(F.col("kind") == NODE))
        if final:
            break
        open_, parts = step.filter(F.col("kind") == OPEN), -(-parts // fan)
    chunks = shards.filter(F.col("kind") == ENDS).select("key", "part", "seq", "ends").repartition("key").sortWithinPartitions("key", "part", "seq")
    digests = map_arrow(chunks, _hash_chunks, "node binary, digest string")
    # a closed child of an open node has its parent's key, and gets the conversation that names it here
    names = nodes.filter("key is not null").select(F.col("key").alias("of"), F.col("low").alias("of_low"))
    known = nodes.filter("parent is null").withColumn("of_low", F.col("parent_low"))
    asked = nodes.filter("parent is not null").join(names, F.col("parent") == F.col("of")).drop("of")
    rows = known.unionByName(asked)
    done = rows.filter("ends is not null")
    late = rows.filter("ends is null").join(digests, F.col("key") == F.col("node")).withColumn("ends", F.col("digest")).drop("node", "digest")
    return done.unionByName(late).select(F.col("low").alias("conv_id"), "depth", F.col("of_low").alias("parent_conv_id"), F.col("members").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) to a row per node of the trie of the rebuilt conversations.

    A null role or text is empty. Turns are in order of turn (null first), those of one number in order of a digest of role
    and text; repeated rows are turns of their own. Rows without a conv_id are left out. A conversation is one value of 12
    bytes a turn in one task, a text of any length is hashed as one value. An empty table gives no rows, not even a root.
    Other columns are ignored, so their names can't clash.
    """
    return trie(cut(rebuilt(cut(sequences_of(conversations)))))


def duckdb_sql() -> str:
    """The same over a table conversations."""
    from .merkle import crc32_sql

    return f"""
with c as (
  select conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as k, length(coalesce(text, '')) as chars from conversations where conv_id is not null
), o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, substr(k, 1, 32)) as pos from c
), i as (
  select conv_id, conv_id - conv_id % {EVERY} as base, {crc32_sql('conv_id::varchar')} % {HEADS} as h from (select distinct conv_id from c)
), r as (
  select i.conv_id, 0 as own, pos, k, chars from i join o on o.conv_id = i.base and pos <= h
  union all select i.conv_id, 1, pos, k, chars from i join o on o.conv_id = i.conv_id and pos > h
), p as (
  select conv_id, chars, row_number() over w as depth, string_agg(k, '') over w as path from r window w as (partition by conv_id order by own, pos)
), m as (
  select conv_id, chars, depth, md5(path) as node, coalesce(lag(md5(path)) over (partition by conv_id order by depth), '') as parent from p
  union all select conv_id, 0, 0, '', null from i
), t as (
  select conv_id, max(depth) as depth from m group by 1
), n as (
  select node, parent, m.depth, any_value(chars) as chars, min(m.conv_id) as low, count(*) as n_convs, string_agg(m.conv_id::varchar, ',' order by m.conv_id) filter (t.depth = m.depth) as ends from m join t using (conv_id) group by all
), k as (
  select parent as node, count(*) as n_children from n where parent is not null group by 1
), s as (
  select m.node, sum((x.n_convs - 1) * x.chars) as saved, count(*) filter (k.n_children is null) as leaves from n x left join k on k.node = x.node join m on m.conv_id = x.low and m.depth <= x.depth group by 1
)
select n.low as conv_id, n.depth, u.low as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, s.leaves as n_leaves, s.saved::bigint as saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
from n left join n u on u.node = n.parent left join k on k.node = n.node join s on s.node = n.node
"""

"""Merkle manifest of a dataset: a hash tree per source, and one over the sources' roots, with a proof for each row.

Slot pivot: a level's nodes are grouped by parent, and conditional aggregates spread each parent's children into FANOUT
columns. All columns concatenated give the parent's hash; all but a child's own give its siblings. A third of the rows
is left a level up, so all levels together are half as many rows as there are leaves, and a hot source is as many
groups as any other rows. Places of leaves come from ranges of the global order (source, id), never from one task.

Proofs go down again: each parent row gets the path from its own node to the root, its children add their siblings to it.
A path is an array of (slot, others), 32 or 64 bytes a level. Digests are stored as bytes and hashed as hex text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered, placed
from .shared import cut

FANOUT = 3
PATH = "array<struct<slot:int,others:binary>>"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value: no two rows frame alike."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*parts: Column) -> Column:
    """SHA-256 of the concatenated parts, as bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _children() -> list[str]:
    return [f"c{s}" for s in range(FANOUT)]


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """nodes(g, idx, n, hash), n of them in group g and at most `most` in any, to the tables of their parents level by
    level: (g, idx, n, c0, c1, c2, hash)."""
    out = []
    while most > 1:
        slot = F.expr(f"idx % {FANOUT}")
        spread = [F.max(F.when(slot == s, F.col("hash"))).alias(c) for s, c in enumerate(_children())]
        up = nodes.filter("n > 1").groupBy("g", F.expr(f"idx div {FANOUT}").alias("idx")).agg(F.expr(f"(max(n) + {FANOUT - 1}) div {FANOUT}").alias("n"), *spread)
        nodes = cut(up.withColumn("hash", digest(*[F.coalesce(hexed(F.col(c)), F.lit("")) for c in _children()])))
        out.append(nodes)
        most = -(-most // FANOUT)
    return out


def _under(nodes: DataFrame, parents: DataFrame, keep: list[str]) -> DataFrame:
    """nodes(g, idx, ...) with their path and subroot, from their parents' rows; a parent without children columns
    stands for what is above a group's last node."""
    above = parents.select(F.col("g").alias("pg"), F.col("idx").alias("pidx"), *[F.col(c).alias(f"p{c}") for c in _children()], F.col("path").alias("ppath"), F.col("subroot"))
    slot = F.expr(f"cast(idx % {FANOUT} as int)")
    none = F.expr("X''")
    others = [F.concat(*[F.coalesce(F.col(f"p{c}"), none) for k, c in enumerate(_children()) if k != s]) for s in range(FANOUT)]
    mine = F.when(slot == 0, others[0])
    for s in range(1, FANOUT):
        mine = mine.when(slot == s, others[s])
    step = F.array(F.struct(slot.alias("slot"), mine.alias("others"))).cast(PATH)
    on = (F.col("g") == F.col("pg")) & (F.expr(f"idx div {FANOUT}") == F.col("pidx"))
    return nodes.join(above, on).select(*keep, F.when(F.col("pc0").isNull(), F.col("ppath")).otherwise(F.concat(step, "ppath")).alias("path"), "subroot")


def _paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Parents of the leaves with their paths, and, for groups of one leaf, what is above them; above(g, height, path,
    subroot) has for each group the path from its root on."""
    ends = lambda height: above.filter(F.col("height") == height).select("g", F.lit(0).cast("bigint").alias("idx"), *[F.lit(None).cast("binary").alias(c) for c in _children()], "path", "subroot")
    down = ends(len(levels))
    for i in range(len(levels) - 1, -1, -1):
        down = _under(levels[i], down, ["g", "idx", *_children()]).unionByName(ends(i))
    return down


def _roots(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(g, height, hash): the last node of each group."""
    tops = nodes.filter("n = 1").select("g", F.lit(0).alias("height"), "hash")
    for i, level in enumerate(levels):
        tops = tops.unionByName(level.filter("n = 1").select("g", F.lit(i + 1).alias("height"), "hash"))
    return tops


def with_proofs(rows: DataFrame, group: str, order: list[str], leaf: str) -> DataFrame:
    """rows with `path`, `subroot` and `root`: `leaf` is a row's digest, rows of a `group` are in `order` (nulls first),
    groups in byte order of their names, null first. Rows that agree in all of these stand next to each other in any order.
    """
    spark = rows.sparkSession
    kept = rows.columns
    at = placed(rows, [F.col(group), *[F.col(c) for c in order], F.col(leaf)])
    stats = cut(at.groupBy(F.col(group).alias("name"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("m"), F.min("row").alias("low")))
    groups = cut(numbered(stats.groupBy("name").agg(F.sum("m").alias("n")), [F.col("name")], "g"))
    size = groups.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("groups")).first()
    before = F.coalesce(F.sum("m").over(Window.partitionBy("name").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = groups.select(F.col("name").alias("name_"), "g", "n")
    spans = cut(stats.withColumn("base", before - F.col("low")).join(named, F.col("name").eqNullSafe(F.col("name_"))).select("name", "p", "base", "g", "n"))
    leaves = at.join(spans, F.col(group).eqNullSafe(F.col("name")) & (F.col("part") == F.col("p")))
    leaves = leaves.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(kept)], F.col(leaf).alias("hash"), "g", (F.col("base") + F.col("row")).alias("idx"), "n")

    levels = _levels(leaves.select("g", "idx", "n", "hash"), size.most or 0)
    subroots = cut(_roots(leaves, levels))
    heads = subroots.select(F.lit(0).cast("bigint").alias("g"), F.col("g").alias("idx"), F.lit(size.groups).cast("bigint").alias("n"), "hash", F.col("g").alias("of"), "height")
    upper = _levels(heads, size.groups)
    root = (upper[-1] if upper else heads).first()
    over = spark.createDataFrame([(0, len(upper))], "g bigint, height int").select("g", "height", F.array().cast(PATH).alias("path"), F.lit(None).cast("binary").alias("subroot"))
    above = cut(_under(heads, _paths(upper, over), ["of", "height", "hash"]).select(F.col("of").alias("g"), "height", "path", F.col("hash").alias("subroot")))
    out = _under(leaves, _paths(levels, above), [f"_{i}" for i in range(len(kept))])
    return out.toDF(*kept, "path", "subroot").withColumn("root", F.lit(bytes(root.hash) if root else None).cast("binary"))


def proof(path: Column) -> Column:
    """SHA-256 hex of all siblings from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: hexed(p["others"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root, hex, that a leaf's digest and its path give."""

    def up(h, p):
        others, mine = hexed(p["others"]), p["slot"] * 64
        return F.sha2(F.concat(others.substr(F.lit(1), mine), h, others.substr(mine + 1, F.length(others))), 256)

    return F.aggregate(path, hexed(leaf), up)


def merkle_proofs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, lang, n_chars, text, ...) to (doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified), one row per row of docs.

    Rows whose crc32(doc_id as text) is even are checked as if their text had lost its line feeds. Nulls frame as `-`, unlike
    empty texts; a null doc_id comes first in its source and its text counts as empty in the crc32. Rows of one doc_id
    are in order of their digests; repeated rows have equal leaves and a place each. A lone row is its source's subroot; a
    lone source's subroot is the root. A text of any length is hashed as one value. An empty table gives no rows; other
    columns are ignored, so their names can't clash.
    """
    text = F.col("text").cast("string")
    fields = [framed(F.col(c)) for c in COLUMNS]
    tampered = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0) & F.contains(text, F.lit("\n"))
    lost = digest(*fields[:-1], framed(F.replace(text, F.lit("\n"), F.lit(""))))
    rows = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), digest(*fields).alias("leaf"), F.when(tampered, lost).alias("changed")))
    got = with_proofs(rows, "source", ["doc_id"], "leaf")
    again = folded(F.coalesce("changed", "leaf"), F.col("path"))
    out = got.select("doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), proof(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32_sql(text: str) -> str:
    """DuckDB's crc32 of a text of digits and signs."""
    bit = "list_reduce([xor(a, b)] || range(8), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)"
    return f"xor(list_reduce([4294967295] || list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: ord(c)::bigint), lambda a, b: {bit}), 4294967295)"


def duckdb_sql() -> str:
    """The same over a table documents."""
    framed_ = lambda x: f"case when {x} is null then '-' else strlen({x}::varchar) || ':' || {x} end"
    leaf = lambda text: "sha256(" + " || ".join([*(framed_(c) for c in COLUMNS[:-1]), framed_(text)]) + ")"
    up = lambda by: f"(max(n) + 2) // 3, sha256(string_agg(hash, '' order by idx)), lvl + 1 from {by}"
    near = lambda t: f"select x.g, x.lvl, x.idx, coalesce(string_agg(y.hash, '' order by y.idx) filter (y.idx < x.idx), '') as l, coalesce(string_agg(y.hash, '' order by y.idx) filter (y.idx > x.idx), '') as r from {t} x left join {t} y on y.g = x.g and y.lvl = x.lvl and y.idx // 3 = x.idx // 3 where x.n > 1 group by all"
    return f"""
with recursive d as materialized (
  select row_number() over () as rid, doc_id, source, {leaf('text')} as leaf,
    case when {crc32_sql("coalesce(doc_id::varchar, '')")} % 2 = 0 then {leaf("replace(text, chr(10), '')")} else {leaf('text')} end as changed from documents
), s as (
  select source, row_number() over (order by source nulls first) - 1 as g, count(*) over () as groups from (select distinct source from d)
), a as materialized (
  select d.*, g, groups, row_number() over (partition by g order by doc_id nulls first, leaf, rid) - 1 as idx, count(*) over (partition by g) as n from d join s on d.source is not distinct from s.source
), t(g, idx, n, hash, lvl) as (
  select g, idx, n, leaf, 0 from a union all select g, idx // 3, {up('t')} where n > 1 group by g, idx // 3, lvl
), u(g, idx, n, hash, lvl) as (
  select 0, g, (select max(groups) from s), hash, 0 from t where n = 1 union all select g, idx // 3, {up('u')} where n > 1 group by g, idx // 3, lvl
), tn as materialized ({near('t')}), un as materialized ({near('u')}
), steps as (
  select rid, list({{'l': l, 'h': '', 'r': r}} order by k) as path from (
    select rid, lvl as k, l, r from a join tn on tn.g = a.g and tn.idx = a.idx // (3 ** lvl)::bigint
    union all select rid, 100 + lvl, l, r from a join un on un.idx = a.g // (3 ** lvl)::bigint) group by rid
), p as (
  select a.*, coalesce(path, []) as path, r.hash as subroot, (select hash from u where n = 1) as root from a left join steps using (rid) join t r on r.g = a.g and r.n = 1
)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) as proof_sha256,
  list_reduce([{{'l': '', 'h': changed, 'r': ''}}] || path, lambda x, y: {{'l': '', 'h': sha256(y.l || x.h || y.r), 'r': ''}}).h as folded_root, folded_root = root as verified
from p
"""

"""N-gram Jaccard self-join: prefix tiles by size, bitmap bounds, exact intersection, components.

1. Each text becomes the sorted array of its distinct 64-bit shingle hashes. Equal sets get one key, so exact copies
   are one node from here on. (Two different sets share a 64-bit key with probability n*n/2**65.)
2. A fixed-size counter sketch over all shingles marks the cells of frequent ones. Shingles are ordered with
   unmarked ones first, then by hash; any order is correct, this one keeps shared passages out of the prefixes.
3. Two sets within the limit share a shingle of their prefixes, and their sizes differ by the limit at most. Size bands
   are as wide as the limit, so the pair meets in the larger one's band: each node is at home in its own band's tile
   and a guest in the next. A tile is a shingle and a band, with rows (node, size, rest); rest counts the node's
   shingles from this one on. At the first shingle that two sets share, the smaller rest bounds their overlap, and
   with the sizes that bounds the pair: most pairs of a tile end there. Tiles of marked shingles may hold a third of
   all rows: they are aggregated before the shuffle and ordered by parts, never held by one task.
4. Chains and stars first: each tile tries its nodes with a neighbour and with its centre, which takes linear work in
   large groups of near copies. Their components collapse; then tiles that still hold more than one component give all pairs across
   components, so no link that could join two components is lost.
5. A pair passes if the XOR of the two bitmaps has so few bits that the overlap may reach the limit; then the sorted
   arrays are intersected exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .components import components
from .shared import cut, map_arrow
from .textkit import grams, mix, pieces, words

#: Cells of the sketch, at least and at most: one for about 64 words between these. The most are 64 MB in a task, 128 MB on
#: the driver and a bitmap of 2 MB for the tasks.
CELLS, MOST_CELLS = 1 << 22, 1 << 24
WIDTH = 5
NUM, DEN = 4, 5
#: How far above the mean a cell is marked at least, and nodes in a part of a marked shingle's tile, about.
MARKED, PART = 30, 4096
#: Nodes up to which a tile's pairs are tried one by one.
DIRECT = 24


def shingle_sets(column, width: int = WIDTH):
    """Per row: sorted distinct shingle hashes (uint64), in order."""
    for _, _, off, data in pieces(column):
        w = words(off, data)
        long = grams(w.hash, width)
        for i in range(len(off) - 1):
            a, b = int(w.first[i]), int(w.first[i + 1])
            n = b - a
            if n >= width:
                s = long[a : b - width + 1].copy()
                if len(s) > 1:
                    s.sort()
                    keep = np.empty(len(s), bool)
                    keep[0] = True
                    np.not_equal(s[1:], s[:-1], out=keep[1:])
                    s = s[keep]
                yield s
            elif n:
                yield grams(w.hash[a:b], n)[:1]
            else:
                yield w.hash[:0]


def key_of(s: np.ndarray) -> int:
    """Signed 64-bit key of a set."""
    return int((mix(s + np.uint64(len(s))).sum(dtype=np.uint64) ^ np.uint64(len(s))).astype(np.int64))


def _batch(names, arrays):
    return pa.RecordBatch.from_arrays(arrays, names)


def _fingerprint(width, cells):
    names = ["doc_id", "print", "n_shingles", "key", "bits", "chunk", "cells"]

    def run(batches):
        counts = np.zeros(cells, np.uint32)
        seen: set[int] = set()
        for b in batches:
            sizes, keys, bits = [], [], []
            for s in shingle_sets(b.column("text"), width):
                n = len(s)
                key = key_of(s) if n else None
                sizes.append(n)
                keys.append(key)
                bits.append(None)
                if n and key not in seen:
                    if len(seen) >= 1_000_000:
                        seen.clear()
                    seen.add(key)
                    bits[-1] = bitmap(s)
                    np.add.at(counts, (s & np.uint64(cells - 1)).astype(np.int64), 1)
            n = len(sizes)
            yield _batch(names, [b.column("doc_id"), b.column("print"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())])
        for k, v in sketch.chunks_of(counts):
            yield _batch(names, [*[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([v], pa.binary())])

    return run


def _values(batch, *columns):
    """Rows of a batch's binary columns; few are copied at a time."""
    for lo in range(0, batch.num_rows, 256):
        part = batch.slice(lo, 256)
        yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def bitmap(s: np.ndarray) -> bytes:
    """Parity bitmap: 64 bits at least, about one bit a shingle; the width depends on the size alone."""
    bits = 64
    while bits < len(s):
        bits *= 2
    hit = np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(hit.astype(np.uint8)).tobytes()


def fold_to(x: np.ndarray, width: int) -> np.ndarray:
    """A parity bitmap (bits as 0/1 bytes) folded to fewer bits stays a parity bitmap."""
    while len(x) > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _tokens(width, num, den, cells, marked):
    def run(batches):
        flags = np.unpackbits(np.frombuffer(marked.value, np.uint8)).astype(bool)
        seen: set[int] = set()
        for b in batches:
            token, node, size, rest, marks = [], [], [], [], []
            for s in shingle_sets(b.column(0), width):
                n = len(s)
                if not n:
                    continue
                key = key_of(s)
                if key in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(key)
                outer = n - -(-num * n // den) + 1
                heavy = flags[(s & np.uint64(cells - 1)).astype(np.int64)]
                token.append(np.concatenate([s[~heavy], s[heavy]])[:outer] if heavy.any() else s[:outer])
                marks.append(np.arange(outer) >= n - int(heavy.sum()))
                node.append(np.full(outer, key, np.int64))
                size.append(np.full(outer, n, np.int32))
                rest.append(np.arange(n, n - outer, -1, dtype=np.int32))
            if token:
                yield _batch(["token", "node", "size", "rest", "marked"], [pa.array(np.concatenate(token).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (node, size, rest, marks))])

    return run


def _bounded(num, den):
    def run(batches):
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(_values(b, "ba", "bb")):
                x, y = np.unpackbits(np.frombuffer(x, np.uint8)), np.unpackbits(np.frombuffer(y, np.uint8))
                m = min(len(x), len(y))
                differ = int((fold_to(x, m) ^ fold_to(y, m)).sum())
                # |A and B| <= (|A| + |B| - differ) / 2, and J >= t asks for |A and B| >= t/(1+t) (|A| + |B|)
                keep[i] = (num + den) * (int(na[i]) + int(nb[i]) - differ) >= 2 * num * (int(na[i]) + int(nb[i]))
            yield _batch(["a", "b"], [b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))])

    return run


def _exact(num, den):
    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(_values(b, "sa", "sb")):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = den * common >= num * (len(both) - common)
            yield _batch(["a", "b"], [b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))])

    return run


def _arrays(width):
    def run(batches):
        for b in batches:
            sets = list(shingle_sets(b.column("text"), width))
            own = pa.array([len(s) > 0 and key_of(s) == k for s, k in zip(sets, b.column("node").to_pylist(), strict=True)], pa.bool_())
            yield _batch(["node", "shingles"], [b.column("node").filter(own), pa.array([s.tobytes() for s in sets], pa.binary()).filter(own)])

    return run


def mark(counts: np.ndarray, least: int = MARKED) -> np.ndarray:
    """Cells far above the mean: more than five deviations and `least`."""
    mean = counts.mean()
    return counts > mean + 5 * mean**0.5 + least


def cells_for(texts: DataFrame) -> int:
    """Cells of the sketch for texts(text): a power of two."""
    words = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    return min(max(CELLS, 1 << (words // 64).bit_length()), MOST_CELLS)


def similar_groups(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN, cells: int | None = None, marked: int = MARKED) -> DataFrame:
    """docs(doc_id bigint, text string, ...) to (doc_id, n_shingles, component_id), one row per row of docs.

    Two rows link when |A and B| / |A or B| >= num/den over sets of `width`-word shingles of the text with A-Z
    lower-cased; a shorter text is one shingle. Null, empty or blank texts have size 0 and link with nothing: their
    component is their own doc_id. component_id is the smallest doc_id that links reach; a null doc_id is never the
    smallest. Repeated rows stay and share a component. A text of any length is one set in one task; an empty table gives
    no rows. Other columns are ignored, so their names can't clash.
    """
    prints, nodes = _nodes(docs, width, num, den, cells, marked)
    named = nodes.select(F.col("node").alias("key"), "component_id")
    keyed = prints.filter("key is not null").join(named, "key").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return keyed.unionByName(prints.filter("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of linked texts: the one of the smallest doc_id (null last), then of the smallest
    text hash; of rows that agree in both, one. Rows without words link with nothing and all stay. Columns stay as they
    are, whatever their names; an empty table gives no rows.
    """
    prints, nodes = _nodes(docs, WIDTH, NUM, DEN, None, MARKED)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "print")).alias("first")
    keep = prints.filter("key is not null").join(nodes.select(F.col("node").alias("key"), "root"), "key").groupBy("root").agg(first)
    keep = keep.select("first.*").unionByName(prints.filter("key is null").select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "print").distinct())
    id_ = F.col("doc_id").cast("bigint")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id"), _print().alias("print"), F.rlike(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]")).alias("worded"))
    rows = rows.join(keep, ["none", "id", "print"], "left_semi")
    one = rows.filter("worded").groupBy("none", "id", "print").agg(F.first("doc").alias("doc")).select("doc.*")
    return one.unionByName(rows.filter("not worded").select("doc.*"))


def _print():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _nodes(docs: DataFrame, width, num, den, cells, least) -> tuple[DataFrame, DataFrame]:
    """(doc_id, print, n_shingles, key) of each row, and (node, root, component_id) of each key."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), _print().alias("print"))
    cells = cells or cells_for(plain)
    seen = cut(map_arrow(plain, _fingerprint(width, cells), "doc_id bigint, print bigint, n_shingles bigint, key bigint, bits binary, chunk int, cells binary"))
    prints = seen.filter("n_shingles is not null").select("doc_id", "print", "n_shingles", "key")
    counts = sketch.summed(seen.filter("chunk is not null"), cells, "uint32", "uint64")
    marked = spark.sparkContext.broadcast(np.packbits(mark(counts, least)).tobytes())
    del counts

    tiles = cut(_tiles(plain, width, num, den, cells, marked))
    maps = seen.filter("bits is not null").groupBy(F.col("key").alias("node")).agg(F.first("n_shingles").alias("size"), F.first("bits").alias("bits"))
    owner = prints.filter("key is not null").groupBy(F.col("key").alias("node")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("first")).select("node", "first.doc_id", "first.print")

    first = cut(_chain_pairs(tiles, num, den))
    near = _within_bound(first, maps, num, den)
    found = _linked(near, plain, owner, width, num, den)
    roots = cut(components(found))
    rest = _cross_pairs(tiles, roots, num, den).join(first, ["a", "b"], "left_anti")
    more = _linked(_within_bound(rest, maps, num, den), plain, owner, width, num, den)
    merged = cut(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
    ids = owner.join(merged, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least_ids = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return prints, ids.join(least_ids, "root").select("node", "root", "component_id")


def _tiles(plain: DataFrame, width, num, den, cells, marked) -> DataFrame:
    """Rows (token, band, node, size, rest, guest) of shingles that two nodes or more have, each node once a tile; of
    marked ones also the tile's number of nodes and its centre, else null."""
    from pyspark.sql import Window

    rows = map_arrow(plain.select("text"), _tokens(width, num, den, cells, marked), "token bigint, node bigint, size int, rest int, marked boolean")
    home = rows.withColumn("home", _band(num, den))
    banded = lambda r: r.select("token", "node", "size", "rest", "home", F.explode(F.array("home", F.col("home") + 1)).alias("band")).select("token", "band", "node", "size", "rest", (F.col("band") > F.col("home")).alias("guest"))
    tile = Window.partitionBy("token")
    seen = home.filter("not marked").select("*", F.min("node").over(tile).alias("low"), F.max("node").over(tile).alias("high"), F.lag("node").over(tile.orderBy("node")).alias("prev"))
    few = banded(seen.filter("low <> high and (prev is null or prev <> node)"))
    # marked shingles: nodes once by (token, node), then sums that combine before the shuffle, joined back
    many = cut(banded(home.filter("marked").dropDuplicates(["token", "node"])))
    centre = F.max_by(F.struct("node", "size", "rest"), F.struct(F.col("rest") / F.col("size"), -F.col("node"))).alias("centre")
    facts = many.groupBy("token", "band").agg(F.count("*").alias("nodes"), centre).filter("nodes > 1")
    return few.withColumns({"nodes": F.lit(None).cast("bigint"), "centre": F.lit(None).cast("struct<node:bigint,size:int,rest:int>")}).unionByName(many.join(facts, ["token", "band"]))


def _band(num, den):
    """Number of a size's band; sizes of which the smaller is num/den of the larger at least are a band apart at most."""
    return F.floor(F.ln("size") / F.lit(math.log(den / num)) + F.lit(1e-9)).cast("int")


def _fits(num, den):
    """Whether the overlap that is left at this shingle can reach t / (1 + t) times the sizes' sum."""
    return F.expr(f"least(ra, rb) * {num + den} >= {num} * (na + nb)")


def _chain_pairs(tiles: DataFrame, num, den) -> DataFrame:
    """Few pairs that join most of a group: each tile's nodes with their neighbour, in one of four random orders that
    tiles share, and with the tile's centre. The centre has the greatest share of its shingles left, that is, the fewest
    of its own before the shared one: in a group of near copies, the text that all were made from. Large tiles are
    ordered by parts, which the centre joins."""
    from pyspark.sql import Window

    place = F.xxhash64("node", F.pmod("token", F.lit(4)))
    other = F.struct("node", "size", "rest")
    tile = Window.partitionBy("token", "band")
    centre = tile.orderBy((F.col("rest") / F.col("size")).desc(), "node")
    few = tiles.filter("nodes is null").select("node", "size", "rest", F.lag(other).over(tile.orderBy(place, "node")).alias("prev"), F.first(other).over(centre).alias("centre"))
    part = F.floor((F.shiftrightunsigned(place, 1) / F.lit(float(1 << 63))) * F.ceil(F.col("nodes") / PART))
    many = tiles.filter("nodes is not null").withColumn("part", part)
    many = many.select("node", "size", "rest", F.lag(other).over(Window.partitionBy("token", "band", "part").orderBy(place, "node")).alias("prev"), "centre")
    pairs = few.unionByName(many).select("node", F.col("size").alias("na"), F.col("rest").alias("ra"), F.explode(F.array("prev", "centre")).alias("other"))
    pairs = pairs.select("node", "na", "ra", F.col("other.node").alias("with"), F.col("other.size").alias("nb"), F.col("other.rest").alias("rb"))
    return pairs.filter("with is not null and node <> with").filter(_fits(num, den)).select(F.least("node", "with").alias("a"), F.greatest("node", "with").alias("b")).distinct()


def _cross_pairs(tiles: DataFrame, roots: DataFrame, num, den) -> DataFrame:
    """All pairs of a tile whose components differ and whose sizes fit.

    Whether a pair fits depends on its sizes and rests alone, and a tile has few of these. So they are tried first, then
    the components that have them, and nodes are paired only where both fit: a tile of many texts that share a template
    and can't be near takes one trial, and a large component beside a small one takes their product, not its square.
    """
    tile, kind = ["token", "band"], ["guest", "size", "rest"]
    named = tiles.join(roots, "node", "left").select("token", "band", "node", "size", "rest", "guest", F.coalesce("root", "node").alias("root"))
    mixed = named.groupBy(*tile).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("nodes")).filter("low <> high").select(*tile, "nodes")
    open_ = cut(named.join(mixed, tile))
    few, named = open_.filter(F.col("nodes") <= DIRECT), open_.filter(F.col("nodes") > DIRECT)
    end = lambda k: few.select(*tile, F.col("guest").alias(f"g{k}"), F.col("node").alias(k), F.col("size").alias(f"n{k}"), F.col("rest").alias(f"r{k}"), F.col("root").alias(f"c{k}"))
    small = end("a").join(end("b"), tile).filter("a < b and ca <> cb and not (ga and gb)").filter(_fits(num, den)).select("a", "b")
    kinds = named.groupBy(*tile, *kind).agg(F.min("root").alias("low"), F.max("root").alias("high"))
    x = kinds.select(*tile, F.col("guest").alias("ga"), F.col("size").alias("na"), F.col("rest").alias("ra"), F.col("low").alias("la"), F.col("high").alias("ha"))
    y = kinds.select(*tile, F.col("guest").alias("gb"), F.col("size").alias("nb"), F.col("rest").alias("rb"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    fit = x.join(y, tile).filter("not (ga and gb) and (la <> ha or lb <> hb or la <> lb)").filter(_fits(num, den)).select(*tile, "ga", "na", "ra", "gb", "nb", "rb")
    side = lambda rows, k, *more: rows.select(*tile, F.col("guest").alias(f"g{k}"), F.col("size").alias(f"n{k}"), F.col("rest").alias(f"r{k}"), F.col("root").alias(f"c{k}"), *more)
    held = named.select(*tile, *kind, "root").distinct()
    one, two = [*tile, "ga", "na", "ra"], [*tile, "gb", "nb", "rb"]
    apart = fit.join(side(held, "a"), one).join(side(held, "b"), two).filter("ca < cb")
    pairs = apart.join(side(named, "a", F.col("node").alias("x")), [*one, "ca"]).join(side(named, "b", F.col("node").alias("y")), [*two, "cb"])
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(small).distinct()


def _within_bound(pairs: DataFrame, maps: DataFrame, num, den) -> DataFrame:
    one = maps.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("bits").alias("ba"))
    two = maps.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col("bits").alias("bb"))
    return map_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ba", "bb"), _bounded(num, den), "a bigint, b bigint")


def _linked(pairs: DataFrame, plain: DataFrame, owner: DataFrame, width, num, den) -> DataFrame:
    pairs = cut(pairs)
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = owner.join(nodes, "node", "left_semi").select("node", F.col("doc_id").alias("id"), F.col("print").alias("of"))
    texts = plain.join(wanted, plain.doc_id.eqNullSafe(wanted.id) & (plain.print == wanted.of)).select("node", "text")
    arrays = cut(map_arrow(texts, _arrays(width), "node bigint, shingles binary").dropDuplicates(["node"]))
    one = arrays.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = arrays.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return map_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb"), _exact(num, den), "a bigint, b bigint")

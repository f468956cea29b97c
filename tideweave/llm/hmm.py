"""Hidden Markov language model, trained by Baum-Welch over all training rows.

Symbols of the model are the TOP most frequent training words, one class for each hashed ending and length of all other
words, and the end of a text. A rare word is its class's symbol times its share of the class, by absolute discounting;
words never seen in training share what the discount leaves, as one type per class.

Each iteration counts expected emissions, transitions and starts in every partition, and the sums alone reach the
driver: STATES x symbols numbers, whatever the corpus. States start from all training rows too: seeded projections of a
segment's symbols part the segments among them. Iterations end when they gain less than LEAST_GAIN a token. Training
cuts long texts into segments of SEGMENT tokens, so that memory is bounded, and writes their symbols once. A segment has
CONTEXT tokens of its text on either side, which lead the recursions in and out but aren't counted: every token and every
transition of a text is counted once, starts at the starts of texts alone. Scoring runs the scaled forward recursion
over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .shared import cut, map_arrow
from .textkit import FOLDED, mix, pieces, words

STATES = 8
TOP = 1 << 15
#: Words whose counts are broadcast (12 bytes each); others are joined.
KNOWN = 1 << 17
CLASSES = 1 << 10
END = TOP + CLASSES
SYMBOLS = TOP + CLASSES + 1
#: log10 likelihood a training token by which an iteration must better the one before it.
LEAST_GAIN = 0.002
SEGMENT, CONTEXT = 512, 32
#: Of the first responsibilities: how sharply projections part segments, and how far a state's symbols differ by themselves.
SHARP, APART = 4.0, 0.5
DISCOUNT = 0.7
#: Observations that the corpus-wide distribution counts for in a state's emissions.
PRIOR = 200.0
TRAINED = "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 5 <> 1"
#: Words that a counting task merges at once, and tokens that score together.
MERGED, SCORED = 1_000_000, 1_000_000


@dataclass
class Text:
    """Words of some rows: hashes, classes, and the index of each row's first word (one more at the end)."""

    hash: np.ndarray
    cls: np.ndarray
    first: np.ndarray


def read(column, limit: int = 1 << 20) -> Iterator[tuple[int, int, Text]]:
    for lo, hi, off, data in pieces(column, limit):
        w = words(off, data)
        last = FOLDED[data[w.end - 1]]
        before = FOLDED[data[np.maximum(w.end - 2, w.start)]]
        size = np.minimum(w.end - w.start, 15).astype(np.uint64)
        cls = (mix(last * np.uint64(3) + before * np.uint64(5) + size) % np.uint64(CLASSES)).astype(np.int32)
        yield lo, hi, Text(w.hash.view(np.int64), cls, w.first)


def _merged(parts):
    """Distinct (hash, class, count) of several such tables; a word has one class, so the hash decides."""
    h, c, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], c[order[first]], np.add.reduceat(n[order], first) if len(h) else n


def word_counts(plain: DataFrame) -> DataFrame:
    """(word, cls, n) of all training words, summed in each task before the shuffle."""

    def run(batches):
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(a) for a in x], ["word", "cls", "n"])
        held, waiting = [], 0
        for b in batches:
            for _, _, t in read(b.column("text")):
                held.append(_merged([(t.hash, t.cls, np.ones(len(t.hash), np.int64))]))
                waiting += len(held[-1][0])
                if waiting > MERGED:
                    held = [_merged(held)]
                    waiting = len(held[0][0])
                    if waiting > MERGED // 2:
                        yield out(held.pop())
                        waiting = 0
        if held:
            yield out(_merged(held))

    return map_arrow(plain, run, "word bigint, cls int, n bigint").groupBy("word", "cls").agg(F.sum("n").alias("n"))


def _cut(groups, room: int) -> tuple[int, int]:
    """The first group, by `at`, with which the rows exceed `room` (else the last), and the room before it."""
    at, before = 0, room
    for r in groups.agg(F.count("*").alias("v")).orderBy("at").collect():
        at, before, room = r["at"], room, room - r["v"]
        if room < 0:
            break
    return at, before


@dataclass
class Counts:
    """What the driver knows of the counts: totals, the KNOWN most frequent words, and sums per class of the rest."""

    tokens: int
    types: int
    ends: int
    words: np.ndarray  # sorted hashes of the known words
    number: np.ndarray  # their counts
    symbol: np.ndarray  # their symbols, -1 beyond TOP
    symbol_count: np.ndarray  # occurrences of each symbol
    class_tokens: np.ndarray
    class_types: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame, ends: int) -> Counts:
        total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        # words by count, in steps of a 32nd of a doubling; within the step that KNOWN ends in, by 4,096 ranges of hashes:
        # what is gathered exceeds KNOWN by one such range at most, and the cut is by count and hash
        level, part = F.floor(F.log2("n") * 32).cast("int"), F.shiftright("word", 52).cast("int")
        least, room = _cut(counts.groupBy((-level).alias("at")), KNOWN)
        last, _ = _cut(counts.filter(level == -least).groupBy(part.alias("at")), room)
        top = counts.filter((level > -least) | ((level == -least) & (part <= last))).select("word", "cls", "n", level.alias("level")).toArrow()
        hashed, c, n, step = (top.column(i).to_numpy() for i in range(4))
        order = np.lexsort((hashed, -step))[:KNOWN]
        hashed, c, n = hashed[order], c[order], n[order]
        order = np.lexsort((hashed, -n))
        hashed, c, n = hashed[order], c[order], n[order]
        per = counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
        tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in per:
            tokens[r.cls], types[r.cls] = r.n, r.v
        tokens -= np.bincount(c[:TOP], weights=n[:TOP], minlength=CLASSES)
        types -= np.bincount(c[:TOP], minlength=CLASSES)
        order = np.argsort(hashed)
        symbol = np.where(np.arange(len(n)) < TOP, np.arange(len(n)), -1)
        seen = np.zeros(SYMBOLS)
        seen[: min(TOP, len(n))] = n[:TOP]
        seen[TOP:END] = tokens
        seen[END] = ends
        return cls(int(total.n or 0) + ends, int(total.v) + (ends > 0), ends, hashed[order], n[order], symbol[order], seen, tokens, types)

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """Index among the known words, or -1."""
        if not len(self.words):
            return np.full(len(hashed), -1)
        at = np.minimum(np.searchsorted(self.words, hashed), len(self.words) - 1)
        return np.where(self.words[at] == hashed, at, -1)

    def symbols(self, t: Text, at: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return TOP + t.cls
        s = np.where(at >= 0, self.symbol[at], -1)
        return np.where(s >= 0, s, TOP + t.cls)

    def base(self, n):
        return np.log10((n + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def share(self, cls: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 of a rare word's share of its class, by its count (0: the share of all unseen words)."""
        held, types = self.class_tokens[cls], self.class_types[cls]
        with np.errstate(divide="ignore"):
            return np.where(held > 0, np.log10(np.where(n > 0, n - DISCOUNT, DISCOUNT * types)) - np.log10(held), 0.0)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states


def sequences(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with an end after each row, and each row's length."""
    size = np.diff(first)
    out = np.full(len(symbols) + len(size), END, np.int64)
    out[np.arange(len(symbols)) + np.repeat(np.arange(len(size)), size)] = symbols
    return out, size + 1


def by_time(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences stored one after another: the positions in the order of time, longest sequence first within a
    step, and how many sequences reach each step."""
    order = np.argsort(-size, kind="stable")
    begin = np.concatenate([[0], np.cumsum(size)])[:-1][order]
    longest = size[order]
    active = np.searchsorted(-longest, -np.arange(1, longest[0] + 1), "right") if len(size) else np.zeros(0, np.int64)
    t = np.repeat(np.arange(len(active)), active)
    rank = np.arange(len(t)) - np.repeat(np.cumsum(active) - active, active)
    return begin[rank] + t, active


def log_likelihood(m: Model, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
    """log10 likelihood of each sequence, by the scaled forward recursion."""
    at, active = by_time(size)
    total = np.zeros(len(size))
    order = np.argsort(-size, kind="stable")
    alpha, lo = None, 0
    seen = symbols[at]
    for n in active:
        e = m.emit[seen[lo : lo + n]]
        alpha = (m.start if alpha is None else alpha[:n] @ m.move) * e
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
        lo += n
    out = np.empty(len(size))
    out[order] = total
    return out


def expected(m: Model, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, transitions and emissions (symbols x states) of the sequences."""
    return both_ways(m, symbols, size)[:3]


def both_ways(m: Model, symbols: np.ndarray, size: np.ndarray, lead: np.ndarray | None = None, tail: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """What expected() gives, and the sequences' log10 likelihood. The first `lead` and the last `tail` tokens of a
    sequence, and transitions into them, aren't counted; nor is the start of one with a lead."""
    at, active = by_time(size)
    seen = symbols[at]
    k = len(m.start)
    low = np.concatenate([[0], np.cumsum(active)])
    order = np.argsort(-size, kind="stable")
    counted = np.ones(len(seen), bool)
    if lead is not None:
        t, rank = np.repeat(np.arange(len(active)), active), np.arange(len(seen)) - np.repeat(low[:-1], active)
        counted = (t >= lead[order][rank]) & (t < (size - tail)[order][rank])
    alpha, scale = np.empty((len(seen), k)), np.empty(len(seen))
    for t, n in enumerate(active):
        a = (m.start if t == 0 else alpha[low[t - 1] : low[t - 1] + n] @ m.move) * m.emit[seen[low[t] : low[t] + n]]
        scale[low[t] : low[t] + n] = s = a.sum(axis=1)
        alpha[low[t] : low[t] + n] = a / s[:, None]
    gamma = alpha  # turned into posteriors from the end
    moves = np.zeros((k, k))
    beta = np.ones((0, k))
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        a = alpha[low[t] : low[t] + n]
        back = np.ones((n, k))
        if len(beta):
            m1 = len(beta)
            span = slice(low[t + 1], low[t + 1] + m1)
            after = beta * m.emit[seen[span]] / scale[span, None]
            moves += (a[:m1] * counted[span, None]).T @ after
            back[:m1] = after @ m.move.T
        beta = back
        gamma[low[t] : low[t] + n] = a * back
    gamma[~counted] = 0.0
    emitted = np.stack([np.bincount(seen, weights=gamma[:, i], minlength=SYMBOLS) for i in range(k)], axis=1)
    return gamma[: active[0] if len(active) else 0].sum(axis=0), moves * m.move, emitted, float(np.log10(scale[counted]).sum())


def segmented(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences of these lengths, stored one after another, cut after every SEGMENT tokens: where each segment with its
    context begins and ends, and how much of it is context before and after."""
    n = -(-size // SEGMENT)
    text = np.repeat(np.arange(len(size)), n)
    end = np.cumsum(size)
    begin = (end - size)[text]
    low = begin + SEGMENT * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
    high = np.minimum(low + SEGMENT, end[text])
    first, last = np.maximum(low - CONTEXT, begin), np.minimum(high + CONTEXT, end[text])
    return first, last, low - first, last - high


def _normal(start, moves, emitted, corpus) -> Model:
    share = (corpus + 0.5) / (corpus.sum() + 0.5 * len(corpus))
    emit = (emitted + PRIOR * share[:, None]) / (emitted.sum(axis=0) + PRIOR)
    move = (moves + 1.0) / (moves + 1.0).sum(axis=1, keepdims=True)
    return Model((start + 1.0) / (start + 1.0).sum(), move, emit)


def segments(training: DataFrame, counts) -> DataFrame:
    """(symbols, lead, tail) of training(text): one row per segment, two bytes a symbol, and its tokens of context;
    `counts` is a broadcast."""

    def run(batches):
        c = counts.value
        for b in batches:
            for _, _, t in read(b.column("text")):
                symbols, size = sequences(c.symbols(t, c.find(t.hash)), t.first)
                first, last, lead, tail = segmented(size)
                held = np.concatenate([[0], np.cumsum(last - first)])
                taken = np.repeat(first - held[:-1], last - first) + np.arange(held[-1])
                buffers = [None, pa.py_buffer((2 * held).astype(np.int32).tobytes()), pa.py_buffer(symbols[taken].astype("<u2").tobytes())]
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(first), buffers), pa.array(lead, pa.int32()), pa.array(tail, pa.int32())], ["symbols", "lead", "tail"])

    return map_arrow(training.select("text"), run, "symbols binary, lead int, tail int")


def _stored(batch, limit: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols, lengths and context of segments(), about `limit` symbols at once."""
    column = batch.column("symbols")
    if not len(column):
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1]
    seen = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view("<u2")
    lead, tail = (batch.column(c).to_numpy().astype(np.int64) for c in ("lead", "tail"))
    end, lo = (off - off[0]) // 2, 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(end, end[lo] + limit, "right")) - 1)
        yield seen[end[lo] : end[hi]].astype(np.int64), np.diff(end[lo : hi + 1]).astype(np.int64), lead[lo:hi], tail[lo:hi]
        lo = hi


def _summed(cut_up: DataFrame, width: int, count) -> np.ndarray:
    """Sums over all segments of the cells that count(symbols, size, lead, tail) gives."""

    def run(batches):
        cells = np.zeros(width)
        for b in batches:
            for stored in _stored(b):
                at = 0
                for x in count(*stored):
                    x = np.ravel(x)
                    cells[at : at + len(x)] += x
                    at += len(x)
        for i, v in sketch.chunks_of(cells):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([v], pa.binary())], ["chunk", "cells"])

    return sketch.summed(map_arrow(cut_up, run, "chunk int, cells binary"), width, "float64")


def _chance(states: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((SYMBOLS, states))


def first_parts(symbols: np.ndarray, size: np.ndarray, corpus: np.ndarray, states: int) -> np.ndarray:
    """First responsibilities (segments x states): by projections on seeded vectors, rare symbols weighing most. They
    follow from a segment's symbols, so states differ by what is in them however many segments there are."""
    share = (corpus + 0.5) / (corpus.sum() + 0.5 * len(corpus))
    weight = -np.log(share)
    v = _chance(states) * weight[:, None]
    v -= share @ v
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    score = np.stack([np.add.reduceat(v[:, k][symbols], begin) for k in range(states)], axis=1)
    score *= SHARP / np.sqrt(np.add.reduceat(weight[symbols] ** 2, begin))[:, None]
    post = np.exp(score - score.max(axis=1, keepdims=True))
    return post / post.sum(axis=1, keepdims=True)


def first_model(cut_up: DataFrame, counts, states: int = STATES) -> Model:
    """States as parts of all segments; a state tends to stay."""
    corpus = counts.value.symbol_count

    def count(symbols, size, lead, tail):
        post = first_parts(symbols, size, counts.value.symbol_count, states)
        row, at = np.repeat(np.arange(len(size)), size), np.arange(len(symbols)) - np.repeat(np.cumsum(size) - size, size)
        own = (at >= lead[row]) & (at < (size - tail)[row])
        yield np.stack([np.bincount(symbols[own], weights=post[row[own], k], minlength=SYMBOLS) for k in range(states)], axis=1)
        yield post[lead == 0].sum(axis=0)

    got = _summed(cut_up, SYMBOLS * states + states, count)
    stay = np.full((states, states), 0.05 / max(states - 1, 1))
    np.fill_diagonal(stay, 0.95)
    # segments that are all alike part into equal states: symbols differ by themselves too
    emitted = got[:-states].reshape(SYMBOLS, states) * np.exp(APART * _chance(states))
    return replace(_normal(got[-states:], np.zeros((states, states)), emitted, corpus), move=stay / stay.sum(axis=1, keepdims=True))


def baum_welch(cut_up: DataFrame, counts, model: Model) -> tuple[Model, float]:
    """One iteration over all segments, and the log10 likelihood of the model before it; `counts` is a broadcast."""
    k = len(model.start)
    held = cut_up.sparkSession.sparkContext.broadcast(model)
    moved = SYMBOLS * k + k * k

    def count(*stored):
        start, moves, emitted, like = both_ways(held.value, *stored)
        return emitted, moves, start, like

    got = _summed(cut_up, moved + k + 1, count)
    out = _normal(got[moved:-1], got[SYMBOLS * k : moved].reshape(k, k), got[: SYMBOLS * k].reshape(SYMBOLS, k), counts.value.symbol_count)
    held.unpersist()
    return out, float(got[-1])


def train(cut_up: DataFrame, counts, states: int = STATES, least_gain: float = LEAST_GAIN) -> Model:
    """Iterations until one gains less than least_gain a token: likelihoods are at most 1, so they end."""
    model, last = first_model(cut_up, counts, states), -np.inf
    while True:
        model, like = baum_welch(cut_up, counts, model)
        like /= max(counts.value.tokens, 1)
        if like - last < least_gain:
            return model
        last = like


def _together(batches, c: Counts) -> Iterator[dict]:
    """Columns, symbols and rare words of the batches' texts, about SCORED tokens at once: the recursion takes a step for
    all texts together. `score` holds the shares of known words; `rare` has the words beyond the known ones, once per row."""
    held: list[dict] = []
    tokens = 0

    def joined():
        out = {k: np.concatenate([h[k] for h in held]) for k in held[0] if k not in ("rare", "doc_id")}
        out["doc_id"] = pa.concat_arrays([h["doc_id"] for h in held])
        out["rare"] = [h["rare"] for h in held]
        held.clear()
        return out

    for b in batches:
        for lo, hi, t in read(b.column("text")):
            k = hi - lo
            at = c.find(t.hash)
            row = np.repeat(np.arange(k), np.diff(t.first))
            known = at >= 0
            n = c.number[np.maximum(at, 0)] if len(c.words) else np.zeros(len(at), np.int64)
            rare = known & (c.symbol[np.maximum(at, 0)] < 0) if len(c.words) else known
            symbols, size = sequences(c.symbols(t, at), t.first)
            ids = b.column("row").slice(lo, k).to_numpy()
            j = np.flatnonzero(~known)
            j = j[np.lexsort((t.hash[j], row[j]))]
            begin = np.flatnonzero(np.append(True, (t.hash[j][1:] != t.hash[j][:-1]) | (row[j][1:] != row[j][:-1]))) if len(j) else j
            number, j = np.diff(np.append(begin, len(j))), j[begin]
            held.append({
                "row": ids, "doc_id": b.column("doc_id").slice(lo, k), "n_tokens": size, "symbols": symbols.astype(np.int32),
                "n_known": np.bincount(row, weights=known, minlength=k).astype(np.int64) + (c.ends > 0),
                "base_score": np.bincount(row, weights=np.where(known, c.base(n), 0.0), minlength=k) + c.base(c.ends),
                "score": np.bincount(row[rare], weights=c.share(t.cls[rare], n[rare]), minlength=k),
                "rare": (ids[row[j]], t.hash[j], t.cls[j], number),
            })
            tokens += len(symbols)
            if tokens >= SCORED:
                yield joined()
                tokens = 0
    if held:
        yield joined()


def score_documents(docs: DataFrame, states: int = STATES, least_gain: float = LEAST_GAIN) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row.

    Rows whose crc32(doc_id as text) mod 5 is 1 are held out, all others train. Null texts count as empty: one token, the
    end. A null doc_id counts as the empty text. Repeated rows train repeatedly and score alike; other columns are
    ignored, so their names can't clash. A table without training rows scores by the uniform model over no words.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    training = plain.filter(TRAINED)
    table = cut(word_counts(training.select("text")))
    counts = Counts.of(table, training.count())
    shared = spark.sparkContext.broadcast(counts)
    model = train(cut(segments(training, shared)), shared, states, least_gain)
    held = spark.sparkContext.broadcast(replace(model, emit=np.ascontiguousarray(model.emit)))
    names = ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "word", "cls", "n"]

    def run(batches):
        c, m = shared.value, held.value
        for part in _together(batches, c):
            n = len(part["row"])
            score = log_likelihood(m, part.pop("symbols"), part["n_tokens"])
            part["score"] = part["score"] + score
            yield pa.RecordBatch.from_arrays([*map(pa.array, (part[x] for x in names[:6])), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names)
            for row, word, cls, number in part["rare"]:
                n = len(row)
                yield pa.RecordBatch.from_arrays([pa.array(row), *[pa.nulls(n, pa.int64())] * 3, *[pa.nulls(n, pa.float64())] * 2, *map(pa.array, (word, cls, number))], names)

    seen = cut(map_arrow(plain.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text"), run, "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double, word bigint, cls int, n bigint"))
    rows, rare = seen.filter("word is null").drop("word", "cls", "n"), seen.filter("word is not null").select("row", "word", "cls", "n")
    rare = rare.join(table.select("word", F.col("n").alias("c")), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    size = spark.createDataFrame([(i, float(a), float(v)) for i, (a, v) in enumerate(zip(counts.class_tokens, counts.class_types))], "cls int, held double, types double")
    rare = rare.join(F.broadcast(size), "cls")
    share = F.when(F.col("held") > 0, F.log10(F.when(F.col("c") > 0, F.col("c") - DISCOUNT).otherwise(DISCOUNT * F.col("types"))) - F.log10("held")).otherwise(0.0)
    base = F.log10((F.col("c") + 0.5) / F.lit(counts.tokens + 0.5 * (counts.types + 1)))
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * base).alias("b"), F.sum(F.col("n") * share).alias("s"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    out = rows.join(more, "row", "left")
    return out.select("doc_id", (~F.expr(TRAINED)).alias("held_out"), "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(counts.tokens).cast("bigint").alias("train_tokens"), (F.col("base_score") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"))

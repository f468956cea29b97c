"""Quality rules with suffix-array repetition.

A text in which LEAST words in a row occur twice gets a suffix array over its words, by prefix doubling; the ranks of
each doubling also give the longest common prefix of neighbours. Intervals of the prefixes are the text's repeated
substrings that can't be longer to the right; those whose occurrences differ in the word before are maximal. The union
of their spans is what repeats cover, the longest is the longest repeat. Texts without such words, nearly all, never
leave the vectorised path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow
from .textkit import SPACE, grams, pieces, span_sums, words

WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Words of the shortest repeat that the method counts.
LEAST = 5
#: A text that passes the base (windows of 8 words cover at most 30 %) is kept if maximal repeats cover at most this share,
COVERED = 0.2
#: and its longest repeat has at most this many, however long the text.
LONGEST_WORDS = 50


def suffix_array(word: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in the order of their words (ordered by hash), and each suffix's rank by its first 1, 2, 4, ... words."""
    n = len(word)
    _, rank = np.unique(word, return_inverse=True)
    levels, step = [rank], 1
    while True:
        key = rank.astype(np.int64) * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        if fresh[order[-1]] == n - 1:
            return order, levels
        levels.append(fresh)
        rank, step = fresh, step * 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix, in words, of each suffix with the next in order."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    out = np.zeros(n - 1, np.int64)
    for i in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        hit = inside & (levels[i][np.minimum(a, n - 1)] == levels[i][np.minimum(b, n - 1)])
        a, b, out = a + (hit << i), b + (hit << i), out + (hit << i)
    return out


def intervals(lcp: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix in order, the length of the innermost interval of common prefixes that holds it (0: none of `least`
    or more), and whether the interval is maximal: whether its suffixes differ in the word `before` them."""
    n = len(before)
    length, maximal = np.zeros(n, np.int64), np.zeros(n, bool)
    inside = np.flatnonzero(np.maximum(np.append(lcp, 0), np.append(0, lcp)) >= least).tolist()
    prefix, word = np.append(lcp, 0).tolist(), before.tolist()
    # open intervals, each within the one below: length, its own suffixes, the word before all of them (None: they differ)
    stack: list[list] = []

    def add(top, own, w):
        top[1] += own
        if w is None or (top[2] is not False and top[2] != w):
            top[2] = None
        elif top[2] is False:
            top[2] = w

    def close():
        size, own, w = stack.pop()
        length[own], maximal[own] = size, w is None
        return w

    at = 0
    for i in inside:
        if at < least:  # the suffix before shares nothing with this one
            while stack:
                close()
        here = prefix[i] if prefix[i] >= least else 0
        if here > at or not stack:
            stack.append([here, [], False])
        add(stack[-1], [i], word[i])
        while stack and stack[-1][0] > here:
            w = close()
            if stack and stack[-1][0] >= here:
                add(stack[-1], [], w)
            elif here >= least:
                stack.append([here, [], w])
        at = here
    while stack:
        close()
    return length, maximal


def suffix_repeats(word: np.ndarray, least: tuple[int, ...] = (WINDOW,)) -> tuple[list[int], int]:
    """Of a text's word hashes: the words in maximal repeats, for each least length of a repeat, and the longest one's."""
    n = len(word)
    if n < 2:
        return [0] * len(least), 0
    order, levels = suffix_array(word)
    length, maximal = intervals(common_prefixes(order, levels), np.where(order > 0, levels[0][order - 1], -1 - order), min(least))
    covered = []
    for k in least:
        take = maximal & (length >= k)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, order[take], 1)
        np.add.at(edge, order[take] + length[take], -1)
        covered.append(int((np.cumsum(edge)[:n] > 0).sum()))
    return covered, int(length[maximal].max(initial=0))


def _judge(batches):
    for b in batches:
        column = b.column("text")
        for lo, hi, off, data in pieces(column):
            w = words(off, data, fold=False)
            inside = ~SPACE[data]
            n_words = np.diff(w.first)
            chars = span_sums(inside & ((data & 0xC0) != 0x80), off)
            symbols = span_sums(SYMBOLS[data], off)
            window = grams(w.hash, LEAST)
            repeated, covered = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
            longest = np.zeros(hi - lo, np.int64)
            lines = np.zeros(hi - lo, np.int64)
            raw = data.tobytes()
            for i in range(hi - lo):
                a, e = int(w.first[i]), int(w.first[i + 1])
                if e - a > LEAST:
                    x = np.sort(window[a : e - LEAST + 1])
                    if (x[1:] == x[:-1]).any():
                        (repeated[i], covered[i]), longest[i] = suffix_repeats(w.hash[a:e], (WINDOW, LEAST))
                text = raw[off[i] : off[i + 1]]
                if b"\n" in text:
                    full = [x for x in text.split(b"\n") if x.strip()]
                    lines[i] = len(full) - len(set(full))
            failed = (n_words < 20) | (100 * repeated > 30 * n_words)
            bad = (covered > COVERED * n_words) | (longest > LONGEST_WORDS)
            cols = [n_words, chars, symbols, lines, repeated, covered, longest, failed, ~(failed | bad)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *map(pa.array, cols)], NAMES)


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "base_failed", "kept"]


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) to counts, base_failed and kept, one row per row of docs.

    covered_words are those in maximal repeats of LEAST words or more, longest_repeat the longest one's words (0 below
    LEAST). Null texts count as empty: no words, so they fail. Repeated rows give repeated results; an empty table gives
    no rows; other columns are ignored, so their names can't clash. Memory is a few dozen bytes a byte of the longest
    text, which one task must hold.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(plain, _judge, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, covered_words bigint, longest_repeat bigint, base_failed boolean, kept boolean")

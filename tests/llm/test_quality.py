import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tideweave.llm.quality import common_prefixes, intervals, quality_rules, suffix_array, suffix_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def longest(w):
    best, n = 0, len(w)
    last = [0] * (n + 1)
    for i in range(n):
        now = [0] * (n + 1)
        for j in range(i):
            if w[i] == w[j]:
                now[j + 1] = last[j] + 1
                best = max(best, now[j + 1])
        last = now
    return best


def covered(w, k):
    seen, out = {}, set()
    for i in range(len(w) - k + 1):
        seen.setdefault(tuple(w[i : i + k]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            out.update(p for i in at for p in range(i, i + k))
    return len(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 8))
def test_suffix_repeats(w, k):
    most = longest(w)
    assert suffix_repeats(np.array(w, np.uint64), (k, 8)) == ([covered(w, k), covered(w, 8)], most if most >= k else 0)


def occurrences(w, p):
    return [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=25), st.integers(1, 4))
def test_intervals_are_the_maximal_repeats(w, k):
    """Spans of all substrings that occur twice and can't be longer on either side."""
    want = set()
    for size in range(k, len(w)):
        for i in range(len(w) - size + 1):
            at = occurrences(w, w[i : i + size])
            ends = lambda d: {w[p + d] if 0 <= p + d < len(w) else ("edge", p) for p in at}  # noqa: E731, B023
            if len(at) > 1 and len(ends(-1)) > 1 and len(ends(size)) > 1:
                want.update((p, p + size) for p in at)
    got = set()
    if len(w) > 1:
        order, levels = suffix_array(np.array(w, np.uint64))
        length, maximal = intervals(common_prefixes(order, levels), np.where(order > 0, levels[0][order - 1], -1 - order), k)
        got = {(int(p), int(p + n)) for p, n, m in zip(order, length, maximal) if m}
    assert got <= want
    cover = lambda spans: {x for a, b in spans for x in range(a, b)}
    assert cover(got) == cover(want)
    # every maximal repeat is an interval, or shares its occurrences with intervals inside it
    longest_at = {}
    for a, b in want:
        longest_at[a] = max(b, longest_at.get(a, 0))
    assert all(longest_at[a] == b for a, b in got)


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    rep = covered(w, 8)
    failed = len(w) < 20 or 100 * rep > 30 * len(w)
    most = longest(w) if len(w) < 1500 else len(w) - 1 if len(set(w)) == 1 else None
    bad = covered(w, 5) > 0.2 * len(w) or (most or 0) > 50
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, rep, failed, not failed and not bad if most is not None else None


def test_documents(spark, documents):
    r = random.Random(4)
    rows = [(d.doc_id, d.text) for d in documents.collect()] + [(1, None), (1, ""), (None, "a\n\n \na\nA"), (2, "x " * 3000), (3, " ".join(r.choice("ab") for _ in range(900)))]
    rows += [(10 + i, "\x1cé ".join(str(r.randrange(400)) for _ in range(300)) + "\n" + "one two three four five six seven eight nine " * (i % 4)) for i in range(40)]
    df = spark.createDataFrame([(*x, True) for x in rows], "doc_id bigint, text string, kept boolean")
    rows_, got = [(d, *brute(t)) for d, t in rows], [tuple(x) for x in quality_rules(df).collect()]
    assert sorted((tuple((x[0], *x[1:6], x[8])) for x in got), key=str) == sorted((x[:7] for x in rows_), key=str)
    # `kept` by brute force too, but for a few texts too long to compare every word with every other
    by = {x[:7]: x[7] for x in rows_ if x[7] is not None}
    told = [(x[9], by[x[0], *x[1:6], x[8]]) for x in got if (x[0], *x[1:6], x[8]) in by]
    assert len(told) > 0.9 * len(rows) and all(a == b for a, b in told) and len({a for a, _ in told}) == 2
    assert all(not (x[9] and x[8]) for x in got)
    assert quality_rules(df.limit(0)).count() == 0


def test_method_rejects_what_the_base_passes(spark):
    fresh = iter(f"w{i}" for i in range(100_000))
    some = lambda n: [next(fresh) for _ in range(n)]
    passage = some(1400)
    short = [some(10) for _ in range(6)]
    texts = [
        passage + some(3600) + passage + some(3600),  # long repeat, 28 % covered
        passage[:51] + some(5000) + passage[:51],  # long repeat, 2 % covered
        [w for s in short for w in s + some(36)] + [w for s in short for w in s + some(36)],  # 10-word repeats, 22 % covered
        passage[:50] + some(5000) + passage[:50],
        [w for s in short for w in s + some(45)] + [w for s in short for w in s + some(45)],  # 10-word repeats, 18 % covered
        [w for s in short for w in s[:6] + some(18)] + [w for s in short for w in s[:6] + some(18)],  # 6-word repeats, 25 % covered
    ]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = sorted(quality_rules(df).collect())
    assert not any(r.base_failed for r in got)
    assert [r.longest_repeat for r in got] == [1400, 51, 10, 50, 10, 6]
    assert [r.kept for r in got] == [False, False, False, True, True, False]

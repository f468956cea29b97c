import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np

from tideweave.llm import hmm as H

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tiny(k=3, seed=1):
    r = np.random.default_rng(seed)
    emit = np.full((H.SYMBOLS, k), 1e-9)
    emit[[0, 1, 2, H.END]] = r.dirichlet(np.ones(4), k).T
    return H.Model(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), emit)


def paths(m, s):
    for z in product(range(len(m.start)), repeat=len(s)):
        p = m.start[z[0]] * m.emit[s[0], z[0]]
        for i in range(1, len(s)):
            p *= m.move[z[i - 1], z[i]] * m.emit[s[i], z[i]]
        yield z, p


SEQS = [[0, 1, 2, 2, H.END], [H.END], [1, 1, H.END], [2, 0, 0, 1, 1, H.END]]


def test_forward_is_exact():
    m = tiny()
    got = H.log_likelihood(m, np.concatenate(SEQS), np.array([len(s) for s in SEQS]))
    assert np.allclose(got, [math.log10(sum(p for _, p in paths(m, s))) for s in SEQS])


def test_expected_counts_are_exact():
    m = tiny()
    start, moves, emitted = H.expected(m, np.concatenate(SEQS), np.array([len(s) for s in SEQS]))
    a, b, c = np.zeros(3), np.zeros((3, 3)), np.zeros((H.SYMBOLS, 3))
    for s in SEQS:
        all_ = list(paths(m, s))
        total = sum(p for _, p in all_)
        for z, p in all_:
            a[z[0]] += p / total
            for i, x in enumerate(s):
                c[x, z[i]] += p / total
                if i:
                    b[z[i - 1], z[i]] += p / total
    assert np.allclose(start, a) and np.allclose(moves, b) and np.allclose(emitted, c)


def test_segmented():
    first, last, lead, tail = H.segmented(np.array([1, 512, 513, 1025]))
    assert (last - first - lead - tail).tolist() == [1, 512, 512, 1, 512, 512, 1]
    assert lead.tolist() == [0, 0, 0, 32, 0, 32, 32] and tail.tolist() == [0, 0, 1, 0, 32, 1, 0]
    assert (first + lead).tolist() == [0, 1, 513, 1025, 1026, 1538, 2050]


def test_segments_count_as_whole_texts(monkeypatch):
    """With context over all of a text, segments give what the text gives; transitions between them aren't lost."""
    m, r = tiny(), random.Random(5)
    texts = [[r.randrange(3) for _ in range(n)] + [H.END] for n in (1, 3, 10, 25)]
    size = np.array([len(t) for t in texts])
    whole = H.both_ways(m, np.concatenate(texts), size)
    monkeypatch.setattr(H, "SEGMENT", 4)
    monkeypatch.setattr(H, "CONTEXT", 100)
    first, last, lead, tail = H.segmented(size)
    symbols = np.concatenate([np.concatenate(texts)[a:b] for a, b in zip(first, last)])
    parts = H.both_ways(m, symbols, last - first, lead, tail)
    assert all(np.allclose(a, b) for a, b in zip(whole, parts))
    assert math.isclose(parts[1].sum(), (size - 1).sum()) and math.isclose(parts[0].sum(), len(texts))


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def base(rows):
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    c = Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            c.update([*WORD.findall(fold(t)), None])
    n, v = sum(c.values()), len(c)
    for (d, t), h in zip(rows, held):
        w = [*WORD.findall(fold(t)), None]
        yield d, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)


def same(got, rows):
    got = sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score))
    want = sorted(base(rows), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    assert np.allclose([r.base_score for r in got], [w[5] for w in want])


def test_documents(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = H.score_documents(docs).collect()
    same(got, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in got if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    print("gain in log10 a token", gain, sum(r.base_score for r in held) / sum(r.n_tokens for r in held))
    assert gain > 0.1


def test_edges(spark):
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "A a é", "a A é É", "b " * 30_000] * 4)] + [(None, "x y"), (None, "x y")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, score int")
    got = H.score_documents(df).collect()
    same(got, rows)
    assert all(r.score < 0 for r in got)
    assert H.score_documents(df.limit(0)).count() == 0
    held = df.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")
    assert H.score_documents(held).filter("n_known > 0").count() == 0


def test_only_long_texts(spark):
    r = random.Random(3)
    docs = []
    for i in range(60):
        topic, words_ = r.randrange(4), []
        for j in range(900):
            topic = r.randrange(4) if j % 100 == 0 else topic
            words_.append(f"w{topic}x{r.randrange(40)}")
        docs.append((i, " ".join(words_)))
    assert all(len(t) >= 2000 for _, t in docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    held = lambda n: [sum(c) for c in zip(*((x.score, x.n_tokens) for x in H.score_documents(df, n).collect() if x.held_out))]
    (many, tokens), (one, _) = held(H.STATES), held(1)
    assert (many - one) / tokens > 0.1


def model_of(df):
    """Counts and model as score_documents makes them."""
    plain = df.filter(H.TRAINED)
    counts = H.Counts.of(H.word_counts(plain.select("text")), plain.count())
    shared = df.sparkSession.sparkContext.broadcast(counts)
    return counts, H.train(H.segments(plain, shared), shared)


def test_score_is_the_model_of_whole_texts(spark):
    """Against a plain forward recursion and counts by hand: symbols, rare words by their share of a class, unseen ones."""
    r = random.Random(9)
    rows = [(i, " ".join((f"w{r.randrange(60)}" if r.random() < 0.5 else f"{r.choice('abc')}{r.randrange(90_000)}{r.choice('xyz')}") for _ in range(r.randrange(60)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: x for x in H.score_documents(df).collect()}
    counts, m = model_of(df)
    assert np.allclose(m.move.sum(axis=1), 1) and np.allclose(m.emit.sum(axis=0), 1)
    number = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1 for w in t.split())
    import pyarrow as pa

    hashed, cls, text = {}, {}, list(number) + sorted({w for _, t in rows for w in t.split()} - set(number))
    for lo, _, t in H.read(pa.array(text)):
        for i, (h, c) in enumerate(zip(t.hash.tolist(), t.cls.tolist())):
            hashed[text[lo + i]], cls[text[lo + i]] = h, c
    top = {h: int(s) for h, s in zip(counts.words.tolist(), counts.symbol) if s >= 0}
    assert len(top) == H.TOP < len(number)
    rest = [w for w in number if hashed[w] not in top]
    tokens, types = Counter(), Counter()
    for w in rest:
        tokens[cls[w]] += number[w]
        types[cls[w]] += 1
    seen = Counter()
    for d, t in rows[:400]:
        alpha, total = m.start, 0.0
        for i, w in enumerate([*t.split(), None]):
            s = H.END if w is None else top.get(hashed[w], H.TOP + cls[w])
            alpha = (alpha if i == 0 else alpha @ m.move) * m.emit[s]
            total += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
            if w is not None and hashed[w] not in top:
                c = cls[w]
                seen["rare" if number[w] else "unseen"] += 1
                total += math.log10((number[w] - H.DISCOUNT if number[w] else H.DISCOUNT * types[c]) / tokens[c]) if tokens[c] else 0.0
        assert math.isclose(total, got[d].score, rel_tol=1e-6), d
    assert min(seen["rare"], seen["unseen"]) > 100


def test_partitions_do_not_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plain = df.filter(H.TRAINED)
    counts = H.Counts.of(H.word_counts(plain.select("text")), plain.count())
    shared = spark.sparkContext.broadcast(counts)
    one, many = (H.baum_welch(H.segments(plain.repartition(n), shared), shared, H.first_model(H.segments(plain.repartition(n), shared), shared)) for n in (1, 8))
    assert math.isclose(one[1], many[1]) and np.allclose(one[0].emit, many[0].emit) and np.allclose(one[0].move, many[0].move)
    assert not np.allclose(one[0].emit[:, 0], one[0].emit[:, 1])


def test_ties_are_cut_by_hash(spark):
    words = spark.range(200_000).selectExpr("xxhash64(id) as word", "cast(id % 1024 as int) as cls", "cast(1 as bigint) as n")
    some = spark.range(10_000).selectExpr("xxhash64(id, 1) as word", "cast(id % 1024 as int) as cls", "cast(5 + id as bigint) as n")
    tied, mixed = H.Counts.of(words, 1), H.Counts.of(words.unionByName(some), 1)
    for c in (tied, mixed):
        assert len(c.words) == H.KNOWN and (c.symbol >= 0).sum() == H.TOP
    kept = sorted(r.word for r in words.collect())
    assert tied.words.tolist() == kept[: H.KNOWN]
    assert mixed.number.sum() == H.KNOWN - 10_000 + sum(range(5, 10_005))

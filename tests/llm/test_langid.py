import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tideweave.llm import langid as L


def test_features_stay_in_rows():
    a = pa.array(["abc d", "", None, "ab", "abcd"])
    off, data = L.pieces(a).__next__()[2:]
    f = L.features(off, data)
    one = [L.features(np.array([0, len(t)]), np.frombuffer(t, np.uint8)).tolist() for t in (b"abc d", b"ab", b"abcd")]
    assert f.tolist() == sum(one, []) and f[3] == f[4] == L.BUCKETS


def test_codebook():
    for n in (2, 3, 4, 6, 7, 40):
        c = L.codebook(n)
        assert len(np.unique(c, axis=0)) == n and (np.abs(c.sum(axis=0)) < n).all()


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in held) and sum(r.held_out for r in got.values()) == len(held)
    right = [got[r.doc_id].lang_pred == r.lang for r in held]
    print(np.mean(right), [(r.lang, got[r.doc_id].lang_pred, got[r.doc_id].score, r.text[:60]) for r in held if got[r.doc_id].lang_pred != r.lang])
    print("flagged", [(r.lang, got[r.doc_id].score, r.text[:60]) for r in rows if got[r.doc_id].ambiguous])
    assert np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    swapped = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 5 = 0 then 'xx' else lang end as lang", "'s' as source")
    assert sorted(L.identify(swapped).collect()) == sorted(got.values())
    kept = L.with_language(docs)
    assert kept.columns == docs.columns and kept.count() > 0.99 * len(rows)


def test_edges(spark):
    rows = [(1, None, "en", 1.0), (2, "", "en", 1.0), (3, "123 --", None, 1.0), (None, "plain words here", "en", 1.0), (4, "mots simples ici", "fr", 1.0), (4, "mots simples ici", "fr", 1.0), (5, "a", None, 1.0), (6, "wörter " * 40_000, "de", 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    got = sorted((tuple(r) for r in L.identify(df).collect()), key=str)
    assert [r[2] for r in got if r[0] in (1, 2, 3)] == ["und"] * 3 and len(got) == len(rows)
    assert L.identify(df.limit(0)).count() == 0 and L.identify(df.filter("lang is null")).filter("lang_pred <> 'und'").count() == 0
    assert L.with_language(df).filter("doc_id in (1, 2, 3)").count() == 0


def brute(rows):
    """(lang_pred, score) by counts in dictionaries and loops over bits and languages."""
    def grams(t):
        x = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in (t or "").encode())
        for i in range(len(x) - 2):
            h = (x[i] * 0x9E3779B1 + x[i + 1] * 0x85EBCA77 + x[i + 2] * 0xC2B2AE3D) & 0xFFFFFFFF
            h ^= h >> 15
            yield ((h * 0x2C1B3C6D) & 0xFFFFFFFF) >> 17

    learned = [(t, g) for d, t, g in rows if t is not None and g is not None and zlib.crc32(("" if d is None else str(d)).encode()) % 5]
    names = sorted({g for _, g in learned})
    count = {g: Counter() for g in names}
    for t, g in learned:
        count[g].update(grams(t))
    total = {g: sum(count[g].values()) + 0.5 * L.BUCKETS for g in names}
    share = lambda g, b: (count[g][b] + 0.5) / total[g]
    code = dict(zip(names, L.codebook(len(names)).tolist()))
    bits = range(len(code[names[0]]))
    mean = lambda x: sum(x) / len(x)
    ratio = {}

    def margin(t, j):
        out, n = 0.0, 0
        for b in grams(t):
            if (b, j) not in ratio:
                ratio[b, j] = math.log(mean([share(g, b) for g in names if code[g][j] > 0])) - math.log(mean([share(g, b) for g in names if code[g][j] < 0]))
            out, n = out + ratio[b, j], n + 1
        return out / max(n, 1)

    right = {g: [1] * len(bits) for g in names}
    number = Counter(g for _, g in learned)
    for t, g in learned:
        for j in bits:
            right[g][j] += margin(t, j) * code[g][j] > 0
    for _, t, _ in rows:
        if t is None or not re.search(r"[^\W\d_]", t):
            yield "und", 0.0
            continue
        m = [margin(t, j) for j in bits]
        loss = {g: round(sum(right[g][j] * math.log1p(math.exp(-m[j] * code[g][j])) for j in bits) / sum(right[g]), 9) for g in names}
        best = min(loss, key=loss.get)
        yield best, 1 / sum(math.exp(-L.SHARPNESS * (x - loss[best])) for x in loss.values())


def test_against_brute_force(spark, documents):
    rows = [(r.doc_id, r.text and r.text[:400], r.lang) for r in documents.collect()] + [(3, None, "en"), (None, "and the", "en"), (7, "12", None), (8, "ab", "fr")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = sorted((str(r.doc_id), r.lang_pred, round(r.score, 4)) for r in L.identify(df).collect())
    assert got == sorted((str(d), p, round(s, 4)) for (d, _, _), (p, s) in zip(rows, brute(rows)))


def test_three_hundred_languages(spark):
    r = random.Random(8)
    words = [["".join(r.choice("abcdefghijklmnopqrstuvwxyzäöüéàñ") for _ in range(6)) for _ in range(12)] for _ in range(300)]
    rows = [(i, " ".join(r.choice(words[i % 300]) for _ in range(30)), f"l{i % 300:03d}") for i in range(3000)]
    got = L.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).filter("held_out").collect()
    assert len({x.lang_pred for x in got}) > 250
    assert sum(x.lang_pred == rows[x.doc_id][2] for x in got) > 0.98 * len(got)

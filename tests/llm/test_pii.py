import hashlib
import re
import time

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tideweave.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    t = 0
    for i, c in enumerate(d[::-1]):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def brute(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab.@-+0123456789 ()%é\n")), max_size=60))
@example("a@b.c.@d.e x@y..z @q.r a@@b.c")
@example("1.2.3.4.5.6.7.8 1.2.3.256 00001.2.3.4")
@example("4111 1111 1111 1111 4111-1111-1111-1111+1 (234) 567-8901")
def test_base_spans(t):
    assert [(a, k, b) for a, b, k, base, _ in pii.spans_of(t) if base] == brute(t)


def test_em_learns_reliability():
    r = np.random.default_rng(1)
    truth = r.random(20_000) < 0.4
    say = lambda good: np.where(r.random(len(truth)) < good, np.where(truth, 1, -1), np.where(truth, -1, 1))
    rows = np.stack([np.zeros(len(truth), int), say(0.95), say(0.8), say(0.5), say(0.7)], axis=1)
    p, n = np.unique(np.concatenate([rows, np.zeros((len(rows), 4), int)], axis=1), axis=0, return_counts=True)
    m = pii.fit(p, n)
    spread = m.reliability[:, 2] - m.reliability[:, 0]
    assert spread[0] > spread[1] > spread[3] > abs(spread[2])
    right = np.array([m.accepts(x[0], (*x[1:], 0, 0, 0, 0)) for x in rows[:3000]]) == truth[:3000]
    assert right.mean() > 0.93


def test_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(1, None), (1, ""), (None, "mail joe.doe (at) mail.example.com or call 555-123-4567."), (2, "é" * 5 + "a@b.co" + "9" * 200_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n_ip int")
    got = sorted((tuple(r)[:6] for r in pii.find_personal_data(df).collect()), key=str)
    want = []
    for d, t in rows:
        b = brute(t or "")[:] if len(t or "") < 150_000 else [(5, 0, 11 + 200_000)]
        s = ",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in b)
        want.append((d, *(sum(k == i for _, k, _ in b) for i in range(4)), hashlib.sha256(s.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert pii.find_personal_data(df.limit(0)).count() == 0
    clean = pii.without_personal_data(documents)
    assert clean.columns == documents.columns
    out = {r.doc_id: r for r in clean.collect()}
    assert len(out) == documents.count() and all(r.n_chars == len(r.text) for r in out.values())
    assert not any(brute(r.text) for r in out.values())
    for d, t in rows[:-4]:
        if not pii.spans_of(t):
            assert out[d].text == t


def test_candidates(spark):
    m = pii.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    extra = [(r.doc_id, r.text[a - 20 : b + 5]) for r in docs for a, b, k, base in pii.decided(r.text, m) if not base]
    print(extra[:10], len(extra), m.weight)
    assert len(extra) <= 0.01 * len(docs)
    assert pii.decided("order 4111 1111 1111 1112 x", m) == []
    assert [k for *_, k, _ in pii.decided("mail joe.doe (at) mail.example.com", m)] == [0]


def test_many_spans_take_linear_time():
    t = " ".join(f"a{i}@b{i}.com 1.2.3.{300 + i} joe{i} (at) x{i}.org" for i in range(7000))
    began = time.perf_counter()
    got = pii.spans_of(t)
    assert len(got) == 21_000 and time.perf_counter() - began < 3


def overlaps(t):
    """spans_of by comparing each candidate with all spans before it."""
    base, rest = [], []
    for kind, a, b, valid in pii.shaped(t):
        (base if valid else rest).append((a, b, pii.KINDS.index(kind), 1))
    rest += [(a, b, pii.KINDS.index(kind), 0) for kind, a, b in pii.loose(t)]
    held = list(base)
    for s in sorted(rest, key=lambda s: (s[0], -s[1], s[3], s[2])):
        if not any(s[0] < b and a < s[1] for a, b, *_ in held):
            held.append(s)
    return sorted((a, k, b) for a, b, k, _ in held)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a@b.co", "555-123-4567", " ", "1.2.3.400", "joe (at) x.org", "+1 555 123 4567", "4111 1111 1111 1111", "4111 1111 1111 1112", "01 42 68 53 00", "030/1234567", "612 34 56 78", "1[.]2[.]3[.]4", "4111.1111.1111.1111", "-", "x", "(at)"]), max_size=12))
def test_overlaps(parts):
    t = "".join(parts)
    assert [(a, k, b) for a, b, k, *_ in pii.spans_of(t)] == overlaps(t)


def test_classifier_sees_context(spark):
    """The word before a span gets its weight from cases that the labelers decide."""
    rows = []
    for i in range(400):
        n = f"{200 + i % 700}-{300 + i % 600}-{1000 + i}"
        rows.append((i, f"telefon zentrale {n} x" if i % 2 else f"a lot /{n}/ x"))
    m = pii.learn(spark.createDataFrame(rows, "doc_id bigint, text string"))
    weight = lambda w: m.weight[-pii.WORDS :][pii.traits(f"{w} 5", len(w) + 1, len(w) + 2)[3]]
    assert weight("zentrale") > weight("lot")


def test_spans_against_plain_models(spark, documents):
    """spans of the query: base and candidate spans by brute force, decided by EM and a classifier written out again."""
    extra = [(10_000 + i, f"call 555-{200 + i}-{1000 + i} now or joe{i} (at) mail{i}.org; order 1.2.3.{300 + i}") for i in range(60)]
    rows = [(r.doc_id, r.text) for r in documents.collect()] + extra
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    seen = [(d, s) for d, t in rows for s in pii.spans_of(t)]
    x = np.array([[k, *v] for _, (_, _, k, _, v) in seen])
    post, _ = pii.posteriors(x[:, 0], x[:, 1:5], np.ones(len(x)))
    f = pii._features(x)
    w, first = pii._first_weight(), pii._first_weight()
    share = min(len(x), 1000.0) / len(x)
    for _ in range(4000):  # plain gradient descent
        w -= 0.004 * (f.T @ (share * (1 / (1 + np.exp(-f @ w)) - post)) + w - first)
    sure = {d: [] for d, _ in rows}
    close = 0
    for (d, (a, b, k, base, _)), y in zip(seen, f @ w):
        close += not base and abs(y) < 0.02
        if base or y > 0:
            sure[d].append(f"{pii.KINDS[k]}:{a}:{b}")
    assert not close
    assert {d: ",".join(s) for d, s in sure.items()} == got
    assert sum(s.count(",") + (s != "") for s in got.values()) > sum(len(brute(t)) for _, t in rows)


def test_masked_columns(spark):
    df = spark.createDataFrame([(1, "a@b.co", None, 3), (2, None, 5, 4), (2, "", 0, 4), (2, "", 0, 4), (None, "x +1 234 567 8901", 1, None)], "doc_id bigint, text string, n_chars int, model int")
    got = pii.without_personal_data(df)
    assert got.schema == df.schema
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "<email>", None, 3), (2, None, 0, 4), (2, "", 0, 4), (2, "", 0, 4), (None, "x <phone>", 9, None)], key=str)
    assert pii.without_personal_data(df.limit(0)).count() == 0


def test_shapes_of_four_languages():
    """What is a candidate, and how the gazetteer votes on it."""
    wanted = {
        "01 42 68 53 00": 1, "06-12-34-56-78": 1, "612 34 56 78": 1, "91 123 45 67": 1, "612 345 678": 0, "912.345.678": 0,
        "030/1234567": 1, "(089) 123456": 1, "0171 2345678": 1, "0221-123456-78": 1, "030 123 45 67": 1, "0123 456789": -1,
        "(212) 555-0147": 1, "212-555-0147": 1, "212 655 0147": 1, "111-655-0147": -1,
    }
    for number, vote in wanted.items():
        got = [(a, b, k, v[:2]) for a, b, k, _, v in pii.spans_of(f"bei {number}.")]
        assert got == [(4, 4 + len(number), 3, (0, vote))], number
    for other in ("01 02 03 04 05 06", "0900 1700", "0900-1730", "12,345 678 901", "2024-01-15", "512 345 678", "612 345 678 901", "0.171 2345678", "x0171 2345678", "0171 2345678/9", "999.888.777.666"):
        assert not [k for _, _, k, *_ in pii.spans_of(other) if k == 3], other
    assert [(k, v[:2]) for _, _, k, _, v in pii.spans_of("host 10[.]20[.]30[.]40, 8 [dot] 8 [dot] 8 [dot] 8 and 300[.]1[.]1[.]1 1[.]2[.]3[.]4[.]5")] == [(1, (0, 1))] * 2
    assert [(k, v[:2]) for _, _, k, _, v in pii.spans_of("4111.1111.1111.1111 or 4111/1111/1111/1112")] == [(2, (0, 1))]


def test_plain_numbers_need_context():
    """Before anything is learned, groups of three are a phone number only beside a word for it."""
    m = pii.fit(np.zeros((0, 9), int), np.zeros(0))
    assert not pii.decided("es sind 612 345 678 Stueck", m)
    assert [k for *_, k, _ in pii.decided("telefono 612 345 678", m)] == [3]
    assert [k for *_, k, _ in pii.decided("Tel. 030/1234567, 01 42 68 53 00", m)] == [3, 3]


def test_long_runs_take_linear_time():
    for part in ("01 42 ", "612 345 ", "0171 2345678/", "1[.]", "1 [dot] ", "4111.", "(089) ", "030 12 "):
        began = time.perf_counter()
        pii.spans_of(part * (600_000 // len(part)))
        assert time.perf_counter() - began < 5, part

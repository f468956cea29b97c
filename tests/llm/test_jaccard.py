import random
import re
import time
from itertools import combinations

from pyspark.sql import functions as F

from tideweave.llm import jaccard
from tideweave.llm.jaccard import one_of_each_group, similar_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = WORD.findall(fold(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        n = len(sets[i] & sets[j])
        if n and 100 * n >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted((tuple(r) for r in similar_groups(df, **more).collect()), key=str)


def test_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    r = random.Random(1)
    base = [r.choice("abcdefgh") + str(r.randrange(50)) for _ in range(300)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "É x"), (8, "é x"), (9, "a b c d e"), (10, "A b c d E"), (None, "one two"), (11, "x " * 70000), (12, "x x x x x x"), (4, "One two"), (4, "quite different text with more words")]
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(0, 14)):
            w[r.randrange(len(w))] = "z" + str(r.randrange(1000))
        rows.append((100 + i, " ".join(w[r.randrange(0, 20) :])))
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, cells=64) == brute(rows)
    assert run(spark, rows, cells=1 << 12, marked=-5) == brute(rows)


def test_large_group_of_marked_shingles(spark, monkeypatch):
    """Tiles of frequent shingles, in parts: near copies of one text, and others that share a passage of it."""
    monkeypatch.setattr("tideweave.llm.jaccard.PART", 16)
    r = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = f"z{r.randrange(10_000)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, " ".join(base[:60] + [f"q{i}x{j}" for j in range(40)])) for i in range(60)]
    got = run(spark, rows, cells=1 << 12, marked=10)
    assert got == brute(rows) == run(spark, rows)


def test_one_of_each_group(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(None, t, 1, "x"), (None, t, 2, "x"), (None, t + " ", 3, "x"), (5, "quite " + t, 4, None), (5, "some other text that is long enough to have shingles", 5, "y"), (5, "some other text that is long enough to have shingles", 5, "y"), (None, "all alone with a null id of its own here", 6, "x"), (7, None, 7, "x"), (7, None, 7, "x"), (None, " ", 8, "x"), (9, "short", 9, "x"), (8, "short", 10, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, root int, print string")
    got = one_of_each_group(df)
    assert got.schema == df.schema
    got = [tuple(x) for x in got.collect()]
    assert set(got) <= set(rows)
    groups = [x for x in got if x[1] and x[1].strip()]
    assert len(groups) == 4 and {x[0] for x in groups} == {None, 5, 8}
    assert [x[0] for x in groups if "eight nine ten" in x[1]] == [5]  # near copies, by null ids and one that is none
    assert len(got) - len(groups) == 3
    assert one_of_each_group(df.limit(0)).count() == 0


def test_empty(spark):
    assert run(spark, []) == []


def test_templates(spark):
    """Texts of one template with a word of their own are no links; eight times as many don't take their square."""
    rows = lambda n: spark.createDataFrame([(i, f"please click here to read more about the w{i}") for i in range(n)], "doc_id bigint, text string").repartition(8)
    took = {}
    for n in (10_000, 80_000):
        began = time.perf_counter()
        got = jaccard.similar_groups(rows(n)).agg(F.count("*"), F.sum((F.col("component_id") == F.col("doc_id")).cast("int"))).first()
        took[n] = time.perf_counter() - began
        assert tuple(got) == (n, n)
    assert took[80_000] < 4 * took[10_000] + 10, took


def test_components_beside_each_other(spark):
    """Templates with shared openings, copies and near copies, against all pairs."""
    r = random.Random(4)
    base = [f"b{i}" for i in range(40)]
    texts = []
    for i in range(150):
        own = [f"o{i % 12}x{j}" for j in range(r.choice([0, 1, 2, 6, 9]))]
        cut_at = r.choice([0, 20, 39])
        texts.append(" ".join(base[:cut_at] + own + base[cut_at:] if i % 3 else base[: r.choice([6, 10, 40])] + [f"w{i % 5}"]))
    sets = [{tuple(x.split()[k : k + 5]) for k in range(max(1, len(x.split()) - 4))} for x in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for marked in (1, 30):
        got = {r.doc_id: r.component_id for r in jaccard.similar_groups(df, marked=marked).collect()}
        assert got == {i: find(i) for i in range(len(texts))}

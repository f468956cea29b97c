from collections import Counter, defaultdict

import corpus_pipeline as P
from tideweave.llm import pii
from tideweave.llm.shared import cut

from .test_jaccard import WORD, brute as groups
from .test_mixing import shares
from .test_pii import brute as personal
from .test_spm import digest

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(90_001, None, "en", "src0", None), (90_002, "123 456", "en", "src1", 7), (90_003, "", "en", None, 0)], docs.schema)
    rows = [docs.unionByName(junk)]
    for _, stage in P.STAGES:
        rows.append(cut(stage(spark, rows[-1], SF)))
    assert all(x.columns == docs.columns for x in rows[:-1])
    start, lang, near, clean, mix = ([tuple(r) for r in x.collect()] for x in rows[:-1])
    assert {r[0] for r in start} - {r[0] for r in lang} >= {90_001, 90_002, 90_003} and set(lang) <= set(start) and len(lang) >= 0.99 * docs.count()
    assert sorted(r[0] for r in near) == sorted(d for d, _, c in groups([r[:2] for r in lang]) if d == c) and set(near) <= set(lang)
    text = {r[0]: r[1] for r in near}
    assert sorted(r[0] for r in clean) == sorted(text)
    assert all(r[1] == text[r[0]] or pii.spans_of(text[r[0]]) for r in clean) and not any(personal(r[1]) for r in clean)
    times, size, of = Counter(r[0] for r in mix), {r[0]: len(WORD.findall(r[1])) for r in clean}, {r[0]: r[3] for r in clean}
    held, got = defaultdict(int), defaultdict(int)
    for d, n in size.items():
        held[of[d]] += n
        got[of[d]] += n * times[d]
    assert max(times.values()) <= 3 and set(mix) <= set(clean)
    for s, goal in shares(held).items():
        assert abs(got[s] - goal) <= max(n for d, n in size.items() if of[d] == s) / 2 + 1
    last = rows[-1].collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last) == sorted((r[0], *digest(r[1])) for r in mix)
    assert all(len(r.ids) == r.n_tokens for r in last)


def test_run(spark):
    assert P.run(spark, SF).select("doc_id", "ids").count() > 100

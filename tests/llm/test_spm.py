import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tideweave.llm.spm import Pieces, encode_documents

MODEL = P.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
OWN = Pieces(MODEL)


def digest(t):
    ids = SP.encode(t or "", add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(SP.decode(ids).encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeinorst ATé\n\t.,<>0129▁ 界\U0001f600\x00s")), max_size=60))
def test_any_text(t):
    ids, back = OWN.encode([t])[0]
    want = SP.encode(t, add_bos=True, add_eos=True)
    assert struct.unpack(f"<{len(ids) // 4}I", ids) == tuple(want)
    assert back == SP.decode(want)


def test_documents(spark, documents):
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    r = random.Random(3)
    texts += [(1, None), (1, None), (2, ""), (3, "  two  spaces \n x"), (None, "<s> </s> <0x0A>"), (4, "a" * 30000), (5, "".join(r.choice("ab é\n") for _ in range(50000)))]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in texts], "doc_id bigint, text string, ids string, n_tokens int")
    got = sorted((tuple(x) for x in encode_documents(df, MODEL).collect()), key=str)
    assert got == sorted(((a, *digest(b)) for a, b in texts), key=str)
    kept = encode_documents(df, MODEL, keep=("ids", "decoded")).filter("n_tokens = 2").first()
    assert kept.ids == [1, 2] and kept.decoded == ""


def test_empty(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id bigint, text string"), MODEL).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcdeinorst▁é\n界")), min_size=1, max_size=200), max_size=5))
def test_arrays_and_heap_merge_alike(chunks):
    ids, first = OWN.encode_chunks(chunks)
    for c, a, b in zip(chunks, first, first[1:]):
        want = []
        for s in OWN.agenda(c):
            want += [OWN.id[s]] if s in OWN.id else [int(OWN.byte[x]) for x in s.encode()]
        assert ids[a:b].tolist() == want


def test_difference_from_the_library_fails(monkeypatch):
    other = Pieces(MODEL)
    monkeypatch.setattr(other, "rank", other.rank[::-1].copy())
    with pytest.raises(RuntimeError, match="differ from the library"):
        other.encode(["internationalisation of the other words"])


def test_words_are_forgotten(monkeypatch):
    own = Pieces(MODEL)
    monkeypatch.setattr("tideweave.llm.spm.CACHE_BYTES", 1000)
    for i in range(20):
        t = " ".join(f"w{i}x{j}" for j in range(10))
        assert struct.unpack(f"<{len(own.encode([t])[0][0]) // 4}I", own.encode([t])[0][0]) == tuple(SP.encode(t, add_bos=True, add_eos=True))
        assert len(own.word) <= 20

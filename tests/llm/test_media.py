import hashlib
import io
import zlib

import numpy as np
import pytest

from tideweave.llm import media as M


def test_round_trips():
    r = np.random.default_rng(1)
    for h, w in ((1, 1), (3, 5), (64, 64), (7, 130)):
        x = r.integers(0, 256, (h, w), dtype=np.uint8)
        assert (M.decode(M.encode_pgm(x)) == x).all()
        assert (M.decode(M.encode_bmp(x)) == x).all()


def test_kinds():
    assert M.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert M.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert M.decode(b"P2 2 1 255 7 8").tolist() == [[7, 8]]
    assert M.decode(b"P3 1 1 255 7 8 9").tolist() == [[[7, 8, 9]]]
    assert M.decode(b"P6 1 1 255\n" + bytes([1, 2, 3])).tolist() == [[[1, 2, 3]]]
    assert M.decode(b"P5 1 1 65535\n" + bytes([1, 2])).tolist() == [[258]]
    with pytest.raises(ValueError):
        M.decode(b"GIF89a")


def test_area_resize_is_the_mean():
    r = np.random.default_rng(2)
    x = r.integers(0, 256, (12, 20)).astype(np.uint8)
    assert np.allclose(M.area_resize(x, 3, 5), x.reshape(3, 4, 5, 4).mean(axis=(1, 3)))
    big = np.kron(x, np.ones((7, 9)))
    assert np.allclose(M.area_resize(x, 7, 9), M.area_resize(big, 7, 9))


def test_text_media(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(1, None), (1, ""), (None, "x" * 64), (2, "é" * 100_000)]
    df = spark.createDataFrame([(*r, "y") for r in rows], "doc_id bigint, text string, media string")
    got = sorted((tuple(r) for r in M.text_media(df).collect()), key=str)
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        p = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        s = b"P5\n64 %d\n255\n" % (len(p) // 64) + p
        x = np.frombuffer(p, np.uint8).reshape(-1, 64)
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(s), hashlib.sha256(s).hexdigest(), M.difference_hash(x), hashlib.sha256(M.npy_tile(x, 32)).hexdigest()))
    assert got == sorted(want, key=str)
    kept = M.text_media(df.filter("doc_id is null"), keep=True).first()
    assert np.load(io.BytesIO(kept.tile)).shape == (32, 32)
    back = M.tiles_of_media(spark.createDataFrame([(1, kept.media), (2, None), (3, bytearray(b"no"))], "media_id bigint, media binary")).orderBy("media_id").collect()
    assert [r.height for r in back] == [1, None, None] and back[0].feature == kept.feature
    assert M.text_media(df.limit(0)).count() == 0

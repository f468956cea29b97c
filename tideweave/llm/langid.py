"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language gets a codeword. Each bit is a binary classifier: the log ratio of n-gram frequencies between the
languages with that bit set and the others, learned from counts over all training rows, every language weighing alike.
A text's margin for a bit is the mean ratio over its n-grams. A second pass over the training rows counts how often each
bit is right about each language; decoding is loss-weighted: a codeword's distance is the logistic loss of its bits,
weighed by those shares. The nearest codeword names the language (of equals the first by name). If the next one is about
as near, the row is flagged as ambiguous.

What is counted has bits x BUCKETS cells and languages x bits cells; bits grow with the logarithm of the number of
languages, of which there may be any number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .shared import map_arrow
from .textkit import crc_of_id, pieces

LETTER = re.compile(r"[^\W\d_]")
#: Hashed n-grams: the model on the driver has bits x this many weights.
BUCKETS = 1 << 15
AMBIGUOUS = 0.02
SHARPNESS = 6.0
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def features(off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that begins at each byte, white space as one sign; BUCKETS where it runs over its row's end."""
    x = _LOWER[data]
    x[(x >= 9) & (x <= 13)] = 32
    n = len(x)
    out = np.full(n, BUCKETS, np.int64)
    if n > 2:
        h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[:-2] = h >> np.uint32(17)
    ends = off[1:][np.diff(off) > 0]
    out[ends - 1] = BUCKETS
    out[ends[ends > 1] - 2] = BUCKETS
    return out


def codebook(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all ways to part up to 6 languages, seeded random ones for more."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        return np.array([[1 if (j >> i) & 1 else -1 for j in range(1, 2 ** (n - 1))] for i in range(n)], np.int8)
    r = np.random.default_rng(7)
    words = 8 * int(np.ceil(np.log2(n))) + 7
    while True:
        code = r.choice(np.array([-1, 1], np.int8), (n, words))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        if len(np.unique(code, axis=0)) == n:
            return code


@dataclass
class Model:
    """names in order, their codewords, weight of each bucket (and of none) for each bit, and trust: a language's share of
    loss for each bit."""

    names: list[str]
    code: np.ndarray
    weight: np.ndarray
    trust: np.ndarray

    def margins(self, off: np.ndarray, data: np.ndarray) -> np.ndarray:
        """texts x bits."""
        hit = self.weight[features(off, data)]
        total = np.concatenate([np.zeros((1, hit.shape[1])), np.cumsum(hit, axis=0, dtype=np.float64)])
        return (total[off[1:]] - total[off[:-1]]) / np.maximum(np.diff(off) - 2, 1)[:, None]

    def predict(self, column) -> tuple[list, np.ndarray, np.ndarray]:
        """(languages, scores, whether ambiguous) of a column of texts."""
        names, scores, doubt = [], [], []
        for lo, hi, off, data in pieces(column, 1 << 19):
            margin = np.clip(self.margins(off, data), -30, 30)
            set_ = self.code > 0
            loss = np.log1p(np.exp(-margin)) @ (self.trust * set_).T + np.log1p(np.exp(margin)) @ (self.trust * ~set_).T
            loss = np.round(loss, 9)  # equal distances must be equal
            near = np.sort(loss, axis=1)[:, :2]
            share = np.exp(-SHARPNESS * (loss - near[:, :1]))
            best = loss.argmin(axis=1)
            texts = column.slice(lo, hi - lo).to_pylist()
            known = np.array([t is not None and LETTER.search(t) is not None for t in texts])
            names += [self.names[i] if k else "und" for i, k in zip(best, known)]
            scores.append(np.where(known, 1 / share.sum(axis=1), 0.0))
            doubt.append(~known | ((near[:, 1] - near[:, 0] < AMBIGUOUS) if near.shape[1] > 1 else np.zeros(len(known), bool)))
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return names, cat(scores, float), cat(doubt, bool)


def held_out(ids) -> np.ndarray:
    return crc_of_id(ids) % 5 == 0


def _summed(rows: DataFrame, shape: tuple[int, int], count) -> np.ndarray:
    """Sum over all rows(lang, text) of the cells that count(cells, language numbers, offsets, bytes) adds to."""

    def run(batches):
        cells = np.zeros(shape)
        for b in batches:
            lang = b.column("at").to_numpy()
            for lo, hi, off, data in pieces(b.column("text"), 1 << 19):
                count(cells, lang[lo:hi], off, data)
        for k, v in sketch.chunks_of(cells.ravel()):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v], pa.binary())], ["chunk", "cells"])

    return sketch.summed(map_arrow(rows, run, "chunk int, cells binary"), shape[0] * shape[1], "float64").reshape(shape)


def train(docs: DataFrame) -> Model:
    """A model from the rows with text and lang whose id isn't held out, all of them."""
    spark = docs.sparkSession
    rows = docs.filter("text is not null and lang is not null").filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = sorted(rows.groupBy("lang").agg(F.sum(F.greatest(F.octet_length("text") - 2, F.lit(0))).alias("n")).collect())
    names = [r.lang for r in found]
    code = codebook(len(names))
    if len(names) < 2:
        return Model(names or ["und"], codebook(1), np.zeros((BUCKETS + 1, 1), np.float32), np.ones((1, 1)))
    # a bit's share of a bucket is the mean over its languages of their smoothed shares
    size = np.array([r.n for r in found]) + 0.5 * BUCKETS
    set_ = code > 0
    rows = rows.join(F.broadcast(spark.createDataFrame([(x, i) for i, x in enumerate(names)], "lang string, at int")), "lang").select("at", "text")  # a row per language

    def grams(cells, lang, off, data):
        f = features(off, data)
        at = np.repeat(lang, np.diff(off))
        for i in np.unique(lang):
            n = np.bincount(f[at == i], minlength=BUCKETS + 1)[:BUCKETS] / size[i]
            cells[:-1][set_[i]] += n
            cells[-1] += n

    got = _summed(rows, (code.shape[1] + 1, BUCKETS), grams)
    yes = (got[:-1] + 0.5 * (set_ / size[:, None]).sum(axis=0)[:, None]) / set_.sum(axis=0)[:, None]
    no = (got[-1] - got[:-1] + 0.5 * (~set_ / size[:, None]).sum(axis=0)[:, None]) / (~set_).sum(axis=0)[:, None]
    weight = np.zeros((BUCKETS + 1, code.shape[1]), np.float32)
    weight[:BUCKETS] = (np.log(np.maximum(yes, 1e-300)) - np.log(np.maximum(no, 1e-300))).T
    model = spark.sparkContext.broadcast(Model(names, code, weight, np.ones(code.shape)))

    def right(cells, lang, off, data):
        m = model.value
        np.add.at(cells, lang, np.concatenate([m.margins(off, data) * m.code[lang] > 0, np.ones((len(lang), 1))], axis=1))

    got = _summed(rows, (len(names), code.shape[1] + 1), right)
    share = (got[:, :-1] + 1) / (got[:, -1:] + 2)
    return Model(names, code, weight, share / share.sum(axis=1, keepdims=True))


def identify(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, ...) to (doc_id, held_out, lang_pred, score, ambiguous), one row per row of docs.

    Rows with null text or lang aren't learned from; null texts and texts without a letter get `und` and score 0.
    lang, source and doc_id take no part in a prediction. Of languages that are equally near the first by name is told.
    With nothing to learn every row gets `und`; an empty table gives no rows. A text of any length counts whole, in one
    task. Repeated rows give repeated results; other columns are ignored, so their names can't clash.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches):
        m = model.value
        for b in batches:
            names, score, doubt = m.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held_out(b.column("doc_id").to_pylist()), pa.bool_()), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(plain, run, "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")


def with_language(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text has a clear language: neither `und` (null and empty texts, no letters) nor ambiguous.

    Repeated rows stay or go together; columns stay as they are, whatever their names; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches):
        m = model.value
        for b in batches:
            names, _, doubt = m.predict(b.column("text"))
            keep = ~doubt & (np.array(names, object) != "und") if names else np.zeros(0, bool)
            yield b.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)

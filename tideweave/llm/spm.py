"""Encoding and decoding for merge-type (BPE) SentencePiece vocabularies with byte pieces.

A text is cut where no vocabulary piece holds the two neighbouring characters side by side: no merge can cross such a
place, so the parts are independent. In each part the adjacent symbol pair of the best score (leftmost among equals)
merges first, until no pair is a piece. The agenda of pairs is kept as arrays over all parts of an Arrow batch at once,
one merge a part and step; the few long parts have a heap each. Characters outside the vocabulary become byte pieces.

Words that are new to a worker are encoded by the agenda and by the sentencepiece library; if the two differ, the task
fails. The ids of every whole text are decoded by the library.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow

MARK = "▁"
#: Bytes, about, of the words that a worker remembers. It starts anew beyond them: frequent words are soon back.
CACHE_BYTES = 64 << 20
#: Characters of the longest word that is remembered, and of the longest part that merges in arrays.
LONGEST = 120
CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NEVER = np.iinfo(np.int32).max
_PROBE = "a  b\tＡ ﬁ é é ½ ™\n 　x ​ "


class Pieces:
    """A vocabulary read through the library, and the agenda encoder on it."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = sp.get_piece_size()
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte = np.full(256, -1, np.int64)
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.id[piece], self.score[piece] = i, -sp.get_score(i)
        if (self.byte < 0).any() or any(MARK in p.lstrip(MARK) for p in self.id) or sp.normalize(_PROBE) != MARK + _PROBE.replace(" ", MARK):
            raise ValueError(f"{model}: needs byte pieces, no mark inside pieces and texts as they are")
        self.by_line = not any("\n" in p for p in self.id)
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))
        # symbols are pieces, and characters that occur in pieces only
        symbol = dict(self.id)
        for c in sorted(set("".join(self.id))):
            symbol.setdefault(c, self.size + len(symbol))
        self.char = np.full(0x110000, -1, np.int64)
        for c, i in symbol.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        self.wide = max(symbol.values()) + 1
        rank = dict(zip(sorted(set(self.score.values())), range(len(self.score))))
        pairs = [(symbol[p[:i]] * self.wide + symbol[p[i:]], rank[self.score[p]], n) for p, n in self.id.items() for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol]
        self.pair, self.rank, self.merged = np.array(sorted(pairs), np.int64).reshape(-1, 3).T.copy()
        self.inside = np.unique(np.array([ord(a) << 21 | ord(b) for p in self.id for a, b in zip(p, p[1:])], np.int64))
        self.word: dict[str, bytes] = {}
        self.held = 0

    def agenda(self, text: str) -> list[str]:
        """Symbols of a text after all merges, by a heap."""
        symbol, score = list(text), self.score
        n = len(symbol)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(score[p], i, i + 1, 2) for i in range(n - 1) if (p := symbol[i] + symbol[i + 1]) in score]
        heapify(queue)
        while queue:
            _, i, j, size = heappop(queue)
            a, b = symbol[i], symbol[j]
            if not a or not b or len(a) + len(b) != size:
                continue
            symbol[i], symbol[j] = a + b, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := a + b + symbol[k]) in score:
                    heappush(queue, (score[p], i, k, len(p)))
            if (k := before[i]) >= 0 and (p := symbol[k] + a + b) in score:
                heappush(queue, (score[p], k, i, len(p)))
        return [s for s in symbol if s]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols and the piece that it makes; _NEVER and -1 if it makes none."""
        if not len(self.pair):
            return np.full(len(a), _NEVER), np.full(len(a), -1)
        key = np.where((a >= 0) & (b >= 0), a * self.wide + b, -1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.rank[at], _NEVER), np.where(hit, self.merged[at], -1)

    def _merge(self, symbol: np.ndarray, alive: np.ndarray, place: np.ndarray, part: np.ndarray) -> None:
        """Merges in all parts at once: each step takes every open part's best pair. `place` are the characters of the
        parts, in order, `part` the number of each one's part; results go to symbol and alive."""
        s = symbol[place]
        follows = lambda at: np.append(part[1:] == part[:-1], False)[at]
        rank, made = np.full(len(s), _NEVER), np.full(len(s), -1)
        rank[:-1], made[:-1] = self._pairs(s[:-1], s[1:])
        rank[~follows(slice(None))] = _NEVER
        while len(s):
            start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            best = np.minimum.reduceat(rank, start)
            size = np.diff(np.append(start, len(s)))
            if (best == _NEVER).any():
                going = np.repeat(best != _NEVER, size)
                symbol[place[~going]] = s[~going]
                s, place, part, rank, made = s[going], place[going], part[going], rank[going], made[going]
                best, size = best[best != _NEVER], size[best != _NEVER]
                if not len(s):
                    return
            at = np.flatnonzero(rank == np.repeat(best, size))
            at = at[np.append(True, part[at[1:]] != part[at[:-1]])]  # the leftmost of each part
            s[at] = made[at]
            alive[place[at + 1]] = False
            stays = np.ones(len(s), bool)
            stays[at + 1] = False
            s, place, part, rank, made = s[stays], place[stays], part[stays], rank[stays], made[stays]
            at -= np.arange(len(at))
            changed = np.concatenate([at, at[at > 0] - 1])
            rank[changed], made[changed] = _NEVER, -1
            changed = changed[follows(changed)]
            rank[changed], made[changed] = self._pairs(s[changed], s[changed + 1])

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks (none empty), one after another, and where each chunk's ids begin (one more at the end)."""
        if not chunks:
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        text = "".join(chunks)
        code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        symbol, alive = self.char[code], np.ones(len(code), bool)
        begins = np.zeros(len(code), bool)
        begins[np.cumsum(size) - size] = True
        if len(self.inside):
            key = code[:-1] << 21 | code[1:]
            at = np.minimum(np.searchsorted(self.inside, key), len(self.inside) - 1)
            begins[1:] |= self.inside[at] != key
        else:
            begins[:] = True
        start = np.flatnonzero(begins)
        length = np.diff(np.append(start, len(code)))
        place = np.flatnonzero(np.repeat((length > 1) & (length <= LONGEST), length))
        if len(place):
            self._merge(symbol, alive, place, (np.cumsum(begins) - 1)[place])
        for a, n in zip(start[length > LONGEST].tolist(), length[length > LONGEST].tolist()):
            alive[a : a + n] = False
            for piece in self.agenda(text[a : a + n]):
                alive[a], symbol[a] = True, self.id.get(piece, -1)
                a += len(piece)
        chunk = np.repeat(np.arange(len(chunks)), size)[alive]
        symbol, code = symbol[alive], code[alive]
        odd = (symbol < 0) | (symbol >= self.size)
        if not odd.any():
            return symbol.astype("<u4"), np.concatenate([[0], np.cumsum(np.bincount(chunk, minlength=len(chunks)))])
        n = np.where(odd, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
        ids = np.repeat(symbol, n)
        ids[np.repeat(odd, n)] = self.byte[np.frombuffer(code[odd].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
        return ids.astype("<u4"), np.concatenate([[0], np.cumsum(np.bincount(chunk, weights=n, minlength=len(chunks)).astype(np.int64))])

    def keys(self, text: str) -> list[str]:
        """A text as words: a plain one has the mark before it, one that begins with a line feed hasn't; a chunk that begins with the mark stands for itself."""
        if text[:1] == " " or "  " in text or MARK in text:
            return [MARK + c for c in CHUNKS.findall(MARK + text.replace(" ", MARK))]
        if not self.by_line:
            return text.split(" ")
        out: list[str] = []
        for i, line in enumerate(text.split("\n")):
            w = line.split(" ")
            if i:
                w[0] = "\n" + w[0]
            out += w
        return out

    @staticmethod
    def chunk(key: str, by_line: bool = True) -> str:
        return key[1:] if key[:1] == MARK else key if by_line and key[:1] == "\n" else MARK + key

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new words, by the agenda; the library must have the same."""
        chunks = [self.chunk(k, self.by_line) for k in new]
        ids, first = self.encode_chunks(chunks)
        # the library puts a mark before every text: it stands in the ids of a word that begins with the mark, and before those of any other
        theirs = self.library.encode([c.removeprefix(MARK).replace(MARK, " ") for c in chunks], num_threads=1)
        lone = self.encode_chunks([MARK])[0].tolist()
        theirs = [x[len(lone) :] if c[0] != MARK else x or lone for c, x in zip(chunks, theirs, strict=True)]
        n = np.fromiter(map(len, theirs), np.int64, len(theirs))
        if not np.array_equal(n, np.diff(first)) or not np.array_equal(np.fromiter(chain.from_iterable(theirs), np.int64, int(n.sum())), ids):
            raw = ids.tolist()
            wrong = [k for k, a, b, x in zip(new, first[:-1], first[1:], theirs) if raw[a:b] != x]
            raise RuntimeError(f"{len(wrong)} words of {len(new)} whose ids differ from the library's, such as {wrong[0][:200]!r}")
        data, at = ids.tobytes(), (4 * first).tolist()
        return {k: data[a:b] for k, a, b in zip(new, at, at[1:])}

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(all ids with begin and end, text decoded from them) of each text."""
        keys = [self.keys(t) if t else [] for t in texts]
        if self.held > CACHE_BYTES:
            self.word, self.held = {}, 0
        known = self.word
        extra: dict[str, bytes] = {}
        new = list(set().union(*keys).difference(known))
        for i in range(0, len(new), 20_000):
            for k, v in self.learn(new[i : i + 20_000]).items():
                if len(k) <= LONGEST:
                    known[k] = v
                    self.held += 200 + 4 * len(k)
                else:
                    extra[k] = v
        if extra:
            find = lambda k: known[k] if k in known else extra[k]
        else:
            find = known.__getitem__
        ids = [self.begin + b"".join(map(find, ks)) + self.end for ks in keys]
        decoded = self.library.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1) if ids else []
        return list(zip(ids, decoded, strict=True))


@lru_cache(2)
def pieces(model: str) -> Pieces:
    """One vocabulary per Python worker, with its words."""
    return Pieces(model)


def _slices(texts, limit=1 << 20):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def _run(model: str, keep: tuple[str, ...]):
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + [x for x in ("ids", "decoded") if x in keep]

    def run(batches):
        p = pieces(model)
        for b in batches:
            lo = 0
            for part in _slices([t or "" for t in b.column("text").to_pylist()]):
                got = p.encode(part)
                own = b.slice(lo, len(part))
                lo += len(part)
                cols = [pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i, _ in got]), pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in got])]
                if "ids" in keep:
                    ends = np.cumsum([0] + [len(i) // 4 for i, _ in got])
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(i for i, _ in got), "<i4"))))
                if "decoded" in keep:
                    cols.append(pa.array([d for _, d in got], pa.string()))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), *cols], ["doc_id", *names])

    return run


def encode_documents(docs: DataFrame, model: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id bigint, text string, ...) to (doc_id, n_tokens, ids_sha256, decoded_sha256), with `keep` also its columns of ids and decoded.

    `model` is a path that every executor can open. Null texts count as empty (begin and end ids only). Repeated rows
    give repeated results; other columns are ignored, so their names can't clash. An empty table gives no rows. A text of
    any length is encoded whole, by one task in memory; pairs of equal score merge from the left.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if "ids" in keep else "") + (", decoded string" if "decoded" in keep else "")
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(plain, _run(model, keep), schema)

"""Personal data by weak supervision.

Base patterns with checks give certain spans. Looser shapes (written-out addresses, phone numbers as they are
written in North America, France, Spain and Germany, ip addresses and cards split by other signs, numbers that fail a
check) are candidates. Four labelers vote on every span: the shape and its check, gazetteers of endings, dialling
codes and card issuers, words before the span, and the characters beside it. Counts of the vote patterns over all texts,
a bounded table, are summed by Spark; expectation-maximisation finds how reliable each labeler is and gives each pattern
a probability. On these a logistic classifier is trained, which also sees the span and its context: its length, what
stands on either side and the word before it. It decides about the candidates; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow

KINDS = ("email", "ip", "card", "phone")
# What labelers know.
#: Endings of hosts; any of two letters is a country's.
ENDINGS = {"com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "aero", "coop", "museum", "jobs", "mobi", "travel", "tel", "cat", "asia", "post", "app", "dev", "cloud", "online", "site", "store", "shop", "tech", "blog", "news", "email", "mail", "web", "xyz", "top", "club", "live", "life", "world", "agency", "company", "group", "media", "network", "services", "solutions", "systems", "support", "team", "digital", "berlin", "hamburg", "wien", "paris", "london", "koeln", "bayern", "madrid", "barcelona", "gal", "eus", "bzh", "alsace", "corsica", "nyc", "tokyo", "amsterdam", "swiss", "academy", "art", "audio", "bank", "bar", "beer", "bike", "bio", "build", "business", "cafe", "camera", "capital", "care", "center", "chat", "church", "city", "clinic", "codes", "coffee", "community", "computer", "consulting", "cool", "dance", "data", "dental", "design", "directory", "doctor", "education", "energy", "engineer", "events", "exchange", "expert", "family", "farm", "film", "finance", "fit", "fun", "fund", "games", "garden", "global", "guide", "health", "help", "host", "house", "immo", "ink", "institute", "land", "law", "legal", "link", "love", "ltd", "market", "money", "music", "page", "partners", "photo", "photos", "press", "rocks", "run", "school", "science", "social", "software", "space", "store", "studio", "style", "today", "tools", "training", "tv", "university", "video", "wiki", "work", "works", "zone"}
#: Dialling codes: of one digit, of two, and the first two digits of those of three.
ONE, TWO, THREE = "17", ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"), ("21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "69", "80", "85", "87", "88", "96", "97", "99")
#: Beginnings of German numbers with 01: mobile and service numbers.
MOBILE = ("15", "16", "17", "18")
#: Card issuers: first and last number of the leading digits, and how many digits a card has.
ISSUERS = ((4, 4, (13, 16, 19)), (51, 55, (16,)), (2221, 2720, (16,)), (34, 34, (15,)), (37, 37, (15,)), (300, 305, (14, 16)), (3095, 3095, (14, 16)), (36, 36, (14, 19)), (38, 39, (14, 19)), (3528, 3589, (16, 19)), (6011, 6011, (16, 19)), (644, 649, (16, 19)), (65, 65, (16, 19)), (62, 62, (16, 17, 18, 19)), (50, 50, (16, 19)), (56, 58, (16, 19)), (67, 67, (16, 19)), (2200, 2204, (16,)))
#: First parts of addresses that no host on the internet has.
NO_HOST = {0, 127, *range(224, 256)}
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach|address|adresse?|kontakt|schreiben|correo|direcci[oó]n|contacto|courriel|[eé]crire|contacter)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|ipv4|host|server|address|adresse?|client|login|from|peer|gateway|dns|ping|serveur|servidor|rechner)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|discover|maestro|credit|debit|payment|pay|kreditkarte|karte|zahlung|tarjeta|pago|carte|paiement|cc)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|cell|fax|hotline|dial|whatsapp|sms|telefon|handy|anrufen|m[oó]vil|tel[eé]fono|llamar|t[eé]l[eé]phone|portable|appeler)\b"),
}
AGAINST = re.compile(r"(?i)(?:\b(?:version|isbn|issn|order|invoice|sku|item|model|page|chapter|serial|part|build|release|bestellung|rechnung|pedido|factura|commande|facture|kapitel|seite)\b|[#=v])\W*$")
#: Own features of the classifier: classes of length, of the character before and after, and buckets for the word before.
LENGTHS, SIDES, WORDS = (8, 12, 20), 3, 16

SIGNS = re.compile(r"[@+0-9]|[\[(] ?at ?[\])]", re.I)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WRITTEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{1,63})+", re.I)
#: National phone numbers: North America's, then those of France, Spain and Germany, which have no other digits beside them.
AMERICAN = re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")
EUROPEAN = re.compile(
    r"(?<![\w+.,/-])(?<![0-9] )(?:"
    r"(?P<fr>0[1-9](?:[ .-][0-9]{2}){4})"
    r"|(?P<es>[6-9][0-9]{2}(?:[ .-][0-9]{2}){3}|9[1-8][ .-][0-9]{3}(?:[ .-][0-9]{2}){2})"
    r"|(?P<threes>[6-9][0-9]{2}(?:(?: [0-9]{3}){2}|(?:\.[0-9]{3}){2}|(?:-[0-9]{3}){2}))"
    r"|(?P<de>(?:\(0[1-9][0-9]{1,3}\) ?|0[1-9][0-9]{1,3}(?: ?[/-] ?| ))(?:[0-9]{5,8}(?:-[0-9]{1,4})?|[0-9]{2,4}(?: [0-9]{2,4}){1,3}))"
    r")(?![\w/-]|[ .,][0-9])"
)
#: Addresses and card numbers that are written so that no machine takes them for one.
SPLIT_IP = re.compile(r"(?<![\w.\])-])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| ?[\[(]dot[\])] ?)[0-9]{1,3}){3}(?![\w\[(.])", re.I)
SPLIT_CARD = re.compile(r"(?<![\w./])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![\w./])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def shaped(text: str):
    """(kind, start, end, valid) of the base patterns, leftmost and non-overlapping per kind."""
    if "@" in text:
        done = 0
        for m in DOMAIN.finditer(text):
            i = at = m.start()
            while i > done and text[i - 1] in LOCAL:
                i -= 1
            if i < at:
                yield "email", i, m.end(), True
                done = m.end()
    if "." in text:
        for m in IP.finditer(text):
            yield "ip", m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19:
                yield "card", m.start(), m.end(), len(digits) >= 14 and luhn(digits)
    if "+" in text:
        for m in PHONE.finditer(text):
            n = sum(c in "0123456789" for c in m[0])
            if 7 <= n <= 15:
                yield "phone", m.start(), m.end(), n >= 10


def loose(text: str):
    """(kind, start, end) of shapes that are candidates only."""
    if "@" in text or "at" in text or "AT" in text or "At" in text or "aT" in text:
        yield from (("email", m.start(), m.end()) for m in WRITTEN.finditer(text))
    if "[" in text or "(" in text:
        yield from (("ip", m.start(), m.end()) for m in SPLIT_IP.finditer(text) if all(int(p) <= 255 for p in re.findall("[0-9]+", m[0])))
    for m in SPLIT_CARD.finditer(text):
        if luhn(digits_of(m[0])):
            yield "card", m.start(), m.end()
    yield from (("phone", m.start(), m.end()) for m in AMERICAN.finditer(text))
    for m in EUROPEAN.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 13:
            yield "phone", m.start(), m.end()


def digits_of(span: str) -> str:
    return "".join(c for c in span if c in "0123456789")


def national(span: str) -> int:
    """Whether a national phone number begins like one of its country; no vote on groups of three, as thousands are
    written so too."""
    digits, form = digits_of(span), EUROPEAN.fullmatch(span)
    if form is None:
        known = digits[0] in "23456789" and digits[1:3] != "11" and digits[3] in "23456789"
    elif form["threes"]:
        return 0
    else:
        known = not form["de"] or digits[1] in "23456789" or digits[1:3] in MOBILE
    return 1 if known else -1


def issued(digits: str) -> bool:
    """Whether some issuer has cards of this length and beginning."""
    return any(len(digits) in sizes and lo <= int(digits[: len(str(lo))]) <= hi for lo, hi, sizes in ISSUERS)


def votes(text: str, kind: str, start: int, end: int, shape: int) -> tuple[int, int, int, int]:
    """One vote of each labeler: 1 for, -1 against, 0 none."""
    span = text[start:end]
    beside = text[start - 1 : start] + text[end : end + 1]
    if kind == "email":
        ending = re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]"))[-1].lower()
        listed = ending in ENDINGS or (len(ending) == 2 and ending.isalpha())
    elif kind == "ip":
        first = re.split("[^0-9]", span, maxsplit=1)[0].lstrip("0")[:4]
        listed = int(first or 0) not in NO_HOST and len(first) < 4
    elif kind == "card":
        listed = issued(digits_of(span))
    elif span[0] == "+":
        code = "".join(c for c in span[1:12] if c in "0123456789")
        listed = code[0] in ONE or code[:2] in TWO or code[:2] in THREE
    else:
        listed = None
    before = text[max(0, start - 40) : start]
    context = -1 if AGAINST.search(before[-16:]) else 1 if CONTEXT[kind].search(before) else 0
    return shape, national(span) if listed is None else 1 if listed else -1, context, -1 if any(c.isalnum() or c in "_/" for c in beside) else 1


def side(c: str) -> int:
    """0: a blank, a line's end or the text's; 1: a letter or digit; 2: anything else."""
    return 0 if not c or c.isspace() else 1 if c.isalnum() else 2


def traits(text: str, start: int, end: int) -> tuple[int, int, int, int]:
    """What the classifier sees besides the votes: length, both sides, and the word before."""
    word = re.findall(r"\w+", text[max(0, start - 24) : start])
    seen = zlib.crc32(word[-1].lower().encode()) % (WORDS - 1) + 1 if word else 0
    return sum(end - start > n for n in LENGTHS), side(text[start - 1 : start]), side(text[end : end + 1]), seen


def spans_of(text: str) -> list[tuple[int, int, int, bool, tuple]]:
    """(start, end, kind number, base, votes and traits) of base spans and of candidates that overlap none. Candidates
    that overlap each other: the first, the longest of those that begin together, of equal ones that which failed no check."""
    if not text or not SIGNS.search(text):
        return []
    base, rest = [], []
    for kind, a, b, valid in shaped(text):
        (base if valid else rest).append((a, b, KINDS.index(kind), valid))
    rest += [(a, b, KINDS.index(kind), None) for kind, a, b in loose(text)]
    out = list(base)
    # the union of base spans as disjoint intervals, in order
    starts, ends = [], []
    for a, b, *_ in sorted(base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    last = 0
    for s in sorted(rest, key=lambda s: (s[0], -s[1], s[3] is False, s[2])):
        i = bisect_left(starts, s[1]) - 1
        if s[0] >= last and (i < 0 or ends[i] <= s[0]):
            last = s[1]
            out.append(s)
    return [(a, b, k, v is True, votes(text, KINDS[k], a, b, {True: 1, False: -1, None: 0}[v]) + traits(text, a, b)) for a, b, k, v in sorted(out, key=lambda s: (s[0], s[2]))]


@dataclass
class Model:
    """reliability: log odds of each labeler's votes; weight: the classifier on one-hot kinds, votes and traits."""

    reliability: np.ndarray
    weight: np.ndarray

    def accepts(self, kind: int, vote: tuple) -> bool:
        return float(_features(np.array([[kind, *vote]]))[0] @ self.weight) > 0


def _features(p: np.ndarray) -> np.ndarray:
    """One-hot kind, then one-hot vote of each labeler, then 1, then one-hot traits."""
    sizes = (len(LENGTHS) + 1, SIDES, SIDES, WORDS)
    return np.concatenate([np.eye(len(KINDS))[p[:, 0]], *(np.eye(3)[p[:, i] + 1] for i in range(1, 5)), np.ones((len(p), 1)), *(np.eye(n)[p[:, 5 + i]] for i, n in enumerate(sizes))], axis=1)


def _first_weight() -> np.ndarray:
    """The classifier before training: the labelers' initial trust, nothing on kinds and traits."""
    return np.concatenate([np.zeros(len(KINDS)), *([-t, 0, t] for t in TRUST), [-1.0], np.zeros(len(LENGTHS) + 1 + 2 * SIDES + WORDS)])


TRUST = np.array([3.0, 1.0, 1.0, 1.0])


def posteriors(kind: np.ndarray, vote: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """EM over patterns (kind, four votes) that occurred n times: each one's probability, and the labelers' log odds."""
    post = 1 / (1 + np.exp(1.0 - vote @ TRUST))
    odds = np.zeros((4, 3))
    for _ in range(rounds):
        prior = np.array([((n * post)[kind == k].sum() + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])
        yes, no = n * post, n * (1 - post)
        for i in range(4):
            for v in range(3):
                hit = vote[:, i] == v - 1
                odds[i, v] = np.log((yes[hit].sum() + 1) / (yes.sum() + 3)) - np.log((no[hit].sum() + 1) / (no.sum() + 3))
        logit = np.log(prior / (1 - prior))[kind] + sum(odds[i, vote[:, i] + 1] for i in range(4))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, odds


def fit(patterns: np.ndarray, n: np.ndarray) -> Model:
    """EM over the vote patterns, then the classifier on its probabilities; a row of patterns is kind, votes and traits."""
    if not len(patterns):
        return Model(np.zeros((4, 3)), _first_weight())
    n = n.astype(float)
    post, odds = posteriors(patterns[:, 0], patterns[:, 1:5], n)
    # Newton steps with a ridge towards the labelers' initial trust
    x, first = _features(patterns), _first_weight()
    w = first.copy()
    share = n / n.sum() * min(n.sum(), 1000.0)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - post)) + (w - first)
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return Model(odds, w)


def learn(docs: DataFrame) -> Model:
    """Counts of patterns over all texts and the model fitted to them. There are kinds x 81 votes x 576 traits at most,
    of which few occur together, however many texts there are."""
    names = ["k", "v0", "v1", "v2", "v3", "t0", "t1", "t2", "t3"]

    def run(batches):
        seen: dict[tuple, int] = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                for _, _, k, _, v in spans_of(t):
                    seen[(k, *v)] = seen.get((k, *v), 0) + 1
        if seen:
            yield pa.RecordBatch.from_arrays([*(pa.array([p[i] for p in seen], pa.int32()) for i in range(9)), pa.array(list(seen.values()), pa.int64())], [*names, "n"])

    rows = map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, ", ".join(f"{x} int" for x in names) + ", n bigint")
    got = rows.groupBy(*names).agg(F.sum("n").alias("n")).orderBy(*names).collect()
    return fit(np.array([r[:9] for r in got], int).reshape(-1, 9), np.array([r.n for r in got]))


def decided(text: str, model: Model) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind number, base) of base spans and accepted candidates."""
    return [(a, b, k, base) for a, b, k, base, v in spans_of(text) if base or model.accepts(k, v)]


def _written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k, _ in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of docs.

    Counts and base_sha256 are of base spans; spans has the accepted candidates too, as kind:start:end in code points.
    Null and empty texts have none; an empty table gives no rows. A text of any length is searched whole, in time that
    grows in proportion to it but for a sort of its spans. Spans that begin together are in the order of kinds. Written-out
    addresses have up to 64 characters before the sign and up to 63 in each part of the host, as mail allows. Repeated
    rows count repeatedly and give repeated results; other columns are ignored, so their names can't clash.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches):
        m = model.value
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                got = decided(t, m)
                base = [s for s in got if s[3]]
                rows.append((*(sum(s[2] == k for s in base) for k in range(4)), hashlib.sha256(_written(base).encode()).hexdigest(), _written(got)))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(plain, run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(text: str, spans) -> str:
    """The text with each span as its kind in angle brackets; spans that overlap are one, named by the first."""
    out, at = [], 0
    for a, b, k, _ in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def without_personal_data(docs: DataFrame) -> DataFrame:
    """docs with every found span of `text` masked, and `n_chars`, where there is such a column, set to the new length.

    Null texts, and null n_chars, stay null. Every row stays, repeated ones too; all other columns stay as they are,
    whatever their names. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs))
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        m = model.value
        for b in batches:
            texts = [t and masked(t, decided(t, m)) for t in b.column(at).to_pylist()]
            if size is not None:
                n = [old if old is None else 0 if t is None else len(t) for old, t in zip(b.column(size).to_pylist(), texts)]
                b = b.set_column(size, b.schema.field(size), pa.array(n).cast(b.schema.field(size).type))
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return map_arrow(docs, run, docs.schema)

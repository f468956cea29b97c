"""Query sets as bit masks: one bigint for up to 63 queries, an array of them beyond."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 63
#: Widest hull for which masks are looked up.
TABLE = 4096


def mask_of(attr: str, ranges: list[tuple[int, int, int]], integral: bool = False) -> Column:
    """Bits of the queries (bit, lo, hi) whose range holds the column; a null is in none.

    A whole-number column over a narrow hull is looked up in a table of masks, one step a row however many queries
    there are; any other is compared with each range.
    """
    if not ranges:
        return F.lit(0).cast("bigint")
    low, high = min(r[1] for r in ranges), max(r[2] for r in ranges)
    if integral and high - low < TABLE:
        table = ", ".join(f"{sum(1 << q for q, lo, hi in ranges if lo <= v <= hi)}L" for v in range(low, high + 1))
        return F.expr(f"coalesce(get(array({table}), try_cast(try_subtract(cast(`{attr}` as bigint), {low}L) as int)), 0L)")
    inside = lambda lo, hi: f"`{attr}` is not null" if (lo, hi) == (-(2**63), 2**63 - 1) else f"`{attr}` between {lo} and {hi}"
    return F.expr(" | ".join(f"case when {inside(lo, hi)} then {1 << q}L else 0L end" for q, lo, hi in ranges))


def mask_words(attr: str, ranges: list[tuple[int, int, int]], integral: bool = False) -> Column:
    """The same as an array of words of 63 bits, for any number of queries."""
    last = max((q for q, _, _ in ranges), default=0) // WORD
    return F.array(*[mask_of(attr, [(q % WORD, lo, hi) for q, lo, hi in ranges if q // WORD == i], integral) for i in range(last + 1)])


def queries_in(mask, n: int) -> Column:
    """Array of the query numbers below n whose bit is set."""
    m = F.col(mask) if isinstance(mask, str) else mask
    return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda q: F.call_function("shiftright", m, q).bitwiseAND(F.lit(1).cast("bigint")) == 1)


def words_in(words, n: int) -> Column:
    """The same for an array of words."""
    w = F.col(words) if isinstance(words, str) else words
    return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda q: F.call_function("shiftright", F.element_at(w, (F.floor(q / WORD) + 1).cast("int")), F.pmod(q, F.lit(WORD))).bitwiseAND(F.lit(1).cast("bigint")) == 1)


def common(one, two, words: bool) -> Column:
    """Queries of both masks; `words` if they are arrays."""
    one, two = F.col(one), F.col(two)
    return F.zip_with(one, two, lambda a, b: a.bitwiseAND(b)) if words else one.bitwiseAND(two)


def some(mask: Column, words: bool) -> Column:
    """Whether a mask has any query."""
    return F.exists(mask, lambda m: m != 0) if words else mask != 0


def holds(mask: Column, qid: Column, words: bool) -> Column:
    """Whether the mask has the query of another column."""
    word = F.element_at(mask, (F.floor(qid / WORD) + 1).cast("int")) if words else mask
    return F.call_function("shiftright", word, F.pmod(qid, F.lit(WORD)).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1

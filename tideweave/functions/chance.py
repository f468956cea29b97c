"""Deterministic chance: numbers that depend on (seed, purpose, id) alone, so any partition makes the same rows."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(seed: int, purpose: str, id_: Column) -> Column:
    """A uniform 32-bit number from an md5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), id_.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def unit(seed: int, purpose: str, id_: Column) -> Column:
    """A uniform number in [0, 1)."""
    return whole(seed, purpose, id_) / F.lit(4294967296.0)


def below(n, seed: int, purpose: str, id_: Column) -> Column:
    """A uniform whole number in [0, n)."""
    return F.pmod(whole(seed, purpose, id_), F.lit(n) if isinstance(n, int) else n)


def pick(values: list[str], seed: int, purpose: str, id_: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (below(len(values), seed, purpose, id_) + 1).cast("int"))


def letters(length: Column, seed: int, purpose: str, id_: Column) -> Column:
    """A lower-case string of that length; from 32 letters on a digest is repeated."""
    digest = F.translate(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), id_.cast("string"))), "0123456789", "ghijklmnop")
    return F.substring(F.repeat(digest, F.ceil(length / 32).cast("int")), F.lit(1), length.cast("int"))


def cumulative(kind: str, n: int, **p: float) -> list[float]:
    """Cumulative shares of n cells: uniform, zipf (exponent, first: the most frequent cell), binomial (chance), beta (a, b) or given (shares)."""
    if kind == "uniform":
        mass = [1.0] * n
    elif kind == "zipf":
        mass = [0.0] * n
        for i in range(n):
            mass[(i + int(p.get("first", 0))) % n] = (i + 1) ** -p.get("exponent", 1.0)
    elif kind == "binomial":
        c = p.get("chance", 0.5)
        mass = [math.comb(n - 1, k) * c**k * (1 - c) ** (n - 1 - k) for k in range(n)]
    elif kind == "beta":
        a, b, fine = p.get("a", 2.0), p.get("b", 2.0), 16
        mass = [sum(((i + (j + 0.5) / fine) / n) ** (a - 1) * (1 - (i + (j + 0.5) / fine) / n) ** (b - 1) for j in range(fine)) for i in range(n)]
    elif kind == "given":
        mass = list(p["shares"])
    else:
        raise ValueError(f"unknown distribution {kind}")
    total = sum(mass)
    return [min(x / total, 1.0) for x in accumulate(mass)][:-1] + [1.0]


def drawn(shares: list[float], u: Column) -> Column:
    """The cell of a cumulative table in which u falls: inverse CDF. Tables have as many cells as values, bounded by the caller."""
    return F.size(F.filter(F.array(*map(F.lit, shares)), lambda c: c <= u)).cast("bigint")

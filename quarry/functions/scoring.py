"""Relevance models as Column arithmetic.

Every model is a function of the Columns tf (posting weight), dl (field length), df, cf, n (documents), total
(length of the field over all documents) and the query frequency qf.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stats:
    tf: Column
    dl: Column
    df: Column
    cf: Column
    n: Column
    total: Column
    field: Column
    qf: float = 1.0


def idf(n: Column, df: Column) -> Column:
    return F.log(n / (df + 1)) + 1


@dataclass(frozen=True)
class BM25F:
    b: float = 0.75
    k1: float = 1.2
    field_b: dict[str, float] = field(default_factory=dict)

    def score(self, s: Stats) -> Column:
        b = F.lit(self.b)
        for name, value in self.field_b.items():
            b = F.when(s.field == name, F.lit(value)).otherwise(b)
        mean = s.total / s.n
        scored = idf(s.n, s.df) * s.tf * (self.k1 + 1) / (s.tf + self.k1 * ((1 - b) + b * s.dl / mean))
        return F.when(s.dl.isNull() | (s.total == 0), s.tf).otherwise(scored)


@dataclass(frozen=True)
class TFIDF:
    def score(self, s: Stats) -> Column:
        return s.tf * idf(s.n, s.df)


@dataclass(frozen=True)
class Frequency:
    def score(self, s: Stats) -> Column:
        return s.tf


@dataclass(frozen=True)
class DFree:
    def score(self, s: Stats) -> Column:
        prior, post = s.tf / s.dl, (s.tf + 1) / (s.dl + 1)
        inverse = s.total / s.cf
        norm = s.tf * F.log(post / prior)
        return s.qf * norm * (s.tf * F.log(prior * inverse) + (s.tf + 1) * F.log(post * inverse) + 0.5 * F.log(post / prior))


@dataclass(frozen=True)
class PL2:
    c: float = 1.0

    def score(self, s: Stats) -> Column:
        tf = s.tf * F.log(1 + self.c * (s.total / s.n) / s.dl)
        f = s.cf / s.n
        r = 1 / F.log(F.lit(2.0))
        return s.qf / (tf + 1) * (tf * F.log(1 / f) + f * r + 0.5 * F.log(2 * F.lit(3.141592653589793) * tf) + tf * (F.log(tf) - r))


@dataclass(frozen=True)
class Multi:
    """A model per field."""

    default: object
    fields: dict[str, object]

    def score(self, s: Stats) -> Column:
        out = self.default.score(s)
        for name, model in self.fields.items():
            out = F.when(s.field == name, model.score(s)).otherwise(out)
        return out


@dataclass(frozen=True)
class Reverse:
    model: object

    def score(self, s: Stats) -> Column:
        return -self.model.score(s)


@dataclass(frozen=True)
class Function:
    """Any function of the statistics to a Column."""

    fn: Callable[[Stats], Column]

    def score(self, s: Stats) -> Column:
        return self.fn(s)


@dataclass(frozen=True)
class PositionBoost:
    """BM25F, and for phrases a bonus that falls with the smallest gap between consecutive matched positions."""

    phrase_boost: float = 1.0
    k: float = 1.0
    base: BM25F = BM25F()

    def score(self, s: Stats) -> Column:
        return self.base.score(s)

    def bonus(self, gap: Column) -> Column:
        return self.phrase_boost / (1 + self.k * (gap - 1))


MODELS: dict[str, Callable] = {"bm25f": BM25F, "bm25": BM25F, "tfidf": TFIDF, "tf_idf": TFIDF, "frequency": Frequency, "dfree": DFree, "pl2": PL2}


def model_named(name: str, **options):
    try:
        return MODELS[name.lower()](**options)
    except KeyError:
        raise ValueError(f"unknown scoring model {name!r}") from None


def coord(score: Column, matched: Column, n: int, scale: float) -> Column:
    """Bonus for matching more of n clauses."""
    if n == 0 or n == scale:
        return F.lit(0.0)
    return (score + (matched - 1) / (n - scale) ** 2) * ((n - 1) / n)

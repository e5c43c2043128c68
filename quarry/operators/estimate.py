"""How many documents a query matches, at least and at most, without touching postings.

A term's document frequency is exact; from there a tree's bounds follow by Fréchet's inequalities: parts of an intersection overlap at
least as far as the number of documents forces them to, and a union is at least its largest part. Patterns are bounded by the
frequencies of the vocabulary's terms that fit. One aggregation over the statistics of the query's terms gives all of it.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.index import SearchIndex
from quarry.plans import query as Q
from quarry.plans.compiler import lead_condition, term_condition


@dataclass
class Bounds:
    lower: Column
    upper: Column


class _Tree:
    def __init__(self, index: SearchIndex):
        self.index, self.n, self.leaves = index, F.col("n"), []

    def leaf(self, q: Q.Query) -> Bounds:
        if q not in self.leaves:
            self.leaves.append(q)
        k = self.leaves.index(q)
        return Bounds(F.col(f"m{k}"), F.least(F.col(f"t{k}"), self.n))

    def intersection(self, parts: list[Bounds]) -> Bounds:
        total = functools.reduce(lambda a, b: a + b, [p.lower for p in parts])
        return Bounds(F.greatest(total - (len(parts) - 1) * self.n, F.lit(0)), self._least([p.upper for p in parts]))

    def union(self, parts: list[Bounds], least: int = 1) -> Bounds:
        """Documents that at least ``least`` of the parts match."""
        if least > len(parts):
            return Bounds(F.lit(0).cast("long"), F.lit(0).cast("long"))
        total = lambda side: functools.reduce(lambda a, b: a + b, [getattr(p, side) for p in parts])
        upper = F.least(F.floor(total("upper") / least).cast("long"), self.n)
        if least <= 1:
            return Bounds(self._greatest([p.lower for p in parts]), upper)
        forced = F.ceil((total("lower") - (least - 1) * self.n) / F.lit(len(parts) - least + 1)).cast("long")
        return Bounds(F.greatest(forced, F.lit(0)), upper)

    @staticmethod
    def _least(columns: list[Column]) -> Column:
        return F.least(*columns) if len(columns) > 1 else columns[0]

    @staticmethod
    def _greatest(columns: list[Column]) -> Column:
        return F.greatest(*columns) if len(columns) > 1 else columns[0]

    def of(self, q: Q.Query) -> Bounds:
        zero = F.lit(0).cast("long")
        if isinstance(q, Q.Null):
            return Bounds(zero, zero)
        if isinstance(q, Q.And):
            return self.intersection([self.of(p) for p in q.parts])
        if isinstance(q, Q.Or):
            return self.union([self.of(p) for p in q.parts], max(q.minmatch, 1))
        if isinstance(q, (Q.DisMax, Q.SpanOr)):
            return self.union([self.of(p) for p in q.parts])
        if isinstance(q, Q.Not):
            part = self.of(q.query)
            return Bounds(self.n - part.upper, self.n - part.lower)
        if isinstance(q, Q.AndNot):
            a, b = self.of(q.a), self.of(q.b)
            return Bounds(F.greatest(a.lower - b.upper, zero), F.least(a.upper, self.n - b.lower))
        if isinstance(q, Q.AndMaybe):
            return self.of(q.a)
        if isinstance(q, Q.Require):
            return self.intersection([self.of(q.a), self.of(q.b)])
        if isinstance(q, Q.Otherwise):
            a, b = self.of(q.a), self.of(q.b)
            some, none = a.lower > 0, a.upper == 0
            lower = F.when(some, a.lower).when(none, b.lower).otherwise(F.least(F.lit(1), b.lower))
            return Bounds(lower, F.when(some, a.upper).when(none, b.upper).otherwise(F.greatest(a.upper, b.upper)))
        if isinstance(q, Q.Phrase):
            parts = [self.of(Q.Term(q.field, w)) for w in q.words]
            return parts[0] if len(parts) == 1 else Bounds(zero, self._least([p.upper for p in parts]))
        if isinstance(q, (Q.SpanNear, Q.Ordered)):
            return Bounds(zero, self._least([self.of(p).upper for p in q.parts]))
        if isinstance(q, (Q.SpanNot, Q.SpanContains, Q.SpanBefore, Q.SpanCondition)):
            a = self.of(q.a)
            return Bounds(zero, a.upper if isinstance(q, Q.SpanNot) else F.least(a.upper, self.of(q.b).upper))
        if isinstance(q, Q.SpanFirst):
            return Bounds(zero, self.of(q.query).upper)
        if isinstance(q, (Q.Boost, Q.Weighted, Q.ConstantScore)):
            return self.of(q.query)
        if isinstance(q, Q.Every) and q.field is None:
            return Bounds(self.n, self.n)
        name = getattr(q, "field", None)
        spec = self.index.specs.get(name) if name else None
        if spec is not None and spec[0].indexed and isinstance(q, (Q.Term, Q.Prefix, Q.Wildcard, Q.Regex, Q.Fuzzy, Q.Variations, Q.TermRange, Q.Every)):
            return self.leaf(q)
        return Bounds(zero, self.n)  # columns and nested documents: nothing is known without reading


def estimate(index: SearchIndex, q: Q.Query) -> DataFrame:
    """One row: lower, upper. The number of matching documents lies between them, ends included."""
    tree = _Tree(index)
    found = tree.of(q.normalize())
    tests = [term_condition(leaf, index) for leaf in tree.leaves]
    reads = [lead_condition(leaf) if isinstance(leaf, (Q.Wildcard, Q.Regex, Q.Fuzzy)) else test for leaf, test in zip(tree.leaves, tests)]
    stats = index.term_stats.where(functools.reduce(lambda a, b: a | b, reads)) if reads else index.term_stats.limit(0)
    zero = F.lit(0).cast("long")
    folds = [c for k, t in enumerate(tests) for c in (F.coalesce(F.max(F.when(t, F.col("df"))), zero).alias(f"m{k}"), F.coalesce(F.sum(F.when(t, F.col("df"))), zero).alias(f"t{k}"))]
    n = index.field_stats.agg(F.max("n").alias("n")) if not tree.leaves else index.field_stats.agg(F.coalesce(F.max("n"), zero).alias("n"))
    # one row on either side
    rows = n.join(F.broadcast(stats.agg(*folds)), F.lit(True)) if folds else n
    return rows.select(found.lower.cast("long").alias("lower"), found.upper.cast("long").alias("upper"))

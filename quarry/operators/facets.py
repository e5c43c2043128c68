"""Grouping keys over search results and what is kept per group."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans import query as Q


@dataclass(frozen=True)
class Facet:
    """``frame`` adds the column __key to results (doc_id, score and document columns); ``overlap`` explodes it."""

    def keyed(self, hits: DataFrame, index) -> DataFrame:
        raise NotImplementedError

    def order(self) -> Column:
        return F.col("__key").asc_nulls_last()


@dataclass(frozen=True)
class FieldFacet(Facet):
    """A column; arrays (or, with overlap, white-space separated text) put a document in several groups."""

    field: str
    reverse: bool = False
    overlap: bool = False

    def keyed(self, hits, index):
        c = F.col(f"`{self.field}`")
        kind = dict(hits.dtypes)[self.field]
        if kind.startswith("array"):
            return hits.withColumn("__key", F.explode_outer(F.array_distinct(c)) if self.overlap else F.get(c, F.lit(0)))
        if self.overlap and kind == "string":
            return hits.withColumn("__key", F.explode_outer(F.array_distinct(F.filter(F.split(c, r"[\s,]+"), lambda t: t != ""))))
        return hits.withColumn("__key", c)

    def order(self):
        return F.col("__key").desc_nulls_first() if self.reverse else F.col("__key").asc_nulls_last()


@dataclass(frozen=True)
class StoredFieldFacet(FieldFacet):
    """A stored column, split by ``split`` where groups overlap; missing values form the null group."""

    split: str = r"\s+"

    def keyed(self, hits, index):
        c = F.col(f"`{self.field}`").cast("string")
        return hits.withColumn("__key", F.explode_outer(F.split(c, self.split)) if self.overlap else c)


@dataclass(frozen=True)
class QueryFacet(Facet):
    """Named queries: the first that matches, or with overlap all; ``other`` where none does."""

    queries: Mapping[str, Q.Query]
    other: str | None = None
    overlap: bool = False

    def keyed(self, hits, index):
        from quarry.plans.compiler import execute

        flagged = None
        for k, q in enumerate(self.queries.values()):
            rows = execute(q, index).select("doc_id", F.lit(k).alias("k"))
            flagged = rows if flagged is None else flagged.unionAll(rows)
        names = F.array(*[F.lit(n) for n in self.queries])
        found = flagged.groupBy("doc_id").agg(F.array_sort(F.collect_set("k")).alias("__hit"))
        hits = hits.join(found, "doc_id", "left")
        if self.overlap:
            keys = F.coalesce(F.transform("__hit", lambda k: F.get(names, k)), F.array(F.lit(self.other)))
            return hits.withColumn("__key", F.explode(keys)).drop("__hit")
        return hits.withColumn("__key", F.coalesce(F.get(names, F.get("__hit", F.lit(0))), F.lit(self.other))).drop("__hit")


def _steps(start, end, gap, hardend: bool) -> list[tuple]:
    gaps, out, at, k = list(gap) if isinstance(gap, (list, tuple)) else [gap], [], start, 0
    while at < end:
        to = at + gaps[min(k, len(gaps) - 1)]
        out.append((at, min(to, end) if hardend else to))
        at, k = to, k + 1
    return out


@dataclass(frozen=True)
class RangeFacet(Facet):
    """Buckets [start, start + gap) up to end; a list of gaps is used in turn, the last repeats. Outside: the null group."""

    field: str
    start: object
    end: object
    gap: object
    hardend: bool = False

    def keyed(self, hits, index):
        c = F.col(f"`{self.field}`")
        key = F.lit(None)
        if not isinstance(self.gap, (list, tuple)) and isinstance(self.gap, (int, float)) and not self.hardend:
            # even steps by arithmetic, however many buckets there are
            low = F.lit(self.start) + F.floor((c - F.lit(self.start)) / F.lit(self.gap)) * F.lit(self.gap)
            key = F.when((c >= F.lit(self.start)) & (low < F.lit(self.end)), F.struct(low.alias("start"), (low + F.lit(self.gap)).alias("end")))
            return hits.withColumn("__key", key)
        for a, b in reversed(_steps(self.start, self.end, self.gap, self.hardend)):
            key = F.when((c >= F.lit(a)) & (c < F.lit(b)), F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))).otherwise(key)
        return hits.withColumn("__key", key)


@dataclass(frozen=True)
class DateRangeFacet(RangeFacet):
    """As RangeFacet with gaps of timedelta or of ``Months``."""


@dataclass(frozen=True)
class Months:
    """A calendar gap for date ranges."""

    n: int

    def __radd__(self, date: dt.datetime) -> dt.datetime:
        import calendar

        y, m = divmod(date.year * 12 + date.month - 1 + self.n, 12)
        return date.replace(year=y, month=m + 1, day=min(date.day, calendar.monthrange(y, m + 1)[1]))


@dataclass(frozen=True)
class ScoreFacet(Facet):
    def keyed(self, hits, index):
        return hits.withColumn("__key", F.col("score"))

    def order(self):
        return F.col("__key").desc()


@dataclass(frozen=True)
class FunctionFacet(Facet):
    """A function of the results' columns to a Column."""

    fn: Callable[[], Column]

    def keyed(self, hits, index):
        return hits.withColumn("__key", self.fn())


@dataclass(frozen=True)
class TranslateFacet(Facet):
    """A function of other facets' keys."""

    fn: Callable[..., Column]
    facets: tuple[Facet, ...]

    def keyed(self, hits, index):
        for k, f in enumerate(self.facets):
            hits = f.keyed(hits, index).withColumnRenamed("__key", f"__key{k}")
        names = [f"__key{k}" for k in range(len(self.facets))]
        return hits.withColumn("__key", self.fn(*map(F.col, names))).drop(*names)


@dataclass(frozen=True)
class MultiFacet(Facet):
    """The tuple of several facets' keys."""

    facets: tuple[Facet, ...]

    def keyed(self, hits, index):
        for k, f in enumerate(self.facets):
            hits = f.keyed(hits, index).withColumnRenamed("__key", f"__key{k}")
        names = [f"__key{k}" for k in range(len(self.facets))]
        return hits.withColumn("__key", F.struct(*[F.col(n).alias(f"k{i}") for i, n in enumerate(names)])).drop(*names)


def as_facet(x) -> Facet:
    if isinstance(x, Facet):
        return x
    if isinstance(x, str):
        return ScoreFacet() if x == "score" else FieldFacet(x)
    if isinstance(x, Q.Query):
        return QueryFacet({"match": x})
    if isinstance(x, Mapping):
        return QueryFacet(x)
    if isinstance(x, Sequence):
        return MultiFacet(tuple(as_facet(v) for v in x))
    raise TypeError(f"not a facet: {x!r}")


def group(hits: DataFrame, facet: Facet, index, kind: str = "count", top: int | None = None, orderer: Column | None = None) -> DataFrame:
    """key and what is kept per group.

    kind: count (n), list (doc_ids in result order, n), unordered (doc_ids, n), best (doc_id of the first by ``orderer`` or score).
    Lists hold a group's ids in one row; ``top`` keeps the largest groups only.
    """
    keyed = facet.keyed(hits, index)
    order = F.struct(orderer if orderer is not None else (-F.col("score")).alias("o"), F.col("doc_id"))
    made = {
        "count": [F.count(F.lit(1)).alias("n")],
        "list": [F.transform(F.array_sort(F.collect_list(order)), lambda s: s["doc_id"]).alias("doc_ids"), F.count(F.lit(1)).alias("n")],
        "unordered": [F.collect_list("doc_id").alias("doc_ids"), F.count(F.lit(1)).alias("n")],
        "best": [F.min_by("doc_id", order).alias("doc_id"), F.count(F.lit(1)).alias("n")],
    }[kind]
    out = keyed.groupBy(F.col("__key").alias("key")).agg(*made)
    return out.orderBy(F.desc("n"), F.asc_nulls_last("key")).limit(top) if top else out


def discover(schema) -> dict[str, Facet]:
    """A facet for every field that can be grouped by, by its kind."""
    out: dict[str, Facet] = {}
    for name, spec in schema.fields.items():
        if spec.kind in ("keyword", "idlist"):
            out[name] = FieldFacet(name, overlap=True)
        elif spec.kind in ("id", "boolean", "numeric", "datetime"):
            out[name] = FieldFacet(name)
    return out

"""Search over an index: filters, collapsing, sorting, paging, facets and operations on results."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scoring
from quarry.operators import facets as FA
from quarry.operators.index import SearchIndex
from quarry.plans import query as Q
from quarry.plans.compiler import execute, matched_terms


@dataclass
class Results:
    """``hits``: doc_id, score, rank and stored columns in order. ``groups``: one frame per facet, over all matches."""

    hits: DataFrame
    matches: DataFrame
    groups: dict[str, DataFrame] = field(default_factory=dict)
    collapsed: DataFrame | None = None

    def count(self) -> DataFrame:
        return self.matches.agg(F.count(F.lit(1)).alias("n"))

    def doc_ids(self) -> DataFrame:
        return self.hits.select("doc_id", "rank")

    def extend(self, other: Results) -> DataFrame:
        """These hits, then the other's that are not among them."""
        more = other.hits.join(self.hits.select("doc_id"), "doc_id", "left_anti")
        return _reranked([self.hits.withColumn("__part", F.lit(0)), more.withColumn("__part", F.lit(1))])

    def filter(self, other: Results) -> DataFrame:
        """These hits that the other has too, in this order."""
        return _reranked([self.hits.join(other.hits.select("doc_id"), "doc_id", "left_semi").withColumn("__part", F.lit(0))])

    def upgrade(self, other: Results, reverse: bool = False) -> DataFrame:
        """The hits that the other has first (or last)."""
        mark = other.hits.select("doc_id", F.lit(1).alias("__in"))
        part = F.coalesce(F.col("__in"), F.lit(0))
        return _reranked([self.hits.join(mark, "doc_id", "left").withColumn("__part", part if reverse else 1 - part).drop("__in")])

    def upgrade_and_extend(self, other: Results) -> DataFrame:
        """The other's hits that are here first, then the rest of these, then the rest of the other's."""
        mark = other.hits.select("doc_id", F.lit(1).alias("__in"))
        own = self.hits.join(mark, "doc_id", "left").withColumn("__part", F.when(F.col("__in") == 1, 0).otherwise(1)).drop("__in")
        more = other.hits.join(self.hits.select("doc_id"), "doc_id", "left_anti").withColumn("__part", F.lit(2))
        return _reranked([own, more])


def _reranked(parts: Sequence[DataFrame]) -> DataFrame:
    """Union in order of part and rank, ranks anew; hit lists are bounded by their limit."""
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    order = Window.orderBy("__part", "rank")
    return rows.withColumn("__new", F.row_number().over(order) - 1).drop("__part", "rank").withColumnRenamed("__new", "rank")


@dataclass
class Searcher:
    index: SearchIndex
    model: object = field(default_factory=scoring.BM25F)

    def matches(self, q: Q.Query, filter: Q.Query | DataFrame | None = None, mask: Q.Query | DataFrame | None = None) -> DataFrame:
        """doc_id, score of the matches within ``filter`` and outside ``mask``."""
        out = execute(q, self.index, self.model)
        for limits, how in ((filter, "left_semi"), (mask, "left_anti")):
            if limits is not None:
                ids = execute(limits, self.index, scoring.Frequency()) if isinstance(limits, Q.Query) else limits
                out = out.join(ids.select("doc_id"), "doc_id", how)
        return out

    def docs_for_query(self, q: Q.Query) -> DataFrame:
        return execute(q, self.index, scoring.Frequency()).select("doc_id")

    def search(
        self,
        q: Q.Query,
        limit: int | None = 10,
        sortedby=None,
        reverse: bool = False,
        groupedby=None,
        maptype: str = "count",
        collapse=None,
        collapse_limit: int = 1,
        collapse_order=None,
        filter=None,
        mask=None,
        terms: bool = False,
        scored: bool = True,
        offset: int = 0,
        columns: Sequence[str] | None = None,
    ) -> Results:
        """The best matches by score (ties: smaller doc_id), or by ``sortedby`` (a facet, a name or several).

        Facets cover all matches; ``limit`` bounds the hit list only. A document whose collapse key is null is never collapsed.
        """
        found = self.matches(q, filter, mask)
        if not scored:
            found = found.select("doc_id", F.lit(0.0).alias("score"))
        full = found
        needs = sortedby is not None or groupedby is not None or collapse is not None
        if needs:
            full = found.join(self.index.docs, "doc_id")
        keys, full = self._order(full, sortedby, reverse)
        collapsed = None
        if collapse is not None:
            full, collapsed = self._collapse(full, FA.as_facet(collapse), collapse_limit, collapse_order, keys)
        groups = {}
        if groupedby is not None:
            named = groupedby if isinstance(groupedby, Mapping) and not all(isinstance(v, Q.Query) for v in groupedby.values()) else {_name(groupedby): groupedby}
            groups = {n: FA.group(full, FA.as_facet(f), self.index, maptype) for n, f in named.items()}
        # with a limit, keys alone are sorted, and the stored columns join the few rows that are left
        late = needs and limit is not None
        slim = full.select("doc_id", "score", *[c for c in full.columns if c.startswith("__")]) if late else full
        ranked = slim.orderBy(*keys)
        if offset:
            ranked = ranked.offset(offset)
        if limit is not None:
            ranked = ranked.limit(limit)
        top = ranked.withColumn("rank", (F.row_number().over(Window.orderBy(*keys)) - 1 + offset)) if limit is not None else ranked.withColumn("rank", F.lit(None).cast("int"))
        drop = [c for c in top.columns if c.startswith("__")]
        top = top.drop(*drop)
        if late or not needs:
            stored = self.index.docs if columns is None else self.index.docs.select("doc_id", *columns)
            top = top.join(stored, "doc_id")
        if terms:
            top = top.join(matched_terms(q, self.index).withColumnRenamed("terms", "matched_terms"), "doc_id", "left")
        # a join keeps no order: which side is moved depends on the tables' sizes
        return Results(top.orderBy("rank") if limit is not None else top, full, groups, collapsed)

    def _order(self, full: DataFrame, sortedby, reverse: bool):
        if sortedby is None:
            keys = [F.desc("score"), F.asc("doc_id")]
            return ([F.asc("score"), F.desc("doc_id")] if reverse else keys), full
        keys = []
        for i, by in enumerate(sortedby if isinstance(sortedby, (list, tuple)) else [sortedby]):
            facet = FA.as_facet(by)
            full = facet.keyed(full, self.index).withColumnRenamed("__key", f"__o{i}")
            down = getattr(facet, "reverse", False) or isinstance(facet, FA.ScoreFacet)
            down = down != reverse
            keys.append(F.col(f"__o{i}").desc_nulls_first() if down else F.col(f"__o{i}").asc_nulls_last())
        return [*keys, F.desc("doc_id") if reverse else F.asc("doc_id")], full

    def _collapse(self, full, facet, limit, order, keys):
        keyed = facet.keyed(full, self.index).withColumnRenamed("__key", "__collapse")
        by = keys
        if order is not None:
            of = FA.as_facet(order)
            keyed = of.keyed(keyed, self.index).withColumnRenamed("__key", "__corder")
            by = [F.col("__corder").desc_nulls_last() if getattr(of, "reverse", False) or isinstance(of, FA.ScoreFacet) else F.col("__corder").asc_nulls_last(), F.asc("doc_id")]
        # rows without key are never ranked, so the rank's bound reaches the window and no task holds them all
        rows = keyed.where(F.col("__collapse").isNotNull()).withColumn("__r", F.row_number().over(Window.partitionBy("__collapse").orderBy(*by))).where(F.col("__r") <= limit)
        kept = rows.unionByName(keyed.where(F.col("__collapse").isNull()), allowMissingColumns=True)
        counts = keyed.where(F.col("__collapse").isNotNull()).groupBy(F.col("__collapse").alias("key")).agg((F.count(F.lit(1)) - limit).alias("n")).where("n > 0")
        return kept, counts

    def page(self, q: Q.Query, number: int, length: int = 10, **options) -> tuple[Results, DataFrame]:
        """One page (from 1) and its facts: total, pages, offset, last page or not."""
        results = self.search(q, limit=length, offset=(number - 1) * length, **options)
        n = F.col("n")
        facts = results.count().select(n.alias("total"), F.ceil(n / length).cast("long").alias("page_count"), F.lit((number - 1) * length).alias("offset"), (F.lit(number * length) >= n).alias("is_last"))
        return results, facts

    def find(self, default_field: str, text: str, **options) -> Results:
        from quarry.plans.parser import QueryParser

        return self.search(QueryParser(default_field, self.index.schema).parse(text), **options)

    def documents(self, **values) -> DataFrame:
        """Stored documents with exactly these values."""
        out = self.index.docs
        for name, value in values.items():
            out = out.where(F.col(name) == F.lit(value))
        return out

    def document(self, **values) -> DataFrame:
        return self.documents(**values).limit(1)

    def idf(self, name: str, text: str) -> DataFrame:
        stats = self.index.term_stats.where((F.col("field") == name) & (F.col("term") == text)).join(F.broadcast(self.index.field_stats.select("field", "n")), "field")
        return stats.select(scoring.idf(F.col("n"), F.col("df")).alias("idf"))

    def scored_with(self, model) -> Searcher:
        return Searcher(self.index, model)


def _name(x) -> str:
    return x if isinstance(x, str) else getattr(x, "field", None) or type(x).__name__.lower()


# Document-id sets: plain DataFrames of doc_id


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").union(b.select("doc_id")).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").distinct().join(b.select("doc_id"), "doc_id", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").distinct().join(b.select("doc_id"), "doc_id", "left_anti")


def inverse(a: DataFrame, index: SearchIndex) -> DataFrame:
    return difference(index.docs, a)


def bitmaps(ids: DataFrame) -> DataFrame:
    """An id set as bitmaps, one row per bucket of ids."""
    return ids.groupBy(F.bitmap_bucket_number("doc_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("bits"))

"""Ranked search that reads only the postings that can matter: postings in blocks, with bounds on their scores.

Documents are put in order (by chosen columns, then length), numbered, and cut into buckets of equally many. A block is what a
term has in a bucket: one row with its postings, and one in a much smaller table of heads with the largest weight and the
least length in the block, which bound every score in it, and the posting that scores best there, whose score some document
reaches. Buckets lie in zones, which are partitions of the stored table.

A query's tree becomes, over the heads of its terms, an upper bound and a reached score for each bucket. The k-th best reached score of different
buckets is a first threshold: no bucket whose bound is below it holds one of the k best. The best buckets are scored first and raise
the threshold; then those that are left. The rest is never read: zones are pruned as partitions, blocks by their terms and bucket numbers. Answers equal
an exhaustive search, ties included.

With a time limit, buckets are scored in waves by descending bound, and the answer so far is given when time ends, with the bound on all that was not seen.
"""

from __future__ import annotations

import functools
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import scoring
from quarry.operators.index import POSTED, SearchIndex, numbered
from quarry.plans import query as Q
from quarry.plans.compiler import execute, term_condition
from quarry.plans.schema import Schema, ensure_schema
from quarry.streaming.middleware import TimeLimit, within

#: Documents of a bucket, zones of a table, buckets of the first wave, and by how much the next ones grow.
SIZE, ZONES, FIRST, GROWTH = 128, 64, 64, 8
#: Buckets that are named in a condition; beyond, they are joined.
NAMED = 1000
#: Documents whose places are sent to all tasks that place postings; those of more are joined by a shuffle.
BROADCAST = 4_000_000
#: Bounds and scores are sums in different orders: a bucket whose bound is less by no more than this share is read.
SLACK = 1e-9
#: Columns of a posting; a block has an array of each, so that a scan reads those that a query needs.
POST = ("doc_id", "tf", "weight", "dl", "positions")
BLOCKS = "field string, term string, bucket long, doc_id array<long>, tf array<int>, weight array<double>, dl array<int>, positions array<array<int>>, zone int"


class Unbounded(ValueError):
    """A query or model without bounds on its scores: search it exhaustively."""


@dataclass
class Ranked:
    """``hits``: (doc_id, score) of the k best, best first. Where not ``complete``, unseen documents score ``bound`` at most."""

    hits: list[tuple[int, float]]
    complete: bool = True
    bound: float | None = None
    threshold: float | None = None
    buckets: int = 0
    read: int = 0
    waves: list[int] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        """rank, doc_id, score, certain (no unseen document can come before it)."""
        rows = [(k, d, s, self.complete or s > self.bound) for k, (d, s) in enumerate(self.hits)]
        return spark.createDataFrame(rows, "rank int, doc_id long, score double, certain boolean")


@dataclass
class _Bound:
    """Of a subtree in a bucket: whether it can match there, the largest score it can have, and one that some document reaches (or None)."""

    here: Column
    most: Column
    reached: Column | None


def _monotone(model) -> bool:
    """Whether more weight and a shorter field never lower a score."""
    if isinstance(model, scoring.Multi):
        return all(map(_monotone, (model.default, *model.fields.values())))
    return isinstance(model, (scoring.BM25F, scoring.TFIDF, scoring.Frequency))


def _posts(blocks: DataFrame, *columns: str) -> DataFrame:
    """The blocks' postings as rows, with these of their columns."""
    return blocks.select("field", "term", F.inline(F.arrays_zip(*columns)))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a part's postings, by zone, field, term and bucket; terms are sorted once each, postings by their places."""
    table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return

    def code(name: str) -> np.ndarray:
        column = table.column(name).combine_chunks()
        if not pa.types.is_string(column.type):
            return column.to_numpy()
        coded = column.dictionary_encode()
        place = np.empty(len(coded.dictionary), np.int64)
        place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
        return place[coded.indices.to_numpy()]

    keys = {name: code(name) for name in ("zone", "field", "term", "bucket", "doc_id")}
    order = np.lexsort(list(keys.values())[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for name in ("zone", "field", "term", "bucket"):
        held = keys[name][order]
        new[1:] |= held[1:] != held[:-1]
    edges = np.r_[np.flatnonzero(new), len(order)]
    kinds = [c.split()[0] for c in BLOCKS.split(", ")]
    for at in range(0, len(edges) - 1, 8192):
        some = edges[at : at + 8193]
        rows, first = table.take(pa.array(order[some[0] : some[-1]])), pa.array(some[:-1] - some[0])
        lists = {c: pa.ListArray.from_arrays(pa.array(some - some[0], pa.int32()), rows.column(c).combine_chunks()) for c in POST}
        yield pa.RecordBatch.from_arrays([lists[c] if c in lists else rows.column(c).combine_chunks().take(first) for c in kinds], names=kinds)


def _sum(columns: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a + b, columns)


def _all(columns: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, columns)


def _any(columns: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, columns)


class BlockIndex:
    """A stored index with blocked postings, opened from ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: Schema):
        base = spark.read.json(f"{path}/manifest").first()["base"]
        read = lambda name: spark.read.parquet(f"{base}/{name}")
        self.spark, self.blocks, self.heads, self.slots = spark, spark.read.schema(BLOCKS).parquet(f"{base}/blocks"), read("heads"), read("slots")
        self.plain = SearchIndex(ensure_schema(schema), read("docs"), spark.createDataFrame([], "field string"), read("term_stats"), read("field_stats"))

    # Writing

    @classmethod
    def write(cls, index: SearchIndex, path: str, size: int = SIZE, zones: int = ZONES, order: tuple[str, ...] = ()) -> BlockIndex:
        """Stores ``index`` in blocks; ``order`` names columns of its documents that put like ones together (a language, a day, a cluster)."""
        spark, base = index.docs.sparkSession, f"{path}/data-{uuid.uuid4().hex[:8]}"
        lengths = index.postings.groupBy("doc_id").agg(F.max("dl").alias("__dl"), F.count(F.lit(1)).alias("__c"))
        lengths = index.docs.select("doc_id", *order).join(lengths, "doc_id", "left")
        named = {name: f"__o{k}" for k, name in enumerate(order)}
        length = F.greatest(F.coalesce("__dl", F.lit(1)), F.lit(1)).alias("__dl")
        slots = numbered(lengths.select(F.col("doc_id").alias("__id"), length, F.coalesce("__c", F.lit(0)).alias("__c"), *(F.col(n).alias(to) for n, to in named.items())), *named.values(), "__dl", "__id")
        slots = slots.select(F.col("__id").alias("doc_id"), F.floor(F.col("doc_id") / size).cast("long").alias("bucket"), "__c")
        # a part is a stretch of buckets with about POSTED postings, so that none grows with the index
        held = slots.groupBy("bucket").agg(F.sum("__c").alias("__c"))
        total, last = held.agg(F.sum("__c"), F.max("bucket")).first()
        parts = max(spark.sparkContext.defaultParallelism, -(-(total or 0) // POSTED))
        before = F.coalesce(F.sum("__c").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each bucket
        held = held.select("bucket", F.least(F.floor(before * parts / F.lit(max(total or 0, 1))), F.lit(parts - 1)).cast("int").alias("part"))
        slots.join(F.broadcast(held), "bucket").select("doc_id", "bucket", "part").write.parquet(f"{base}/slots")
        slots = spark.read.parquet(f"{base}/slots")
        zone = F.floor(F.col("bucket") * zones / F.lit((last or 0) + 1)).cast("int")
        few = slots.count() <= BROADCAST
        rows = index.postings.join(F.broadcast(slots) if few else slots, "doc_id").select(zone.alias("zone"), "field", "term", "bucket", "part", *POST)
        # a bucket lies in one part, so blocks are whole there
        rows = rows.repartitionById(parts, "part").drop("part")
        rows.mapInArrow(_gathered, BLOCKS).sortWithinPartitions("zone", "field", "term", "bucket").write.partitionBy("zone").parquet(f"{base}/blocks")
        blocks = spark.read.schema(BLOCKS).parquet(f"{base}/blocks")
        sums = lambda c, kind: F.aggregate(c, F.lit(0).cast(kind), lambda a, x: a + x)
        facts = blocks.select("field", "term", F.size("tf").alias("n"), sums("weight", "double").alias("cf"), sums("tf", "long").alias("total"), F.array_max("weight").alias("w"), F.array_min("dl").alias("least"), F.array_max("dl").alias("most"))
        stats = facts.groupBy("field", "term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"), F.max("w").alias("max_weight"), F.min("least").alias("min_length"), F.max("most").alias("max_length"))
        stats.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.parquet(f"{base}/term_stats")
        totals = facts.groupBy("field").agg(F.sum("total").alias("total"), F.min("least").alias("min_length"), F.max("most").alias("max_length"))
        index.docs.write.parquet(f"{base}/docs")
        n = spark.read.parquet(f"{base}/docs").agg(F.count(F.lit(1)).alias("n"))
        totals.join(F.broadcast(n), F.lit(True)).coalesce(1).write.parquet(f"{base}/field_stats")
        cls._heads(blocks, spark.read.parquet(f"{base}/field_stats")).repartitionByRange(parts, "field", "term", "bucket").sortWithinPartitions("field", "term", "bucket").write.parquet(f"{base}/heads")
        spark.createDataFrame([(base,)], "base string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
        return cls(spark, path, index.schema)

    @staticmethod
    def _heads(blocks: DataFrame, field_stats: DataFrame) -> DataFrame:
        """field, term, bucket, zone, n, max_weight, min_length, and weight and length of the posting of the largest impact."""
        mean = F.col("total") / F.col("n")
        impact = lambda w, dl: F.struct((w / (w + 1.2 * (0.25 + 0.75 * dl / F.col("mean")))).alias("impact"), w.alias("weight"), dl.alias("dl"))
        best = F.array_max(F.zip_with("weight", "dl", impact))
        found = blocks.join(F.broadcast(field_stats.select("field", mean.alias("mean"))), "field")
        heads = found.select("field", "term", "bucket", "zone", F.size("weight").alias("n"), F.array_max("weight").alias("max_weight"), F.array_min("dl").alias("min_length"), best.alias("best"))
        return heads.select("field", "term", "bucket", "zone", "n", "max_weight", "min_length", F.col("best.weight").alias("best_weight"), F.col("best.dl").alias("best_length"))

    # Bounds

    def _bound(self, q: Q.Query, model, leaves: list, positive: bool = True) -> _Bound:
        """The bounds of a subtree; registers its terms in ``leaves``."""
        rec = lambda x, m=model: self._bound(x, m, leaves)
        none = F.lit(0.0)
        if isinstance(q, Q.Null):
            return _Bound(F.lit(False), none, None)
        if isinstance(q, Q.Term):
            spec = self.plain.specs.get(q.field)
            if spec is None or not spec[0].indexed or not _monotone(model):
                raise Unbounded(f"no bounds for {q!r} under {model!r}")
            if (q.field, str(q.text), model) not in leaves:
                leaves.append((q.field, str(q.text), model))
            k = leaves.index((q.field, str(q.text), model))
            if q.boost < 0:
                raise Unbounded("a negative boost")
            return _Bound(F.col(f"u{k}").isNotNull(), F.coalesce(F.col(f"u{k}"), none) * q.boost, F.coalesce(F.col(f"l{k}"), none) * q.boost)
        if getattr(q, "boost", 1.0) < 0:
            raise Unbounded("a negative boost")
        if isinstance(q, (Q.Boost, Q.Weighted)):
            part = rec(q.query, getattr(q, "model", None) or model)
            return _Bound(part.here, part.most * q.boost, None if part.reached is None else part.reached * q.boost)
        if isinstance(q, Q.ConstantScore):
            part = rec(q.query)
            if q.score < 0:
                raise Unbounded("a negative score")
            score = F.lit(float(q.score * q.boost))
            return _Bound(part.here, F.when(part.here, score).otherwise(none), F.when(part.here, score).otherwise(none) if part.reached is not None else None)
        if isinstance(q, (Q.Phrase, Q.SpanNear, Q.Ordered)):
            parts = [rec(Q.Term(q.field, w) if isinstance(q, Q.Phrase) else w) for w in (q.words if isinstance(q, Q.Phrase) else q.parts)]
            if isinstance(model, scoring.PositionBoost):
                raise Unbounded("scores that depend on distances")
            return _Bound(_all([p.here for p in parts]), _sum([p.most for p in parts]) * q.boost, None)
        if isinstance(q, (Q.And, Q.Or, Q.DisMax)):
            scored = [p for p in q.parts if not (isinstance(q, Q.And) and isinstance(p, Q.Not))]
            for p in q.parts:
                if p not in scored:
                    self._bound(p.query, model, [])  # matters to no bound, but must be made of terms
            if not scored:
                raise Unbounded("nothing but exclusions")
            parts = [rec(p) for p in scored]
            most, reached = [p.most for p in parts], [p.reached for p in parts]
            if isinstance(q, Q.And):
                lone = len(q.parts) == 1 and reached[0] is not None
                return _Bound(_all([p.here for p in parts]), _sum(most) * q.boost, reached[0] * q.boost if lone else None)
            one = F.greatest(*[r for r in reached if r is not None]) if sum(r is not None for r in reached) > 1 else next((r for r in reached if r is not None), None)
            if isinstance(q, Q.DisMax):
                best = F.greatest(*most) if len(most) > 1 else most[0]
                return _Bound(_any([p.here for p in parts]), (best + q.tiebreak * (_sum(most) - best)) * q.boost, None if one is None else one * q.boost)
            # a document that has one part alone may be too few, and may be scaled down
            sure = one is not None and q.minmatch <= 1 and q.scale is None
            total = _sum(most) if q.scale is None else scoring.coord(_sum(most), F.lit(len(parts)), len(parts), q.scale)
            return _Bound(_any([p.here for p in parts]), total * q.boost, one * q.boost if sure else None)
        if isinstance(q, (Q.AndNot, Q.Require)):
            a, b = rec(q.a), rec(q.b) if isinstance(q, Q.Require) else None
            if b is None:
                self._bound(q.b, model, [])
            return _Bound(a.here & b.here if b else a.here, a.most * q.boost, None)
        if isinstance(q, Q.AndMaybe):
            a, b = rec(q.a), rec(q.b)
            return _Bound(a.here, (a.most + b.most) * q.boost, None if a.reached is None else a.reached * q.boost)
        raise Unbounded(f"no bounds for {type(q).__name__}")

    def bounds(self, q: Q.Query, model=None) -> tuple[DataFrame, bool]:
        """zone, bucket, blocks, most, reached of the buckets that can hold a match, and whether ``reached`` says anything."""
        leaves: list = []
        bound = self._bound(q.normalize(), model or scoring.BM25F(), leaves)
        if not leaves:
            return self.spark.createDataFrame([], "zone int, bucket long, blocks long, most double, reached double"), False
        is_leaf = [(F.col("field") == name) & (F.col("term") == text) for name, text, _ in leaves]
        wanted = _any(is_leaf)
        stats = self.plain.term_stats.where(wanted).join(F.broadcast(self.plain.field_stats.select("field", "total", "n")), "field").select("field", "term", "df", "cf", "total", F.col("n").alias("docs"))
        heads = self.heads.where(wanted).join(F.broadcast(stats), ["field", "term"])  # as many rows as the query has terms

        def score(k: int, weight: str, length: str) -> Column:
            name, _, model = leaves[k]
            scorable = self.plain.specs[name][0].scorable
            dl = F.col(length).cast("double") if scorable else F.lit(None).cast("double")
            got = model.score(scoring.Stats(F.col(weight), dl, F.col("df"), F.col("cf"), F.col("docs").cast("double"), F.col("total").cast("double"), F.col("field")))
            return F.max(F.when(is_leaf[k], got.cast("double")))

        columns = [c for k in range(len(leaves)) for c in (score(k, "max_weight", "min_length").alias(f"u{k}"), score(k, "best_weight", "best_length").alias(f"l{k}"))]
        rows = heads.groupBy("zone", "bucket").agg(F.count(F.lit(1)).alias("blocks"), *columns).where(bound.here)
        reached = F.lit(None).cast("double") if bound.reached is None else bound.reached
        return rows.select("zone", "bucket", "blocks", bound.most.cast("double").alias("most"), reached.alias("reached")), bound.reached is not None

    # Searching

    def view(self, q: Q.Query | None = None, buckets: DataFrame | None = None, zones: list[int] | None = None) -> SearchIndex:
        """An index over the blocks of the query's terms, in the given zones and buckets: no others are read."""
        held = self.blocks
        if zones is not None:
            held = held.where(F.col("zone").isin(zones) if zones else F.lit(False))
        if q is not None:
            names = [term_condition(Q.Term(name, text), self.plain) for name, text in sorted(q.normalize().terms())]
            held = held.where(_any(names) if names else F.lit(False))
        if buckets is not None:
            numbers = [r["bucket"] for r in buckets.select("bucket").limit(NAMED + 1).collect()]
            held = held.where(F.col("bucket").isin(numbers)) if len(numbers) <= NAMED else held.join(buckets.select("bucket"), "bucket", "left_semi")
        placed = q is None or any(isinstance(x, (Q.Phrase, Q.SpanNear, Q.Ordered)) for x in _nodes(q))
        postings = _posts(held, *(POST if placed else POST[:-1]))
        p = self.plain
        return SearchIndex(p.schema, p.docs, postings if placed else postings.withColumn("positions", F.lit(None).cast("array<int>")), p.term_stats, p.field_stats)

    def top_k(self, q: Q.Query, k: int = 10, model=None, seconds: float | None = None, first: int = FIRST) -> Ranked:
        """The k best documents (ties: smaller doc_id), exact unless ``seconds`` are over before all that can matter is read."""
        model, ends = model or scoring.BM25F(), None if seconds is None else time.monotonic() + seconds
        found, sure = self.bounds(q, model)
        found = found.persist(StorageLevel.MEMORY_AND_DISK)
        out = Ranked([], threshold=float("-inf"))
        try:
            total = found.agg(F.count(F.lit(1)), F.max("most")).first()
            out.buckets, out.bound = total[0], total[1]
            if sure:
                reached = [r[0] for r in found.orderBy(F.desc("reached")).limit(k).select("reached").collect()]
                out.threshold = reached[-1] if len(reached) == k else out.threshold
            below, size = None, first
            while out.bound is not None and self._can_matter(out.bound, out.threshold):
                open_ = found.where(self._floor(out.threshold) <= F.col("most"))
                open_ = open_ if below is None else open_.where(F.col("most") < below)
                # with time enough, what the first wave leaves open is read at once
                edge = None if seconds is None and below is not None else open_.orderBy(F.desc("most")).limit(size).agg(F.min("most")).first()[0]
                wave = open_ if edge is None else open_.where(F.col("most") >= edge)
                left = None if ends is None else ends - time.monotonic()
                if left is not None and left <= 0:
                    out.complete = False
                    break
                read = lambda w=wave: self._scored(q, w, k, model)
                try:
                    zones, hits = read() if left is None else within(self.spark, left, read)
                except TimeLimit:
                    out.complete = False
                    break
                out.hits = sorted([*out.hits, *hits], key=lambda h: (-h[1], h[0]))[:k]
                out.threshold = max(out.threshold, out.hits[-1][1]) if len(out.hits) == k else out.threshold
                out.waves.append(zones)
                out.read += zones
                below, size = edge, size * GROWTH
                out.bound = None if edge is None else found.where(F.col("most") < edge).agg(F.max("most")).first()[0]
            if out.complete:
                out.bound = None
        finally:
            found.unpersist()
        return out

    @staticmethod
    def _floor(threshold: float) -> Column:
        return F.lit(threshold - SLACK * abs(threshold) if threshold > float("-inf") else float("-inf"))

    @staticmethod
    def _can_matter(bound: float, threshold: float) -> bool:
        return threshold == float("-inf") or bound >= threshold - SLACK * abs(threshold)

    def _scored(self, q: Q.Query, wave: DataFrame, k: int, model) -> tuple[int, list[tuple[int, float]]]:
        """How many buckets the wave has, and the k best documents in them."""
        per = wave.groupBy("zone").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each zone
        if not per:
            return 0, []
        view = self.view(q, wave, sorted(r["zone"] for r in per))
        rows = execute(q, view, model).orderBy(F.desc("score"), F.asc("doc_id")).limit(k).collect()
        return sum(r["n"] for r in per), [(r["doc_id"], r["score"]) for r in rows]


def _nodes(q: Q.Query):
    yield q
    for c in q.children():
        yield from _nodes(c)


def sizes(index: BlockIndex, q: Q.Query) -> DataFrame:
    """zone, buckets, blocks of a query's terms: what an exhaustive search reads."""
    return index.bounds(q)[0].groupBy("zone").agg(F.count(F.lit(1)).alias("buckets"), F.sum("blocks").alias("blocks"))


__all__ = ["BlockIndex", "Ranked", "Unbounded", "sizes"]

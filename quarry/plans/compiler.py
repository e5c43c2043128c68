"""Query trees to DataFrames of (doc_id, score).

One pass: every leaf gets a number. Postings are filtered once by the leaves' (field, term) conditions, which
reach the parquet scan, and joined with the statistics of the query's exact terms (broadcast: as many rows as
the query has terms). Column conditions add rows from the documents. One aggregation by doc_id then
holds each leaf's score (and positions, where spans need them), and the tree becomes one filter and one
score expression over these columns: one shuffle for any boolean tree.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scoring
from quarry.functions.distance import osa_within
from quarry.plans import query as Q


@dataclass
class Leaf:
    number: int
    query: Q.Query
    model: object
    positions: bool = False
    exact: bool = False
    column: bool = False


@dataclass
class Plan:
    index: object
    model: object
    leaves: list[Leaf] = field(default_factory=list)

    def leaf(self, q: Q.Query, model, positions: bool, exact: bool, column: bool = False) -> Leaf:
        for found in self.leaves:
            if replace(found.query, boost=1.0) == replace(q, boost=1.0) and found.model is model and found.column == column:
                found.positions = found.positions or positions
                return found
        self.leaves.append(Leaf(len(self.leaves), q, model, positions, exact, column))
        return self.leaves[-1]


@dataclass
class Part:
    """What a subtree becomes: whether it matches, its score where it does, its spans on demand."""

    match: Column
    score: Column
    spans: Column | None = None
    #: whether it can match a document that no leaf matches
    open: bool = False


def zero() -> Column:
    return F.lit(0.0)


def term_condition(q: Q.Query, index) -> Column:
    """Condition on postings columns field and term."""
    term, here = F.col("term"), F.col("field") == q.field
    if isinstance(q, Q.Term):
        return here & (term == str(q.text))
    if isinstance(q, Q.Prefix):
        return here & term.startswith(q.text)
    if isinstance(q, Q.Wildcard):
        lead = q.text[: min([q.text.find(c) for c in "*?[" if c in q.text], default=len(q.text))]
        return here & (term.startswith(lead) if lead else F.lit(True)) & term.rlike(f"^(?:{q.pattern()})$")
    if isinstance(q, Q.Regex):
        lead = _literal_lead(q.text)
        return here & (term.startswith(lead) if lead else F.lit(True)) & term.rlike(f"^(?:{q.text})")
    if isinstance(q, Q.Fuzzy):
        lead = q.text[: q.prefix]
        near = F.length(term).between(len(q.text) - q.maxdist, len(q.text) + q.maxdist)
        return here & (term.startswith(lead) if lead else F.lit(True)) & near & osa_within(term, q.text, q.maxdist)
    if isinstance(q, Q.Variations):
        from quarry.functions.morphology import variations

        return here & term.isin(*sorted(variations(q.text)))
    if isinstance(q, Q.TermRange):
        out = here
        if q.start is not None:
            out = out & (term > q.start if q.start_excl else term >= q.start)
        if q.end is not None:
            out = out & (term < q.end if q.end_excl else term <= q.end)
        return out
    if isinstance(q, Q.Every):
        return here
    raise TypeError(f"not a term query: {q!r}")


def lead_condition(q: Q.Query) -> Column:
    """A condition on field and term that all terms of a pattern fulfil and that prunes a scan: its literal beginning."""
    if isinstance(q, Q.Wildcard):
        lead = q.text[: min([q.text.find(c) for c in "*?[" if c in q.text], default=len(q.text))]
    else:
        lead = q.text[: q.prefix] if isinstance(q, Q.Fuzzy) else _literal_lead(q.text)
    here = F.col("field") == q.field
    return here & F.col("term").startswith(lead) if lead else here


def _literal_lead(pattern: str) -> str:
    lead = ""
    for k, c in enumerate(pattern):
        if c in r"\.^$*+?{}[]|()":
            return lead[:-1] if c in "*?{" else "" if c == "|" else lead if "|" not in pattern else ""
        lead += c
    return lead


def column_condition(q: Q.Query) -> Column:
    """Condition on document columns."""
    c = F.col(f"`{q.field}`") if q.field else None
    if isinstance(q, Q.NumericRange):
        out = c.isNotNull()
        if q.start is not None:
            out = out & (c > F.lit(q.start) if q.start_excl else c >= F.lit(q.start))
        if q.end is not None:
            out = out & (c < F.lit(q.end) if q.end_excl else c <= F.lit(q.end))
        return out
    if isinstance(q, Q.ColumnQuery):
        return q.condition(c) if callable(q.condition) else c == F.lit(q.condition)
    if isinstance(q, Q.Term):
        return c == F.lit(q.text)
    if isinstance(q, Q.TermRange):
        return column_condition(Q.NumericRange(q.field, q.start, q.end, q.start_excl, q.end_excl))
    if isinstance(q, Q.Every):
        return c.isNotNull() if q.field else F.lit(True)
    raise TypeError(f"not a column query: {q!r}")


def _span(p: Column) -> Column:
    return F.transform(p, lambda x: F.struct(x.alias("s"), x.alias("e")))


def _hulls(a: Column, b: Column, slop: int, ordered: bool, mindist: int) -> Column:
    """Hulls of pairs of spans whose distance lies in [mindist, slop]."""

    def gap(x: Column, y: Column) -> Column:
        return F.when(y.s > x.e, y.s - x.e).when(x.s > y.e, x.s - y.e).otherwise(0)

    def fits(x: Column, y: Column) -> Column:
        ok = gap(x, y).between(mindist, slop)
        return ok & (x.s <= y.s) if ordered else ok

    def hull(x: Column, y: Column) -> Column:
        return F.struct(F.least(x.s, y.s).alias("s"), F.greatest(x.e, y.e).alias("e"))

    return F.array_distinct(F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: fits(x, y)), lambda y: hull(x, y)))))


def _after(spans: Column):
    """Whether a span begins after one of ``spans`` has ended."""
    first = F.array_min(F.transform(spans, lambda x: x.e))
    return lambda y: first < y.s


def build(q: Q.Query, plan: Plan, model, positions: bool = False) -> Part:
    """The filter, score and spans of a subtree; registers its leaves."""
    index = plan.index
    rec = lambda x, p=positions, m=model: build(x, plan, m, p)
    if isinstance(q, Q.Null):
        return Part(F.lit(False), zero(), F.array().cast("array<struct<s:int,e:int>>"))
    if isinstance(q, Q.Boost):
        part = rec(q.query)
        return replace(part, score=part.score * q.boost)
    if isinstance(q, Q.ConstantScore):
        return replace(rec(q.query), score=F.lit(float(q.score * q.boost)))
    if isinstance(q, Q.Weighted):
        part = rec(q.query, m=q.model or model)
        return replace(part, score=part.score * q.boost)
    if isinstance(q, (Q.Phrase, Q.SpanNear, Q.Ordered)):
        phrase = isinstance(q, Q.Phrase)
        parts = [rec(Q.Term(q.field, w) if phrase else w, True) for w in (q.words if phrase else q.parts)]
        every = functools.reduce(lambda x, y: x & y, [p.match for p in parts])
        spans = parts[0].spans
        for p in parts[1:]:
            if isinstance(q, Q.Ordered):
                spans = F.filter(p.spans, _after(spans))
            else:
                spans = _hulls(spans, p.spans, q.slop, getattr(q, "ordered", True), getattr(q, "mindist", 1))
        spans = F.when(every, spans)
        score = _total([p.score for p in parts]) * q.boost
        if phrase and isinstance(model, scoring.PositionBoost):
            gaps = F.transform(spans, lambda x: (x.e - x.s) / F.lit(max(len(q.words) - 1, 1)))
            score = score + F.coalesce(model.bonus(F.array_min(gaps)), zero())
        return Part(every & F.coalesce(F.size(spans) > 0, F.lit(False)), score, spans)
    if isinstance(q, Q.SpanOr):
        parts = [rec(p, True) for p in q.parts]
        spans = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(p.spans, F.array().cast("array<struct<s:int,e:int>>")) for p in parts])))
        return Part(functools.reduce(lambda x, y: x | y, [p.match for p in parts]), _total([F.when(p.match, p.score).otherwise(zero()) for p in parts]) * q.boost, spans)
    if isinstance(q, Q.SpanFirst):
        part = rec(q.query, True)
        spans = F.filter(part.spans, lambda x: x.e <= q.limit)
        return Part(part.match & (F.size(spans) > 0), part.score * q.boost, spans)
    if isinstance(q, (Q.SpanNot, Q.SpanContains, Q.SpanBefore, Q.SpanCondition)):
        a, b = rec(q.a, True), rec(q.b, True)
        other = F.coalesce(b.spans, F.array().cast("array<struct<s:int,e:int>>"))
        if isinstance(q, Q.SpanNot):
            spans = F.filter(a.spans, lambda x: ~F.exists(other, lambda y: (x.s <= y.e) & (y.s <= x.e)))
            return Part(a.match & (F.size(spans) > 0), a.score * q.boost, spans)
        if isinstance(q, Q.SpanContains):
            spans = F.filter(a.spans, lambda x: F.exists(other, lambda y: (x.s <= y.s) & (y.e <= x.e)))
        elif isinstance(q, Q.SpanBefore):
            spans = F.filter(a.spans, lambda x: x.e < F.array_min(other).s)
        else:
            spans = a.spans
        score = a.score if isinstance(q, Q.SpanCondition) else a.score + b.score
        return Part(a.match & b.match & (F.size(spans) > 0), score * q.boost, spans)
    if isinstance(q, Q.And):
        parts = [rec(p) for p in q.parts]
        return Part(functools.reduce(lambda x, y: x & y, [p.match for p in parts]), _total([p.score for p in parts]) * q.boost, parts[0].spans, all(p.open for p in parts))
    if isinstance(q, Q.Or):
        parts = [rec(p) for p in q.parts]
        hits = [p.match.cast("int") for p in parts]
        count = functools.reduce(lambda x, y: x + y, hits)
        match = count >= max(q.minmatch, 1)
        score = _total([F.when(p.match, p.score).otherwise(zero()) for p in parts])
        if q.scale is not None:
            score = scoring.coord(score, count, len(parts), q.scale)
        spans = None
        if positions:
            none = F.array().cast("array<struct<s:int,e:int>>")
            spans = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(p.spans, none) for p in parts])))
        return Part(match, score * q.boost, spans, any(p.open for p in parts))
    if isinstance(q, Q.DisMax):
        parts = [rec(p) for p in q.parts]
        scores = [F.when(p.match, p.score).otherwise(zero()) for p in parts]
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        score = best + q.tiebreak * (_total(scores) - best)
        return Part(functools.reduce(lambda x, y: x | y, [p.match for p in parts]), score * q.boost, None, any(p.open for p in parts))
    if isinstance(q, Q.AndNot):
        a, b = rec(q.a), rec(q.b, False)
        return Part(a.match & ~b.match, a.score * q.boost, a.spans, a.open)
    if isinstance(q, Q.AndMaybe):
        a, b = rec(q.a), rec(q.b, False)
        return Part(a.match, (a.score + F.when(b.match, b.score).otherwise(zero())) * q.boost, a.spans, a.open)
    if isinstance(q, Q.Require):
        a, b = rec(q.a), rec(q.b, False)
        return Part(a.match & b.match, a.score * q.boost, a.spans, a.open and b.open)
    if isinstance(q, Q.Not):
        part = rec(q.query, False)
        return Part(~part.match, zero(), None, not part.open)
    # leaves
    name = getattr(q, "field", None)
    if isinstance(q, Q.Every) and name is None:
        return Part(F.lit(True), F.lit(float(q.boost)), None, True)
    indexed = name in index.specs and index.specs[name][0].indexed and not isinstance(q, (Q.NumericRange, Q.ColumnQuery))
    if not indexed:
        q = index.typed(q)
        if isinstance(q, Q.Null):
            return rec(q)
        leaf = plan.leaf(q, None, False, False, column=True)
        col = F.col(f"s{leaf.number}")
        return Part(col.isNotNull(), F.lit(float(q.boost)))
    exact = isinstance(q, Q.Term)
    leaf = plan.leaf(q, model if exact else None, positions, exact)
    col = F.col(f"s{leaf.number}")
    spans = _span(F.col(f"p{leaf.number}")) if positions else None
    return Part(col.isNotNull(), (col if exact else F.lit(1.0)) * float(q.boost), spans)


def _total(scores: list[Column]) -> Column:
    return functools.reduce(lambda x, y: x + y, scores)


def _leaf_rows(plan: Plan) -> DataFrame | None:
    """(doc_id, leaf, score, positions) of all leaves' matches."""
    index, rows = plan.index, []
    terms = [x for x in plan.leaves if not x.column]
    spans = any(x.positions for x in plan.leaves)
    if terms:
        conditions = {x.number: term_condition(x.query, index) for x in terms}
        costly = [x for x in terms if isinstance(x.query, (Q.Wildcard, Q.Regex, Q.Fuzzy))]
        reads = {x.number: lead_condition(x.query) if x in costly else conditions[x.number] for x in terms}
        held = index.postings.where(functools.reduce(lambda a, b: a | b, reads.values()))
        if costly:
            # patterns are tested once for each term of the vocabulary, not for each posting
            tests = F.array_compact(F.array(*[F.when(conditions[x.number], F.lit(x.number)) for x in costly]))
            fits = index.term_stats.where(functools.reduce(lambda a, b: a | b, [reads[x.number] for x in costly])).select("field", "term", tests.alias("__fits")).where(F.size("__fits") > 0)
            held = held.join(fits, ["field", "term"], "inner" if len(costly) == len(terms) else "left")
            conditions |= {x.number: F.coalesce(F.array_contains("__fits", x.number), F.lit(False)) for x in costly}
        exact = [x for x in terms if x.exact]
        if exact:
            wanted = functools.reduce(lambda a, b: a | b, [conditions[x.number] for x in exact])
            stats = index.term_stats.where(wanted).join(F.broadcast(index.field_stats.select("field", "total", "n")), "field").select("field", "term", "df", "cf", "total", "n")
            held = held.join(F.broadcast(stats), ["field", "term"], "left")
        hits = []
        for x in terms:
            score = F.lit(1.0)
            if x.exact:
                spec = index.specs[x.query.field][0]
                length = F.col("dl").cast("double") if spec.scorable else F.lit(None).cast("double")
                score = x.model.score(scoring.Stats(F.col("weight"), length, F.col("df"), F.col("cf"), F.col("n").cast("double"), F.col("total").cast("double"), F.col("field")))
            hits.append(F.when(conditions[x.number], F.struct(F.lit(x.number).alias("leaf"), score.cast("double").alias("score"))))
        if len(hits) == 1:
            held = held.select("doc_id", hits[0].alias("hit"), *(["positions"] if spans else [])).where("hit is not null")
        else:
            held = held.select("doc_id", F.explode(F.array_compact(F.array(*hits))).alias("hit"), *(["positions"] if spans else []))
        rows.append(held.select("doc_id", "hit.leaf", "hit.score", *(["positions"] if spans else [])))
    for x in plan.leaves:
        if x.column:
            found = index.docs.where(column_condition(x.query)).select("doc_id", F.lit(x.number).alias("leaf"), F.lit(1.0).alias("score"))
            rows.append(found.withColumn("positions", F.lit(None).cast("array<int>")) if spans else found)
    return functools.reduce(DataFrame.unionAll, rows) if rows else None


def execute(q: Q.Query, index, model=None) -> DataFrame:
    """Matching documents as (doc_id, score)."""
    model = model or scoring.BM25F()
    q = q.normalize()
    nested = _nested(q, index, model)
    if nested is not None:
        return nested
    plan = Plan(index, model)
    part = build(q, plan, model)
    rows = _leaf_rows(plan)
    if rows is None:
        return index.docs.where(part.match).select("doc_id", part.score.cast("double").alias("score"))
    if part.open:
        everyone = index.docs.select("doc_id", F.lit(-1).alias("leaf"), zero().alias("score"))
        rows = rows.unionByName(everyone, allowMissingColumns=True)
    aggregates = [F.max(F.when(F.col("leaf") == x.number, F.col("score"))).alias(f"s{x.number}") for x in plan.leaves]
    aggregates += [F.array_sort(F.flatten(F.collect_list(F.when(F.col("leaf") == x.number, F.col("positions"))))).alias(f"p{x.number}") for x in plan.leaves if x.positions]
    docs = rows.groupBy("doc_id").agg(*aggregates)
    return docs.where(part.match).select("doc_id", F.coalesce(part.score.cast("double"), zero()).alias("score"))


def matched_terms(q: Q.Query, index) -> DataFrame:
    """doc_id and the set of the query's terms found in it, as "field:term"."""
    plan = Plan(index, scoring.Frequency())
    build(q.normalize(), plan, plan.model)
    terms = [x for x in plan.leaves if not x.column]
    if not terms:
        return index.docs.select("doc_id", F.array().cast("array<string>").alias("terms")).limit(0)
    wanted = functools.reduce(lambda a, b: a | b, [term_condition(x.query, index) for x in terms])
    return index.postings.where(wanted).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "field", "term"))).alias("terms"))


def _nested(q: Q.Query, index, model) -> DataFrame | None:
    """Results of subtrees that change the unit of retrieval, joined with the rest."""
    if isinstance(q, Q.Otherwise):
        a = execute(q.a, index, model)
        b = execute(q.b, index, model)
        some = a.limit(1).select(F.lit(1).alias("__some"))
        # b's rows stay only where a is empty: an outer join with at most one row
        kept = b.join(F.broadcast(some), F.lit(True), "left_anti")
        return a.unionByName(kept).select("doc_id", (F.col("score") * q.boost).alias("score"))
    if isinstance(q, Q.NestedParent):
        children = execute(q.query, index, model).join(index.docs.select("doc_id", "parent_id"), "doc_id")
        if q.per_parent:
            best = Window.partitionBy("parent_id").orderBy("doc_id")
            children = children.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= q.per_parent)
        fold = {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg, "count": F.count}[q.fold]
        found = children.groupBy(F.col("parent_id").alias("doc_id")).agg((fold("score") * q.boost).cast("double").alias("score")).where("doc_id is not null")
        return found.join(execute(q.parents, index, model).select("doc_id"), "doc_id", "left_semi")
    if isinstance(q, Q.NestedChildren):
        parents = execute(Q.And((q.parents, q.query)), index, model).select(F.col("doc_id").alias("parent_id"))
        children = index.docs.select("doc_id", "parent_id").where("doc_id <> parent_id")
        return children.join(parents, "parent_id", "left_semi").select("doc_id", F.lit(float(q.boost)).alias("score"))
    special = (Q.Otherwise, Q.NestedParent, Q.NestedChildren)
    if not any(isinstance(x, special) for x in _walk(q)):
        return None
    if isinstance(q, (Q.And, Q.Or)):
        frames = [execute(p, index, model) for p in q.parts]
        if isinstance(q, Q.And):
            out = frames[0]
            for f in frames[1:]:
                out = out.join(f.withColumnRenamed("score", "__s"), "doc_id").select("doc_id", (F.col("score") + F.col("__s")).alias("score"))
        else:
            out = functools.reduce(DataFrame.unionAll, frames).groupBy("doc_id").agg(F.sum("score").alias("score"))
        return out.select("doc_id", (F.col("score") * q.boost).alias("score"))
    if isinstance(q, Q.Wrapper) and not isinstance(q, Q.Not):
        score = F.lit(float(q.score)) if isinstance(q, Q.ConstantScore) else F.col("score") * q.boost
        return execute(q.query, index, getattr(q, "model", None) or model).select("doc_id", score.alias("score"))
    if isinstance(q, Q.Not):
        return index.docs.select("doc_id").join(execute(q.query, index, model), "doc_id", "left_anti").select("doc_id", zero().alias("score"))
    a, b = execute(q.a, index, model), execute(q.b, index, model)
    if isinstance(q, Q.AndNot):
        return a.join(b, "doc_id", "left_anti")
    if isinstance(q, Q.Require):
        return a.join(b, "doc_id", "left_semi")
    if isinstance(q, Q.AndMaybe):
        return a.join(b.withColumnRenamed("score", "__s"), "doc_id", "left").select("doc_id", (F.col("score") + F.coalesce("__s", zero())).alias("score"))
    raise TypeError(f"{type(q).__name__} cannot hold nested queries")


def _walk(q: Q.Query):
    yield q
    for c in q.children():
        yield from _walk(c)

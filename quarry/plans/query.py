"""The query algebra: a tree of frozen nodes, its operators and rewrites."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Query:
    def __and__(self, other: Query) -> Query:
        return And((self, other)).normalize()

    def __or__(self, other: Query) -> Query:
        return Or((self, other)).normalize()

    def __sub__(self, other: Query) -> Query:
        return And((self, Not(other))).normalize()

    def children(self) -> tuple[Query, ...]:
        return ()

    def rebuild(self, children: tuple[Query, ...]) -> Query:
        return self

    def map(self, fn: Callable[[Query], Query]) -> Query:
        """The tree with ``fn`` applied bottom-up."""
        return fn(self.rebuild(tuple(c.map(fn) for c in self.children())))

    def leaves(self) -> Iterator[Query]:
        if self.children():
            for c in self.children():
                yield from c.leaves()
        else:
            yield self

    def terms(self) -> set[tuple[str, str]]:
        """(field, text) of every exact term."""
        out = set()
        for leaf in self.leaves():
            if isinstance(leaf, Term):
                out.add((leaf.field, leaf.text))
            elif isinstance(leaf, Phrase):
                out |= {(leaf.field, w) for w in leaf.words}
        return out

    def replace_term(self, name: str, old: str, new: str) -> Query:
        def one(q: Query) -> Query:
            if isinstance(q, Term) and (q.field, q.text) == (name, old):
                return replace(q, text=new)
            if isinstance(q, Phrase) and q.field == name:
                return replace(q, words=tuple(new if w == old else w for w in q.words))
            return q

        return self.map(one)

    def boosted(self, boost: float) -> Query:
        if boost == 1.0:
            return self
        if any(f.name == "boost" for f in fields(self)):
            return replace(self, boost=self.boost * boost)
        return Boost(self, boost)

    def normalize(self) -> Query:
        return self.map(_simplify)


@dataclass(frozen=True)
class Null(Query):
    """Matches nothing; ``error`` may say why."""

    error: str | None = None


@dataclass(frozen=True)
class Every(Query):
    """All documents, or all with any term (or value) in a field."""

    field: str | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class Term(Query):
    field: str
    text: Any
    boost: float = 1.0


@dataclass(frozen=True)
class Prefix(Query):
    field: str
    text: str
    boost: float = 1.0


@dataclass(frozen=True)
class Wildcard(Query):
    """* is any run of characters, ? any one, [..] a set."""

    field: str
    text: str
    boost: float = 1.0

    def pattern(self) -> str:
        out, k, s = "", 0, self.text
        while k < len(s):
            c = s[k]
            if c == "*":
                out += ".*"
            elif c == "?":
                out += "."
            elif c == "[" and "]" in s[k + 2 :]:
                end = s.index("]", k + 2)
                body = s[k + 1 : end].replace("\\", r"\\")
                out += "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]"
                k = end
            else:
                out += re.escape(c)
            k += 1
        return out


@dataclass(frozen=True)
class Regex(Query):
    """Terms that begin with a match."""

    field: str
    text: str
    boost: float = 1.0


@dataclass(frozen=True)
class Fuzzy(Query):
    """Terms within ``maxdist`` edits (a transposition is one) that share the first ``prefix`` characters."""

    field: str
    text: str
    boost: float = 1.0
    maxdist: int = 1
    prefix: int = 1


@dataclass(frozen=True)
class Variations(Query):
    """English forms of a word."""

    field: str
    text: str
    boost: float = 1.0


@dataclass(frozen=True)
class TermRange(Query):
    field: str
    start: str | None
    end: str | None
    start_excl: bool = False
    end_excl: bool = False
    boost: float = 1.0


@dataclass(frozen=True)
class NumericRange(Query):
    field: str
    start: Any
    end: Any
    start_excl: bool = False
    end_excl: bool = False
    boost: float = 1.0


@dataclass(frozen=True)
class DateRange(NumericRange):
    start: dt.datetime | None
    end: dt.datetime | None


@dataclass(frozen=True)
class ColumnQuery(Query):
    """A value, or a function Column -> boolean Column, on a stored column."""

    field: str
    condition: Any
    boost: float = 1.0


@dataclass(frozen=True)
class Phrase(Query):
    """Words in order, each within ``slop`` positions of the one before."""

    field: str
    words: tuple[str, ...]
    slop: int = 1
    boost: float = 1.0


@dataclass(frozen=True)
class Compound(Query):
    parts: tuple[Query, ...]
    boost: float = 1.0

    def __post_init__(self):
        object.__setattr__(self, "parts", tuple(self.parts))

    def children(self):
        return self.parts

    def rebuild(self, children):
        return replace(self, parts=children)


@dataclass(frozen=True)
class And(Compound):
    pass


@dataclass(frozen=True)
class Or(Compound):
    """``minmatch``: least number of parts that must match. ``scale``: coordination bonus."""

    minmatch: int = 0
    scale: float | None = None


@dataclass(frozen=True)
class DisMax(Compound):
    """The best part's score, plus ``tiebreak`` times the rest."""

    tiebreak: float = 0.0


@dataclass(frozen=True)
class Binary(Query):
    a: Query
    b: Query
    boost: float = 1.0

    def children(self):
        return (self.a, self.b)

    def rebuild(self, children):
        return replace(self, a=children[0], b=children[1])


class AndNot(Binary):
    """a without b."""


class AndMaybe(Binary):
    """a; b only adds to the score."""


class Require(Binary):
    """a where b matches; only a scores."""


class Otherwise(Binary):
    """a, or b if a matches no document at all."""


@dataclass(frozen=True)
class Wrapper(Query):
    query: Query
    boost: float = 1.0

    def children(self):
        return (self.query,)

    def rebuild(self, children):
        return replace(self, query=children[0])


class Not(Wrapper):
    """All documents but those of the query; adds nothing to a score."""


class Boost(Wrapper):
    pass


@dataclass(frozen=True)
class ConstantScore(Wrapper):
    score: float = 1.0


@dataclass(frozen=True)
class Weighted(Wrapper):
    """The query scored by its own model."""

    model: Any = None


@dataclass(frozen=True)
class SpanFirst(Wrapper):
    """Spans that end within the first ``limit`` positions."""

    limit: int = 0


@dataclass(frozen=True)
class SpanNear(Compound):
    """Parts within ``slop`` of each other, folded from the left; ``mindist`` 1 excludes overlap."""

    slop: int = 1
    ordered: bool = True
    mindist: int = 1


class SpanOr(Compound):
    pass


class SpanNot(Binary):
    """Spans of a that overlap none of b."""


class SpanContains(Binary):
    """Spans of a that have a span of b within."""


class SpanBefore(Binary):
    """Spans of a that end before the first span of b."""


class SpanCondition(Binary):
    """Spans of a where b matches too."""


@dataclass(frozen=True)
class Sequence(SpanNear):
    """Any queries near each other in order."""


@dataclass(frozen=True)
class Ordered(Compound):
    """Each part before the next."""


@dataclass(frozen=True)
class NestedParent(Query):
    """Parents of matching children; scores folded by ``fold`` (sum, max, min, avg, count), at most ``per_parent`` children each."""

    parents: Query
    query: Query
    per_parent: int | None = None
    fold: str = "sum"
    boost: float = 1.0

    def children(self):
        return ()


@dataclass(frozen=True)
class NestedChildren(Query):
    """All children of matching parents."""

    parents: Query
    query: Query
    boost: float = 1.0


def boolean(required=(), should=(), prohibited=()) -> Query:
    """Required, optional and prohibited clauses as one query."""
    must, may = And(tuple(required)), Or(tuple(should))
    q: Query = AndMaybe(must, may) if required and should else must if required else may
    return (AndNot(q, Or(tuple(prohibited))) if prohibited else q).normalize()


def _simplify(q: Query) -> Query:
    if isinstance(q, Wildcard):
        if set(q.text) == {"*"}:
            return Every(q.field, q.boost)
        if not re.search(r"[*?\[]", q.text):
            return Term(q.field, q.text, q.boost)
        if q.text.endswith("*") and not re.search(r"[*?\[]", q.text[:-1]):
            return Prefix(q.field, q.text[:-1], q.boost)
    if isinstance(q, Prefix) and not q.text:
        return Every(q.field, q.boost)
    if isinstance(q, Regex) and q.text in ("", ".*"):
        return Every(q.field, q.boost)
    if isinstance(q, Phrase):
        return Null() if not q.words else Term(q.field, q.words[0], q.boost) if len(q.words) == 1 else q
    if type(q) in (And, Or, DisMax):
        parts: list[Query] = []
        for p in q.parts:
            if type(p) is type(q) and not isinstance(q, DisMax) and getattr(p, "minmatch", 0) == 0 and getattr(p, "scale", None) == getattr(q, "scale", None) and getattr(q, "minmatch", 0) == 0:
                parts += [x.boosted(p.boost) for x in p.parts]
            else:
                parts.append(p)
        nulls = [p for p in parts if isinstance(p, Null)]
        parts = list(dict.fromkeys(p for p in parts if not isinstance(p, Null)))
        if isinstance(q, And) and len(parts) > 1:
            parts = [p for p in parts if not (isinstance(p, Every) and p.field is None)] or [Every()]
        if not parts:
            return nulls[0] if nulls else Null()
        if len(parts) == 1 and getattr(q, "minmatch", 0) <= 1 and getattr(q, "scale", None) is None:
            return parts[0].boosted(q.boost)
        return replace(q, parts=tuple(parts))
    if isinstance(q, (AndNot, AndMaybe)) and isinstance(q.b, Null):
        return q.a.boosted(q.boost)
    if isinstance(q, AndMaybe) and isinstance(q.a, Null):
        return q.b.boosted(q.boost)
    if isinstance(q, (AndNot, Require)) and isinstance(q.a, Null):
        return Null()
    if isinstance(q, Require) and isinstance(q.b, Null):
        return Null()
    if isinstance(q, Not) and isinstance(q.query, Null):
        return Every()
    return q


__all__ = [n for n, v in list(globals().items()) if isinstance(v, type) and issubclass(v, Query)] + ["boolean"]

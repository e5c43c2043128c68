"""Excerpts of texts with the query's terms marked.

Plain Python on one text; ``highlight`` applies it to a bounded hit list with an Arrow UDF, after limiting.
``from_places`` analyses no text: it takes the places of the query's terms from postings that keep characters, and cuts, joins and
marks the stored text around them in Column expressions.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import analysis
from quarry.functions.analysis import Analyzer, python_pattern

_WORD = re.compile(python_pattern(analysis.WORD_PATTERN))


@dataclass(frozen=True)
class Mark:
    term: str
    start: int
    end: int
    pos: int


@dataclass(frozen=True)
class Fragment:
    text: str
    start: int
    end: int
    marks: tuple[Mark, ...]

    def score(self) -> float:
        """Matches, times 100 for each distinct term."""
        return len(self.marks) * (100 * len({m.term for m in self.marks}) or 1)


def tokens(text: str, analyzer: Analyzer | None = None) -> list[Mark]:
    """Analysed tokens with offsets; tokens that analysis drops are left out, positions count words."""
    out = []
    for pos, m in enumerate(_WORD.finditer(text)):
        if analyzer is None:
            out.append(Mark(m[0].lower(), m.start(), m.end(), pos))
        else:
            out += [Mark(t, m.start(), m.end(), pos) for t in analyzer.analyze(m[0])]
    return out


def marks_of(text: str, terms: Sequence[str], analyzer: Analyzer | None = None, phrases: Sequence[Sequence[str]] = ()) -> list[Mark]:
    """Tokens that are query terms; with phrases, their words count only inside the phrase."""
    found = tokens(text, analyzer)
    strict = {w for p in phrases for w in p}
    inside: set[int] = set()
    by_pos: dict[int, set[str]] = {}
    for m in found:
        by_pos.setdefault(m.pos, set()).add(m.term)
    order = sorted(by_pos)
    for p in phrases:
        for k in range(len(order) - len(p) + 1):
            if all(w in by_pos[order[k + j]] for j, w in enumerate(p)):
                inside |= set(order[k : k + len(p)])
    wanted = set(terms)
    return [m for m in found if m.pos in inside or m.term in wanted and m.term not in strict]


Fragmenter = Callable[[str, list[Mark]], list[Fragment]]


def whole(text: str, marks: list[Mark]) -> list[Fragment]:
    return [Fragment(text, 0, len(text), tuple(marks))]


def sentences(most: int = 200, ends: str = ".!?") -> Fragmenter:
    """Sentences that hold a match, cut at ``most`` characters."""

    def run(text: str, marks: list[Mark]) -> list[Fragment]:
        out, start = [], 0
        for m in [*re.finditer(f"[{re.escape(ends)}]+", text), None]:
            end = m.end() if m else len(text)
            inner = tuple(x for x in marks if start <= x.start and x.end <= min(end, start + most))
            if inner:
                lead = len(text[start:end]) - len(text[start:end].lstrip())
                out.append(Fragment(text, start + lead, min(end, start + lead + most), inner))
            start = end
        return out

    return run


def context(most: int = 200, surround: int = 20) -> Fragmenter:
    """Matches with up to ``surround`` characters of whole words around, near ones in one fragment of at most ``most``."""

    def run(text: str, marks: list[Mark]) -> list[Fragment]:
        words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        out: list[Fragment] = []
        k = 0
        while k < len(marks):
            first = marks[k]
            start = min((a for a, _ in words if first.start - surround <= a <= first.start), default=first.start)
            if out and start < out[-1].end:
                start = min((a for a, _ in words if a >= out[-1].end), default=first.start)
            inner, last = [first], first.end
            k += 1
            while k < len(marks) and marks[k].start <= last + surround and marks[k].end - start <= most:
                inner.append(marks[k])
                last = marks[k].end
                k += 1
            end = max((b for _, b in words if b <= min(last + surround, max(start + most, last))), default=last)
            out.append(Fragment(text, start, max(end, last), tuple(inner)))
        return out

    return run


def pinpoint(most: int = 200, surround: int = 20, autotrim: bool = False) -> Fragmenter:
    """As context, but to the character; ``autotrim`` cuts back to white space."""

    def run(text: str, marks: list[Mark]) -> list[Fragment]:
        out = []
        for f in context(most, 0)(text, marks):
            start, end = max(0, f.start - surround), min(len(text), f.end + surround)
            if autotrim:
                if start and (m := re.search(r"\s", text[start : f.start])):
                    start += m.end()
                if end < len(text) and (m := re.search(r"\s\S*$", text[f.end : end])):
                    end = f.end + m.start()
            out.append(Fragment(text, start, end, f.marks))
        return out

    return run


ORDERS: dict[str, Callable[[Fragment], object]] = {"first": lambda f: f.start, "score": lambda f: 0, "longer": lambda f: -(f.end - f.start), "shorter": lambda f: f.end - f.start}


def top_fragments(fragments: list[Fragment], count: int = 3, order: str = "first", least: float = 1) -> list[Fragment]:
    best = sorted((f for f in fragments if f.score() >= least), key=lambda f: -f.score())[:count]
    return sorted(best, key=ORDERS[order])


Formatter = Callable[[list[Fragment]], str]


def formatter(mark: Callable[[str, Mark, dict], str], plain: Callable[[str], str] = lambda s: s, between: str = "...") -> Formatter:
    def run(fragments: list[Fragment]) -> str:
        seen: dict[str, int] = {}
        parts = []
        for f in fragments:
            out, at = "", f.start
            for m in f.marks:
                if m.start < at:
                    continue
                out += plain(f.text[at : m.start]) + mark(f.text[m.start : m.end], m, seen)
                at = m.end
            parts.append(out + plain(f.text[at : f.end]))
        return between.join(parts)

    return run


def null_format(between: str = "...") -> Formatter:
    return formatter(lambda s, m, seen: s, between=between)


def uppercase(between: str = "...") -> Formatter:
    return formatter(lambda s, m, seen: s.upper(), between=between)


def html_format(tag: str = "strong", between: str = "...", css: str = "match", term_css: str = "term", classes: int = 5) -> Formatter:
    """<tag class="match termN">, N numbering the distinct terms, texts escaped."""

    def mark(s: str, m: Mark, seen: dict) -> str:
        n = seen.setdefault(m.term, len(seen)) % classes
        return f'<{tag} class="{css} {term_css}{n}">{html.escape(s)}</{tag}>'

    return formatter(mark, lambda s: html.escape(s, quote=False), between)


def excerpt(text: str | None, terms: Sequence[str], analyzer: Analyzer | None = None, fragmenter: Fragmenter | None = None, format: Formatter | None = None, top: int = 3, order: str = "first", phrases=(), least: float = 1) -> str:
    """The best fragments of a text, formatted; empty without a match."""
    if not text:
        return ""
    fragments = (fragmenter or context())(text, marks_of(text, terms, analyzer, phrases))
    return (format or html_format())(top_fragments(fragments, top, order, least))


def highlight(hits: DataFrame, column: str, query, field: str, analyzer: Analyzer | None = None, out: str = "highlight", **options) -> DataFrame:
    """A hit list with excerpts of ``column`` for the query's terms in ``field``."""
    from quarry.plans.query import Phrase

    terms = sorted(t for f, t in query.terms() if f == field)
    phrases = [q.words for q in query.leaves() if isinstance(q, Phrase) and q.field == field]

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: excerpt(t, terms, analyzer or analysis.standard(), phrases=phrases, **options))

    return hits.withColumn(out, run(F.col(column)))


_PLACE = "array<struct<start: int, end: int, pos: int, term: int>>"
_FRAGMENT = "array<struct<a: int, b: int, n: int, terms: array<int>>>"


def places(index, query, field: str, ids: DataFrame) -> DataFrame:
    """doc_id and ``places`` (start, end, pos, number of the term; by start) of the query's terms in the documents of ``ids``.

    Words of phrases count only where the whole phrase stands. The field must keep characters (TEXT(characters=True)).
    """
    from quarry.plans.query import Phrase

    if not index.specs[field][0].options.get("characters"):
        raise ValueError(f"{field!r} keeps no characters")
    terms = sorted(str(t) for f, t in query.terms() if f == field)
    phrases = [q.words for q in query.leaves() if isinstance(q, Phrase) and q.field == field]
    strict = {w for p in phrases for w in p}
    held = index.postings.where((F.col("field") == field) & F.col("term").isin(terms) if terms else F.lit(False)).join(ids.select("doc_id"), "doc_id", "left_semi")
    spots = [_spots(k) for k in range(len(terms))]
    none = F.array().cast(_PLACE)
    of = held.groupBy("doc_id").agg(*[F.coalesce(F.max(F.when(F.col("term") == t, spots[k])), none).alias(f"t{k}") for k, t in enumerate(terms)], F.lit(0).alias("__"))
    number = {t: k for k, t in enumerate(terms)}
    found = []
    for t, k in number.items():
        column = F.col(f"t{k}")
        if t in strict:
            inside = F.flatten(F.array(*[_inside(p, number) for p in phrases]))
            column = F.filter(column, _at(inside))
        found.append(column)
    return of.select("doc_id", (F.array_sort(F.concat(*found)) if found else none).alias("places"))


def _spots(k: int) -> Column:
    """The places of a posting of the k-th term."""
    return F.transform(F.arrays_zip("starts", "ends", "positions"), lambda x: F.struct(x["starts"].alias("start"), x["ends"].alias("end"), x["positions"].alias("pos"), F.lit(k).alias("term")))


def _at(positions: Column) -> Callable[[Column], Column]:
    return lambda x: F.array_contains(positions, x["pos"])


def _inside(words: Sequence[str], number: dict[str, int]) -> Column:
    """The positions that whole occurrences of a phrase take."""
    at = [F.transform(F.col(f"t{number[w]}"), lambda x: x["pos"]) for w in words]
    begins = F.filter(at[0], lambda p: functools.reduce(lambda a, b: a & b, [F.array_contains(at[j], p + j) for j in range(1, len(words))], F.lit(True)))
    return F.flatten(F.transform(begins, lambda p: F.sequence(p, p + len(words) - 1)))


def from_places(hits: DataFrame, index, query, field: str, column: str, out: str = "highlight", surround: int = 40, top: int = 3, before: str = "<strong>", after: str = "</strong>", between: str = "...") -> DataFrame:
    """A hit list with excerpts of ``column`` from the places that postings keep; an empty one without a match.

    A fragment is a place with ``surround`` characters on both sides; fragments that touch are one. The ``top`` best (places, times 100
    for each distinct term; ties: the first) stand in their order in the text.
    """
    rows = hits.join(places(index, query, field, hits).withColumnRenamed("places", "__places"), "doc_id", "left")
    rows = rows.withColumn("__places", F.coalesce("__places", F.array().cast(_PLACE)))
    length = F.length(F.col(column))

    def merged(done: Column, p: Column) -> Column:
        a, b = F.greatest(p["start"] - surround, F.lit(0)), F.least(p["end"] + surround, length)
        last, rest = F.get(done, F.size(done) - 1), F.slice(done, F.lit(1), F.size(done) - 1)
        new = F.struct(a.alias("a"), b.alias("b"), F.lit(1).alias("n"), F.array(p["term"]).alias("terms"))
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], b).alias("b"), (last["n"] + 1).alias("n"), F.array_union(last["terms"], F.array(p["term"])).alias("terms"))
        return F.when(F.size(done) == 0, F.array(new)).when(a > last["b"], F.concat(done, F.array(new))).otherwise(F.concat(rest, F.array(longer))).cast(_FRAGMENT)

    rows = rows.withColumn("__fragments", F.aggregate("__places", F.array().cast(_FRAGMENT), merged))
    score = lambda f: f["n"] * 100 * F.size(f["terms"])
    best = F.slice(F.array_sort(F.transform("__fragments", lambda f: F.struct((-score(f)).alias("s"), f["a"].alias("a"), f["b"].alias("b")))), 1, top)
    rows = rows.withColumn("__fragments", F.array_sort(F.transform(best, lambda f: F.struct(f["a"].alias("a"), f["b"].alias("b")))))
    cut = lambda a, b: _escaped(F.substring(F.col(column), a + 1, b - a))

    def text(f: Column) -> Column:
        def step(done: Column, p: Column) -> Column:
            more = F.concat(done["out"], cut(done["at"], p["start"]), F.lit(before), cut(p["start"], p["end"]), F.lit(after))
            return F.when(p["start"] < done["at"], done).otherwise(F.struct(p["end"].alias("at"), more.alias("out")))

        inner = F.filter("__places", lambda p: (p["start"] >= f["a"]) & (p["end"] <= f["b"]))
        begin = F.struct(f["a"].alias("at"), F.lit("").alias("out"))
        return F.aggregate(inner, begin, step, lambda d: F.concat(d["out"], cut(d["at"], f["b"])))

    return rows.withColumn(out, F.array_join(F.transform("__fragments", text), between)).drop("__places", "__fragments")


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

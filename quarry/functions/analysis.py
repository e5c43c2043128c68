"""Text analysis as Column expressions.

A tokenizer turns a string Column into an array of terms; filters turn term arrays into term arrays. All
of it stays in Spark's generated code except stemming and phonetics, which are Arrow UDFs that see each
distinct term once per batch. The same chain runs on Python strings (``analyze``) for query text.

Positions count the kept terms. The first kept term keeps its raw index, the following ones count
up by one, so phrases cross removed stop words.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters, digits, underscore and asterisk, joined by single dots; the same in Java, RE2 and Python.
WORD_PATTERN = r"[\p{L}\p{N}_*]+(?:\.?[\p{L}\p{N}_*]+)*"

#: English words that standard analysis drops.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "from", "have", "if", "in", "is", "it", "may",
    "not", "of", "on", "or", "tbd", "that", "the", "this", "to", "us", "we", "when", "will", "with", "yet", "you", "your",
)


def python_pattern(pattern: str) -> str:
    r"""A Java/RE2 pattern for Python's re: letters, numbers and underscore together are \w."""
    return pattern.replace(r"\p{L}\p{N}_", r"\w").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")


@dataclass(frozen=True)
class Stage:
    """One step: on Columns, and on Python values (a string for tokenizers, a list of terms for filters)."""

    column: Callable[[Column], Column]
    python: Callable
    tokenizer: bool = False
    #: whether it lower-cases each term and does nothing else
    lower: bool = False
    #: of a tokenizer: the first and last character of each word of a text, in code points
    spans: Callable[[str], list[tuple[int, int]] | np.ndarray] | None = None

    def __or__(self, other: Stage) -> Analyzer:
        return Analyzer((self, other))


class Analyzer:
    """A tokenizer followed by filters, composed with ``|``."""

    def __init__(self, stages: Sequence[Stage]):
        if not stages or not stages[0].tokenizer or any(s.tokenizer for s in stages[1:]):
            raise ValueError("an analyzer is one tokenizer followed by filters")
        self.stages = tuple(stages)

    def __or__(self, other: Stage) -> Analyzer:
        return Analyzer((*self.stages, other))

    def terms(self, text: Column) -> Column:
        """array<string> of kept terms; null text gives an empty array."""
        out = F.coalesce(text, F.lit(""))
        for stage in self.stages:
            out = stage.column(out)
        return out

    def tokens(self, text: Column) -> Column:
        """array<struct<term, pos>>."""
        kept, first = self.terms(text), self.first_position(text)
        places = F.when(F.size(kept) > 0, F.sequence(first, first + F.size(kept) - 1)).otherwise(F.array().cast("array<int>"))
        return F.zip_with(kept, places, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))

    def first_position(self, text: Column) -> Column:
        """Position of the first kept term: the raw index of the first term that the first dropping filter keeps."""
        raw = self.stages[0].column(F.coalesce(text, F.lit("")))
        for stage in self.stages[1:]:
            keep = getattr(stage.column, "keeps", None)
            if keep is not None:
                return F.greatest(F.array_position(F.transform(raw, lambda t: keep(F.lower(t))), F.lit(True)) - 1, F.lit(0)).cast("int")
        return F.lit(0)

    def split(self) -> tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[Column], Column]] | None:
        """The analyzer as three functions: raw terms of a text, those that its dropping filter keeps, and what the rest makes of them.

        Only where nothing but lower-casing stands before the filter: then a caller computes the raw terms once and finds the first
        position in them. Else None.
        """
        at = next((k for k, x in enumerate(self.stages) if hasattr(x.column, "keeps")), 0)
        if not at or not all(x.lower for x in self.stages[1:at]):
            return None
        run = lambda stages: lambda c: functools.reduce(lambda v, x: x.column(v), stages, c)
        return lambda text: run(self.stages[:at])(F.coalesce(text, F.lit(""))), self.stages[at].column, run(self.stages[at + 1 :])

    def keeps(self) -> Callable[[Column], Column]:
        """The test of the dropping filter, for a raw term as ``split`` gives it."""
        return next(x.column.keeps for x in self.stages if hasattr(x.column, "keeps"))

    def analyze(self, text: str) -> list[str]:
        out = text or ""
        for stage in self.stages:
            out = stage.python(out)
        return out


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once: an expression named inside a lambda would be computed anew for each element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


# Tokenizers


@functools.cache
def _word_characters() -> np.ndarray:
    """Whether each code point may stand in a word."""
    one = re.compile(python_pattern(r"[\p{L}\p{N}_*]"))
    return np.fromiter((one.match(chr(c)) is not None for c in range(0x110000)), bool, 0x110000)


def word_spans(text: str) -> np.ndarray:
    """First and last character of each match of WORD_PATTERN: runs of its characters and of single dots between two of them."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _word_characters()[codes]
    dots = np.flatnonzero(codes[1:-1] == ord(".")) + 1
    inside[dots] = inside[dots - 1] & inside[dots + 1]
    return np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8))).reshape(-1, 2)


def id_tokenizer() -> Stage:
    return Stage(lambda c: F.array(c), lambda s: [s], True, spans=lambda s: [(0, len(s))])


def regex_tokenizer(pattern: str = WORD_PATTERN, gaps: bool = False) -> Stage:
    compiled = re.compile(python_pattern(pattern))
    words = word_spans if pattern == WORD_PATTERN and not gaps else lambda s: [m.span() for m in compiled.finditer(s)]
    if gaps:
        between = lambda s: [(a, b) for a, b in zip([0, *(e for _, e in words(s))], [*(a for a, _ in words(s)), len(s)]) if a < b]
        return Stage(lambda c: F.filter(F.split(c, pattern), lambda t: t != ""), lambda s: [t for t in compiled.split(s) if t], True, spans=between)
    return Stage(lambda c: F.regexp_extract_all(c, F.lit(pattern), 0), lambda s: [m[0] for m in compiled.finditer(s)], True, spans=words)


def space_tokenizer() -> Stage:
    return regex_tokenizer(r"[^ \t\r\n]+")


def comma_tokenizer() -> Stage:
    return Stage(lambda c: F.filter(F.transform(F.split(c, ","), lambda t: F.trim(t)), lambda t: t != ""), lambda s: [t.strip() for t in s.split(",") if t.strip()], True)


def charset_tokenizer(charmap: dict[str, str | None]) -> Stage:
    """Characters mapped to None (or missing) separate tokens, others are replaced by their image."""
    known = "".join(re.escape(c) for c, to in charmap.items() if to)
    source = "".join(c for c, to in charmap.items() if to and len(to) == 1)
    target = "".join(to for to in charmap.values() if to and len(to) == 1)
    pattern = f"[{known}]+"
    table = str.maketrans({c: to for c, to in charmap.items() if to})
    return Stage(lambda c: F.transform(F.regexp_extract_all(c, F.lit(pattern), 0), lambda t: F.translate(t, source, target)), lambda s: [t.translate(table) for t in re.findall(pattern, s)], True)


def path_tokenizer(pattern: str = "[^/]+") -> Stage:
    """/a/b/c gives /a, /a/b and /a/b/c."""

    def steps(parts: Column) -> Column:
        upto = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
        return F.transform(upto, lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))

    def column(c: Column) -> Column:
        return let(F.regexp_extract_all(c, F.lit(pattern), 0), steps)

    def python(s: str) -> list[str]:
        parts = re.findall(pattern, s)
        return ["/" + "/".join(parts[: i + 1]) for i in range(len(parts))]

    return Stage(column, python, True)


def _grams(c: Column, low: int, high: int) -> Column:
    n = F.length(c)
    starts = F.when(n >= low, F.sequence(F.lit(1), n - (low - 1))).otherwise(F.array().cast("array<int>"))
    sizes = F.array(*[F.lit(k) for k in range(low, high + 1)])
    per = F.transform(starts, lambda i: F.transform(F.filter(sizes, lambda k: i + k - 1 <= n), lambda k: F.substring(c, i, k)))
    return F.flatten(per)


def _py_grams(s: str, low: int, high: int) -> list[str]:
    return [s[i : i + k] for i in range(len(s)) for k in range(low, high + 1) if i + k <= len(s)]


def ngram_tokenizer(low: int, high: int | None = None) -> Stage:
    """All character n-grams of low to high characters, by start and size."""
    high = high or low

    def grams(chars: Column) -> Column:
        n = F.size(chars)
        starts = F.when(n >= low, F.sequence(F.lit(1), n - (low - 1))).otherwise(F.array().cast("array<int>"))
        sizes = F.array(*[F.lit(k) for k in range(low, high + 1)])
        return F.flatten(F.transform(starts, lambda i: F.transform(F.filter(sizes, lambda k: i + k - 1 <= n), lambda k: F.array_join(F.slice(chars, i, k), ""))))

    def column(c: Column) -> Column:
        # over an array of characters: a slice of a long text is found at once, a substring by counting from its start
        return let(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), grams)

    return Stage(column, lambda s: _py_grams(s, low, high), True)


# Filters


def _map(column: Callable[[Column], Column], python: Callable[[str], str]) -> Stage:
    return Stage(lambda a: F.transform(a, column), lambda ts: [python(t) for t in ts])


def lowercase() -> Stage:
    return replace(_map(F.lower, str.lower), lower=True)


def strip() -> Stage:
    return _map(lambda t: F.regexp_replace(t, r"^[\s\u00a0]+|[\s\u00a0]+$", ""), str.strip)


def reverse() -> Stage:
    return _map(F.reverse, lambda t: t[::-1])


def passthrough() -> Stage:
    return Stage(lambda a: a, list)


def by_mode(index: Stage, query: Stage) -> Stage:
    """One filter for documents, another for query texts: columns are documents, Python values are queries."""
    return Stage(index.column, query.python, index.tokenizer)


def logging_filter(logger=None) -> Stage:
    """Passes terms on and logs those of query texts at debug level."""
    import logging

    to = logger or logging.getLogger("quarry.analysis")

    def python(ts: list[str]) -> list[str]:
        to.debug("%s", ts)
        return list(ts)

    return Stage(lambda a: a, python)


def stop(words: Sequence[str] = STOP_WORDS, least: int = 2, most: int | None = None) -> Stage:
    """Drops stop words and terms shorter than ``least`` or longer than ``most``."""
    listed = frozenset(words)

    def keeps(t: Column) -> Column:
        ok = F.length(t) >= least
        if most:
            ok = ok & (F.length(t) <= most)
        return ok & ~t.isin(*sorted(listed)) if listed else ok

    def column(a: Column) -> Column:
        return F.filter(a, keeps)

    column.keeps = keeps
    return Stage(column, lambda ts: [t for t in ts if len(t) >= least and (not most or len(t) <= most) and t not in listed])


def charset(charmap: dict[str, str]) -> Stage:
    """Folds characters; images of more than one character by replacement."""
    single = {c: to for c, to in charmap.items() if len(to) == 1}
    longer = {c: to for c, to in charmap.items() if len(to) != 1}

    def column(t: Column) -> Column:
        if single:
            t = F.translate(t, "".join(single), "".join(single.values()))
        for c, to in longer.items():
            t = F.replace(t, F.lit(c), F.lit(to))
        return t

    return _map(column, lambda t: t.translate(str.maketrans(charmap)))


def substitution(pattern: str, replacement: str) -> Stage:
    java = re.sub(r"\\(\d)", r"$\1", replacement)
    return _map(lambda t: F.regexp_replace(t, pattern, java), lambda t: re.sub(python_pattern(pattern), replacement, t))


def delimited_attribute(delimiter: str = "^") -> Stage:
    """word^2.0 gives word; ``boosts`` of the raw terms gives the numbers."""
    return _map(lambda t: F.substring_index(t, delimiter, 1), lambda t: t.split(delimiter, 1)[0])


def boosts(terms: Column, delimiter: str = "^", default: float = 1.0) -> Column:
    return F.transform(terms, lambda t: F.coalesce(F.element_at(F.split(t, re.escape(delimiter)), 2).try_cast("double") if hasattr(Column, "try_cast") else F.lit(None), F.lit(default)))


def shingle(size: int = 2, sep: str = "-") -> Stage:
    """Runs of ``size`` neighbouring terms joined; fewer terms are joined whole."""

    def runs(a: Column) -> Column:
        n = F.size(a)
        found = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(a, i, F.lit(size)), sep))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(found)

    def column(a: Column) -> Column:
        return let(a, runs)

    return Stage(column, lambda ts: [sep.join(ts[i : i + size]) for i in range(max(len(ts) - size + 1, 1))] if ts else [])


def biword(sep: str = "-") -> Stage:
    return shingle(2, sep)


def tee(*chains: Sequence[Stage]) -> Stage:
    """The outputs of several chains of filters, term by term where they are equally long, else one after another."""

    def run(value, attribute):
        outs = []
        for chain in chains:
            out = value
            for stage in [chain] if isinstance(chain, Stage) else chain:
                out = getattr(stage, attribute)(out)
            outs.append(out)
        return outs

    def python(ts):
        outs = run(ts, "python")
        return [t for row in zip(*outs) for t in row] if len({len(o) for o in outs}) == 1 else [t for o in outs for t in o]

    def woven(all_: Column) -> Column:
        outs = [F.get(all_, F.lit(k)) for k in range(len(chains))]
        same = functools.reduce(lambda x, y: x & y, [F.size(o) == F.size(outs[0]) for o in outs[1:]], F.lit(True))
        return F.when(same, F.flatten(F.transform(outs[0], lambda t, i: F.array(t, *[F.get(o, i) for o in outs[1:]])))).otherwise(F.flatten(all_))

    def column(a: Column) -> Column:
        return let(F.array(*run(a, "column")), woven)

    return Stage(column, python)


def ngram_filter(low: int, high: int | None = None, at: str | None = None) -> Stage:
    """n-grams of each term: all, or those at its start or end."""
    high = high or low

    def edge(t: Column) -> Column:
        sizes = F.filter(F.array(*[F.lit(k) for k in range(low, high + 1)]), lambda k: k <= F.length(t))
        if at == "start":
            return F.transform(sizes, lambda k: F.substring(t, F.lit(1), k))
        return F.transform(sizes, lambda k: F.substring(t, F.length(t) - k + 1, k))

    def python(ts):
        if at is None:
            return [g for t in ts for g in _py_grams(t, low, high)]
        return [t[:k] if at == "start" else t[len(t) - k :] for t in ts for k in range(low, high + 1) if k <= len(t)]

    return Stage(lambda a: F.flatten(F.transform(a, edge if at else lambda t: _grams(t, low, high))), python)


def intraword(split_words: bool = True, split_numbers: bool = True, merge_words: bool = False, merge_numbers: bool = False) -> Stage:
    """Splits terms at case changes, between letters and digits and at punctuation; merging adds the joined parts."""
    cuts = [r"[^\p{L}\p{N}]+"]
    if split_words:
        cuts.append(r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")
    if split_numbers:
        cuts.append(r"(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
    pattern = "|".join(cuts)

    def parts(t: Column) -> Column:
        return let(F.filter(F.split(t, pattern), lambda p: p != ""), merged)

    def merged(out: Column) -> Column:
        if merge_words or merge_numbers:
            words = F.filter(out, lambda p: p.rlike(r"^\p{L}+$"))
            digits = F.filter(out, lambda p: p.rlike(r"^\p{N}+$"))
            extra = [F.when(F.size(x) > 1, F.array(F.array_join(x, ""))).otherwise(F.array().cast("array<string>")) for x, on in ((words, merge_words), (digits, merge_numbers)) if on]
            out = F.concat(out, *extra)
        return out

    import regex

    compiled = regex.compile(pattern, regex.V1)

    def python(ts):
        out = []
        for t in ts:
            found = [p for p in compiled.split(t) if p]
            for on, test in ((merge_words, str.isalpha), (merge_numbers, str.isdigit)):
                runs = [p for p in found if test(p)]
                if on and len(runs) > 1:
                    found = [*found, "".join(runs)]
            out += found
        return out

    return Stage(lambda a: F.flatten(F.transform(a, parts)), python)


def compound_words(words: Sequence[str], keep: bool = True) -> Stage:
    """Splits terms into dictionary words where they cover the whole term, longest first."""
    listed = frozenset(words)

    def split(t: str) -> tuple[str, ...]:
        if t in listed:
            return (t,)
        for k in range(len(t) - 1, 0, -1):
            if t[:k] in listed and (rest := split(t[k:])):
                return (t[:k], *rest)
        return ()

    def python(ts):
        out = []
        for t in ts:
            found = split(t)
            out += ([t] if keep or not found else []) + (list(found) if len(found) > 1 else [])
        return out

    return Stage(_array_udf(python), python)


def term_udf(fn: Callable[[str], str]) -> Stage:
    """A filter from a Python function of one term, in Arrow batches, each distinct term once per process."""
    cached = _Cached(fn)
    return Stage(_array_udf(cached), cached)


class _Cached:
    """A function of one term over lists of terms; what it has seen stays in the process, not in its pickle."""

    def __init__(self, fn: Callable[[str], str]):
        self.fn, self.seen = fn, {}

    def __getstate__(self):
        return {"fn": self.fn, "seen": {}}

    def __call__(self, terms: list[str]) -> list[str]:
        seen = self.seen
        for t in terms:
            if t not in seen:
                if len(seen) >= 200_000:
                    seen.clear()
                seen[t] = self.fn(t)
        return [seen[t] if t in seen else self.fn(t) for t in terms]


def _array_udf(fn: Callable[[list[str]], list[str]]):
    def column(a: Column) -> Column:
        @F.pandas_udf("array<string>")
        def run(arrays: pd.Series) -> pd.Series:
            return arrays.map(lambda ts: fn(list(ts)) if ts is not None else None)

        return run(a)

    return column


def stem(language: str = "en", ignore: Sequence[str] = ()) -> Stage:
    from quarry.functions.stemming import stemmer_for

    fn, kept = stemmer_for(language), frozenset(ignore)
    return term_udf(lambda t: t if t in kept else fn(t))


def phonetic(kind: str = "metaphone", combine: bool = False) -> Stage:
    """Double Metaphone codes (primary, then a different secondary), or a soundex variant, of each term."""
    from quarry.functions.phonetics import double_metaphone, soundex_ar, soundex_en, soundex_es

    one = {"soundex_en": soundex_en, "soundex_es": soundex_es, "soundex_ar": soundex_ar}.get(kind)

    def python(ts):
        out = []
        for t in ts:
            codes = [one(t)] if one else [c for c in dict.fromkeys(double_metaphone(t)) if c]
            out += ([t] if combine else []) + codes
        return out

    return Stage(_array_udf(python), python)


# Analyzers


def id_analyzer(lower: bool = False) -> Analyzer:
    return Analyzer([id_tokenizer(), *([lowercase()] if lower else [])])


def keyword(lower: bool = False, commas: bool = False) -> Analyzer:
    return Analyzer([comma_tokenizer() if commas else space_tokenizer(), *([lowercase()] if lower else [])])


def regex_analyzer(pattern: str = r"[\p{L}\p{N}_]+(?:\.?[\p{L}\p{N}_]+)*", gaps: bool = False) -> Analyzer:
    return Analyzer([regex_tokenizer(pattern, gaps)])


def simple(pattern: str = WORD_PATTERN, gaps: bool = False) -> Analyzer:
    return regex_tokenizer(pattern, gaps) | lowercase()


def standard(words: Sequence[str] = STOP_WORDS, least: int = 2, most: int | None = None, pattern: str = WORD_PATTERN) -> Analyzer:
    return simple(pattern) | stop(words, least, most)


def stemming(language: str = "en", words: Sequence[str] = STOP_WORDS, least: int = 2, ignore: Sequence[str] = ()) -> Analyzer:
    return standard(words, least) | stem(language, ignore)


def fancy(words: Sequence[str] = STOP_WORDS, least: int = 2) -> Analyzer:
    return regex_tokenizer(r"\s+", gaps=True) | intraword(merge_words=True, merge_numbers=True) | lowercase() | stop(words, least)


def language(code: str) -> Analyzer:
    """Lower-casing, the language's stop words and stemmer, each where known."""
    from quarry.functions.languages import has_stemmer, stop_words

    out = simple() | stop(stop_words(code), 1)
    return out | stem(code) if has_stemmer(code) else out


def multi_language(codes: Sequence[str]) -> Analyzer:
    """The terms of several languages' analyzers, one after another."""
    parts = [language(c) for c in codes]
    return Analyzer([Stage(lambda c: F.concat(*[p.terms(c) for p in parts]), lambda s: [t for p in parts for t in p.analyze(s)], True)])


def ngram(low: int, high: int | None = None) -> Analyzer:
    return ngram_tokenizer(low, high) | lowercase()


def gram_counts(texts: DataFrame, column: str, low: int, high: int | None = None) -> DataFrame:
    """gram and n: how often each term of ``ngram(low, high)`` stands in all texts; a stretch of texts is counted before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for text in [*batch.column(0).to_pylist(), None]:
                if text:
                    held.append(np.frombuffer(text.encode("utf-32-le"), np.uint32))
                    size += len(held[-1])
                if held and (text is None or size > 1 << 20):
                    yield from counted(held)
                    held, size = [], 0

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        chars, row = np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held])
        alphabet, first = np.unique(chars, return_inverse=True)
        codes = first = first.astype(np.int64)
        for k in range(1, (high or low) + 1):
            if k > 1:
                # codes of k characters from those of k - 1, kept small
                codes = codes[: len(first) - k + 1] * len(alphabet) + first[k - 1 :]
            if not len(codes):
                return
            inside = np.flatnonzero(row[: len(codes)] == row[k - 1 :])
            names, at, codes = np.unique(codes, return_index=True, return_inverse=True)
            n = np.bincount(codes[inside], minlength=len(names))
            if k >= low:
                live = np.flatnonzero(n)
                grams = ["".join(map(chr, chars[i : i + k])) for i in at[live].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n[live], pa.int64())], names=["gram", "n"])

    found = texts.select(F.col(column)).mapInArrow(run, "gram string, n long")
    return found.groupBy(F.lower("gram").alias("gram")).agg(F.sum("n").alias("n"))


def ngram_words(low: int, high: int | None = None, at: str | None = None) -> Analyzer:
    return simple() | ngram_filter(low, high, at)


def autocomplete(low: int = 2, high: int = 10) -> Analyzer:
    return ngram_words(low, high, "start")


#: Named presets.
PRESETS: dict[str, Callable[[], Analyzer]] = {
    "autocomplete": autocomplete,
    "partial_match": lambda: ngram_words(2, 5),
    "fuzzy": lambda: ngram_words(3, 4),
    "code_search": lambda: fancy(()),
    "exact": lambda: id_analyzer(True),
    "keyword": lambda: keyword(True),
    "standard": standard,
    "stemming": stemming,
}


def characters(text: Column, analyzer: Analyzer | None = None, pattern: str = WORD_PATTERN) -> Column:
    """array<struct<term, pos, start, end>>: the analyzer's terms of each word with the word's place in the text, in code points."""
    compiled, chain = re.compile(python_pattern(pattern)), analyzer or standard()

    @F.pandas_udf("array<struct<term:string,pos:int,start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: [{"term": t, "pos": k, "start": m.start(), "end": m.end()} for k, m in enumerate(compiled.finditer(s or "")) for t in chain.analyze(m[0])])

    return run(text)


def explain(text: str, analyzer: Analyzer | None = None) -> list[dict]:
    """Term and position of each token of a text."""
    return [{"term": t, "pos": i} for i, t in enumerate((analyzer or standard()).analyze(text))]

"""Edit distances on Columns and strings."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def osa(a: str, b: str, limit: int | None = None) -> int:
    """Edits between two strings where swapping neighbours is one edit; over ``limit``, limit + 1."""
    if limit is not None and abs(len(a) - len(b)) > limit:
        return limit + 1
    older: list[int] = []
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            new.append(best)
        if limit is not None and min(new) > limit and (not older or min(old) > limit):
            return limit + 1
        older, old = old, new
    return old[-1]


def osa_column(term: Column, text: str, limit: int) -> Column:
    """Distance of each term from ``text``, null over ``limit``; an Arrow UDF behind a built-in prefilter."""

    @F.pandas_udf("int")
    def run(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: None if t is None else d if (d := osa(t, text, limit)) <= limit else None).astype("Int32")

    # a swap is two plain edits, so the plain distance is at most twice the wanted one
    return F.when(F.levenshtein(term, F.lit(text)) <= 2 * limit, run(term))


def osa_within(term: Column, text: str, limit: int) -> Column:
    """Whether a term lies within ``limit`` edits of ``text``; for one edit without Python."""
    if limit == 0:
        return term == text
    if limit == 1:
        swaps = sorted({text[:i] + text[i + 1] + text[i] + text[i + 2 :] for i in range(len(text) - 1)} - {text})
        near = F.levenshtein(term, F.lit(text)) <= 1
        return near | term.isin(*swaps) if swaps else near
    return F.coalesce(osa_column(term, text, limit).isNotNull(), F.lit(False))


def similarity(a: Column, b: Column) -> Column:
    """((longer - distance) / longer) * (shorter / longer)."""
    n, m = F.length(a), F.length(b)
    longer, shorter = F.greatest(n, m), F.least(n, m)
    return F.when(longer == 0, F.lit(1.0)).otherwise((longer - F.levenshtein(a, b)) / longer * (shorter / longer))


@functools.lru_cache(maxsize=4096)
def natural_key(s: str) -> tuple:
    """Digits compare as numbers, the rest as text."""
    import re

    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.findall(r"\d+|\D+", s))


def natural_sort(c: Column, width: int = 20) -> Column:
    """A Column that sorts mixed digits and text naturally: digit runs padded with zeros."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), 0), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(p)), "")

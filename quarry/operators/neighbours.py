"""Terms within a few edits, by equality: an index of what terms become when characters are left out.

Two words within d edits (insertions, deletions, substitutions, swaps of neighbours) have beginnings of HEAD characters that become equal
when at most d characters are left out of either: edits in the beginning cost one each, and so does a shift of its end. So a
term is stored under the variants of its beginning, a few dozen whatever its length, a word is looked up by its own variants, and what meets is verified. No scan of the vocabulary, no pair without a common variant.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.distance import osa

#: Characters of a term that variants are made of; more than any distance asked for.
HEAD = 8


def variants(term: Column, maxdist: int) -> Column:
    """The beginning of a term with up to ``maxdist`` characters left out."""
    found = level = F.array(F.substring(term, 1, HEAD))
    for _ in range(maxdist):
        level = F.array_distinct(F.flatten(F.transform(level, _without_one)))
        found = F.concat(found, level)
    return F.array_distinct(found)


def _without_one(t: Column) -> Column:
    places = F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))


def variants_of(word: str, maxdist: int) -> set[str]:
    """The same of one word."""
    found = level = {word[:HEAD]}
    for _ in range(maxdist):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        found = found | level
    return found


class TermNeighbours:
    """A stored table (variant, term and its other columns), sorted by variant."""

    def __init__(self, table: DataFrame, maxdist: int):
        self.table, self.maxdist = table, maxdist

    @classmethod
    def write(cls, terms: DataFrame, path: str, maxdist: int = 2) -> TermNeighbours:
        """From a vocabulary: ``term`` and further columns (df, cf)."""
        if not 0 < maxdist < HEAD:
            raise ValueError("a distance from 1 to below the length of a beginning")
        rows = terms.where(F.col("term").isNotNull()).withColumn("variant", F.explode(variants(F.col("term"), maxdist)))
        rows.repartitionByRange("variant").sortWithinPartitions("variant", "term").write.parquet(path)
        return cls(terms.sparkSession.read.parquet(path), maxdist)

    def near(self, word: str, maxdist: int | None = None) -> DataFrame:
        """Terms within ``maxdist`` edits of a word, with their distance; the variants' row groups are read."""
        d = self._checked(maxdist)
        found = self.table.where(F.col("variant").isin(sorted(variants_of(word, d)))).drop("variant").distinct()
        return _verified(found.withColumn("word", F.lit(word)), d).drop("word")

    def near_all(self, words: DataFrame, maxdist: int | None = None, column: str = "word") -> DataFrame:
        """word, and the terms within ``maxdist`` edits of it with their distance, of all ``words`` together."""
        d = self._checked(maxdist)
        asked = words.select(F.col(column).alias("word")).where("word is not null").distinct()
        asked = asked.withColumn("variant", F.explode(variants(F.col("word"), d)))
        return _verified(asked.join(self.table, "variant").drop("variant").distinct(), d)

    def correct(self, words: DataFrame, maxdist: int | None = None, column: str = "word") -> DataFrame:
        """word and best: itself if it is a term, else the nearest term (ties: more frequent, then first); null without one."""
        near = self.near_all(words, maxdist, column)
        best = near.groupBy("word").agg(F.min(F.struct("distance", -F.col("cf"), F.col("term").alias("term"))).alias("b"))
        return words.select(F.col(column).alias("word")).distinct().join(best.select("word", F.col("b.term").alias("best")), "word", "left")

    def _checked(self, maxdist: int | None) -> int:
        d = self.maxdist if maxdist is None else maxdist
        if d > self.maxdist:
            raise ValueError(f"built for {self.maxdist} edits")
        return d


def _verified(pairs: DataFrame, maxdist: int) -> DataFrame:
    """Pairs (word, term) within ``maxdist`` edits, with their distance; as many edits as Levenshtein's at most, fewer with swaps."""
    close = pairs.where(F.abs(F.length("word") - F.length("term")) <= maxdist).withColumn("__l", F.levenshtein("word", "term"))
    close = close.where(F.col("__l") <= 2 * maxdist)  # a swap is two edits there

    @F.pandas_udf("int")
    def swaps(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([osa(x, y, maxdist) for x, y in zip(a, b)], index=a.index, dtype="int32")

    return close.withColumn("distance", swaps("word", "term")).where(F.col("distance") <= maxdist).drop("__l")

"""Spelling suggestions and completions from the index's vocabulary."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.distance import osa_column
from quarry.operators.index import SearchIndex
from quarry.plans import query as Q


def suggest(index: SearchIndex, field: str, text: str, limit: int = 5, maxdist: int = 2, prefix: int = 0, by_distance: bool = False) -> DataFrame:
    """Terms within ``maxdist`` edits by frequency (score -(maxdist + 0.5 / frequency)), or by distance first."""
    near = index.terms_within(field, text, maxdist, prefix).where(F.col("term") != text)
    score = -(F.lit(float(maxdist)) + 0.5 / F.col("cf"))
    if by_distance:
        return near.withColumn("distance", osa_column(F.col("term"), text, maxdist)).orderBy("distance", F.desc("cf"), "term").limit(limit).select("term", "distance", "cf")
    return near.select("term", score.alias("score")).orderBy(F.desc("score"), "term").limit(limit)


def suggest_from(words: DataFrame, text: str, limit: int = 5, maxdist: int = 2, prefix: int = 0) -> DataFrame:
    """As suggest, from a word list (column term); score is the negative distance."""
    lead = F.col("term").startswith(text[:prefix]) if prefix else F.lit(True)
    found = words.where(lead & F.length("term").between(len(text) - maxdist, len(text) + maxdist)).withColumn("distance", osa_column(F.col("term"), text, maxdist))
    return found.where("distance is not null and distance > 0").select("term", (-F.col("distance")).cast("double").alias("score")).orderBy(F.desc("score"), "term").limit(limit)


def suggest_all(parts: Sequence[DataFrame], limit: int = 5, how=F.sum) -> DataFrame:
    """Suggestions of several correctors, scores of equal terms folded."""
    rows = functools.reduce(DataFrame.unionAll, [p.select("term", "score") for p in parts])
    return rows.groupBy("term").agg(how("score").alias("score")).orderBy(F.desc("score"), "term").limit(limit)


def correct_query(index: SearchIndex, q: Q.Query, text: str = "", maxdist: int = 2, prefix: int = 0) -> tuple[Q.Query, str]:
    """The query with each term that the index lacks replaced by its best suggestion, and the text likewise.

    A query has few terms: one look at the vocabulary tells which are missing, one more per missing term.
    """
    terms = sorted(q.terms())
    if not terms:
        return q, text
    held = functools.reduce(lambda a, b: a | b, [(F.col("field") == f) & (F.col("term") == t) for f, t in terms])
    known = {(r["field"], r["term"]) for r in index.term_stats.where(held).select("field", "term").collect()}
    for f, t in terms:
        if (f, t) not in known:
            best = suggest(index, f, t, 1, maxdist, prefix).first()
            if best:
                q = q.replace_term(f, t, best["term"])
                text = text.replace(t, best["term"])
    return q, text


def complete(index: SearchIndex, field: str, prefix: str, limit: int = 5, by: str = "frequency") -> DataFrame:
    """Terms with a prefix by document frequency, or alphabetically."""
    found = index.term_stats.where((F.col("field") == field) & F.col("term").startswith(prefix))
    order = [F.desc("df"), F.asc("term")] if by == "frequency" else [F.asc("term")]
    return found.orderBy(*order).limit(limit).select("term", "df")


def complete_phrases(phrases: DataFrame, prefix: str, limit: int = 5, column: str = "phrase") -> DataFrame:
    """Phrases with a prefix; score 1 / (length + 1), half as much again for the exact phrase."""
    c = F.lower(F.col(column))
    score = 1 / (F.length(c) + 1) * F.when(c == prefix.lower(), 1.5).otherwise(1.0)
    return phrases.where(c.startswith(prefix.lower())).select(F.col(column).alias("phrase"), score.alias("score")).distinct().orderBy(F.desc("score"), "phrase").limit(limit)


def complete_ngrams(phrases: DataFrame, text: str, limit: int = 5, n: int = 3, column: str = "phrase") -> DataFrame:
    """Phrases by the number of edge n-grams (2 to n characters) of their words shared with the text's words."""
    from quarry.functions import analysis

    grams = analysis.ngram_words(2, n, "start")
    wanted = sorted(set(grams.analyze(text)))
    if not wanted:
        return phrases.select(F.col(column).alias("phrase"), F.lit(0).alias("score")).limit(0)
    shared = F.size(F.array_intersect(grams.terms(F.col(column)), F.array(*[F.lit(w) for w in wanted])))
    return phrases.select(F.col(column).alias("phrase"), shared.alias("score")).where("score > 0").distinct().orderBy(F.desc("score"), "phrase").limit(limit)


def vocabulary(spark: SparkSession, words: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "term string")

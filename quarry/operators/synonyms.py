"""Synonyms: tables of word and synonym, and expansion of texts, terms and queries."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans import query as Q


class Synonyms:
    """A dictionary of words; texts are expanded with a map literal, large ones by ``expand_terms``' join."""

    def __init__(self, words: Mapping[str, Sequence[str]] | None = None):
        self.words: dict[str, tuple[str, ...]] = {k.lower(): tuple(dict.fromkeys(v)) for k, v in (words or {}).items()}

    @classmethod
    def from_json(cls, text: str) -> Synonyms:
        return cls(json.loads(text))

    @classmethod
    def from_yaml(cls, text: str) -> Synonyms:
        """From a mapping of words to lists, or to one synonym each (where a YAML library is installed)."""
        import yaml

        return cls({str(k): [str(x) for x in (v if isinstance(v, list) else [v])] for k, v in (yaml.safe_load(text) or {}).items()})

    @classmethod
    def from_frame(cls, df: DataFrame, limit: int = 100_000) -> Synonyms:
        """From rows (word, synonym); more words than ``limit`` belong in a join."""
        rows = df.groupBy(F.lower("word").alias("word")).agg(F.array_sort(F.collect_set("synonym")).alias("s")).limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError("too many words for a dictionary; use expand_terms")
        return cls({r["word"]: r["s"] for r in rows})

    def add(self, word: str, *synonyms: str) -> None:
        key = word.lower()
        self.words[key] = tuple(dict.fromkeys((*self.words.get(key, ()), *synonyms)))

    def remove(self, word: str, synonym: str | None = None) -> None:
        key = word.lower()
        if synonym is None:
            self.words.pop(key, None)
        elif key in self.words:
            self.words[key] = tuple(s for s in self.words[key] if s != synonym)

    def get(self, word: str) -> tuple[str, ...]:
        return self.words.get(word.lower(), ())

    def merge(self, other: Synonyms) -> Synonyms:
        out = Synonyms(self.words)
        for word, values in other.words.items():
            out.add(word, *values)
        return out

    def to_json(self) -> str:
        return json.dumps({k: list(v) for k, v in sorted(self.words.items())}, ensure_ascii=False)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(w, s) for w, ss in sorted(self.words.items()) for s in ss], "word string, synonym string")

    def expand_text(self, text: Column) -> Column:
        """Each white-space separated word followed by its synonyms."""
        if not self.words:
            return text
        table = F.create_map(*[x for w, ss in sorted(self.words.items()) for x in (F.lit(w), F.array(*[F.lit(s) for s in ss]))])
        words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
        none = F.array().cast("array<string>")
        return F.array_join(F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.element_at(table, F.lower(w)), none)))), " ")

    def expand_query(self, q: Q.Query, boost: float = 1.0) -> Q.Query:
        """Terms as alternatives of themselves and their synonyms."""

        def one(x: Q.Query) -> Q.Query:
            if isinstance(x, Q.Term) and (found := self.get(str(x.text))):
                return Q.Or((x, *[Q.Term(x.field, s, x.boost * boost) for s in found]))
            return x

        return q.map(one).normalize()


def expand_terms(terms: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with a column term, and a copy for each synonym in ``table`` (word, synonym): a join, for dictionaries of any size."""
    more = terms.join(table.select(F.lower("word").alias("term"), "synonym"), "term").withColumn("term", F.col("synonym")).drop("synonym")
    return terms.unionByName(more)


def from_wordnet(spark: SparkSession, path: str) -> DataFrame:
    """word, synonym from a thesaurus file of lines s(group,number,'word',kind,sense,count). : words of one group are synonyms."""
    pattern = r"^s\((\d+),\d+,'((?:[^']|'')*)',\w+,\d+,\d+\)\."
    rows = spark.read.text(path).select(F.regexp_extract("value", pattern, 1).alias("group"), F.lower(F.replace(F.regexp_extract("value", pattern, 2), F.lit("''"), F.lit("'"))).alias("word")).where("group <> ''").distinct()
    return rows.join(rows.withColumnRenamed("word", "synonym"), "group").where("word <> synonym").select("word", "synonym").distinct()


def from_wiktionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, synonym) of a dictionary extract in JSON lines: entries with word and synonyms, also by sense."""
    rows = spark.read.schema("word string, synonyms array<struct<word:string>>, senses array<struct<synonyms:array<struct<word:string>>>>").json(path)
    nested = F.flatten(F.transform(F.coalesce("senses", F.array()), lambda s: F.coalesce(s["synonyms"], F.array())))
    return rows.select(F.lower("word").alias("word"), F.explode(F.concat(F.coalesce("synonyms", F.array()), nested)).alias("s")).select("word", F.col("s.word").alias("synonym")).where("synonym is not null").distinct()

"""Incremental indexing with Structured Streaming, and views that keep an index up to date.

A stream of documents becomes a stream of postings, appended to parquet with one batch number per
micro-batch, so a batch that runs again replaces its own rows. Statistics are additive (df, cf, total length
per batch) and are summed on reading, so nothing is recounted.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.index import SearchIndex, keep_last, postings_of
from quarry.operators.search import Results, Searcher
from quarry.plans import query as Q
from quarry.plans.schema import Schema, ensure_schema


def write_batch(batch: DataFrame, number: int, schema: Schema, path: str, id_column: str = "doc_id") -> None:
    """One micro-batch as documents, postings and statistics under its number: writing it again changes nothing."""
    docs = batch.withColumn("doc_id", F.col(id_column).cast("long"))
    postings = postings_of(docs, schema.resolve(docs.columns))
    docs.write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
    postings.sortWithinPartitions("field", "term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
    held = batch.sparkSession.read.parquet(f"{path}/postings/batch={number}")
    stats = held.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("weight").alias("cf"), F.max("weight").alias("max_weight"), F.min("dl").alias("min_length"), F.max("dl").alias("max_length"))
    stats.write.mode("overwrite").parquet(f"{path}/term_stats/batch={number}")
    totals = held.groupBy("field").agg(F.sum("tf").alias("total"), F.min("dl").alias("min_length"), F.max("dl").alias("max_length"), F.lit(0).cast("long").alias("n"))
    written = batch.sparkSession.read.parquet(f"{path}/docs/batch={number}").agg(F.count(F.lit(1)).alias("n"))
    totals.unionByName(written, allowMissingColumns=True).coalesce(1).write.mode("overwrite").parquet(f"{path}/field_stats/batch={number}")


def index_stream(stream: DataFrame, schema, path: str, checkpoint: str, id_column: str = "doc_id", trigger: Mapping | None = None) -> StreamingQuery:
    """Starts indexing a stream of documents under ``path``."""
    schema = ensure_schema(schema)
    writer = stream.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, schema, path, id_column)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def open_stream_index(spark: SparkSession, schema, path: str) -> SearchIndex:
    """The index of all batches written so far."""
    docs = spark.read.parquet(f"{path}/docs").drop("batch")
    postings = spark.read.parquet(f"{path}/postings").drop("batch")
    stats = spark.read.parquet(f"{path}/term_stats").groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("max_weight").alias("max_weight"), F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"))
    fields = spark.read.parquet(f"{path}/field_stats")
    n = fields.agg(F.sum("n").alias("n"))
    totals = fields.where("field is not null").groupBy("field").agg(F.sum("total").alias("total"), F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"))
    # one row with one number on the right side
    return SearchIndex(ensure_schema(schema), docs, postings, stats, totals.join(F.broadcast(n), F.lit(True)))


def term_counts(stream: DataFrame, text: str, time: str, window: str = "1 hour", late: str = "10 minutes", analyzer=None) -> DataFrame:
    """Counts of terms by event-time window; windows close ``late`` after their end."""
    from quarry.functions import analysis

    terms = (analyzer or analysis.standard()).terms(F.col(text))
    return stream.withWatermark(time, late).select(F.col(time), F.explode(terms).alias("term")).groupBy(F.window(time, window).alias("window"), "term").agg(F.count(F.lit(1)).alias("n"))


def facet_counts(stream: DataFrame, key: str, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def percolate(stream: DataFrame, text: str, queries: Mapping[str, Q.Query], analyzer=None) -> DataFrame:
    """Documents of a stream with the names of the stored queries that match them (boolean trees of terms, prefixes and phrases)."""
    from quarry.functions import analysis

    terms = (analyzer or analysis.standard()).terms(F.col(text))

    def match(q: Q.Query):
        held = F.col("__terms")
        if isinstance(q, Q.Term):
            return F.array_contains(held, q.text)
        if isinstance(q, Q.Prefix):
            return F.exists(held, lambda t: t.startswith(q.text))
        if isinstance(q, Q.Phrase):
            return F.concat(F.lit(" "), F.array_join(held, " "), F.lit(" ")).contains(" " + " ".join(q.words) + " ")
        if isinstance(q, Q.And):
            return functools.reduce(lambda a, b: a & b, map(match, q.parts))
        if isinstance(q, (Q.Or, Q.DisMax)):
            return functools.reduce(lambda a, b: a | b, map(match, q.parts))
        if isinstance(q, Q.Not):
            return ~match(q.query)
        if isinstance(q, Q.AndNot):
            return match(q.a) & ~match(q.b)
        if isinstance(q, (Q.AndMaybe, Q.Boost, Q.ConstantScore)):
            return match(q.a if isinstance(q, Q.AndMaybe) else q.query)
        if isinstance(q, Q.Require):
            return match(q.a) & match(q.b)
        if isinstance(q, Q.Every):
            return F.lit(True)
        raise TypeError(f"{type(q).__name__} cannot be tested on a stream")

    names = F.array_compact(F.array(*[F.when(match(q.normalize()), F.lit(n)) for n, q in queries.items()]))
    return stream.withColumn("__terms", terms).withColumn("matched", names).drop("__terms").where(F.size("matched") > 0)


Middleware = Callable[[DataFrame], DataFrame]


@dataclass
class SearchView:
    """A source with its index: build, refresh with changes, search.

    Middleware are functions on DataFrames: ``before_index`` on documents, ``after_search`` on hits; ``rewriters`` on queries.
    """

    name: str
    source: object
    schema: Schema | None = None
    before_index: Sequence[Middleware] = ()
    after_search: Sequence[Middleware] = ()
    rewriters: Sequence[Callable[[Q.Query], Q.Query]] = ()
    model: object = None
    strict: bool = False
    index: SearchIndex | None = field(default=None, repr=False)
    seen: object = None

    def _prepared(self, df: DataFrame) -> DataFrame:
        return functools.reduce(DataFrame.transform, self.before_index, df)

    def build(self) -> SearchIndex:
        from quarry.sources.discovery import validate

        df = self._prepared(self.source.frame())
        self.schema = self.schema or self.source.discover_schema()
        if self.strict and (issues := [i for i in validate(df, self.schema, self.source.id_field) if i.severity == "error"]):
            raise ValueError("; ".join(f"{i.field}: {i.message}" for i in issues))
        key = self.source.id_field
        id_column = key if key and dict(df.dtypes).get(key) in ("bigint", "int", "smallint", "tinyint") else None
        self.index = SearchIndex.build(df, self.schema, id_column)
        self._mark(df)
        return self.index

    def _mark(self, df: DataFrame) -> None:
        if self.source.incremental:
            self.seen = df.agg(F.max(self.source.incremental)).first()[0]

    def refresh(self) -> SearchIndex:
        """Indexes what is newer than the last seen value; rows with a known id replace it."""
        if self.index is None or not self.source.incremental or self.seen is None:
            return self.build()
        self.source.refresh()
        key = self.source.id_field
        changed = self._prepared(self.source.changes(self.seen)).withColumn("doc_id", F.col(key).cast("long"))
        changed = keep_last(changed, ["doc_id"], self.source.incremental)
        self.index = self.index.delete(changed).add(changed)
        self._mark(changed.select(self.source.incremental).unionByName(self.index.docs.select(self.source.incremental)))
        return self.index

    reindex = build

    def evolve(self, name: str, spec, source: str | None = None) -> SearchIndex:
        self.index = self.index.add_field(name, spec, source=source)
        self.schema = self.index.schema
        return self.index

    def search(self, q: Q.Query | str, default: str | None = None, **options) -> Results:
        from quarry.operators import facets
        from quarry.plans.parser import QueryParser, rewrite

        if isinstance(q, str):
            default = default or next(n for n, f in self.schema.fields.items() if f.kind == "text")
            q = QueryParser(default, self.schema).parse(q)
        q = rewrite(q, self.rewriters)
        if options.get("groupedby") == "auto":
            options["groupedby"] = facets.discover(self.schema)
        out = Searcher(self.index, self.model).search(q, **options) if self.model else Searcher(self.index).search(q, **options)
        out.hits = functools.reduce(DataFrame.transform, self.after_search, out.hits)
        return out


def encrypted(columns: Sequence[str], key: str) -> Middleware:
    """Stored columns encrypted (AES-GCM, base64 text)."""
    return lambda df: df.withColumns({c: F.base64(F.aes_encrypt(F.col(c).cast("binary"), F.lit(key).cast("binary"))) for c in columns})


def decrypted(columns: Sequence[str], key: str) -> Middleware:
    return lambda df: df.withColumns({c: F.aes_decrypt(F.unbase64(F.col(c)), F.lit(key).cast("binary")).cast("string") for c in columns})


def reranked(score) -> Middleware:
    """Hits with a new score, a function of their columns, in its order."""
    return lambda df: df.withColumn("score", score()).orderBy(F.desc("score"), "doc_id")


def from_config(spark: SparkSession, config: Mapping) -> SearchView:
    """A view from a description: name, source, fields (name -> kind and options), synonyms, scoring."""
    from quarry.functions import analysis, scoring
    from quarry.operators.synonyms import Synonyms
    from quarry.plans import schema as S
    from quarry.sources import readers

    kinds = {"text": S.TEXT, "id": S.ID, "keyword": S.KEYWORD, "numeric": S.NUMERIC, "datetime": S.DATETIME, "boolean": S.BOOLEAN, "stored": S.STORED, "ngram": S.NGRAM, "ngramwords": S.NGRAMWORDS, "vector": S.VECTOR, "search_as_you_type": S.SEARCH_AS_YOU_TYPE}
    fields = {}
    for name, spec in (config.get("fields") or {}).items():
        options = {"kind": spec} if isinstance(spec, str) else dict(spec)
        kind = options.pop("kind", "text")
        if "language" in options:
            options["analyzer"] = analysis.language(options.pop("language"))
        elif isinstance(options.get("analyzer"), str):
            options["analyzer"] = analysis.PRESETS[options["analyzer"]]()
        fields[name] = kinds[kind](**options)
    rewriters = [Synonyms(config["synonyms"]).expand_query] if config.get("synonyms") else []
    model = scoring.model_named(config["scoring"]) if config.get("scoring") else None
    return SearchView(config.get("name", "view"), readers.make(spark, config["source"]), S.Schema(fields) if fields else None, rewriters=rewriters, model=model, strict=config.get("strict", False))


def load_config(path: str) -> dict:
    """A description from JSON (or YAML where its library is installed)."""
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yml", ".yaml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)

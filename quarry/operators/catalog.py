"""The engine's registered queries over the driver tables, and the same rows in DuckDB SQL."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import analysis, distance, languages, scoring
from quarry.functions.analysis import STOP_WORDS
from quarry.operators import expand, facets, highlight, search, suggest, vectors
from quarry.operators.blocks import BlockIndex
from quarry.operators.estimate import estimate
from quarry.operators.graph import VectorGraph, recall
from quarry.operators.index import SearchIndex, keep_last, numbered, shared_path, spread, with_parents
from quarry.operators.neighbours import TermNeighbours
from quarry.operators.postings import packed_of, postings_of
from quarry.operators.search import Searcher
from quarry.plans import query as Q
from quarry.plans.parser import FEATURES, QueryParser, multifield
from quarry.plans.parser import simple as simple_parser
from quarry.plans.schema import DATETIME, ID, KEYWORD, NUMERIC, TEXT, Schema

_held: dict[tuple[str, str, str], SearchIndex] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _index(spark: SparkSession, sf_dir: str, name: str, make) -> SearchIndex:
    """An index built once per session: its tables are stored in the shared folder, statistics are held by the executors."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _held:
        _held[key] = make()
    return _held[key]


DOCUMENTS = Schema(text=TEXT(stored=True), lang=ID(), source=ID())


def documents(spark, sf_dir) -> SearchIndex:
    return _index(spark, sf_dir, "documents", lambda: _over(table(spark, sf_dir, "documents"), DOCUMENTS))


def _over(docs: DataFrame, schema: Schema) -> SearchIndex:
    """An index whose postings come from ``docs`` dealt in parts and are stored packed; the documents themselves stay as they lie."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    dealt, specs = spread(docs), schema.resolve(docs.columns)
    return SearchIndex(schema, docs, postings_of(dealt, specs)).laid(docs=False, packed=packed_of(dealt, specs))


ORDERS = Schema(o_orderstatus=ID(), o_orderpriority=KEYWORD(), o_totalprice=NUMERIC("float"), o_orderdate=DATETIME())


def orders(spark, sf_dir) -> SearchIndex:
    return _index(spark, sf_dir, "orders", lambda: SearchIndex.build(table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")), ORDERS, "o_orderkey").laid())


PARTS = Schema(p_name=TEXT(), p_brand=ID(), p_type=TEXT(), p_size=NUMERIC(), p_retailprice=NUMERIC("float"))


def parts(spark, sf_dir) -> SearchIndex:
    return _index(spark, sf_dir, "parts", lambda: SearchIndex.build(table(spark, sf_dir, "part"), PARTS, "p_partkey").laid())


#: The same tokens in SQL: lower-cased words of two or more characters that are no stop words, positions without holes.
_PATTERN = r"[\p{L}\p{N}_*]+(?:\.?[\p{L}\p{N}_*]+)*"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
TOKENS = rf"""
raw AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{_PATTERN}'), lambda x: lower(x)) AS w FROM documents),
kept AS (SELECT doc_id, list_filter(w, lambda x: length(x) >= 2 AND x NOT IN ({_STOPS})) AS k, w FROM raw),
numbered AS (
  SELECT doc_id, unnest(k) AS term, generate_subscripts(k, 1) - 1 + coalesce(list_position(list_transform(w, lambda x: length(x) >= 2 AND x NOT IN ({_STOPS})), true), 1) - 1 AS pos, len(k) AS dl
  FROM kept
),
post AS (SELECT doc_id, term, count(*) AS tf, min(dl) AS dl, list(pos ORDER BY pos) AS positions FROM numbered GROUP BY doc_id, term),
stat AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY term),
tot AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM post) AS total)
"""
_BM25 = "(ln(n / (df + 1.0)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (total * 1.0 / n)))"
SCORED = f"{TOKENS}, hit AS (SELECT p.doc_id, p.term, {_BM25} AS s, p.positions FROM post p JOIN stat USING (term), tot)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("doc_id", F.round("score", digits).alias("score"))


def _matches(spark, sf_dir, q, model=None) -> DataFrame:
    return _rounded(Searcher(documents(spark, sf_dir), model or scoring.BM25F()).matches(q))


T = lambda w, boost=1.0: Q.Term("text", w, boost)


# Analysis


@query(rf"SELECT term, count(*) AS n FROM (SELECT unnest(k) AS term FROM (SELECT list_filter(list_transform(regexp_extract_all(text, '{_PATTERN}'), lambda x: lower(x)), lambda x: length(x) >= 2 AND x NOT IN ({_STOPS})) AS k FROM documents)) GROUP BY term")
def tokenize_standard(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select(F.explode(analysis.standard().terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT doc_id, unnest(string_split(lower(text), '')) AS c, generate_subscripts(string_split(lower(text), ''), 1) AS i FROM documents), g AS (SELECT c || lead(c) OVER w AS two, c || lead(c) OVER w || lead(c, 2) OVER w AS three FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)) SELECT gram, count(*) AS n FROM (SELECT two AS gram FROM g UNION ALL SELECT three FROM g) WHERE gram IS NOT NULL GROUP BY gram")
def tokenize_ngram(spark, sf_dir):
    return analysis.gram_counts(spread(table(spark, sf_dir, "documents")), "text", 2, 3)


@query("SELECT path, count(*) AS n FROM (SELECT '/' || array_to_string(p[1:i], '/') AS path FROM (SELECT regexp_extract_all(url, '[^/]+') AS p FROM pages), range(1, 20) r(i) WHERE i <= len(p)) GROUP BY path")
def tokenize_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.explode(analysis.Analyzer([analysis.path_tokenizer()]).terms(F.col("url"))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(r"WITH w AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\r\n]+'), lambda x: x <> '') AS w FROM documents)) SELECT shingle, count(*) AS n FROM (SELECT CASE WHEN lead(w) OVER o IS NOT NULL THEN w || '-' || lead(w) OVER o WHEN count(*) OVER (PARTITION BY doc_id) = 1 THEN w END AS shingle FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE shingle IS NOT NULL GROUP BY shingle")
def shingle2(spark, sf_dir):
    chain = analysis.space_tokenizer() | analysis.lowercase() | analysis.shingle(2)
    return spread(table(spark, sf_dir, "documents")).select(F.explode(chain.terms(F.col("text"))).alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT gram, count(*) AS n FROM (SELECT substring(w, 1, k) AS gram FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS w FROM part), (VALUES (2), (3), (4), (5)) s(k) WHERE k <= length(w)) GROUP BY gram")
def edge_ngrams(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(analysis.autocomplete(2, 5).terms(F.col("p_name"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query()
def stem_porter(spark, sf_dir):
    terms = spread(table(spark, sf_dir, "documents")).select(F.explode(analysis.standard().terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.groupBy(F.get(analysis.Analyzer([analysis.id_tokenizer(), analysis.stem("en")]).terms(F.col("term")), F.lit(0)).alias("stem")).agg(F.sum("n").alias("n"))


# Index


@query(f"WITH {TOKENS} SELECT term, doc_id, count(*) AS tf, min(dl) AS dl, CAST(sum(pos) AS BIGINT) AS pos_sum FROM numbered GROUP BY doc_id, term")
def postings_build(spark, sf_dir):
    p = documents(spark, sf_dir).postings.where("field = 'text'")
    return p.select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"), F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x).alias("pos_sum"))


@query(f"WITH {TOKENS} SELECT term, df, CAST(cf AS DOUBLE) AS cf FROM stat")
def term_stats(spark, sf_dir):
    return documents(spark, sf_dir).term_stats.where("field = 'text'").select("term", "df", "cf")


@query(f"WITH {TOKENS} SELECT CAST(total AS BIGINT) AS total, n, (SELECT min(dl) FROM post) AS min_length, (SELECT max(dl) FROM post) AS max_length FROM tot")
def field_stats(spark, sf_dir):
    return documents(spark, sf_dir).field_stats.where("field = 'text'").select("total", "n", F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"))


# Boolean algebra


@query(f"WITH {SCORED} SELECT doc_id, round(s, 6) AS score FROM hit WHERE term = 'erst'")
def term_query(spark, sf_dir):
    return _matches(spark, sf_dir, T("erst"))


def _tree(select: str, words: str) -> str:
    """SQL over one row per document with a score per word (null where absent)."""
    columns = ", ".join(f"max(s) FILTER (WHERE term = '{w}') AS {v}" for v, w in zip("abcd", words.split()))
    listed = ", ".join(f"'{w}'" for w in words.split())
    return f"WITH {SCORED}, d AS (SELECT doc_id, {columns} FROM hit WHERE term IN ({listed}) GROUP BY doc_id) SELECT doc_id, round({select}"


@query(_tree("a + b, 6) AS score FROM d WHERE a IS NOT NULL AND b IS NOT NULL", "erst ther"))
def bool_and(spark, sf_dir):
    return _matches(spark, sf_dir, Q.And((T("erst"), T("ther"))))


@query(_tree("coalesce(a, 0) + coalesce(b, 0) + 2 * coalesce(c, 0), 6) AS score FROM d", "erst ther enst"))
def bool_or(spark, sf_dir):
    return _matches(spark, sf_dir, Q.Or((T("erst"), T("ther"), T("enst", 2.0))))


@query(_tree("coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0), 6) AS score FROM d WHERE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT >= 2", "erst ther enst"))
def bool_or_minmatch(spark, sf_dir):
    return _matches(spark, sf_dir, Q.Or((T("erst"), T("ther"), T("enst")), minmatch=2))


@query(_tree("a, 6) AS score FROM d WHERE a IS NOT NULL AND b IS NULL", "erst ther"))
def bool_andnot(spark, sf_dir):
    return _matches(spark, sf_dir, Q.AndNot(T("erst"), T("ther")))


@query(_tree("a + coalesce(b, 0), 6) AS score FROM d WHERE a IS NOT NULL", "erst ther"))
def bool_andmaybe(spark, sf_dir):
    return _matches(spark, sf_dir, Q.AndMaybe(T("erst"), T("ther")))


@query(_tree("a, 6) AS score FROM d WHERE a IS NOT NULL AND b IS NOT NULL", "erst ther"))
def bool_require(spark, sf_dir):
    return _matches(spark, sf_dir, Q.Require(T("erst"), T("ther")))


@query(f"WITH {SCORED} SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit WHERE term = 'ther')")
def bool_not(spark, sf_dir):
    return _matches(spark, sf_dir, Q.Not(T("ther")))


@query(f"WITH {SCORED} SELECT doc_id, round(coalesce(s, 0), 6) AS score FROM documents LEFT JOIN (SELECT doc_id, s FROM hit WHERE term = 'erst') USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM hit WHERE term = 'ther') AND s IS NOT NULL")
def bool_and_not_inner(spark, sf_dir):
    return _matches(spark, sf_dir, Q.And((T("erst"), Q.Not(T("ther")))))


@query(_tree("greatest(coalesce(a, 0), coalesce(b, 0)) + 0.1 * (coalesce(a, 0) + coalesce(b, 0) - greatest(coalesce(a, 0), coalesce(b, 0))), 6) AS score FROM d", "erst ther"))
def dismax(spark, sf_dir):
    return _matches(spark, sf_dir, Q.DisMax((T("erst"), T("ther")), tiebreak=0.1))


@query(_tree("b, 6) AS score FROM d WHERE b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d x WHERE x.a IS NOT NULL)", "nowhereatall ther"))
def otherwise(spark, sf_dir):
    return _matches(spark, sf_dir, Q.Otherwise(T("nowhereatall"), T("ther")))


@query(f"WITH {TOKENS} SELECT DISTINCT doc_id, 1.5::DOUBLE AS score FROM post WHERE term LIKE 'then%'")
def prefix_terms(spark, sf_dir):
    return _matches(spark, sf_dir, Q.Prefix("text", "then", 1.5))


@query(f"WITH {TOKENS} SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM post WHERE regexp_full_match(term, 'th.*in.')")
def wildcard_terms(spark, sf_dir):
    return _matches(spark, sf_dir, Q.Wildcard("text", "th*in?"))


@query(f"WITH {TOKENS} SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM post WHERE regexp_matches(term, '^(?:er(st|th)a)')")
def regex_terms(spark, sf_dir):
    return _matches(spark, sf_dir, Q.Regex("text", "er(st|th)a"))


@query(f"WITH {TOKENS} SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM post WHERE starts_with(term, 't') AND damerau_levenshtein(term, 'thers') <= 1")
def fuzzy_terms(spark, sf_dir):
    return _matches(spark, sf_dir, Q.Fuzzy("text", "thers", maxdist=1, prefix=1))


@query(f"WITH {TOKENS} SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM post WHERE term >= 'erst' AND term < 'erth'")
def term_range(spark, sf_dir):
    return _matches(spark, sf_dir, Q.TermRange("text", "erst", "erth", end_excl=True))


@query("SELECT o_orderkey AS doc_id, 1.0::DOUBLE AS score FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 50000")
def numeric_range(spark, sf_dir):
    return _rounded(Searcher(orders(spark, sf_dir)).matches(Q.NumericRange("o_totalprice", 1000, 50000, start_excl=True)))


@query("SELECT o_orderkey AS doc_id, 1.0::DOUBLE AS score FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def date_range(spark, sf_dir):
    ix = orders(spark, sf_dir)
    return _rounded(Searcher(ix).matches(QueryParser("o_orderstatus", ix.schema).parse("o_orderdate:1995")))


@query("SELECT p_partkey AS doc_id, 1.0::DOUBLE AS score FROM part WHERE p_size % 7 = 3")
def column_query(spark, sf_dir):
    return _rounded(Searcher(parts(spark, sf_dir)).matches(Q.ColumnQuery("p_size", lambda c: c % 7 == 3)))


@query("SELECT doc_id, 2.0::DOUBLE AS score FROM documents")
def every_document(spark, sf_dir):
    return _matches(spark, sf_dir, Q.Every(boost=2.0))


@query(_tree("3.0, 6)::DOUBLE AS score FROM d", "erst ther"))
def constant_score(spark, sf_dir):
    return _matches(spark, sf_dir, Q.ConstantScore(Q.Or((T("erst"), T("ther"))), score=3.0))


@query(f"WITH {SCORED} SELECT doc_id, round(sum(s), 6) AS score FROM hit WHERE term IN ('erst', 'enst') AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de') GROUP BY doc_id")
def parsed_query(spark, sf_dir):
    ix = documents(spark, sf_dir)
    return _rounded(Searcher(ix).matches(QueryParser("text", ix.schema).parse("(erst OR enst) REQUIRE lang:de")))


# Scoring models


def _model_sql(formula: str) -> str:
    return f"WITH {TOKENS} SELECT doc_id, round(sum({formula}), 6) AS score FROM post JOIN stat USING (term), tot WHERE term IN ('erst', 'ther') GROUP BY doc_id"


_OR = Q.Or((T("erst"), T("ther")))


@query(_model_sql(_BM25))
def score_bm25(spark, sf_dir):
    return _matches(spark, sf_dir, _OR)


@query(_model_sql("tf * (ln(n / (df + 1.0)) + 1)"))
def score_tfidf(spark, sf_dir):
    return _matches(spark, sf_dir, _OR, scoring.TFIDF())


@query(_model_sql("tf::DOUBLE"))
def score_frequency(spark, sf_dir):
    return _matches(spark, sf_dir, _OR, scoring.Frequency())


@query(_model_sql("tf * ln(((tf + 1.0) / (dl + 1)) / (tf * 1.0 / dl)) * (tf * ln((tf * 1.0 / dl) * (total * 1.0 / cf)) + (tf + 1) * ln(((tf + 1.0) / (dl + 1)) * (total * 1.0 / cf)) + 0.5 * ln(((tf + 1.0) / (dl + 1)) / (tf * 1.0 / dl)))"))
def score_dfree(spark, sf_dir):
    return _matches(spark, sf_dir, _OR, scoring.DFree())


@query(
    f"WITH {TOKENS}, x AS (SELECT doc_id, tf * ln(1 + (total * 1.0 / n) / dl) AS t, cf * 1.0 / n AS f FROM post JOIN stat USING (term), tot WHERE term IN ('erst', 'ther')) "
    "SELECT doc_id, round(sum(1 / (t + 1) * (t * ln(1 / f) + f / ln(2) + 0.5 * ln(2 * pi() * t) + t * (ln(t) - 1 / ln(2)))), 6) AS score FROM x GROUP BY doc_id"
)
def score_pl2(spark, sf_dir):
    return _matches(spark, sf_dir, _OR, scoring.PL2())


@query(_model_sql(f"-({_BM25})"))
def score_reverse(spark, sf_dir):
    return _matches(spark, sf_dir, _OR, scoring.Reverse(scoring.BM25F()))


@query(_model_sql("tf * 2.0 / dl"))
def score_function(spark, sf_dir):
    return _matches(spark, sf_dir, _OR, scoring.Function(lambda s: s.tf * 2.0 / s.dl))


@query(f"WITH {SCORED} SELECT doc_id, round(sum(s), 6) AS score FROM hit WHERE term IN ('erst', 'ther') GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark, sf_dir):
    return Searcher(documents(spark, sf_dir)).search(_OR, limit=10, columns=[]).hits.select("doc_id", F.round("score", 6).alias("score"))


# Estimates, near terms, moments


def _frequency(words: str) -> str:
    return ", ".join(f"coalesce((SELECT df FROM stat WHERE term = '{w}'), 0) AS {v}" for v, w in zip("abc", words.split()))


_SIZES = {
    "all": (Q.And((T("erst"), T("ther"), T("enst"))), "greatest(a + b + c - 2 * n, 0)", "least(a, b, c)", "a AND b AND c"),
    "any": (Q.Or((T("erst"), T("ther"), T("enst"))), "greatest(a, b, c)", "least(a + b + c, n)", "a OR b OR c"),
    "two of three": (Q.Or((T("erst"), T("ther"), T("enst")), minmatch=2), "greatest(ceil((a + b + c - n) / 2), 0)", "least((a + b + c) // 2, n)", "a::INT + b::INT + c::INT >= 2"),
    "without": (Q.AndNot(T("erst"), T("ther")), "greatest(a - b, 0)", "least(a, n - b)", "a AND NOT b"),
    "not": (Q.Not(T("ther")), "n - b", "n - b", "NOT b"),
    "nested": (Q.And((Q.Or((T("erst"), T("enst"))), Q.Not(T("ther")))), "greatest(greatest(a, c) + (n - b) - n, 0)", "least(least(a + c, n), n - b)", "(a OR c) AND NOT b"),
}


@query(
    f"WITH {TOKENS}, f AS (SELECT {_frequency('erst ther enst')}, n FROM tot), "
    "held AS (SELECT doc_id, coalesce(bool_or(term = 'erst'), false) AS a, coalesce(bool_or(term = 'ther'), false) AS b, coalesce(bool_or(term = 'enst'), false) AS c FROM documents LEFT JOIN post USING (doc_id) GROUP BY doc_id) "
    + " UNION ALL ".join(f"SELECT '{name}' AS tree, CAST({lower} AS BIGINT) AS lower, CAST({upper} AS BIGINT) AS upper, (SELECT count(*) FROM held WHERE {true}) AS found, true AS holds FROM f" for name, (_, lower, upper, true) in _SIZES.items())
)
def result_sizes(spark, sf_dir):
    """Bounds on the number of matches from frequencies alone, beside the number."""
    index, parts = documents(spark, sf_dir), []
    for name, (q, *_) in _SIZES.items():
        found = Searcher(index).matches(q).agg(F.count(F.lit(1)).alias("found"))
        # one row on either side
        parts.append(estimate(index, q).join(F.broadcast(found), F.lit(True)).select(F.lit(name).alias("tree"), "lower", "upper", "found", F.col("found").between(F.col("lower"), F.col("upper")).alias("holds")))
    return functools.reduce(DataFrame.unionAll, parts)


@query(rf"WITH {TOKENS}, words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) SELECT word, term, df, damerau_levenshtein(word, term) AS distance FROM words, stat WHERE regexp_full_match(term, '[a-z]+') AND abs(length(word) - length(term)) <= 1 AND damerau_levenshtein(word, term) <= 1")
def near_terms(spark, sf_dir):
    """Terms (of plain letters: SQL's distance counts bytes) of the documents within one edit of each word of the benchmark."""
    key = (spark.sparkContext.applicationId, sf_dir, "near")
    if key not in _held:
        _held[key] = TermNeighbours.write(documents(spark, sf_dir).term_stats.where("field = 'text' and term rlike '^[a-z]+$'").select("term", "df", "cf"), shared_path(spark, "near"))
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return _held[key].near_all(words, 1).select("word", "term", "df", F.col("distance").cast("long").alias("distance"))


@query("SELECT l_returnflag, l_linestatus, n, weight, round(mean, 4) AS mean, round(sum(l_quantity * (l_extendedprice - mean) ** 2) / min(weight), 0) AS variance FROM lineitem JOIN (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS weight, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS mean FROM lineitem GROUP BY ALL) USING (l_returnflag, l_linestatus) GROUP BY ALL")
def weighted_moments(spark, sf_dir):
    got = expand.weighted_moments(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag", "l_linestatus"])
    return got.select("l_returnflag", "l_linestatus", "n", "weight", F.round("mean", 4).alias("mean"), F.round("variance", 0).alias("variance"))


# Stored blocks with bounds


def document_blocks(spark, sf_dir) -> BlockIndex:
    """The documents' index stored in blocks, like languages and lengths together; stored once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, "stored blocks")
    if key not in _held:
        _held[key] = BlockIndex.write(documents(spark, sf_dir), shared_path(spark, "blocks"), order=("lang",))
    return _held[key]


def _ranked(spark, sf_dir, q, k: int = 10, **options) -> DataFrame:
    return _rounded(document_blocks(spark, sf_dir).top_k(q, k, **options).frame(spark))


def _best(select: str, words: str, k: int = 10) -> str:
    return f"{_tree(select, words)} ORDER BY score DESC, doc_id LIMIT {k}"


@query(SQL["bm25_topk"])
def block_topk(spark, sf_dir):
    return _ranked(spark, sf_dir, _OR)


@query(_best("coalesce(a, 0) + coalesce(b, 0) + 2 * coalesce(c, 0) + coalesce(d, 0), 6) AS score FROM d", "erst ther enst una", 25))
def block_topk_weighted(spark, sf_dir):
    return _ranked(spark, sf_dir, Q.Or((T("erst"), T("ther"), T("enst", 2.0), T("una"))), 25)


@query(_best("a + coalesce(b, 0), 6) AS score FROM d WHERE a IS NOT NULL AND c IS NULL", "erst enst ther"))
def block_topk_tree(spark, sf_dir):
    return _ranked(spark, sf_dir, Q.AndNot(Q.AndMaybe(T("erst"), T("enst")), T("ther")))


@query(_best("a + b, 6) AS score FROM d WHERE a IS NOT NULL AND b IS NOT NULL", "erst enst"))
def block_topk_all(spark, sf_dir):
    return _ranked(spark, sf_dir, Q.And((T("erst"), T("enst"))))


@query(SQL["bm25_topk"])
def anytime_topk(spark, sf_dir):
    """Waves by descending bound, with time enough."""
    return _ranked(spark, sf_dir, _OR, seconds=3600)


@query(
    f"WITH {TOKENS}, slot AS (SELECT doc_id, (row_number() OVER (ORDER BY lang NULLS FIRST, greatest(len(k), 1), doc_id) - 1) // 128 AS bucket FROM kept JOIN documents USING (doc_id)) "
    "SELECT term, CAST(bucket AS BIGINT) AS bucket, count(*) AS n, CAST(max(tf) AS DOUBLE) AS max_weight, min(dl) AS min_length FROM post JOIN slot USING (doc_id) GROUP BY term, bucket"
)
def block_heads(spark, sf_dir):
    heads = document_blocks(spark, sf_dir).heads.where("field = 'text'")
    return heads.select("term", "bucket", F.col("n").cast("long").alias("n"), "max_weight", F.col("min_length").cast("long").alias("min_length"))


# Positions


def _pair(a: str, b: str, test: str, score: str = "a.s + b.s") -> str:
    """SQL for documents with the words ``a`` and ``b`` at positions x and y for which ``test`` holds."""
    places = lambda name, w: f"{name} AS MATERIALIZED (SELECT doc_id, pos AS {name} FROM numbered WHERE term = '{w}')"
    scores = lambda name, w: f"{name} AS MATERIALIZED (SELECT doc_id, s FROM hit WHERE term = '{w}')"
    return (
        f"WITH {SCORED}, {scores('a', a)}, {scores('b', b)}, {places('x', a)}, {places('y', b)} "
        f"SELECT a.doc_id, round({score}, 6) AS score FROM a JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IN (SELECT x.doc_id FROM x JOIN y ON x.doc_id = y.doc_id WHERE {test})"
    )


@query(_pair("die", "der", "y = x + 1"))
def phrase_adjacent(spark, sf_dir):
    return _matches(spark, sf_dir, Q.Phrase("text", ("die", "der")))


@query(_pair("die", "der", "y - x BETWEEN 1 AND 3"))
def phrase_slop(spark, sf_dir):
    return _matches(spark, sf_dir, Q.Phrase("text", ("die", "der"), slop=3))


@query(_pair("die", "ein", "abs(y - x) BETWEEN 1 AND 3"))
def span_near(spark, sf_dir):
    return _matches(spark, sf_dir, Q.SpanNear((T("die"), T("ein")), slop=3, ordered=False))


@query(_pair("die", "ein", "y - x BETWEEN 1 AND 5"))
def span_near_ordered(spark, sf_dir):
    return _matches(spark, sf_dir, Q.SpanNear((T("die"), T("ein")), slop=5))


@query(f"WITH {SCORED} SELECT doc_id, round(s, 6) AS score FROM hit WHERE term = 'die' AND doc_id IN (SELECT doc_id FROM numbered WHERE term = 'die' AND pos <= 10)")
def span_first(spark, sf_dir):
    return _matches(spark, sf_dir, Q.SpanFirst(T("die"), limit=10))


@query(_pair("die", "ein", "x <= y AND x.doc_id IN (SELECT x.doc_id FROM x JOIN y ON x.doc_id = y.doc_id GROUP BY x.doc_id HAVING min(x) < min(y))"))
def span_before(spark, sf_dir):
    return _matches(spark, sf_dir, Q.SpanBefore(T("die"), T("ein")))


@query(_pair("die", "ein", "x < y"))
def ordered(spark, sf_dir):
    return _matches(spark, sf_dir, Q.Ordered((T("die"), T("ein"))))


@query(
    f"WITH {SCORED}, x AS MATERIALIZED (SELECT doc_id, pos AS x FROM numbered WHERE term = 'die'), y AS MATERIALIZED (SELECT doc_id, pos AS y FROM numbered WHERE term = 'ein') "
    "SELECT doc_id, round(s, 6) AS score FROM hit WHERE term = 'die' AND doc_id IN (SELECT x.doc_id FROM x LEFT JOIN y ON x.doc_id = y.doc_id AND y = x + 1 WHERE y IS NULL)"
)
def span_not(spark, sf_dir):
    return _matches(spark, sf_dir, Q.SpanNot(T("die"), Q.Phrase("text", ("die", "ein"))))


@query(_tree("coalesce(a, 0) + coalesce(b, 0), 6) AS score FROM d", "die ein"))
def span_or(spark, sf_dir):
    return _matches(spark, sf_dir, Q.SpanOr((T("die"), T("ein"))))


@query(_tree("a, 6) AS score FROM d WHERE a IS NOT NULL AND b IS NOT NULL", "die ein"))
def span_condition(spark, sf_dir):
    return _matches(spark, sf_dir, Q.SpanCondition(T("die"), T("ein")))


# Sorting, paging, collapsing, filters


@query("SELECT o_orderkey AS doc_id, CAST(row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) - 1 AS INTEGER) AS rank FROM orders WHERE o_orderstatus = 'O' ORDER BY rank LIMIT 50")
def sort_multi(spark, sf_dir):
    by = ["o_orderpriority", facets.FieldFacet("o_totalprice", reverse=True)]
    return Searcher(orders(spark, sf_dir)).search(Q.Term("o_orderstatus", "O"), limit=50, sortedby=by).hits.select("doc_id", "rank")


@query(f"WITH {SCORED} SELECT doc_id, round(sum(s), 6) AS score FROM hit WHERE term IN ('erst', 'ther') GROUP BY doc_id ORDER BY sum(s) DESC, doc_id LIMIT 10 OFFSET 10")
def page_2(spark, sf_dir):
    return Searcher(documents(spark, sf_dir)).page(_OR, 2, 10)[0].hits.select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {SCORED}, m AS (SELECT doc_id, sum(s) AS s FROM hit WHERE term IN ('erst', 'ther') GROUP BY doc_id) SELECT doc_id, source, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s DESC, doc_id) AS r FROM m JOIN documents USING (doc_id)) WHERE r <= 2")
def collapse_top2(spark, sf_dir):
    hits = Searcher(documents(spark, sf_dir)).search(_OR, limit=None, collapse="source", collapse_limit=2).hits
    return hits.select("doc_id", "source", F.round("score", 6).alias("score"))


@query(f"WITH {SCORED} SELECT doc_id, round(sum(s), 6) AS score FROM hit WHERE term IN ('erst', 'ther') AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1') GROUP BY doc_id")
def filter_mask(spark, sf_dir):
    return _rounded(Searcher(documents(spark, sf_dir)).matches(_OR, filter=Q.Term("lang", "en"), mask=Q.Term("source", "src1")))


@query(f"WITH {TOKENS} SELECT doc_id, array_to_string(list('text:' || term ORDER BY term), ',') AS terms FROM post WHERE term IN ('erst', 'ther') GROUP BY doc_id")
def matched_terms(spark, sf_dir):
    from quarry.plans.compiler import matched_terms as run

    return run(_OR, documents(spark, sf_dir)).select("doc_id", F.array_join("terms", ",").alias("terms"))


_TOP = f"WITH {SCORED}, e AS (SELECT doc_id, row_number() OVER (ORDER BY sum(s) DESC, doc_id) - 1 AS rank FROM hit WHERE term = 'erst' GROUP BY doc_id ORDER BY rank LIMIT 20), t AS (SELECT doc_id, row_number() OVER (ORDER BY sum(s) DESC, doc_id) - 1 AS rank FROM hit WHERE term = 'ther' GROUP BY doc_id ORDER BY rank LIMIT 20)"


@query(f"{_TOP} SELECT doc_id, CAST(row_number() OVER (ORDER BY p, rank) - 1 AS INTEGER) AS rank FROM (SELECT *, 0 AS p FROM e UNION ALL SELECT *, 1 AS p FROM t WHERE doc_id NOT IN (SELECT doc_id FROM e))")
def results_extend(spark, sf_dir):
    s = Searcher(documents(spark, sf_dir))
    return s.search(T("erst"), limit=20, columns=[]).extend(s.search(T("ther"), limit=20, columns=[])).select("doc_id", "rank")


@query(f"{_TOP} SELECT doc_id, CAST(row_number() OVER (ORDER BY (doc_id NOT IN (SELECT doc_id FROM t)), rank) - 1 AS INTEGER) AS rank FROM e")
def results_upgrade(spark, sf_dir):
    s = Searcher(documents(spark, sf_dir))
    return s.search(T("erst"), limit=20, columns=[]).upgrade(s.search(T("ther"), limit=20, columns=[])).select("doc_id", "rank")


def _tops(a: str, b: str, n: int) -> str:
    one = lambda name, w: f"{name} AS (SELECT doc_id, row_number() OVER (ORDER BY sum(s) DESC, doc_id) - 1 AS rank FROM hit WHERE term = '{w}' GROUP BY doc_id ORDER BY rank LIMIT {n})"
    return f"WITH {SCORED}, {one('e', a)}, {one('t', b)}"


def _two(spark, sf_dir, a: str, b: str, n: int):
    s = Searcher(documents(spark, sf_dir))
    return s.search(T(a), limit=n, columns=[]), s.search(T(b), limit=n, columns=[])


@query(f"{_tops('er', 're', 100)} SELECT doc_id, CAST(row_number() OVER (ORDER BY rank) - 1 AS INTEGER) AS rank FROM e WHERE doc_id IN (SELECT doc_id FROM t)")
def results_filter(spark, sf_dir):
    a, b = _two(spark, sf_dir, "er", "re", 100)
    return a.filter(b).select("doc_id", "rank")


@query(f"{_tops('er', 're', 100)} SELECT doc_id, CAST(row_number() OVER (ORDER BY p, rank) - 1 AS INTEGER) AS rank FROM (SELECT doc_id, rank, CASE WHEN doc_id IN (SELECT doc_id FROM t) THEN 0 ELSE 1 END AS p FROM e UNION ALL SELECT doc_id, rank, 2 FROM t WHERE doc_id NOT IN (SELECT doc_id FROM e))")
def results_upgrade_and_extend(spark, sf_dir):
    a, b = _two(spark, sf_dir, "er", "re", 100)
    return a.upgrade_and_extend(b).select("doc_id", "rank")


_SETS = f"WITH {TOKENS}, a AS (SELECT DISTINCT doc_id FROM post WHERE term = 'er'), b AS (SELECT DISTINCT doc_id FROM post WHERE term = 're')"


def _sets(spark, sf_dir):
    s = Searcher(documents(spark, sf_dir))
    return s.docs_for_query(T("er")), s.docs_for_query(T("re"))


@query(f"{_SETS} SELECT doc_id FROM a UNION SELECT doc_id FROM b")
def docset_union(spark, sf_dir):
    return search.union(*_sets(spark, sf_dir))


@query(f"{_SETS} SELECT doc_id FROM a WHERE doc_id IN (SELECT doc_id FROM b)")
def docset_intersection(spark, sf_dir):
    return search.intersection(*_sets(spark, sf_dir))


@query(f"{_SETS} SELECT doc_id FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)")
def docset_difference(spark, sf_dir):
    return search.difference(*_sets(spark, sf_dir))


@query(f"{_SETS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a)")
def docset_inverse(spark, sf_dir):
    return search.inverse(_sets(spark, sf_dir)[0], documents(spark, sf_dir))


@query(f"WITH {SCORED}, m AS (SELECT doc_id, sum(s) AS s FROM hit WHERE term IN ('erst', 'ther') GROUP BY doc_id) SELECT source AS key, count(*) - 2 AS n FROM m JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) > 2")
def collapse_counts(spark, sf_dir):
    return Searcher(documents(spark, sf_dir)).search(_OR, limit=None, collapse="source", collapse_limit=2).collapsed


@query("SELECT o_orderkey AS doc_id, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS INTEGER) AS rank FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY rank LIMIT 20 OFFSET 20")
def sort_reverse_page(spark, sf_dir):
    return Searcher(orders(spark, sf_dir)).search(Q.Term("o_orderpriority", "1-URGENT"), limit=20, offset=20, sortedby=facets.FieldFacet("o_totalprice", reverse=True)).hits.select("doc_id", "rank")


@query("WITH t AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F') SELECT n AS total, CAST(ceil(n / 25.0) AS BIGINT) AS page_count, CAST(25 AS INTEGER) AS offset, 50 >= n AS is_last FROM t")
def page_facts(spark, sf_dir):
    return Searcher(orders(spark, sf_dir)).page(Q.Term("o_orderstatus", "F"), 2, 25)[1]


# Facets


def _group(ix, q, facet, kind="count") -> DataFrame:
    return Searcher(ix).search(q, limit=1, groupedby={"g": facet}, maptype=kind).groups["g"]


@query("SELECT o_orderpriority AS key, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def facet_field(spark, sf_dir):
    return _group(orders(spark, sf_dir), Q.Term("o_orderstatus", "F"), "o_orderpriority")


@query("SELECT CASE WHEN p_size >= 1 AND p_size < 51 THEN 1 + floor((p_size - 1) / 10)::BIGINT * 10 END AS start, count(*) AS n FROM part GROUP BY 1")
def facet_range(spark, sf_dir):
    return _group(parts(spark, sf_dir), Q.Every(), facets.RangeFacet("p_size", 1, 51, 10)).select(F.col("key.start").alias("start"), "n")


@query("SELECT CASE WHEN p_retailprice >= 900 AND p_retailprice < 950 THEN 900 WHEN p_retailprice >= 950 AND p_retailprice < 1050 THEN 950 WHEN p_retailprice >= 1050 AND p_retailprice < 1100 THEN 1050 END AS start, count(*) AS n FROM part GROUP BY 1")
def facet_range_gaps(spark, sf_dir):
    return _group(parts(spark, sf_dir), Q.Every(), facets.RangeFacet("p_retailprice", 900, 1100, [50, 100], hardend=True)).select(F.col("key.start").alias("start"), "n")


@query("SELECT date_trunc('year', o_orderdate) AS start, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1992-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1992-01-01' AND o_orderdate < TIMESTAMP '1999-01-01') HAVING count(*) > 0")
def facet_daterange(spark, sf_dir):
    facet = facets.DateRangeFacet("o_orderdate", dt.datetime(1992, 1, 1), dt.datetime(1999, 1, 1), facets.Months(12))
    return _group(orders(spark, sf_dir), Q.Every(), facet).select(F.col("key.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT CASE WHEN o_totalprice < 50000 THEN 'cheap' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'dear' END AS key, count(*) AS n FROM orders GROUP BY 1")
def facet_query(spark, sf_dir):
    named = {"cheap": Q.NumericRange("o_totalprice", None, 50000, end_excl=True), "mid": Q.NumericRange("o_totalprice", None, 200000, end_excl=True)}
    return _group(orders(spark, sf_dir), Q.Every(), facets.QueryFacet(named, other="dear"))


@query("SELECT o_orderstatus AS k0, o_orderpriority AS k1, count(*) AS n FROM orders GROUP BY 1, 2")
def facet_multi(spark, sf_dir):
    return _group(orders(spark, sf_dir), Q.Every(), facets.MultiFacet((facets.FieldFacet("o_orderstatus"), facets.FieldFacet("o_orderpriority")))).select("key.k0", "key.k1", "n")


@query("SELECT key, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_type, ' ')) AS key FROM part) GROUP BY 1")
def facet_overlap(spark, sf_dir):
    return _group(parts(spark, sf_dir), Q.Every(), facets.FieldFacet("p_type", overlap=True))


@query(f"WITH {SCORED}, m AS (SELECT doc_id, sum(s) AS s FROM hit WHERE term IN ('erst', 'ther') GROUP BY doc_id) SELECT source AS key, arg_min(doc_id, (-s, doc_id)) AS doc_id, count(*) AS n FROM m JOIN documents USING (doc_id) GROUP BY 1")
def facet_best(spark, sf_dir):
    return _group(documents(spark, sf_dir), _OR, "source", "best")


# Nested documents


@query("SELECT o.o_orderkey AS doc_id, CAST(count(*) AS DOUBLE) AS score FROM orders o JOIN lineitem l ON o_orderkey = l_orderkey WHERE l_quantity > 45 AND o_orderstatus = 'F' GROUP BY 1")
def nested_parent(spark, sf_dir):
    ix = blocks(spark, sf_dir)
    q = Q.NestedParent(Q.And((Q.Term("kind", "order"), Q.Term("status", "F"))), Q.And((Q.Term("kind", "item"), Q.ConstantScore(Q.NumericRange("quantity", 45, None, start_excl=True)))), fold="count")
    return _rounded(Searcher(ix).matches(q)).select(F.floor(F.col("doc_id") / 100).alias("doc_id"), "score")


@query("SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS doc_id, 1.0::DOUBLE AS score FROM orders o JOIN lineitem l ON o_orderkey = l_orderkey WHERE o_totalprice > 300000")
def nested_children(spark, sf_dir):
    q = Q.NestedChildren(Q.Term("kind", "order"), Q.NumericRange("price", 300000, None, start_excl=True))
    return _rounded(Searcher(blocks(spark, sf_dir)).matches(q))


def blocks(spark, sf_dir) -> SearchIndex:
    """Orders and their items as one table of documents, each item with its order as parent."""

    def make():
        o, item = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
        key = F.col("o_orderkey") * 100
        head = o.select(key.alias("doc_id"), key.alias("parent_id"), F.lit("order").alias("kind"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.lit(None).cast("double").alias("quantity"))
        up = F.col("l_orderkey") * 100
        line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
        body = item.withColumn("line", line).select((up + F.col("line")).alias("doc_id"), up.alias("parent_id"), F.lit("item").alias("kind"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("price"), F.col("l_quantity").alias("quantity"))
        return SearchIndex.build(head.unionByName(body), Schema(kind=ID(), status=ID(), price=NUMERIC("float"), quantity=NUMERIC("float")))

    return _index(spark, sf_dir, "blocks", lambda: make().laid())


# Suggestion, expansion, vectors, languages


@query(f"WITH {TOKENS} SELECT term, round(-(2.0 + 0.5 / cf), 9) AS score FROM stat WHERE damerau_levenshtein(term, 'thers') <= 2 AND term <> 'thers' ORDER BY -(2.0 + 0.5 / cf) DESC, term LIMIT 5")
def suggest_terms(spark, sf_dir):
    return suggest.suggest(documents(spark, sf_dir), "text", "thers").select("term", F.round("score", 9).alias("score"))


@query(f"WITH {TOKENS} SELECT term, df FROM stat WHERE starts_with(term, 'the') ORDER BY df DESC, term LIMIT 5")
def autocomplete_prefix(spark, sf_dir):
    return suggest.complete(documents(spark, sf_dir), "text", "the")


@query(f"WITH {TOKENS} SELECT term, round(cf * ln(n * 1.0 / df), 6) AS score FROM stat, tot ORDER BY cf * ln(n * 1.0 / df) DESC, term DESC LIMIT 10")
def distinctive_terms(spark, sf_dir):
    return documents(spark, sf_dir).most_distinctive_terms("text", 10).select("term", F.round("score", 6).alias("score"))


@query(f"WITH {TOKENS} SELECT term, CAST(cf AS DOUBLE) AS cf FROM stat ORDER BY cf DESC, term DESC LIMIT 10")
def frequent_terms(spark, sf_dir):
    return documents(spark, sf_dir).most_frequent_terms("text", 10)


@query(
    f"WITH {TOKENS}, w AS (SELECT term, sum(tf) AS w FROM post WHERE doc_id IN (3, 7, 9) GROUP BY term), s AS (SELECT term, w * log2((1 + cf * 1.0 / n) / (cf * 1.0 / n)) + log2(1 + cf * 1.0 / n) AS s FROM w JOIN stat USING (term), tot), m AS (SELECT max(s) AS m FROM s) "
    "SELECT term, round(s / ((m * ln((1 + m / n) / (m / n)) + ln(1 + m / n)) / ln(2)), 6) AS score FROM s, m, tot ORDER BY s DESC, term LIMIT 5"
)
def key_terms_bo1(spark, sf_dir):
    ix = documents(spark, sf_dir)
    return expand.key_terms(ix, ix.docs.where(F.col("doc_id").isin(3, 7, 9)), "text").select("term", F.round("score", 6).alias("score"))


def _key_terms(chosen: str, formula: str) -> str:
    """SQL: term and score of the words of documents, from w (their weight there), cf, n, total and top (their weight together)."""
    return f"w AS (SELECT term, sum(tf) AS w FROM post WHERE doc_id IN ({chosen}) GROUP BY term), k AS (SELECT term, {formula} AS s FROM w JOIN stat USING (term), tot, (SELECT sum(w) AS top FROM w))"


@query(f"WITH {TOKENS}, {_key_terms('3, 7, 9', 'w * log2((1 + w * top / total) / (w * top / total)) + log2(1 + w * top / total)')} SELECT term, round(s, 6) AS score FROM k ORDER BY s DESC, term LIMIT 5")
def key_terms_bo2(spark, sf_dir):
    ix = documents(spark, sf_dir)
    return expand.key_terms(ix, ix.docs.where(F.col("doc_id").isin(3, 7, 9)), "text", model="bo2").select("term", F.round("score", 6).alias("score"))


@query(f"WITH {TOKENS}, {_key_terms('3, 7, 9', 'CASE WHEN w / top < cf * 1.0 / total THEN 0.0 ELSE w / top * log2((w / top) / (w * 1.0 / total)) END')} SELECT term, round(s, 6) AS score FROM k ORDER BY s DESC, term LIMIT 5")
def key_terms_kl(spark, sf_dir):
    ix = documents(spark, sf_dir)
    return expand.key_terms(ix, ix.docs.where(F.col("doc_id").isin(3, 7, 9)), "text", model="kl").select("term", F.round("score", 6).alias("score"))


@query(
    f"WITH {SCORED}, {_key_terms('3', 'w * log2((1 + cf * 1.0 / n) / (cf * 1.0 / n)) + log2(1 + cf * 1.0 / n)')}, b AS (SELECT term, s / ((max(s) OVER () * ln((1 + max(s) OVER () / n) / (max(s) OVER () / n)) + ln(1 + max(s) OVER () / n)) / ln(2)) AS b FROM k, tot ORDER BY b DESC, term LIMIT 5) "
    "SELECT doc_id, round(sum(s * b), 6) AS score FROM hit JOIN b USING (term) WHERE doc_id <> 3 GROUP BY doc_id ORDER BY sum(s * b) DESC, doc_id LIMIT 10"
)
def more_like(spark, sf_dir):
    return expand.more_like(Searcher(documents(spark, sf_dir)), 3, "text").hits.select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings WHERE vec_id <> 0) ORDER BY s DESC, vec_id LIMIT 10")
def vector_cosine_topk(spark, sf_dir):
    return vectors.similar_rows(table(spark, sf_dir, "embeddings"), 0, 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def _detect_sql() -> str:
    counts = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in languages.STOP_WORDS[c])}))) AS {c}_" for c in ("fr", "en", "de", "es", "it"))
    best = "CASE WHEN greatest(fr_, en_, de_, es_, it_) = 0 THEN '' WHEN fr_ >= greatest(en_, de_, es_, it_) THEN 'fr' WHEN en_ >= greatest(de_, es_, it_) THEN 'en' WHEN de_ >= greatest(es_, it_) THEN 'de' WHEN es_ >= it_ THEN 'es' ELSE 'it' END"
    return rf"SELECT doc_id, {best} AS language FROM (SELECT doc_id, {counts} FROM (SELECT doc_id, string_split_regex(lower(text), '\s+') AS w FROM documents))"


@query(_detect_sql())
def lang_detect_stopwords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", languages.detect(F.col("text")).alias("language"))


@query()
def simhash(spark, sf_dir):
    """32-bit hashes that are near (few bits apart) where texts share most words; the tests compare them by ``hamming``."""
    return table(spark, sf_dir, "documents").select("doc_id", expand.simhash(F.split("text", " ")).alias("hash"))


@query()
def highlight_top(spark, sf_dir):
    hits = Searcher(documents(spark, sf_dir)).search(_OR, limit=10).hits
    return highlight.highlight(hits, "text", _OR, "text").select("doc_id", "highlight")


PLACED = Schema(text=TEXT(stored=True, characters=True))


def placed_documents(spark, sf_dir) -> SearchIndex:
    """The documents' texts with the characters of every place."""
    return _index(spark, sf_dir, "placed", lambda: _over(table(spark, sf_dir, "documents"), PLACED))


#: Words of documents with their first and last characters: gaps between words and words by turns.
_PLACES = rf"""
words AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{_PATTERN}')) AS w, unnest(regexp_split_to_array(text, '{_PATTERN}')[:-2]) AS g, generate_subscripts(regexp_extract_all(text, '{_PATTERN}'), 1) AS i
  FROM documents
),
place AS (SELECT doc_id, i, lower(w) AS w, CAST(sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e, length(w) AS n FROM words)
"""
_escape = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')".format


@query(f"WITH {_PLACES} SELECT w AS term, doc_id, count(*) AS tf, CAST(sum(e - n) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM place WHERE length(w) >= 2 AND w NOT IN ({_STOPS}) GROUP BY w, doc_id")
def character_postings(spark, sf_dir):
    p = placed_documents(spark, sf_dir).postings
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return p.select("term", "doc_id", F.col("tf").cast("long").alias("tf"), total("starts").alias("starts"), total("ends").alias("ends"))


@query(
    f"WITH {SCORED}, best AS (SELECT doc_id, sum(s) AS score FROM hit WHERE term IN ('erst', 'ther') GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10), {_PLACES.strip()}, "
    "mark AS (SELECT doc_id, w, e - n AS s, e, greatest(e - n - 40, 0) AS a, least(e + 40, length(text)) AS b FROM place JOIN documents USING (doc_id) WHERE w IN ('erst', 'ther') AND doc_id IN (SELECT doc_id FROM best)), "
    "island AS (SELECT *, sum(CASE WHEN a > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM mark)), "
    "fragment AS (SELECT doc_id, k, min(a) AS a, max(b) AS b, max(e) AS last, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) * count(DISTINCT w) DESC, min(a)) AS r FROM island GROUP BY doc_id, k), "
    f"piece AS (SELECT i.doc_id, i.k, i.s, {_escape('substr(text, till + 1, i.s - till)')} || '<strong>' || {_escape('substr(text, i.s + 1, e - i.s)')} || '</strong>' AS t FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id, k ORDER BY s), min(a) OVER (PARTITION BY doc_id, k)) AS till FROM island) i JOIN documents USING (doc_id)), "
    f"line AS (SELECT f.doc_id, f.a, string_agg(t, '' ORDER BY s) || {_escape('substr(min(text), min(f.last) + 1, min(f.b) - min(f.last))')} AS t FROM fragment f JOIN piece p ON p.doc_id = f.doc_id AND p.k = f.k JOIN documents d ON d.doc_id = f.doc_id WHERE r <= 3 GROUP BY f.doc_id, f.a) "
    "SELECT doc_id, string_agg(t, '...' ORDER BY a) AS highlight FROM line GROUP BY doc_id"
)
def highlight_places(spark, sf_dir):
    """Excerpts from places in postings; no text is analysed."""
    index = placed_documents(spark, sf_dir)
    hits = Searcher(index).search(_OR, limit=10, columns=["text"]).hits
    return highlight.from_places(hits, index, _OR, "text", "text").select("doc_id", "highlight")


BOOSTED = Schema(words=TEXT(analysis.space_tokenizer() | analysis.lowercase() | analysis.delimited_attribute(), token_boosts="^"))


@query("SELECT p_partkey AS doc_id, w AS term, count(*) AS tf, CAST(sum(b) AS DOUBLE) AS weight FROM (SELECT p_partkey, unnest(string_split(lower(p_type), ' ')) AS w, generate_subscripts(string_split(p_type, ' '), 1) * 0.25 + p_size % 4 AS b FROM part) GROUP BY p_partkey, w")
def token_boosts(spark, sf_dir):
    marked = F.array_join(F.transform(F.split("p_type", " "), lambda w, i: F.concat(w, F.lit("^"), (i + 1) * 0.25 + F.col("p_size") % 4)), " ")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), marked.alias("words"))
    return SearchIndex.build(parts, BOOSTED).postings.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), "weight")


@query("SELECT o_orderkey AS doc_id, o_totalprice, count(*) OVER (ORDER BY o_totalprice RANGE BETWEEN CURRENT ROW AND 1000 FOLLOWING) AS in_window FROM orders")
def sliding_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_totalprice")
    return expand.windows_of(rows, "o_totalprice", 1000.0).drop("spread")


# Updating

#: The documents after a change of every third.
_CHANGED = "changed AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || ' zusatz ther' ELSE text END AS text, lang FROM documents)"
_CHANGED_TOKENS = f"{_CHANGED}, {TOKENS.strip().replace('FROM documents', 'FROM changed')}"


def streamed_documents(spark, sf_dir) -> SearchIndex:
    """The documents in a streamed index: two batches, a third that replaces every third document, then a merge and a late batch."""
    from quarry.streaming.snapshots import StreamedIndex

    key = (spark.sparkContext.applicationId, sf_dir, "streamed")
    if key not in _held:
        index = StreamedIndex(spark, shared_path(spark, "streamed"), DOCUMENTS)
        docs = spread(table(spark, sf_dir, "documents"))
        changed = docs.where("doc_id % 3 = 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" zusatz ther")))
        for k, batch in enumerate((docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 <> 0"), changed.where("doc_id % 2 = 0"))):
            index.upsert(batch, "documents", k)
        index.merge(all_segments=True)
        index.upsert(changed.where("doc_id % 2 <> 0"), "documents", 3)
        index.upsert(docs, "documents", 3)  # a batch that is there already changes nothing
        _held[key] = index.open()
    return _held[key]


@query(f"WITH {_CHANGED_TOKENS} SELECT term, CAST(df AS BIGINT) AS df, CAST(cf AS DOUBLE) AS cf FROM stat")
def snapshot_term_stats(spark, sf_dir):
    return streamed_documents(spark, sf_dir).term_stats.where("field = 'text'").select("term", "df", "cf")


@query(f"WITH {_CHANGED_TOKENS}, hit AS (SELECT p.doc_id, p.term, {_BM25} AS s FROM post p JOIN stat USING (term), tot) SELECT doc_id, round(sum(s), 6) AS score FROM hit WHERE term IN ('zusatz', 'ther') GROUP BY doc_id")
def snapshot_search(spark, sf_dir):
    return _rounded(Searcher(streamed_documents(spark, sf_dir)).matches(Q.Or((T("zusatz"), T("ther")))))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def dedupe_keep_last(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("arrival", F.struct("ts", "event_id"))
    return keep_last(rows, ["user_id"], "arrival").select("user_id", "event_id", "event_type")


@query("SELECT event_type AS term, count(*) AS df FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY 1")
def incremental_upsert(spark, sf_dir):
    """All events: the odd ones are stored, the even ones arrive and replace their user's, unless that is newer."""
    schema = Schema(event_type=ID(), user_id=NUMERIC(bits=64, unique=True))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "event_type", "user_id")
    old = keep_last(rows.where("doc_id % 2 = 1"), ["user_id"])
    new = rows.where("doc_id % 2 = 0")
    held = SearchIndex.build(old, schema)
    newer = keep_last(new, ["user_id"]).join(old.select("user_id", F.col("doc_id").alias("o")), "user_id", "left").where("o is null or doc_id > o").drop("o")
    return held.update(newer).term_stats.where("field = 'event_type'").select("term", "df")


@query("SELECT event_type AS term, count(*) AS df FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click') GROUP BY 1")
def delete_by_query(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "event_type")
    return SearchIndex.build(rows, Schema(event_type=ID())).delete_by_query(Q.Term("event_type", "click")).term_stats.select("term", "df")


@query(f"WITH {TOKENS} SELECT term, df, CAST(cf AS DOUBLE) AS cf FROM stat")
def add_documents(spark, sf_dir):
    """Documents added in two parts give the statistics of the whole."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ix = SearchIndex.build(docs.where("doc_id < 300"), Schema(text=TEXT())).add(docs.where("doc_id >= 300"))
    return ix.term_stats.select("term", "df", "cf")


@query("WITH u AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 150000), l AS (SELECT o_orderkey, 'old' AS o_orderstatus FROM orders WHERE o_totalprice < 200000 AND o_orderkey NOT IN (SELECT o_orderkey FROM u)) SELECT o_orderstatus AS term, count(*) AS df FROM (SELECT * FROM u UNION ALL SELECT * FROM l) GROUP BY 1")
def overlay_index(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus", "o_totalprice")
    schema = Schema(o_orderstatus=ID())
    lower = SearchIndex.build(rows.where("o_totalprice < 200000").withColumn("o_orderstatus", F.lit("old")), schema)
    return lower.overlay(SearchIndex.build(rows.where("o_totalprice > 150000"), schema)).term_stats.select("term", "df")


@query("SELECT field, CAST(sum(df) AS BIGINT) AS df FROM (SELECT 'o_orderpriority' AS field, count(*) AS df FROM orders UNION ALL SELECT 'o_custkey', count(*) FROM orders) GROUP BY 1")
def add_remove_field(spark, sf_dir):
    ix = SearchIndex.build(table(spark, sf_dir, "orders"), Schema(o_orderpriority=ID(), o_orderstatus=ID()), "o_orderkey")
    return ix.add_field("o_custkey", ID()).remove_field("o_orderstatus").term_stats.groupBy("field").agg(F.sum("df").alias("df"))


@query("SELECT CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS BIGINT) AS doc_id, o_orderkey FROM orders")
def number_documents(spark, sf_dir):
    return numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("doc_id", "o_orderkey")


@query("SELECT event_id AS doc_id, max(CASE WHEN event_type = 'login' OR event_id % 50 = 0 THEN event_id END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS parent_id FROM events")
def nearest_parent(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "event_type")
    return with_parents(rows, F.expr("event_type = 'login' OR doc_id % 50 = 0")).select("doc_id", "parent_id")


# The vocabulary


@query(f"WITH {TOKENS} SELECT term FROM stat WHERE starts_with(term, 'th')")
def lexicon_prefix(spark, sf_dir):
    return documents(spark, sf_dir).lexicon("text", "th")


@query(f"WITH {TOKENS} SELECT CAST(cf AS DOUBLE) AS frequency, df AS doc_frequency FROM stat WHERE term = 'ther'")
def term_frequency(spark, sf_dir):
    return documents(spark, sf_dir).frequency("text", "ther")


@query(f"WITH {TOKENS} SELECT doc_id, CAST(min(dl) AS INTEGER) AS length FROM post GROUP BY doc_id")
def doc_lengths(spark, sf_dir):
    return documents(spark, sf_dir).doc_lengths("text")


@query(f"WITH {TOKENS} SELECT term, CAST(tf AS INTEGER) AS tf, array_to_string(list_transform(positions, lambda x: CAST(x AS VARCHAR)), ',') AS at FROM post WHERE doc_id = 5")
def term_vector(spark, sf_dir):
    return documents(spark, sf_dir).term_vector(5, "text").select("term", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("at"))


@query(f"WITH {TOKENS} SELECT term, df, CAST(cf AS DOUBLE) AS cf FROM stat WHERE starts_with(term, 't') AND damerau_levenshtein(term, 'thers') <= 1")
def terms_within(spark, sf_dir):
    return documents(spark, sf_dir).terms_within("text", "thers", 1, 1)


@query(f"WITH {TOKENS} SELECT term FROM stat WHERE starts_with(term, 'the') ORDER BY term LIMIT 7")
def autocomplete_alphabetical(spark, sf_dir):
    return suggest.complete(documents(spark, sf_dir), "text", "the", 7, by="term").select("term")


@query(f"WITH {TOKENS} SELECT round(ln(n / (df + 1.0)) + 1, 9) AS idf FROM stat, tot WHERE term = 'ther'")
def term_idf(spark, sf_dir):
    return Searcher(documents(spark, sf_dir)).idf("text", "ther").select(F.round("idf", 9).alias("idf"))


# The query language


def _parsed(spark, sf_dir, text: str, **options) -> DataFrame:
    ix = documents(spark, sf_dir)
    return _rounded(Searcher(ix).matches(QueryParser("text", ix.schema, **options).parse(text)))


@query(_pair("die", "der", "y - x BETWEEN 1 AND 2", "2.5 * (a.s + b.s)"))
def parsed_phrase(spark, sf_dir):
    return _parsed(spark, sf_dir, '"die der"~2^2.5')


@query(_tree("coalesce(a, 0) + coalesce(b, 0), 6) AS score FROM d WHERE (a IS NOT NULL OR b IS NOT NULL) AND c IS NULL", "erst ther enst"))
def parsed_or_not(spark, sf_dir):
    return _parsed(spark, sf_dir, "(erst OR ther) ANDNOT enst")


@query(_tree("a + coalesce(b, 0), 6) AS score FROM d WHERE a IS NOT NULL", "erst ther"))
def parsed_andmaybe(spark, sf_dir):
    return _parsed(spark, sf_dir, "erst ANDMAYBE ther")


@query(_tree("coalesce(a, 0) * 3 + coalesce(b, 0), 6) AS score FROM d", "erst ther"))
def parsed_boost(spark, sf_dir):
    return _parsed(spark, sf_dir, "erst^3 OR ther")


@query(f"WITH {TOKENS} SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM post WHERE starts_with(term, 'ther')")
def parsed_prefix(spark, sf_dir):
    return _parsed(spark, sf_dir, "ther*")


@query(f"WITH {TOKENS} SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM post WHERE damerau_levenshtein(term, 'thers') <= 1")
def parsed_fuzzy(spark, sf_dir):
    return _parsed(spark, sf_dir, "thers~", features=FEATURES)


@query("SELECT o_orderkey AS doc_id, 2.0::DOUBLE AS score FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 60000 AND o_orderstatus = 'F'")
def parsed_range(spark, sf_dir):
    ix = orders(spark, sf_dir)
    return _rounded(Searcher(ix, scoring.Function(lambda s: s.tf)).matches(QueryParser("o_orderstatus", ix.schema).parse("o_totalprice:[1000 TO 60000} F")))


@query("SELECT o_orderkey AS doc_id, 1.0::DOUBLE AS score FROM orders WHERE o_totalprice > 300000")
def parsed_greater(spark, sf_dir):
    ix = orders(spark, sf_dir)
    return _rounded(Searcher(ix).matches(QueryParser("o_orderstatus", ix.schema, gt_lt=True).parse("o_totalprice:>300000")))


@query(f"WITH {SCORED} SELECT doc_id, round(sum(s), 6) AS score FROM hit WHERE term IN ('erst', 'ther') AND doc_id IN (SELECT doc_id FROM hit WHERE term = 'erst') AND doc_id NOT IN (SELECT doc_id FROM hit WHERE term = 'enst') GROUP BY doc_id")
def parsed_simple(spark, sf_dir):
    ix = documents(spark, sf_dir)
    return _rounded(Searcher(ix).matches(simple_parser("text", ix.schema).parse("+erst ther -enst")))


@query("WITH w AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS n, regexp_extract_all(lower(p_type), '[a-z0-9]+') AS t FROM part) SELECT p_partkey AS doc_id, CAST(len(list_filter(n, lambda x: x = 'small')) + 2 * len(list_filter(t, lambda x: x = 'small')) AS DOUBLE) AS score FROM w WHERE list_contains(n, 'small') OR list_contains(t, 'small')")
def parsed_multifield(spark, sf_dir):
    ix = parts(spark, sf_dir)
    return _rounded(Searcher(ix, scoring.Frequency()).matches(multifield({"p_name": 1.0, "p_type": 2.0}, ix.schema).parse("small")))


# Filters of analysis


def _words(spark, sf_dir, chain, source: str = "part", column: str = "p_name") -> DataFrame:
    return table(spark, sf_dir, source).select(F.explode(chain.terms(F.col(column))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _words_sql(value: str, source: str = "part", column: str = "p_name", keep: str = "true") -> str:
    return rf"SELECT term, count(*) AS n FROM (SELECT {value} AS term FROM (SELECT unnest(regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}_*]+')) AS w FROM {source}) WHERE {keep}) GROUP BY term"


@query(_words_sql("reverse(w)"))
def filter_reverse(spark, sf_dir):
    return _words(spark, sf_dir, analysis.simple() | analysis.reverse())


@query(_words_sql(r"regexp_replace(w, '(e)(.)', '\2\1', 'g')"))
def filter_substitution(spark, sf_dir):
    return _words(spark, sf_dir, analysis.simple() | analysis.substitution("(e)(.)", r"\2\1"))


@query(_words_sql("translate(replace(w, 'ß', 'ss'), 'éèêàçñó', 'eeeacno')", "documents", "text"))
def filter_charset(spark, sf_dir):
    fold = dict(zip("éèêàçñó", "eeeacno")) | {"ß": "ss"}
    return _words(spark, sf_dir, analysis.simple(pattern=r"[\p{L}\p{N}_*]+") | analysis.charset(fold), "documents", "text")


@query(_words_sql("w", keep="length(w) BETWEEN 4 AND 6 AND w NOT IN ('steel', 'green')"))
def filter_stop(spark, sf_dir):
    return _words(spark, sf_dir, analysis.simple() | analysis.stop(("steel", "green"), 4, 6))


@query("SELECT term, count(*) AS n FROM (SELECT split_part(unnest(string_split(lower(p_name), ' ')) || '^' || p_size, '^', 1) AS term FROM part) GROUP BY term")
def filter_delimited(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("words", F.expr("array_join(transform(split(lower(p_name), ' '), w -> concat(w, '^', p_size)), ' ')"))
    chain = analysis.space_tokenizer() | analysis.delimited_attribute()
    return rows.select(F.explode(chain.terms(F.col("words"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT term, count(*) AS n FROM (SELECT trim(unnest(string_split(p_brand || ' , ' || p_type || ',' || p_size, ','))) AS term FROM part) GROUP BY term")
def tokenize_commas(spark, sf_dir):
    chain = analysis.keyword(commas=True)
    return table(spark, sf_dir, "part").select(F.explode(chain.terms(F.concat("p_brand", F.lit(" , "), "p_type", F.lit(","), "p_size"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lower(n_name) AS term, count(*) AS n FROM nation GROUP BY 1")
def tokenize_id(spark, sf_dir):
    return _words(spark, sf_dir, analysis.id_analyzer(True), "nation", "n_name")


@query("SELECT gram AS term, count(*) AS n FROM (SELECT right(w, k) AS gram FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS w FROM part), (VALUES (2), (3)) s(k) WHERE k <= length(w)) GROUP BY 1")
def ngrams_at_end(spark, sf_dir):
    return _words(spark, sf_dir, analysis.ngram_words(2, 3, "end"))


@query("SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS distance, round(CASE WHEN greatest(length(a.n_name), length(b.n_name)) = 0 THEN 1.0 ELSE (greatest(length(a.n_name), length(b.n_name)) - levenshtein(a.n_name, b.n_name)) * 1.0 / greatest(length(a.n_name), length(b.n_name)) * least(length(a.n_name), length(b.n_name)) / greatest(length(a.n_name), length(b.n_name)) END, 9) AS similarity FROM nation a JOIN region r ON a.n_regionkey = r.r_regionkey JOIN nation b ON b.n_regionkey = r.r_regionkey")
def edit_distance(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rows = n.select("n_regionkey", F.col("n_name").alias("a")).join(n.select("n_regionkey", F.col("n_name").alias("b")), "n_regionkey")
    return rows.select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"), F.round(distance.similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


# Facets, more


@query("SELECT o_orderstatus AS key, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY 1")
def facet_lists(spark, sf_dir):
    got = _group(orders(spark, sf_dir), Q.NumericRange("o_totalprice", 250000, None, start_excl=True), "o_orderstatus", "list")
    return got.select("key", F.get("doc_ids", F.lit(0)).alias("first"), F.element_at("doc_ids", -1).alias("last"), "n")


@query("SELECT CAST(p_size % 5 AS BIGINT) AS key, count(*) AS n FROM part GROUP BY 1")
def facet_function(spark, sf_dir):
    return _group(parts(spark, sf_dir), Q.Every(), facets.FunctionFacet(lambda: (F.col("p_size") % 5).cast("long")))


@query("SELECT user_id % 10 AS key, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    from quarry.streaming.ingest import facet_counts

    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return facet_counts(rows, "key", "ts").select("key", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query(f"WITH {TOKENS}, d AS (SELECT doc_id, bool_or(term = 'erst') AS a, bool_or(term = 'ther') AS b, bool_or(term = 'die') AS c FROM post GROUP BY doc_id) SELECT doc_id, array_to_string(list_filter([CASE WHEN a AND NOT b THEN 'first' END, CASE WHEN b OR c THEN 'second' END], lambda x: x IS NOT NULL), ',') AS matched FROM d WHERE (a AND NOT b) OR b OR c")
def percolate(spark, sf_dir):
    from quarry.streaming import ingest

    stored = {"first": Q.AndNot(T("erst"), T("ther")), "second": Q.Or((T("ther"), T("die")))}
    return ingest.percolate(table(spark, sf_dir, "documents"), "text", stored).select("doc_id", F.array_join("matched", ",").alias("matched"))


# Vectors, more


_V = "CAST(embedding AS DOUBLE[])"


@query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, list_inner_product({_V}, (SELECT {_V} FROM embeddings WHERE vec_id = 1)) AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 10")
def vector_product_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return vectors.search(v, v.where("vec_id = 1").first()["embedding"], 10, "vec_id", metric="ip").select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(-s, 6) AS score FROM (SELECT vec_id, list_distance({_V}, (SELECT {_V} FROM embeddings WHERE vec_id = 1)) AS s FROM embeddings) ORDER BY s, vec_id LIMIT 10")
def vector_distance_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return vectors.search(v, v.where("vec_id = 1").first()["embedding"], 10, "vec_id", metric="l2").select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) WHERE rank <= 3")
def vector_search_many(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return vectors.search_many(v, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 3, "vec_id").select("query_id", "vec_id", "rank")


def _graph(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir, "graph")
    if key not in _held:
        _held[key] = VectorGraph.build(table(spark, sf_dir, "embeddings"), "vec_id")
    return _held[key]


@query("SELECT count(*) AS indexed, count(*) AS linked, count(*) FILTER (WHERE vec_id % 20 = 0) AS asked, true AS good FROM embeddings")
def vector_graph_recall(spark, sf_dir):
    """Whether the graph finds nine of ten of the ten most similar vectors of every query; all rows are nodes and have links."""
    v, graph = table(spark, sf_dir, "embeddings"), _graph(spark, sf_dir)
    asked = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = recall(graph.search(asked, 10), vectors.search_many(v, asked, 10, "vec_id"))
    nodes = graph.links.agg(F.count(F.lit(1)).alias("indexed"), F.count_if(F.size("near") > 0).alias("linked"))
    # one row on either side
    return nodes.join(F.broadcast(got), F.lit(True)).select("indexed", "linked", "asked", (F.col("recall") >= 0.9).alias("good"))


@query()
def vector_graph_search(spark, sf_dir):
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return _graph(spark, sf_dir).search(asked, 10).withColumnRenamed("id", "vec_id")


@query(f"{_tops('er', 're', 100)} SELECT doc_id, round(sum(1.0 / (60 + rank + 1)), 9) AS score FROM (SELECT * FROM e UNION ALL SELECT * FROM t) GROUP BY doc_id ORDER BY sum(1.0 / (60 + rank + 1)) DESC, doc_id LIMIT 10")
def fuse_ranks(spark, sf_dir):
    a, b = _two(spark, sf_dir, "er", "re", 100)
    return vectors.fuse([a.hits, b.hits]).select("doc_id", F.round("score", 9).alias("score"))

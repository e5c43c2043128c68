"""Postings counted in their rows, character places, token boosts, and excerpts from places."""

import collections
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import analysis
from quarry.operators import highlight
from quarry.operators.index import SearchIndex
from quarry.operators.postings import postings_of
from quarry.plans import query as Q
from quarry.plans.schema import ID, TEXT, Schema

ROWS = [(1, "The Fox & the hound: a fox <b>ran</b>, fox!", 2.0), (2, None, 1.0), (3, "", 1.0), (4, "über ÜBER 中文 fox_1 a", 0.5), (5, "no match here " * 30 + "quick fox and quick hound", 1.0), (6, "the a of", 1.0)]


def docs(spark):
    return spark.createDataFrame([(i, t, "k", b) for i, t, b in ROWS], "doc_id long, text string, kind string, b double")


@pytest.mark.parametrize("analyzer", [analysis.standard(), analysis.simple(), analysis.regex_tokenizer(r"\s+", gaps=True) | analysis.lowercase(), analysis.stemming(), analysis.id_analyzer()])
def test_places(spark, analyzer):
    schema = Schema(text=TEXT(analyzer, characters=True), kind=ID())
    got = collections.defaultdict(list)
    for r in postings_of(docs(spark), schema.resolve(["doc_id", "text", "kind", "b"]), F.col("b")).collect():
        if r["field"] == "kind":
            assert r["starts"] is None and r["positions"] is None and r["weight"] == 1.0 and r["tf"] == 1
            continue
        text, b = next((t, b) for i, t, b in ROWS if i == r["doc_id"])
        assert r["tf"] == len(r["positions"]) == len(r["starts"]) == len(r["ends"]) and r["weight"] == r["tf"] * b
        assert r["positions"] == sorted(r["positions"])
        for s, e, p in zip(r["starts"], r["ends"], r["positions"]):
            assert analyzer.analyze(text[s:e]) == [r["term"]]
            got[r["doc_id"], r["dl"]].append((p, r["term"]))
    for (i, dl), found in got.items():
        text = next(t for k, t, _ in ROWS if k == i)
        assert [t for _, t in sorted(found)] == analyzer.analyze(text) and dl == len(found)
        first = min(p for p, _ in found)
        assert [p for p, _ in sorted(found)] == list(range(first, first + len(found)))
    assert {i for i, _ in got} == {i for i, t, _ in ROWS if t is not None and analyzer.analyze(t)}


def test_lists_nulls_and_what_has_no_places(spark):
    rows = spark.createDataFrame([(1, ["a", None, "b", "a"]), (2, []), (3, None)], "doc_id long, tags array<string>")
    got = {(r["doc_id"], r["term"]): (r["tf"], r["dl"]) for r in postings_of(rows, Schema(tags=ID()).resolve(["doc_id", "tags"])).collect()}
    assert got == {(1, "a"): (2, 4), (1, "b"): (1, 4)}
    with pytest.raises(ValueError, match="list"):
        postings_of(rows, Schema(tags=TEXT(characters=True)).resolve(["doc_id", "tags"]))
    with pytest.raises(ValueError, match="tokenizer"):
        postings_of(docs(spark), Schema(text=TEXT(analysis.Analyzer([analysis.ngram_tokenizer(2, 3)]), characters=True)).resolve(["doc_id", "text"]))
    with pytest.raises(Exception, match="have no places"):
        grams = TEXT(analysis.ngram_words(2, 3), characters=True)
        postings_of(docs(spark), Schema(text=grams).resolve(["doc_id", "text"])).collect()


def test_token_boosts(spark):
    rows = spark.createDataFrame([(1, "Fox^2.5 hound fox^0.5 fox^x")], "doc_id long, text string")
    spec = TEXT(analysis.space_tokenizer() | analysis.lowercase() | analysis.delimited_attribute(), token_boosts="^", boost=2.0)
    got = {r["term"]: r for r in postings_of(rows, Schema(text=spec).resolve(["doc_id", "text"])).collect()}
    assert got["fox"]["boosts"] == [2.5, 0.5, 1.0] and got["fox"]["weight"] == 8.0 and got["fox"]["positions"] == [0, 2, 3] and got["hound"]["weight"] == 2.0


def test_excerpts_from_places(spark):
    index = SearchIndex.build(docs(spark), Schema(text=TEXT(stored=True, characters=True), kind=ID()))
    hits = index.docs.select("doc_id", "text")
    mark = lambda q, **o: {r["doc_id"]: r["highlight"] for r in highlight.from_places(hits, index, q, "text", "text", **o).collect()}
    fox = Q.Or((Q.Term("text", "fox"), Q.Term("text", "hound")))
    got = mark(fox)
    assert got[1] == "The <strong>Fox</strong> &amp; the <strong>hound</strong>: a <strong>fox</strong> &lt;b&gt;ran&lt;/b&gt;, <strong>fox</strong>!"
    assert got[5] == ("no match here " * 30 + "quick ")[-40:] + "<strong>fox</strong> and quick <strong>hound</strong>" and got[2] == got[3] == got[4] == ""
    assert mark(fox, surround=2, top=1)[1] == "e <strong>hound</strong>: a <strong>fox</strong> &lt;"  # two places of two terms
    assert mark(fox, surround=2, top=2, between="|")[1] == "e <strong>Fox</strong> &amp;|e <strong>hound</strong>: a <strong>fox</strong> &lt;"
    phrase = mark(Q.Phrase("text", ("quick", "hound")), surround=3, before="[", after="]")
    assert phrase[5] == "nd [quick] [hound]" and phrase[1] == ""
    with pytest.raises(ValueError):
        highlight.from_places(hits, SearchIndex.build(docs(spark), Schema(text=TEXT())), fox, "text", "text")


@pytest.mark.parametrize("terms", [1 << 21, 5])
def test_packed_postings_are_the_same(spark, monkeypatch, tmp_path, terms):
    from quarry.operators import postings
    from quarry.operators.index import SearchIndex

    rows = spark.createDataFrame([(i, " ".join(f"w{k % (i % 7 + 1)}" for k in range(i % 11)), ["x", None][i % 2], 1.0 + i % 3) for i in range(60)], "doc_id long, text string, kind string, b double").coalesce(1)
    specs = Schema(text=TEXT(characters=True), kind=ID()).resolve(rows.columns)
    plain = Schema(text=TEXT(), kind=ID())
    key = lambda df: sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: (r["field"], r["term"], r["doc_id"]))
    with monkeypatch.context() as m:
        m.setattr(postings, "TERMS", terms)
        cut = list(postings.stretches(pa.RecordBatch.from_arrays([pa.array([["a"] * k for k in (3, 2, 9, 0, 1)])], names=["terms"])))
    assert [len(x) for x in cut] == ([5] if terms > 5 else [2, 1, 2])
    for s, boost in ((specs, F.col("b")), (plain.resolve(rows.columns), None)):
        made = postings.packed_of(rows, s, boost)
        assert key(postings.unpacked(made)) == key(postings_of(rows, s, boost))
        assert made.count() < postings_of(rows, s, boost).count() / 3  # a row for a term, not for each of its documents
    flat = SearchIndex(plain, rows, postings_of(rows, plain.resolve(rows.columns)))
    laid = SearchIndex(plain, rows, flat.postings).laid(f"file://{tmp_path}/laid", docs=False, packed=postings.packed_of(rows, plain.resolve(rows.columns)))
    for name in ("postings", "term_stats"):
        assert key(getattr(laid, name).withColumn("doc_id", F.lit(0)) if name == "term_stats" else laid.postings) == key(getattr(flat, name).withColumn("doc_id", F.lit(0)) if name == "term_stats" else flat.postings)
    assert sorted(map(tuple, laid.field_stats.collect())) == sorted(map(tuple, flat.field_stats.collect()))


def test_word_spans_are_those_of_the_pattern():
    import random
    import re

    pattern, r = re.compile(analysis.python_pattern(analysis.WORD_PATTERN)), random.Random(3)
    texts = ["", ".", "a", "a.b", "a..b", ".a.", "a.b.c d", "é.ü*_1 中.文", "x\U0001d400.y", "a.\u0301b"] + ["".join(r.choice("ab.. *_é中²\u0301\U0001d400-") for _ in range(r.randrange(40))) for _ in range(3000)]
    for text in texts:
        assert analysis.word_spans(text).tolist() == [list(m.span()) for m in pattern.finditer(text)], text
    long = "wort. und " * 40_000
    began = time.perf_counter()
    list(pattern.finditer(long))
    slow = time.perf_counter() - began
    spans = analysis.standard().stages[0].spans
    spans(long)
    began = time.perf_counter()
    assert len(spans(long)) == 80_000
    assert time.perf_counter() - began < slow  # no step for each word

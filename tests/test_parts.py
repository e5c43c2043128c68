"""Layers, events, registries, registered models, formats and word sources."""

import dataclasses
import logging
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import analysis, languages
from quarry.operators import synonyms
from quarry.operators.index import SearchIndex
from quarry.operators.search import Searcher
from quarry.plans import query as Q
from quarry.plans.schema import ID, SPELL, TEXT, Schema
from quarry.sources import discovery
from quarry.streaming import middleware as M


def test_layers_compose_from_the_outside_in(caplog):
    waits, calls, metrics = [], [], M.Metrics()

    def find(q):
        calls.append(q)
        if len(calls) < 3:
            raise OSError("busy")
        return q * 2

    with caplog.at_level(logging.INFO, "quarry"):
        run = M.chain(find, M.cached(size=2), M.logged(), metrics.layer("find"), M.retrying(3, wait=1, sleep=waits.append))
        assert run("a") == "aa" == run("a")
    assert waits == [1, 2] and len(calls) == 3 and metrics.calls["find"] == 1 and "took" in caplog.text
    assert 'quarry_calls_total{name="find"} 1' in metrics.text()
    run("b"), run("c"), run("a")
    assert calls[3:] == ["b", "c", "a"]
    run.clear()
    with pytest.raises(ValueError):
        M.chain(lambda: int("x"), M.logged(), metrics.layer("bad"), M.retrying())()
    assert metrics.errors["bad"] == 1


def test_cached_answers_age():
    now = [0.0]
    run = M.cached(seconds=5, clock=lambda: now[0])(lambda x: now[0])
    assert run(1) == 0 and (now.__setitem__(0, 4.0), run(1))[1] == 0 and (now.__setitem__(0, 6.0), run(1))[1] == 6


def test_a_time_limit_cancels_jobs(spark):
    slow = F.udf(lambda x: time.sleep(0.5) or x, "long")
    for limit in (0.0, 1.0):  # before the job is planned, and while it runs
        with pytest.raises(M.TimeLimit):
            M.within(spark, limit, lambda: spark.range(400).repartition(4).select(slow("id").alias("x")).agg(F.sum("x")).collect())
    assert M.within(spark, 60, lambda: spark.range(5).count()) == 5
    with pytest.raises(ZeroDivisionError):
        M.within(spark, 60, lambda: 1 / 0)


def test_events_registry_and_plugins(spark):
    events, heard = M.Events(), []
    off = events.on("saved", lambda version: heard.append(version))
    events.on("*", lambda name, **facts: heard.append((name, facts)))
    events.emit("saved", version=3)
    off()
    events.emit("saved", version=4)
    assert heard == [3, ("saved", {"version": 3}), ("saved", {"version": 4})]
    registry = M.Registry({"simple": analysis.simple})

    @registry.register("letters")
    def letters():
        return analysis.Analyzer([analysis.regex_tokenizer("[a-z]+")])

    assert registry.make("letters").analyze("ab1cd") == ["ab", "cd"] and registry.names() == ["letters", "simple"]
    with pytest.raises(ValueError):
        registry.register("simple", letters)
    with pytest.raises(KeyError):
        registry.make("none")
    assert registry.load("quarry.no.such.group") == []

    class Upper:
        def before_index(self, df):
            return df.withColumn("t", F.upper("t"))

    class Only:
        def rewrite(self, q):
            return Q.And((q, Q.Every()))

    plugins = M.Plugins(Upper())
    plugins.add(Only())
    assert plugins.before_index(spark.createDataFrame([("a",)], "t string")).first()["t"] == "A"
    assert isinstance(plugins.rewrite(Q.Term("t", "a")), Q.And) and plugins.after_search(7) == 7


def test_registered_models(spark):
    @discovery.register_model(id_field="key", tag=ID())
    @dataclasses.dataclass
    class Note:
        key: int
        text: str
        tag: str

    index = discovery.index_models(spark, [Note(4, "big red cat", "New York"), Note(9, "red dog", "york")], "key")
    found = lambda q: sorted(r["doc_id"] for r in Searcher(index).matches(q).collect())
    assert found(Q.Term("text", "red")) == [4, 9] and found(Q.Term("tag", "New York")) == [4] and found(Q.Term("tag", "york")) == [9]


def test_formats_and_modes(spark):
    docs = spark.createDataFrame([(1, "a b a b a c")], "doc_id long, text string")
    chain = analysis.space_tokenizer() | analysis.lowercase()
    there = SearchIndex.build(docs, Schema(text=TEXT(chain, frequency=False)))
    assert {(r["term"], r["weight"]) for r in there.postings.collect()} == {("a", 1.0), ("b", 1.0), ("c", 1.0)} and there.postings.where("positions is not null").count() == 0
    assert SPELL().analyzer.analyze("The Cat") == ["the", "cat"] and not SPELL().stored
    modes = analysis.space_tokenizer() | analysis.by_mode(analysis.ngram_filter(1, 3, "start"), analysis.passthrough())
    assert docs.select(modes.terms(F.lit("abc"))).first()[0] == ["a", "ab", "abc"] and modes.analyze("abc") == ["abc"]
    assert (analysis.simple() | analysis.logging_filter()).analyze("A b") == ["a", "b"]
    at = spark.createDataFrame([("The quick.brown fox",), (None,)], "t string").select(analysis.characters(F.col("t")).alias("c")).collect()
    assert [(x["term"], x["pos"], x["start"], x["end"]) for x in at[0]["c"]] == [("quick.brown", 1, 4, 15), ("fox", 2, 16, 19)] and at[1]["c"] == []


def test_word_sources(spark, tmp_path):
    (tmp_path / "wn.pl").write_text("s(1,1,'car',n,1,2).\ns(1,2,'auto',n,1,0).\ns(2,1,'dog''s life',n,1,0).\ns(2,2,'misery',n,1,0).\nbad\ns(3,1,'alone',n,1,0).\n")
    rows = synonyms.from_wordnet(spark, str(tmp_path / "wn.pl")).collect()
    assert {(r["word"], r["synonym"]) for r in rows} == {("car", "auto"), ("auto", "car"), ("dog's life", "misery"), ("misery", "dog's life")}
    pytest.importorskip("yaml")
    assert synonyms.Synonyms.from_yaml("car: [auto, wagon]\nbig: large").get("BIG") == ("large",)


def test_detectors_by_name(spark):
    df = spark.createDataFrame([("the cat is on the mat",)], "t string")
    assert df.select(languages.detect_with("stopwords", F.col("t"))).first()[0] == "en"
    languages.register_detector("always", lambda c: F.lit("xx"))
    assert df.select(languages.detect_with("always", F.col("t"))).first()[0] == "xx"
    with pytest.raises(KeyError):
        languages.detect_with("none", F.col("t"))

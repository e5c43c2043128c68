"""Result sizes from frequencies, near terms by deletions, mergeable moments, JSON errors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import analysis
from quarry.functions.distance import osa
from quarry.operators import expand
from quarry.operators.estimate import estimate
from quarry.operators.index import SearchIndex
from quarry.operators.neighbours import TermNeighbours, variants, variants_of
from quarry.operators.search import Searcher
from quarry.plans import query as Q
from quarry.plans.schema import ID, TEXT, Schema
from quarry.sources import readers


def T(w):
    return Q.Term("text", w)


def test_sizes_hold_for_random_trees(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("abcdef") for _ in range(rnd.randrange(5))), rnd.choice("xy")) for i in range(60)]
    index = SearchIndex.build(spark.createDataFrame(rows, "doc_id long, text string, kind string"), Schema(text=TEXT(analysis.simple()), kind=ID())).persist()

    def tree(depth):
        kind = rnd.randrange(8) if depth else 0
        sub = lambda: tree(depth - 1)
        return [
            lambda: T(rnd.choice("abcdefz")), lambda: Q.And((sub(), sub())), lambda: Q.Or((sub(), sub(), sub()), minmatch=rnd.choice([0, 2])), lambda: Q.Not(sub()), lambda: Q.AndNot(sub(), sub()),
            lambda: Q.Require(sub(), sub()), lambda: Q.DisMax((sub(), sub())), lambda: Q.AndMaybe(sub(), sub()),
        ][kind]()

    trees = [tree(3) for _ in range(10)] + [Q.Phrase("text", ("a", "b")), Q.Prefix("text", "a"), Q.Wildcard("text", "[ab]"), Q.Every(), Q.Every("text"), Q.Otherwise(T("z"), T("a")), Q.Otherwise(T("a"), T("b")), Q.TermRange("text", "b", "d"), Q.Null(), Q.NumericRange("doc_id", 3, 9)]
    for q in trees:
        row, n = estimate(index, q).first(), Searcher(index).matches(q).count()
        assert 0 <= row["lower"] <= n <= row["upper"] <= 60, q
    assert estimate(index, T("a")).first()["lower"] == estimate(index, T("a")).first()["upper"] == Searcher(index).matches(T("a")).count()
    assert "positions" not in estimate(index, T("a"))._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    index.unpersist()


def test_near_terms(spark, tmp_path):
    rnd = random.Random(10)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 13))) for _ in range(300)} | {"a" * 400, "b" + "a" * 400, "ab" * 30, "ab" * 29 + "ba", "ö中", "中ö"}
    asked = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 12))) for _ in range(40)} | {"a" * 401, "ab" * 30, "ö中", ""})
    table = TermNeighbours.write(spark.createDataFrame([(w, len(w), float(len(w) % 5)) for w in sorted(words)] + [(None, 0, 0.0)], "term string, df int, cf double"), f"file://{tmp_path}/n")
    frame = spark.createDataFrame([(w,) for w in asked] + [(None,), ("abc",)], "word string")
    for d in (1, 2):
        expected = sorted((a, w, osa(a, w)) for a in {*asked, "abc"} for w in words if osa(a, w, d) <= d)
        assert sorted((r["word"], r["term"], r["distance"]) for r in table.near_all(frame, d).collect()) == expected
    assert sorted((r["term"], r["distance"]) for r in table.near("abcab", 2).collect()) == sorted((w, osa("abcab", w)) for w in words if osa("abcab", w, 2) <= 2)
    best = {r["word"]: r["best"] for r in table.correct(frame).collect()}
    for a in asked:
        near = [(osa(a, w), -float(len(w) % 5), w) for w in words if osa(a, w, 2) <= 2]
        assert best[a] == (min(near)[2] if near else None)
    per = table.table.groupBy("term").count().agg(F.max("count")).first()[0]
    assert per <= 1 + 8 + 28
    got = spark.createDataFrame([("abcabcabcabc",)], "t string").select(variants(F.col("t"), 2)).first()[0]
    assert set(got) == variants_of("abcabcabcabc", 2)
    plan = table.near("abcab")._jdf.queryExecution().executedPlan().toString()
    assert "In(variant" in plan.split("PushedFilters")[1] or "variant" in plan.split("PushedFilters")[1].split("ReadSchema")[0]
    with pytest.raises(ValueError):
        table.near("a", 3)


def test_weighted_moments(spark):
    rng = np.random.default_rng(12)
    x, w, k = 1e9 + rng.normal(size=5000), rng.uniform(0.1, 9, 5000), rng.integers(0, 3, 5000)
    k[:2500] = 0  # a hot group
    rows = [(str(a) if a else None, float(b), float(c)) for a, b, c in zip(k, x, w)] + [("0", None, 1.0), ("0", 1.0, None), ("0", 5.0, 0.0), ("0", float("nan"), 1.0), ("9", 1.0, -1.0)]
    df = spark.createDataFrame(rows, "key string, x double, w double").repartition(7)
    got = {r["key"]: r for r in expand.weighted_moments(df, "x", "w", ["key"]).collect()}
    assert set(got) == {None, "1", "2"}
    for key in (0, 1, 2):
        a, b = x[k == key], w[k == key]
        mean = np.average(a, weights=b)
        r = got[str(key) if key else None]
        assert r["n"] == len(a) and r["weight"] == pytest.approx(b.sum()) and r["mean"] == pytest.approx(mean, rel=1e-12)
        assert r["variance"] == pytest.approx(np.average((a - mean) ** 2, weights=b), rel=1e-5)  # sums of squares would lose all of it
    one = expand.weighted_moments(df, "x", "w").first()
    assert one["n"] == 5000 and expand.weighted_moments(df.limit(0), "x", "w").count() == 0


def test_json_that_does_not_fit_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json(spark, str(tmp_path / "a.json"), lines=True, schema="a int").collect()
    assert readers.json(spark, str(tmp_path / "a.json"), lines=True, schema="a int", malformed="drop").count() == 2
    (tmp_path / "b.json").write_text('{"found": {"rows": [{"a": 1}]}}')
    assert readers.json(spark, str(tmp_path / "b.json"), document_path="found.rows").count() == 1
    with pytest.raises(ValueError):
        readers.json(spark, str(tmp_path / "b.json"), document_path="found.row")

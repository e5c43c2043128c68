"""The vector graph: recall against exact search, copies, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import graph, vectors
from quarry.operators.graph import VectorGraph, recall


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, embedding array<double>")


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 12))
    rows = [(i, [float(x) for x in centres[i % 25] + 0.6 * rng.normal(size=12)]) for i in range(1200)]
    rows += [(5000 + i, rows[7][1]) for i in range(700)]  # copies: more than a third of the rows
    rows += [(9001, None), (9002, [0.0] * 12), (9003, [float("nan")] * 12), (9004, [1.0, None] + [0.0] * 10), (None, [1.0] * 12), (9005, [1e300] + [0.0] * 11), (3, [9.0] * 12)]
    df = frame(spark, rows)
    path = f"file://{tmp_path_factory.mktemp('graph')}/g"
    return df, VectorGraph.build(df, landmarks=60, near=12, followers=12, path=path), path


def test_recall(spark, held):
    df, built, path = held
    ids = {r["id"]: r["near"] for r in built.links.collect()}
    assert len(ids) == 1901 and all(near and i not in near for i, near in ids.items())
    assert max(map(len, ids.values())) <= 24
    asked = df.where("doc_id % 20 = 0 and doc_id < 1200").withColumnRenamed("doc_id", "query_id")
    exact = vectors.search_many(graph.units(df, "doc_id", "embedding").withColumnRenamed("v", "embedding"), asked, 10, "id")
    got = VectorGraph.open(spark, path).search(asked, 10)
    row = recall(got, exact).first()
    assert row["asked"] == 60 and row["recall"] >= 0.9
    rows = got.collect()
    assert sorted({r["rank"] for r in rows}) == list(range(1, 11)) and {r["id"] for r in rows if r["rank"] == 1 and r["query_id"] != 0} >= {20 * k for k in range(1, 60)} - {7}
    assert all(abs(r["score"]) <= 1.0001 for r in rows)
    copies = VectorGraph.open(spark, path).search(df.where("doc_id = 7").withColumnRenamed("doc_id", "query_id"), 10).collect()
    assert len(copies) == 10 and all(r["score"] > 0.9999 for r in copies)


def test_rounds_improve_lists(spark):
    rng = np.random.default_rng(4)
    df = frame(spark, [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)])
    exact = vectors.search_many(df, df.withColumnRenamed("doc_id", "query_id"), 6, "doc_id").where("query_id <> doc_id").groupBy("query_id").agg(F.sum("score").alias("s")).agg(F.sum("s")).first()[0]
    nodes = graph.units(df, "doc_id", "embedding").persist()
    points = np.array([r["v"] for r in nodes.limit(20).collect()], np.float32)
    lists = graph._best(VectorGraph._first(nodes, points, 5), 5).persist()
    total = lambda x: x.agg(F.sum(F.aggregate("near", F.lit(0.0), lambda s, n: s + n["score"]))).first()[0]
    better = VectorGraph._improved(nodes, lists, 5, 5).persist()
    best = VectorGraph._improved(nodes, better, 5, 5)
    a, b, c = total(lists), total(better), total(best)
    assert a < b < c <= exact + 1e-3 and c > 0.95 * exact


def test_small_and_empty(spark):
    one = VectorGraph.build(frame(spark, [(4, [1.0, 0.0])]))
    asked = frame(spark, [(1, [1.0, 1.0]), (2, None)]).withColumnRenamed("doc_id", "query_id")
    assert [(r["query_id"], r["id"]) for r in one.search(asked).collect()] == [(1, 4)]
    empty = VectorGraph.build(frame(spark, []))
    assert empty.search(asked).collect() == [] and empty.links.count() == 0


def _records(spark) -> int:
    """Rows that all stages so far wrote to shuffles."""
    jsc = spark.sparkContext._jsc.sc()
    stages = jsc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_parts_move_vectors_not_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=32)]) for i in range(1500)] + [(2000 + i, [1.0] + [0.0] * 31) for i in range(500)]
    df = frame(spark, rows)
    asked = df.where("doc_id % 20 = 0 and doc_id < 1500").withColumnRenamed("doc_id", "query_id").persist()
    before = _records(spark)
    built = VectorGraph.build(df)
    found = {(r["query_id"], r["rank"]): r["id"] for r in built.search(asked, 10).collect()}
    # vectors by id and to their part, then once for each slice; queries and answers; the rest are counts
    assert len(found) == 750 and _records(spark) - before < 2000 * 3 + 2000 * 8 + 75 * 20
    exact = vectors.search_many(df, asked, 10, "doc_id")
    assert recall(built.search(asked, 10), exact).first()["recall"] >= 0.95
    # links lead from every node, and copies are in no list but their own
    links = {r["id"]: r["near"] for r in built.links.collect()}
    assert len(links) == 2000 and all(links.values()) and sum(len([x for x in near if x > 2000]) for near in links.values()) == 0
    assert {x for i in range(2001, 2500) for x in links[i]} == {2000}
    copies = built.search(frame(spark, [(1, [2.0] + [0.0] * 31)]).withColumnRenamed("doc_id", "query_id"), 10).collect()
    assert sorted((r["rank"], r["id"]) for r in copies) == [(k + 1, 2000 + k) for k in range(10)]


def test_many_small_parts(spark):
    rng = np.random.default_rng(6)
    df = frame(spark, [(i, [float(x) for x in rng.normal(size=16)]) for i in range(900)] + [(7000, [0.5] * 16), (7001, [0.5] * 16)])
    asked = df.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    built = VectorGraph.build(df, part=60)
    assert built.rows.select("part").distinct().count() > 10
    assert recall(built.search(asked, 10), vectors.search_many(df, asked, 10, "doc_id")).first()["recall"] >= 0.95
    with pytest.raises(Exception, match="different lengths"):
        VectorGraph.build(frame(spark, [(1, [1.0, 0.0]), (2, [1.0])])).links.collect()

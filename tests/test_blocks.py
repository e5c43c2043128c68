"""Search by bounded blocks against exhaustive search; anytime answers."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from quarry.functions import analysis, scoring
from quarry.operators import blocks
from quarry.operators.blocks import BlockIndex, Unbounded
from quarry.operators.index import SearchIndex
from quarry.operators.search import Searcher
from quarry.plans import query as Q
from quarry.plans.schema import ID, TEXT, Schema

SCHEMA = Schema(text=TEXT(analysis.simple()), title=TEXT(analysis.simple(), boost=2.0), kind=ID())


def T(word, boost=1.0, name="text"):
    return Q.Term(name, word, boost)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    rows = []
    for i in range(3000):
        n = rnd.choice([0, 1, 3, 8, 20, 60])
        rows.append((i * 3, " ".join(rnd.choices(words, weights, k=n)), rnd.choice([None, "w1 w2", "w9"]), rnd.choice("ab")))
    rows += [(20_000 + i, "w3 w5", None, "c") for i in range(40)]  # ties
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string, kind string")
    plain = SearchIndex.build(docs, SCHEMA).persist()
    path = f"file://{tmp_path_factory.mktemp('blocks')}/{uuid.uuid4().hex}"
    return plain, BlockIndex.write(plain, path, size=16, zones=12, order=("kind",))


TREES = [
    T("w30"),
    T("nowhere"),
    Q.Or((T("w0"), T("w3"), T("w40", 2.0))),
    Q.Or((T("w3"), T("w5"))),
    Q.And((T("w3"), T("w5"))),
    Q.And((T("w3"), T("nowhere"))),
    Q.And((T("w3"), Q.Not(T("w0")))),
    Q.Or((T("w3"), T("w5"), T("w7")), minmatch=2),
    Q.Or((T("w3"), T("w5"), T("w7")), scale=2.5),
    Q.AndNot(T("w3"), Q.Or((T("w0"), T("w1")))),
    Q.AndMaybe(T("w40"), T("w0")),
    Q.Require(T("w4"), T("a", name="kind")),
    Q.DisMax((T("w2"), T("w2", name="title")), tiebreak=0.2),
    Q.Phrase("text", ("w0", "w1")),
    Q.Or((Q.Phrase("text", ("w0", "w1"), slop=2), T("w50"))),
    Q.ConstantScore(Q.Or((T("w3"), T("w5"))), score=2.0),
    Q.Or((T("w6"), T("w9", 3.0, "title"), T("c", name="kind"))),
]


def test_equal_to_exhaustive_search(both):
    plain, index = both
    cases = [(q, 7, scoring.BM25F()) for q in TREES] + [(TREES[2], 1, scoring.BM25F(b=0.3, k1=2.0)), (TREES[3], 7, scoring.TFIDF()), (TREES[16], 3, scoring.Frequency())]
    for q, k, model in cases:
        expected = [(r["doc_id"], r["score"]) for r in Searcher(plain, model).matches(q).orderBy(F.desc("score"), "doc_id").limit(k).collect()]
        got = index.top_k(q, k, model, first=4)
        assert got.complete and got.bound is None and got.read <= got.buckets
        assert [d for d, _ in got.hits] == [d for d, _ in expected], q
        assert [s for _, s in got.hits] == pytest.approx([s for _, s in expected])


def test_fewer_blocks_and_bytes_are_read(spark, both):
    plain, index = both
    q = Q.Or((T("w3"), T("w5")))
    got = index.top_k(q, 5, first=4)
    assert 0 < got.read < got.buckets / 2
    total = index.blocks.where("field = 'text' and term in ('w3', 'w5')").count()
    assert total >= got.buckets

    def read():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).head().totalInputBytes()

    def cost(action):
        before = read()
        action()
        return read() - before

    found = index.bounds(q)[0]
    best = found.orderBy(F.desc("most")).limit(4).persist()
    zones = [r[0] for r in best.select("zone").distinct().collect()]
    weigh = lambda view: view.postings.agg(F.sum("weight"), F.sum(F.size("positions"))).collect()
    phrase = Q.Phrase("text", ("w3", "w5"))
    some, those, unplaced = index.view(phrase, best, zones), index.view(phrase), index.view(q)
    bounded, exhaustive = (cost(lambda v=v: weigh(v)) for v in (some, those))
    assert bounded < 0.6 * exhaustive
    plan = unplaced.postings._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in plan.split("ReadSchema")[1] and "PartitionFilters: [zone" in some.postings._jdf.queryExecution().executedPlan().toString()
    best.unpersist()


def test_heads_bound_their_blocks(both):
    plain, index = both
    heads = {(r["field"], r["term"], r["bucket"]): r for r in index.heads.collect()}
    slots = {r["doc_id"]: r["bucket"] for r in index.slots.collect()}
    held = {}
    for p in plain.postings.collect():
        held.setdefault((p["field"], p["term"], slots[p["doc_id"]]), []).append((p["weight"], p["dl"]))
    assert set(held) == set(heads)
    for key, posts in held.items():
        h = heads[key]
        assert (h["n"], h["max_weight"], h["min_length"]) == (len(posts), max(w for w, _ in posts), min(n for _, n in posts)) and (h["best_weight"], h["best_length"]) in posts
    counts = {}
    for b in slots.values():
        counts[b] = counts.get(b, 0) + 1
    assert max(counts.values()) == 16 and sum(n < 16 for n in counts.values()) <= 1


def test_anytime(spark, both, monkeypatch):
    _, index = both
    q = Q.Or((T("w0"), T("w3"), T("w40", 2.0)))
    whole = index.top_k(q, 10, first=4)
    timed = index.top_k(q, 10, seconds=600, first=4)
    assert timed.complete and timed.hits == whole.hits
    none = index.top_k(q, 10, seconds=0)
    assert not none.complete and none.hits == [] and none.bound >= whole.hits[0][1]
    scored, calls = BlockIndex._scored, []

    def slow(self, *args):
        calls.append(1)
        if len(calls) > 1:
            import time

            time.sleep(3)
        return scored(self, *args)

    monkeypatch.setattr(BlockIndex, "_scored", slow)
    monkeypatch.setattr(blocks, "GROWTH", 1)
    monkeypatch.setattr(BlockIndex, "_can_matter", staticmethod(lambda bound, threshold: True))
    some = index.top_k(q, 10, seconds=8, first=2)
    assert not some.complete and some.waves and some.bound is not None
    frame = some.frame(spark).orderBy("rank").collect()
    sure = [r["doc_id"] for r in frame if r["certain"]]
    assert sure == [d for d, _ in whole.hits][: len(sure)]
    assert all(s <= whole.hits[k][1] + 1e-9 for k, (_, s) in enumerate(some.hits))


def test_without_bounds(spark, both, tmp_path):
    _, index = both
    for q in (Q.Prefix("text", "w"), Q.Not(T("w0")), T("w0", -1.0), Q.NumericRange("kind", 1, 2), Q.AndNot(T("w0"), Q.Prefix("text", "w"))):
        with pytest.raises(Unbounded):
            index.top_k(q)
    with pytest.raises(Unbounded):
        index.top_k(T("w0"), model=scoring.PL2())
    empty = SearchIndex.build(spark.createDataFrame([], "doc_id long, text string, title string, kind string"), SCHEMA)
    assert BlockIndex.write(empty, f"file://{tmp_path}/e").top_k(T("w0")).hits == []

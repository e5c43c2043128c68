"""Streamed segments under versions: upserts equal a rebuild, readers keep their version, merges and conflicts."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import analysis
from quarry.operators.index import SearchIndex
from quarry.operators.search import Searcher
from quarry.plans import query as Q
from quarry.plans.schema import ID, TEXT, Schema
from quarry.streaming import snapshots
from quarry.streaming.snapshots import StreamedIndex, upsert_stream

SCHEMA = Schema(text=TEXT(analysis.simple(), stored=True), code=ID(unique=True))
COLUMNS = "doc_id long, text string, code string"


def state(index):
    """Documents, postings and statistics that must equal a rebuild's."""
    docs = sorted(map(tuple, index.docs.select("doc_id", "text", "code").collect()), key=str)
    posts = sorted(map(str, index.postings.select("field", "term", "doc_id", "tf", "dl", "positions").collect()))
    terms = sorted(map(tuple, index.term_stats.select("field", "term", "df", "cf").collect()))
    fields = sorted(map(tuple, index.field_stats.select("field", "total", "n").collect()))
    return docs, posts, terms, fields


def rebuilt(spark, rows):
    return state(SearchIndex.build(spark.createDataFrame(rows, COLUMNS), SCHEMA))


def apply(live, batch):
    """The rows after an upsert, plainly."""
    for row in batch:
        live = [r for r in live if r[0] != row[0] and (row[2] is None or r[2] != row[2])]
        live.append(row)
    return live


def test_upserts_and_merges_equal_a_rebuild(spark, tmp_path):
    rnd = random.Random(5)
    index = StreamedIndex(spark, f"file://{tmp_path}/i", SCHEMA)
    with pytest.raises(FileNotFoundError):
        index.open()
    live, held = [], []
    for b in range(4):
        batch = [(b * 10 + k if k < 6 else rnd.randrange(10 * b + 1), f"w{rnd.randrange(5)} w{rnd.randrange(5)} b{b}", f"c{b * 10 + k}" if k % 2 else None) for k in range(9)]
        batch += [(500 + b, f"new {b}", f"c{rnd.randrange(10 * b + 1)}"), (900, None, "same")]
        batch = list({r[0]: r for r in batch}.values())
        batch = list({r[2] or r[0]: r for r in batch}.values())
        live = apply(live, batch)
        index.upsert(spark.createDataFrame(batch, COLUMNS))
        held.append((index.open(), list(live)))
        if b == 2:
            before = index.manifest()
            assert index.merge(all_segments=True) == 3 and index.merge() == 0
            assert len(index.manifest()["segments"]) == 1 and index.manifest()["version"] == before["version"] + 1
            assert state(index.open()) == rebuilt(spark, live)
    assert state(index.open()) == rebuilt(spark, live)
    for opened, rows in (held[0], held[2]):
        assert state(opened) == rebuilt(spark, rows)  # a reader keeps its version
    assert state(index.open(2)) == rebuilt(spark, held[1][1])
    index.delete(spark.createDataFrame([(900,), (12345,)], "doc_id long"))
    live = [r for r in live if r[0] != 900]
    assert state(index.open()) == rebuilt(spark, live)
    found = Searcher(index.open()).matches(Q.Or((Q.Term("text", "w1"), Q.Term("text", "w2")))).collect()
    plain = Searcher(SearchIndex.build(spark.createDataFrame(live, COLUMNS), SCHEMA)).matches(Q.Or((Q.Term("text", "w1"), Q.Term("text", "w2")))).collect()
    assert {(r[0], round(r[1], 9)) for r in found} == {(r[0], round(r[1], 9)) for r in plain}
    index.merge(all_segments=True)
    assert index.vacuum(1) > 0 and state(index.open()) == rebuilt(spark, live) and len(index.versions()) == 1


def test_a_merge_meets_an_upsert(spark, tmp_path, monkeypatch):
    """Documents that die while a merge runs stay dead, and a reader sees every row once at any time."""
    index = StreamedIndex(spark, f"file://{tmp_path}/i", SCHEMA)
    one, two = [(1, "a b", "x"), (2, "a", "y")], [(3, "c", "z")]
    index.upsert(spark.createDataFrame(one, COLUMNS))
    index.upsert(spark.createDataFrame(two, COLUMNS))
    write, seen = StreamedIndex._write, []

    def slow(self, docs, postings=None):
        out = write(self, docs, postings)
        if postings is not None and not seen:  # the merged segment is written but not committed
            seen.append(sorted(r[0] for r in index.open().docs.select("doc_id").collect()))
            StreamedIndex(spark, index.path, SCHEMA).upsert(spark.createDataFrame([(2, "new", "y"), (4, "d", "x")], COLUMNS))
            seen.append(sorted(r[0] for r in index.open().docs.select("doc_id").collect()))
        return out

    monkeypatch.setattr(StreamedIndex, "_write", slow)
    assert index.merge(all_segments=True) == 2 and seen == [[1, 2, 3], [2, 3, 4]]
    assert state(index.open()) == rebuilt(spark, [(3, "c", "z"), (2, "new", "y"), (4, "d", "x")])
    assert len(index.manifest()["segments"]) == 2


def test_conflicts_dead_writers_and_repeated_batches(spark, tmp_path, monkeypatch):
    index = StreamedIndex(spark, f"file://{tmp_path}/i", SCHEMA)
    batch = spark.createDataFrame([(1, "a", "x")], COLUMNS)
    assert index.upsert(batch, "s", 0) == 1 and index.upsert(batch, "s", 0) is None and index.versions() == [1]
    commit, calls = StreamedIndex._commit, []

    def second(self, found):
        if not calls:  # another writer takes the number first
            calls.append(1)
            StreamedIndex(spark, index.path, SCHEMA).upsert(spark.createDataFrame([(2, "b", "y"), (7, "c", None)], COLUMNS))
        return commit(self, found)

    monkeypatch.setattr(StreamedIndex, "_commit", second)
    assert index.upsert(spark.createDataFrame([(3, "b again", "y")], COLUMNS)) == 3
    assert sorted(r[0] for r in index.open().docs.select("doc_id").collect()) == [1, 3, 7]
    monkeypatch.setattr(snapshots, "PATIENCE", 0.3)
    stream = index.fs.create(index._at("manifests", "v4"), False)
    stream.write(bytearray(b'{"half'))
    stream.close()
    assert index.manifest()["version"] == 3
    assert index.upsert(spark.createDataFrame([(8, "d", None)], COLUMNS)) == 5
    assert index.open().docs.count() == 4


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(i, f"word{i % 3} all", f"k{i}") for i in range(12)] + [(i, "changed all", f"k{i}") for i in range(4)]
    for k in range(4):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], COLUMNS).coalesce(1).write.mode("append").json(str(source))
    index = StreamedIndex(spark, f"file://{tmp_path}/i", SCHEMA)
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).json(str(source))
    upsert_stream(stream, index, f"file://{tmp_path}/c", trigger={"availableNow": True}, fan=3).awaitTermination()
    opened = index.open()
    assert opened.docs.count() == 12 and len(index.manifest()["segments"]) < 4
    assert {r["text"] for r in opened.docs.where(F.col("doc_id") < 4).collect()} == {"changed all"}
    assert opened.term_stats.where("term = 'all'").first()["df"] == 12


def test_segments_are_stored_packed_and_texts_move_for_repeated_keys_alone(spark, tmp_path):
    """A row for a term in a stretch of documents; a batch without repeated keys is written as it lies."""
    index = StreamedIndex(spark, f"file://{tmp_path}/i", SCHEMA)
    index.upsert(spark.createDataFrame([(k, "all words", None) for k in range(40)], COLUMNS).coalesce(1))
    (segment,) = index.manifest()["segments"]
    stored = spark.read.parquet(f"{index.path}/postings/segment={segment}")
    assert stored.count() < 40 and stored.groupBy("term").agg(F.sum("df").alias("n")).where("n = 40").count() == 2
    assert len(list((tmp_path / "i" / "docs").iterdir())) == 1
    twice = [(3, "old", "b"), (3, "newer", "a"), (50, "x", "same"), (51, "y", "same"), (60, None, None)]
    index.upsert(spark.createDataFrame(twice, COLUMNS), arrival="code")
    rows = [(k, "all words", None) for k in range(40) if k != 3] + [(3, "old", "b"), (60, None, None)]
    got, (docs, _, terms, _) = state(index.open()), rebuilt(spark, rows)
    same = [r for r in got[0] if r[2] == "same"]
    assert len(same) == 1 and sorted([*docs, *same], key=str) == got[0] and set(terms) <= set(got[2])

import dataclasses
import datetime as dt
import json
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.search import Searcher
from quarry.plans import query as Q
from quarry.plans.schema import ID, NUMERIC, TEXT, Schema
from quarry.sources import discovery, readers, rest
from quarry.streaming import ingest


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("First Name,2nd, 2nd!\nann,1,x\nbob,2\n")
    df = readers.csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["first_name", "_2nd", "_2nd_2"] and {t for _, t in df.dtypes} == {"string"} and df.count() == 2
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert readers.json(spark, str(tmp_path / "a.jsonl"), lines=True, schema="a int", malformed="drop").where("a is not null").count() == 2
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"a": 1}, {"a": 2}]}, indent=1))
    assert sorted(r["a"] for r in readers.json(spark, str(tmp_path / "b.json")).collect()) == [1, 2]
    (tmp_path / "c.json").write_text(json.dumps({"x": {"y": [{"a": 3}]}}, indent=1))
    assert readers.json(spark, str(tmp_path / "c.json"), "x.y").first()["a"] == 3
    with pytest.raises(ValueError, match="x.z"):
        readers.json(spark, str(tmp_path / "c.json"), "x.z")
    spark.sql("select date'2020-01-02' d, 1 n").write.parquet(f"{tmp_path}/p")
    source = readers.make(spark, {"type": "parquet", "path": f"{tmp_path}/p", "incremental": "n", "name": "p"})
    assert dict(source.frame().dtypes)["d"] == "timestamp_ntz" and source.count() == 1 and source.changes(1).count() == 0 and source.health_check()
    seen = []
    source.observe(seen.append)
    source.refresh()
    assert len(seen) == 1 and [len(b) for b in source.batches(1)] == [1] and source.metadata()["name"] == "p"
    with pytest.raises(ValueError):
        readers.make(spark, {"type": "nothing"})


def test_database(spark, tmp_path):
    path = str(tmp_path / "db")
    con = sqlite3.connect(path)
    con.execute("create table articles (id integer, title text, weight real)")
    con.executemany("insert into articles values (?, ?, ?)", [(i, f"t{i}", i / 2) for i in range(10)])
    con.commit()
    connect = lambda: sqlite3.connect(path)
    df = readers.dbapi(spark, connect, "select * from articles", splits=["id < 5", "id >= 5"])
    assert df.count() == 10 and dict(df.dtypes) == {"id": "bigint", "title": "string", "weight": "double"}


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        slow = [True]

        def _send(self, value, code=200, **headers):
            self.send_response(code)
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            self.wfile.write(json.dumps(value).encode())

        def do_GET(self):
            u = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(u.query).items()}
            rows = [{"id": i, "name": f"n{i}", "tags": ["x"]} for i in range(25)]
            if u.path == "/slow" and self.slow:
                self.slow.pop()
                return self._send({}, 429, Retry_After="0")
            n = int(q.get("limit", 100))
            at = (int(q.get("page", 1)) - 1) * n if u.path == "/page" else int(q.get("offset", q.get("cursor", 0)))
            got = {"results": rows[at : at + n], "next": str(at + n) if at + n < 25 else None}
            self._send(got)

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self._send({"errors": ["no"]} if "bad" in body["query"] else {"data": {"items": [{"id": 1}, {"id": 2}]}})

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_web(spark, server):
    for path, paging in (("page", {"type": "page"}), ("page", {"type": "page", "pages": 3}), ("offset", {"type": "offset"}), ("cursor", {"type": "cursor"})):
        df = rest.rest(spark, f"{server}/{path}", pagination=paging, page_size=10)
        assert sorted(r["id"] for r in df.collect()) == list(range(25)), paging
    df = rest.rest(spark, f"{server}/offset", document_path="nowhere", schema="id long")
    assert df.count() == 0
    assert rest.rest(spark, f"{server}/slow", schema="id long, tags string").first()["tags"] == '["x"]'
    assert rest.graphql(spark, server, "{ items { id } }").count() == 2
    with pytest.raises(Exception):
        rest.graphql(spark, server, "bad", schema="id long").collect()
    assert rest.headers_of({"type": "basic", "username": "a", "password": "b"})["Authorization"] == "Basic YTpi"


@dataclasses.dataclass
class Article:
    id: int
    title: str
    tags: list[str]
    at: dt.datetime | None = None


def test_models_and_discovery(spark):
    df = readers.models(spark, [Article(1, "one", ["x", "y"]), Article(2, "two", [], dt.datetime(2020, 1, 1))])
    assert df.count() == 2 and isinstance(df.schema["tags"].dataType, T.ArrayType)
    schema = discovery.schema_of_model(Article, "id")
    assert {n: f.kind for n, f in schema.fields.items()} == {"at": "datetime", "id": "id", "tags": "keyword", "title": "text"}
    strings = spark.createDataFrame([("1", "1.5", "true", "2020-01-02", "x"), ("2", "2", "no", "2020-01-03 10:00", "y"), ("", None, "f", "bad", "z")], "a string, b string, c string, d string, e string")
    types = {k: v.simpleString() for k, v in discovery.discover_types(strings).items()}
    assert types == {"a": "bigint", "b": "double", "c": "boolean", "d": "timestamp_ntz", "e": "string"}
    assert discovery.typed(strings, {"a": T.LongType()}).where("a is null").count() == 1
    issues = discovery.validate(strings, Schema(a=NUMERIC(bits=8), e=TEXT(), z=ID(), b=ID(unique=True)))
    assert {(i.level, i.field) for i in issues} == {("structural", "z"), ("runtime", "a")}
    report = {r["field"]: r["advice"] for r in discovery.usage_report(strings, Schema(e=TEXT(), c=TEXT())).collect()}
    assert set(report) == {"e", "c"}


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_streaming(spark, tmp_path):
    rows = [(1, "alfa bravo", dt.datetime(2020, 1, 1, 0, 5)), (2, "bravo charlie", dt.datetime(2020, 1, 1, 0, 50)), (3, "alfa", dt.datetime(2020, 1, 1, 5, 0))]
    spark.createDataFrame(rows[:2], "doc_id long, text string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = Schema(text=TEXT())
    read = lambda: spark.readStream.schema("doc_id long, text string, ts timestamp").parquet(f"{tmp_path}/in")
    for k in range(2):
        q = ingest.index_stream(read(), schema, f"{tmp_path}/ix", f"{tmp_path}/cp", trigger={"availableNow": True})
        q.awaitTermination(120)
        if k == 0:
            spark.createDataFrame(rows[2:], "doc_id long, text string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ix = ingest.open_stream_index(spark, schema, f"{tmp_path}/ix")
    assert ids(Searcher(ix).matches(Q.Term("text", "alfa"))) == [1, 3]
    assert ix.term_stats.where("term = 'alfa'").first()["df"] == 2
    for name, frame in (("terms", ingest.term_counts(read(), "text", "ts")), ("facets", ingest.facet_counts(read(), "text", "ts")), ("stored", ingest.percolate(read(), "text", {"a": Q.Term("text", "alfa"), "p": Q.Phrase("text", ("bravo", "charlie"))}))):
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp_{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {(r["term"], r["n"]) for r in spark.table("terms").collect()} >= {("bravo", 2), ("alfa", 1), ("charlie", 1)}
    assert {r["doc_id"]: r["matched"] for r in spark.table("stored").collect()} == {1: ["a"], 2: ["p"], 3: ["a"]}


def test_views(spark, tmp_path):
    rows = [(1, "red car", 1), (2, "blue boat", 2)]
    held = [spark.createDataFrame(rows, "id long, title string, version long")]
    source = readers.Source("s", lambda: held[0], incremental="version", id_field="id")
    view = ingest.SearchView("v", source, Schema(title=TEXT(stored=True)), after_search=[ingest.reranked(lambda: F.col("doc_id").cast("double"))])
    view.build()
    assert ids(view.search("red OR blue").hits) == [1, 2] and view.search("red OR blue").hits.first()["doc_id"] == 2
    held[0] = spark.createDataFrame([*rows[1:], (1, "green car", 3), (3, "red bus", 4)], "id long, title string, version long")
    view.refresh()
    assert ids(view.search("red").hits) == [3] and ids(view.search("green").hits) == [1] and view.seen == 4
    key = "0123456789abcdef"
    df = held[0].transform(ingest.encrypted(["title"], key))
    assert df.first()["title"] != "blue boat" and df.transform(ingest.decrypted(["title"], key)).first()["title"] == "blue boat"
    held[0].write.parquet(f"{tmp_path}/t")
    config = {"source": {"type": "parquet", "path": f"{tmp_path}/t"}, "fields": {"title": {"kind": "text", "language": "en"}}, "synonyms": {"car": ["auto"]}, "scoring": "tfidf"}
    (tmp_path / "c.json").write_text(json.dumps(config))
    built = ingest.from_config(spark, ingest.load_config(str(tmp_path / "c.json")))
    built.build()
    assert built.search("cars").hits.count() == 1

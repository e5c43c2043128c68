import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.functions import scoring
from quarry.operators import expand, facets, highlight, suggest, vectors
from quarry.operators.index import SearchIndex, numbered, with_parents
from quarry.operators.search import Searcher, bitmaps, difference, intersection, inverse, union
from quarry.operators.synonyms import Synonyms
from quarry.plans import query as Q
from quarry.plans.schema import BOOLEAN, DATETIME, ID, KEYWORD, NUMERIC, SEARCH_AS_YOU_TYPE, TEXT, Schema, SchemaClass, ensure_schema, merge_schemas

ROWS = [
    (0, "alfa bravo charlie delta echo", "blue", 5, dt.datetime(2001, 5, 1), True),
    (1, "bravo charlie delta echo alfa", "red", 3, dt.datetime(2002, 6, 2), False),
    (2, "charlie delta echo alfa bravo", "blue", 9, dt.datetime(2003, 7, 3), None),
    (3, "delta echo alfa bravo charlie", None, None, None, True),
    (4, "echo alfa foxtrot charlie echo", "green", 1, dt.datetime(2005, 1, 1), False),
]


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, tag string, num int, date timestamp_ntz, flag boolean")
    return SearchIndex.build(df, Schema(text=TEXT(spelling=True), tag=ID(), num=NUMERIC(), date=DATETIME(), flag=BOOLEAN())).persist()


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


T = lambda w: Q.Term("text", w)


@pytest.mark.parametrize(
    "q, expected",
    [
        (T("foxtrot"), [4]),
        (T("zulu"), []),
        (Q.And((T("bravo"), T("charlie"))), [0, 1, 2, 3]),
        (Q.Or((T("foxtrot"), T("bravo"))), [0, 1, 2, 3, 4]),
        (Q.AndNot(T("alfa"), T("foxtrot")), [0, 1, 2, 3]),
        (Q.Require(T("alfa"), T("foxtrot")), [4]),
        (Q.Not(T("bravo")), [4]),
        (Q.Otherwise(T("zulu"), T("foxtrot")), [4]),
        (Q.Otherwise(T("bravo"), T("foxtrot")), [0, 1, 2, 3]),
        (Q.Every(), [0, 1, 2, 3, 4]),
        (Q.Every("tag"), [0, 1, 2, 4]),
        (Q.Null(), []),
        (Q.Phrase("text", ("alfa", "bravo")), [0, 2, 3]),
        (Q.Phrase("text", ("bravo", "alfa")), []),
        (Q.Phrase("text", ("alfa", "charlie"), slop=2), [0, 3, 4]),
        (Q.Phrase("text", ("bravo", "charlie", "delta")), [0, 1]),
        (Q.SpanFirst(T("alfa"), limit=0), [0]),
        (Q.SpanNear((T("echo"), T("alfa")), slop=1), [1, 2, 3, 4]),
        (Q.SpanNear((T("alfa"), T("echo")), slop=1, ordered=False), [1, 2, 3, 4]),
        (Q.SpanOr((T("foxtrot"), T("bravo"))), [0, 1, 2, 3, 4]),
        (Q.SpanBefore(T("alfa"), T("bravo")), [0, 2, 3]),
        (Q.SpanCondition(T("alfa"), T("foxtrot")), [4]),
        (Q.SpanContains(Q.SpanNear((T("alfa"), T("charlie")), slop=4, ordered=False), T("foxtrot")), [4]),
        (Q.SpanNot(T("echo"), Q.SpanNear((T("echo"), T("alfa")), slop=1)), [0, 4]),
        (Q.Ordered((T("alfa"), T("charlie"))), [0, 3, 4]),
        (Q.Sequence((T("alfa"), Q.Or((T("bravo"), T("foxtrot"))))), [0, 2, 3, 4]),
        (Q.Prefix("text", "fox"), [4]),
        (Q.Wildcard("text", "f?xt*"), [4]),
        (Q.Regex("text", "fo[xy]"), [4]),
        (Q.Fuzzy("text", "foxtort"), [4]),
        (Q.Fuzzy("text", "oxtrot", prefix=0), [4]),
        (Q.Variations("text", "alfas"), [0, 1, 2, 3, 4]),
        (Q.TermRange("text", "f", "g"), [4]),
        (Q.TermRange("tag", None, "blue"), [0, 2]),
        (Q.NumericRange("num", 3, None, start_excl=True), [0, 2]),
        (Q.Term("num", 9), [2]),
        (Q.Term("num", "9"), [2]),
        (Q.Term("num", "nine"), []),
        (Q.Term("flag", "yes"), [0, 3]),
        (Q.Term("date", "2002"), [1]),
        (Q.DateRange("date", dt.datetime(2002, 1, 1), None), [1, 2, 4]),
        (Q.ColumnQuery("num", lambda c: c % 2 == 1), [0, 1, 2, 4]),
        (Q.ColumnQuery("tag", "red"), [1]),
        (Q.And((T("alfa"), Q.NumericRange("num", None, 4))), [1, 4]),
        (Q.And((T("alfa"), Q.Not(Q.Term("tag", "blue")))), [1, 3, 4]),
        (Q.Or((T("foxtrot"), Q.Not(T("bravo")))), [4]),
        (Q.Or((T("alfa"), T("bravo"), T("foxtrot")), minmatch=2), [0, 1, 2, 3, 4]),
        (Q.ConstantScore(T("foxtrot")), [4]),
        (Q.And((Q.Otherwise(T("zulu"), T("alfa")), Q.Term("tag", "blue"))), [0, 2]),
        (Q.boolean(required=[T("alfa")], should=[T("foxtrot")], prohibited=[Q.Term("tag", "red")]), [0, 2, 3, 4]),
    ],
)
def test_matches(index, q, expected):
    assert ids(Searcher(index).matches(q)) == expected


def test_scores(index):
    s = Searcher(index, scoring.Frequency())
    score = lambda q: {r["doc_id"]: r["score"] for r in s.matches(q).collect()}
    assert score(T("echo"))[4] == 2.0
    assert score(Q.DisMax((T("echo"), T("alfa")), tiebreak=0.5))[4] == 2.5
    assert score(Q.AndMaybe(T("alfa"), T("foxtrot")))[4] == 2.0
    assert score(Q.Term("text", "echo", boost=3.0))[4] == 6.0
    assert score(Q.Prefix("text", "ech", boost=1.5))[4] == 1.5
    assert score(Q.Weighted(T("echo"), model=scoring.Function(lambda x: x.tf * 10)))[4] == 20.0
    assert score(Q.Or((T("alfa"), T("foxtrot")), scale=0.9))[4] > score(Q.Or((T("alfa"), T("foxtrot")), scale=0.9))[0]
    multi = scoring.Multi(scoring.Frequency(), {"tag": scoring.Function(lambda x: F.lit(7.0))})
    assert {r["score"] for r in Searcher(index, multi).matches(Q.Term("tag", "red")).collect()} == {7.0}
    assert scoring.model_named("pl2", c=2.0).c == 2.0
    with pytest.raises(ValueError):
        scoring.model_named("nothing")


def test_normalize():
    a, b = T("a"), T("b")
    assert Q.And((a, Q.And((b, a)))).normalize() == Q.And((a, b))
    assert Q.Or((a, Q.Null())).normalize() == a
    assert Q.And((Q.Every(), a)).normalize() == a
    assert Q.Wildcard("text", "ab*").normalize() == Q.Prefix("text", "ab") and Q.Wildcard("text", "*").normalize() == Q.Every("text")
    assert (a & b) == Q.And((a, b)) and (a | b) == Q.Or((a, b)) and (a - b) == Q.And((a, Q.Not(b)))
    assert Q.Phrase("text", ("x",), boost=2.0).normalize() == Q.Term("text", "x", 2.0)


def test_sort_page_collapse(index):
    s = Searcher(index)
    order = lambda r: [x["doc_id"] for x in r.hits.orderBy("rank").collect()]
    assert order(s.search(Q.Every(), sortedby="num")) == [4, 1, 0, 2, 3]
    assert order(s.search(Q.Every(), sortedby="num", reverse=True)) == [3, 2, 0, 1, 4]
    assert order(s.search(Q.Every(), sortedby=["tag", facets.FieldFacet("num", reverse=True)])) == [2, 0, 4, 1, 3]
    results, facts = s.page(Q.Every(), 2, 2)
    assert order(results) == [2, 3] and facts.first()["page_count"] == 3 and not facts.first()["is_last"]
    r = s.search(Q.Every(), limit=None, collapse="tag", sortedby="num")
    assert ids(r.hits) == [0, 1, 3, 4] and {x["key"]: x["n"] for x in r.collapsed.collect()} == {"blue": 1}
    assert ids(s.search(Q.Every(), limit=None, collapse="tag", collapse_order=facets.FieldFacet("num", reverse=True)).hits) == [1, 2, 3, 4]
    hit = s.search(Q.Or((T("foxtrot"), T("alfa"))), limit=1, terms=True).hits.first()
    assert hit["doc_id"] == 4 and hit["matched_terms"] == ["text:alfa", "text:foxtrot"]
    assert ids(s.search(T("alfa"), limit=None, scored=False, filter=Q.Term("tag", "blue"), mask=T("foxtrot")).hits) == [0, 2]
    assert s.find("text", "foxtrot").hits.first()["doc_id"] == 4 and s.document(tag="red").first()["doc_id"] == 1


def test_results_operations(index):
    s = Searcher(index)
    a, b = s.search(Q.Every(), sortedby="num", limit=3), s.search(Q.Term("tag", "blue"), sortedby="num", limit=3)
    order = lambda df: [x["doc_id"] for x in df.orderBy("rank").collect()]
    assert order(a.hits) == [4, 1, 0] and order(b.hits) == [0, 2]
    assert order(a.extend(b)) == [4, 1, 0, 2] and order(a.filter(b)) == [0] and order(a.upgrade(b)) == [0, 4, 1] and order(a.upgrade(b, reverse=True)) == [4, 1, 0]
    assert order(a.upgrade_and_extend(b)) == [0, 4, 1, 2]
    x, y = s.docs_for_query(Q.Term("tag", "blue")), s.docs_for_query(T("bravo"))
    assert ids(union(x, y)) == [0, 1, 2, 3] and ids(intersection(x, y)) == [0, 2] and ids(difference(y, x)) == [1, 3] and ids(inverse(y, index)) == [4]
    assert bitmaps(x).count() == 2


def test_facets(index):
    s = Searcher(index)
    groups = lambda f, kind="count", q=Q.Every(): {str(r["key"]): r for r in s.search(q, limit=1, groupedby={"g": f}, maptype=kind).groups["g"].collect()}
    assert {k: r["n"] for k, r in groups("tag").items()} == {"blue": 2, "red": 1, "green": 1, "None": 1}
    assert groups("tag", "list")["blue"]["doc_ids"] == [0, 2] and groups("tag", "best", T("echo"))["blue"]["doc_id"] == 0
    assert groups(facets.RangeFacet("num", 0, 10, 5))["Row(start=0, end=5)"]["n"] == 2
    assert groups(facets.RangeFacet("num", 0, 10, [2, 3]))["Row(start=2, end=5)"]["n"] == 1
    assert groups(facets.QueryFacet({"low": Q.NumericRange("num", None, 4)}, other="rest"))["rest"]["n"] == 3
    assert groups(facets.QueryFacet({"a": T("alfa"), "f": T("foxtrot")}, overlap=True))["a"]["n"] == 5
    assert len(groups(facets.DateRangeFacet("date", dt.datetime(2001, 1, 1), dt.datetime(2006, 1, 1), facets.Months(12)))) == 5
    assert groups(facets.FunctionFacet(lambda: F.col("num") % 2 == 1))["True"]["n"] == 4
    assert groups(facets.TranslateFacet(lambda a, b: F.concat_ws("/", a, b), (facets.FieldFacet("tag"), facets.FieldFacet("num"))))["red/3"]["n"] == 1
    assert groups(facets.StoredFieldFacet("text", overlap=True))["foxtrot"]["n"] == 1
    assert set(facets.discover(index.schema)) == {"date", "flag", "num", "tag"}


def test_index_statistics_and_changes(spark, index, tmp_path):
    assert index.most_frequent_terms("text", 1).first()["term"] == "echo"
    assert index.frequency("text", "echo").first()["frequency"] == 6.0 and index.field_length("text").first()["total"] == 25
    assert ids(index.delete_by_query(T("foxtrot")).docs) == [0, 1, 2, 3]
    stored = index.save(str(tmp_path / "ix"))
    assert ids(Searcher(stored).matches(Q.Phrase("text", ("alfa", "bravo")))) == [0, 2, 3] and SearchIndex.exists(spark, str(tmp_path / "ix"))
    again = SearchIndex.open(spark, str(tmp_path / "ix"), index.schema)
    assert ids(Searcher(again.save(str(tmp_path / "ix"))).matches(T("foxtrot"))) == [4]
    with pytest.raises(FileNotFoundError):
        SearchIndex.open(spark, str(tmp_path / "none"), index.schema)
    schema = Schema(key=ID(unique=True), v=TEXT())
    old = SearchIndex.build(spark.createDataFrame([(1, "a", "one"), (2, "b", "two"), (3, None, "three")], "doc_id long, key string, v string"), schema)
    new = old.update(spark.createDataFrame([(4, "a", "four"), (5, "a", "five"), (6, None, "six")], "doc_id long, key string, v string"))
    assert ids(new.docs) == [2, 3, 5, 6] and ids(Searcher(new).matches(Q.Term("v", "five"))) == [5] and ids(Searcher(new).matches(Q.Term("v", "one"))) == []
    more = old.add_field("w", SEARCH_AS_YOU_TYPE(), source="v")
    assert ids(Searcher(more).matches(Q.Term("w", "thr"))) == [3] and "w" not in more.remove_field("w").schema
    assert ids(old.overlay(new).docs) == [1, 2, 3, 5, 6]
    rows = numbered(spark.createDataFrame([(x,) for x in "dbca"], "k string"), "k").orderBy("doc_id").collect()
    assert [(r["k"], r["doc_id"]) for r in rows] == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    empty = SearchIndex.build(spark.createDataFrame([], "doc_id long, v string"), Schema(v=TEXT()))
    assert ids(Searcher(empty).matches(Q.Term("v", "x"))) == []


def test_nested(spark):
    rows = [(0, "product", "car", None), (1, "part", "engine", 100), (2, "part", "wheel", 5), (3, "product", "bike", None), (4, "part", "wheel", 7), (5, "part", "chain", 2)]
    df = with_parents(spark.createDataFrame(rows, "doc_id long, kind string, name string, price int"), F.col("kind") == "product")
    ix = SearchIndex.build(df, Schema(kind=ID(), name=ID(), price=NUMERIC()))
    s = Searcher(ix, scoring.Frequency())
    parents = Q.Term("kind", "product")
    assert ids(s.matches(Q.NestedParent(parents, Q.Term("name", "wheel")))) == [0, 3]
    assert ids(s.matches(Q.NestedParent(parents, Q.NumericRange("price", 50, None)))) == [0]
    assert {r["doc_id"]: r["score"] for r in s.matches(Q.NestedParent(parents, Q.Term("kind", "part"))).collect()} == {0: 2.0, 3: 2.0}
    assert {r["score"] for r in s.matches(Q.NestedParent(parents, Q.Term("kind", "part"), per_parent=1)).collect()} == {1.0}
    assert ids(s.matches(Q.NestedChildren(parents, Q.Term("name", "bike")))) == [4, 5]
    assert ids(s.matches(Q.And((Q.NestedChildren(parents, Q.Term("name", "bike")), Q.Term("name", "wheel"))))) == [4]


def test_suggest_and_expand(spark, index):
    assert [r["term"] for r in suggest.suggest(index, "text", "bravp").collect()] == ["bravo"]
    assert [r["term"] for r in suggest.suggest(index, "text", "ecko", by_distance=True).collect()] == ["echo"]
    q, text = suggest.correct_query(index, Q.And((T("alfa"), T("foxtrt"))), "alfa foxtrt")
    assert q == Q.And((T("alfa"), T("foxtrot"))) and text == "alfa foxtrot"
    assert [r["term"] for r in suggest.complete(index, "text", "cha").collect()] == ["charlie"]
    words = suggest.vocabulary(spark, ["hello", "help", "hold"])
    assert [r["term"] for r in suggest.suggest_from(words, "helo").collect()] == ["hello", "help", "hold"]
    both = suggest.suggest_all([suggest.suggest_from(words, "helo"), suggest.suggest_from(words, "help")])
    assert both.first()["term"] == "help" or both.count() == 3
    phrases = spark.createDataFrame([("new york",), ("new",), ("old",)], "phrase string")
    assert [r["phrase"] for r in suggest.complete_phrases(phrases, "new").collect()] == ["new", "new york"]
    assert suggest.complete_ngrams(phrases, "new yo").first()["phrase"] == "new york"
    assert [r["term"] for r in expand.key_terms(index, index.docs.where("doc_id = 4"), "text", 2).collect()] == ["echo", "foxtrot"]
    for model in ("bo2", "kl"):
        assert expand.key_terms(index, index.docs.where("doc_id = 4"), "text", 2, model).count() == 2
    like = expand.more_like(Searcher(index), 0, "text").hits
    assert 0 not in ids(like) and like.count() > 0
    h = spark.createDataFrame([("a b c d",), ("a b c d",), ("w x y z",)], "t string").select(expand.simhash(F.split("t", " ")).alias("h")).collect()
    assert h[0]["h"] == h[1]["h"] != h[2]["h"]
    nums = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 100, 101, 102)], "v double")
    got = {r["v"]: r["cluster"] for r in expand.kmeans(nums, "v", 2).collect()}
    assert got[1.0] == got[3.0] != got[100.0] == got[102.0]
    assert [r["in_window"] for r in expand.windows_of(nums, "v", 2.0).orderBy("v").collect()] == [3, 2, 1, 3, 2, 1]


def test_highlight(index):
    text = "The quick brown fox jumps. Over the lazy dog & a Fox again!"
    assert highlight.excerpt(text, ["fox"], format=highlight.uppercase()) .count("FOX") == 2
    out = highlight.excerpt(text, ["fox"], fragmenter=highlight.whole)
    assert '<strong class="match term0">fox</strong>' in out and "&amp;" in out
    assert highlight.excerpt(text, ["zebra"]) == "" and highlight.excerpt(None, ["x"]) == ""
    assert highlight.excerpt(text, ["fox"], fragmenter=highlight.sentences(), format=highlight.null_format(" | ")) == "The quick brown fox jumps. | Over the lazy dog & a Fox again!"
    only = highlight.marks_of("big cat and big dog", ["big", "cat"], phrases=[("big", "cat")])
    assert [m.start for m in only] == [0, 4]
    long = "x " * 300 + "needle " + "y " * 300
    got = highlight.excerpt(long, ["needle"], fragmenter=highlight.pinpoint(surround=10), format=highlight.null_format())
    assert "needle" in got and len(got) <= 200
    hits = Searcher(index).search(T("foxtrot")).hits
    assert "foxtrot</strong>" in highlight.highlight(hits, "text", T("foxtrot"), "text").first()["highlight"]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.7, 0.7]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "doc_id long, embedding array<double>")
    got = vectors.search(df, [1.0, 0.1], 2).collect()
    assert [r["doc_id"] for r in got] == [1, 2]
    assert [r["doc_id"] for r in vectors.search(df, [1.0, 0.1], 2, among=df.where("doc_id > 1")).collect()] == [2, 3]
    assert [r["doc_id"] for r in vectors.search(df, [0.0, 1.0], 1, metric="l2").collect()] == [3]
    qs = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 2.0])], "query_id long, embedding array<double>")
    many = {(r["query_id"], r["rank"]): r["doc_id"] for r in vectors.search_many(df.where("embedding is not null"), qs, 2).collect()}
    assert many == {(7, 1): 1, (7, 2): 2, (8, 1): 3, (8, 2): 2}
    fused = vectors.fuse([vectors.search(df, [1.0, 0.0], 3), vectors.search(df, [0.0, 1.0], 3)]).collect()
    assert len(fused) == 3
    embedded = vectors.embed(spark.createDataFrame([("ab",), (None,)], "t string"), "t", lambda: lambda ts: [[float(len(t))] for t in ts])
    assert [r["embedding"] for r in embedded.collect()] == [[2.0], [0.0]]


def test_synonyms(spark):
    s = Synonyms({"Car": ["auto"]})
    s.add("car", "wagon")
    df = spark.createDataFrame([("my car is",)], "t string")
    assert df.select(s.expand_text(F.col("t")).alias("x")).first()["x"] == "my car auto wagon is"
    assert s.expand_query(T("car")) == Q.Or((T("car"), T("auto"), T("wagon")))
    assert Synonyms.from_frame(s.to_frame(spark)).get("CAR") == ("auto", "wagon") and Synonyms.from_json(s.to_json()).words == s.words


def test_schemas():
    class Doc(SchemaClass):
        title = TEXT()
        tags = KEYWORD(commas=True)

    assert ensure_schema(Doc).names() == ["tags", "title"]
    merged = merge_schemas([Doc.schema(), Schema(n=NUMERIC())])
    assert merged.names() == ["n", "tags", "title"]
    with pytest.raises(ValueError):
        merge_schemas([Schema(a=TEXT()), Schema(a=ID())])
    s = Schema({"*_t": TEXT()})
    assert "name_t" in s and "name" not in s and list(s.resolve(["x_t", "y"])) == ["x_t"]
    with pytest.raises(KeyError):
        Schema()["x"]
    assert NUMERIC(bits=64, signed=False).type.simpleString() == "decimal(20,0)"

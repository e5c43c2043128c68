"""Web services as Spark data sources: JSON over HTTP by pages, offsets or cursors, and GraphQL."""

from __future__ import annotations

import base64
import itertools
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

def headers_of(auth: Mapping | None) -> dict[str, str]:
    """bearer, basic or api_key credentials as a header."""
    if not auth:
        return {}
    kind = auth.get("type", "bearer")
    if kind == "bearer":
        return {"Authorization": f"Bearer {auth['token']}"}
    if kind == "basic":
        return {"Authorization": "Basic " + base64.b64encode(f"{auth['username']}:{auth['password']}".encode()).decode()}
    if kind == "api_key":
        return {auth.get("header", "X-API-Key"): auth["key"]}
    raise ValueError(f"unknown kind of credentials {kind!r}")


def fetch(url: str, method: str = "GET", params: Mapping | None = None, headers: Mapping | None = None, body: bytes | None = None, timeout: float = 30, tries: int = 5):
    """Parsed JSON; waits as told when asked to slow down."""
    if params:
        url += ("&" if "?" in url else "?") + urllib.parse.urlencode(params)
    for k in range(tries):
        request = urllib.request.Request(url, data=body, method=method, headers={"Accept": "application/json", **(headers or {})})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as got:
                return json.loads(got.read() or b"null")
        except urllib.error.HTTPError as e:
            if e.code != 429 or k == tries - 1:
                raise
            wait = e.headers.get("Retry-After", "1")
            time.sleep(min(float(wait) if wait.replace(".", "", 1).isdigit() else 1.0, 60))


def rows_at(value, path: str | None) -> list:
    """The list under a dotted path (or the value, or its results, data or items); nothing where there is none."""
    if path:
        for part in path.split("."):
            value = value.get(part) if isinstance(value, Mapping) else None
    elif isinstance(value, Mapping):
        value = next((value[n] for n in ("results", "data", "items") if isinstance(value.get(n), list)), [value])
    return value if isinstance(value, list) else [value] if isinstance(value, Mapping) else []


class Page(InputPartition):
    def __init__(self, value):
        super().__init__(value)


class RestReader(DataSourceReader):
    """Pages are followed to the end; ``max_pages`` in the pagination makes a longer feed an error, and so is a cursor that comes twice."""

    def __init__(self, schema: T.StructType, options: Mapping[str, str]):
        self.schema, self.o = schema, json.loads(options["config"])

    def partitions(self) -> list[Page]:
        """One task per page where the number of pages is given, else one task that follows the pages."""
        paging = self.o.get("pagination") or {}
        if paging.get("type") in ("page", "offset") and paging.get("pages"):
            return [Page(k) for k in range(int(paging["pages"]))]
        return [Page(None)]

    def _get(self, params: Mapping):
        return fetch(self.o["url"], self.o.get("method", "GET"), {**(self.o.get("params") or {}), **params}, {**(self.o.get("headers") or {}), **headers_of(self.o.get("auth"))}, timeout=self.o.get("timeout", 30))

    def read(self, partition: Page) -> Iterator[tuple]:
        for row in self._rows(partition.value):
            yield tuple(_fit(row.get(f.name), f.dataType) for f in self.schema)

    def _rows(self, number: int | None) -> Iterator[Mapping]:
        paging, path = self.o.get("pagination") or {}, self.o.get("document_path")
        kind, size = paging.get("type"), int(self.o.get("page_size", 100))
        if not kind:
            yield from rows_at(self._get({}), path)
            return
        name, size_name = paging.get("param", {"page": "page", "offset": "offset", "cursor": "cursor"}[kind]), paging.get("size_param", "limit")
        first = int(paging.get("start", 1 if kind == "page" else 0))
        if number is not None:
            at = first + number if kind == "page" else first + number * size
            yield from rows_at(self._get({name: at, size_name: size}), path)
            return
        cursor, seen, most = None, set(), paging.get("max_pages")
        for k in itertools.count():
            if most is not None and k >= int(most):
                raise RuntimeError(f"more than {most} pages at {self.o['url']}")
            at = {"page": first + k, "offset": first + k * size, "cursor": cursor}[kind]
            got = self._get({size_name: size, **({} if at is None else {name: at})})
            rows = rows_at(got, path)
            yield from rows
            if kind == "cursor":
                cursor = got
                for part in paging.get("next", "next").split("."):
                    cursor = cursor.get(part) if isinstance(cursor, Mapping) else None
                if not cursor:
                    return
                if str(cursor) in seen:
                    raise RuntimeError(f"cursor {cursor!r} came twice at {self.o['url']}")
                seen.add(str(cursor))
            elif len(rows) < size:
                return


def _fit(value, kind: T.DataType):
    """A JSON value in a column's type; nested values as JSON text where the column is a string."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return int(value)
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else str(value).lower() in ("true", "1", "yes", "t")
    return value


class RestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_rest"

    def schema(self) -> T.StructType:
        """Types of the first page's rows."""
        from quarry.sources.readers import _type_of

        reader = RestReader(T.StructType(), self.options)
        rows = []
        for row in reader._rows(0 if (reader.o.get("pagination") or {}).get("pages") else None):
            rows.append(row)
            if len(rows) == 5:
                break
        names = list(dict.fromkeys(n for r in rows for n in r))
        return T.StructType([T.StructField(n, _type_of([r.get(n) for r in rows])) for n in names])

    def reader(self, schema: T.StructType) -> RestReader:
        return RestReader(schema, self.options)


def rest(spark: SparkSession, url: str, schema: T.StructType | str | None = None, **config) -> DataFrame:
    spark.dataSource.register(RestSource)
    reader = spark.read.format("quarry_rest").option("config", json.dumps({"url": url, **config}))
    return (reader.schema(schema) if schema is not None else reader).load()


class GraphReader(RestReader):
    def _rows(self, number):
        body = json.dumps({"query": self.o["query"], "variables": self.o.get("variables") or {}}).encode()
        got = fetch(self.o["url"], "POST", None, {"Content-Type": "application/json", **(self.o.get("headers") or {}), **headers_of(self.o.get("auth"))}, body, self.o.get("timeout", 30))
        if got.get("errors"):
            raise RuntimeError(f"GraphQL: {got['errors']}")
        data = got.get("data") or {}
        path = self.o.get("document_path") or (next(iter(data), "") if len(data) == 1 else "")
        yield from rows_at(data, path)


class GraphSource(RestSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_graphql"

    def schema(self) -> T.StructType:
        from quarry.sources.readers import _type_of

        rows = [r for _, r in zip(range(5), GraphReader(T.StructType(), self.options)._rows(None))]
        names = list(dict.fromkeys(n for r in rows for n in r))
        return T.StructType([T.StructField(n, _type_of([r.get(n) for r in rows])) for n in names])

    def reader(self, schema):
        return GraphReader(schema, self.options)


def graphql(spark: SparkSession, url: str, query: str, schema: T.StructType | str | None = None, **config) -> DataFrame:
    spark.dataSource.register(GraphSource)
    reader = spark.read.format("quarry_graphql").option("config", json.dumps({"url": url, "query": query, **config}))
    return (reader.schema(schema) if schema is not None else reader).load()

"""Sources: everything that yields a DataFrame.

A Source has a name, a schema, batches, changes since a value, a count and a health check; the readers below make
DataFrames of files, databases, web services and in-memory objects, and ``make`` builds one from a description.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Source:
    """A DataFrame that can be made again. ``incremental``: column that grows with changes. ``id_field``: key column."""

    name: str
    make: Callable[[], DataFrame]
    incremental: str | None = None
    id_field: str | None = None
    observers: list[Callable[[DataFrame], None]] = field(default_factory=list)
    _frame: DataFrame | None = None

    def frame(self) -> DataFrame:
        if self._frame is None:
            self._frame = self.make()
        return self._frame

    def refresh(self) -> DataFrame:
        """Reads anew and tells the observers."""
        self._frame = self.make()
        for tell in self.observers:
            tell(self._frame)
        return self._frame

    def discover_schema(self):
        from quarry.sources.discovery import schema_of

        return schema_of(self.frame(), self.id_field)

    def changes(self, since) -> DataFrame:
        """Rows whose incremental column is strictly greater."""
        if not self.incremental:
            raise ValueError(f"{self.name} has no incremental column")
        return self.frame().where(F.col(self.incremental) > F.lit(since))

    def count(self) -> int:
        return self.frame().count()

    def batches(self, size: int = 1000) -> Iterable[list]:
        """Rows by lists of ``size``, one partition at a time on the driver."""
        held: list = []
        for row in self.frame().toLocalIterator(prefetchPartitions=True):
            held.append(row)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held

    def health_check(self) -> bool:
        try:
            self.frame().limit(1).collect()
            return True
        except Exception:
            return False

    def metadata(self) -> dict:
        return {"name": self.name, "incremental": self.incremental, "id_field": self.id_field, "schema": self.frame().schema.jsonValue()}

    def observe(self, fn: Callable[[DataFrame], None]) -> None:
        self.observers.append(fn)

    def unobserve(self, fn: Callable[[DataFrame], None]) -> None:
        self.observers.remove(fn)


def clean_names(names: Sequence[str]) -> list[str]:
    """Column names of word characters, not starting with a digit, made unique by a number."""
    out: list[str] = []
    for k, name in enumerate(names):
        new = re.sub(r"\W+", "_", (name or "").strip()).strip("_").lower() or f"column_{k + 1}"
        new = f"_{new}" if new[0].isdigit() else new
        base, n = new, 2
        while new in out:
            new, n = f"{base}_{n}", n + 1
        out.append(new)
    return out


def csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8", **options) -> DataFrame:
    """Strings under cleaned header names."""
    df = spark.read.csv(path, header=True, sep=delimiter, encoding=encoding, inferSchema=False, multiLine=options.pop("multiline", False), **options)
    return df.toDF(*clean_names(df.columns))


#: What happens to JSON lines that do not parse: they are left out, an error ends the read, or their text stays in _corrupt_record.
MALFORMED = {"drop": "DROPMALFORMED", "fail": "FAILFAST", "keep": "PERMISSIVE"}


def json(spark: SparkSession, path: str, document_path: str | None = None, lines: bool | None = None, schema: T.StructType | str | None = None, malformed: str = "fail") -> DataFrame:
    """JSON lines, an array, or an object that holds the rows under results, data or a dotted path. A ``document_path`` that leads to no rows is an error.

    ``malformed`` says what becomes of lines that do not parse, by default an error; a whole document that does not parse is an error.
    """
    if lines is None:
        head = [r["value"].strip() for r in spark.read.text(path).limit(2).collect()]
        lines = bool(head) and all(h.startswith("{") and h.endswith("}") for h in head) and (len(head) > 1 or not document_path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.option("multiLine", not lines).option("mode", MALFORMED[malformed] if lines else "FAILFAST").json(path)
    if not lines:
        at = document_path or next((n for n in ("results", "data") if n in df.columns and len(df.columns) <= 2), None)
        if at:
            kind: T.DataType | None = df.schema
            for part in at.split("."):
                kind = kind[part].dataType if isinstance(kind, T.StructType) and part in kind.fieldNames() else None
            if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
                raise ValueError(f"{path}: no rows under {at!r}")
            df = df.select(F.explode(F.col(at)).alias("__row")).select("__row.*")
    return df


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with dates widened to timestamps."""
    df = spark.read.parquet(path)
    dates = {f.name: F.col(f"`{f.name}`").cast("timestamp_ntz") for f in df.schema if isinstance(f.dataType, T.DateType)}
    return df.withColumns(dates) if dates else df


def jdbc(spark: SparkSession, url: str, query: str, since=None, incremental: str | None = None, **options) -> DataFrame:
    """A query run by a database; a delta wraps the query, so it holds for any query."""
    if since is not None:
        value = f"'{since}'" if isinstance(since, str) else since
        query = f"SELECT * FROM ({query}) q WHERE q.{incremental} > {value}"
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def dbapi(spark: SparkSession, connect: Callable[[], object], query: str, schema: T.StructType | str | None = None, splits: Sequence[str] = (), limit: int | None = None, sample: int = 1000) -> DataFrame:
    """A query over a Python DB-API connection made on the executors; ``splits`` are conditions read in parallel.

    Without a schema the types are those of the first ``sample`` rows; a later value that does not fit its type ends the read with an error.
    """
    parts = list(splits) or ["1 = 1"]
    if schema is None:
        cursor = connect().cursor()
        cursor.execute(f"SELECT * FROM ({query}) q LIMIT {int(sample)}")
        names = [d[0] for d in cursor.description]
        if len(set(names)) != len(names):
            raise ValueError(f"duplicate column names: {names}")
        rows = cursor.fetchall()
        schema = T.StructType([T.StructField(n, _type_of([r[k] for r in rows])) for k, n in enumerate(names)])
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = schema.fieldNames()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for condition in pdf["split"]:
                cursor = connect().cursor()
                cursor.execute(f"SELECT * FROM ({query}) q WHERE {condition}" + (f" LIMIT {limit}" if limit else ""))
                while rows := cursor.fetchmany(10_000):
                    yield pd.DataFrame(rows, columns=names)

    return spark.createDataFrame([(p,) for p in parts], "split string").repartition(len(parts)).mapInPandas(run, schema)


def _type_of(values: Sequence) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {bool} and kinds:
        return T.BooleanType()
    if kinds <= {int, bool} and kinds:
        return T.LongType()
    if kinds <= {int, float, bool} and kinds:
        return T.DoubleType()
    return T.BinaryType() if kinds == {bytes} else T.StringType()


def pandas(spark: SparkSession, frame, schema=None) -> DataFrame:
    return spark.createDataFrame(frame, schema) if schema is not None else spark.createDataFrame(frame)


def arrow(spark: SparkSession, value) -> DataFrame:
    """An Arrow table, or anything with to_arrow()."""
    return spark.createDataFrame(value.to_arrow() if hasattr(value, "to_arrow") else value)


def models(spark: SparkSession, objects: Sequence, schema: T.StructType | None = None) -> DataFrame:
    """Dataclass, pydantic-like or plain objects, one row each."""
    rows = [dict(model_values(o)) for o in objects]
    if schema is None and objects:
        from quarry.sources.discovery import struct_of

        schema = struct_of(type(objects[0]))
    return spark.createDataFrame(rows, schema)


def model_values(o) -> Mapping:
    if dataclasses.is_dataclass(o):
        return {f.name: getattr(o, f.name) for f in dataclasses.fields(o)}
    if hasattr(o, "model_dump"):
        return o.model_dump()
    if hasattr(o, "__struct_fields__"):
        return {n: getattr(o, n) for n in o.__struct_fields__}
    if isinstance(o, Mapping):
        return o
    return {k: v for k, v in vars(o).items() if not k.startswith("_")}


def make(spark: SparkSession, description: Mapping) -> Source:
    """A source from its description: type and its options."""
    from quarry.sources import rest

    d = dict(description)
    kind, name = d.pop("type"), d.pop("name", d.get("path") or d.get("url") or "source")
    keep = {k: d.pop(k, None) for k in ("incremental", "id_field")}
    readers: dict[str, Callable[..., DataFrame]] = {
        "csv": csv, "json": json, "jsonl": lambda s, path, **o: json(s, path, lines=True, **o), "parquet": parquet, "jdbc": jdbc, "sql": jdbc, "dbapi": dbapi,
        "pandas": pandas, "polars": arrow, "arrow": arrow, "models": models, "pydantic": models, "rest": rest.rest, "graphql": rest.graphql,
        "table": lambda s, table: s.table(table), "query": lambda s, query: s.sql(query), "orc": lambda s, path: s.read.orc(path),
        "binary": lambda s, path: s.read.format("binaryFile").load(path),
    }
    if kind not in readers:
        raise ValueError(f"unknown source type {kind!r}")
    return Source(name, lambda: readers[kind](spark, **d), **keep)

"""Schemas from data: Spark types, class annotations, samples; and checks of data against them."""

from __future__ import annotations

import dataclasses
import datetime as dt
import decimal
import typing
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans import schema as S

#: Python types and what they are in Spark.
PYTHON_TYPES: dict[type, T.DataType] = {
    str: T.StringType(), bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), bytes: T.BinaryType(), decimal.Decimal: T.DecimalType(38, 10),
    dt.datetime: T.TimestampNTZType(), dt.date: T.DateType(), dict: T.StringType(),
}


def spark_type(annotation) -> T.DataType:
    """Spark type of an annotation; optional and list types are seen through."""
    origin, args = typing.get_origin(annotation), typing.get_args(annotation)
    if origin in (list, tuple, set, Sequence, frozenset):
        return T.ArrayType(spark_type(args[0] if args else str))
    if origin in (dict, Mapping):
        return T.MapType(T.StringType(), spark_type(args[1]) if len(args) > 1 else T.StringType())
    if args and type(None) in args:
        return spark_type(next(a for a in args if a is not type(None)))
    return PYTHON_TYPES.get(annotation, T.StringType())


def struct_of(model: type) -> T.StructType:
    hints = typing.get_type_hints(model)
    names = [f.name for f in dataclasses.fields(model)] if dataclasses.is_dataclass(model) else list(getattr(model, "model_fields", hints))
    return T.StructType([T.StructField(n, spark_type(hints.get(n, str))) for n in names])


def field_for(kind: T.DataType, name: str = "", id_field: str | None = None) -> S.Field:
    """The field type for a column: ids, booleans and times by type or name, arrays as keywords, other text as TEXT."""
    if name and name == id_field:
        return S.ID(stored=True, unique=True)
    if isinstance(kind, T.BooleanType):
        return S.BOOLEAN(stored=True)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return S.DATETIME(stored=True, sortable=True)
    if isinstance(kind, T.NumericType):
        return S.NUMERIC(kind, stored=True, sortable=True)
    if isinstance(kind, T.ArrayType):
        return S.VECTOR() if isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else S.KEYWORD(stored=True)
    if isinstance(kind, (T.MapType, T.StructType, T.BinaryType)):
        return S.STORED()
    low = name.lower()
    if low in ("id", "uuid", "guid", "key") or low.endswith(("_id", "_uuid", "_key")):
        return S.ID(stored=True)
    return S.TEXT(stored=True)


def schema_of(df: DataFrame, id_field: str | None = None, overrides: Mapping[str, S.Field] | None = None) -> S.Schema:
    fields = {f.name: field_for(f.dataType, f.name, id_field) for f in df.schema}
    return S.Schema({**fields, **(overrides or {})})


def schema_of_model(model: type, id_field: str | None = None) -> S.Schema:
    """A schema from annotations; fields may carry a Field as metadata (dataclasses: metadata={"field": ...})."""
    struct = struct_of(model)
    given = {f.name: f.metadata["field"] for f in dataclasses.fields(model) if "field" in f.metadata} if dataclasses.is_dataclass(model) else {}
    return S.Schema({f.name: given.get(f.name) or field_for(f.dataType, f.name, id_field) for f in struct})


#: Schemas of registered models.
MODELS: dict[type, S.Schema] = {}


def register_model(model: type | None = None, id_field: str | None = None, **fields: S.Field):
    """Registers the schema of a dataclass, pydantic-like, msgspec-like or mapped class, with ``fields`` instead of what its annotations say.

    Also as a decorator: ``@register_model(id_field="id")``.
    """
    if model is None:
        return lambda m: register_model(m, id_field, **fields)
    MODELS[model] = S.Schema({**schema_of_model(model, id_field).fields, **fields})
    return model


def index_models(spark, objects, id_field: str | None = None):
    """An index over objects of one registered model; ``id_field`` names the document id, if it is a whole number."""
    from quarry.operators.index import SearchIndex
    from quarry.sources import readers

    kind = type(objects[0])
    return SearchIndex.build(readers.models(spark, objects, struct_of(kind)), MODELS.get(kind) or schema_of_model(kind, id_field), id_field)


def discover_types(df: DataFrame, sample: int | None = None, share: float = 0.5) -> dict[str, T.DataType]:
    """Types that most values of the string columns have, over all rows (or a sample): boolean, long, double, timestamp."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    rows = df.limit(sample) if sample else df
    if not names:
        return {}
    tests = {"boolean": lambda c: F.lower(c).isin("t", "true", "yes", "f", "false", "no"), "bigint": lambda c: c.rlike(r"^[+-]?\d{1,18}$"), "double": lambda c: c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "timestamp_ntz": lambda c: c.rlike(r"^\d{4}-\d\d-\d\d([ T]\d\d:\d\d(:\d\d(\.\d+)?)?)?$")}
    counts = [F.count_if(F.trim(F.col(f"`{n}`")) != "").alias(f"{k}:n") for k, n in enumerate(names)]
    counts += [F.count_if(test(F.trim(F.col(f"`{n}`")))).alias(f"{k}:{t}") for k, n in enumerate(names) for t, test in tests.items()]
    got = rows.agg(*counts).first().asDict()
    out: dict[str, T.DataType] = {}
    for k, n in enumerate(names):
        total = got[f"{k}:n"]
        best = next((t for t in tests if total and got[f"{k}:{t}"] > share * total), None)
        out[n] = T._parse_datatype_string(best) if best else T.StringType()
    return out


def typed(df: DataFrame, types: Mapping[str, T.DataType]) -> DataFrame:
    """Columns cast to types, values that don't fit becoming null."""
    return df.withColumns({n: F.col(f"`{n}`").try_cast(t) for n, t in types.items()})


@dataclass(frozen=True)
class Issue:
    level: str
    field: str
    message: str
    severity: str = "error"


def validate(df: DataFrame, schema: S.Schema, id_field: str | None = None) -> list[Issue]:
    """Structural, search, performance and content checks; the content check is one aggregation over all rows."""
    out: list[Issue] = []
    specs = schema.resolve(df.columns)
    for name in schema.names():
        if name not in specs and "*" not in name and "?" not in name:
            out.append(Issue("structural", name, "no such column"))
    if id_field and id_field not in df.columns:
        out.append(Issue("structural", id_field, "no such id column"))
    if len(set(map(str.lower, df.columns))) != len(df.columns):
        out.append(Issue("structural", "", "column names clash"))
    if not any(spec.indexed for spec, _ in specs.values()):
        out.append(Issue("search", "", "no searchable field"))
    for name, (spec, _) in specs.items():
        if spec.kind == "text" and spec.unique:
            out.append(Issue("search", name, "a text field cannot be a key", "warning"))
        if spec.kind in ("ngram", "ngramwords") and spec.options.get("high", 4) - spec.options.get("low", 2) > 8:
            out.append(Issue("performance", name, "many n-grams per word", "warning"))
    checks = []
    for name, (spec, column) in specs.items():
        c = F.col(f"`{column}`")
        if spec.type is not None and spec.kind in ("numeric", "datetime", "boolean"):
            checks.append(F.count_if(c.isNotNull() & c.try_cast(spec.type).isNull()).alias(f"{name}:type"))
        if spec.unique:
            checks.append((F.count(c) - F.count_distinct(c)).alias(f"{name}:repeated"))
        if spec.kind == "vector" and spec.dimension:
            checks.append(F.count_if(F.size(c) != spec.dimension).alias(f"{name}:dimension"))
    if checks:
        for key, n in df.agg(*checks).first().asDict().items():
            if n:
                name, what = key.rsplit(":", 1)
                out.append(Issue("runtime", name, f"{n} values: {what}"))
    return out


def usage_report(df: DataFrame, schema: S.Schema) -> DataFrame:
    """Per field the share of nulls, the distinct values, and a tighter kind where one fits."""
    specs = {n: c for n, (s, c) in schema.resolve(df.columns).items() if not n.startswith("spell_")}
    aggregates = [F.count(F.lit(1)).alias("__n")]
    for n, c in specs.items():
        col = F.col(f"`{c}`")
        aggregates += [F.count(col).alias(f"{n}:c"), F.approx_count_distinct(col.cast("string")).alias(f"{n}:d")]
    got = df.agg(*aggregates)
    spark: SparkSession = df.sparkSession
    row = got.first().asDict()
    rows = []
    for n in specs:
        kind, share = schema[n].kind, row[f"{n}:d"] / max(row[f"{n}:c"], 1)
        advice = "keyword" if kind == "text" and share < 0.05 else "id" if kind in ("text", "keyword") and share > 0.99 and row[f"{n}:c"] > 20 else kind
        rows.append((n, kind, 1 - row[f"{n}:c"] / max(row["__n"], 1), row[f"{n}:d"], advice))
    return spark.createDataFrame(rows, "field string, kind string, nulls double, distinct long, advice string")

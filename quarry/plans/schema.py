"""Field types and schemas."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import analysis
from quarry.functions.analysis import Analyzer


@dataclass(frozen=True)
class Field:
    """How a column is indexed. ``kind``: text, id, idlist, keyword, numeric, datetime, boolean, ngram, ngramwords, vector, stored."""

    kind: str
    analyzer: Analyzer | None = None
    stored: bool = False
    unique: bool = False
    sortable: bool = False
    scorable: bool = False
    positions: bool = False
    boost: float = 1.0
    spelling: bool = False
    multitoken: str = "default"
    type: T.DataType | None = None
    dimension: int | None = None
    options: Mapping = field(default_factory=dict)

    @property
    def indexed(self) -> bool:
        """Whether the field has postings; other kinds are queried as columns."""
        return self.analyzer is not None


def TEXT(analyzer: Analyzer | None = None, phrase: bool = True, stored: bool = False, boost: float = 1.0, spelling: bool = False, sortable: bool = False, multitoken: str = "default", frequency: bool = True, characters: bool = False, token_boosts: str | None = None) -> Field:
    """``frequency=False`` keeps only that a term is there: every weight is the boost, and there are no positions.

    ``characters`` keeps the first and last character of every place beside its position. ``token_boosts`` is what divides a word of
    the text from its boost (word^2.5): a posting's weight is then the sum of its places' boosts, which are kept too.
    """
    options = {} if frequency else {"existence": True}
    if characters:
        options["characters"] = True
    if token_boosts:
        options["boosts"] = token_boosts
    return Field("text", analyzer or analysis.standard(), stored, scorable=True, positions=phrase and frequency, boost=boost, spelling=spelling, sortable=sortable, multitoken=multitoken, options=options)


def SPELL(analyzer: Analyzer | None = None) -> Field:
    """Plain words of a text, for suggestions: neither stored nor scored."""
    return Field("text", analyzer or analysis.simple(), False)


def ID(stored: bool = False, unique: bool = False, sortable: bool = False, boost: float = 1.0, analyzer: Analyzer | None = None) -> Field:
    return Field("id", analyzer or analysis.id_analyzer(), stored, unique, sortable, boost=boost)


def IDLIST(stored: bool = False, unique: bool = False, expression: str = r"[^\r\n\t ,;]+", boost: float = 1.0) -> Field:
    return Field("idlist", Analyzer([analysis.regex_tokenizer(expression)]), stored, unique, boost=boost)


def KEYWORD(stored: bool = False, lowercase: bool = False, commas: bool = False, scorable: bool = False, unique: bool = False, boost: float = 1.0, sortable: bool = False) -> Field:
    return Field("keyword", analysis.keyword(lowercase, commas), stored, unique, sortable, scorable, boost=boost)


def NUMERIC(type: T.DataType | str = "int", bits: int = 32, decimal_places: int = 0, signed: bool = True, stored: bool = False, unique: bool = False, sortable: bool = False) -> Field:
    """int of 8 to 64 bits, float, or decimal with places; unsigned 64-bit integers are decimals of 20 digits."""
    if isinstance(type, str):
        if type == "float":
            type = T.DoubleType()
        elif type == "decimal" or decimal_places:
            type = T.DecimalType(38, decimal_places)
        elif not signed:
            type = {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType()}.get(bits, T.DecimalType(20, 0))
        else:
            type = {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}[bits]
    return Field("numeric", None, stored, unique, sortable, type=type)


def DATETIME(stored: bool = False, unique: bool = False, sortable: bool = False) -> Field:
    return Field("datetime", None, stored, unique, sortable, type=T.TimestampNTZType())


def BOOLEAN(stored: bool = False) -> Field:
    return Field("boolean", None, stored, type=T.BooleanType())


def STORED() -> Field:
    return Field("stored", None, True)


def COLUMN(type: T.DataType | None = None) -> Field:
    return Field("stored", None, True, sortable=True, type=type)


def NGRAM(low: int = 2, high: int = 4, stored: bool = False, any_gram: bool = False, phrase: bool = False) -> Field:
    return Field("ngram", analysis.ngram(low, high), stored, positions=phrase, scorable=True, multitoken="or" if any_gram else "and", options={"low": low, "high": high})


def NGRAMWORDS(low: int = 2, high: int = 4, stored: bool = False, at: str | None = None, any_gram: bool = False, sortable: bool = False) -> Field:
    return Field("ngramwords", analysis.ngram_words(low, high, at), stored, sortable=sortable, scorable=True, multitoken="or" if any_gram else "and", options={"low": low, "high": high, "at": at})


def SEARCH_AS_YOU_TYPE(stored: bool = True) -> Field:
    return Field("text", analysis.autocomplete(), stored, scorable=True)


def VECTOR(dimension: int | None = None, stored: bool = True) -> Field:
    return Field("vector", None, stored, dimension=dimension, type=T.ArrayType(T.FloatType()))


def REVERSED(base: Field | None = None) -> Field:
    """A companion of a field with its terms reversed, for leading wildcards."""
    return replace(base or TEXT(), analyzer=(base or TEXT()).analyzer | analysis.reverse(), stored=False)


class Schema:
    """Fields by name, in name order; names with * or ? are patterns for columns found at build time."""

    def __init__(self, fields: Mapping[str, Field] | None = None, copies: Mapping[str, str] | None = None, **named: Field):
        self.fields: dict[str, Field] = dict(sorted({**(fields or {}), **named}.items()))
        #: field -> column it is built from, where the names differ (spelling, reversed and n-gram companions)
        self.copies: dict[str, str] = dict(copies or {})

    def __contains__(self, name: str) -> bool:
        return self.get(name) is not None

    def __getitem__(self, name: str) -> Field:
        found = self.get(name)
        if found is None:
            raise KeyError(name)
        return found

    def get(self, name: str) -> Field | None:
        if name in self.fields:
            return self.fields[name]
        return next((f for n, f in self.fields.items() if ("*" in n or "?" in n) and fnmatch.fnmatchcase(name, n)), None)

    def add(self, name: str, spec: Field, source: str | None = None) -> Schema:
        return Schema({**self.fields, name: spec}, {**self.copies, **({name: source} if source else {})})

    def remove(self, name: str) -> Schema:
        if name not in self.fields:
            raise KeyError(name)
        return Schema({k: v for k, v in self.fields.items() if k != name}, {k: v for k, v in self.copies.items() if k != name})

    def names(self) -> list[str]:
        return list(self.fields)

    def resolve(self, columns: Sequence[str]) -> dict[str, tuple[Field, str]]:
        """field -> (spec, column) for the columns that exist; patterns take every column they match."""
        out = {}
        for name, spec in self.fields.items():
            if "*" in name or "?" in name:
                out |= {c: (spec, c) for c in columns if fnmatch.fnmatchcase(c, name) and c not in self.fields}
            elif self.copies.get(name, name) in columns:
                out[name] = (spec, self.copies.get(name, name))
        for name, (spec, column) in list(out.items()):
            if spec.spelling:
                out.setdefault(f"spell_{name}", (replace(TEXT(analysis.simple()), stored=False), column))
        return out

    def unique_fields(self) -> list[str]:
        return [n for n, f in self.fields.items() if f.unique]

    def describe(self) -> str:
        return json.dumps({n: {"kind": f.kind, "stored": f.stored, "unique": f.unique, "sortable": f.sortable, "boost": f.boost} for n, f in self.fields.items()})


def merge_schemas(schemas: Sequence[Schema]) -> Schema:
    """All fields of several schemas; a name with two kinds is an error."""
    out: dict[str, Field] = {}
    copies: dict[str, str] = {}
    for s in schemas:
        for name, spec in s.fields.items():
            if name in out and (out[name].kind, out[name].type) != (spec.kind, spec.type):
                raise ValueError(f"field {name!r} is {out[name].kind} and {spec.kind}")
            out.setdefault(name, spec)
        copies |= s.copies
    return Schema(out, copies)


class SchemaClass:
    """Declarative form: fields are class attributes."""

    @classmethod
    def schema(cls) -> Schema:
        found: dict[str, Field] = {}
        for base in reversed(cls.__mro__):
            found |= {n: f for n, f in vars(base).items() if isinstance(f, Field)}
        return Schema(found)


def ensure_schema(schema) -> Schema:
    if isinstance(schema, Schema):
        return schema
    if isinstance(schema, type) and issubclass(schema, SchemaClass):
        return schema.schema()
    if isinstance(schema, Mapping):
        return Schema(schema)
    raise TypeError(f"not a schema: {schema!r}")


def to_boolean(c: Column) -> Column:
    """Fixed words for true and false; null for anything else."""
    text = F.lower(c.cast("string"))
    return F.when(text.isin("t", "true", "yes", "1"), True).when(text.isin("f", "false", "no", "0"), False)

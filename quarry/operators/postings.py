"""Postings: what a document has of each of its terms, counted inside its own row.

Analysis stays in Catalyst: a document's terms are one array. An Arrow function turns a batch of such arrays into postings by
array operations (terms as codes, one sort by document and code, run lengths), so nothing is shuffled and a token never becomes a row of its own. Where a
field asks for characters or boosts, each place has its first and last character in the text and its boost beside its position.

For storing, the postings of a term in a stretch of documents are one row (``packed_of``), with their counts beside them: a row for each posting costs
several times what its values do. ``unpacked`` gives the postings again, and conditions on field and term reach the packed rows.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.schema import Field

POSTINGS = "field string, term string, doc_id long, tf int, weight double, dl int, positions array<int>, starts array<int>, ends array<int>, boosts array<float>"
_INTS, _FLOATS = pa.list_(pa.int32()), pa.list_(pa.float32())
SCHEMA = pa.schema(
    [("field", pa.string()), ("term", pa.string()), ("doc_id", pa.int64()), ("tf", pa.int32()), ("weight", pa.float64()), ("dl", pa.int32()), ("positions", _INTS), ("starts", _INTS), ("ends", _INTS), ("boosts", _FLOATS)]
)
#: Documents whose terms are counted together; for packed rows documents, and terms unless one document has more.
ROWS, STRETCH, TERMS = 512, 8192, 1 << 21

_COUNTS = "field string, term string, df long, cf double, total long, max_weight double, min_length int, max_length int"
_COUNT_TYPES = [("field", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("cf", pa.float64()), ("total", pa.int64()), ("max_weight", pa.float64()), ("min_length", pa.int32()), ("max_length", pa.int32())]
#: How packed rows are stored: numbers as differences, no dictionaries (a stretch has each term and few equal ids).
STORED = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}


def counted(name: str, spec: Field, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Postings of the documents of a batch: doc_id, terms, first, and text, kept and boost where they are there."""
    return _counted(name, spec, batch, False)[0]


def _each(specs: dict[str, tuple[Field, str]]) -> list[str]:
    """What packed rows hold of each posting: characters and boosts only where a field has them."""
    asked = lambda option: any(spec.indexed and spec.options.get(option) for spec, _ in specs.values())
    return ["doc_id", "tf", "weight", "dl", "positions"] + ["starts", "ends"] * asked("characters") + ["boosts"] * asked("boosts")


def packed_schema(specs: dict[str, tuple[Field, str]] | None = None) -> str:
    """Columns of packed rows; without ``specs`` with all that a posting may have."""
    kinds = dict(x.strip().split(" ") for x in POSTINGS.split(","))
    return f"{_COUNTS}, held array<struct<{', '.join(f'{n}: {kinds[n]}' for n in (list(kinds)[2:] if specs is None else _each(specs)))}>>"


def packed(name: str, spec: Field, batch: pa.RecordBatch, each: list[str]) -> pa.RecordBatch:
    """The same postings, a row for each term; a weight that is the frequency is left out."""
    flat, codes = _counted(name, spec, batch, True)
    new = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    over = lambda fold, c: fold.reduceat(flat.column(c).to_numpy(), new) if len(new) else np.zeros(0)
    sizes, total = np.diff(np.r_[new, len(codes)]), np.add.reduceat(flat.column("tf").to_numpy().astype(np.int64), new) if len(new) else np.zeros(0)
    plain = bool((flat.column("weight").to_numpy() == flat.column("tf").to_numpy()).all())
    values = [pa.nulls(len(codes), pa.float64()) if n == "weight" and plain else flat.column(n) for n in each]
    held = pa.ListArray.from_arrays(pa.array(np.r_[new, len(codes)], pa.int32()), pa.StructArray.from_arrays(values, fields=[SCHEMA.field(n) for n in each]))
    columns = [flat.column("field").slice(0, len(new)), flat.column("term").take(pa.array(new)), sizes, over(np.add, "weight"), total, over(np.maximum, "weight"), over(np.minimum, "dl"), over(np.maximum, "dl")]
    counts = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, _COUNT_TYPES)]
    return pa.RecordBatch.from_arrays([*counts, held], names=[*[n for n, _ in _COUNT_TYPES], "held"])


def stretches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in stretches of STRETCH documents at most, and of TERMS terms at most where a document doesn't have more."""
    upto = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(int(np.searchsorted(upto, TERMS + (upto[at - 1] if at else 0), "right")), at + 1)
        end = min(end, at + STRETCH, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def unpacked(rows: DataFrame, *beside: str) -> DataFrame:
    """The postings of packed rows, with columns that stand beside them."""
    there = rows.schema["held"].dataType.elementType.fieldNames()
    kinds = dict(x.strip().split(" ") for x in POSTINGS.split(","))
    each = {n: F.col("__p")[n] if n in there else F.lit(None).cast(kinds[n]) for n in list(kinds)[2:]}
    each["weight"] = F.coalesce(each["weight"], each["tf"].cast("double"))
    return rows.select("field", "term", *beside, F.explode("held").alias("__p")).select("field", "term", *[c.alias(n) for n, c in each.items()], *beside)


def counts_in(rows: DataFrame, *beside: str) -> DataFrame:
    """field, term, doc_id, tf and weight of the postings of packed rows; their positions are not read."""
    p = F.explode(F.arrays_zip(F.col("held.doc_id"), F.col("held.tf"), F.col("held.weight")))
    found = rows.select("field", "term", *beside, p.alias("__p"))
    return found.select("field", "term", *beside, F.col("__p.doc_id").alias("doc_id"), F.col("__p.tf").alias("tf"), F.coalesce("__p.weight", F.col("__p.tf").cast("double")).alias("weight"))


def _counted(name: str, spec: Field, batch: pa.RecordBatch, by_term: bool) -> tuple[pa.RecordBatch, np.ndarray]:
    """Postings of a batch and the codes of their terms, by document and term or the other way round."""
    ids, held = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("terms")
    lengths = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = held.flatten()
    row = np.repeat(np.arange(len(ids)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    first = batch.column("first").to_numpy(zero_copy_only=False).astype(np.int64)
    live = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
    coded = flat.take(pa.array(live)).dictionary_encode() if flat.null_count else flat.dictionary_encode()
    codes, row, place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), row[live], place[live]
    order = np.argsort(codes * max(len(ids), 1) + row if by_term else row * max(len(coded.dictionary), 1) + codes, kind="stable")
    row, codes, at = row[order], codes[order], place[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (codes[1:] != codes[:-1])]) if len(row) else np.zeros(0, np.int64)
    edges = np.r_[new, len(row)]
    tf, doc = np.diff(edges), row[new]
    lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind.value_type))
    none = lambda kind: pa.nulls(len(new), kind)
    starts, ends, boosts = none(_INTS), none(_INTS), none(_FLOATS)
    weight = tf.astype(np.float64) * spec.boost
    if "text" in batch.schema.names:
        spans, factors = placed(spec, batch, lengths)
        spans = spans[live][order]
        if spec.options.get("characters"):
            starts, ends = lists(spans[:, 0], _INTS), lists(spans[:, 1], _INTS)
        if spec.options.get("boosts"):
            factors = factors[live][order]
            boosts, weight = lists(factors, _FLOATS), np.add.reduceat(factors, new) * spec.boost if len(new) else weight
    if "boost" in batch.schema.names:
        weight = weight * batch.column("boost").to_numpy(zero_copy_only=False)[doc]
    if spec.kind in ("id", "idlist") or spec.options.get("existence"):
        weight = np.full(len(new), float(spec.boost))
    positions = lists(first[row] + at, _INTS) if spec.positions else none(_INTS)
    columns = [pa.array([name] * len(new), pa.string()), coded.dictionary.take(pa.array(codes[new])), ids[doc], tf, weight, lengths[doc], positions, starts, ends, boosts]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, SCHEMA.types)], schema=SCHEMA), codes[new]


def placed(spec: Field, batch: pa.RecordBatch, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start, end and boost of each kept term of the batch, from the tokenizer's places in the texts."""
    find, mark = spec.analyzer.stages[0].spans, spec.options.get("boosts")
    texts = [text or "" for text in batch.column("text").to_pylist()]
    pairs = lambda x: x if isinstance(x, np.ndarray) else np.fromiter(itertools.chain.from_iterable(x), np.int64).reshape(-1, 2)
    found = [pairs(find(text)) for text in texts]
    sizes = np.array([len(x) for x in found], np.int64)
    spans, row = np.concatenate([np.zeros((0, 2), np.int64), *found]), np.repeat(np.arange(len(texts)), sizes)
    if "kept" in batch.schema.names:
        kept = batch.column("kept")
        if (pc.fill_null(pc.list_value_length(kept), 0).to_numpy(zero_copy_only=False) != sizes).any():
            raise ValueError("the words of a text and those found in it differ")
        mask = kept.flatten().to_numpy(zero_copy_only=False).astype(bool)
        spans, row = spans[mask], row[mask]
    there = np.bincount(row, minlength=len(texts))
    if (there != lengths).any():
        at = int(np.flatnonzero(there != lengths)[0])
        raise ValueError(f"analysis makes {lengths[at]} terms of {there[at]} words, so they have no places in the text")
    factors = [_number(texts[r][a:b].partition(mark)[2]) for r, (a, b) in zip(row.tolist(), spans.tolist())] if mark else []
    return spans, np.array(factors)


def _number(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        return 1.0


def postings_of(docs: DataFrame, specs: dict[str, tuple[Field, str]], boost: Column | None = None) -> DataFrame:
    """Postings of the indexed fields of ``docs`` (doc_id and the fields' columns). ``boost`` is a document's."""
    return _indexed(docs, specs, boost, lambda batch: (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)), counted, POSTINGS)


def packed_of(docs: DataFrame, specs: dict[str, tuple[Field, str]], boost: Column | None = None) -> DataFrame:
    """The same postings packed: a row for each field, term and stretch of documents, with its counts."""
    each = _each(specs)
    return _indexed(docs, specs, boost, stretches, lambda name, spec, batch: packed(name, spec, batch, each), packed_schema(specs))


def _indexed(docs: DataFrame, specs: dict[str, tuple[Field, str]], boost: Column | None, cut, count, schema: str) -> DataFrame:
    frames = []
    for name, (spec, column) in specs.items():
        if not spec.indexed:
            continue
        values = F.col(f"`{column}`")
        is_array, analyzer = dict(docs.dtypes)[column].startswith("array"), spec.analyzer
        text = values.cast("string")
        rows = docs.where(values.isNotNull()).select(F.col("doc_id").cast("long"), *([boost.cast("double").alias("boost")] if boost is not None else []), (values.cast("array<string>") if is_array else text).alias("text"))
        places = bool(spec.options.get("characters") or spec.options.get("boosts"))
        if is_array:
            if places:
                raise ValueError(f"{name}: terms of a list have no places in a text")
            rows = rows.withColumnRenamed("text", "terms").withColumn("first", F.lit(0))
        else:
            rows = _analysed(rows, spec, analyzer, places)
        rows = rows if places else rows.drop("text")

        def run(batches: Iterator[pa.RecordBatch], name=name, spec=spec) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in cut(batch):
                    yield count(name, spec, some)
            pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

        frames.append(rows.mapInArrow(run, schema))
    if not frames:
        return docs.sparkSession.createDataFrame([], schema)
    return functools.reduce(DataFrame.unionAll, frames)


def _analysed(rows: DataFrame, spec: Field, analyzer, places: bool) -> DataFrame:
    """``rows`` with the terms of their text, the position of the first, and which words are kept where places are asked for."""
    if places and analyzer.stages[0].spans is None:
        raise ValueError("this tokenizer does not tell where its words are")
    steps = analyzer.split() if spec.positions or places else None
    if steps is None:
        first = analyzer.first_position(F.col("text")) if spec.positions else F.lit(0)
        return rows.withColumns({"terms": analyzer.terms(F.col("text")), "first": first})
    # the raw terms once; the first kept term stands where they hold it first
    rows = rows.withColumn("raw", steps[0](F.col("text")))
    if places:
        rows = rows.withColumn("kept", F.transform("raw", analyzer.keeps()))
    rows = rows.withColumn("terms", steps[1](F.col("raw")))
    first = F.greatest(F.array_position("raw", F.get("terms", F.lit(0))) - 1, F.lit(0)).cast("int")
    return rows.withColumn("first", F.coalesce(first, F.lit(0))).drop("raw").withColumn("terms", steps[2](F.col("terms")))

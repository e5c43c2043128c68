"""Vector search and fusion with text scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.index import ranked


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def search(vectors: DataFrame, query: Sequence[float], k: int = 10, id_column: str = "doc_id", column: str = "embedding", among: DataFrame | None = None, metric: str = "cosine") -> DataFrame:
    """The k nearest vectors by cosine, inner product or (negative) distance; ``among`` limits the ids."""
    rows = vectors if among is None else vectors.join(among.select(id_column), id_column, "left_semi")
    q = F.array(*[F.lit(float(x)) for x in query])
    c = F.col(column)
    score = {"cosine": lambda: cosine(c, q), "ip": lambda: dot(c, q), "l2": lambda: -F.sqrt(F.aggregate(F.zip_with(c, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))}[metric]()
    return rows.select(id_column, score.alias("score")).where(F.col("score").isNotNull()).orderBy(F.desc("score"), id_column).limit(k)


def _blocks(rows: DataFrame, id_column: str, column: str, size: int, name: str) -> DataFrame:
    """Rows packed into blocks of about ``size``, dealt by a hash: array<struct<id, v>> in one column."""
    parts = max(1, -(-rows.count() // size))
    return rows.groupBy(F.pmod(F.xxhash64(id_column), F.lit(parts)).alias("__b")).agg(F.collect_list(F.struct(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("v"))).alias(name)).drop("__b")


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "doc_id", query_id: str = "query_id", column: str = "embedding", block: int = 4096) -> DataFrame:
    """The k most similar vectors of every query: every block of queries meets every block of vectors in one matrix product.

    Both sides are packed on the executors, so neither is limited nor collected; a block pair yields k rows a query, and ranks merge them.
    Similarities are rounded to 12 digits, so that copies tie; vectors that are zero or hold null or non-finite numbers take no part.
    """
    packed = _blocks(vectors.where(F.col(column).isNotNull()), id_column, column, block, "held")
    asked = _blocks(queries.where(F.col(column).isNotNull()), query_id, column, max(1, block // 4), "asked")

    def unit(rows: pa.Array) -> tuple[pa.Array, np.ndarray]:
        ids, v = rows.field("id"), rows.field("v")
        sizes = np.diff(v.offsets.to_numpy())
        if len(set(sizes.tolist())) != 1:
            raise ValueError("vectors of different lengths")
        m = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        n = np.linalg.norm(m, axis=1)
        fine = np.isfinite(n) & (n > 0)
        return ids.filter(pa.array(fine)), m[fine] / n[fine, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (ids, m), (asking, q) = (unit(batch.column(name)[row].values) for name in ("held", "asked"))
                if not len(ids) or not len(asking):
                    continue
                scores = q @ m.T
                least = np.partition(scores, -k, axis=1)[:, -k, None] if len(ids) > k else -2.0
                name, at = np.nonzero(scores >= least - 2e-12)
                score = np.round(scores[name, at], 12)
                place = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)[at]
                order = np.lexsort((place, -score, name))
                name, at, score = name[order], at[order], score[order]
                kept = np.arange(len(name)) - np.searchsorted(name, name) < k
                columns = [asking.take(pa.array(name[kept])), ids.take(pa.array(at[kept])), pa.array(score[kept])]
                yield pa.RecordBatch.from_arrays(columns, names=[query_id, id_column, "score"])

    kinds = dict(vectors.dtypes)
    found = packed.crossJoin(asked).mapInArrow(run, f"{query_id} {dict(queries.dtypes)[query_id]}, {id_column} {kinds[id_column]}, score double")
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), id_column)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_rows(vectors: DataFrame, doc_id: int, k: int = 10, id_column: str = "doc_id", column: str = "embedding") -> DataFrame:
    """Nearest rows to a stored vector, without itself."""
    probe = vectors.where(F.col(id_column) == doc_id).select(F.col(column).alias("__q"))
    rows = vectors.where(F.col(id_column) != doc_id).join(F.broadcast(probe.limit(1)), F.lit(True))
    return rows.select(id_column, cosine(F.col(column), F.col("__q")).alias("score")).where("score is not null").orderBy(F.desc("score"), id_column).limit(k)


def fuse(parts: Sequence[DataFrame], weights: Sequence[float] | None = None, k: int = 10, method: str = "rrf", constant: int = 60) -> DataFrame:
    """Several rankings (doc_id, score) as one: reciprocal ranks, or weighted scores."""
    rows = None
    for n, part in enumerate(parts):
        w = (weights or [1.0] * len(parts))[n]
        if method == "rrf":
            placed = ranked(part.select("doc_id", "score"), "__rank", F.desc("score"), "doc_id")
            value = placed.select("doc_id", (w / (constant + F.col("__rank"))).alias("score"))
        else:
            value = part.select("doc_id", (F.col("score") * w).alias("score"))
        rows = value if rows is None else rows.unionAll(value)
    return rows.groupBy("doc_id").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def embed(docs: DataFrame, column: str, model: Callable[[], Callable[[list[str]], list[list[float]]]], out: str = "embedding", prefix: str = "", on_error: str = "fail") -> DataFrame:
    """``docs`` with an embedding of a text column. ``model()`` is made once per task and called on batches.

    A batch that fails ends the job; with on_error="null" its texts are tried one by one, and those that fail have none.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for texts in batches:
            asked = [prefix + (t or "") for t in texts]
            try:
                found = encode(asked)
            except Exception:
                if on_error != "null":
                    raise
                found = []
                for t in asked:
                    try:
                        found += encode([t])
                    except Exception:
                        found.append(None)
            yield pd.Series(found, index=texts.index)

    return docs.withColumn(out, run(F.col(column)))


def onnx_model(path: str, tokenizer: str, pooling: str = "mean", normalize: bool = True) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """An ONNX encoder with a tokenizers file, for ``embed``."""

    def make():
        import onnxruntime
        from tokenizers import Tokenizer

        session, coder = onnxruntime.InferenceSession(path), Tokenizer.from_file(tokenizer)
        coder.enable_padding()
        names = {i.name for i in session.get_inputs()}

        def encode(texts: list[str]) -> list[list[float]]:
            got = coder.encode_batch(texts)
            mask = np.array([g.attention_mask for g in got], np.int64)
            feed = {"input_ids": np.array([g.ids for g in got], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
            states = session.run(None, {k: v for k, v in feed.items() if k in names})[0]
            m = mask[..., None]
            out = states[:, 0] if pooling == "cls" else np.where(m > 0, states, -np.inf).max(1) if pooling == "max" else (states * m).sum(1) / np.maximum(m.sum(1), 1)
            if normalize:
                out = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            return out.astype(float).tolist()

        return encode

    return make


def approximate(vectors: DataFrame, column: str = "embedding", tables: int = 4, width: float = 2.0):
    """A fitted LSH model for approximate distance search (``approxNearestNeighbors``) and its vectors."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    data = vectors.withColumn("__v", array_to_vector(F.col(column)))
    return BucketedRandomProjectionLSH(inputCol="__v", outputCol="__h", numHashTables=tables, bucketLength=width, seed=7).fit(data), data

"""Approximate vector search over navigable graphs of neighbour lists.

Building. Vectors are dealt by a hash of their id into parts of about PART. A part is one graph: its distinct vectors are nodes, a node's links are
its ``near`` nearest nodes of the part (exact, by blocks of a matrix product) and its best followers (nodes that list it). Copies of a vector are
one node: a copy is linked with the node and stands for it in answers, so a large group of copies neither fills the lists around it nor shuts a search in.

Searching. Every query meets every part, in cells of a part and a slice of the queries. In a cell a query starts at its nearest landmarks (a sample of the
part's nodes); in each step the neighbours of what is new in its beam are scored and the beam keeps the best. It ends when no beam changes,
or after ``steps``. Only vectors of parts and queries and the best answers of a cell move between tasks, a vector once for each cell, never once for each pair
or step. Work is queries by parts; a part's share of the answers is found as well in a large table as in a small one.

Every vector is indexed: it is a row of a part with links, whatever the sample. Answers are approximate; ``recall`` measures them against exact ones. Cosine similarity.

Vectors that are null, zero or hold null or non-finite numbers take no part; vectors of different lengths are an error.
Of rows with one id the smallest vector is indexed.

``VectorGraph.lists`` gives neighbour lists over a whole table, not parts: first lists come from the cells of the nearest landmarks (cells of more than CELL
vectors are split by a hash), then improve in rounds of a neighbour join: at each pivot its neighbours, and its best followers, meet in one small matrix product, and
a pair that is better than the worst of either's list is offered to it. A pivot has at most 1 + near + followers members, so no group grows with the data, and a hub's
followers are ranked with a limit before they move. Vectors move once for each pivot and round there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.index import shared_path

#: Landmarks at most (of a part, or of a table where they are held by every task), cells of a vector, and vectors of a cell's part.
LANDMARKS, CELLS, CELL = 4096, 2, 1024
#: Vectors of a part's graph, queries of a slice, queries that go together in a task, and rows of a block of the product.
PART, SLICE, TOGETHER, BLOCK = 32_768, 16_384, 64, 128
_PAIR = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("score", pa.float32())])


def _written(df: DataFrame, tag: str) -> DataFrame:
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _matrix(column: pa.Array) -> np.ndarray:
    sizes = pc.min_max(pc.list_value_length(column)).as_py()
    if sizes["min"] != sizes["max"]:
        raise ValueError("vectors of different lengths")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def units(rows: DataFrame, id_column: str, column: str, id_name: str = "id") -> DataFrame:
    """id and v, of length 1, of the vectors that take part."""
    x = F.transform(F.col(column), lambda a: a.cast("double"))
    fine = F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf"))))
    kept = rows.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias(id_name), x.alias("x")).where(F.coalesce(fine, F.lit(False)))
    kept = kept.select(id_name, "x", F.array_max(F.transform("x", lambda a: F.abs(a))).alias("__m")).where("__m > 0")  # so that no square is too large
    kept = kept.select(id_name, F.transform("x", lambda a: a / F.col("__m")).alias("x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, a: s + a * a))
    return kept.withColumn("__n", length).select(id_name, F.transform("x", lambda a: (a / F.col("__n")).cast("float")).alias("v"))


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """id and ``near``, the k best of its pairs, best first (ties: smaller ids)."""
    once = pairs.repartition("id").groupBy("id", "near").agg(F.max("score").alias("score"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "near")
    ranked = once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "near", "score"))).alias("near")).select("id", F.transform("near", lambda x: F.struct(x["near"].alias("id"), x["score"].alias("score"))).alias("near"))


def _nearest(marks: np.ndarray, count: int):
    """A mapInArrow function: id (or query), v and the numbers of its nearest landmarks with their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                scores = _matrix(some.column("v")) @ marks.T
                top = np.argsort(-scores, axis=1, kind="stable")[:, :count]
                rows = np.repeat(np.arange(some.num_rows), top.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(rows)), some.column("v").take(pa.array(rows)), pa.array(top.ravel(), pa.int32()), pa.array(scores[rows, top.ravel()], pa.float32())], names=["id", "v", "cell", "score"]
                )

    return run


def _in_cell(table: pa.Table, k: int) -> pa.Table:
    """The k best of each row among the rows of its cell."""
    ids, v = table.column("id").to_numpy(), _matrix(table.column("v").combine_chunks())
    scores = v @ v.T
    np.fill_diagonal(scores, -np.inf)
    n = min(k, len(ids) - 1)
    if n < 1:
        return _PAIR.empty_table()
    top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    rows = np.repeat(np.arange(len(ids)), n)
    return pa.Table.from_arrays([pa.array(ids[rows]), pa.array(ids[top.ravel()]), pa.array(scores[rows, top.ravel()].astype(np.float32))], schema=_PAIR)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of members of a pivot that beat the worst of the first one's list; rows come by pivot."""
    left: pa.Table | None = None

    def offers(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        pivot, ids, floor = (table.column(c).to_numpy() for c in ("pivot", "id", "floor"))
        v = _matrix(table.column("v").combine_chunks())
        edges = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1], True])
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            scores = v[a:b] @ v[a:b].T
            i, j = np.nonzero((scores > floor[a:b, None]) & (ids[a:b, None] != ids[a:b]))
            out.append((ids[a + i], ids[a + j], scores[i, j]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PAIR.types)], schema=_PAIR)

    for batch in batches:
        table = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        pivot = table.column("pivot").to_numpy()
        whole = int(np.searchsorted(pivot, pivot[-1], "left")) if (np.diff(pivot) >= 0).all() else int(np.flatnonzero(pivot != pivot[-1])[-1] + 1)
        if whole:
            yield offers(table.slice(0, whole))
        left = table.slice(whole)
    if left is not None and left.num_rows:
        yield offers(left)


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The place of each row among those of its key; keys are sorted."""
    return np.arange(len(keys)) - np.searchsorted(keys, keys)


def _nearest_nodes(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, near, score: the k best others of each row of ``v``, best first.

    The maxima of groups of columns give a score that k of a row reach, so few of its scores are sorted.
    """
    n, out = len(v), []
    groups = max(2 * k, 256)
    width = n // groups
    for at in range(0, n, BLOCK):
        scores = v[at : at + BLOCK] @ v.T
        own = np.arange(len(scores))
        scores[own, at + own] = -np.inf
        least = np.full(len(scores), -2.0, np.float32)
        if width > 1:
            least = np.partition(scores[:, : groups * width].reshape(len(scores), groups, width).max(2), groups - k, axis=1)[:, groups - k]
        i, j = np.nonzero(scores >= least[:, None])
        x = scores[i, j]
        order = np.lexsort(((j - i - at) % n, -x, i))
        i, j, x = i[order], j[order], x[order]
        kept = _ranks(i) < k
        out.append((i[kept] + at, j[kept], x[kept]))
    return tuple(np.concatenate(c) for c in zip(*out))


_LINKED = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("v", pa.list_(pa.float32())), ("same", pa.int64()), ("near", pa.list_(pa.int64()))])


def _linked(table: pa.Table, near: int, followers: int) -> pa.Table:
    """The rows of a part with ``same``, the smallest id of equal vectors (the node), and their links."""
    table = table.combine_chunks().sort_by("id")
    ids, v = table.column("id").to_numpy(), _matrix(table.column("v").chunk(0))
    _, nodes, of = np.unique(np.ascontiguousarray(v + 0.0).view(f"V{v.shape[1] * 4}").ravel(), return_index=True, return_inverse=True)  # first rows of equal ones; -0.0 is 0.0
    n, k = len(nodes), min(near, len(nodes) - 1)
    a = b = np.zeros(0, np.int64)
    if k > 0:
        i, j, x = _nearest_nodes(v[nodes], k)
        order = np.lexsort((i, -x, j))
        listed, by = j[order], i[order]
        kept = _ranks(listed) < followers
        a, b = np.divmod(np.unique(np.r_[i * n + j, listed[kept] * n + by[kept]]), n)
    # a copy has its node as its link; a node that has nothing else has its first copy
    copies = np.flatnonzero(nodes[of] != np.arange(len(ids)))
    alone = copies[np.unique(of[copies], return_index=True)[1]] if n == 1 else copies[:0]
    row, to = np.r_[nodes[a], copies, nodes[of[alone]]], np.r_[nodes[b], nodes[of[copies]], alone]
    order = np.lexsort((to, row))
    offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(ids)))]
    links = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[to[order]], pa.int64()))
    return pa.Table.from_arrays([table.column("part").chunk(0), table.column("id").chunk(0), table.column("v").chunk(0), pa.array(ids[nodes[of]]), links], schema=_LINKED)


def _beam(v: np.ndarray, offsets: np.ndarray, links: np.ndarray, marks: np.ndarray, q: np.ndarray, beam: int, starts: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their scores that the beams of some queries end with, a row each; -inf where there are fewer."""
    n, rows, count = len(v), np.arange(len(q))[:, None], min(starts, len(marks))
    scores = q @ v[marks].T
    first = np.argpartition(-scores, count - 1, axis=1)[:, :count]
    ids, scores = marks[first], np.take_along_axis(scores, first, 1)
    fresh = np.ones(ids.shape, bool)
    seen, stamp = np.zeros(len(q) * n, bool), np.empty(len(q) * n, np.int32)
    seen[(rows * n + ids).ravel()] = True
    for _ in range(steps):
        asker, at = np.nonzero(fresh)
        if not len(asker):
            break
        node = ids[asker, at]
        sizes = offsets[node + 1] - offsets[node]
        place = np.arange(sizes.sum()) + np.repeat(offsets[node] - (np.cumsum(sizes) - sizes), sizes)
        asker, new = np.repeat(asker, sizes), links[place]
        key = asker * n + new
        unseen = np.flatnonzero(~seen[key])
        stamp[key[unseen]] = unseen
        unseen = unseen[stamp[key[unseen]] == unseen]  # each node once for each query
        asker, new = asker[unseen], new[unseen]
        seen[key[unseen]] = True
        edges = np.searchsorted(asker, np.arange(len(q) + 1)).tolist()
        got = np.concatenate([v[new[a:b]] @ one for a, b, one in zip(edges[:-1], edges[1:], q)])
        worst = scores.min(1) if scores.shape[1] >= beam else np.full(len(q), -np.inf)
        better = got > worst[asker]
        asker, new, got = asker[better], new[better], got[better]
        more = int(np.bincount(asker, minlength=1).max())
        held = scores.shape[1]
        wide = lambda old, none: np.concatenate([old, np.full((len(q), more), none, old.dtype)], 1)
        ids, scores, fresh, column = wide(ids, 0), wide(scores, -np.inf), wide(np.zeros_like(fresh), False), held + _ranks(asker)
        ids[asker, column], scores[asker, column], fresh[asker, column] = new, got, True
        if scores.shape[1] > beam:
            kept = np.argpartition(-scores, beam - 1, axis=1)[:, :beam]
            ids, scores, fresh = (np.take_along_axis(x, kept, 1) for x in (ids, scores, fresh))
    return ids, scores


_FOUND = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float32())])


def _found(part: pa.Table, asked: pa.Table, landmarks: int | None, k: int, beam: int, starts: int, steps: int) -> pa.Table:
    """The k best rows of a part that each of the queries of a slice finds."""
    if not part.num_rows or not asked.num_rows:
        return _FOUND.empty_table()
    part = part.combine_chunks().sort_by([("same", "ascending"), ("id", "ascending")])
    ids, same, near = part.column("id").to_numpy(), part.column("same").to_numpy(), part.column("near").combine_chunks()
    heads = np.flatnonzero(ids == same)  # a node's rows follow each other, itself first
    nodes, copies = ids[heads], np.diff(np.r_[heads, len(ids)])
    v = _matrix(part.column("v").combine_chunks().take(pa.array(heads)))
    near = near.take(pa.array(heads))
    flat, owner = near.flatten().to_numpy(), np.repeat(np.arange(len(heads)), pc.list_value_length(near).to_numpy())
    to = np.minimum(np.searchsorted(nodes, flat), len(nodes) - 1)
    owner, to = owner[nodes[to] == flat], to[nodes[to] == flat]
    offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(nodes)))]
    count = min(LANDMARKS, len(nodes), max(landmarks or math.ceil(4 * math.sqrt(len(nodes))), 1))
    marks = np.sort(np.random.default_rng(len(nodes)).permutation(len(nodes))[:count])
    names, q = asked.column("query").to_numpy(), _matrix(asked.column("v").combine_chunks())
    out = []
    for at in range(0, len(q), TOGETHER):
        got, scores = _beam(v, offsets, to, marks, q[at : at + TOGETHER], max(beam, k), starts, steps)
        some = min(k, got.shape[1])
        best = np.argpartition(-scores, some - 1, axis=1)[:, :some]
        asker = np.repeat(np.arange(len(got)), some)
        node, score = np.take_along_axis(got, best, 1).ravel(), np.take_along_axis(scores, best, 1).ravel()
        asker, node, score = (x[score > -np.inf] for x in (asker, node, score))
        times = np.minimum(copies[node], k)
        row = np.repeat(heads[node] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        asker, score = np.repeat(asker, times), np.repeat(score, times)
        order = np.lexsort((ids[row], -score, asker))
        order = order[_ranks(asker[order]) < k]
        out.append(pa.Table.from_arrays([pa.array(names[at + asker[order]]), pa.array(ids[row[order]]), pa.array(score[order], pa.float32())], schema=_FOUND))
    return pa.concat_tables(out)


class VectorGraph:
    """``nodes`` (id, v of length 1), ``links`` (id, near), both of ``rows``: a table of parts with v, same and near. ``landmarks`` are of a part."""

    def __init__(self, rows: DataFrame, landmarks: int | None = None):
        self.rows, self.landmarks = rows, landmarks
        self.nodes, self.links = rows.select("id", "v"), rows.select("id", "near")

    @classmethod
    def build(cls, vectors: DataFrame, id_column: str = "doc_id", column: str = "embedding", near: int = 24, followers: int = 24, landmarks: int | None = None, path: str | None = None, part: int = PART) -> VectorGraph:
        """The graph of all vectors; its table is under ``path``, or in the shared folder."""
        spark = vectors.sparkSession
        base = path or shared_path(spark, "graph")
        nodes = _written(units(vectors, id_column, column).groupBy("id").agg(F.min("v").alias("v")), "nodes")
        parts = max(1, -(-nodes.count() // part))
        dealt = nodes.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "v").repartition(4 * parts, "part")
        dealt.groupBy("part").applyInArrow(lambda t: _linked(t, near, followers), "part int, id long, v array<float>, same long, near array<long>").write.parquet(f"{base}/rows")
        return cls.open(spark, base, landmarks)

    @classmethod
    def open(cls, spark: SparkSession, path: str, landmarks: int | None = None) -> VectorGraph:
        return cls(spark.read.schema("part int, id long, v array<float>, same long, near array<long>").parquet(f"{path}/rows"), landmarks)

    @classmethod
    def lists(cls, nodes: DataFrame, near: int = 24, followers: int = 24, rounds: int = 4, landmarks: int | None = None) -> DataFrame:
        """id and near (id, score), best first: about the nearest of all ``nodes`` (id, v of length 1)."""
        n = nodes.count()
        if not n:
            return nodes.sparkSession.createDataFrame([], "id long, near array<struct<id: long, score: float>>")
        count = min(LANDMARKS, landmarks or math.ceil(4 * math.sqrt(n)))
        marks = nodes.orderBy(F.xxhash64("id"), "id").limit(max(count, 1)).collect()  # at most LANDMARKS
        lists = _written(_best(cls._first(nodes, np.array([r["v"] for r in marks], np.float32), near), near), "lists")
        for _ in range(rounds):
            lists = _written(cls._improved(nodes, lists, near, followers), "lists")
        return lists

    @staticmethod
    def _first(nodes: DataFrame, points: np.ndarray, near: int) -> DataFrame:
        """Neighbours inside the cells of each vector."""
        placed = nodes.mapInArrow(_nearest(points, CELLS), "id long, v array<float>, cell int, score float").drop("score")
        parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(CELL))).cast("int").alias("parts"))
        dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id", "cell"), F.col("parts")))  # a row for each landmark
        return dealt.select("cell", "part", "id", "v").groupBy("cell", "part").applyInArrow(lambda t: _in_cell(t.select(["id", "v"]), near), "id long, near long, score float")

    @staticmethod
    def _followers(lists: DataFrame, followers: int) -> DataFrame:
        """pivot and id: the best of those that list each vector."""
        edges = lists.select("id", F.explode("near").alias("x")).select(F.col("x.id").alias("pivot"), "id", F.col("x.score").alias("score"))
        order = Window.partitionBy("pivot").orderBy(F.desc("score"), "id")
        return edges.withColumn("r", F.row_number().over(order)).where(F.col("r") <= followers).select("pivot", "id")

    @classmethod
    def _improved(cls, nodes: DataFrame, lists: DataFrame, near: int, followers: int) -> DataFrame:
        """The lists after one neighbour join."""
        floor = F.when(F.size("near") >= near, F.element_at("near", -1)["score"]).otherwise(F.lit(-2.0)).cast("float")
        state = nodes.join(lists.select("id", floor.alias("floor")), "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0).cast("float")))
        members = lists.select(F.col("id").alias("pivot"), F.explode(F.array_append(F.transform("near", lambda x: x["id"]), F.col("id"))).alias("id"))
        members = members.unionByName(cls._followers(lists, followers)).distinct()
        rows = members.join(state, "id").select("pivot", "id", "floor", "v").repartition("pivot").sortWithinPartitions("pivot")
        offers = rows.mapInArrow(_joined, "id long, near long, score float")
        kept = lists.select("id", F.explode("near").alias("x")).select("id", F.col("x.id").alias("near"), F.col("x.score").alias("score"))
        return _best(kept.unionByName(offers), near)

    def search(self, queries: DataFrame, k: int = 10, query_id: str = "query_id", column: str = "embedding", beam: int = 256, starts: int = 32, steps: int = 12) -> DataFrame:
        """query id, rank, id, score: about the k most similar vectors of every query. ``beam``, ``starts`` and ``steps`` are of a part."""
        asked = _written(units(queries, query_id, column, "query").groupBy("query").agg(F.min("v").alias("v")), "asked")
        parts = (self.rows.agg(F.max("part")).first()[0] or 0) + 1
        slices = max(-(-2 * asked.sparkSession.sparkContext.defaultParallelism // parts), -(-asked.count() // SLICE))
        cells, landmarks = 4 * parts * slices, self.landmarks
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = self.rows.withColumn("slice", upto(slices)).repartition(cells, "part", "slice")
        right = asked.withColumn("slice", F.pmod(F.xxhash64("query"), F.lit(slices)).cast("int")).withColumn("part", upto(parts)).repartition(cells, "part", "slice")
        met = left.groupBy("part", "slice").cogroup(right.groupBy("part", "slice")).applyInArrow(lambda a, b: _found(a, b, landmarks, k, beam, starts, steps), "query long, id long, score float")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select(F.col("query").alias(query_id), "rank", "id", F.col("score").cast("double").alias("score"))


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", score: str = "score", slack: float = 1e-5) -> DataFrame:
    """recall, asked: the share of the exact answers that are found; an answer as similar as the worst exact one counts (ties)."""
    worst = exact.groupBy(query_id).agg(F.min(score).alias("__worst"), F.count(F.lit(1)).alias("__n"))
    hits = found.join(worst, query_id).groupBy(query_id).agg(F.count_if(F.col(score) >= F.col("__worst") - slack).alias("__hit"))
    per = worst.join(hits, query_id, "left").select("__n", F.least(F.coalesce("__hit", F.lit(0)), F.col("__n")).alias("__hit"))
    return per.agg((F.sum("__hit") / F.sum("__n")).alias("recall"), F.count(F.lit(1)).alias("asked"))


__all__ = ["VectorGraph", "recall", "units"]

"""Exact top-k by integer inner product: exhaustive term-at-a-time accumulation.

Vectors are rows of integer weights, one term per dimension, packed in units in the smallest type that holds them. Units of
candidates are dealt over parts, units of queries over groups, and each (part, group) pair is a cell, one task's work: the cell's queries
come first and stay in memory, its candidates stream past in blocks. For a block and a tile of queries, the posting list of each term
in turn is added, weighted, to a dense array of scores; a partition selects the rows that can be among the k best, which are kept across
blocks; the k best of all cells are merged by rank. A unit is copied once for each group (candidates) or part (queries). The number of
cells follows from the work, WORK multiplications each, and from the cluster's cores, so a task's time does not grow with the table until there
are as many cells as Spark schedules well; copies grow with the square root of the number of cells. Memory is bounded
by GROUP, TILE and AHEAD; nothing is broadcast or collected.

Defined cases: vectors that are null, hold null or non-finite components, or have a null id take no
part; vectors of different lengths share the leading dimensions (missing ones are zero); rows with a
query's own id are never its candidates; of several query rows with one id the smallest vector
(array order) is the query; other repeated rows are candidates each; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows

#: Rows of a unit, of a block, of a tile and of the blocks seen at once; weights of a group.
UNIT, BLOCK, TILE, AHEAD, GROUP = 1024, 4096, 32, 16384, 1 << 24
#: Multiplications of a cell (about a minute's), and the fewest and most cells of (part, group) that a table is dealt to.
WORK, FEWEST, MOST = 1 << 37, 64, 100_000


def weights(vectors: DataFrame, scale: int = 256, *extra: str) -> DataFrame:
    """vec_id, the ``extra`` columns and integer weights floor(scale * x) of every vector that takes part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.select("vec_id", "embedding", *extra).where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long"), *extra, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("weights"))


def narrow(values: np.ndarray) -> np.ndarray:
    """``values`` in the smallest integer type of at least two bytes that holds them."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    return values.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max), copy=False)


def packed(rows: DataFrame, *extra: str) -> DataFrame:
    """ids, lengths, values, width: units of at most UNIT rows as they lie, and ``unit``, which numbers them in turn from each partition on.

    ``extra`` columns of longs, or of lists of equally many longs, go along.
    """
    schema = pa.schema([("ids", pa.binary()), ("lengths", pa.binary()), ("values", pa.binary()), ("width", pa.int32()), *((name, pa.binary()) for name in extra)])

    def pack(batch: pa.RecordBatch) -> list:
        ids, held = batch.column("vec_id").to_numpy(), batch.column("weights")
        values = narrow(held.flatten().to_numpy(zero_copy_only=False))
        lengths = pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int32)
        more = [batch.column(name) for name in extra]
        more = [c.flatten() if pa.types.is_list(c.type) else c for c in more]
        return [[ids.tobytes()], [lengths.tobytes()], [values.tobytes()], [values.itemsize], *([c.to_numpy(zero_copy_only=False).tobytes()] for c in more)]

    units = rows.mapInArrow(arrow_rows(schema, pack, UNIT), ", ".join(["ids binary, lengths binary, values binary, width int", *(f"{name} binary" for name in extra)]))
    at = F.monotonically_increasing_id()
    return units.withColumn("unit", F.shiftright(at, 33) + at.bitwiseAND(F.lit((1 << 33) - 1)))


Rows = tuple[np.ndarray, ...]  # ids, lengths, values one row after another, and extra columns


def unpacked(row: dict, *extra: str) -> Rows:
    more = (np.frombuffer(row[name] or b"", np.int64) for name in extra)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int32).astype(np.int64), np.frombuffer(row["values"], f"i{row['width']}"), *more


def together(units: list[Rows]) -> Rows:
    return tuple(np.concatenate(c) for c in zip(*units))


def ascending(rows: Rows) -> Rows:
    """The rows by ascending id."""
    ids, lengths, values = rows
    order = np.argsort(ids, kind="stable")
    starts, taken = (np.cumsum(lengths) - lengths)[order], lengths[order]
    at = np.arange(len(values)) + np.repeat(starts - (np.cumsum(taken) - taken), taken)
    return ids[order], taken, values[at]


def largest_norm(lengths: np.ndarray, values: np.ndarray) -> float:
    squares = np.bincount(np.repeat(np.arange(len(lengths)), lengths), values.astype(np.float64) ** 2, len(lengths))
    return math.sqrt(squares.max(initial=0.0))


def postings(lengths: np.ndarray, values: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (rows, weights) of the nonzero weights, rows ascending."""
    terms = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    live = values != 0
    terms, rows, values = terms[live], rows[live], values[live]
    order = np.argsort(terms, kind="stable")
    terms, rows, values = terms[order], rows[order], values[order]
    edges = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1], True]) if len(terms) else np.zeros(1, int)
    return {int(terms[a]): (rows[a:b], values[a:b]) for a, b in zip(edges[:-1], edges[1:])}


def laid_out(lists: dict, n: int, kind: type) -> dict:
    """``lists`` in ``kind``; a posting list of more than a quarter of the ``n`` rows is laid out over all of them (rows: None)."""
    out = {}
    for term, (rows, weight) in lists.items():
        if 4 * len(rows) > n:
            whole = np.zeros(n, kind)
            whole[rows] = weight
            out[term] = None, whole
        else:
            out[term] = rows, weight.astype(kind)
    return out


def accumulate(scores: np.ndarray, spare: np.ndarray, tile: dict, lists: dict) -> None:
    """Adds the postings of each term in turn to ``scores`` (queries by rows of the block), weighted by the tile's weights of the term."""
    for term, (asked, factor) in tile.items():
        if term not in lists:
            continue
        rows, weight = lists[term]
        if asked is None and rows is None:
            np.multiply(factor[:, None], weight, out=spare)
            np.add(scores, spare, out=scores)
        elif asked is None:
            scores[:, rows] += factor[:, None] * weight
        elif rows is None:
            scores[asked] += factor[:, None] * weight
        else:
            scores[asked[:, None], rows] += factor[:, None] * weight


def select(scores: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries and rows of all scores that can be among the k best: not under ``floor``, nor under the k-th of the block; ties to the first rows."""
    hits = scores >= floor[:, None]
    many = np.flatnonzero(np.count_nonzero(hits, axis=1) > k)
    if len(many):
        some = scores[many]
        edge = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k, None]
        over, level = some > edge, some == edge
        left = k - np.count_nonzero(over, axis=1)
        crowded = np.flatnonzero(np.count_nonzero(level, axis=1) > left)
        level[crowded] &= np.cumsum(level[crowded], axis=1) <= left[crowded, None]
        hits[many] = over | level
    return np.divmod(np.flatnonzero(hits), hits.shape[1])


class Kept:
    """The k best (score, id) so far of each of n slots: larger scores first, then smaller ids."""

    def __init__(self, n: int, k: int) -> None:
        self.k, shape = k, (n, k)
        self.found, self.scores, self.taken = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)

    def merge(self, slots: np.ndarray, found: np.ndarray, scores: np.ndarray) -> None:
        touched = np.unique(slots)
        old, place = np.nonzero(self.taken[touched])
        slot = np.r_[slots, touched[old]]
        found, scores = np.r_[found, self.found[touched[old], place]], np.r_[scores, self.scores[touched[old], place]]
        order = np.lexsort((found, ~scores, slot))
        slot, found, scores = slot[order], found[order], scores[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot, "left")
        kept = rank < self.k
        slot, rank = slot[kept], rank[kept]
        self.found[slot, rank], self.scores[slot, rank], self.taken[slot, rank] = found[kept], scores[kept], True


class Best(Kept):
    """The k best candidates so far of each query of a cell."""

    def __init__(self, queries: Rows, k: int) -> None:
        self.ids, self.lengths, values = queries
        super().__init__(len(self.ids), k)
        ends = np.cumsum(self.lengths)
        self.tiles = []
        for a in range(0, len(self.ids), TILE):
            b = min(a + TILE, len(self.ids))
            lengths, own = self.lengths[a:b], values[ends[a] - self.lengths[a] : ends[b - 1]]
            self.tiles.append((a, b, lengths, own, largest_norm(lengths, own)))

    def see(self, rows: Rows) -> None:
        """Scores ``rows``, in blocks, against all queries."""
        ids, lengths, values = ascending(rows)
        norm = largest_norm(lengths, values)
        ends, blocks = np.cumsum(lengths), {}
        for a, b, q_lengths, q_values, q_norm in self.tiles:
            # No sum of products, in parts or whole, exceeds the product of the norms.
            kind = np.int32 if 1.001 * norm * q_norm < 2**31 - 1 else np.int64
            if kind not in blocks:
                cuts = [(x, min(x + BLOCK, len(ids))) for x in range(0, len(ids), BLOCK)]
                lists = [postings(lengths[x:y], values[ends[x] - lengths[x] : ends[y - 1]]) for x, y in cuts]
                room = 2, TILE * min(BLOCK, len(ids))
                blocks[kind] = [(ids[x:y], laid_out(held, y - x, kind)) for (x, y), held in zip(cuts, lists)], np.empty(room, kind)
            tile = laid_out(postings(q_lengths, q_values), b - a, kind)
            for block, held in blocks[kind][0]:
                scores, spare = blocks[kind][1][:, : (b - a) * len(block)].reshape(2, b - a, len(block))
                scores[:] = 0
                accumulate(scores, spare, tile, held)
                self._keep(a, b, block, scores)

    def _keep(self, a: int, b: int, ids: np.ndarray, scores: np.ndarray) -> None:
        own, least, most = self.ids[a:b], np.iinfo(scores.dtype).min, np.iinfo(scores.dtype).max
        first, last = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        for q in np.flatnonzero(first < last).tolist():
            scores[q, first[q] : last[q]] = least
        floor = np.where(self.taken[a:b, -1], np.clip(self.scores[a:b, -1], least, most), least).astype(scores.dtype)
        at, rows = select(scores, floor, min(self.k, len(ids)))
        other = (rows < first[at]) | (rows >= last[at])
        if other.any():
            self.merge(at[other] + a, ids[rows[other]], scores[at[other], rows[other]].astype(np.int64))

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.ids), 1 << 14):
            at, place = np.nonzero(self.taken[a : a + (1 << 14)])
            at += a
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (self.ids[at], self.found[at, place], self.scores[at, place])], schema=schema)


def dealt(n: int, asked: int, terms: int, cores: int = 1) -> tuple[int, int]:
    """Parts of ``n`` candidates and groups of ``asked`` queries with ``terms`` weights: cells of bounded work with the fewest copies."""
    share = max(asked, 1) / max(n, 1)
    cells = max(FEWEST, 2 * cores, min(MOST, math.ceil(n * terms / WORK)))
    groups = max(1, round(math.sqrt(cells * share)), math.ceil(terms / GROUP))
    return max(1, min(math.ceil(n / UNIT), round(math.sqrt(cells / share)))), groups


def in_cells(units: DataFrame, asked: DataFrame, parts: int, groups: int) -> DataFrame:
    """The ``units`` of candidates and of queries in every cell that they meet in: a cell in a partition, its queries first."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def cells(units: DataFrame, queries: bool, part: Column, group: Column) -> DataFrame:
        rest = [c for c in units.columns if c not in ("unit", "each")]
        return units.select((part * groups + group).cast("int").alias("cell"), F.lit(queries).alias("queries"), *rest)

    held = cells(units.withColumn("each", each(groups)), False, F.col("unit") % parts, F.col("each"))
    asked = cells(asked.withColumn("each", each(parts)), True, F.col("each"), F.col("unit") % groups)
    return held.unionByName(asked, allowMissingColumns=True).repartitionById(parts * groups, "cell").sortWithinPartitions("cell", F.desc("queries"))


def over_cells(start: Callable[[Rows], object], schema: pa.Schema, held: tuple[str, ...] = (), asked: tuple[str, ...] = ()) -> Callable:
    """A mapInArrow function over cells: ``start`` makes an object of a cell's queries (with the ``asked`` columns), which sees its candidates
    (with the ``held`` columns) in blocks and then yields its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, best, waiting = None, None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["cell"] != cell:
                    if best is not None:
                        if waiting:
                            best.see(together(waiting))
                        yield from best.rows(schema)
                    cell, best, waiting = row["cell"], None, []
                if best is None and not row["queries"]:
                    if waiting:
                        best, waiting = start(together(waiting)), []
                    else:
                        continue  # a cell without queries
                waiting.append(unpacked(row, *(asked if row["queries"] else held)))
                if best is not None and sum(len(u[0]) for u in waiting) >= AHEAD:
                    best.see(together(waiting))
                    waiting = []
        if best is not None:
            if waiting:
                best.see(together(waiting))
            yield from best.rows(schema)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return run


def dealt_for(rows: DataFrame, is_asked: Column) -> tuple[int, int]:
    """Parts and groups for ``rows`` (weights), of which those that fulfil ``is_asked`` are queries too."""
    counts = rows.agg(F.count(F.lit(1)), F.count_if(is_asked), F.coalesce(F.sum(F.when(is_asked, F.size("weights"))), F.lit(0))).first()
    return dealt(*counts, rows.sparkSession.sparkContext.defaultParallelism)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose vec_id is divisible by ``every``."""
    all_rows = weights(vectors, scale)
    is_asked = F.col("vec_id") % every == 0
    asked = all_rows.where(is_asked).groupBy("vec_id").agg(F.min("weights").alias("weights"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    units = in_cells(packed(all_rows), packed(asked), *dealt_for(all_rows, is_asked))
    scored = units.mapInArrow(over_cells(lambda rows: Best(rows, k), schema), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

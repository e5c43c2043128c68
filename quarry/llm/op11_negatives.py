"""Hard negatives by blocked dense matrix products.

Rows of integer weights are packed in units; every block of anchors meets every block of candidates in one cell (see op3_topk), where the
product of the two blocks is taken in float64. Sums below 2^53 are exact there; a pair of blocks whose norms allow larger ones is
multiplied in long integers, and beyond those in Python's, cut to the range of a long. Vectors are laid out in slabs of SLAB
dimensions, so a long vector among short ones costs its own length.

The first pass keeps each anchor's best rows of its own label, its positives: a bounded list, merged over blocks in the task
and by rank over cells. The second pass gives every positive a window of scores, from ``low`` to ``high`` hundredths of its own, and keeps the best rows
of other labels in each, in the same way. Scores are computed twice rather than stored. Labels play no part in how rows are dealt, so a
label of a third of all rows is no hot key. Memory is bounded by TILE, op3_topk's BLOCK, AHEAD and GROUP; nothing is broadcast or collected but three counts.

Defined cases: rows without id, label or vector, or with a null or non-finite component, take no part; vectors of different
lengths share the leading dimensions (missing ones are zero); rows with an anchor's own id are never its positives or negatives;
of several anchor rows with one id the smallest (label, then vector) is the anchor; other repeated rows are candidates each;
ties go to the smaller id; a window of a negative positive score is empty (its lower end lies above its upper); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import op3_topk
from quarry.llm.common import cut
from quarry.llm.op3_topk import Kept, Rows, dealt_for, in_cells, over_cells, packed, select, weights

#: Anchors of a tile and dimensions of a slab.
TILE, SLAB = 256, 1024
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Block:
    """Rows laid out for products: ids, labels, and dense slabs of the rows that reach each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.labels, self.lengths = ids, labels, lengths
        self.norm = op3_topk.largest_norm(lengths, values)
        starts, self.slabs = np.cumsum(lengths) - lengths, []
        for d in range(0, int(lengths.max(initial=0)), SLAB):
            rows = np.flatnonzero(lengths > d)
            wide = np.minimum(lengths[rows] - d, SLAB)
            dense = np.zeros((len(rows), int(wide.max())), np.int64)
            row = np.repeat(np.arange(len(rows)), wide)
            at = np.arange(len(row)) - np.repeat(np.cumsum(wide) - wide, wide)
            dense[row, at] = values[starts[rows][row] + d + at]
            self.slabs.append((rows if len(rows) < len(ids) else None, dense, dense.astype(np.float64)))


def product(a: Block, b: Block) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b``: float64 where they are exact, else longs."""
    bound = 1.001 * a.norm * b.norm  # no sum of products, in parts or whole, exceeds the product of the norms
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
    out = None
    for (rows, whole, real), (others, other_whole, other_real) in zip(a.slabs, b.slabs):
        x, y = (real, other_real) if kind is np.float64 else (whole.astype(kind), other_whole.astype(kind))
        n = min(x.shape[1], y.shape[1])
        part = x[:, :n] @ y[:, :n].T
        if rows is None and others is None:
            out = part if out is None else out + part
        else:
            out = np.zeros((len(a.ids), len(b.ids)), kind) if out is None else out
            out[np.ix_(np.arange(len(a.ids)) if rows is None else rows, np.arange(len(b.ids)) if others is None else others)] += part
    if out is None:
        return np.zeros((len(a.ids), len(b.ids)))
    return np.clip(out, LEAST + 1, MOST).astype(np.int64) if kind is object else out


def blocks(rows: Rows, size: int) -> Iterator[tuple[int, int, Block]]:
    """Blocks of ``size`` rows and where they begin and end."""
    ids, lengths, values, labels = rows[:4]
    ends = np.cumsum(lengths)
    for a in range(0, len(ids), size):
        b = min(a + size, len(ids))
        yield a, b, Block(ids[a:b], labels[a:b], lengths[a:b], values[ends[a] - lengths[a] : ends[b - 1]])


def by_id(rows: Rows) -> Rows:
    """Candidates (ids, lengths, values, labels) by ascending id, so that the first of equal scores is the smallest id."""
    ids, lengths, values, labels = rows
    return *op3_topk.ascending((ids, lengths, values)), labels[np.argsort(ids, kind="stable")]


class Mined(Kept):
    """The best candidates of every slot of a cell's anchors: one slot an anchor for positives, one a window for negatives."""

    def __init__(self, anchors: Rows, k: int, windows: int) -> None:
        self.tiles = list(blocks(anchors, TILE))
        self.windows, n = windows, len(anchors[0])
        super().__init__(n * max(windows, 1), k)
        self.anchors = np.repeat(anchors[0], max(windows, 1))
        if windows:
            self.low, self.high, self.positives, self.positive_scores = (x.reshape(n, windows) for x in anchors[4:])

    def see(self, rows: Rows) -> None:
        for _, _, block in blocks(by_id(rows), op3_topk.BLOCK):
            for a, b, tile in self.tiles:
                scores = product(tile, block)
                (self._negatives if self.windows else self._positives)(a, b, tile, block, scores)

    def _floor(self, slots: np.ndarray) -> np.ndarray:
        return np.where(self.taken[slots, -1], self.scores[slots, -1], LEAST)

    def _best(self, slots: np.ndarray, block: Block, scores: np.ndarray, fits: np.ndarray) -> None:
        """Offers the scores that fit, a row of them for each slot."""
        none, least = (-np.inf, np.finfo(np.float64).min) if scores.dtype == np.float64 else (LEAST, LEAST + 1)
        at, rows = select(np.where(fits, scores, none), np.full(len(slots), least, scores.dtype), self.k)
        self.merge(slots[at], block.ids[rows], scores[at, rows].astype(np.int64))

    def _positives(self, a: int, b: int, tile: Block, block: Block, scores: np.ndarray) -> None:
        slots = np.arange(a, b)
        fits = (tile.labels[:, None] == block.labels) & (tile.ids[:, None] != block.ids) & (scores >= self._floor(slots)[:, None])
        some = np.flatnonzero(fits.any(axis=1))
        if len(some):
            self._best(slots[some], block, scores[some], fits[some])

    def _negatives(self, a: int, b: int, tile: Block, block: Block, scores: np.ndarray) -> None:
        slots = np.arange(a, b)[:, None] * self.windows + np.arange(self.windows)
        low = np.maximum(self.low[a:b], self._floor(slots.ravel()).reshape(slots.shape))
        high = self.high[a:b]
        open_ = low <= high
        fits = (scores >= np.where(open_, low, MOST).min(axis=1)[:, None]) & (scores <= np.where(open_, high, LEAST).max(axis=1)[:, None])
        fits &= (tile.labels[:, None] != block.labels) & (tile.ids[:, None] != block.ids)
        some = np.flatnonzero(fits.any(axis=1))
        for j in range(self.windows if len(some) else 0):
            of = scores[some]
            own = fits[some] & (of >= low[some, j, None]) & (of <= high[some, j, None])
            hit = np.flatnonzero(own.any(axis=1))
            if len(hit):
                self._best(slots[some[hit], j], block, of[hit], own[hit])

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.anchors), 1 << 14):
            at, place = np.nonzero(self.taken[a : a + (1 << 14)])
            at += a
            slot = [at % self.windows, self.positives.ravel()[at], self.positive_scores.ravel()[at]] if self.windows else []
            columns = [self.anchors[at], *slot, self.found[at, place], self.scores[at, place]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _ranked(rows: DataFrame, k: int, *slot: str, best: str, by: str) -> DataFrame:
    """The k best rows of each slot over all cells, with their rank."""
    order = Window.partitionBy(*slot).orderBy(F.desc(by), F.asc(best))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the best negatives in the window of each anchor's positives.

    Anchors are rows whose vec_id is divisible by ``every``; a negative n of positive p fulfils low * p <= 100 * n <= high * p.
    """
    vectors = vectors.where(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("long"))
    rows = weights(vectors, scale, "label")
    is_anchor = F.col("vec_id") % every == 0
    parts, groups = dealt_for(rows, is_anchor)
    first = F.min(F.struct("label", "weights"))
    anchors = rows.where(is_anchor).groupBy("vec_id").agg(first.alias("first")).select("vec_id", "first.label", "first.weights")
    units = packed(rows, "label")

    def passed(asked: DataFrame, k: int, windows: int, *columns: str) -> DataFrame:
        names = ["anchor_id", *(["window", "positive_id", "positive_score"] if windows else []), "found_id", "found_score"]
        schema = pa.schema([(n, pa.int64()) for n in names])
        run = over_cells(lambda cell: Mined(cell, k, windows), schema, ("label",), ("label", *columns))
        return in_cells(units, packed(asked, "label", *columns), parts, groups).mapInArrow(run, ", ".join(f"{n} long" for n in names))

    near = _ranked(passed(anchors, positives, 0), positives, "anchor_id", best="found_id", by="found_score")
    near = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "found_id", "found_score"))).alias("near"))  # as many as positives
    # ends of the windows in whole numbers; a missing positive has an empty one
    ends = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda k: F.get("near", k))
    score = lambda x: F.coalesce(x["found_score"], F.lit(0)).cast("decimal(19,0)")
    edge = lambda x, percent, up: (F.ceil if up else F.floor)(score(x) * percent / F.lit(100).cast("decimal(3,0)")).cast("long")
    there = lambda x, value, other: F.when(x.isNotNull(), value).otherwise(F.lit(other)).cast("long")
    windows = near.select(
        F.col("anchor_id").alias("vec_id"),
        F.transform(ends, lambda x: there(x, edge(x, low, True), 1)).alias("low"),
        F.transform(ends, lambda x: there(x, edge(x, high, False), 0)).alias("high"),
        F.transform(ends, lambda x: F.coalesce(x["found_id"], F.lit(0)).cast("long")).alias("positive_ids"),
        F.transform(ends, lambda x: F.coalesce(x["found_score"], F.lit(0)).cast("long")).alias("positive_scores"),
    )
    windows = cut(windows, "windows")
    asked = anchors.join(windows, "vec_id")
    found = _ranked(passed(asked, negatives, positives, "low", "high", "positive_ids", "positive_scores"), negatives, "anchor_id", "window", best="found_id", by="found_score")
    return found.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("found_score").alias("negative_score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

"""Packing of documents into training sequences of equal length, balanced by attention cost.

A document's ids, with an end id, are cut into pieces: as many whole sequences of SIZE ids as they fill, each a sequence of its own, and a
rest. Rests are gathered, as documents lie in the table, in groups of about GROUP ids and packed group by group, so a task
holds one group whatever the table's size, no text moves between tasks, and groups of hot sources or copies are of no account.

A group's rests fill as many whole sequences as they have ids for; the ids left over go to shorter sequences, one for each
power of two in their number, so no sequence is padded. The cost of a piece of n ids is linear plus quadratic, n * 6 * width + n * n: a layer's
products with its weights and with the n ids attended to, for a model of that width. Rests go, by descending length, to
the sequence of the lowest cost that has room for the whole of it. Where none has, the sequence of the lowest cost that has any room takes what
fits, and what is left of the rest waits for its turn by its new length. Costs are whole numbers, so ties are exact: rests by doc_id, then start
and order of arrival, sequences by number.

Sequence ids are the number of the table's partition times 2^33, plus a number from 0 in the partition.

Defined cases: a null text is empty and still has the end id; a null doc_id sorts first; repeated rows are packed each; an empty
table yields no pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.op6_repair import encoder

#: Ids of a sequence (a power of two) and of a group, and width of the model whose costs are estimated.
SIZE, GROUP, WIDTH = 2048, 1 << 21, 1024


@dataclass(slots=True)
class Rest:
    """A part of a document that is not packed yet."""

    doc_id: int | None
    start: int
    tokens: int
    ids: np.ndarray


Piece = tuple[Rest, int, int, int]  # what it holds, its sequence, its offset there, the sequence's length


def cost(length: int, width: int = WIDTH) -> int:
    """Estimated cost of a piece: linear in its length, and quadratic."""
    return length * 6 * width + length * length


def capacities(total: int, size: int) -> list[int]:
    """Lengths of the sequences that ``total`` ids fill without padding: whole ones, then powers of two."""
    left = total % size
    return [size] * (total // size) + [1 << k for k in range(size.bit_length() - 1, -1, -1) if left >> k & 1]


def balanced(rests: list[Rest], size: int, width: int = WIDTH) -> list[Piece]:
    """Pieces of the rests of a group, by sequence (from 0) and offset."""
    lengths = capacities(sum(len(r.ids) for r in rests), size)
    room = np.array(lengths, np.int64)
    costs, out = np.zeros(len(room), np.int64), []
    full = np.iinfo(np.int64).max
    order = sorted(range(len(rests)), key=lambda k: (rests[k].doc_id is not None, rests[k].doc_id or 0, rests[k].start))
    queue = [(-len(rests[k].ids), turn, 0) for turn, k in enumerate(order)]  # turn: place by doc_id; 0: ids placed already
    heapq.heapify(queue)
    used = np.zeros(len(room), np.int64)
    while queue:
        length, turn, placed = heapq.heappop(queue)
        length = -length
        best = int(np.argmin(np.where(room >= length, costs, full)))
        if room[best] < length:
            best = int(np.argmin(np.where(room > 0, costs, full)))
        taken, rest = min(length, int(room[best])), rests[order[turn]]
        out.append((Rest(rest.doc_id, rest.start + placed, rest.tokens, rest.ids[placed : placed + taken]), best, int(used[best]), lengths[best]))
        used[best] += taken
        room[best] -= taken
        costs[best] += cost(taken, width)
        if taken < length:
            heapq.heappush(queue, (taken - length, turn, placed + taken))
    return sorted(out, key=lambda p: p[1:])


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_length", pa.int64()), ("cost", pa.int64()), ("ids", pa.binary())]
)


def _batches(pieces: list[Piece], first: int, width: int, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(pieces), rows):
        table = [(r.doc_id, r.start, len(r.ids), r.tokens, first + s, offset, length, cost(len(r.ids), width), r.ids.astype("<u4", copy=False).tobytes()) for r, s, offset, length in pieces[at : at + rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table), SCHEMA.types)], schema=SCHEMA)


def pack(docs: DataFrame, path: str, end_id: int = 1, size: int = SIZE, group: int = GROUP, width: int = WIDTH) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, sequence_length, cost, ids (little-endian, 32 bits each) of every piece.

    ``size`` is a power of two; ``path`` is a byte-level tokenizer file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, first = encoder(path), TaskContext.get().partitionId() << 33
        held, waiting = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc, ids in zip(some.column("doc_id").to_pylist(), coder.encode(some.column("text").to_pylist())):
                    ids = np.append(ids, np.uint32(end_id))
                    whole = len(ids) // size
                    if whole:
                        yield from _batches([(Rest(doc, k * size, len(ids), ids[k * size : (k + 1) * size]), k, 0, size) for k in range(whole)], first, width)
                        first += whole
                    if len(ids) > whole * size:
                        held.append(Rest(doc, whole * size, len(ids), ids[whole * size :].copy()))
                        waiting += len(held[-1].ids)
                    if waiting >= group:
                        pieces = balanced(held, size, width)
                        yield from _batches(pieces, first, width)
                        first, held, waiting = first + pieces[-1][1] + 1, [], 0
        if held:
            yield from _batches(balanced(held, size, width), first, width)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    columns = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, cost long, ids binary"
    return rows.mapInArrow(run, columns)

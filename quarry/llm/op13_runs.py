"""Periodic runs of words by harmonic grid probing.

A run is a stretch of words that repeats with a smallest period q, of at least max(LEAST, TIMES * q) words, that no neighbouring word
extends. Words of a batch of texts are numbered and laid end to end, longest text first, with a number of its own behind each text. For
every period p in turn, equality of the words at jp and (j + 1)p is tested on the grid of multiples of p, in the texts that are
long enough for a run of that period: a run holds at least TIMES - 1 neighbouring pairs of grid points, so only places with so many
equal pairs in a row survive. Survivors are extended to both sides by comparing the array with itself p further on, in chunks of doubling size.
Grid points that lie in a run found before are skipped: a stretch whose grid points do has that run's period, or none shorter than it.
All grids of a text of n words have n log n points together.

Texts are judged each by itself, where they lie: nothing is shuffled, broadcast or collected. A task holds a batch of at most WORDS words, or one longer text.

Defined cases: a null text, like an empty one, has no words, no runs and an empty collapsed text; words are what Unicode's ASCII
white space (space and U+0009 to U+000D) separates, compared as they are; a null doc_id stays null; repeated rows are texts of their own; an
empty table yields no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD

#: A run has at least LEAST words and TIMES periods; words of the texts that are searched together; the first chunk of an extension.
LEAST, TIMES, WORDS, CHUNK = 6, 4, 1 << 20, 64
Run = tuple[int, int, int]  # start, length, period


def split(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def extended(a: np.ndarray, at: int, period: int, step: int) -> int:
    """The farthest place from ``at`` on, going by ``step`` (1 or -1), up to which every word equals the one ``period`` further on."""
    chunk = CHUNK
    while True:
        if step > 0:
            n = min(chunk, len(a) - period - at - 1)
            same = a[at + 1 : at + 1 + n] == a[at + 1 + period : at + 1 + period + n]
        else:
            n = min(chunk, at)
            same = (a[at - n : at] == a[at - n + period : at + period])[::-1]
        if n <= 0:
            return at
        if not same.all():
            return at + step * int(same.argmin())
        at, chunk = at + step * n, 2 * chunk


def grid_runs(words: np.ndarray, limits: np.ndarray) -> list[Run]:
    """All runs in ``words``, where those before ``limits[p]`` are of the texts in which a run of period p has room."""
    found: list[Run] = []
    reach = np.zeros(len(words), np.int64)  # the farthest end of the runs found so far that hold a word
    need = TIMES - 1
    for p in range(1, len(limits)):
        grid = words[: limits[p] : p]
        pairs = len(grid) - 1
        if pairs < need:
            continue
        equal = grid[1:] == grid[:-1]
        row = equal[: pairs - need + 1]
        for k in range(1, need):
            row = row & equal[k : pairs - need + 1 + k]
        at = np.flatnonzero(row) * p
        at = at[reach[at] <= at + need * p]
        last = -1  # the last place that has been compared with the one a period further on
        for x in at.tolist():
            if x <= last or reach[x] > x + need * p:
                continue
            last = extended(words, x, p, 1)
            if last < x + (need - 1) * p:
                continue
            left = extended(words, x, p, -1)
            length = last - left + 1 + p
            if length >= max(LEAST, TIMES * p):
                found.append((left, length, p))
                np.maximum(reach[left : left + length], left + length, out=reach[left : left + length])
    return found


def runs_of(texts: list[np.ndarray]) -> list[list[Run]]:
    """Runs of every text (its words as numbers from 0), by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    order = [k for k in order if len(texts[k]) >= LEAST]
    if not order:
        return out
    lengths = np.array([len(texts[k]) for k in order])
    ends = np.cumsum(lengths + 1)
    words = np.concatenate([x for n, k in enumerate(order) for x in (texts[k], [-1 - n])])
    periods = np.arange(int(lengths[0]) // TIMES + 1)
    long_enough = len(order) - np.searchsorted(lengths[::-1], np.maximum(LEAST, TIMES * periods), "left")
    limits = np.where(long_enough > 0, ends[long_enough - 1], 0)
    for start, length, period in grid_runs(words, limits):
        k = int(np.searchsorted(ends, start, "right"))
        out[order[k]].append((start - int(ends[k] - lengths[k] - 1), length, period))
    return [sorted(r, key=lambda r: (r[0], r[2])) for r in out]


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by spaces, without those that a run holds behind its first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.cumsum(edge)[:-1] == 0
    return b" ".join(w for w, x in zip(words, kept.tolist()) if x)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def _found(ids: list, texts: list[list[bytes]], numbers: list[np.ndarray]) -> pa.RecordBatch:
    runs = runs_of(numbers)
    rows = [ids, [len(t) for t in texts], [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], [collapsed(t, r).decode("utf-8", "replace") for t, r in zip(texts, runs)]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, SCHEMA.types)], schema=SCHEMA)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed text of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, numbers, held, known = [], [], [], 0, {}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = split(text.as_py())
                ids.append(doc)
                texts.append(words)
                numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
                held += len(words)
                if held >= WORDS:
                    yield _found(ids, texts, numbers)
                    ids, texts, numbers, held, known = [], [], [], 0, {}
            if ids:
                yield _found(ids, texts, numbers)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    columns = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, columns)


def digests(found: DataFrame) -> DataFrame:
    """n_runs, the longest run (ties: smallest start, then period) and digests of all runs and of the collapsed text, for the rows of ``find``."""
    # of equal lengths the first in order of start and period
    longest = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("__r"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    r = F.col("__r")
    milli = F.floor(r["length"] * 1000 / r["period"]).cast("long")
    return rows.select("doc_id", "n_runs", r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts (by a checksum of the id) repeat a stretch of their words to their end.

    Let h be the crc32 of the id in decimal, g = floor(h / 10), n the number of words: where h % 10 = 0 and n > 0, every word i from
    a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). Texts without id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.when(h % 10 == 0, F.floor(h / 10).cast("long")).alias("g"))
    # words only where they are needed
    rows = rows.withColumn("words", F.when(F.col("g").isNotNull(), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), 0)))
    n = F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    a, p, words = F.col("a"), F.col("p"), F.col("words")
    turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(words, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int")))
    return rows.select("doc_id", F.when(a.isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))

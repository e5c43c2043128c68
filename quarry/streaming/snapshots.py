"""A streamed index of immutable segments under versioned manifests.

A batch becomes one segment: documents, packed postings with their counts, and totals of its fields, that never change. A document replaces earlier ones with its doc_id
or with an equal value in a unique field: the commit adds tombstones (segment, doc_id) for them, and what their postings take off the
statistics. A manifest lists the live segments and tombstones of one version, so a reader opens a version and sees whole batches and every live document once,
whatever is written or merged meanwhile. Segments of like size are merged into one (size-tiered), which also drops their dead rows.

A manifest is one small file, created only where none of its number is there; who comes second reads the newer version and decides anew.
A file that does not end in its closing mark is not yet (or never will be) a version. A batch of a stream that a version holds already is left out, so batches may run again.
"""

from __future__ import annotations

import functools
import json
import math
import re
import time
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.index import SearchIndex, keep_last, spread
from quarry.operators.postings import STORED, counts_in, packed_of, packed_schema, unpacked
from quarry.plans.schema import Schema, ensure_schema

#: Segments of a tier that are merged together, and seconds that an unfinished manifest is waited for.
FAN, PATIENCE = 4, 10.0
#: Bytes of stored documents that one task analyses at most, unless they lie in less than a file.
SPLIT = 128 << 20
_GONE = "segment string, doc_id long"
_TAKEN = "segment string, field string, term string, df long, cf double, total long"


class Conflict(RuntimeError):
    """Another writer was first, again and again."""


class StreamedIndex:
    """The index under ``path``; ``id_column`` numbers documents (doc_id)."""

    def __init__(self, spark: SparkSession, path: str, schema, id_column: str = "doc_id"):
        self.spark, self.path, self.schema, self.id_column = spark, path.rstrip("/"), ensure_schema(schema), id_column
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._at = lambda *parts: hadoop("/".join([self.path, *parts]))
        self.fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    # Versions

    def versions(self) -> list[int]:
        if not self.fs.exists(self._at("manifests")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._at("manifests"))]
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n))

    def _read(self, version: int) -> dict | None:
        """A manifest, or None while it is unfinished."""
        stream = self.fs.open(self._at("manifests", f"v{version}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        body, mark, _ = text.partition("\nend")
        return json.loads(body) if mark else None

    def manifest(self, version: int | None = None, patience: float = 0.0) -> dict:
        """The manifest of a version, by default of the latest whole one; ``patience``: seconds to wait for a later one to be finished."""
        ends = time.monotonic() + patience
        if version:
            found = self._read(version)
            if found is None:
                raise FileNotFoundError(f"{self.path}: no version {version}")
            return found
        while True:
            numbers = self.versions()
            for n in reversed(numbers):
                found = self._read(n)
                if found is not None:
                    return found
                if time.monotonic() < ends:
                    time.sleep(0.1)
                    break
            else:
                return {"version": 0, "segments": {}, "tombstones": [], "taken": [], "streams": {}}

    def _commit(self, found: dict) -> bool:
        """Whether ``found`` became the next version."""
        found["version"] = max(self.versions(), default=0) + 1 if found.get("skip") else found["version"] + 1
        found.pop("skip", None)
        try:
            stream = self.fs.create(self._at("manifests", f"v{found['version']}"), False)
        except Py4JJavaError:
            if self.fs.exists(self._at("manifests", f"v{found['version']}")):
                return False
            raise
        stream.write(bytearray((json.dumps(found) + "\nend").encode()))
        stream.close()
        return True

    def _next(self, change, tries: int = 20) -> dict | None:
        """Commits ``change`` of the latest manifest (None: nothing to do), again if another version came between."""
        for _ in range(tries):
            base = self.manifest(patience=PATIENCE)
            made = change(json.loads(json.dumps(base)))
            if made is None:
                return None
            if any(v > base["version"] for v in self.versions()) and self.manifest()["version"] == base["version"]:
                made["skip"] = True  # a dead writer's number
            elif self.versions() and max(self.versions()) > base["version"]:
                continue
            if self._commit(made):
                return made
        raise Conflict(self.path)

    # Reading

    def _table(self, name: str, segments, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.option("basePath", f"{self.path}/{name}")
        paths = [f"{self.path}/{name}/segment={s}" for s in segments]
        return (reader.schema(schema) if schema else reader.option("mergeSchema", True)).parquet(*paths)

    def _gone(self, found: dict) -> DataFrame:
        paths = [f"{self.path}/tombstones/{t}" for t in found["tombstones"]]
        rows = self.spark.read.schema(_GONE).parquet(*paths) if paths else self.spark.createDataFrame([], _GONE)
        return rows.where(F.col("segment").isin(*found["segments"])).distinct()

    def _packed(self, segments) -> DataFrame:
        return self._table("postings", segments, packed_schema() + ", segment string")

    def _live(self, found: dict, name: str, segments=None) -> DataFrame:
        """Rows of documents or postings without those of dead documents, with their segment."""
        segments = found["segments"] if segments is None else segments
        rows = self._packed(segments) if name == "postings" else self._table(name, segments)
        rows = rows.withColumn("segment", F.col("segment").cast("string"))
        if name == "postings":
            rows = unpacked(rows, "segment")
        return rows.join(self._gone(found), ["segment", "doc_id"], "left_anti") if found["tombstones"] else rows

    def _taken(self, found: dict) -> DataFrame:
        paths = [f"{self.path}/taken/{t}" for t in found["taken"]]
        rows = self.spark.read.schema(_TAKEN).parquet(*paths) if paths else self.spark.createDataFrame([], _TAKEN)
        return rows.where(F.col("segment").isin(*found["segments"]))

    def open(self, version: int | None = None) -> SearchIndex:
        """The index as of a version, by default the latest. Statistics are summed from the counts of packed postings, less what dead documents had.

        The extremes of weights and lengths cover dead documents too until their segments are merged: bounds, not values.
        """
        found = self.manifest(version)
        if not found["segments"]:
            raise FileNotFoundError(f"no index at {self.path}")
        docs = self._live(found, "docs").drop("segment")
        postings = self._live(found, "postings").drop("segment")
        taken = self._taken(found)
        less = taken.select("field", "term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))
        counts = self._packed(found["segments"]).select("field", "term", "df", "cf", "max_weight", "min_length", "max_length")
        stats = counts.unionByName(less, allowMissingColumns=True)
        stats = stats.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("max_weight").alias("max_weight"), F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length")).where("df > 0")
        n = sum(s["docs"] - s["gone"] for s in found["segments"].values())
        fields = self._table("field_stats", found["segments"]).drop("segment").unionByName(taken.select("field", (-F.col("total")).alias("total")), allowMissingColumns=True)
        fields = fields.groupBy("field").agg(F.sum("total").alias("total"), F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length")).withColumn("n", F.lit(n).cast("long"))
        return SearchIndex(self.schema, docs, postings, stats, fields, self.path, found["version"])

    # Writing

    def _store(self, docs: DataFrame, keys=(), arrival: str | None = None) -> str:
        """A new segment's documents, one for each value of ``keys``; the segment's id.

        They are written as they come and dealt by keys only where stored ones share one: texts move for that alone.
        """
        segment = uuid.uuid4().hex[:12]
        docs.write.parquet(f"{self.path}/docs/segment={segment}")
        stored = self.spark.read.schema(docs.schema).parquet(f"{self.path}/docs/segment={segment}")
        if not any(stored.where(F.col(k).isNotNull()).groupBy(k).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect() for k in keys):
            return segment
        for k in keys:
            stored = keep_last(stored, [k], arrival)
        return self._store(stored)

    def _analysed(self, segment: str) -> DataFrame:
        """Packed postings of a segment's stored documents."""
        docs = self.spark.read.parquet(f"{self.path}/docs/segment={segment}")
        return packed_of(spread(docs, SPLIT), self.schema.resolve(docs.columns))

    def _write(self, segment: str, postings: DataFrame | None = None) -> tuple[str, int]:
        """The postings of a segment whose documents are stored (by default as they are analysed): its id and number of documents."""
        at = lambda name: f"{self.path}/{name}/segment={segment}"
        postings = self._analysed(segment) if postings is None else postings
        postings.write.options(**STORED).parquet(at("postings"))
        packed = self.spark.read.schema(postings.schema).parquet(at("postings"))
        totals = packed.groupBy("field").agg(F.sum("total").alias("total"), F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"))
        totals.coalesce(1).write.parquet(at("field_stats"))
        return segment, self._table("docs", [segment]).count()

    def _bury(self, found: dict, gone: DataFrame, segments=None) -> dict:
        """Adds tombstones for ``gone`` (segment, doc_id) to a manifest, with what they take off the statistics."""
        name = uuid.uuid4().hex[:12]
        gone.select("segment", "doc_id").distinct().write.parquet(f"{self.path}/tombstones/{name}")
        gone = self.spark.read.schema(_GONE).parquet(f"{self.path}/tombstones/{name}")
        counts = {r["segment"]: r["n"] for r in gone.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each segment
        if not counts:
            return found
        postings = counts_in(self._packed(sorted(counts)), "segment").join(gone, ["segment", "doc_id"], "left_semi")
        terms = postings.groupBy("segment", "field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("weight").alias("cf"), F.sum("tf").alias("total"))
        terms.select(*(c.split()[0] for c in _TAKEN.split(", "))).write.parquet(f"{self.path}/taken/{name}")
        found["tombstones"].append(name)
        found["taken"].append(name)
        for segment, n in counts.items():
            found["segments"][segment]["gone"] += n
        return found

    def upsert(self, batch: DataFrame, stream: str | None = None, number: int | None = None, arrival: str | None = None) -> int | None:
        """Adds documents in place of earlier ones with their doc_id or a value of a unique field; the version, or None for a batch that is there already.

        Of several rows of the batch with one key the last by ``arrival`` (by default the order of doc_id) stays.
        """
        if stream is not None and self.manifest()["streams"].get(stream, -1) >= number:
            return None
        docs = batch.withColumn("doc_id", F.col(self.id_column).cast("long"))
        keys = [k for k in self.schema.unique_fields() if k != "doc_id"]
        segment, n = self._write(self._store(docs, ["doc_id", *keys], arrival))
        new = self._table("docs", [segment])

        def change(found: dict) -> dict | None:
            if stream is not None and found["streams"].get(stream, -1) >= number:
                return None
            if found["segments"]:
                held = self._live(found, "docs")
                gone = [held.join(new.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_semi").select("segment", "doc_id") for k in ("doc_id", *keys)]
                found = self._bury(found, functools.reduce(DataFrame.unionAll, gone))
            found["segments"][segment] = {"docs": n, "gone": 0}
            if stream is not None:
                found["streams"][stream] = number
            return found

        made = self._next(change)
        return made and made["version"]

    def delete(self, ids: DataFrame) -> int:
        """Without the documents in ``ids`` (doc_id)."""

        def change(found: dict) -> dict:
            return self._bury(found, self._live(found, "docs").join(ids.select("doc_id").distinct(), "doc_id", "left_semi"))

        return self._next(change)["version"]

    def merge(self, fan: int = FAN, all_segments: bool = False) -> int:
        """Merges the segments of the smallest tier that has ``fan`` of them (or all); how many were merged.

        Readers keep their versions. Documents that die while the merge runs are dead in the merged segment too.
        """
        start = self.manifest(patience=PATIENCE)
        tiers: dict[int, list[str]] = {}
        for s, facts in start["segments"].items():
            tiers.setdefault(0 if all_segments else math.floor(math.log(max(facts["docs"] - facts["gone"], 1), fan)), []).append(s)
        chosen = next((sorted(tiers[t]) for t in sorted(tiers) if len(tiers[t]) >= (2 if all_segments else fan)), None)
        if chosen is None:
            return 0
        docs = self._live(start, "docs", segments=chosen).drop("segment")
        # the live documents' texts cost less to analyse than all postings to take apart, sort out and pack again
        segment = self._store(docs)
        segment, n = self._write(segment, self._analysed(segment))
        known = self._gone(start)

        def change(found: dict) -> dict | None:
            if not set(chosen) <= set(found["segments"]):
                return None
            fresh = self._gone(found).where(F.col("segment").isin(chosen)).join(known, ["segment", "doc_id"], "left_anti")
            others, taken = self._gone(found).where(~F.col("segment").isin(chosen)), self._taken(found).where(~F.col("segment").isin(chosen))
            name = uuid.uuid4().hex[:12]
            others.write.parquet(f"{self.path}/tombstones/{name}")
            taken.write.parquet(f"{self.path}/taken/{name}")
            found["segments"] = {s: f for s, f in found["segments"].items() if s not in chosen} | {segment: {"docs": n, "gone": 0}}
            found["tombstones"], found["taken"] = [name], [name]
            return self._bury(found, fresh.select(F.lit(segment).alias("segment"), "doc_id"))

        return len(chosen) if self._next(change) else 0

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the files that none of the ``keep`` latest versions needs; how many folders went. Readers of older versions lose theirs.

        Run it where nobody writes: what a writer has not committed yet looks unneeded.
        """
        whole = [v for v in self.versions() if self._read(v) is not None]
        held = [self._read(v) for v in whole[-keep:]]
        needed = {f"segment={s}" for m in held for s in m["segments"]} | {t for m in held for t in [*m["tombstones"], *m["taken"]]}
        gone = 0
        for name in ("docs", "postings", "field_stats", "tombstones", "taken"):
            if self.fs.exists(self._at(name)):
                for status in self.fs.listStatus(self._at(name)):
                    if status.getPath().getName() not in needed:
                        gone += bool(self.fs.delete(status.getPath(), True))
        for v in whole[:-keep]:
            self.fs.delete(self._at("manifests", f"v{v}"), False)
        return gone


def upsert_stream(stream: DataFrame, index: StreamedIndex, checkpoint: str, name: str = "stream", trigger: Mapping | None = None, fan: int | None = FAN) -> StreamingQuery:
    """Starts a stream of documents into ``index``, one version a batch; like segments are merged as they come (``fan`` None: never)."""

    def write(batch: DataFrame, number: int) -> None:
        index.upsert(batch, name, number)
        while fan and index.merge(fan):
            pass

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


__all__ = ["Conflict", "StreamedIndex", "upsert_stream"]

"""Media columns: payloads in ISO base media files, and what their boxes say about them.

``store`` writes each text's bytes as an 8-bit mono track: ftyp, then moov with full sample tables
(stsd, stts, stsc, stsz, stco, stss), then mdat. A sample is 192 bytes, a chunk up to 64 samples, every
16th sample a sync sample. ``probe`` walks the nested boxes and decodes the tables into codec,
duration, sample and keyframe byte ranges without touching the payload; ``payload`` slices the bytes
out by those ranges. Files are told apart by content only, so equal texts give equal files.

Defined cases: a null text is empty (192 spaces are stored); boxes that are truncated, or whose sizes
don't fit their parents, raise ValueError from ``probe``; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows

SAMPLE, PER_CHUNK, KEY_EVERY, RATE = 192, 64, 16, 8000
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) + 8 < 2**32 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def u32(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


def padded(data: bytes) -> bytes:
    return data.ljust(max(SAMPLE, -(-len(data) // SAMPLE) * SAMPLE), b" ")


def encode(payload: bytes) -> bytes:
    """A media file that holds ``payload``, whose length is a positive multiple of SAMPLE."""
    samples = len(payload) // SAMPLE
    chunks = -(-samples // PER_CHUNK)
    last = samples - (chunks - 1) * PER_CHUNK
    length = samples * SAMPLE
    matrix = u32(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = [(1, PER_CHUNK, 1)] if last == PER_CHUNK else [(1, last, 1)] if chunks == 1 else [(1, PER_CHUNK, 1), (chunks, last, 1)]
    keys = range(1, samples + 1, KEY_EVERY)
    head = box(b"ftyp", b"isom", u32(0x200), b"isomiso2")

    def moov(base: int) -> bytes:
        table = box(
            b"stbl",
            full(b"stsd", u32(1), entry),
            full(b"stts", u32(1, samples, SAMPLE)),
            full(b"stsc", u32(len(runs), *(v for r in runs for v in r))),
            full(b"stsz", u32(SAMPLE, samples)),
            full(b"stco", u32(chunks, *(base + k * PER_CHUNK * SAMPLE for k in range(chunks)))),
            full(b"stss", u32(len(keys), *keys)),
        )
        media = box(
            b"mdia",
            full(b"mdhd", u32(0, 0, RATE, length), struct.pack(">HH", 0x55C4, 0)),
            full(b"hdlr", u32(0), b"soun", bytes(12), b"sound\0"),
            box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", u32(1), full(b"url ", flags=1))), table),
        )
        track = box(b"trak", full(b"tkhd", u32(0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, u32(0, 0), flags=7), media)
        return box(b"moov", full(b"mvhd", u32(0, 0, RATE, length, 0x10000), struct.pack(">H", 0x100), bytes(10), matrix, bytes(24), u32(2)), track)

    start = len(head) + len(moov(0)) + 8
    return b"".join((head, moov(start), box(b"mdat", payload)))


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    samples: list[tuple[int, int]]  # runs of adjacent samples as (offset, bytes)
    n_samples: int
    keyframes: list[tuple[int, int]]


def boxes(data: memoryview, start: int, end: int):
    """(kind, body start, body end) of the boxes in a range."""
    at = start
    while at < end:
        if at + 8 > end:
            raise ValueError("truncated box header")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("truncated box header")
            size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} does not fit")
        yield kind, body, at + size
        at += size


def _find(data: memoryview, start: int, end: int, path: tuple[bytes, ...]):
    for kind, a, b in boxes(data, start, end):
        if kind == path[0]:
            if len(path) == 1:
                yield a, b
            else:
                yield from _find(data, a, b, path[1:])


def _table(data: memoryview, span: tuple[int, int], skip: int, columns: int) -> list[tuple[int, ...]]:
    a, b = span
    count = struct.unpack_from(">I", data, a + skip)[0]
    if a + skip + 4 + 4 * columns * count > b:
        raise ValueError("truncated table")
    flat = struct.unpack_from(f">{columns * count}I", data, a + skip + 4)
    return list(zip(*[iter(flat)] * columns))


def probe(file: bytes) -> list[Track]:
    """The tracks of a file, from its boxes alone."""
    data, out = memoryview(file), []
    for a, b in _find(data, 0, len(data), (b"moov", b"trak")):
        one = lambda *path: next(_find(data, a, b, (b"mdia", *path)), None)  # noqa: B023, E731
        stbl = (b"minf", b"stbl")
        mdhd, stsd, stsc, stsz, stss = one(b"mdhd"), one(*stbl, b"stsd"), one(*stbl, b"stsc"), one(*stbl, b"stsz"), one(*stbl, b"stss")
        stco, co64 = one(*stbl, b"stco"), one(*stbl, b"co64")
        if not (mdhd and stsd and stsc and stsz and (stco or co64)):
            raise ValueError("missing sample table")
        if data[mdhd[0]] == 1:
            timescale, duration = struct.unpack_from(">IQ", data, mdhd[0] + 20)
        else:
            timescale, duration = struct.unpack_from(">II", data, mdhd[0] + 12)
        codec = bytes(data[stsd[0] + 12 : stsd[0] + 16]).decode("latin-1")
        if stco:
            offsets = [x for (x,) in _table(data, stco, 4, 1)]
        else:
            count = struct.unpack_from(">I", data, co64[0] + 4)[0]
            offsets = list(struct.unpack_from(f">{count}Q", data, co64[0] + 8))
        size, count = struct.unpack_from(">II", data, stsz[0] + 4)
        sizes = [size] * count if size else [x for (x,) in _table(data, stsz, 8, 1)]
        runs = _table(data, stsc, 4, 3)
        places, sample = [], 0
        for k, (first, per, _) in enumerate(runs):
            for chunk in range(first - 1, runs[k + 1][0] - 1 if k + 1 < len(runs) else len(offsets)):
                at = offsets[chunk]
                for _n in range(per):
                    if sample >= count:
                        break
                    places.append((at, sizes[sample]))
                    at += sizes[sample]
                    sample += 1
        if sample != count or any(p + n > len(data) for p, n in places[-1:]):
            raise ValueError("samples do not fit")
        keys = [places[x - 1] for (x,) in _table(data, stss, 4, 1)] if stss else places
        joined: list[list[int]] = []
        for at, n in places:
            if joined and joined[-1][0] + joined[-1][1] == at:
                joined[-1][1] += n
            else:
                joined.append([at, n])
        out.append(Track(codec, timescale, duration, [(x, y) for x, y in joined], count, keys))
    return out


def payload(file: bytes, track: Track) -> bytes:
    return b"".join(file[a : a + n] for a, n in track.samples)


def feature():
    """codec, duration in media time, samples, keyframes and a digest of their byte ranges, from the columns of inspect()."""
    ranges = F.array_join(F.transform("keyframes", lambda x: F.concat(x["offset"].cast("string"), F.lit("+"), x["bytes"].cast("string"))), ",")
    return F.format_string("codec=%s;duration=%d/%d;samples=%d;keyframes=%d;ranges=%s", F.trim("codec"), "duration", "timescale", "samples", F.size("keyframes"), F.substring(F.sha2(ranges, 256), 1, 16))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the stored file) of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def rows(batch: pa.RecordBatch) -> list:
        data = [(t or "").encode() for t in batch.column("text").to_pylist()]
        return [batch.column("doc_id").cast(pa.int64()), [len(x) for x in data], [encode(padded(x)) for x in data]]

    return docs.select("doc_id", "text").mapInArrow(arrow_rows(schema, rows, 512), "doc_id long, n_bytes long, media binary")


def inspect(files: DataFrame) -> DataFrame:
    """Digests of stored files (doc_id, n_bytes, media), their payload read back by byte ranges; codec, timescale, duration, samples and keyframes; the feature."""
    keys = pa.list_(pa.struct([("offset", pa.int64()), ("bytes", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", keys)])

    def rows(batch: pa.RecordBatch) -> list:
        out: list[list] = [batch.column("doc_id"), batch.column("n_bytes"), *([] for _ in range(10))]
        for file in batch.column("media").to_pylist():
            (track,) = probe(file)
            data = payload(file, track)
            for column, value in zip(out[2:], (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(file), hashlib.sha256(file).hexdigest(), track.codec, track.timescale, track.duration, track.n_samples, [{"offset": a, "bytes": n} for a, n in track.keyframes])):
                column.append(value)
        return out

    found = files.mapInArrow(arrow_rows(schema, rows, 512), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, timescale long, duration long, samples long, keyframes array<struct<offset:long,bytes:long>>")
    return found.withColumn("feature", feature())

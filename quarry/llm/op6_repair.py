"""Token-id output in grammar-compressed binary shards with random access.

Documents are range-sorted by id and encoded; each sorted partition is cut into shards of at most
SHARD ids (a longer document has a shard of its own). In a shard, Re-Pair runs on the id sequence until no
pair of neighbours within a document occurs twice. A round counts pairs, takes those with at least one STEP-th
of the occurrences of the most frequent one and replaces them together; where occurrences overlap, the more
frequent pair wins, then the leftmost. Counts cover all neighbours at first, then those beside new
nonterminals and those still frequent, over a linked list, so a round costs what it can change, not the
length of the shard. STEP = 1 is Re-Pair one count at a time; 64 costs 2.3 % more symbols and rules on a
shard of the test documents (576,293 against 563,268) and an eightieth of the time.

A shard stores its rules, the expansion length of every rule, the symbols, the documents' symbol counts and
the id position of every MARK-th symbol, so any document or range of ids is decoded without the rest.

Shard layout, little-endian: magic RPG2, five u32 (documents, rules, symbols, high bits, first nonterminal),
then doc ids i64, null flags u8, symbol counts u32, id counts u32, rule pairs and symbols each as 16 low bits
(u16) and one bit plane for each high bit, rule lengths u8 (255: the next of the u32 list, whose number goes
before it), marks u32.

Defined cases: a null text is empty and still has the end id; a null doc_id sorts first; rows equal in
doc_id are ordered by their text; an empty table writes no shard and yields no rows.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut
from quarry.llm.op4_bpe import byte_chars

SHARD, LEAST, MARK = 1 << 20, 2, 512
#: A round replaces the pairs with at least one STEP-th of the occurrences of the most frequent one.
STEP = 64
#: Passes that settle overlapping occurrences by frequency before the rest of a run is settled by turns.
PASSES = 6
#: Bits of the word table's places; it is emptied when a quarter of them are taken. Longer words than LONG are not kept.
PLACES, LONG = 22, 64
#: Characters that are split and looked up at once.
PART = 1 << 18
#: White space, and where the byte-level pre-tokenizer's classes are enumerated (below U+0250).
_SPACES, _NARROW = "\t\n\v\f\r \x85\xa0", 0x250
_WIDE = re.compile(f"[^\x01-{chr(_NARROW - 1)}]")
_CUT = re.compile(f"[^{_SPACES}](?=[{_SPACES}])")
_LETTER, _DIGIT, _SPACE, _OTHER, _END = 1, 2, 3, 4, 5
_CLASS = np.full(_NARROW, _OTHER, np.uint8)
for _c in range(_NARROW):
    _CLASS[_c] = {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(chr(_c))[0], _OTHER)
_CLASS[[ord(c) for c in _SPACES]] = _SPACE
_CLASS[0] = _END  # between texts
_VALUE = np.random.default_rng(8).integers(1, 1 << 63, _NARROW, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _ramp(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_starts(chars: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokenizer's words begin in joined texts (character numbers, 0 behind each text).

    Of a run of white space before a visible character the last is apart from the others; a space there opens the next word.
    """
    kind = _CLASS[chars]
    behind = np.empty_like(kind)
    behind[0], behind[1:] = _END, kind[:-1]
    start = kind != behind
    space = kind == _SPACE
    ahead = np.empty_like(kind)
    ahead[-1], ahead[:-1] = _END, kind[1:]
    start |= space & (ahead != _SPACE) & (ahead != _END)
    blank = np.zeros_like(start)
    blank[1:] = chars[:-1] == 32
    start &= ~(blank & (kind != _SPACE) & (kind != _END))
    mark = np.flatnonzero((chars == 39) & start)  # an apostrophe that opens a word, before the letters of a contraction
    mark = mark[mark + 2 < len(chars)]
    if len(mark):
        one, two = chars[mark + 1], chars[mark + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = one.astype(np.int64) << 16 | two
        long = np.isin(pair, [ord(a) << 16 | ord(b) for a, b in ("re", "ve", "ll")])
        found = short | long
        start[mark[found] + 1] = False
        start[mark[found] + 2 + long[found]] = True
    return np.flatnonzero(start)


def parts(text: str, size: int):
    """A text in parts of about ``size`` characters, cut before white space behind a visible character: always between words."""
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:]


class Encoder:
    """Ids of whole texts, equal to the tokenizers library's for a byte-level file.

    Texts are joined, split into words by array operations, and words looked up by a 64-bit hash and their
    length; words not met before are merged by tiktoken with ranks from the file's vocabulary (whose ids follow the merges).
    Texts with special tokens, with characters from U+0250 or with the character 0 go through the library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        byte = {c: b for b, c in enumerate(byte_chars())}
        ranks = {bytes(byte[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if i not in added}
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.powers = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.clear()

    def clear(self) -> None:
        """Empties the table: a hash at each taken place, and the number of its word; words' ids lie end to end."""
        self.hashes, self.numbers = np.zeros(1 << PLACES, np.uint64), np.zeros(1 << PLACES, np.int32)
        self.known, self.ids, self.filled = 0, np.zeros(1 << 16, np.uint32), 0
        self.first, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 if it is not in the table."""
        at = (hashes >> np.uint64(64 - PLACES)).astype(np.int64)
        held = self.hashes[at]
        out = np.where((held == hashes) & (hashes != 0), self.numbers[at], -1)
        open_ = np.flatnonzero((held != hashes) & (held != 0) & (hashes != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (1 << PLACES) - 1
            held = self.hashes[at[open_]]
            same = held == hashes[open_]
            out[open_[same]] = self.numbers[at[open_[same]]]
            open_ = open_[~same & (held != 0)]
        return out

    def add(self, hashes: np.ndarray, words: list[list[int]]) -> np.ndarray:
        """Numbers of new words; those with hash 0 are kept for this call's texts only."""
        n, lengths = len(words), np.array([len(w) for w in words], np.int64)
        flat = np.fromiter(itertools.chain.from_iterable(words), np.uint32, int(lengths.sum()))
        while self.known + n > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        while self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        numbers = np.arange(self.known, self.known + n)
        self.ids[self.filled : self.filled + len(flat)] = flat
        self.count[numbers] = lengths
        self.first[numbers] = self.filled + np.cumsum(lengths) - lengths
        self.known, self.filled = self.known + n, self.filled + len(flat)
        open_ = np.flatnonzero(hashes)
        at = (hashes >> np.uint64(64 - PLACES)).astype(np.int64)
        while len(open_):
            free = open_[self.hashes[at[open_]] == 0]
            self.hashes[at[free]] = hashes[free]  # of several for one place the last stays
            self.numbers[at[free]] = numbers[free]
            open_ = open_[self.hashes[at[open_]] != hashes[open_]]
            at[open_] = (at[open_] + 1) & (1 << PLACES) - 1
        return numbers

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        found: list[list[np.ndarray]] = [[] for _ in texts]
        whole, held, owner, size = [], [], [], 0

        def flush() -> None:
            for k, ids in zip(owner, self.narrow(held) if held else []):
                found[k].append(ids)
            held.clear()
            owner.clear()

        for k, text in enumerate(texts):
            if text and (_WIDE.search(text) or any(s in text for s in self.special)):
                whole.append(k)
                continue
            for part in parts(text or "", PART):
                held.append(part)
                owner.append(k)
                size += len(part) + 1
                if size >= PART:
                    flush()
                    size = 0
        flush()
        for k, got in zip(whole, self.tokenizer.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False)):
            found[k] = [np.array(got.ids, np.uint32)]
        return [ids[0] if len(ids) == 1 else np.concatenate(ids) for ids in found]

    def narrow(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts whose characters are all from 1 to below _NARROW."""
        if self.known << 2 > 1 << PLACES:
            self.clear()
        joined = "\0".join(texts) + "\0"
        chars = np.frombuffer(joined.encode("utf-16-le"), np.uint16)
        if len(chars) > len(self.powers[0]):
            self.powers = _ramp(_BASE, 2 * len(chars)), _ramp(pow(_BASE, -1, 1 << 64), 2 * len(chars))
        starts = word_starts(chars)
        ends = np.r_[starts[1:], len(chars)]
        total = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(_VALUE[chars] * self.powers[0][: len(chars)], out=total[1:])
        hashes = (total[ends] - total[starts]) * self.powers[1][starts] + (ends - starts).astype(np.uint64)
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(29)
        hashes[ends - starts > LONG] = 0  # a long word is merged each time
        numbers = self.find(hashes)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            known, back = np.unique(hashes[new].view(np.int64), return_index=True, return_inverse=True)[1:]
            lone = np.flatnonzero(hashes[new] == 0)
            if len(lone):  # not the same word for being hashed alike
                known = np.concatenate([known, lone])
                back[lone] = len(known) - len(lone) + np.arange(len(lone))
            at = new[known]
            words = [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            numbers[new] = self.add(hashes[at], [[] if w[0] == "\0" else self.merge(w) for w in words])[back]
        counts = self.count[numbers]
        edges = np.cumsum(counts)
        flat = self.ids[np.repeat(self.first[numbers] - edges + counts, counts) + np.arange(int(edges[-1]))]
        stops = np.r_[0, edges][np.searchsorted(starts, np.flatnonzero(chars == 0), "right")]
        return np.split(flat, stops[:-1])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _settle(prio: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Which occurrences are replaced: ``link[k]`` says that occurrence k overlaps k - 1; higher ``prio`` first, then the leftmost.

    Runs that PASSES passes leave open (many occurrences in ascending frequency) are settled by turns.
    """
    take = np.zeros(len(prio), bool)
    open_, p, ties = np.arange(len(prio)), prio, link
    for _ in range(PASSES):
        over = (p[1:] > p[:-1]) & ties[1:]  # wins over its left neighbour
        under = (p[:-1] >= p[1:]) & ties[1:]  # wins over its right neighbour
        win = np.ones(len(p), bool)
        win[1:] &= over | ~ties[1:]
        win[:-1] &= under | ~ties[1:]
        take[open_[win]] = True
        free = ~win
        free[1:] &= ~(win[:-1] & ties[1:])
        free[:-1] &= ~(win[1:] & ties[1:])
        some = np.flatnonzero(free)
        if not len(some):
            return take
        ties = ties[some] & np.r_[False, some[1:] == some[:-1] + 1]
        open_, p = open_[some], p[some]
    begins = np.flatnonzero(~ties)
    runs = np.zeros(len(p), np.int64)
    runs[begins] = begins
    take[open_[(np.arange(len(p)) - np.maximum.accumulate(runs)) % 2 == 0]] = True
    return take


def _by_pair(left: np.ndarray, right: np.ndarray, place: np.ndarray, top: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in ascending order as one number each, and their places; ``top`` bounds the symbols and ``n`` the places."""
    b, c = max(1, (top - 1).bit_length()), max(1, (n - 1).bit_length())
    pair = left.astype(np.int64) << b | right
    if 2 * b + c <= 63:  # one sort of numbers that carry their place
        mixed = np.sort(pair << c | place)
        return mixed >> c, mixed & (1 << c) - 1
    order = np.argsort(pair)
    return pair[order], place[order]


def compress(ids: np.ndarray, ends: np.ndarray, first: int, least: int = LEAST, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of ``ids``; ``ends`` marks the last id of each document; nonterminals count from ``first``.

    Returns symbols, their end marks, rule pairs (r, 2) and rule expansion lengths.
    """
    n = len(ids)
    seq, closed = ids.astype(np.int64), ends.copy()  # closed: the last of its document, or swallowed
    dead = np.zeros(n, bool)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    active = np.flatnonzero(~closed)
    rules, size = [np.empty((0, 2), np.int64)], np.ones(first, np.int64)
    rank_at = np.zeros(n, np.int32)
    while len(active):
        bits = max(1, (len(size) - 1).bit_length())
        pairs, place = _by_pair(seq[active], seq[after[active]], active, len(size), n)
        edges = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        counts = np.diff(np.r_[edges, len(pairs)])
        most = int(counts.max())
        frequent = np.flatnonzero(counts >= least)
        enough = np.repeat(counts >= least, counts)
        now = frequent[counts[frequent] >= max(least, -(-most // step))]
        now = now[np.argsort(-counts[now], kind="stable")]  # the most frequent first
        ranks = np.zeros(len(counts), np.int32)
        ranks[now] = np.arange(len(now), 0, -1)
        ranked = np.repeat(ranks, counts)
        later = place[enough & (ranked == 0)]  # for a later round, when counts have fallen
        hit = ranked > 0
        spots = place[hit]
        rank_at[spots] = ranked[hit]
        spots = np.sort(spots)
        prio = rank_at[spots]
        rank_at[spots] = 0
        link = np.zeros(len(spots), bool)
        link[1:] = after[spots[:-1]] == spots[1:]
        take = _settle(prio, link)
        paying = np.bincount(prio[take], minlength=len(now) + 1) >= least  # overlaps may leave a pair too rare
        take &= paying[prio]
        spot, used = spots[take], np.flatnonzero(paying)
        if not len(spot):
            if most < least * step:
                break
            active = np.sort(later)
            continue
        name = np.zeros(len(paying), np.int64)
        name[used] = len(size) + np.arange(len(used))
        pair = pairs[edges[now[len(now) - used]]]
        pair = np.stack([pair >> bits, pair & (1 << bits) - 1], 1)
        gone = after[spot]
        seq[spot], closed[spot] = name[prio[take]], closed[gone]
        closed[gone] = dead[gone] = True
        behind = after[gone]
        after[spot] = behind
        inner = behind < n
        before[behind[inner]] = spot[inner]
        size = np.concatenate([size, size[pair[:, 0]] + size[pair[:, 1]]])
        rules.append(pair)
        beside = before[spot]
        parts = [spot, beside[beside >= 0], spots[~take], later]
        if sum(map(len, parts)) * 16 < n:
            active = np.unique(np.concatenate(parts))
        else:
            flags = np.zeros(n, bool)
            for some in parts:
                flags[some] = True
            active = np.flatnonzero(flags)
        active = active[~closed[active]]
    return seq[~dead].astype(np.uint32), closed[~dead], np.concatenate(rules).astype(np.uint32), size[first:].astype(np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for: each nonterminal gives way to its pair at the place its expansion begins."""
    if not len(symbols):
        return np.empty(0, np.uint32)
    size = np.ones(len(symbols), np.int64)
    deep = symbols >= first
    size[deep] = lengths[symbols[deep] - first]
    ends = np.cumsum(size)
    at = ends - size
    out = np.empty(int(ends[-1]), np.uint32)
    out[at[~deep]] = symbols[~deep]
    symbols, at = symbols[deep] - first, at[deep]
    while len(symbols):
        left, right = rules[symbols, 0], rules[symbols, 1]
        step = np.ones(len(left), np.int64)
        deep = left >= first
        step[deep] = lengths[left[deep] - first]
        symbols, at = np.concatenate([left, right]), np.concatenate([at, at + step])
        deep = symbols >= first
        out[at[~deep]] = symbols[~deep]
        symbols, at = symbols[deep] - first, at[deep]
    return out


def _planes(values: np.ndarray, high: int) -> bytes:
    """Numbers as 16 low bits and ``high`` bit planes."""
    return (values & 0xFFFF).astype("<u2").tobytes() + b"".join(np.packbits(values >> 16 + k & 1).tobytes() for k in range(high))


def pack(docs: list[tuple[int | None, np.ndarray]], first: int) -> bytes:
    ids = np.concatenate([x for _, x in docs])
    counts = np.array([len(x) for _, x in docs], np.uint32)
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(counts) - 1] = True
    symbols, last, rules, lengths = compress(ids, ends, first)
    high = max(0, (first + len(rules)).bit_length() - 16)
    per = np.diff(np.r_[-1, np.flatnonzero(last)])
    size = np.r_[np.ones(first, np.uint32), lengths][symbols]
    long = lengths[lengths >= 255]
    return b"".join(
        (
            b"RPG2",
            struct.pack("<5I", len(docs), len(rules), len(symbols), high, first),
            np.array([d or 0 for d, _ in docs], "<i8").tobytes(),
            np.array([d is None for d, _ in docs], np.uint8).tobytes(),
            per.astype("<u4").tobytes(),
            counts.astype("<u4").tobytes(),
            _planes(rules.ravel(), high),
            _planes(symbols, high),
            np.minimum(lengths, 255).astype(np.uint8).tobytes(),
            struct.pack("<I", len(long)) + long.astype("<u4").tobytes(),
            (np.cumsum(size, dtype=np.int64) - size)[::MARK].astype("<u4").tobytes(),
        )
    )


class Shard:
    """A stored shard; ``document(k)`` decodes one document, ``ids(a, b)`` any range of id positions."""

    def __init__(self, data: bytes):
        if data[:4] != b"RPG2":
            raise ValueError("not a shard")
        n, r, s, high, self.first = struct.unpack_from("<5I", data, 4)
        at = 24

        def read(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        def planes(count: int) -> np.ndarray:
            out = read("<u2", count).astype(np.uint32)
            for k in range(high):
                out |= np.unpackbits(read("u1", -(-count // 8)), count=count).astype(np.uint32) << np.uint32(16 + k)
            return out

        self.doc_ids, self.nulls = read("<i8", n), read("u1", n)
        self.n_symbols, self.n_ids = read("<u4", n), read("<u4", n)
        self.rules, self.symbols = planes(2 * r).reshape(-1, 2), planes(s)
        self.lengths = read("u1", r).astype(np.int64)
        self.lengths[self.lengths == 255] = read("<u4", int(read("<u4", 1)[0]))
        self.marks = read("<u4", -(-s // MARK))
        self.at = np.r_[0, np.cumsum(self.n_symbols, dtype=np.int64)]
        self.starts = np.r_[0, np.cumsum(self.n_ids, dtype=np.int64)]

    def whole(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.lengths, self.first)

    def document(self, k: int) -> np.ndarray:
        return expand(self.symbols[self.at[k] : self.at[k + 1]], self.rules, self.lengths, self.first)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (end exclusive): only the symbols between the marks around them are read."""
        lo, hi = np.searchsorted(self.marks, a, "right") - 1, np.searchsorted(self.marks, b, "left")
        if b <= a or lo < 0:
            return np.empty(0, np.uint32)
        got = expand(self.symbols[lo * MARK : hi * MARK], self.rules, self.lengths, self.first)
        return got[a - int(self.marks[lo]) :][: b - a]


def write_shards(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """part, shard, n_ids, data: shards of the encoded texts in ascending doc_id order, as a table to write."""
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int64()), ("data", pa.binary())])

    def run(batches):
        part, shard, held, size = TaskContext.get().partitionId(), 0, [], 0

        coder = encoder(path)

        def out():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([size], pa.int64()), pa.array([pack(held, coder.size)], pa.binary())], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                for doc, ids in zip(some.column("doc_id").to_pylist(), coder.encode(some.column("text").to_pylist())):
                    ids = np.append(ids, np.uint32(end_id))
                    if held and size + len(ids) > SHARD:
                        yield out()
                        shard, held, size = shard + 1, [], 0
                    held.append((doc, ids))
                    size += len(ids)
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "part int, shard int, n_ids long, data binary")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in stored shards."""
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, number, data = (batch.column(n)[row].as_py() for n in ("part", "shard", "data"))
                shard = Shard(data)
                n = len(shard.doc_ids)
                whole = shard.whole().astype("<u4", copy=False)
                crc = [zlib.crc32(whole[a:b]) for a, b in zip(shard.starts, shard.starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64(), mask=shard.nulls.astype(bool)), pa.array(shard.starts[:-1]), pa.array(shard.n_ids.astype(np.int64)), pa.array(crc, pa.int64())], schema=schema)

    rows = shards.select("part", "shard", "data").mapInArrow(run, "part int, shard int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    # ids before a shard: those of the parts before (a table of one row for each part) and of the part's shards before
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", earlier(Window.orderBy("part")).alias("part_base"))
    bases = shards.select("part", "shard", "n_ids").withColumn("base", earlier(Window.partitionBy("part").orderBy("shard"))).drop("n_ids")
    bases = cut(bases.join(parts, "part").select("part", "shard", (F.col("base") + F.col("part_base")).alias("base")), "bases")
    return rows.join(bases, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")

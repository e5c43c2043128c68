"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

A merge is prevented from the right only by a merge of lower rank whose output begins inside its own,
so dependence runs along chains of overlapping outputs with falling ranks. ``lookahead`` adds up the
longest such chain for the whole merge list: a token is final as soon as that many symbols behind its
end are known. ``symbols_to_ids`` therefore encodes runs of any length in windows of fixed size, emits
the tokens that are stable and goes on behind them. Texts are read in pieces of about PIECE characters that end
before white space behind a visible character, which no token crosses; words seen before come from a bounded
table. ``stream`` yields the ids of a piece at a time, and digests of ids and of decoded text follow it, so beside the text
itself a document of any length takes the memory of one piece, or of one window where a word is longer. (The lookahead of
a public word file is some thousand symbols, so most words are one window.)

Decoding is a state machine from ids to text: tokens are mapped to bytes, bytes to characters by an
incremental UTF-8 decoder, so no more than one unfinished character is held. Files without a decoder
are decoded as their library does: tokens joined by spaces; the machine holds whether one has gone out.

Defined cases: a null text is empty and has no ids; special tokens in a text become their ids, as in the
library; a text without any token decodes to the empty text.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarry.llm.common import arrow_rows

PIECE = 1 << 16
TABLE = 300_000
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"[^{_SPACE}](?=[{_SPACE}])")
_NARROW = 0x250  # below it classes of characters are enumerated, so the plain regular expressions serve
_WIDE = re.compile(f"[^\\x00-\\u{_NARROW - 1:04x}]")


def _class(kind: str) -> str:
    """The characters below _NARROW whose general category begins with ``kind``, as ranges."""
    out, codes = "", [c for c in range(_NARROW) if unicodedata.category(chr(c))[0] == kind]
    for k, c in enumerate(codes):
        if k == 0 or codes[k - 1] != c - 1:
            end = c
            while end + 1 in codes:
                end += 1
            out += f"\\u{c:04x}-\\u{end:04x}"
    return out


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else 256 and up in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]], length) -> int:
    """Symbols behind a token's end that settle it; ``length`` counts the symbols of a token.

    Runs through the merges by rank; the reach of a merge is its output's length plus the largest reach
    among merges of lower rank that begin with a proper suffix of its output.
    """
    starts: dict[str, int] = {}
    most = 1
    for a, b in merges:
        out = a + b
        reach = length(out) + max((starts.get(out[k:], 0) for k in range(1, len(out))), default=0)
        for k in range(1, len(out) + 1):
            if starts.get(out[:k], 0) < reach:
                starts[out[:k]] = reach
        most = max(most, reach)
    return most


class Transducer:
    """Encoder and decoder of one tokenizer file (BPE, byte-level alphabet)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.ranks = {m: k for k, m in enumerate(merges)}
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {v: k for k, v in (self.vocab | self.special).items()}
        cut = len(self.suffix)
        self.length = (lambda t: len(t) - cut if cut and t.endswith(self.suffix) else len(t)) if cut else len
        self.lookahead = lookahead(merges, self.length)
        self.window = 4 * self.lookahead
        self.plain_decoder = spec.get("decoder") is None
        chars = byte_chars()
        self.byte_char = chars
        self.char_byte = {c: b for b, c in enumerate(chars)}
        self.token_bytes = {} if self.plain_decoder else {i: bytes(self.char_byte[c] for c in t) for i, t in self.tokens.items() if i not in set(self.special.values())}
        self.words = _Words(self)
        steps = json.dumps(spec.get("normalizer") or {})
        self.nfc, self.lower = '"NFC"' in steps, '"Lowercase"' in steps
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        letters, numbers = _class("L"), _class("N")
        if spec["pre_tokenizer"]["type"] == "ByteLevel":
            tails = "'(?:s|t|re|ve|m|ll|d)"
            self.narrow = re.compile(f" ?[{letters}]+| ?[{numbers}]+|{tails}| ?[^{_SPACE}{letters}{numbers}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
            self.wide = regex.compile(rf"{tails}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
        else:
            tails = "'(?:s|t|re|ve|m|ll|d)"
            self.narrow = re.compile(f"[{letters}]+|[{numbers}]|{tails}|[^{_SPACE}{letters}{numbers}]+")
            self.wide = regex.compile(rf"{tails}|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        self.id_names = [str(k) for k in range(max(self.tokens) + 1)]

    def symbols(self, word: str) -> list[str]:
        out = [self.byte_char[b] for b in word.encode()]
        if self.suffix and out:
            out[-1] += self.suffix
        return out

    def merge(self, parts: list[str]) -> list[str]:
        """All merges of a run, lowest rank first, leftmost among equals."""
        ranks, none = self.ranks, len(self.ranks)
        if len(parts) > 100:
            return self.merge_long(parts)
        while len(parts) > 1:
            best, pair = none, None
            for p in zip(parts, parts[1:]):
                r = ranks.get(p, none)
                if r < best:
                    best, pair = r, p
            if pair is None:
                break
            a, b = pair
            out, k, n = [], 0, len(parts)
            while k < n:
                if parts[k] == a and k + 1 < n and parts[k + 1] == b:
                    out.append(a + b)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def merge_long(self, parts: list[str]) -> list[str]:
        """As ``merge``, with a queue of pairs over a linked list: n log n."""
        ranks, n = self.ranks, len(parts)
        parts, after, before = list(parts), list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, k) for k, p in enumerate(zip(parts, parts[1:])) if (r := ranks.get(p)) is not None]
        heapq.heapify(queue)
        while queue:
            rank, k = heapq.heappop(queue)
            j = after[k]
            if parts[k] is None or j >= n or ranks.get((parts[k], parts[j])) != rank:
                continue
            parts[k] += parts[j]
            parts[j] = None
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (r := ranks.get((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(queue, (r, k))
            if before[k] >= 0 and (r := ranks.get((parts[before[k]], parts[k]))) is not None:
                heapq.heappush(queue, (r, before[k]))
        return [p for p in parts if p is not None]

    def symbols_to_ids(self, symbols: list[str]) -> list[int]:
        """Ids of a run of symbols, in windows: tokens with ``lookahead`` known symbols behind them are emitted."""
        ids: list[int] = []
        at, n = 0, len(symbols)
        while at < n:
            end = min(n, at + self.window)
            tokens = self.merge(symbols[at:end])
            for token in tokens:
                size = self.length(token)
                if end < n and at + size + self.lookahead > end:
                    break
                ids.append(self.vocab[token])
                at += size
        return ids

    def normal(self, text: str) -> str:
        if self.nfc and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("\u03a3", "\u03c3").lower()
        return text

    def pieces(self, text: str):
        """Parts of a text of about PIECE characters, cut before white space behind a visible character."""
        at = 0
        while len(text) - at > 2 * PIECE:
            m = _CUT.search(text, at + PIECE)
            if not m:
                break
            yield text[at : m.start() + 1]
            at = m.start() + 1
        yield text[at:]

    def stream(self, text: str | None):
        """Ids of a text, as one list for each piece and special token."""
        if not text:
            return
        parts = self.split.split(text) if self.split and any(t in text for t in self.special) else (text,)
        for part in parts:
            if part in self.special:
                yield [self.special[part]]
                continue
            for piece in self.pieces(part):
                piece = self.normal(piece)
                ids: list[int] = []
                for got in map(self.words.__getitem__, (self.wide if _WIDE.search(piece) else self.narrow).findall(piece)):
                    ids += got
                yield ids

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.stream(text) for i in ids]

    def decoder(self) -> Decoder:
        return Decoder(self)

    def decode(self, ids: list[int]) -> str:
        machine = Decoder(self)
        return machine.feed(ids) + machine.end()


class Decoder:
    """The state machine from ids to text: ``feed`` gives the text that ids settle, ``end`` what an unfinished character leaves."""

    def __init__(self, owner: Transducer):
        self.owner, self.begun = owner, False
        self.ends = set(owner.special.values())
        self.chars = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        tokens = self.owner.tokens
        if self.owner.plain_decoder:
            text = " ".join(map(tokens.__getitem__, ids))
            if ids and self.begun:
                text = " " + text
            self.begun = self.begun or bool(ids)
            return text
        if self.ends.isdisjoint(ids):
            return self.chars.decode(b"".join(map(self.owner.token_bytes.__getitem__, ids)))
        out = []
        for i in ids:
            if i in self.ends:
                out.append(self.end() + tokens[i])
            else:
                out.append(self.chars.decode(self.owner.token_bytes[i]))
        return "".join(out)

    def end(self) -> str:
        rest = self.chars.decode(b"", True)
        self.chars.reset()
        return rest


class _Words(dict):
    """word -> ids, filled on demand, emptied when it holds TABLE words."""

    def __init__(self, owner: Transducer):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str):
        ids = tuple(self.owner.symbols_to_ids(self.owner.symbols(word)))
        if len(word) <= 64:
            if len(self) >= TABLE:
                self.clear()
            self[word] = ids
        return ids


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of every text."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def rows(batch: pa.RecordBatch) -> list:
        coder = transducer(path)
        out: list[list] = [batch.column("doc_id").cast(pa.int64()), [], [], []] + [[]] * with_ids
        kept = []
        for text in batch.column("text").to_pylist():
            machine, said, read, n = coder.decoder(), hashlib.sha256(), hashlib.sha256(), 0
            held = []
            for ids in coder.stream(text):
                if ids:
                    said.update(((" " if n else "") + " ".join(map(coder.id_names.__getitem__, ids))).encode())
                    read.update(machine.feed(ids).encode())
                    n += len(ids)
                    if with_ids:
                        held.append(pa.array(ids, pa.int32()))
            read.update(machine.end().encode())
            out[1].append(n)
            out[2].append(said.hexdigest())
            out[3].append(read.hexdigest())
            kept += held
        if with_ids:
            lengths = [0, *out[1]]
            for k in range(1, len(lengths)):
                lengths[k] += lengths[k - 1]
            out[4] = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.concat_arrays(kept) if kept else pa.array([], pa.int32()))
        return out

    spec = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(arrow_rows(schema, rows, 512), spec)

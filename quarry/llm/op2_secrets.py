"""Secret scans with structural confirmation.

Base kinds are patterns. Further candidates are runs of base64, base64url or hex that are long enough
for the shortest base secret, on one line or wrapped over several: they are decoded and reported only if
the bytes parse as what they claim to be (a signed token's header and payload, nested DER lengths that fill
the value exactly, length-prefixed key fields, an armoured key body, or text that holds a base secret again).
A run that is no candidate as a whole is decoded at each alignment; in it, text with a base secret counts
anywhere, a DER value from one boundary (a / - _ + or a line's end) to another, key fields to a boundary.

Defined cases: a null text is empty and has no spans; spans are code points, end exclusive; overlaps
between kinds are all kept; texts of any length are scanned whole, and decoded once for each alignment.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Order of kinds that start at the same place.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key", "inner")

#: The shortest token: 14 characters of header, {"alg":""}, 3 of body and two dots.
_LONG = re.compile(r"[^\x20\x09-\x0D]{19,}")
#: 24 characters hold 18 bytes: an access key, or token= and 12 characters.
LEAST = 24
_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
_BREAK = r"(?:\r\n?|\n|\\r\\n|\\n)[\x20\t]*"
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{2,}}+(?:{_BREAK}[A-Za-z0-9+/_-]++)+={{0,2}}")
_LINE = re.compile(_BREAK)
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----([^-]*)-----END \1-----")
_HEXRUN = re.compile(r"[0-9a-fA-F]{32,}")
#: Text of UTF-8 that is long enough for a base secret.
_UTF8 = re.compile(rb"(?:[\0-\x7F]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}){18,}+")
_SPLIT = re.compile(r"[+/_-]")
_DER_HEAD = re.compile(r"M[A-P]")
_SSH_HEAD = re.compile(r"AAAA(?:[BC]3NzaC1|E2VjZHNhLXNoYTIt)|b3BlbnNzaC1rZXktdjEA")
_STANDARD = str.maketrans("-_", "+/")
_SSH = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def b64(text: str) -> bytes | None:
    """The bytes of base64 or base64url text, padded or not; None if it is neither."""
    body = re.sub(r"\s+", "", text).rstrip("=")
    if not body or len(body) % 4 == 1 or ("-" in body or "_" in body) and ("+" in body or "/" in body):
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fills(data: bytes, depth: int = 0) -> bool:
    """Whether ``data`` is a series of DER values whose nested lengths fill it exactly."""
    at = 0
    while at < len(data):
        if at + 2 > len(data) or depth > 16:
            return False
        tag, length = data[at], data[at + 1]
        at += 2
        if tag & 0x1F == 0x1F:
            return False
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return False
            length = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + length > len(data):
            return False
        if tag & 0x20 and not der_fills(data[at : at + length], depth + 1):
            return False
        at += length
    return True


def is_der_key(data: bytes) -> bool:
    """One DER sequence, at least 24 bytes, that begins with an integer or a sequence, its lengths exact."""
    return len(data) >= 24 and data[0] == 0x30 and data[1] != 0 and der_fills(data) and _first_child(data) in (0x02, 0x30) and _one_value(data)


def _head(data: bytes) -> tuple[int, int]:
    if data[1] & 0x80:
        n = data[1] & 0x7F
        return 2 + n, int.from_bytes(data[2 : 2 + n], "big")
    return 2, data[1]


def _first_child(data: bytes) -> int:
    at, length = _head(data)
    return data[at] if length and at < len(data) else -1


def _one_value(data: bytes) -> bool:
    at, length = _head(data)
    return at + length == len(data)


def is_ssh_key(data: bytes) -> bool:
    """The wire form of a key (length-prefixed fields, an algorithm and at least one more) or an OpenSSH private key."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at = fields = 0
    while at < len(data):
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        field = data[at + 4 : at + 4 + n]
        if len(field) != n or not fields and not field.startswith(_SSH):
            return False
        at, fields = at + 4 + n, fields + 1
    return fields > 1


def _inner_secrets(inner: str) -> list[tuple[int, int]]:
    """Where a decoded text holds secrets of its own."""
    return [(start, end) for start, end, kind in base_spans(inner) if kind != "hex"] + [m.span() for m in _PEM.finditer(inner)]


def confirmed(data: bytes) -> str | None:
    if is_der_key(data) or is_ssh_key(data):
        return "key"
    try:
        inner = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return "inner" if _inner_secrets(inner) else None


def _bounds(body: str, lines: list[int]) -> tuple[list[int], list[int]]:
    """Where parts of a run may start and end, in order; ``lines`` are starts of further lines."""
    marks = [m.start() for m in _SPLIT.finditer(body)]
    return sorted({0, *lines, *(k + 1 for k in marks)}), sorted({*marks, *lines, len(body)})


def _text_parts(data: bytes, shift: int, chars: int, octets: int, size: int, bounds) -> list[tuple[int, int, str]]:
    """Parts of a run whose bytes from ``shift`` on, ``octets`` in each ``chars`` characters, are text that holds a secret."""
    parts = []
    for m in _UTF8.finditer(data):
        inner = m[0].decode()
        if not (held := _inner_secrets(inner)):
            continue
        first = m.start() + len(inner[: min(x for x, _ in held)].encode())
        last = m.start() + len(inner[: max(x for _, x in held)].encode())
        starts, ends = bounds()
        at = shift + -(-m.start() // octets) * chars
        at = min(at, shift + first // octets * chars)
        inside = bisect_left(starts, at), bisect_right(starts, shift + first // octets * chars)
        at = next((p for p in starts[slice(*inside)] if (p - shift) % chars == 0), at)
        least, most = shift - (-last * chars // octets), shift - (-m.end() * chars // octets)
        k = bisect_right(ends, most)
        end = ends[k - 1] if k and ends[k - 1] >= least else min(most, size)
        parts.append((at, end, "inner"))
    return parts


def base64_parts(body: str, lines: list[int]) -> list[tuple[int, int, str]]:
    """Confirmed parts (start, end, kind) of an unpadded run that is not confirmed as a whole."""
    plain, held = body.translate(_STANDARD), []
    bounds = lambda: held[0] if held else held.append(_bounds(body, lines)) or held[0]
    parts, streams = [], []
    for shift in range(4):
        size = len(plain) - shift - ((len(plain) - shift) % 4 == 1)
        streams.append(base64.b64decode(plain[shift : shift + size] + "=" * (-size % 4)) if size > 0 else b"")
        parts += _text_parts(streams[-1], shift, 4, 3, len(body), bounds)
    stops = set(bounds()[1]) if _DER_HEAD.search(body) or _SSH_HEAD.search(body) else set()
    if _DER_HEAD.search(body):
        starts, _ = bounds()
        for p in starts:
            if not _DER_HEAD.match(body, p):
                continue
            data = memoryview(streams[p % 4])[p // 4 * 3 :]
            if len(data) < 24 or data[1] & 0x80 and not 1 <= data[1] & 0x7F <= 4:
                continue
            n = sum(_head(data))
            if n <= len(data) and (q := p - (-n * 4 // 3)) in stops and is_der_key(data[:n]) and b64(body[p:q]) is not None:
                parts.append((p, q, "key"))
    for m in _SSH_HEAD.finditer(body):
        p = m.start()
        if m[0][0] == "b":
            parts.append((p, len(body), "key"))
            continue
        data = memoryview(streams[p % 4])[p // 4 * 3 :]
        if not bytes(data[4:23]).startswith(_SSH):
            continue
        at, end = 4 + int.from_bytes(data[:4], "big"), 0
        while at + 4 <= len(data) and (at := at + 4 + int.from_bytes(data[at : at + 4], "big")) <= len(data):
            q = p - (-at * 4 // 3)
            end = q if q in stops else end
        if end and b64(body[p:end]) is not None:
            parts.append((p, end, "key"))
    return parts


def run_parts(run: str, lines: list[int]) -> list[tuple[int, int, str]]:
    """Confirmed parts of a run of base64: the whole, or else those within it. A part that ends the run has its padding."""
    data = b64(run)
    if data and (kind := confirmed(data)):
        return [(0, len(run), kind)]
    body = run.rstrip("=")
    return [(a, len(run) if b == len(body) else b, kind) for a, b, kind in base64_parts(body, lines)]


def hex_parts(run: str, lines: list[int]) -> list[tuple[int, int, str]]:
    """The same of hex digits, which hold a key only as a whole but for one digit at either end."""
    n = len(run)
    for a, b in [(0, n)] if n % 2 == 0 else [(0, n - 1), (1, n)]:
        if kind := confirmed(bytes.fromhex(run[a:b])):
            return [(a, b, kind)]
    bounds = lambda: _bounds(run, lines)
    return [x for shift in (0, 1) for x in _text_parts(bytes.fromhex(run[shift : n - (n - shift) % 2]), shift, 2, 1, n, bounds)]


def wrapped_spans(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Confirmed parts of base64 or hex that goes on over line ends, except where a line alone has been ``found``."""
    spans = []
    for m in _WRAPPED.finditer(text):
        places, joined, lines, at = [], [], [], m.start()
        for br in [*_LINE.finditer(text, m.start(), m.end()), None]:
            end = br.start() if br else m.end()
            places.extend(range(at, end))
            joined.append(text[at:end])
            if br:
                lines.append(len(places))
                at = br.end()
        run = "".join(joined)
        if len(run.rstrip("=")) < LEAST:
            continue
        parts = run_parts(run, lines)
        if _HEXRUN.fullmatch(run):
            parts += hex_parts(run, lines)
        for a, b, kind in parts:
            start, end = places[a], places[b - 1] + 1
            if any(a < x < b for x in lines) and not any(start <= s and e <= end and k == kind for s, e, k in found):
                spans.append((start, end, kind))
    return spans


def added_spans(text: str) -> list[tuple[int, int, str]]:
    spans = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            body = "".join(x for x in m[2].replace("\\n", "\n").replace("\\r", "").splitlines() if ":" not in x)
            data = b64(body)
            if data and (is_der_key(data) or is_ssh_key(data) or "BLOCK" in m[1] or "ENCRYPTED" in m[1] or "Proc-Type" in m[2]):
                spans.append((m.start(), m.end(), "pem"))
    for run in _LONG.finditer(text):
        part, base = run[0], run.start()
        for m in _JWT.finditer(part) if part.count(".") >= 2 else ():
            try:
                head, body = (json.loads(b64(m[k]) or b"") for k in (1, 2))
            except ValueError:
                continue
            if isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict):
                spans.append((base + m.start(), base + m.end(), "jwt"))
    decoded = [(m.start() + a, m.start() + b, kind) for m in _RUN.finditer(text) for a, b, kind in run_parts(m[0], [])]
    decoded += [(m.start() + a, m.start() + b, kind) for m in _HEXRUN.finditer(text) for a, b, kind in hex_parts(m[0], [])]
    return spans + decoded + wrapped_spans(text, decoded)


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text, by start, then kind as listed in KINDS."""
    text = text or ""
    return sorted({*base_spans(text), *added_spans(text)}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _join(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, the digest of base spans and all spans, for every row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def rows(batch: pa.RecordBatch) -> list:
        out: list[list] = [batch.column("doc_id").cast(pa.int64()), [], [], [], [], [], []]
        for text in batch.column("text").to_pylist():
            spans = find_secrets(text)
            base = [s for s in spans if s[2] in KINDS[:3]]
            for k in range(3):
                out[k + 1].append(sum(s[2] == KINDS[k] for s in base))
            out[4].append(hashlib.sha256(_join(base).encode()).hexdigest())
            out[5].append(_join(spans))
            out[6].append(len(spans) - len(base))
        return out

    return docs.select("doc_id", "text").mapInArrow(arrow_rows(schema, rows), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each run of overlapping spans replaced by [SECRET:kind], the kind of its first span."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out += [text[at:start], f"[SECRET:{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in text, n_chars following it; rows without secrets stay as they are."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                texts = part.column(names.index("text")).to_pylist()
                new = [redact(t, s) if (s := find_secrets(t)) else t for t in texts]
                columns = {"text": pa.array(new, pa.string())}
                if "n_chars" in names:
                    old = part.column(names.index("n_chars"))
                    columns["n_chars"] = pa.array([o if n is t else len(n) for n, t, o in zip(new, texts, old.to_pylist())], old.type)
                arrays = [columns.get(n, part.column(k)) for k, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


__all__ = ["F", "scan", "redacted", "find_secrets", "base_spans", "added_spans", "redact"]

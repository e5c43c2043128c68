"""Chat formatting by event-sourced reconstruction.

A log has one row per event: conv_id, turn, seq, kind, role, text. It is partitioned by conversation and
turn, sorted by seq and folded into messages:
  message     opens a message of that turn with role and text
  delta       appends text to the turn's open message
  edit        replaces the text of the turn's open message
  regenerate  empties the turn's open message and discards later turns opened before this event
Each message is rendered there as one piece of output; pieces are then sorted by conversation and turn, and
discarded ones dropped:
  user        [INST] text [/INST]
  assistant   <s>text</s>
  any other   <<SYS>>role (newline) text<</SYS>>
Inside texts and roles a backslash follows the first character of every control string, and precedes
every backslash and, in roles, every newline; reading a piece undoes exactly that. Both folds stream in sorted order and
hold one message, whatever the length of a conversation. Folding and rendering are dealt by conversation and turn, so a
conversation with a large share of all rows spreads over the tasks. ``read_back`` parses pieces and digests each
conversation; a digest is sequential, so all pieces of a conversation pass through one task as a stream, which there only
parses and hashes.

Defined cases: null texts and roles are empty; events of a turn without open message open one (deltas and
edits with their role); rows equal in turn are ordered by seq, kind, role, text; null turns come first;
a null conv_id is a conversation of its own; an empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])|<(?=</?SYS>>)")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_PIECE = re.compile(r"\[INST\] (?P<user>.*) \[/INST\]|<s>(?P<assistant>.*)</s>|<<SYS>>(?P<role>(?:\\.|[^\\\n])*)\n(?P<other>.*)<</SYS>>", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """The piece of one message, and where its loss mask starts and ends."""
    body = escape(text)
    if role == "user":
        return f"[INST] {body} [/INST]", 0, 0
    if role == "assistant":
        return f"<s>{body}</s>", 3, 3 + len(body)
    return f"<<SYS>>{escape(role).replace(chr(10), chr(92) + chr(10))}\n{body}<</SYS>>", 0, 0


def parse(piece: str) -> tuple[str, str]:
    """Role and text of a piece."""
    m = _PIECE.fullmatch(piece)
    if not m:
        raise ValueError("not a rendered message")
    if m["user"] is not None:
        return "user", unescape(m["user"])
    if m["assistant"] is not None:
        return "assistant", unescape(m["assistant"])
    return unescape(m["role"]), unescape(m["other"])


def _rows(batches, names):
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _batches(rows, schema: pa.Schema, size: int = 1024):
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def fold_messages(rows):
    """Messages (conv_id, turn, opened, redone, role, text) of events sorted by conv_id, turn, seq."""
    key = None
    message: list | None = None
    for conv, turn, seq, kind, role, text in rows:
        if (conv, turn) != key:
            if message:
                yield (*key, message[0], message[1], message[2], "".join(message[3]))
            key, message = (conv, turn), None
        if message is None or kind == "message":
            if message:
                yield (*key, message[0], message[1], message[2], "".join(message[3]))
            message = [seq, None, role or "", [] if kind == "regenerate" else [text or ""]]
        elif kind == "delta":
            message[3].append(text or "")
        elif kind == "edit":
            message[3] = [text or ""]
        if kind == "regenerate":
            message[0], message[1], message[3] = seq, seq, []
    if message:
        yield (*key, message[0], message[1], message[2], "".join(message[3]))


def kept_pieces(rows):
    """Pieces sorted by conv_id, turn, opened, numbered; those that a regeneration discarded are left out."""
    conv, edge, n, first = None, None, 0, True
    turn_now, turn_edge = None, None
    for c, turn, opened, redone, piece, start, end in rows:
        if first or c != conv:
            conv, edge, n, first, turn_now, turn_edge = c, None, 0, False, turn, None
        if turn != turn_now:
            if turn_edge is not None and (edge is None or turn_edge > edge):
                edge = turn_edge
            turn_now, turn_edge = turn, None
        if redone is not None and (turn_edge is None or redone > turn_edge):
            turn_edge = redone
        if edge is not None and opened is not None and opened < edge:
            continue
        yield conv, n, piece, start, end
        n += 1


def format_log(events: DataFrame) -> DataFrame:
    """conv_id, n, piece, loss_start, loss_end: the rendered conversations, in order within each partition."""
    names = ("conv_id", "turn", "seq", "kind", "role", "text")
    long, string = pa.int64(), pa.string()
    folded = pa.schema([("conv_id", long), ("turn", long), ("opened", long), ("redone", long), ("piece", string), ("loss_start", long), ("loss_end", long), ("rank", long)])
    pieces = pa.schema([("conv_id", long), ("n", long), ("piece", string), ("loss_start", long), ("loss_end", long)])
    events = events.select(*(F.col(n).cast("long") for n in names[:3]), *(F.col(n).cast("string") for n in names[3:]))
    events = events.repartition("conv_id", "turn").sortWithinPartitions(*names)

    def fold(batches):
        # messages equal in turn and opening keep the order in which they come, by kind, role and text
        found = (m[:4] + render(m[4], m[5]) + (k,) for k, m in enumerate(fold_messages(_rows(batches, names))))
        return _batches(found, folded)

    spec = "conv_id long, turn long, opened long, redone long, piece string, loss_start long, loss_end long, rank long"
    messages = events.mapInArrow(fold, spec)
    messages = messages.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "opened", "rank").drop("rank")
    kept = messages.columns
    return messages.mapInArrow(lambda it: _batches(kept_pieces(_rows(it, kept)), pieces), "conv_id long, n long, piece string, loss_start long, loss_end long")


def digest(rows):
    """One row per conversation from its pieces in order."""
    conv, state, first = None, None, True
    for c, _, piece, start, end in rows:
        if first or c != conv:
            if not first:
                yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
            conv, state, first = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], False
        role, text = parse(piece)
        state[0] += 1
        state[1].update(f"{role}\n{text}\n".encode())
        if end > start:
            said = unescape(piece[start:end])
            state[2] += len(said)
            state[3].update(said.encode())
        state[4] += len(piece)
    if not first:
        yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def read_back(pieces: DataFrame) -> DataFrame:
    """What the output of ``format_log`` holds, read from its pieces."""
    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    names = ("conv_id", "n", "piece", "loss_start", "loss_end")
    return pieces.mapInArrow(lambda it: _batches(digest(_rows(it, names)), out), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(conversations: DataFrame) -> DataFrame:
    """Finished conversations (conv_id, turn, role, text) as a log of whole messages."""
    return conversations.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
    + len(regexp_extract_all(text, '</?s>')) + len(regexp_extract_all(text, '\[/?INST\]')) + len(regexp_extract_all(text, '<</?SYS>>')) AS body,
    length(role) + length(regexp_replace(role, '[^\\\n]', '', 'g'))
    + len(regexp_extract_all(role, '</?s>')) + len(regexp_extract_all(role, '\[/?INST\]')) + len(regexp_extract_all(role, '<</?SYS>>')) AS head
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE head + 16 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

"""Conversations as one marked text each, put together column by column.

A turn is written as ``### role: text</turn>`` and a line feed.  A backslash
before a character takes its special meaning away: backslashes and control
strings inside texts get one, so that a text that looks like a turn stays a
text and everything is read back as it was.

Rows are range partitioned by conversation and turn, so a conversation of any
length spreads over tasks; a task formats it in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.llm.common import slices

HEAD, AFTER_ROLE, END = b"### ", b": ", b"</turn>\n"
#: Control strings of the template, as they are found inside texts and roles.
CONTROL = r"(\\|### |</turn>)"
CONTROL_OF_ROLE = r"(\\|:|### |</turn>)"
TURN = re.compile(
    r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL
)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Bytes of text after which a conversation is cut into pieces.
PIECE_BYTES = 8 << 20

PIECES = (
    "part int, piece long, open boolean, n_turns long, formatted string, "
    "loss array<struct<start:long,end:long>>"
)
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths in bytes and the joined bytes of an array of strings without nulls."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset :][: len(strings) + 1]
    data = strings.buffers()[2]
    if data is None:
        return np.zeros(len(strings), np.int64), np.empty(0, np.uint8)
    joined = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return np.diff(offsets).astype(np.int64), joined


def _scatter(out: np.ndarray, at: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> None:
    """Copy segment i of ``data``, ``lengths[i]`` bytes, to ``out`` from ``at[i]`` on."""
    before = np.cumsum(lengths) - lengths
    out[np.arange(len(data)) + np.repeat(at - before, lengths)] = data


def assemble(
    roles: pa.Array, texts: pa.Array, starts: np.ndarray, trained: str = "assistant"
) -> tuple[pa.Array, pa.Array]:
    """Formatted conversations and the spans under their loss masks.

    ``starts`` holds the first row of each conversation.  Spans are code points
    of the formatted text that hold the escaped text of a ``trained`` turn.
    """
    under = pc.equal(roles, trained).to_numpy(zero_copy_only=False)
    roles = pc.replace_substring_regex(roles, CONTROL_OF_ROLE, r"\\\1")
    texts = pc.replace_substring_regex(texts, CONTROL, r"\\\1")
    (role_bytes, role_data), (text_bytes, text_data) = _bytes_of(roles), _bytes_of(texts)
    turn_bytes = role_bytes + text_bytes + len(HEAD + AFTER_ROLE + END)
    offsets = np.concatenate(([0], np.cumsum(turn_bytes)))
    head_at = offsets[:-1]
    role_at = head_at + len(HEAD)
    after_at = role_at + role_bytes
    text_at = after_at + len(AFTER_ROLE)
    buffer = pa.allocate_buffer(int(offsets[-1]))
    out = np.frombuffer(buffer, np.uint8)
    for at, mark in ((head_at, HEAD), (after_at, AFTER_ROLE), (text_at + text_bytes, END)):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    _scatter(out, role_at, role_bytes, role_data)
    _scatter(out, text_at, text_bytes, text_data)
    ends = np.concatenate((starts[1:], [len(roles)]))
    bounds = np.concatenate((offsets[starts], offsets[-1:])).astype(np.int32)
    formatted = pa.Array.from_buffers(
        pa.string(), len(starts), [None, pa.py_buffer(bounds.tobytes()), buffer]
    )
    # The same lengths in code points give the spans.
    role_chars, text_chars = (pc.utf8_length(a).to_numpy().astype(np.int64) for a in (roles, texts))
    turn_chars = role_chars + text_chars + len(HEAD + AFTER_ROLE + END)
    begin = np.cumsum(turn_chars) - turn_chars
    begin = begin - np.repeat(begin[starts], ends - starts)
    text_begin = begin + len(HEAD + AFTER_ROLE) + role_chars
    counts = np.concatenate(([0], np.cumsum(under)))
    loss = pa.ListArray.from_arrays(
        pa.array(np.concatenate((counts[starts], counts[-1:])), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(text_begin[under]), pa.array((text_begin + text_chars)[under])],
            fields=list(_SPAN),
        ),
    )
    return formatted, loss


def _firsts(ids: pa.Array) -> np.ndarray:
    """Places where a run of equal ids begins; null equals null."""
    if len(ids) == 0:
        return np.empty(0, np.int64)
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False)
    differ = pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b)))
    return np.concatenate(([0], np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1))


def _pieces(batches: Iterator[pa.RecordBatch], piece_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows as formatted pieces; the last conversation waits for its next rows."""
    held: pa.RecordBatch | None = None
    # "Open" conversations may have pieces elsewhere: the first and the last of the task, and cut ones.
    first, cut, number = True, False, 0

    def written(rows: pa.RecordBatch, starts: np.ndarray, last_open: bool) -> pa.RecordBatch:
        nonlocal first, cut, number
        formatted, loss = assemble(rows.column("role"), rows.column("text"), starts)
        opened = np.zeros(len(starts), bool)
        opened[0] = first or cut
        opened[-1] |= last_open
        ends = np.concatenate((starts[1:], [rows.num_rows]))
        out = pa.RecordBatch.from_arrays(
            [
                rows.column("conv_id").take(pa.array(starts)),
                rows.column("part").take(pa.array(starts)),
                pa.array(np.arange(number, number + len(starts))),
                pa.array(opened),
                pa.array(ends - starts),
                formatted,
                loss,
            ],
            names=["conv_id", "part", "piece", "open", "n_turns", "formatted", "loss"],
        )
        first, cut, number = False, False, number + len(starts)
        return out

    for batch in batches:
        for part in slices(batch, "text"):
            rows = pa.concat_batches([held, part]) if held is not None else part
            starts = _firsts(rows.column("conv_id"))
            tail = int(starts[-1])
            if tail:
                yield written(rows.slice(0, tail), starts[:-1], False)
            held = rows.slice(tail)
            if held.nbytes >= piece_bytes:
                yield written(held, np.zeros(1, np.int64), True)
                cut, held = True, None
    if held is not None:
        yield written(held, np.zeros(1, np.int64), True)


def format_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """One row per conversation, or per piece of it: id, turns, formatted text and loss spans.

    Turns stand in ascending order, null first, equal ones by role and text;
    repeated rows are turns of their own.  A null role or text is empty, a null
    id is an id like any other.  Other columns are not read, whatever their
    names.  A conversation whose texts exceed ``piece_bytes`` or that crosses the
    border of two tasks has several pieces, in the order of (part, piece);
    ``open`` tells which rows may have others.  Spans count from the piece's start.
    An empty table gives an empty table.
    """
    named = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    # Bounds hold the start of a text only: the driver samples them.
    dealt = named.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
    ordered = dealt.sortWithinPartitions(*order).select(
        "conv_id", "role", "text", F.spark_partition_id().alias("part")
    )
    kind = named.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(lambda b: _pieces(b, piece_bytes), f"conv_id {kind}, {PIECES}")


class _Reader:
    """Digests of one conversation, fed piece by piece."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def feed(self, formatted: str, loss: list[dict]) -> None:
        at = 0
        for turn in TURN.finditer(formatted):
            if turn.start() != at:
                break
            at = turn.end()
            role, text = unescape(turn[1]), unescape(turn[2])
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        if at != len(formatted):
            raise ValueError("a formatted conversation does not end with a turn")
        for span in loss:
            text = unescape(formatted[span["start"] : span["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.formatted_chars += len(formatted)

    def row(self) -> tuple:
        return (
            self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars
        )


_READ = [
    ("n_turns", pa.int64(), "long"),
    ("turns_sha256", pa.string(), "string"),
    ("loss_chars", pa.int64(), "long"),
    ("loss_sha256", pa.string(), "string"),
    ("formatted_chars", pa.int64(), "long"),
]


def _read_closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations read where they are; open pieces go on with their text."""
    for batch in batches:
        for part in slices(batch, "formatted"):
            texts, masks = part.column("formatted").to_pylist(), part.column("loss").to_pylist()
            found = []
            for i, opened in enumerate(part.column("open").to_pylist()):
                reader = _Reader()
                if not opened:
                    reader.feed(texts[i], masks[i])
                    texts[i] = masks[i] = None
                found.append(reader.row())
            columns = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in ("conv_id", "part", "piece", "open")),
                    pa.array(texts, pa.string()),
                    pa.array(masks, part.column("loss").type),
                    *(pa.array(v, t) for v, (_, t, _) in zip(columns, _READ, strict=True)),
                ],
                names=["conv_id", "part", "piece", "open", "formatted", "loss", *(n for n, _, _ in _READ)],
            )


def _read_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, one conversation after the other; memory holds one slice."""
    names = ["conv_id", *(n for n, _, _ in _READ)]
    reader, current, kind = None, None, None

    def whole() -> pa.RecordBatch:
        arrays = [pa.array([current], kind), *(pa.array([v], t) for v, (_, t, _) in zip(reader.row(), _READ))]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for batch in batches:
        for part in slices(batch, "formatted"):
            opened = part.column("open").to_numpy(zero_copy_only=False)
            closed = part.filter(pa.array(~opened))
            if closed.num_rows:
                yield closed.select(names)
            kind = part.schema.field("conv_id").type
            for i in np.flatnonzero(opened).tolist():
                conv = part.column("conv_id")[i].as_py()
                if reader is not None and conv != current:
                    yield whole()
                    reader = None
                if reader is None:
                    reader, current = _Reader(), conv
                reader.feed(part.column("formatted")[i].as_py(), part.column("loss")[i].as_py())
    if reader is not None:
        yield whole()


def read_conversations(pieces: DataFrame) -> DataFrame:
    """What the formatted pieces say, one row per conversation.

    Turns are parsed from the formatted text, trained text is taken from under
    the loss spans; both are unescaped.  Digests: role, line feed, text, line
    feed of every turn; all trained text.  Whole conversations are read in
    place; only open pieces move.  The pieces of one conversation are hashed one
    after the other, as such a digest must be, and none is held longer.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    read = ", ".join(f"{n} {t}" for n, _, t in _READ)
    closed = pieces.mapInArrow(
        _read_closed,
        f"conv_id {kind}, part int, piece long, open boolean, formatted string, "
        f"loss array<struct<start:long,end:long>>, {read}",
    )
    together = closed.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return together.mapInArrow(_read_open, f"conv_id {kind}, {read}")

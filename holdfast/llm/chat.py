r"""Chat formatting by columnar byte assembly.

Rows of a conversation, in the order of turn (null first; ties by role, then text), become one string

    <|im_start|>role NEWLINE text <|im_end|> NEWLINE ...

Control strings inside roles and texts are broken by a backslash after their first character, backslashes are doubled and a
newline in a role gets a backslash in front, so that the output holds no control string but its own and can be read back.
For a batch of rows the lengths of all segments are known first; their running sum gives every segment's place, and numpy
scatters headers and contents into one buffer that becomes the Arrow column. The loss mask is the list of byte spans of the
assistant texts.

A conversation of more than about ``piece_bytes`` comes in several rows, numbered by ``piece`` from 0, next to each other and in
order; a turn is never cut. So a task holds one piece at a time, and Spark's sort spills what it cannot hold. A conversation is
formatted by one task, from its first turn to its last.

Null role or text: empty. A row with a null conv_id is a conversation of its own. An empty table gives an empty result.
Repeated rows are turns of their own. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import prepare, quoted

# fixed values: the template's marks, and the marks of other common templates, which texts must not smuggle in
START, END = b"<|im_start|>", b"<|im_end|>\n"
CONTROL = (
    r"(<)(\||s>|/s>|<SYS>>|</SYS>>|bos>|eos>|pad>|unk>|start_of_turn>|end_of_turn>)"
    r"|(\[)(INST\]|/INST\]|SYSTEM_PROMPT\]|/SYSTEM_PROMPT\]|AVAILABLE_TOOLS\]|/AVAILABLE_TOOLS\]|TOOL_CALLS\]|TOOL_RESULTS\]|/TOOL_RESULTS\])"
)
LOSS_ROLE = "assistant"
TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
SCHEMA = "conv_id long, piece int, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"
#: bytes of roles and texts, before they are escaped, from which a conversation gets another piece
PIECE_BYTES = 64 << 20


def escape(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(texts, "\\", "\\\\")
    return pc.replace_substring_regex(texts, CONTROL, r"\1\3\\\2\4")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and the length of each value."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return (whole[ends[0]:ends[-1]], np.diff(ends)) if len(texts) else (whole[:0], np.empty(0, np.int64))


def assemble(rows: pa.Table, piece: int = 0) -> pa.RecordBatch:
    """Conversations, their rows next to each other and in order, to one row each. ``piece``: number of the first one's piece;
    the others begin here."""
    conv = rows.column("conv_id").combine_chunks()
    roles = escape(pc.fill_null(rows.column("role"), "").combine_chunks())
    roles = pc.replace_substring(roles, "\n", "\\\n")
    texts = escape(pc.fill_null(rows.column("text"), "").combine_chunks())
    role_bytes, role_len = flat(roles)
    text_bytes, text_len = flat(texts)
    n = rows.num_rows
    lengths = np.stack([np.full(n, len(START)), role_len, np.ones(n, np.int64), text_len, np.full(n, len(END))], axis=1)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = offsets[:-1].reshape(n, 5)
    out = np.empty(offsets[-1], np.uint8)
    for column, mark in ((0, START), (2, b"\n"), (4, END)):
        out[at[:, column, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    for column, source, length in ((1, role_bytes, role_len), (3, text_bytes, text_len)):
        moved = np.repeat(at[:, column] - (np.cumsum(length) - length), length)
        out[moved + np.arange(len(source))] = source
    first = new_group(rows)
    pieces = np.zeros(len(first), np.int32)
    pieces[0] = piece
    starts = np.append(at[first, 0], offsets[-1]).astype(np.int64)
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(starts), pa.py_buffer(out)).cast(pa.string())
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    loss = pc.equal(pc.fill_null(rows.column("role"), ""), LOSS_ROLE).to_numpy().astype(bool)
    begin = at[:, 3] - starts[group]
    spans = np.concatenate([[0], np.cumsum(np.bincount(group[loss], minlength=len(first)))]).astype(np.int32)
    return pa.RecordBatch.from_arrays([
        conv.take(pa.array(first)), pa.array(pieces), pa.array(np.bincount(group, minlength=len(first)).astype(np.int64)), formatted,
        pa.ListArray.from_arrays(spans, pa.array(begin[loss])), pa.ListArray.from_arrays(spans, pa.array((begin + text_len)[loss])),
    ], ["conv_id", "piece", "n_turns", "formatted", "loss_starts", "loss_ends"])


def keys_of(rows: pa.Table) -> np.ndarray:
    """Conversation of each row: its id, or the number that a row without one has."""
    none = rows.column("conv_id").is_null().to_numpy()
    number = pc.coalesce(rows.column("conv_id"), rows.column("own")).to_numpy()
    return np.stack([none.astype(np.int64), number])


def new_group(rows: pa.Table) -> np.ndarray:
    """Row numbers at which a conversation begins."""
    keys = keys_of(rows)
    return np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))


def format_batches(batches: Iterator[pa.RecordBatch], piece_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Sorted rows to conversations; the last one of a batch waits for the next batch, which may continue it."""
    held: list[pa.Table] = []
    piece, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        keys = keys_of(rows)
        # what is held, or has left in pieces, ends where another conversation begins
        if last is not None and (keys[:, 0] != last).any():
            if held:
                yield assemble(pa.concat_tables(held).combine_chunks(), piece)
            held, piece = [], 0
        last = keys[:, -1]
        begin = int(new_group(rows)[-1])
        if begin:
            yield assemble(pa.concat_tables([*held, rows.slice(0, begin)]).combine_chunks(), piece)
            held, piece = [], 0
        held.append(rows.slice(begin))
        while held and sum(x.nbytes for x in held) >= piece_bytes:
            yield assemble(pa.concat_tables(held).combine_chunks(), piece)
            held, piece = [], piece + 1
    if held:
        yield assemble(pa.concat_tables(held).combine_chunks(), piece)


def format_chat(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """conv_id, piece, n_turns, formatted, loss_starts and loss_ends (byte offsets into formatted), a row per conversation or,
    of a very long one, per piece."""
    prepare(turns.sparkSession)
    ident = quoted(conv_id).cast("long")
    rows = turns.select(
        ident.alias("conv_id"), F.when(ident.isNull(), F.monotonically_increasing_id()).alias("own"), quoted(turn).alias("turn"),
        quoted(role).cast("string").alias("role"), quoted(text).cast("string").alias("text"))
    ordered = rows.repartition("conv_id", "own").sortWithinPartitions("conv_id", "own", "turn", "role", "text")
    return ordered.select("conv_id", "own", "role", "text").mapInArrow(lambda batches: format_batches(batches, piece_bytes), SCHEMA)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs that a formatted conversation was made of."""
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted)]


def read_loss(formatted: str, starts: list[int], ends: list[int]) -> str:
    """All text under the loss mask, in order."""
    data = formatted.encode()
    return "".join(unescape(data[a:b].decode()) for a, b in zip(starts, ends))

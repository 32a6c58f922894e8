"""Chat formatting by columnar byte assembly.

Every turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``; a conversation's output is its turns' in order.  Within
a batch nothing is built turn by turn: the lengths of the five segments of all turns give, by a running sum, where
each segment starts, and constant headers and the columns' bytes are scattered into one preallocated Arrow buffer.

Control strings inside roles and texts are escaped: a backslash is doubled, ``<|`` becomes ``<\\|``, and in roles a
line break becomes backslash n.  So ``<|`` stands in the output only where a turn begins or ends, and
:func:`read_back` finds all turns again.  The loss mask covers the escaped texts of assistant turns, as code
points of their turn's output.

Formatting is done turn by turn, so a conversation that holds a third of all rows is spread like any other rows;
reading back streams the turns of a conversation in order and keeps only running digests.

Defined cases: null roles and texts count as empty; turns with equal numbers are ordered by their output; a null turn
stands first; rows with a null conv_id form a conversation; repeated rows are repeated turns; an empty table gives an
empty result; other columns are ignored, whatever their names.
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
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: A batch whose output would be larger is halved; Arrow's string offsets end at 2 GiB.
MOST_BYTES = 1 << 30


def _escaped(column: pa.Array, role: bool = False) -> pa.Array:
    out = pc.replace_substring(pc.replace_substring(pc.fill_null(column, ""), "\\", "\\\\"), "<|", "<\\|")
    return pc.replace_substring(out, "\n", "\\n") if role else out


_ESCAPE = re.compile(r"\\(.)", re.S)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without gaps, and the offsets of its values, from 0."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    return np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]) if data and at[-1] > at[0] else np.empty(0, np.uint8), at - at[0]


def assembled(segments: list[bytes | pa.Array], rows: int) -> pa.Array:
    """One string a row: the segments (a constant, or a string column) one after the other."""
    parts = [(np.frombuffer(s, np.uint8), None) if isinstance(s, bytes) else _bytes(s) for s in segments]
    lengths = np.stack([np.full(rows, len(data)) if at is None else np.diff(at) for data, at in parts], axis=1).astype(np.int64)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    total = int(ends[-1, -1]) if rows else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8) if total else np.empty(0, np.uint8)
    out.flags.writeable = True
    for k, (data, at) in enumerate(parts):
        if at is None:
            out[starts[:, k, None] + np.arange(len(data))] = data
        else:
            out[np.arange(len(data)) + np.repeat(starts[:, k] - at[:-1], lengths[:, k])] = data
    offsets = np.concatenate([[0], ends[:, -1]]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer(offsets), buffer])


def _formatted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if batch.num_rows > 1 and 2 * sum(batch.column(c).nbytes for c in ("role", "text")) > MOST_BYTES:
        half = batch.num_rows // 2
        yield from _formatted(batch.slice(0, half))
        yield from _formatted(batch.slice(half))
        return
    role, text = _escaped(batch.column("role"), role=True), _escaped(batch.column("text"))
    out = assembled([START.encode(), role, b"\n", text, f"{END}\n".encode()], batch.num_rows)
    learned = pc.equal(pc.fill_null(batch.column("role"), ""), LOSS_ROLE)
    begin = pc.add(pc.cast(pc.utf8_length(role), pa.int64()), len(START) + 1)
    end = pc.add(begin, pc.cast(pc.utf8_length(text), pa.int64()))
    nothing = pa.nulls(batch.num_rows, pa.int64())
    yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), out, pc.if_else(learned, begin, nothing), pc.if_else(learned, end, nothing)],
                                     names=["conv_id", "turn", "formatted", "loss_start", "loss_end"])


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, formatted, and loss_start and loss_end (code points of formatted; else null)."""
    base = conversations.select("conv_id", "turn", "role", "text")
    schema = T.StructType([base.schema["conv_id"], base.schema["turn"], T.StructField("formatted", T.StringType()),
                           T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])
    return base.mapInArrow(lambda batches: (out for batch in batches for out in _formatted(batch)), schema)



def turns_of(output: str) -> list[tuple[str, str]]:
    """The roles and texts in a formatted output; an error if it is anything but whole turns."""
    found, at = [], 0
    while at < len(output):
        head = output.index("\n", at)
        tail = output.index("<|", head)
        if not output.startswith(START, at) or not output.startswith(f"{END}\n", tail):
            raise ValueError("not a formatted conversation")
        found.append((unescaped(output[at + len(START):head]), unescaped(output[head + 1:tail])))
        at = tail + len(END) + 1
    return found


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; digests of the conversation at hand are carried from batch to batch."""
    kind, now, state, done = None, object(), None, []

    def close():
        if state:
            done.append((now, state["turns"], state["all"].hexdigest(), state["loss"], state["learned"].hexdigest(), state["chars"]))

    def flush():
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in done], k) for i, k in enumerate(kinds)], names=list(names))

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, output, begin, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
            if conv != now:
                close()
                now, state = conv, {"turns": 0, "all": hashlib.sha256(), "loss": 0, "learned": hashlib.sha256(), "chars": 0}
            for role, text in turns_of(output):
                state["all"].update(f"{role}\n{text}\n".encode())
                state["turns"] += 1
            state["chars"] += len(output)
            if begin is not None:
                learned = unescaped(output[begin:end])
                state["loss"] += len(learned)
                state["learned"].update(learned.encode())
        if done:
            yield flush()
            done.clear()
    close()
    if done:
        yield flush()


def read_back(output: DataFrame) -> DataFrame:
    """One row per conversation, from what :func:`formatted` returns: conv_id, n_turns, turns_sha256 (of role, line break,
    text, line break per turn), loss_chars, loss_sha256 (all text under the mask, unescaped), formatted_chars."""
    schema = T.StructType([output.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
                           T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    ordered = output.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(_read, schema)

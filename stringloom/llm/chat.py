"""Chat formatting by columnar byte assembly.

Turns are dealt out by conversation, sorted, and formatted in blocks: every turn is the
segments header, role, separator, content and footer. From the segments' byte lengths numpy takes the
cumulative offsets in the output, builds the scatter index of all content bytes at once
and copies headers and contents into one preallocated buffer, which becomes the data of an
Arrow string column without another copy.

The template is `<s>role` newline text `</s>` newline. Inside roles and texts every
control string of CONTROLS, and every escaped form of one, gets one more backslash after
its first character, and an end of line in a role becomes \\n; reading takes them away
again, so any text comes back as it was, and no text can close its turn.

A conversation longer than PIECE_BYTES is put out in several pieces (piece 0, 1, ...), cut
between turns, so no row and no task holds more than a bounded part of it. The loss mask is
a list of spans (start and end in code points of the piece) around the texts of the loss
roles.

Defined cases: a null text is empty; a null role is the empty role; turns with equal number
follow role and text; a null turn comes first; a null conv_id is a conversation of its own;
other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of common chat templates, this one's among them.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

_ALTERNATIVES = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True) if c[0] == "<")
_SQUARE = "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == "[")
#: first character, backslashes, rest: `<` with its rests or `[` with its rests.
PLAIN = rf"(<)(\\*)({_ALTERNATIVES})|(\[)(\\*)({_SQUARE})"
HEAD, MID, TAIL = "<s>", "\n", "</s>\n"
PIECE_BYTES = 4 << 20
SCHEMA = "conv_id long, piece int, n_turns long, formatted string, loss array<struct<start:int,end:int>>"


def escape(values: pa.Array) -> pa.Array:
    """One more backslash into every control string, escaped or not."""
    out = values
    for first, rest in (("<", _ALTERNATIVES), (r"\[", _SQUARE)):
        out = pc.replace_substring_regex(out, pattern=rf"({first})(\\*)({rest})", replacement=r"\1\\\2\3")
    return out


def unescape(text: str) -> str:
    return re.sub(PLAIN, lambda m: (m[1] or m[4]) + (m[2] or m[5] or "\\")[1:] + (m[3] or m[6]), text) if "\\" in text else text


def escape_role(values: pa.Array) -> pa.Array:
    out = pc.replace_substring(escape(values), pattern="\\", replacement="\\\\")
    return pc.replace_substring(out, pattern="\n", replacement="\\n")


def unescape_role(text: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a string column without nulls."""
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), at


def assemble(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Interleave string columns row by row into one buffer; returns it and the offset of every segment."""
    parts = [_bytes_of(c) for c in columns]
    rows, k = len(columns[0]), len(columns)
    lengths = np.stack([np.diff(at) for _, at in parts], axis=1) if rows else np.zeros((0, k), np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths.ravel())])
    out = np.empty(int(offsets[-1]), np.uint8)
    for j, (data, at) in enumerate(parts):
        source = data[at[0] : at[-1]]
        shift = offsets[:-1].reshape(rows, k)[:, j] - (at[:-1] - at[0])
        out[np.arange(len(source)) + np.repeat(shift, lengths[:, j])] = source
    return out, offsets


def format_block(conv: np.ndarray, roles: pa.Array, texts: pa.Array, loss_roles: tuple[str, ...]):
    """Turns in order to (bounds of conversations, buffer, text ends by conversation, loss spans)."""
    roles, texts = pc.fill_null(roles, ""), pc.fill_null(texts, "")
    n = len(texts)
    fixed = lambda s: pa.array([s]).take(pa.array(np.zeros(n, np.int64)))
    shown, text = escape_role(roles), escape(texts)
    out, offsets = assemble([fixed(HEAD), shown, fixed(MID), text, fixed(TAIL)])
    starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]])) if n else np.zeros(0, np.int64)
    # code points before each byte, for spans that Spark's string functions understand
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    first = offsets[:-1].reshape(n, 5)
    mask = pc.is_in(roles, pa.array(list(loss_roles))).to_numpy(zero_copy_only=False)
    base = np.repeat(points[first[starts, 0]], np.diff(np.append(starts, n))) if n else points[:0]
    return starts, out, np.append(first[starts, 0], len(out)), (points[first[:, 3]] - base, points[first[:, 4]] - base, mask)


def format_chats(turns: DataFrame, *, loss_roles: tuple[str, ...] = ("assistant",), piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(conv_id, piece, n_turns, formatted, loss) of turns (conv_id, turn, role, text)."""
    rows = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        held: list[pa.RecordBatch] = []  # turns of the conversation that may go on
        piece = 0

        def put(batch: pa.RecordBatch, number: int):
            """The batch's conversations, the first of them as piece `number`."""
            keys = batch.column("conv_id")
            conv = pc.fill_null(keys, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            starts, out, ends, (a, b, mask) = format_block(conv, batch.column("role"), batch.column("text"), loss_roles)
            formatted = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
            turns_of = np.diff(np.append(starts, len(conv)))
            in_loss = np.concatenate([[0], np.cumsum(mask)])
            spans = pa.StructArray.from_arrays([pa.array(a[mask].astype(np.int32)), pa.array(b[mask].astype(np.int32))], names=["start", "end"])
            loss = pa.ListArray.from_arrays(pa.array(in_loss[np.append(starts, len(conv))].astype(np.int32)), spans)
            pieces = np.zeros(len(starts), np.int32)
            pieces[:1] = number
            return pa.RecordBatch.from_arrays([keys.take(pa.array(starts)), pa.array(pieces), pa.array(turns_of.astype(np.int64)), formatted, loss], names=["conv_id", "piece", "n_turns", "formatted", "loss"])

        def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        last = object()
        for whole in batches:
            size = max(1, int(whole.num_rows * piece_bytes / max(1, whole.nbytes)))
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                keys = batch.column("conv_id").to_pylist()
                if held and keys[0] != last:
                    yield put(one(held), piece)
                    held, piece = [], 0
                last = keys[-1]
                cut = next((i + 1 for i in range(len(keys) - 1, -1, -1) if keys[i] != last), 0)
                if cut:  # whole conversations before the last one
                    yield put(one([*held, batch.slice(0, cut)]), piece)
                    held, piece = [], 0
                held.append(batch.slice(cut))
                if sum(x.nbytes for x in held) > piece_bytes:
                    yield put(one(held), piece)
                    held, piece = [], piece + 1
        if held:
            yield put(one(held), piece)

    return dealt.mapInArrow(run, SCHEMA)


TURN = re.compile(r"<s>([^\n]*)\n(.*?)</s>\n", re.S)


def read_chat(formatted: str, loss: list[dict]) -> tuple[list[tuple[str, str]], list[str]]:
    """The (role, text) turns and the texts under the loss mask, unescaped, of one piece."""
    turns = [(unescape_role(r), unescape(t)) for r, t in TURN.findall(formatted)]
    return turns, [unescape(formatted[s["start"] : s["end"]]) for s in loss]


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_chats(chats: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted pieces, piece by piece."""
    dealt = chats.repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def run(batches):
        import hashlib

        last, state = object(), None
        rows: list[tuple] = []

        def close():
            if state is not None:
                rows.append((last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for key, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if state is None or key != last:
                    close()
                    last, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns, under = read_chat(text, loss)
                state[0] += len(turns)
                state[4] += len(text)
                for role, said in turns:
                    state[1].update(f"{role}\n{said}\n".encode())
                for said in under:
                    state[2] += len(said)
                    state[3].update(said.encode())
            if len(rows) > 10_000:
                yield _rows(rows)
                rows.clear()
        close()
        if rows:
            yield _rows(rows)

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[x.split()[0] for x in DIGESTS.split(", ")]).cast(TARGET)

    return dealt.mapInArrow(run, DIGESTS)


TARGET = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

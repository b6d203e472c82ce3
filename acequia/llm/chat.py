r"""Chat formatting by columnar byte assembly.

A turn becomes ``<turn ROLE>\n TEXT \n</turn>\n`` (without the blanks shown
here), and a conversation its turns in order. In texts and roles a backslash is
doubled and a control string is broken by a backslash after its ``<``, so no
text can open or close a turn, and dropping each backslash's own mark gives
the text back. A line break in a role is written ``\n``. The loss mask holds
byte spans of the output that carry assistant texts.

Turns are range-partitioned by (conversation, turn), so that one conversation
with a third of all rows is spread over many tasks. Within a task they come in
Arrow batches; segment lengths, offsets and scatter indices are computed in
numpy and headers, texts and tails are copied into one preallocated buffer,
of which each output row (a chunk) is a slice. A conversation that ends inside
its batch is one ``whole`` chunk; others are several chunks, ordered by
``(first_turn, chunk)``, of which no task ever holds more than one.

Defined cases: a null text is empty, a null role is an empty role; a null
conversation id is one conversation; rows of one turn, and repeated rows, are
ordered by role, then text; a null turn comes first; an empty table gives an
empty result; further columns are ignored.
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

from acequia.llm.common import batch_of, col

OPEN, CLOSE = b"<turn ", b"</turn>"
TAIL = b"\n" + CLOSE + b"\n"
#: A control string starts with one of these.
CONTROL = (b"<turn", b"</turn")
ASSISTANT = "assistant"
#: Text bytes assembled at once; a longer single turn is assembled by itself.
BLOCK = 1 << 22

CHUNK = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("whole", T.BooleanType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("formatted", T.BinaryType()),
        T.StructField("loss", T.ArrayType(T.LongType())),
    ]
)


def escape_positions(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where a backslash goes in: before each backslash, and after a control string's ``<``.

    ``data`` holds texts one after another, ``ends`` their ends; a match lies
    within one text.
    """
    found = [np.flatnonzero(data == 0x5C)]
    angles = np.flatnonzero(data == 0x3C)
    if len(angles):
        limit = ends[np.searchsorted(ends, angles, side="right")]
        for control in CONTROL:
            fits = angles[angles + len(control) <= limit]
            same = np.ones(len(fits), bool)
            for i, byte in enumerate(control):
                same &= data[fits + i] == byte
            found.append(fits[same] + 1)
    return np.sort(np.concatenate(found))


def escaped(text: bytes) -> bytes:
    """One text escaped, by the same rule; for headers."""
    data = np.frombuffer(text, np.uint8)
    at = escape_positions(data, np.array([len(data)]))
    return np.insert(data, at, 0x5C).tobytes()


def unescaped(text: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: m[1], text, flags=re.DOTALL)


def header(role: str) -> bytes:
    return OPEN + escaped(role.encode()).replace(b"\n", b"\\n") + b">\n"


def role_of(line: bytes) -> str:
    """The role of a header without its line break."""
    inner = line[len(OPEN) : -1]
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], inner).decode()


def assemble(texts: pa.Array, roles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer: its bytes, the turns' ends, and the texts' starts and ends in it."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, buffer = texts.buffers()
    ends = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffer or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    starts, ends = ends[:-1], ends[1:]

    names, kinds = np.unique(np.array(roles, dtype=object), return_inverse=True)
    heads = [header(name) for name in names]
    head_size = np.array([len(h) for h in heads], np.int64)[kinds]
    put = escape_positions(data, ends)
    # A text's insertions lie in (start, end]: an angle's is after it, a backslash's before it.
    before = np.searchsorted(put, starts)
    after = np.searchsorted(put, ends)
    sizes = ends - starts + after - before
    turn_ends = np.cumsum(head_size + sizes + len(TAIL))
    turn_starts = np.r_[0, turn_ends[:-1]]
    text_starts = turn_starts + head_size
    out = np.empty(int(turn_ends[-1]) if len(turn_ends) else 0, np.uint8)

    # Scatter index of each text byte: its place in its text, the text's place
    # in the output, and one more for every backslash put in up to it.
    shift = np.repeat(text_starts - starts - before, ends - starts)
    index = np.arange(len(data)) + shift
    if len(put):
        marks = np.zeros(len(data) + 1, np.int32)
        marks[put] = 1
        index += np.cumsum(marks)[:-1]
        out[index[put] - 1] = 0x5C
    out[index] = data
    for kind, head in enumerate(heads):
        places = turn_starts[kinds == kind]
        out[places[:, None] + np.arange(len(head))] = np.frombuffer(head, np.uint8)
    out[(text_starts + sizes)[:, None] + np.arange(len(TAIL))] = np.frombuffer(TAIL, np.uint8)
    return out, turn_ends, text_starts, text_starts + sizes


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``BLOCK`` bytes of text each."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0)
    place = np.cumsum(size.to_numpy(zero_copy_only=False)) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def format_conversations(
    turns: DataFrame,
    *,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """Chunks of formatted conversations with their loss spans (start, end, start, end, ...)."""
    rows = turns.select(
        col(conv).cast("long").alias("conv"), col(turn).alias("turn"),
        F.coalesce(col(role), F.lit("")).alias("role"),
        F.coalesce(col(text), F.lit("")).alias("text"),
    )
    keys = ["conv", "turn", "role", "text"]
    parts = [partitions] if partitions else []
    ordered = rows.repartitionByRange(*parts, *keys[:3]).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, current = TaskContext.get().partitionId(), 0, object()
        held = None  # the last chunk, not known yet to be the end of its conversation
        for whole in batches:
            for batch in _blocks(whole):
                ids = batch.column("conv").to_pylist()
                roles = batch.column("role").to_pylist()
                out, ends, a, b = assemble(batch.column("text"), roles)
                done = [[] for _ in CHUNK.fields]
                first = 0
                for last in range(1, len(ids) + 1):
                    if last < len(ids) and ids[last] == ids[first]:
                        continue
                    begin = int(ends[first - 1]) if first else 0
                    loss = [
                        int(x) - begin
                        for i in range(first, last)
                        if roles[i] == ASSISTANT
                        for x in (a[i], b[i])
                    ]
                    # Only a conversation with another one before and after it in this
                    # task is known to have no turn elsewhere.
                    fresh = ids[first] != current
                    if held is not None:
                        held[3] = held[3] and fresh
                        for column, value in zip(done, held, strict=True):
                            column.append(value)
                    whole_so_far = fresh and number > 0
                    content = out[begin : int(ends[last - 1])].tobytes()
                    held = [ids[first], part, number, whole_so_far, last - first, content, loss]
                    number, current, first = number + 1, ids[first], last
                if done[0]:
                    yield batch_of(CHUNK, done)
        if held is not None:
            held[3] = False
            yield batch_of(CHUNK, [[v] for v in held])

    return ordered.mapInArrow(run, CHUNK)


def read_turns(formatted: bytes) -> Iterator[tuple[str, bytes]]:
    """(role, text) of each turn of a formatted chunk."""
    at = 0
    while at < len(formatted):
        line = formatted.index(b"\n", at)
        end = formatted.index(TAIL, line)
        yield role_of(formatted[at:line]), unescaped(formatted[line + 1 : end])
        at = end + len(TAIL)


DIGEST = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
    ]
)


class _Digest:
    """Running digests of one conversation; its size does not depend on the conversation's."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: bytes, loss: list[int]) -> None:
        for role, text in read_turns(formatted):
            self.all.update(role.encode() + b"\n" + text + b"\n")
            self.turns += 1
        for a, b in zip(loss[::2], loss[1::2], strict=True):
            text = unescaped(formatted[a:b])
            self.loss.update(text)
            self.loss_chars += len(text.decode())
        self.chars += len(formatted.decode())

    def row(self) -> tuple:
        return (
            self.conv, self.turns, self.all.hexdigest(),
            self.loss_chars, self.loss.hexdigest(), self.chars,
        )


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations from chunks in order, one conversation after another."""
    current = None
    for batch in batches:
        rows = []
        for row in batch.select(["conv_id", "formatted", "loss"]).to_pylist():
            if current is None or current.conv != row["conv_id"]:
                if current is not None:
                    rows.append(current.row())
                current = _Digest(row["conv_id"])
            current.add(row["formatted"], row["loss"])
        if rows:
            yield batch_of(DIGEST, list(zip(*rows, strict=True)))
    if current is not None:
        yield batch_of(DIGEST, [[v] for v in current.row()])


def conversation_digests(chunks: DataFrame) -> DataFrame:
    """Turns, loss text and sizes of each conversation, read back from the chunks.

    Whole conversations are read where they are. Chunks of the others, a few for
    each task besides those of very long conversations, are brought together by
    conversation and read as a stream.
    """
    whole = chunks.where("whole").mapInArrow(_read_back, DIGEST)
    split = chunks.where("not whole").repartition("conv_id")
    split = split.sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(_read_back, DIGEST)
    return whole.union(split)

"""Bounded-space online packing of documents into token windows.

Every document is its token ids and one end id. Whole windows are cut off a
long document at once; the rest is placed into the open window it fits best.
A task keeps a fixed number of open windows; when none fits, the fullest is
emitted and a new one opened. What is still open when a task ends, a bounded
number of windows, is merged: leftovers of a group of tasks are placed again,
longest piece first, and closed there.

Ids are those of a `tokenizers` file. If it is a byte-level BPE whose ids
follow the order of its merges, its own vocabulary is handed to `tiktoken`,
which finds the same ids in a fraction of the time; texts that spell a special
token or hold a very long word, and all texts under other tokenizers, are
encoded by `tokenizers`.

Defined cases: a null or empty text is the end id alone; repeated rows and
null ids are packed like others; an empty table gives an empty result; further
columns are ignored. Every id lies in exactly one piece.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acequia.llm.common import batch_of, col
from acequia.session import materialize

SIZE = 1024
OPEN_WINDOWS = 256
MERGE_TASKS = 64
END_ID = 0
#: Characters of a word from which `tokenizers`, whose merging is not quadratic, takes the text.
LONG_WORD = 2_000

#: Fixed values of byte-level pre-tokenisation: the pattern of its words, and
#: the bytes that stand for themselves as code points.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_RUN = re.compile(rf"\S{{{LONG_WORD}}}|\s{{{LONG_WORD}}}")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("open", T.BooleanType()),
        T.StructField("task", T.IntegerType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def _ranks(settings: dict) -> dict[bytes, int] | None:
    """The vocabulary as bytes, if its ids order the merges of a byte-level BPE."""
    before, model = settings["pre_tokenizer"] or {}, settings["model"]
    plain = (
        before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
        and settings["normalizer"] is None
        and model["type"] == "BPE"
        and not model.get("ignore_merges")
    )
    if not plain:
        return None
    hidden = sorted(set(range(256)) - set(_PRINTABLE))
    byte_of = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"] for t in settings["added_tokens"]}
    merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"]["".join(m)] for m in merged]
    if order != sorted(order):
        return None
    return {
        bytes(byte_of[c] for c in token): id
        for token, id in model["vocab"].items()
        if token not in special
    }


class Encoder:
    """Ids of texts as arrays of unsigned 32-bit numbers."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in settings["added_tokens"]]
        ranks, self.fast = _ranks(settings), None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding(
                path, pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}
            )

    def _plain(self, text: str) -> bool:
        if self.fast is None or any(t in text for t in self.special):
            return False
        return len(text) < LONG_WORD or not _LONG_RUN.search(text)

    def encode(self, text: str) -> np.ndarray:
        if self._plain(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


class Windows:
    """A fixed number of open windows; placing is best fit, the fullest goes when none fits."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.room: list[tuple[int, int]] = []  # (free ids, window), ascending
        self.held: dict[int, list] = {}
        self.closed: list[list] = []
        self.count = 0

    def place(self, length: int, piece) -> None:
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            free, window = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                _, fullest = self.room.pop(0)
                self.closed.append(self.held.pop(fullest))
            free, window = self.size, self.count
            self.count += 1
            self.held[window] = []
        self.held[window].append(piece)
        if free == length:
            self.closed.append(self.held.pop(window))
        else:
            insort(self.room, (free - length, window))

    def emitted(self) -> list[list]:
        done, self.closed = self.closed, []
        return done


def _pieces(windows: list[list], first: int, still_open: bool, task: int) -> pa.RecordBatch | None:
    """Rows of the pieces of some windows; ``first`` is the sequence id of the first window."""
    rows = []
    for number, window in enumerate(windows):
        offset = 0
        for piece in window:
            rows.append((*piece[:5], first + number, offset, still_open, task, piece[5]))
            offset += piece[2]
    return batch_of(PIECE, list(zip(*rows, strict=True))) if rows else None


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    id: str = "doc_id",
    text: str = "text",
    size: int = SIZE,
    open_windows: int = OPEN_WINDOWS,
    merge_tasks: int = MERGE_TASKS,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    ``tokenizer`` is the file of a `tokenizers` tokenizer, there on every
    executor. ``ids`` holds a piece's ids (null without ``with_ids``),
    ``ids_crc32`` their checksum. The first pass is written to the shared
    folder, so that every reader sees one packing.
    """
    rows = docs.select(col(id).cast("long").alias("doc_id"), col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder, windows = _encoder(tokenizer), Windows(size, open_windows)
        number, end = task << 36, np.array([END_ID], "<u4")
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for name, value in zip(names, batch.column("text"), strict=True):
                ids = np.append(encoder.encode(value.as_py() or ""), end)
                for start in range(0, len(ids), size):
                    own = ids[start : start + size].tobytes()
                    n = len(own) // 4
                    piece = (name, start, n, zlib.crc32(own), len(ids), own if with_ids else None)
                    if n == size:
                        windows.closed.append([piece])
                    else:
                        windows.place(n, piece)
                if len(windows.closed) >= 4096:
                    done = windows.emitted()
                    yield _pieces(done, number, False, task)
                    number += len(done)
        done = windows.emitted()
        made = _pieces(done, number, False, task)
        number += len(done)
        if made is not None:
            yield made
        left = _pieces(list(windows.held.values()), number, True, task)
        if left is not None:
            yield left

    first = materialize(rows.mapInArrow(run, PIECE), "packing")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, group, left = [*PIECE.names[:5], "ids"], None, []
        for batch in batches:
            for row in batch.to_pylist():
                if left and row["group"] != group:
                    yield _closed(left, group, size)
                    left = []
                group = row["group"]
                left.append(tuple(row[n] for n in names))
        if left:
            yield _closed(left, group, size)

    # A group's leftovers are at most merge_tasks * open_windows windows, whatever the input.
    left = first.where("open").withColumn("group", F.floor(F.col("task") / merge_tasks))
    merged = left.repartition("group").sortWithinPartitions("group").mapInArrow(merge, PIECE)
    return first.where("not open").union(merged).drop("open", "task")


def _closed(left: list[tuple], group: int, size: int) -> pa.RecordBatch:
    """Leftover pieces of a group of tasks placed again, longest first, and closed."""
    windows = Windows(size, len(left) + 1)
    for piece in sorted(left, key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1], p[3])):
        windows.place(piece[2], piece)
    done = windows.emitted() + list(windows.held.values())
    return _pieces(done, (1 << 62) + (group << 32), False, 0)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's encoder; kept between tasks with what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def sequences(pieces: DataFrame, size: int = SIZE, pad_id: int = END_ID) -> DataFrame:
    """One row per sequence: its ids, padded unless their number is a power of two."""
    whole = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias("parts")
    )
    hexes = F.concat_ws("", F.transform("parts", lambda p: F.hex(p["ids"])))
    used = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"])
    pad = F.when(F.bit_count(used) == 1, 0).otherwise(size - used).cast("int")
    pad_hex = np.array([pad_id], "<u4").tobytes().hex()
    return whole.select(
        "sequence_id",
        used.alias("n_ids"),
        pad.cast("long").alias("n_pad"),
        F.unhex(F.concat(hexes, F.repeat(F.lit(pad_hex), pad))).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"], p["start"], p["offset"], p["length"])).alias("parts"),
    )

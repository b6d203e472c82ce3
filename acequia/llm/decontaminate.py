"""Benchmark decontamination with an Aho-Corasick automaton.

The windows of all benchmark texts, normalised, make one automaton. A document
is normalised byte for byte, scanned once, and every match is mapped back to
the words, and so to the bytes, of the original text.

Words are runs of ASCII letters (lower-cased), digits and all code points from
U+0080. A window is ``window`` consecutive words of an item; a shorter item
with a word is one window. A document is contaminated if windows cover at
least one word and at least ``share`` of its words.

Defined cases: a null or empty text has no words and is clean; an item without
words has no window; items repeated or sharing windows are reported by their
distinct ids; null ids of documents are kept, items with a null id mark words
but are not listed; an empty benchmark leaves every document clean; further
columns of either table are ignored or passed through.

The windows are sent to the tasks in blocks of at most ``block_chars``
characters, compressed, so an automaton has a fixed bound. The tasks of a worker
share the automaton of a benchmark of one block; with more blocks a task takes
them in turn over a bounded number of documents, all in one stage.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acequia.llm.common import free_name, struct_array, utf8

WINDOW = 13
BLOCK_CHARS = 8_000_000
#: Documents that a task holds while it takes several blocks in turn.
CHUNK_BYTES = 64 << 20
SHARE = (1, 20)

#: Word bytes: digits, letters and everything from 0x80; all others become a blank.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
WORDS_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("contaminated", T.BooleanType()),
    ]
)
def normalise(text: bytes) -> bytes:
    """Lower-cased words between single blanks, with a blank at either end."""
    return b" " + b" ".join(text.translate(_TABLE).split()) + b" "


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word in the original bytes."""
    inside = np.frombuffer(b" " + text.translate(_TABLE) + b" ", np.uint8) != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def windows(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """Each distinct window of the benchmark with the sorted ids of its items."""
    words = F.regexp_extract_all(
        F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        F.lit(f"({WORDS_RE})"),
        F.lit(1),
    )
    items = benchmark.select(F.col(item).cast("string").alias("item"), words.alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return (
        items.where(F.size("words") > 0)
        .select("item", "words", F.explode(starts).alias("at"))
        .select("item", F.concat_ws(" ", F.slice("words", F.col("at"), size)).alias("words"))
        .groupBy("words")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def _blocks(found: DataFrame, limit: int) -> Iterator[list[tuple[str, tuple[str, ...]]]]:
    """Windows in blocks of at most ``limit`` characters each, one after another.

    ``toLocalIterator`` brings them one partition at a time; the driver holds one
    block of the benchmark's windows, never documents.
    """
    block, size = [], 0
    for row in found.toLocalIterator():
        if block and size + len(row["words"]) > limit:
            yield block
            block, size = [], 0
        block.append((row["words"], tuple(row["items"])))
        size += len(row["words"])
    if block:
        yield block


def _automaton(packed: bytes) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for words, items in pickle.loads(zlib.decompress(packed)):
        key = " " + words.encode().decode("latin-1") + " "  # one character a byte
        found.add_word(key, (words.count(" ") + 1, items))
    found.make_automaton()
    return found


#: The automaton that this worker made last, by its block's name: tasks of a worker share one of a small benchmark.
_KEPT: dict[str, ahocorasick.Automaton] = {}


def _kept(name: str, packed: bytes) -> ahocorasick.Automaton:
    if name not in _KEPT:
        _KEPT.clear()  # before the next one is made: two never live at once
        _KEPT[name] = _automaton(packed)
    return _KEPT[name]


def _hits(norm: bytes, automaton: ahocorasick.Automaton, hit: set[int], seen: set[str]) -> None:
    """Adds the hit words of a normalised text and the items that hold them."""
    matches = list(automaton.iter(norm.decode("latin-1")))
    if matches:
        blanks = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
        ends = np.searchsorted(blanks, [m[0] for m in matches]).tolist()
        for end, (_, (n, ids)) in zip(ends, matches, strict=True):
            hit.update(range(end - n, end))
            seen.update(ids)


def _judged(raw: bytes, hit: set[int], seen: set[str]) -> tuple:
    words, items = sorted(hit), sorted(seen)
    if words:
        first, end = word_spans(raw)
        n, spans = len(first), joined(words, first, end)
    else:
        n, spans = len(raw.translate(_TABLE).split()), []
    bad = bool(words) and SHARE[1] * len(words) >= SHARE[0] * n
    return n, len(words), len(items), items, spans, bad


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
    out: str = "contamination",
) -> DataFrame:
    """``docs`` with a struct ``out``: words, hit words, items, byte spans, verdict.

    ``spans`` are [first byte, end) of the hit words in the original UTF-8 text,
    neighbouring words joined. However many blocks the benchmark has, documents
    pass one Python stage: a task holds ``CHUNK_BYTES`` of them and takes the
    blocks in turn, so one automaton is in memory at a time.
    """
    context, run_name = docs.sparkSession.sparkContext, uuid.uuid4().hex
    shared = [
        context.broadcast(zlib.compress(pickle.dumps(block)))
        for block in _blocks(windows(benchmark, item, item_text, window), block_chars)
    ]
    name = free_name(docs, out)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, RESULT)])
    position = docs.columns.index(text)

    def judge(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [list(utf8(batch.column(position))) for batch in held]
        found = [[(set(), set()) for _ in own] for own in texts]
        norms = [[normalise(raw) for raw in own] for own in texts] if shared else []
        for number, block in enumerate(shared):
            automaton = _kept(f"{run_name}-{number}", block.value)
            for own, marks in zip(norms, found, strict=True):
                for norm, (hit, seen) in zip(own, marks, strict=True):
                    if len(norm) > 2:
                        _hits(norm, automaton, hit, seen)
        for batch, own, marks in zip(held, texts, found, strict=True):
            rows = [_judged(raw, *mark) for raw, mark in zip(own, marks, strict=True)]
            result = struct_array(RESULT, list(zip(*rows, strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns, result], names=[*batch.schema.names, name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            # With one block nothing is gained by waiting.
            if held and (size >= CHUNK_BYTES or len(shared) < 2):
                yield from judge(held)
                held, size = [], 0
        if held:
            yield from judge(held)

    return docs.mapInArrow(run, schema)


def joined(words: list[int], first: np.ndarray, end: np.ndarray) -> list[list[int]]:
    """Byte spans of the words, runs of consecutive words as one span."""
    at = np.asarray(words)
    cut = np.flatnonzero(np.diff(at) > 1) + 1
    begin, last = at[np.r_[0, cut]], at[np.r_[cut - 1, len(at) - 1]]
    return [[int(a), int(b)] for a, b in zip(first[begin], end[last], strict=True)]


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    name = free_name(docs, "contamination")
    marked = find_contamination(docs, benchmark, out=name, **options)
    return marked.where(~F.col(f"{name}.contaminated")).select(*docs.columns)

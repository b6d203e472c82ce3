"""Exact removal of repeated byte strings with suffix order and longest previous factors.

A byte is removed if a string of ``length`` bytes over it also starts in a
document of a smaller id; the first copy stays. Strings are judged on the
input, and none crosses documents.

Every string of ``length`` bytes has an anchor, the ``GRAM`` bytes in it with
the least hash (the leftmost, if equal). Equal strings have equal anchors at
equal places, so only strings of one anchor need to be compared, and a run of
neighbouring strings shares one: a context of at most ``2 * length - GRAM``
bytes. The work is done in two rounds over parts of the corpus of bounded size:

1. A part sends each distinct context once, as hashes of its anchor and of the
   whole, with the smallest id that holds it. Where a smaller id holds the same
   context, all its strings are repeated. Contexts that alone have their anchor
   are done with. What is left are different contexts of one anchor.
2. For those the bytes are sent. Per bucket of anchors all their strings are
   sorted (the suffix array, cut at ``length``), the common prefixes of
   neighbours give the LCP array, and the previous and the next smaller id in
   suffix order give the longest previous factor; where it reaches ``length``
   the string is repeated.

*Common passages*: the strings over the edge of a passage that very many
documents share have their anchor in the passage and a context of their own in
every document. An anchor with more than ``KINDS`` contexts in one part, or more
than ``MANY`` in all, is *split*: a part sends one mark for it instead of its
contexts, and in round 2 its strings are dealt one by one, by a hash of all
their bytes, so neither round has a group that grows with the documents.

A part then joins its repeated strings into spans and cuts them out. A string
held by very many documents is sent once by each part, not once by each
document, and copies of a document are spread over the parts by id. Contexts are
computed in both rounds; what the second finds out travels on with the answers,
so that cutting needs the texts alone. A row between the rounds holds what one
part has for one bucket, and a bucket serves ``PARTS_A_BUCKET`` parts.

Defined cases: a null text is empty; texts shorter than ``length`` stay whole;
rows of one id do not remove from each other; a null id neither removes nor
loses anything; an empty table gives an empty result; further columns are
ignored. Contexts are compared by 64-bit hashes within one anchor's bucket in
round 1, and byte by byte in round 2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acequia.llm.common import batch_of, col, utf8

LENGTH = 50
GRAM = 20
PART_BYTES = 8 << 20
PARTS_A_BUCKET = 2
#: Contexts of one anchor that one part sends, and that one bucket compares.
KINDS, MANY = 32, 1024
#: Bytes of strings that are sorted at once.
SORT_BYTES = 64 << 20
#: Bytes whose anchors are found at once.
BLOCK = 1 << 20


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each place on."""
    x = data.astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[:-shift] | (x[shift:] << np.uint64(8 * shift))
    h = x * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for at in range(8, GRAM, 8):
        at = min(at, GRAM - 8)  # the last word overlaps if 8 does not divide GRAM
        h = (h[: len(x) - at] + x[at:]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring keys."""
    done = 1
    while 2 * done <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    rest = width - done
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


@dataclass
class Contexts:
    """Contexts of the documents of a part, in order of row and place."""

    row: np.ndarray  # document
    start: np.ndarray  # first byte in it
    strings: np.ndarray  # how many strings, one byte apart
    anchor: np.ndarray  # place of the anchor in the context
    gram: np.ndarray  # hash of the anchor
    whole: np.ndarray  # hash of the context


def contexts(texts: list[bytes], length: int = LENGTH) -> Contexts:
    found: list[list[np.ndarray]] = [[] for _ in range(6)]

    def block(pieces: list[tuple[int, int, bytes]]) -> None:
        raw = b"".join(p for _, _, p in pieces)
        data = np.frombuffer(raw, np.uint8)
        sizes = np.array([len(p) for _, _, p in pieces])
        ends = np.cumsum(sizes)
        grams = _grams(data)
        place = np.arange(len(grams), dtype=np.uint64)
        low = np.uint64((1 << 24) - 1)
        first = _least((grams & ~low) | place, length - GRAM + 1) & low
        left = np.repeat(ends, sizes) - np.arange(len(data))
        at = np.flatnonzero(left >= length)
        anchors = first[at].astype(np.int64)
        cut = np.flatnonzero(np.diff(anchors)) + 1
        begin, last = at[np.r_[0, cut]], at[np.r_[cut - 1, len(at) - 1]]
        anchors = anchors[np.r_[0, cut]]
        piece = np.searchsorted(ends, begin, side="right")
        rows, offsets = (np.array(v) for v in list(zip(*pieces, strict=True))[:2])
        hashed, view = xxhash.xxh64_intdigest, memoryview(raw)
        spans = zip(begin.tolist(), (last + length).tolist(), (anchors - begin).tolist(), strict=True)
        whole = np.fromiter((hashed(view[a:b], t) for a, b, t in spans), np.uint64, len(begin))
        starts = offsets[piece] + begin - (ends - sizes)[piece]
        made = (rows[piece], starts, last - begin + 1, anchors - begin, grams[anchors], whole)
        for column, values in zip(found, made, strict=True):
            column.append(values)

    pieces, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), BLOCK):
            piece = text[at : at + BLOCK + length - 1]
            pieces.append((row, at, piece))
            size += len(piece)
            if size >= BLOCK:
                block(pieces)
                pieces, size = [], 0
    if pieces:
        block(pieces)
    kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return Contexts(*[np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(found, kinds, strict=True)])


class _Part:
    """Contexts of one part, and its distinct ones with the smallest id that holds each."""

    def __init__(self, ids: list[int | None], texts: list[bytes], buckets: int, length: int):
        self.texts, self.length = texts, length
        named = [b"" if i is None else t for i, t in zip(ids, texts, strict=True)]
        self.found = c = contexts(named, length)
        order = np.array([0 if i is None else i for i in ids], np.int64)[c.row]
        bucket = (c.gram % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((order, c.whole, c.gram, bucket))
        new_gram = np.ones(len(by), bool)
        new_gram[1:] = c.gram[by][1:] != c.gram[by][:-1]
        new = new_gram.copy()
        new[1:] |= c.whole[by][1:] != c.whole[by][:-1]
        self.kind = np.empty(len(by), np.int64)
        self.kind[by] = np.cumsum(new) - 1
        self.first = by[new]  # one context of each kind, of its smallest id
        self.bucket, self.id = bucket[self.first], order[self.first]
        self.later = order > self.id[self.kind]
        self.short = (c.gram[self.first] // np.uint64(buckets)).astype(np.uint32)
        # Anchors with too many kinds send their first one alone, as a mark.
        group = np.cumsum(new_gram[new]) - 1
        hot = (np.bincount(group) > KINDS)[group] if len(group) else np.zeros(0, bool)
        self.sent = np.flatnonzero(~hot | new_gram[new])
        self.mark = hot[self.sent].astype(np.uint8)
        self.spoken_for = np.searchsorted(self.sent, np.arange(len(group)), side="right") - 1
        self.slices = _slices(self.bucket[self.sent])


def _slices(keys: np.ndarray) -> dict[int, slice]:
    """Where each key lies in sorted ``keys``."""
    if not len(keys):
        return {}
    cut = np.flatnonzero(np.diff(keys)) + 1
    edges = np.r_[0, cut, len(keys)]
    return {int(keys[a]): slice(a, b) for a, b in zip(edges, edges[1:], strict=False)}


def _binaries(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.BinaryType()) for n in names]


_HEAD = [T.StructField("bucket", T.LongType()), T.StructField("part", T.LongType())]
_SENT = T.StructType([*_HEAD, *_binaries("gram", "whole", "ids", "mark")])
_ANSWER = T.StructType([*_HEAD, *_binaries("data")])
#: Contexts for a bucket; or, under bucket -1, what a part keeps until it cuts.
_BYTES = T.StructType([*_HEAD, *_binaries("ids", "strings", "sizes", "tags", "contexts")])
RESULT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("kept", T.BinaryType()),
    ]
)
UNIQUE, REPEATED, OPEN, SPLIT = 0, 1, 2, 3


def judge_contexts(gram: np.ndarray, whole: np.ndarray, ids: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """For each context sent to a bucket: unique, repeated as a whole, open, or of a split anchor."""
    by = np.lexsort((ids, whole, gram))
    g, w, d = gram[by], whole[by], ids[by]
    new_gram = np.r_[True, g[1:] != g[:-1]]
    new_kind = new_gram | np.r_[True, w[1:] != w[:-1]]
    group, kind = np.cumsum(new_gram) - 1, np.cumsum(new_kind) - 1
    least = d[new_kind]
    verdict = np.where(d > least[kind], REPEATED, UNIQUE).astype(np.uint8)
    # Open: the smallest ids of at least two kinds of one anchor differ.
    starts = np.flatnonzero(new_gram[new_kind])
    differ = np.minimum.reduceat(least, starts) < np.maximum.reduceat(least, starts)
    verdict[(verdict == UNIQUE) & differ[group]] = OPEN
    many = np.diff(np.r_[starts, len(least)]) > MANY
    many |= np.maximum.reduceat(mark[by], np.flatnonzero(new_gram)) > 0
    verdict[many[group]] = SPLIT
    out = np.empty_like(verdict)
    out[by] = verdict
    return out


def _previous(ids: np.ndarray, lcp: np.ndarray, length: int) -> np.ndarray:
    """Common prefix with the previous smaller id in suffix order; 0 where it falls below ``length``.

    Pointers jump over larger ids, doubling their reach; ``reach`` is the least
    common prefix jumped over.
    """
    before, reach = np.arange(len(ids)) - 1, lcp.copy()

    def waiting(at: np.ndarray) -> np.ndarray:
        at = at[(before[at] >= 0) & (reach[at] >= length)]
        return at[ids[before[at]] >= ids[at]]

    at = waiting(np.arange(len(ids)))
    while len(at):
        jump = before[at]
        reach[at], before[at] = np.minimum(reach[at], reach[jump]), before[jump]
        at = waiting(at)
    return np.where((before >= 0) & (reach >= length), reach, 0)


def longest_previous(ids: np.ndarray, lcp: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factors in suffix order, as far as they reach ``length``.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i. An earlier copy is
    one of a smaller id; the longest is met at the previous or the next smaller.
    """
    after = np.r_[0, lcp[1:][::-1]]
    return np.maximum(_previous(ids, lcp, length), _previous(ids[::-1], after, length)[::-1])


def repeated_strings(
    data: bytes, sizes: np.ndarray, strings: np.ndarray, tags: np.ndarray, ids: np.ndarray, length: int
) -> np.ndarray:
    """For contexts one after another, a bit for each string of each that a smaller id holds.

    Equal strings lie in contexts of equal ``tags``; they are sorted in batches
    of tags, of bounded bytes.
    """
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer(data, np.uint8)
    bits = np.zeros(len(sizes), np.uint64)
    batches = -(-int(strings.sum()) * length // SORT_BYTES)
    for batch in range(batches):
        own = np.flatnonzero(tags % batches == batch)
        if not len(own):
            continue
        many = strings[own]
        owner = np.repeat(own, many)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        rows = np.lib.stride_tricks.sliding_window_view(flat, length)[starts[owner] + place]
        suffixes = np.argsort(rows.view(f"S{length}").ravel(), kind="stable")
        rows = rows[suffixes]
        other = rows[1:] != rows[:-1]
        lcp = np.zeros(len(rows), np.int64)
        lcp[1:] = np.where(other.any(axis=1), other.argmax(axis=1), length)
        again = longest_previous(ids[owner[suffixes]], lcp, length) >= length
        at = suffixes[again]
        np.bitwise_or.at(bits, owner[at], np.uint64(1) << place[at].astype(np.uint64))
    return bits


def _join(parts: list, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(p, kind) for p in parts])


def remove_repeated(docs: DataFrame, *, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: id, bytes, removed bytes, their spans, and the bytes kept."""
    if not GRAM + 1 < length < GRAM + 64:  # a context holds at most 64 strings
        raise ValueError(f"length must lie between {GRAM + 2} and {GRAM + 63}")
    rows = docs.select(col(id).cast("long").alias("id"), F.coalesce(col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // PART_BYTES))  # parts of bounded size
    buckets = -(-n // PARTS_A_BUCKET)
    # Rows are spread by id, those without one by text.
    spread = F.pmod(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")), F.lit(n))
    parts = rows.withColumn("part", spread).repartition(n, "part")

    def load(table: pa.Table) -> _Part:
        return _Part(*_rows(table), buckets, length)

    def send(table: pa.Table) -> pa.Table:
        part, number = load(table), table.column("part")[0].as_py()
        whole = part.found.whole[part.first]
        made = []
        for bucket, own in part.slices.items():
            at = part.sent[own]
            arrays = (part.short[at], whole[at], part.id[at], part.mark[own])
            made.append((bucket, number, *[a.tobytes() for a in arrays]))
        return _table(_SENT, made)

    def answer(table: pa.Table) -> pa.Table:
        sent = {n: table.column(n).to_pylist() for n in _SENT.names}
        kinds = zip(("gram", "whole", "ids", "mark"), (np.uint32, np.uint64, np.int64, np.uint8), strict=True)
        verdict = judge_contexts(*[_join(sent[n], kind) for n, kind in kinds])
        ends = np.cumsum([len(x) // 8 for x in sent["ids"]])
        data = [v.tobytes() for v in np.split(verdict, ends[:-1])]
        return _table(_ANSWER, zip(sent["bucket"], sent["part"], data, strict=True))

    def send_bytes(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _table(_BYTES, [])
        part, number = load(table), table.column("part")[0].as_py()
        told = np.zeros(len(part.sent), np.uint8)
        for row in answers.to_pylist():
            told[part.slices[row["bucket"]]] = np.frombuffer(row["data"], np.uint8)
        verdict = told[part.spoken_for]
        return _table(_BYTES, _messages(part, verdict, number, buckets))

    def answer_bytes(table: pa.Table) -> pa.Table:
        sent = {n: table.column(n).to_pylist() for n in _BYTES.names}
        if sent["bucket"][0] < 0:  # a part's own notes go on to it
            return _table(_ANSWER, zip(sent["bucket"], sent["part"], sent["contexts"], strict=True))
        sizes, strings = (_join(sent[n], np.uint8).astype(np.int64) for n in ("sizes", "strings"))
        tags, ids = _join(sent["tags"], np.uint32).astype(np.int64), _join(sent["ids"], np.int64)
        bits = repeated_strings(b"".join(sent["contexts"]), sizes, strings, tags, ids, length)
        ends = np.cumsum([len(x) // 8 for x in sent["ids"]])
        data = [v.tobytes() for v in np.split(bits, ends[:-1])]
        return _table(_ANSWER, zip(sent["bucket"], sent["part"], data, strict=True))

    def cut_out(table: pa.Table, answers: pa.Table) -> pa.Table:
        made = []
        if table.num_rows:
            ids, texts = _rows(table)
            row, begin, end = _covered({r["bucket"]: r["data"] for r in answers.to_pylist()}, length)
            by = np.argsort(row, kind="stable")
            edges = np.searchsorted(row[by], np.arange(len(texts) + 1))
            for i, (name, raw) in enumerate(zip(ids, texts, strict=True)):
                own = by[edges[i] : edges[i + 1]]
                made.append((name, len(raw), *_without(raw, begin[own], end[own])))
        return _table(RESULT, made)

    sent = parts.groupBy("part").applyInArrow(send, _SENT).repartition(buckets, "bucket")
    first = sent.groupBy("bucket").applyInArrow(answer, _ANSWER).repartition(n, "part")
    noted = parts.groupBy("part").cogroup(first.groupBy("part")).applyInArrow(send_bytes, _BYTES)
    # Notes of a part lie apart from all buckets.
    apart = F.when(F.col("bucket") < 0, F.col("part")).otherwise(F.lit(-1))
    noted = noted.withColumn("note", apart).repartition(n, "bucket", "note")
    second = noted.groupBy("bucket", "note").applyInArrow(answer_bytes, _ANSWER).repartition(n, "part")
    return parts.groupBy("part").cogroup(second.groupBy("part")).applyInArrow(cut_out, RESULT)


def _rows(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """Ids and texts of a part in one order, however the shuffle delivered them."""
    rows = list(zip(table.column("id").to_pylist(), utf8(table.column("text")), strict=True))
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest(r[1])))
    return [i for i, _ in rows], [t for _, t in rows]


def _table(schema: T.StructType, rows) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema.fields]
    return pa.Table.from_batches([batch_of(schema, columns)])


def _messages(part: _Part, verdict: np.ndarray, number: int, buckets: int):
    """A part's rows for the second round: bytes for the buckets, and its own notes."""
    c, length = part.found, part.length
    notes = []
    # Contexts repeated as a whole, joined where they follow one another.
    at = np.flatnonzero(part.later | (verdict[part.kind] == REPEATED))
    row, start, end = c.row[at], c.start[at], c.start[at] + c.strings[at]
    joined = np.zeros(len(at), bool)
    joined[1:] = (row[1:] == row[:-1]) & (start[1:] == end[:-1])
    head, last = np.flatnonzero(~joined), np.r_[np.flatnonzero(~joined)[1:] - 1, len(at) - 1]
    notes.append(np.stack([row[head], start[head], end[last[: len(head)]]]) if len(at) else np.zeros((3, 0)))

    # Open contexts: the bytes of each kind, to the bucket of its anchor.
    kinds = np.flatnonzero(verdict == OPEN)
    at = part.first[kinds]
    asked = np.zeros((2, len(verdict)), np.int64)  # bucket of a kind, and place among those sent to it
    for bucket, own in _slices(part.bucket[kinds]).items():
        asked[0, kinds[own]], asked[1, kinds[own]] = bucket, np.arange(own.stop - own.start)
        cut = zip(c.row[at[own]].tolist(), c.start[at[own]].tolist(), c.strings[at[own]].tolist(), strict=True)
        rows = [part.texts[r][s : s + k + length - 1] for r, s, k in cut]
        sizes = np.array([len(x) for x in rows], np.uint8)
        yield (
            bucket, number, part.id[kinds[own]].tobytes(), c.strings[at[own]].astype(np.uint8).tobytes(),
            sizes.tobytes(), part.short[kinds[own]].tobytes(), b"".join(rows),
        )
    held = np.flatnonzero((verdict[part.kind] == OPEN) & ~part.later)
    notes.append(np.stack([c.row[held], c.start[held], c.strings[held], *asked[:, part.kind[held]]]))

    # Strings of split anchors, each distinct one once, to the bucket of a hash of all its bytes.
    at = np.flatnonzero((verdict[part.kind] == SPLIT) & ~part.later)
    owners = part.id[part.kind[at]].tolist()
    spans = zip(c.row[at].tolist(), c.start[at].tolist(), c.strings[at].tolist(), owners, strict=True)
    least: dict[bytes, int] = {}
    held, places = [], []
    for r, s, k, i in spans:
        text = part.texts[r]
        for j in range(s, s + k):
            string = text[j : j + length]
            held.append(string)
            places.append((r, j, i))
            least[string] = min(least.get(string, i), i)
    hashes = {x: xxhash.xxh64_intdigest(x) for x in least}
    order = sorted(least, key=lambda x: (hashes[x] % buckets, hashes[x], x))
    found = _slices(np.array([hashes[x] % buckets for x in order], np.int64))
    index: dict[bytes, tuple[int, int]] = {}
    for bucket, own in found.items():
        rows = order[own]
        index |= {x: (buckets + bucket, k) for k, x in enumerate(rows)}
        ones = np.ones(len(rows), np.uint8)
        yield (
            buckets + bucket, number, np.array([least[x] for x in rows], np.int64).tobytes(), ones.tobytes(),
            (ones * np.uint8(length)).tobytes(),
            np.array([hashes[x] >> 32 for x in rows], np.uint32).tobytes(), b"".join(rows),
        )
    # Where a smaller id of this very part holds the string it is repeated, else the bucket tells.
    here = [(r, j, j + 1) for (r, j, i), x in zip(places, held, strict=True) if i > least[x]]
    notes[0] = np.concatenate([notes[0], np.array(here, np.int64).reshape(-1, 3).T], axis=1)
    asks = [(r, j, 1, *index[x]) for (r, j, i), x in zip(places, held, strict=True) if i == least[x]]
    notes.append(np.array(asks, np.int64).reshape(-1, 5).T)
    packed = [np.ascontiguousarray(n, np.int64) for n in notes]
    counts = np.array([n.shape[1] for n in packed], np.int64)
    note = counts.tobytes() + b"".join(n.tobytes() for n in packed)
    yield -1, number, b"", b"", b"", b"", note


def _covered(answers: dict[int, bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last byte (exclusive) of everything repeated, from a part's notes and their answers."""
    if -1 not in answers:
        return (np.zeros(0, np.int64),) * 3
    flat = np.frombuffer(answers[-1], np.int64)
    counts, flat = flat[:3], flat[3:]
    whole, open_, single = (
        x.reshape(r, -1) for x, r in zip(np.split(flat, np.cumsum(counts * (3, 5, 5))[:-1]), (3, 5, 5), strict=True)
    )
    asked = np.concatenate([open_, single], axis=1)
    bits = np.zeros(asked.shape[1], np.uint64)
    by = np.argsort(asked[3], kind="stable")
    for bucket, own in _slices(asked[3][by]).items():
        bits[by[own]] = np.frombuffer(answers[bucket], np.uint64)[asked[4][by[own]]]
    place = np.arange(64, dtype=np.uint64)
    context, offset = np.nonzero((bits[:, None] >> place) & np.uint64(1))
    begin = asked[1][context] + offset
    return (
        np.r_[whole[0], asked[0][context]],
        np.r_[whole[1], begin],
        np.r_[whole[2] - 1, begin] + length,
    )


def _without(raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[int, list[list[int]], bytes]:
    """Removed bytes, their spans and the rest of a text, from the ranges that are repeated."""
    if not len(begin):
        return 0, [], raw
    change = np.zeros(len(raw) + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    gone = np.cumsum(change)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return int(gone.sum()), edge.reshape(-1, 2).tolist(), kept

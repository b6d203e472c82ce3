"""Exact dedup by content-defined chunk recipes.

1. Every text is cut where the hash of the last ``WINDOW`` bytes falls below a
   bound, at ``LEAST`` bytes from the last cut at the earliest and ``MOST`` at
   the latest. Cuts depend on the text alone, so equal texts have equal chunks.
   What is kept of a document is its recipe, the hashes of its chunks in order.
2. Chunks become *verified identifiers*: distinct (hash, bytes) are grouped by
   their whole bytes, combined before the shuffle, so the bytes of a chunk move
   once from a task however many documents there hold it. A hash that stands
   for one content is that content's identifier. Where a hash stands for
   several, each gets a number of its own, and the recipes that use it are
   completed by comparing bytes.
3. Ordered identifier lists are compared: texts are equal when their lists are.
   Documents themselves are not moved. A group's size and its row of the
   largest id are combined before the shuffle; the join back is one that
   adaptive execution splits where thousands of copies share a list.

Defined cases: a null text is empty, and an empty text has no chunk; of equal
texts the row of the largest id stays, of equal ids one row, and a row with a
null id only if no other has an id; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acequia.llm.common import batch_of, col, free_name, utf8
from acequia.session import materialize

WINDOW = 16
LEAST, MOST = 512, 16 << 10
#: A place is a cut if this many leading bits of its window's hash are zero.
CUT_BITS = 11
#: Bytes whose windows are hashed at once, and of chunks sent at once.
BLOCK = 1 << 20

_FACTOR = 0x9E3779B97F4A7C15
_BYTES = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
_BYTES ^= _BYTES >> np.uint64(32)
_BYTES *= np.uint64(0xD6E8FEB86659FD93)


def _places(raw: bytes) -> np.ndarray:
    """Ends of the windows in ``raw`` that are cuts, in order."""
    found = []
    for at in range(0, max(len(raw) - WINDOW + 1, 0), BLOCK):
        h = _BYTES[np.frombuffer(raw, np.uint8, min(BLOCK + WINDOW - 1, len(raw) - at), at)]
        width = 1
        while width < WINDOW:  # the hash of twice the width from two neighbours
            h = h[:-width] * np.uint64(pow(_FACTOR, width, 1 << 64)) + h[width:]
            width *= 2
        found.append(np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + at + WINDOW)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts(texts: list[bytes]) -> list[list[int]]:
    """For each text the ends of its chunks."""
    out: list[list[int]] = []

    def block(group: list[bytes]) -> None:
        places = _places(b"".join(group)).tolist()
        start = 0
        for text in group:
            end, at, own = start + len(text), start, []
            while at < end:
                # Windows over the text's own start end before the least size.
                k = bisect_left(places, at + LEAST)
                cut = places[k] if k < len(places) else end
                at = min(cut, at + MOST, end)
                own.append(at - start)
            out.append(own)
            start = end

    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= BLOCK:
            block(group)
            group, size = [], 0
    block(group)
    return out


def chunk_hash(chunk: bytes, bits: int) -> int:
    """The leading ``bits`` of a 64-bit hash, as a signed number."""
    return (xxhash.xxh64_intdigest(chunk) >> (64 - bits)) - (1 << (bits - 1))


def _documents(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple]:
    """(batch, row, text, chunks, hashes) of every row, a block of texts at a time."""
    for batch in batches:
        texts, first, size = [], 0, 0

        def told(texts=texts, batch=batch):
            for k, (text, ends) in enumerate(zip(texts, cuts(texts), strict=True)):
                chunks = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                yield batch, first + k, text, chunks, [chunk_hash(c, bits) for c in chunks]

        for text in utf8(batch.column("text")):
            texts.append(text)
            size += len(text)
            if size >= BLOCK:
                yield from told()
                first, size = first + len(texts), 0
                texts.clear()
        yield from told()


def recipes(rows: DataFrame, bits: int = 64) -> DataFrame:
    """(id, sha256, n_bytes, hashes) of every row of (id, text)."""
    schema = T.StructType(
        [
            rows.schema["id"],
            T.StructField("sha256", T.StringType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("hashes", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, batch = [], None
        for now, row, text, _, hashes in _documents(batches, bits):
            if len(made) >= 4096 or now is not batch:
                if made:
                    yield batch_of(schema, list(zip(*made, strict=True)))
                made, batch, ids = [], now, now.column("id")
            made.append((ids[row].as_py(), hashlib.sha256(text).hexdigest(), len(text), hashes))
        if made:
            yield batch_of(schema, list(zip(*made, strict=True)))

    return rows.mapInArrow(run, schema)


def chunk_rows(rows: DataFrame, bits: int = 64) -> DataFrame:
    """(id, sha256, place, hash, bytes) of every chunk of every row of (id, text)."""
    schema = T.StructType(
        [
            rows.schema["id"],
            T.StructField("sha256", T.StringType()),
            T.StructField("place", T.IntegerType()),
            T.StructField("hash", T.LongType()),
            T.StructField("bytes", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for batch, row, text, chunks, hashes in _documents(batches, bits):
            name, sha = batch.column("id")[row].as_py(), hashlib.sha256(text).hexdigest()
            for k, (chunk, h) in enumerate(zip(chunks, hashes, strict=True)):
                made.append((name, sha, k, h, chunk))
                size += len(chunk)
                if size >= BLOCK:
                    yield batch_of(schema, list(zip(*made, strict=True)))
                    made, size = [], 0
        if made:
            yield batch_of(schema, list(zip(*made, strict=True)))

    return rows.mapInArrow(run, schema)


def distinct_chunks(rows: DataFrame, bits: int = 64) -> DataFrame:
    """Distinct (hash, bytes) of all chunks; a chunk leaves a task once, without its documents."""
    schema = T.StructType([T.StructField("hash", T.LongType()), T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, chunks, size = [], [], 0
        for _, _, _, own, named in _documents(batches, bits):
            hashes += named
            chunks += own
            size += sum(map(len, own))
            if size >= BLOCK:
                yield batch_of(schema, [hashes, chunks])
                hashes, chunks, size = [], [], 0
        yield batch_of(schema, [hashes, chunks])

    return rows.select("text").mapInArrow(run, schema).groupBy("hash", "bytes").agg(F.lit(1).alias("one"))


def identified(rows: DataFrame, bits: int = 64) -> tuple[DataFrame, list[str]]:
    """(id, sha256, n_bytes, row, ids, ...) of every row, and the columns that are equal for equal texts only.

    An id is a hash that stands for one content; ``numbers`` are added where
    contents share a hash: the place and the content's number of each such chunk.
    """
    made = recipes(rows, bits).withColumn("row", F.monotonically_increasing_id())
    made = materialize(made.withColumnRenamed("hashes", "ids"), "recipes")
    distinct = distinct_chunks(rows, bits)
    shared = materialize(distinct.groupBy("hash").count().where("count > 1").select("hash"), "shared-hashes")
    if shared.isEmpty():
        return made, ["n_bytes", "ids"]
    # Rare: contents of one hash are told apart by their bytes.
    numbered = distinct.join(shared, "hash").select(
        "hash", "bytes", F.expr("row_number() over (partition by hash order by bytes)").alias("number")
    )
    told = chunk_rows(rows, bits).join(shared, "hash").join(numbered, ["hash", "bytes"])
    told = told.select("id", "sha256", "place", "number").distinct().groupBy("id", "sha256").agg(
        F.sort_array(F.collect_list(F.struct("place", "number"))).alias("numbers")
    )
    kind = told.schema["numbers"].dataType
    told = told.select(F.col("id").alias("id_"), F.col("sha256").alias("sha_"), "numbers")
    by = F.col("id").eqNullSafe(F.col("id_")) & (F.col("sha256") == F.col("sha_"))
    made = made.join(told, by, "left").drop("id_", "sha_")
    made = made.withColumn("numbers", F.coalesce("numbers", F.array().cast(kind)))
    return materialize(made, "identified"), ["n_bytes", "ids", "numbers"]


def find_copies(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", hash_bits: int = 64
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, n_bytes, n_chunks.

    ``hash_bits`` is the width of the chunk hashes, at most 64; results do not
    depend on it.
    """
    rows = docs.select(col(id).alias("id"), F.coalesce(col(text), F.lit("")).alias("text"))
    found, key = identified(rows, hash_bits)
    groups = found.groupBy(*key).agg(
        F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("stays")
    )
    # Written, so that the join has exchanges of its own, which adaptive execution can split.
    groups = materialize(groups, "copy-groups")
    return found.join(groups, key).select(
        "id",
        F.col("stays.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("stays.row")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
        "n_bytes",
        F.size("ids").cast("long").alias("n_chunks"),
    )


def keep_one(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each text, that of the largest id."""
    sha, stays_id, stays_sha = (free_name(docs, n) for n in ("text_sha256", "stays_id", "stays_sha256"))
    stays = find_copies(docs, id=id, text=text).where("kept")
    stays = stays.select(F.col("id").alias(stays_id), F.col("text_sha256").alias(stays_sha))
    told = docs.withColumn(sha, F.sha2(F.coalesce(col(text), F.lit("")), 256))
    by = col(id).eqNullSafe(col(stays_id)) & (col(sha) == col(stays_sha))
    return told.join(stays, by, "left_semi").dropDuplicates([id, sha]).drop(sha)

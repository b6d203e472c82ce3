"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

A text's words (ASCII lower-cased, parted by blanks) give shingles; each bit of
the fingerprint is the majority of that bit over the shingles' XXH64 values.
Distinct fingerprints, not documents, are then linked: 64 bits are cut into
``distance // 2 + 1`` segments, so two fingerprints within ``distance`` bits
differ by at most one bit in some segment. Every fingerprint looks up its own
segment value and those one bit away in a table of segment values, and the
full distance of each match is verified. A one-bit ball is enumerated upwards
only (a zero bit set to one), so that a pair is met from one side. Before that,
values that share a segment are linked to the least of them, where that is near,
and pairs already joined by such stars are left out, so that a family of many
near copies does not write all its pairs. With two segments of 32 bits a table entry stays selective for billions of
fingerprints, which whole-segment equality on 16 bits would not.

Defined cases: null or empty texts and texts without words have fingerprint 0
and are linked like any other; repeated rows get one row each; a null id never
names a group unless the group has no other id; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acequia.llm.common import ASCII_LOWER, annotate, col, free_name, struct_array, utf8
from acequia.llm.components import connected_components
from acequia.session import materialize

SHINGLE = 3
DISTANCE = 3
SEED = 42
BITS = 64
#: Shingles whose bits are unpacked at once; bounds the memory of a very long text.
CHUNK = 65_536

_KIND = T.StructType([T.StructField("value", T.LongType())])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit integer."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if len(words) < shingle:
        pieces = [line]
    else:
        pairs = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        pieces = [line[a:b] for a, b in pairs]
    ones = np.zeros(BITS, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, len(pieces), CHUNK):
        part = pieces[at : at + CHUNK]
        values = np.fromiter((hashed(p, SEED) for p in part), np.uint64, len(part))
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((2 * ones > len(pieces)).astype(np.uint8), bitorder="little")
    return int(packed.view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with a long column ``name``; computed per Arrow batch, no shuffle."""
    held = free_name(docs, f"{name}_struct")
    position = docs.columns.index(text)

    def make():
        def compute(batch):
            values = [fingerprint(raw, shingle) for raw in utf8(batch.column(position))]
            return struct_array(_KIND, [values])

        return compute

    marked = annotate(docs, held, _KIND, make)
    return marked.select(*[col(c) for c in docs.columns], F.col(f"{held}.value").alias(name))


def _segment(value: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _ball(key: Column, segment: int, width: int) -> Column:
    """The segment's own value, and those with one of its zero bits set."""
    zeros = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.bit_get(key, j) == 0)

    def entry(value: Column, flipped: bool) -> Column:
        return F.struct(
            F.lit(segment).alias("segment"), value.alias("key"), F.lit(flipped).alias("flipped")
        )

    one = F.lit(1).cast("long")
    up = F.transform(zeros, lambda j: entry(key.bitwiseOR(F.call_function("shiftleft", one, j)), True))
    return F.concat(F.array(entry(key, False)), up)


def _edges(distance: int) -> list[tuple[int, int, int]]:
    """(segment, lowest bit, width) of each segment."""
    count = distance // 2 + 1
    cuts = [BITS * i // count for i in range(count + 1)]
    return [(n, low, high - low) for n, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def star_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): each value of ``fp`` and the least one that shares a segment with it, if they are near.

    At most one link for each segment of a value, however many share it.
    """
    segments = [
        F.struct(F.lit(n).alias("segment"), _segment(F.col("fp"), low, width).alias("key"))
        for n, low, width in _edges(distance)
    ]
    table = prints.select("fp", F.inline(F.array(*segments)))
    least = table.groupBy("segment", "key").agg(F.min("fp").alias("least"))
    near = (F.col("fp") != F.col("least")) & _near(F.col("fp"), F.col("least"), distance)
    return table.join(least, ["segment", "key"]).where(near).select(
        F.col("fp").alias("a"), F.col("least").alias("b")
    )


def links(prints: DataFrame, distance: int = DISTANCE, group: str | None = None) -> DataFrame:
    """(a, b) for all pairs of distinct values of ``fp`` at most ``distance`` bits apart.

    A pair near in several segments may come more than once. With ``group``, a
    column of ``prints``, pairs of one group are left out and the others come as
    their groups, each pair of groups once.
    """
    if distance < 1:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    keys, balls = [], []
    for segment, low, width in _edges(distance):
        key = _segment(F.col("fp"), low, width)
        keys.append(F.struct(F.lit(segment).alias("segment"), key.alias("key")))
        balls.append(_ball(key, segment, width))
    own = F.col(group or "fp")
    table = prints.select(F.col("fp").alias("b"), own.alias("group_b"), F.explode(F.array(*keys)).alias("t"))
    probes = prints.select(F.col("fp").alias("a"), own.alias("group_a"), F.explode(F.concat(*balls)).alias("p"))
    near = (
        (F.col("p.segment") == F.col("t.segment"))
        & (F.col("p.key") == F.col("t.key"))
        & _near(F.col("a"), F.col("b"), distance)
        & (F.col("p.flipped") | (F.col("a") < F.col("b")))
    )
    if group is None:
        return probes.join(table, near).select("a", "b")
    found = probes.join(table, near & (F.col("group_a") != F.col("group_b")))
    pair = (F.greatest("group_a", "group_b").alias("a"), F.least("group_a", "group_b").alias("b"))
    return found.select(*pair).distinct()


def fingerprint_roots(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) of distinct fingerprints; root is the least one that links lead to.

    A family of very many near copies is one star, or a few, before pairs are
    looked for, and pairs within a star are not written: what comes out of the
    join are links between stars.
    """
    if distance < 1:
        return prints.select("fp", F.col("fp").alias("root"))
    stars = connected_components(star_links(prints, distance))
    placed = prints.join(stars, prints["fp"] == stars["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("star")
    )
    placed = materialize(placed, "stars")
    merged = connected_components(links(placed, distance, "star"))
    return placed.join(merged, placed["star"] == merged["node"], "left").select(
        "fp", F.coalesce("root", "star").alias("root")
    )


def near_duplicates(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
) -> DataFrame:
    """One row per row of ``docs``: id, ``fp``, ``text_hash``, ``root`` and ``component``.

    ``root`` is the least fingerprint of the group and names it also where ids are
    null; ``component`` is the smallest id whose fingerprint is reachable over links;
    ``text_hash`` (XXH64 of the text) tells rows of one id apart.
    """
    prints = with_fingerprint(docs.select(col(id).alias("id"), col(text).alias("text")), "text", "fp", shingle)
    prints = materialize(
        prints.select("id", "fp", F.xxhash64("text").alias("text_hash")), "fingerprints"
    )
    first = materialize(prints.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    placed = first.join(fingerprint_roots(first.select("fp"), distance), "fp")
    least = placed.groupBy("root").agg(F.min("low").alias("component"))
    named = placed.join(least, "root").select("fp", "root", "component")
    return prints.join(named, "fp").select("id", "fp", "text_hash", "root", "component")


def keep_first(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, with its columns.

    The row of the smallest id stays; among rows of that id in the group, the
    one with the least text hash, and among equal texts the least other values.
    """
    found = near_duplicates(docs, id=id, text=text, shingle=shingle, distance=distance)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash"))
    chosen = found.groupBy("root").agg(first.alias("keep"))
    names = docs.columns
    key, rank = free_name(docs, "row_key"), free_name(docs, "row_rank")
    # A struct, in which nulls are equal, so that join and window share one exchange;
    # for that its type, nullability included, is the same on both sides.
    kept_hash = F.coalesce(F.col("keep.text_hash"), F.lit(0)).alias("text_hash")
    chosen = chosen.select(F.struct(F.col("keep.id").alias("id"), kept_hash).alias("kept_key")).distinct()
    row_key = F.struct(col(id).alias("id"), F.xxhash64(col(text)).alias("text_hash"))
    kept = docs.withColumn(key, row_key).join(chosen, col(key) == F.col("kept_key"), "left_semi")
    others = [col(c) for c in names if c not in (id, text)] or [F.lit(0)]
    window = Window.partitionBy(col(key)).orderBy(*others)
    ranked = kept.withColumn(rank, F.row_number().over(window))
    return ranked.where(col(rank) == 1).select(*[col(c) for c in names])

"""Hard negatives by BOND vertical scans.

For each anchor the positives are the best rows of its own label, and the hard
negatives of each positive are the best rows of other labels whose score lies in
a window below the positive's score. A score is the inner product of integer
vectors; higher ones come first, ties by the smaller id.

*Blocks*: rows and anchors are cut into blocks of bounded bytes, and each pair of
a block of anchors and a block of rows is one group, so either side is copied
once for each block of the other. A group's best few go on to a grouped merge.
No side passes the driver or one task.

*Vertical scan*: within a group vectors lie by dimension. An anchor reads the
dimensions in descending order of its own magnitudes, a step at a time. What the
dimensions left can still add lies between sums of the least and the greatest
contribution that the block's minima and maxima allow. A row whose greatest
possible score stays below the least certain score of enough others, or whose
range of scores meets no window, leaves the candidate bitmap; when the bitmap
has shrunk by half the columns are cut down to it. What is left has read all
dimensions and is exact. Only rows that cannot be returned are dropped.

Defined cases: rows with a null label, a null vector, or a null or non-finite
component take no part, nor do rows with a null id; a shorter vector ends in
zeros; equal rows are rows of their own, and an anchor is not its own positive
but an equal row may be; an anchor without positives or negatives gives no row;
components so large that a score could pass 2^62 are an error; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acequia.llm.common import batch_of, col
from acequia.session import materialize, task_count

#: Bytes of a block of rows or of anchors, at 8 a component.
BLOCK_BYTES = 64 << 20
#: Rows below which a block is not cut further to keep all cores at work.
LEAST_ROWS = 1024
#: Parts of the dimensions read one after another: the first half at once, then shorter steps.
STEPS = (0.5, 0.25, 0.125, 0.0625, 0.0625)

_BEST = T.StructType(
    [
        T.StructField("anchor", T.LongType()),
        T.StructField("window", T.IntegerType()),
        T.StructField("id", T.LongType()),
        T.StructField("score", T.LongType()),
    ]
)


class Columns:
    """Vectors of a block by dimension, with the least and greatest value of each."""

    def __init__(self, vectors: pa.ChunkedArray, dims: int):
        flat = vectors.combine_chunks()
        sizes = np.diff(flat.offsets.to_numpy())
        values = flat.flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.values = np.zeros((dims, len(sizes)), np.int64)
        self.values[at, row] = values
        self.low = self.values.min(axis=1) if len(sizes) else np.zeros(dims, np.int64)
        self.high = self.values.max(axis=1) if len(sizes) else np.zeros(dims, np.int64)
        # Sums of products below 2^53 are exact as doubles, whose products are faster.
        self.most = int(np.abs(self.values).max(initial=0))
        self.real = self.values.astype(np.float64)

    def products(self, weights: np.ndarray, dims: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
        exact = self.most * int(np.abs(weights).sum()) < 1 << 53
        part = (self.real if exact else self.values)[dims]
        part = part if rows is None else part[:, rows]
        return ((weights.astype(np.float64) if exact else weights) @ part).astype(np.int64)


def steps_of(anchor: np.ndarray, columns: Columns) -> list[tuple[np.ndarray, int, int]]:
    """Dimensions in descending magnitude, in steps, and the least and greatest that the rest can add."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    a, b = anchor * columns.low, anchor * columns.high
    least, most = np.minimum(a, b)[order], np.maximum(a, b)[order]
    ends = np.ceil(np.cumsum(STEPS) * len(order)).astype(int)
    out, start = [], 0
    for end in ends.tolist():
        if end > start:
            out.append((order[start:end], int(least[end:].sum()), int(most[end:].sum())))
        start = max(start, end)
    return out


def scan(
    anchor: np.ndarray, columns: Columns, allowed: np.ndarray, count: int, windows: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Rows that may be among the ``count`` best of all, or of each window, and their exact scores.

    ``windows`` are rows of a least and a greatest score, both allowed.
    """
    bounds = np.array([[-(1 << 62), 1 << 62]]) if windows is None else windows
    live = np.flatnonzero(allowed)
    score = np.zeros(len(live), np.int64)
    held, at = columns, live  # ``at``: where the live rows lie in ``held``
    for dims, least, most in steps_of(anchor, columns):
        score += held.products(anchor[dims], dims, None if len(at) == held.values.shape[1] else at)
        low, high = score + least, score + most
        keep = np.zeros(len(live), bool)
        for floor, ceiling in bounds.tolist():
            sure = low[(low >= floor) & (high <= ceiling)]
            if len(sure) > count:
                floor = max(floor, int(np.partition(sure, len(sure) - count)[len(sure) - count]))
            elif len(sure) == count:
                floor = max(floor, int(sure.min()))
            keep |= (high >= floor) & (low <= ceiling)
        if not keep.all():
            live, score, at = live[keep], score[keep], at[keep]
            if not len(live):
                break
            if 2 * len(at) < held.values.shape[1]:
                held, at = _cut(held, at), np.arange(len(at))
    return live, score


def _cut(columns: Columns, rows: np.ndarray) -> Columns:
    out = object.__new__(Columns)
    out.values, out.real = columns.values[:, rows], columns.real[:, rows]
    out.low, out.high, out.most = columns.low, columns.high, columns.most
    return out


def _first(ids: np.ndarray, score: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` first by score and id."""
    return np.lexsort((ids, -score))[:count]


def vectors(
    rows: DataFrame, label: Column, is_anchor: Column, *, id: str = "vec_id", vector: str = "embedding",
    scale: float = 256,
) -> DataFrame:
    """(key, id, label, v, anchor) of the rows that take part; components become ``floor(scale * x)``."""
    x = F.transform(col(vector), lambda c: c.cast("double"))
    # A comparison with infinity is false for it, for NaN and for null.
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    scaled = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    out = rows.where(col(id).isNotNull() & label.isNotNull() & col(vector).isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("key"),
        col(id).cast("long").alias("id"),
        label.cast("long").alias("label"),
        scaled.alias("v"),
        F.aggregate(scaled, F.lit(0.0), lambda m, c: F.greatest(m, F.abs(c.cast("double")))).alias("most"),
        is_anchor.alias("anchor"),
    )
    return materialize(out, "vectors")


def _blocks(n: int, dims: int, least: int) -> int:
    """Blocks for ``n`` vectors: of bounded bytes, and at least ``least`` if there are rows enough."""
    return max(1, -(-n * dims * 8 // BLOCK_BYTES), min(least, -(-n // LEAST_ROWS)))


def _pairs(left: DataFrame, right: DataFrame, m: int, n: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to the m x n pairs of their blocks."""
    block = "pmod(xxhash64(key), {})"
    # New columns: both sides stem from one table, and a cogroup mixes up equal ones.
    a = left.select(*[F.col(c).alias(c) for c in left.columns])
    a = a.withColumn("a", F.expr(block.format(m)).cast("int"))
    a = a.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    b = right.withColumn("b", F.expr(block.format(n)).cast("int"))
    return a, b.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))


def mine(
    rows: DataFrame, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``vectors``.

    A negative's score lies between ``low`` and ``high`` hundredths of the positive's.
    """
    size = rows.agg(
        F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("v")).alias("dims"),
        F.max("most").alias("most"),
    ).first()
    dims = size["dims"] or 0
    if size["n"] and dims * size["most"] ** 2 >= 2.0**62 / max(low, high, 100):
        raise ValueError("components are too large for exact scores")
    anchors = rows.where("anchor").drop("anchor", "most")
    rows = rows.drop("anchor", "most")
    # Blocks to keep all cores at work, as long as they hold rows enough; then blocks of bounded bytes.
    least = task_count(rows.sparkSession)
    m, n = _blocks(size["anchors"], dims, 1), _blocks(size["n"], dims, least)

    def best_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            given, columns = Columns(left["v"], dims).values.T, Columns(right["v"], dims)
            labels, ids, keys = (right[c].to_numpy() for c in ("label", "id", "key"))
            for key, label, anchor in zip(left["key"].to_pylist(), left["label"].to_pylist(), given, strict=True):
                at, score = scan(anchor, columns, (labels == label) & (keys != key), positives)
                best = _first(ids[at], score, positives)
                out += [(key, 0, int(ids[at[k]]), int(score[k])) for k in best]
        return pa.Table.from_batches([batch_of(_BEST, list(zip(*out, strict=True)) or [[]] * 4)])

    a, b = _pairs(anchors, rows, m, n)
    found = a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInArrow(best_positives, _BEST)
    ranked = found.withColumn(
        "rank", F.expr("row_number() over (partition by anchor order by score desc, id)")
    ).where(F.col("rank") <= positives)
    listed = ranked.groupBy(F.col("anchor").alias("key")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives")
    )
    listed = materialize(anchors.join(listed, "key"), "positives")

    def best_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            given, columns = Columns(left["v"], dims).values.T, Columns(right["v"], dims)
            labels, ids = (right[c].to_numpy() for c in ("label", "id"))
            for key, label, scores, anchor in zip(
                left["key"].to_pylist(), left["label"].to_pylist(), left["scores"].to_pylist(), given, strict=True
            ):
                scores = np.array(scores, np.int64)
                # low * p <= 100 * n <= high * p, in whole numbers
                windows = np.stack([-(-low * scores // 100), high * scores // 100], axis=1)
                open_ = np.flatnonzero(windows[:, 0] <= windows[:, 1])
                if not len(open_):
                    continue
                at, score = scan(anchor, columns, labels != label, negatives, windows[open_])
                for w in open_.tolist():
                    inside = np.flatnonzero((score >= windows[w, 0]) & (score <= windows[w, 1]))
                    best = inside[_first(ids[at[inside]], score[inside], negatives)]
                    out += [(key, w, int(ids[at[k]]), int(score[k])) for k in best]
        return pa.Table.from_batches([batch_of(_BEST, list(zip(*out, strict=True)) or [[]] * 4)])

    asked = listed.select("key", "label", "v", F.col("positives.score").alias("scores"))
    a, b = _pairs(asked, rows, m, n)
    found = a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInArrow(best_negatives, _BEST)
    ranked = found.withColumn(
        "rank", F.expr("row_number() over (partition by anchor, window order by score desc, id)")
    ).where(F.col("rank") <= negatives)
    positive = F.element_at("positives", F.col("window") + 1)
    return (
        ranked.withColumnRenamed("id", "negative_id")
        .withColumnRenamed("score", "negative_score")
        .withColumnRenamed("anchor", "key")
        .join(listed.select("key", F.col("id").alias("anchor_id"), "positives"), "key")
        .select(
            "anchor_id",
            positive["id"].alias("positive_id"),
            F.col("rank").cast("int").alias("rank"),
            "negative_id",
            positive["score"].alias("positive_score"),
            "negative_score",
        )
    )

"""Hard negatives against all pairs in whole numbers."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from acequia.llm import bond

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, positives=5, negatives=3, low=50, high=95):
    given = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, v, label in rows
        if i is not None and label is not None and v is not None
        and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for k, (i, label, v) in enumerate(given):
        if i % 50:
            continue
        scored = []
        for j, (other, its, w) in enumerate(given):
            if j != k:
                pairs = itertools.zip_longest(v, w, fillvalue=0)
                scored.append((-sum(a * b for a, b in pairs), other, its))
        scored.sort()
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            window = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s]
            out += [(i, p, r + 1, x[1], -s, -x[0]) for r, x in enumerate(window[:negatives])]
    return sorted(out)


def found(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    frame = frame.withColumns({c: F.lit("clash") for c in ("id", "key", "v", "anchor", "a", "b", "score", "window")})
    made = bond.vectors(frame, F.col("label"), F.col("vec_id") % 50 == 0)
    return sorted(tuple(r) for r in bond.mine(made).collect())


def table(n, dims, seed=1, spread=1.0):
    """Vectors near a centre for each label, so that windows are met."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims)) * 0.2 + 0.3
    labels = rng.integers(0, 4, n)
    values = (centres[labels] + spread * rng.normal(size=(n, dims)) * 0.1).astype(np.float32)
    return [(i, [float(x) for x in v], int(k)) for i, v, k in zip(range(n), values, labels, strict=True)]


def test_all_pairs(spark):
    rows = table(600, 24)
    want = plain(rows)
    assert len(want) > 100 and found(spark, rows) == want


def test_edges(spark):
    rows = table(150, 8)
    rows += [
        (200, None, 1), (201, rows[3][1], None), (None, rows[4][1], 1), (202, [math.nan] * 8, 1),
        (203, [math.inf] + [0.0] * 7, 2), (204, [None] + [0.5] * 7, 2), (250, [], 1), (300, [0.5, 0.5], 2),
        (350, [0.0] * 8, 0), (400, [-0.5] * 8, 3), rows[0], rows[0], rows[50], rows[7],
    ]
    rows += [(500 + i, rows[10][1], rows[10][2]) for i in range(80)]  # very common vector, ties by id
    want = plain(rows)
    assert want and found(spark, rows) == want


def test_many_blocks(spark, monkeypatch):
    """Blocks of rows and of anchors change no result."""
    rows = table(700, 12, seed=2)
    want = plain(rows)
    monkeypatch.setattr(bond, "BLOCK_BYTES", 12 * 8 * 5)
    made = bond.vectors(spark.createDataFrame(rows, SCHEMA), F.col("label"), F.col("vec_id") % 50 == 0)
    assert bond._blocks(14, 12, 1) == 3
    assert sorted(tuple(r) for r in bond.mine(made).collect()) == want


def test_empty_and_without_anchors(spark):
    assert found(spark, []) == []
    assert found(spark, [(i, [0.1, 0.2], 1) for i in range(1, 40)]) == []


def test_too_large_components(spark):
    with pytest.raises(ValueError, match="too large"):
        found(spark, [(50, [1e30], 1), (51, [1.0], 1)])


def test_large_but_exact(spark):
    """Scores beyond 2^53 stay exact."""
    random.seed(5)
    rows = [(i, [float(np.float32(random.uniform(0.9, 1) * 2**18)) for _ in range(6)], i % 2) for i in range(60)]
    want = plain(rows)
    assert want and found(spark, rows) == want


def test_scan_drops_rows_early_and_keeps_the_best():
    """Most rows leave the bitmap before the last step, none that may be returned."""
    rng = np.random.default_rng(6)
    vectors = np.floor(rng.normal(size=(3000, 32)) * 40).astype(np.int64)
    vectors[:40] += np.int64(60)
    anchor = vectors[0] * np.where(np.arange(32) < 6, 5, 1)
    columns = bond.Columns(pa.chunked_array([pa.array(vectors.tolist(), pa.list_(pa.int64()))]), 32)
    at, score = bond.scan(anchor, columns, np.ones(3000, bool), 5)
    exact = vectors @ anchor
    assert (exact[at] == score).all() and len(at) < 300
    best = np.lexsort((np.arange(3000), -exact))[:5]
    assert set(best) <= set(at.tolist())
    window = np.array([[int(exact.max() * 0.5), int(exact.max() * 0.9)]])
    at, score = bond.scan(anchor, columns, np.ones(3000, bool), 3, window)
    inside = np.flatnonzero((exact >= window[0, 0]) & (exact <= window[0, 1]))
    best = inside[np.lexsort((inside, -exact[inside]))[:3]]
    assert (exact[at] == score).all() and set(best.tolist()) <= set(at.tolist())


def test_dimensions_by_descending_magnitude():
    columns = bond.Columns(pa.chunked_array([pa.array([[1, 2, 3], [4, -5, 6]], pa.list_(pa.int64()))]), 3)
    steps = bond.steps_of(np.array([1, -9, 4]), columns)
    assert [d for dims, _, _ in steps for d in dims.tolist()] == [1, 2, 0]
    assert steps[-1][1:] == (0, 0)

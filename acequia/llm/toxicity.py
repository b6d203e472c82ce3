"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are the words of the lower-cased text and its hashed runs of 5 and of 8
bytes, blanks included, so that a word and its relatives share some. Kept are
those that two or more toxic texts hold, as a share more than twice that of the
clean ones: all that do so significantly, of each kind of feature as many as
keep the expected share of chance finds below ``FALSE_SHARE`` (Benjamini and
Hochberg), up to ``KEPT``; and where those are fewer than ``FILL``, as with few
labels, the strongest of the others, which the ridge shrinks instead of a floor
dropping them. The test follows the number of labels and of features. One weight
vector is shared by all ordered thresholds: P(grade <= k) =
sigmoid(threshold_k - score). Weights are not negative, as kept features speak
for toxicity alone. The expected severity is the sum over k of P(grade > k).

Two-valued labels are graded first: 0 for a clean text, and toxic texts are
split into mild (1) and severe (2) at the median of the logarithmic counts of
kept features, summed.

Selection and weights are fitted on a bounded sample of labelled documents
(``per_label`` of each label, drawn by a hash of the id, one row an id, weighted
back to the label's true count); prediction covers all rows and whole texts.

Defined cases: a null or empty text has no features and is as clean as the
thresholds say; labels that are null, or of unknown documents, are ignored; a
document with several labels takes the largest, one with several rows lends the
sample the row of the largest text hash; without labelled texts of both kinds
nothing can be learned and every text has severity 0; with too few to tell any
feature, a warning says so and every text gets the base rate; repeated rows are
scored alike; further columns are ignored or passed through.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acequia.llm.common import annotate, batch_of, col, free_name, struct_array
from acequia.session import materialize

GRAMS = (5, 8)
BUCKETS = 1 << 20
#: Buckets of the runs, then of the words.
WORDS = 1 << 19
ALL_BUCKETS = BUCKETS + WORDS
PER_LABEL = 4000
KEPT, FILL = 4000, 2000
#: Expected share of chance finds among the kept features of a kind.
FALSE_SHARE = 0.05
#: Tasks that read the sample, whose size is bounded.
SAMPLE_TASKS = 8

RESULT = T.StructType(
    [
        T.StructField("grade", T.IntegerType()),
        T.StructField("expected_severity", T.DoubleType()),
        T.StructField("p_toxic", T.DoubleType()),
        T.StructField("toxic", T.BooleanType()),
    ]
)
_TALLY = T.StructType([T.StructField(n, T.LongType()) for n in ("bucket", "n", "seen")])
_SAMPLE = T.StructType(
    [
        T.StructField("buckets", T.ArrayType(T.LongType())),
        T.StructField("counts", T.ArrayType(T.LongType())),
    ]
)
#: ASCII bytes that are no letters become blanks.
_TABLE = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def codes(text: str | None) -> np.ndarray:
    """Buckets of the runs of bytes at each place of the text, runs of blanks joined."""
    words = (text or "").lower().encode().translate(_TABLE).split()
    if not words:
        return np.zeros(0, np.uint32)
    most = max(GRAMS)
    data = np.frombuffer(b" " + b" ".join(words) + b" " * most, np.uint8).astype(np.uint32)
    places = len(data) - most + 1
    code, made = np.zeros(places, np.uint32), []
    for i in range(most):
        code = code * np.uint32(16_777_619) + data[i : places + i]
        if i + 1 in GRAMS:
            made.append(((code ^ (code >> np.uint32(13))) * np.uint32(2_654_435_761)) >> np.uint32(12))
    made.append(BUCKETS + _words(data[: len(data) - most + 1]))
    return np.concatenate(made)


def _words(data: np.ndarray) -> np.ndarray:
    """A bucket for each word between blanks: differences of one running sum, moved to a common place."""
    factor = np.uint32(2_246_822_519)
    back = np.uint32(pow(2_246_822_519, -1, 1 << 32))
    powers = np.full(len(data), factor, np.uint32)
    powers[0] = 1
    sums = np.cumsum((data + np.uint32(1)) * np.cumprod(powers, dtype=np.uint32), dtype=np.uint32)
    powers[1:] = back
    unmoved = np.cumprod(powers, dtype=np.uint32)
    blank = np.flatnonzero(data == 32)
    first, last = blank[:-1], blank[1:] - 1  # a word lies after its first place and ends at its last
    code = (sums[last] - sums[first]) * unmoved[first]
    code = (code ^ (code >> np.uint32(15))) * np.uint32(2_654_435_761)
    return code >> np.uint32(13)


@dataclass
class Ordinal:
    """Weights of the kept buckets, shared by the ordered thresholds."""

    kept: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, buckets: np.ndarray, counts: np.ndarray) -> float:
        return float(self.weights[buckets] @ np.log1p(counts))

    def above(self, score: float) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -60, 60)))


def _deviance(n: np.ndarray, positive: float, all_rows: float, seen: np.ndarray) -> np.ndarray:
    """Likelihood ratio of each bucket's presence against the label, from document counts."""

    def part(k, m):
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / np.maximum(m, 1e-12)), 0.0)

    a, b = seen, n - seen
    c, d = positive - seen, all_rows - positive - b
    p = positive / all_rows
    q = n / all_rows
    expected = (all_rows * p * q, all_rows * (1 - p) * q, all_rows * p * (1 - q), all_rows * (1 - p) * (1 - q))
    return 2 * sum(part(k, m) for k, m in zip((a, b, c, d), expected, strict=True))


def fit_ordinal(
    rows: list[tuple[np.ndarray, np.ndarray]],
    grades: np.ndarray,
    sample_weights: np.ndarray,
    kept: np.ndarray,
    ridge: float = 0.1,
    rounds: int = 1500,
) -> Ordinal:
    """Penalised maximum likelihood by gradient steps with momentum (Adam).

    ``rows`` holds (buckets, counts) among the kept buckets, ``grades`` 0 to K - 1.
    """
    levels = int(grades.max())
    row = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    bucket = np.concatenate([b for b, _ in rows]) if len(row) else np.zeros(0, int)
    value = np.log1p(np.concatenate([c for _, c in rows])) if len(row) else np.zeros(0)
    share = sample_weights / sample_weights.sum()
    weights = np.zeros(len(kept))
    top = np.array([share[grades <= k].sum() for k in range(levels)])
    first = np.log(np.clip(top, 1e-6, 1 - 1e-6) / np.clip(1 - top, 1e-6, 1))
    # Thresholds as the first one and the logarithms of the steps between them: always ordered.
    steps = np.r_[first[0], np.log(np.maximum(np.diff(first), 1e-2))]
    state = [np.zeros(len(kept) + levels) for _ in range(2)]
    for t in range(1, rounds + 1):
        bounds = np.cumsum(np.r_[steps[0], np.exp(steps[1:])])
        score = np.bincount(row, value * weights[bucket], len(rows))
        edges = np.r_[-np.inf, bounds, np.inf]
        upper, lower = edges[grades + 1] - score, edges[grades] - score
        hi, lo = _sigmoid(upper), _sigmoid(lower)
        p = np.maximum(hi - lo, 1e-12)
        up, down = hi * (1 - hi) / p, lo * (1 - lo) / p
        by_score = share * (up - down)  # of the negative log-likelihood
        slope = np.bincount(bucket, value * by_score[row], len(kept)) + ridge / len(rows) * weights
        by_bound = np.array(
            [-(share * up)[grades == k].sum() + (share * down)[grades == k + 1].sum() for k in range(levels)]
        )
        by_step = np.cumsum(by_bound[::-1])[::-1].copy()
        by_step[1:] *= np.exp(steps[1:])
        slope = np.r_[slope, by_step]
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.99 * state[1] + 0.01 * slope**2
        move = 0.05 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-10)
        weights = np.maximum(weights - move[: len(kept)], 0.0)
        steps -= move[len(kept) :]
    return Ordinal(kept, weights, np.cumsum(np.r_[steps[0], np.exp(steps[1:])]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def select(
    bucket: np.ndarray, n: np.ndarray, seen: np.ndarray, positive: float, all_rows: float, tested: tuple[int, int],
    most: int = KEPT, fill: int = FILL,
) -> np.ndarray:
    """Buckets that toxic documents hold more often, those that do so significantly first; in order.

    ``tested`` is how many buckets of runs and of words two documents or more
    hold: as many as could have been found by chance.
    """
    gain = _deviance(n, positive, all_rows, seen)
    more = seen * (all_rows - positive) > 2 * (n - seen) * positive
    chance = np.array([erfc(sqrt(max(g, 0.0) / 2)) / 2 for g in gain.tolist()])
    found = []
    for kind, tests in enumerate(tested):
        own = np.flatnonzero(more & ((bucket >= BUCKETS) == bool(kind)))
        own = own[np.argsort(chance[own], kind="stable")]
        good = np.flatnonzero(chance[own] <= FALSE_SHARE * np.arange(1, len(own) + 1) / max(tests, 1))
        found.append(own[: good[-1] + 1] if len(good) else own[:0])
    found = np.concatenate(found)
    found = found[np.argsort(-gain[found], kind="stable")[:most]]
    rest = np.setdiff1d(np.flatnonzero(more), found)
    rest = rest[np.argsort(-gain[rest], kind="stable")[: max(fill - len(found), 0)]]
    return np.sort(bucket[np.concatenate([found, rest])])


def _kept_counts(text: str | None, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the kept buckets in a text, and their counts."""
    own = place[codes(text)]
    return np.unique(own[own >= 0], return_counts=True)


def _places(kept: np.ndarray) -> np.ndarray:
    place = np.full(ALL_BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    return place


def fit_model(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    per_label: int = PER_LABEL,
) -> Ordinal | None:
    """The regression, fitted on a bounded sample of labelled documents; None if there are none."""
    marked = (
        labels.select(col(id).alias("label_id"), (col(label) > 0).alias("bad"))
        .where(F.col("label_id").isNotNull() & F.col("bad").isNotNull())
        .groupBy("label_id").agg(F.max("bad").alias("bad"))
    )
    counts = {r["bad"]: r["count"] for r in marked.groupBy("bad").count().collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("bad"), min(1.0, per_label / counts[True])).otherwise(
        min(1.0, per_label / counts[False])
    )
    # Ids and labels of the sample alone, about 2 * per_label rows by the exact counts.
    drawn = marked.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select(col(id).alias("id"), col(text).alias("text"))
    texts = texts.join(F.broadcast(drawn), F.col("id") == F.col("label_id"))
    # One row an id: however many rows share one, the sample stays as large as it was drawn.
    texts = texts.groupBy("id", "bad").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    texts = materialize(texts.repartition(SAMPLE_TASKS), "toxicity")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = np.zeros(ALL_BUCKETS + 1, np.int64), np.zeros(ALL_BUCKETS + 1, np.int64)
        for batch in batches:
            for bad, value in zip(batch.column("bad").to_pylist(), batch.column("text"), strict=True):
                own = np.unique(codes(value.as_py()))
                n[own] += 1
                n[ALL_BUCKETS] += 1  # documents
                if bad:
                    seen[own] += 1
                    seen[ALL_BUCKETS] += 1
        used = np.flatnonzero(n)
        if len(used):
            yield batch_of(_TALLY, [used, n[used], seen[used]])

    tallies = texts.mapInArrow(tally, _TALLY).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    tallies = materialize(tallies, "toxicity")
    whole = tallies.where(F.col("bucket") == ALL_BUCKETS).first()
    if whole is None or whole["seen"] in (0, whole["n"]):
        return None
    positive, all_rows = float(whole["seen"]), float(whole["n"])
    # At most one row a bucket; of them only what ``select`` can choose from is drawn.
    common = tallies.where((F.col("bucket") < ALL_BUCKETS) & (F.col("n") > 1))
    tests = {r["kind"]: r["count"] for r in common.groupBy((F.col("bucket") >= BUCKETS).alias("kind")).count().collect()}
    rate = F.col("seen") * (all_rows - positive) > 2 * (F.col("n") - F.col("seen")) * positive
    found = common.where((F.col("seen") > 1) & rate).orderBy("bucket").toPandas()
    bucket, n, seen = (found[c].to_numpy(np.int64) for c in _TALLY.names)
    tested = (tests.get(False, 0), tests.get(True, 0))
    kept = select(bucket, n.astype(float), seen.astype(float), positive, all_rows, tested)
    if not len(kept):
        warnings.warn(f"{int(positive)} toxic of {int(all_rows)} labelled texts tell no feature", stacklevel=2)
    place = _places(kept)

    def make():
        def compute(batch: pa.RecordBatch) -> pa.Array:
            made = [_kept_counts(value.as_py(), place) for value in batch.column(2)]
            return struct_array(_SAMPLE, [list(c) for c in zip(*made, strict=True)])

        return compute

    sample = annotate(texts, "f", _SAMPLE, make).select("id", "bad", "f.*").collect()
    sample.sort(key=lambda r: r["id"])
    rows = [(np.array(r["buckets"], np.int64), np.array(r["counts"], float)) for r in sample]
    bad = np.array([r["bad"] for r in sample])
    mass = np.array([np.log1p(c).sum() for _, c in rows])
    severe = bad & (mass > np.median(mass[bad]))
    grades = bad.astype(int) + severe
    share_of = {kind: counts[kind] / max((bad == kind).sum(), 1) for kind in (True, False)}
    weights = np.where(bad, share_of[True], share_of[False])
    return fit_ordinal(rows, grades, weights, kept)


def predict(docs: DataFrame, model: Ordinal | None, *, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``out``: grade, expected severity, P(grade > 0), verdict; no shuffle."""
    name, position = free_name(docs, out), docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        ordinal = shared.value
        place = _places(ordinal.kept) if ordinal else None

        def compute(batch: pa.RecordBatch) -> pa.Array:
            rows = []
            for value in batch.column(position):
                if ordinal is None:
                    rows.append((0, 0.0, 0.0, False))
                    continue
                index, counts = _kept_counts(value.as_py(), place)
                above = ordinal.above(ordinal.score(index, counts))
                grade = int((above >= 0.5).sum())
                rows.append((grade, float(above.sum()), float(above[0]), grade > 0))
            return struct_array(RESULT, [list(c) for c in zip(*rows, strict=True)])

        return compute

    return annotate(docs, name, RESULT, make)

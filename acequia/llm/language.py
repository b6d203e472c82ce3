"""Hierarchical language identification: the family first, then the language within it.

A text's features are the square roots of its shares of hashed byte trigrams,
a vector of length one. Linear support vector machines, one for each pair of
families and one for each pair of languages of a family, are fitted by dual
coordinate descent; the pairs vote, ties go to the larger sum of margins.

The machines are fitted on a sample: ``per_language`` texts of each language,
``max_rows`` in all, drawn by a hash of the id. Counts behind the sampling
shares cover all rows. Prediction covers all rows and whole texts and uses the
text alone.

Defined cases: a null text and a text without a letter are ``und`` with score
0; a null id is not held out and not learned from; a null language is not
learned from; with no labelled text everything is ``und``, with one language
all texts are that language, score 1; repeated rows are predicted alike;
further columns are ignored or passed through.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acequia.llm.common import annotate, col, free_name, struct_array

UNKNOWN = "und"
PER_LANGUAGE = 400
MAX_ROWS = 6000
SIZE = 4096
FOLDS = 5
#: Texts scored by one matrix product.
ROWS = 256
#: A prediction less sure than this is no prediction for a filter.
LEAST_SCORE = 0.05

#: Language codes (ISO 639) by family. Any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi fo",
    "romance": "fr es it pt ro ca gl oc ast",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
    "turkic": "tr az kk uz ky tk tt",
    "indo-aryan": "hi bn mr gu pa ur ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "austronesian": "id ms jv su tl mg",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

RESULT = T.StructType(
    [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
)
_SAMPLE = T.StructType([T.StructField("vector", T.BinaryType())])
_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of hashed byte trigrams; None without a letter."""
    if text is None or not _LETTER.search(text):
        return None
    data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    code = (data[:-2] * np.uint32(40_503) + data[1:-1] * np.uint32(1_009) + data[2:] * np.uint32(31)) % SIZE
    counts = np.bincount(code, minlength=SIZE).astype(np.float32)
    return np.sqrt(counts / counts.sum())


def fit_svm(rows: np.ndarray, signs: np.ndarray, cost: float = 10.0, rounds: int = 40) -> np.ndarray:
    """Weights, the last for the constant, of a squared-hinge machine by dual coordinate descent."""
    rows = np.hstack([rows, np.ones((len(rows), 1), np.float32)]).astype(np.float64)
    # Classes weigh alike however many rows they have.
    share = np.where(signs > 0, np.mean(signs > 0), np.mean(signs < 0))
    ridge = share / cost
    alpha, weights = np.zeros(len(rows)), np.zeros(rows.shape[1])
    norms = np.einsum("ij,ij->i", rows, rows) + ridge
    order = np.random.default_rng(0)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(rows)):
            slope = signs[i] * (rows[i] @ weights) - 1 + ridge[i] * alpha[i]
            new = max(alpha[i] - slope / norms[i], 0.0)
            if new != alpha[i]:
                weights += (new - alpha[i]) * signs[i] * rows[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return weights.astype(np.float32)


@dataclass
class Pairwise:
    """One machine for each pair of labels."""

    labels: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None
    slope: float = 4.0

    @classmethod
    def fit(cls, rows: np.ndarray, names: np.ndarray) -> Pairwise:
        made = cls(sorted(set(names.tolist())))
        fitted, margins = [], []
        for i, j in combinations(range(len(made.labels)), 2):
            one, other = names == made.labels[i], names == made.labels[j]
            part, signs = rows[one | other], np.where(one[one | other], 1.0, -1.0)
            test = np.arange(len(part)) % 5 == 0
            if len(set(signs[~test])) == 2 and test.any():
                margins.append(signs[test] * _margin(part[test], fit_svm(part[~test], signs[~test])))
            made.pairs.append((i, j))
            fitted.append(fit_svm(part, signs))
        if fitted:
            made.weights = np.stack(fitted)
        if margins:  # the slope under which margins of rows not fitted on are likeliest
            margin = np.concatenate(margins)
            slopes = (0.5, 1, 2, 4, 8, 16, 32)
            made.slope = min(slopes, key=lambda s: np.logaddexp(0, -s * margin).sum())
        return made

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's label and its probability, the least over its pairs."""
        n, k = len(rows), len(self.labels)
        if self.weights is None:
            return np.zeros(n, int), np.ones(n)
        margin = rows @ self.weights[:, :-1].T + self.weights[:, -1]
        votes, sums = np.zeros((n, k)), np.zeros((n, k))
        for p, (i, j) in enumerate(self.pairs):
            votes[:, i] += margin[:, p] > 0
            votes[:, j] += margin[:, p] <= 0
            sums[:, i] += margin[:, p]
            sums[:, j] -= margin[:, p]
        best = np.lexsort((sums, votes))[:, -1] if k > 1 else np.zeros(n, int)
        least = np.full(n, np.inf)
        for p, (i, j) in enumerate(self.pairs):
            for label, sign in ((i, 1), (j, -1)):
                own = best == label
                least[own] = np.minimum(least[own], sign * margin[own, p])
        return best, 1 / (1 + np.exp(-self.slope * np.clip(least, -30, 30)))


def _margin(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return rows @ weights[:-1] + weights[-1]


@dataclass
class Model:
    """Machines between families, and within each family between its languages."""

    families: Pairwise
    within: dict[str, Pairwise]

    @classmethod
    def fit(cls, rows: np.ndarray, langs: np.ndarray) -> Model:
        groups = np.array([family_of(x) for x in langs.tolist()], dtype=object)
        return cls(
            Pairwise.fit(rows, groups),
            {g: Pairwise.fit(rows[groups == g], langs[groups == g]) for g in sorted(set(groups.tolist()))},
        )

    def predict(self, rows: np.ndarray) -> tuple[list[str], list[float]]:
        group, sure = self.families.predict(rows)
        langs, scores = np.empty(len(rows), object), np.zeros(len(rows))
        for g, name in enumerate(self.families.labels):
            own = group == g
            if own.any():
                machine = self.within[name]
                best, score = machine.predict(rows[own])
                langs[own] = np.array(machine.labels, dtype=object)[best]
                scores[own] = score * sure[own]
        return langs.tolist(), scores.tolist()


def held_out(id: Column) -> Column:
    """Whether a document is kept from learning: its id's checksum is a multiple of ``FOLDS``."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit_model(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    max_rows: int = MAX_ROWS,
) -> Model | None:
    """The machines, fitted on a bounded sample of labelled texts; None without any."""
    rows = docs.select(
        col(id).alias("id"), col(text).alias("text"), col(lang).cast("string").alias("lang")
    )
    rows = rows.where(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id"))
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    most = max(2, min(per_language, max_rows // len(counts)))
    place = F.xxhash64("id")
    # A share a little over what is needed, then the exact number by rank.
    share = F.create_map(
        *[x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, (1.3 * most + 50) / n)))]
    )
    drawn = rows.where(F.pmod(place, F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "id", F.xxhash64("text")))
    drawn = drawn.withColumn("place", rank).where(F.col("place") <= most).drop("place")
    at = drawn.columns.index("text")

    def make():
        def compute(batch: pa.RecordBatch) -> pa.Array:
            made = [features(v.as_py()) for v in batch.column(at)]
            return struct_array(_SAMPLE, [[None if f is None else f.astype("<f2").tobytes() for f in made]])

        return compute

    # A language's rank, and so the features, are taken by one task; it holds at most ``most`` texts.
    sample = annotate(drawn, "f", _SAMPLE, make).where("f.vector is not null")
    found = sorted((r["lang"], bytes(r["vector"])) for r in sample.select("lang", "f.vector").collect())
    if not found:
        return None
    vectors = np.stack([np.frombuffer(v, "<f2") for _, v in found]).astype(np.float32)
    langs = np.array([name for name, _ in found], dtype=object)
    mixed = np.random.default_rng(0).permutation(len(langs))
    return Model.fit(vectors[mixed], langs[mixed])


def identify(docs: DataFrame, model: Model | None, *, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out`` of predicted language and score; no shuffle."""
    name, position = free_name(docs, out), docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        machines = shared.value

        def compute(batch: pa.RecordBatch) -> pa.Array:
            langs, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            waiting: list[tuple[int, np.ndarray]] = []

            def flush():
                found = machines.predict(np.stack([f for _, f in waiting]))
                for (i, _), lang, score in zip(waiting, *found, strict=True):
                    langs[i], scores[i] = lang, score
                waiting.clear()

            for i, value in enumerate(batch.column(position)):
                made = features(value.as_py()) if machines else None
                if made is not None:
                    waiting.append((i, made))
                if len(waiting) == ROWS:
                    flush()
            if waiting:
                flush()
            return struct_array(RESULT, [langs, scores])

        return compute

    return annotate(docs, name, RESULT, make)


def keep_identified(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang",
    wanted: Sequence[str] | None = None, least_score: float = LEAST_SCORE,
) -> DataFrame:
    """The rows of ``docs`` in a wanted language, with their columns; a null ``lang`` gets the prediction.

    ``wanted`` are languages, by default all that were learned; a row goes if
    the predicted one is not among them, if its text holds no letter, or if the
    prediction's score is below ``least_score``. If nothing can be learned,
    because no text has a language, all rows are passed through with a warning.
    """
    model = fit_model(docs, id=id, text=text, lang=lang)
    if model is None:
        warnings.warn("no text with a language to learn from: all rows are kept", stacklevel=2)
        return docs
    learned = sorted({name for machine in model.within.values() for name in machine.labels})
    if wanted is not None and set(wanted) - set(learned):
        warnings.warn(f"no text in {sorted(set(wanted) - set(learned))} to learn from", stacklevel=2)
    name = free_name(docs, "language")
    found = identify(docs, model, text=text, out=name)
    told = F.col(f"{name}.lang_pred")
    sure = told.isin(list(learned if wanted is None else wanted)) & (F.col(f"{name}.score") >= least_score)
    return found.where(sure).select(
        *[F.coalesce(col(c).cast("string"), told).alias(c) if c == lang else col(c) for c in docs.columns]
    )

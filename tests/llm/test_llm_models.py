"""Predictions of the fitted operators, recomputed row by row in plain Python."""

import math
import os
from collections import Counter

import brute
import numpy as np
import pytest
import regex
from compare import connect

from acequia.llm import language, quality, toxicity

SF_DIR = os.environ.get("ACEQUIA_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def documents():
    return connect(SF_DIR).execute("select doc_id, text, lang from documents").fetchall()


@pytest.fixture(scope="module")
def frame(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang")


# --- quality ----------------------------------------------------------------


def votes(text):
    """The eight rules' votes on one text."""
    words = brute.WORD.findall(text)
    n_words, word_chars, n_symbols, n_dup, n_repeat, _ = brute.measures(text)
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    letters, upper = len(regex.findall(r"\p{L}", text)), len(regex.findall(r"\p{Lu}", text))
    stops = set(quality.STOP_WORDS.split())
    n, m = max(n_words, 1), max(letters, 1)
    ratios = [
        (n_symbols / n, 0.05, 0.2), (upper / m, 0.15, 0.4), (text.count("!") / n, 0.05, 0.2),
        (n_repeat / n, 0.1, 0.3), (n_dup / max(len(lines), 1), 0.1, 0.3),
    ]
    out = [-1 if x > bad else 1 if x < good else 0 for x, good, bad in ratios]
    length = word_chars / n
    out.append(-1 if length < 2 or length > 15 else 1 if 3 <= length <= 10 else 0)
    share = sum(w.lower() in stops for w in words) / n
    out.append(-1 if share < 0.01 else 1 if share > 0.1 else 0)
    share = letters / max(word_chars, 1)
    out.append(-1 if share < 0.6 else 1 if share > 0.85 else 0)
    return tuple(out)


def em(rows, rounds=500):
    """Expectation-maximisation over single documents, the way it is defined."""
    v, n = np.array(rows), len(rows)
    hot = np.stack([v == k for k in (1, 0, -1)], axis=2).astype(float)  # document, rule, vote
    silent = ((v == 0).sum(0) + 1) / (n + 2)
    right, wrong = 0.8 * (1 - silent), (1 - 0.8) * (1 - silent)
    share = np.array([np.stack([right, silent, wrong], 1), np.stack([wrong, silent, right], 1)])
    good, last = 0.8, -math.inf
    for _ in range(rounds):
        logs = np.einsum("drk,crk->dc", hot, np.log(share)) + np.log([good, 1 - good])
        both = np.logaddexp(*logs.T)
        p = np.exp(logs - both[:, None])
        good = min(max((p[:, 0].sum() + 1) / (n + 2), 1e-6), 1 - 1e-6)
        share = (np.einsum("dc,drk->crk", p, hot) + 2 / 3) / (p.sum(0)[:, None, None] + 2)
        if abs(both.sum() - last) < 1e-9 * n:
            break
        last = both.sum()
    logs = np.einsum("drk,crk->dc", hot, np.log(share)) + np.log([good, 1 - good])
    return np.exp(logs[:, 0] - np.logaddexp(*logs.T))


def test_quality_posterior(documents, frame):
    texts = {i: t or "" for i, t, _ in documents}
    judged = {i: t for i, t in texts.items() if not brute.measures(t)[-1]}
    posterior = dict(zip(judged, em([votes(t) for t in judged.values()]), strict=True))
    found = {r["id"]: r for r in quality.judge(frame).collect()}
    assert set(found) == set(texts)
    for i, r in found.items():
        if r["base_failed"]:
            assert i not in posterior and not r["kept"]
        else:
            assert abs(r["quality"] - posterior[i]) < 1e-6
            assert r["kept"] == (posterior[i] >= 0.5)


def test_unsettled_estimate_warns(monkeypatch):
    monkeypatch.setattr(quality, "MOST_ROUNDS", 1)
    with pytest.warns(UserWarning, match="still moved"):
        quality.estimate([((1, -1), 5), ((1, 1), 7), ((-1, 1), 2)])


# --- language ---------------------------------------------------------------


def trigrams(text):
    data = f" {text.lower()} ".encode()
    counts = Counter(
        (a * 40_503 + b * 1_009 + c * 31) % (1 << 32) % language.SIZE for a, b, c in zip(data, data[1:], data[2:], strict=False)
    )
    total = sum(counts.values())
    return {k: math.sqrt(n / total) for k, n in counts.items()}


def choose(machine, features):
    """Votes of all pairs, ties by the sum of margins; the least probability over the winner's pairs."""
    if machine.weights is None:
        return machine.labels[0], 1.0
    won, sums, margins = Counter(), Counter(), {}
    for (i, j), w in zip(machine.pairs, machine.weights, strict=True):
        margin = sum(float(w[k]) * x for k, x in features.items()) + float(w[-1])
        margins[i, j] = margin
        won[i if margin > 0 else j] += 1
        sums[i] += margin
        sums[j] -= margin
    best = max(range(len(machine.labels)), key=lambda k: (won[k], sums[k]))
    least = min(m if i == best else -m for (i, j), m in margins.items() if best in (i, j))
    return machine.labels[best], 1 / (1 + math.exp(-machine.slope * min(max(least, -30), 30)))


def test_language_of_every_text(documents, frame):
    model = language.fit_model(frame)
    found = {r["doc_id"]: r["l"] for r in language.identify(frame, model, out="l").collect()}
    for i, text, _ in documents:
        if text is None or not regex.search(r"\p{L}", text):
            assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0)
            continue
        features = trigrams(text)
        family, sure = choose(model.families, features)
        lang, score = choose(model.within[family], features)
        assert found[i]["lang_pred"] == lang
        assert abs(found[i]["score"] - sure * score) < 1e-3


# --- toxicity ---------------------------------------------------------------

MASK = (1 << 32) - 1


def buckets(text):
    """Runs of 5 and 8 bytes at each place, and words, one after another."""
    words = "".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text.lower()).encode().split()
    line = b" " + b" ".join(words) + b" " * 8
    out = Counter()
    for at in range(len(line) - 7) if words else ():
        code = 0
        for k, byte in enumerate(line[at : at + 8], 1):
            code = (code * 16_777_619 + byte) & MASK
            if k in toxicity.GRAMS:
                out[((code ^ code >> 13) * 2_654_435_761 & MASK) >> 12] += 1
    for word in words:
        code = sum((b + 1) * pow(2_246_822_519, k, 1 << 32) for k, b in enumerate(word, 1)) & MASK
        out[toxicity.BUCKETS + (((code ^ code >> 15) * 2_654_435_761 & MASK) >> 13)] += 1
    return out


def test_toxicity_of_every_text(spark, documents, frame):
    model = toxicity.fit_model(frame, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    weights = dict(zip(model.kept.tolist(), model.weights.tolist(), strict=True))
    found = {r["doc_id"]: r["t"] for r in toxicity.predict(frame, model, out="t").collect()}
    for i, text, _ in documents:
        score = sum(weights.get(b, 0.0) * math.log1p(n) for b, n in buckets(text or "").items() if b in weights)
        above = [1 / (1 + math.exp(min(max(t - score, -60), 60))) for t in model.thresholds.tolist()]
        assert found[i]["grade"] == sum(p >= 0.5 for p in above)
        assert abs(found[i]["expected_severity"] - sum(above)) < 1e-9
        assert found[i]["toxic"] == (above[0] >= 0.5)

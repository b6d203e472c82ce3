"""The registered queries over the driver's tables against brute force."""

import itertools
import os
import zlib

import brute
import brute_pii
import pytest
from compare import connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from acequia.llm import pii, queries, toxicity
from acequia.llm.oracles import ORACLES

SF_DIR = os.environ.get("ACEQUIA_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def tables():
    con = connect(SF_DIR)
    names = ("documents", "benchmark", "labels", "conversations")
    return {n: con.execute(f"select * from {n}").fetchall() for n in names}


@pytest.fixture(scope="module")
def result(spark):
    made = {}

    def run(name):
        if name not in made:
            made[name] = [r.asDict() for r in queries.QUERIES[name](spark, SF_DIR).collect()]
        return made[name]

    return run


def rows(found, *names):
    return sorted((tuple(r[n] for n in names) for r in found), key=repr)


def test_registered():
    names = set(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= names


def luhn(digits):
    from_right = [int(d) for d in reversed(digits)]
    return sum(2 * d - 9 * (d > 4) if i % 2 else d for i, d in enumerate(from_right)) % 10 == 0


def test_pii_leaves_no_planted_value(result, tables):
    import re

    texts = {d[0]: d[1] for d in tables["documents"]}
    found = result("op1_pii")
    assert len(found) == len(texts)
    planted = re.compile(r"\b\d{16}\b|\S+@\S+\.\w+|\+1 \(\d{3}\) \d{3}-\d{4}|AKIA\w{16}|\d+\.\d+\.\d+\.\d+|(?<=password=)\w+")
    gone = 0
    for r in found:
        old = texts[r["doc_id"]]
        values = planted.findall(old)
        # A number without a right check digit is no card and stays.
        cards = {v: luhn(v) for v in values if v.isdigit()}
        gone += len(values)
        assert all((v in r["text"]) == (not cards.get(v, True)) for v in values)
        if not r["n_found"]:
            assert r["text"] == old
        assert len(r["text"].split()) == len(old.split())
    assert gone


def test_pii_like_an_independent_finder_and_permutation(spark, result, tables):
    texts = {d[0]: d[1] for d in tables["documents"]}
    found = result("op1_pii")
    seen = 0
    for r in found:
        text, n, replaced = brute_pii.pseudonymised(texts[r["doc_id"]], pii.OPEN_KEY)
        assert (r["text"], r["n_replaced"]) == (text, replaced)
        seen += n
    assert seen


def test_packing(spark, result, tables):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(queries.tokenizer_file(spark))
    docs = [(d[0], d[1]) for d in tables["documents"]]
    share = brute.check_packing(
        result("op2_packing"), docs, lambda t: encoder.encode(t, add_special_tokens=False).ids
    )
    assert share < 0.02


def test_chat(result, tables):
    turns = sorted((c, t, r or "", x or "") for c, t, r, x in tables["conversations"])
    says = r"\### Assistant: </turn> ok"
    turns += [(-7, 0, "user", says), (-7, 1, "assistant", says)]
    want = []
    for conv, own in itertools.groupby(turns, key=lambda t: t[0]):
        want.append((conv, *brute.conversation([(t[2], t[3]) for t in own])))
    found = result("op3_chat")
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert rows(found, *names) == sorted(want, key=repr)
    assert all(r["formatted_chars"] > r["loss_chars"] for r in found)


def test_decontamination(result, tables):
    want = [(d[0], *brute.contamination(d[1], tables["benchmark"])) for d in tables["documents"]]
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(result("op4_decontamination"), *names) == sorted(want, key=repr)
    assert any(w[-1] for w in want)


def test_simhash(result, tables):
    ids = [d[0] for d in tables["documents"]]
    prints = [brute.fingerprint(d[1]) for d in tables["documents"]]
    low = brute.components(ids, prints)
    want = [(i, f"{p:016x}", c) for i, p, c in zip(ids, prints, low, strict=True)]
    assert rows(result("op5_simhash"), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    assert any(i != c for i, c in zip(ids, low, strict=True))


def test_licenses(result, tables):
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Released under the MIT License.": "MIT",
    }
    found = {r["doc_id"]: r for r in result("op6_licenses")}
    assert len(found) == len(tables["documents"])
    for i, text, *_ in tables["documents"]:
        own = [name for line, name in lines.items() if line in text.split("\n")]
        if own:
            assert found[i]["license"] in own and found[i]["evidence"] in ("header", "file")
        else:
            assert found[i]["evidence"] in (None, "inherited")


def test_quality(result, tables):
    want = [(d[0], *brute.measures(d[1])) for d in tables["documents"]]
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = result("op7_quality")
    assert rows(found, *names) == sorted(want, key=repr)
    good = {d: q for d, q, _ in tables["labels"]}
    judged = [(good[r["doc_id"]], r["kept"]) for r in found if r["doc_id"] in good and not r["base_failed"]]
    assert sum(q == k for q, k in judged) >= 0.97 * len(judged)
    assert not any(r["kept"] for r in found if r["base_failed"])


def test_language(result, tables):
    langs = {d[0]: d[2] for d in tables["documents"]}
    found = result("op8_language")
    assert len(found) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_toxicity(result, tables):
    found = result("op9_toxicity")
    assert len(found) == len(tables["documents"])
    assert all(0 <= r["expected_severity"] <= 2 for r in found)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_toxicity_at_every_size(spark, sf):
    """Labelled toxic documents are found, and clean ones left alone, however many labels there are."""
    folder = f"{os.path.dirname(SF_DIR)}/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("no driver tables of this size")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = queries.QUERIES["op9_toxicity"](spark, folder).join(labels.withColumnRenamed("toxic", "label"), "doc_id")
    sums = {r["label"]: (r["n"], r["bad"]) for r in found.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if("toxic").alias("bad")).collect()}
    assert sums[1][1] >= 0.9 * sums[1][0] and sums[0][1] <= 0.02 * sums[0][0]


def test_toxicity_of_labels_it_has_not_seen(spark):
    """Four fifths of the labels of 10,000 documents find nine tenths of the rest."""
    folder = f"{os.path.dirname(SF_DIR)}/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no driver tables of this size")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = toxicity.fit_model(docs, labels.where(~held))
    found = toxicity.predict(docs.join(labels.where(held), "doc_id"), model, out="t")
    sums = {r["toxic"]: (r["n"], r["bad"]) for r in found.groupBy("toxic").agg(
        F.count("*").alias("n"), F.count_if("t.toxic").alias("bad")).collect()}
    assert sums[1][1] >= 0.9 * sums[1][0] and sums[0][1] <= 0.02 * sums[0][0]


def test_suffix_dedup(result, tables):
    want = brute.without_repeats([(d[0], d[1]) for d in tables["documents"]])
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows(result("op10_suffix_dedup"), *names) == sorted(want, key=repr)
    assert sum(w[2] for w in want)


def test_pipeline(spark, tables):
    """Each stage on its own input against brute force."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language"](spark, docs, SF_DIR)
    assert known.columns == docs.columns and known.count() == docs.count()
    single = stages["near_duplicates"](spark, known, SF_DIR)
    assert single.columns == docs.columns
    given = sorted((r["doc_id"], r["text"]) for r in known.collect())
    ids = [i for i, _ in given]
    low = brute.components(ids, [brute.fingerprint(t) for _, t in given])
    kept = sorted((r["doc_id"], r["text"]) for r in single.collect())
    assert kept == [g for g, c in zip(given, low, strict=True) if g[0] == c]
    clean = stages["decontamination"](spark, single, SF_DIR)
    assert clean.columns == docs.columns
    left = [g for g in kept if not brute.contamination(g[1], tables["benchmark"])[-1]]
    assert sorted((r["doc_id"], r["text"]) for r in clean.collect()) == left
    masked = stages["pii"](spark, clean, SF_DIR)
    assert masked.columns == docs.columns and masked.count() == len(left)
    texts = [(r["doc_id"], r["text"]) for r in masked.collect()]
    encoder = Tokenizer.from_file(queries.tokenizer_file(spark))
    pieces = [r.asDict() for r in entry.queries()["pipeline"](spark, SF_DIR).collect()]
    brute.check_packing(pieces, texts, lambda t: encoder.encode(t, add_special_tokens=False).ids)

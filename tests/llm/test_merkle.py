"""The Merkle manifest against a plain recursive tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from acequia.llm import merkle

random.seed(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    told = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return sha("".join(told))


def plain_tree(nodes):
    """The top, and for each leaf its steps (place, others)."""
    paths = [[] for _ in nodes]
    owner = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [list(range(i, min(i + 3, len(nodes)))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for k, at in enumerate(run):
                for leaf in owner[at]:
                    paths[leaf].append((k, [nodes[j] for j in run if j != at]))
        owner = [sum((owner[j] for j in run), []) for run in runs]
        nodes = [sha("".join(nodes[j] for j in run)) for run in runs]
    return nodes[0], paths


def plain(rows):
    """(id, leaf, subroot, root, proof_sha256) of rows (id, source, text)."""
    leaves = {}
    for r in rows:
        leaves.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, plain_leaf(r)))
    names = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(leaves[s])]) for s in names}
    root, above = plain_tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for (known, i, leaf), steps in zip(sorted(leaves[s]), trees[s][1], strict=True):
            told = sha("".join(h for _, others in steps + up for h in others))
            out.append((i if known else None, leaf, trees[s][0], root, told))
    return sorted(out, key=repr)


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    clash = {c: F.lit("clash") for c in ("tree", "pos", "n", "hash", "id", "block", "items", "claim", "root")}
    return docs.withColumns(clash).withColumn("leaf", merkle.leaf(*map(F.col, ("doc_id", "source", "text"))))


ROWS = [(i, "hot", f"text {i}\nof") for i in range(300)]
ROWS += [(i, random.choice("abcdef"), "x" * (i % 50)) for i in range(1000, 1200)]
ROWS += [(1, None, None), (None, None, "ü"), (None, "hot", None), (5, "lone", ""), (7, "é", "z"), (8, "", "z")]
ROWS += [(77, "hot", "again"), (77, "hot", "again"), (9, "long", "y" * 300_000)]


@pytest.mark.parametrize("every", [1, 2, 4])
def test_all_rows(spark, every):
    docs = frame(spark, ROWS).repartition(7)
    found = merkle.prove(merkle.manifest(docs, every=every), with_siblings=True).collect()
    names = ("id", "leaf", "subroot", "root", "proof_sha256")
    assert sorted((tuple(r[n] for n in names) for r in found), key=repr) == plain(ROWS)
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in found)
    for r in found:  # the proof alone leads to the root
        steps = [(s["place"], s["others"]) for s in r["proof"]]
        assert merkle.fold(r["leaf"], steps) == r["root"]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 81, 82, 243, 244])
def test_sizes_around_powers(spark, n):
    rows = [(i, "s", str(i)) for i in range(n)]
    made = merkle.manifest(frame(spark, rows), every=2)
    found = [tuple(r[:5]) for r in merkle.prove(made).collect()]
    assert sorted(found, key=repr) == plain(rows)
    assert made.root.collect()[0]["root"] == found[0][3]


def test_stored_levels_only(spark):
    """Every second level is stored: 300 leaves need 6 levels, of which 0, 2 and 4 are stored."""
    made = merkle.manifest(frame(spark, [(i, "s", "t") for i in range(300)]), every=2)
    assert len(made.sources.levels) == 3
    assert [level.selectExpr("sum(size(items))").first()[0] for level in made.sources.levels] == [300, 34, 4]


def test_tampered_claims_fail(spark):
    docs = frame(spark, ROWS).withColumn("claim", F.when(F.col("doc_id") % 5 == 0, F.sha2("leaf", 256)).otherwise(F.col("leaf")))
    found = merkle.prove(merkle.manifest(docs, claim="claim")).collect()
    assert len(found) == len(ROWS)
    for r in found:
        assert r["verified"] == (r["id"] is None or r["id"] % 5 != 0)


def test_a_third_of_equal_rows(spark):
    rows = [(1, "s", "same")] * 100 + [(i, "s", "other") for i in range(2, 202)]
    found = merkle.prove(merkle.manifest(frame(spark, rows).repartition(5))).collect()
    assert sorted((tuple(r[:5]) for r in found), key=repr) == plain(rows)


def test_empty(spark):
    made = merkle.manifest(frame(spark, []))
    assert merkle.prove(made).collect() == [] and made.root.collect() == []

"""Exact dedup by chunk recipes against plain grouping of whole texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from acequia.llm import chunk_dedup

random.seed(4)


def noise(n):
    return "".join(chr(random.randint(32, 126)) for _ in range(n))


LONG = noise(200_000)
ROWS = [
    (1, "short"), (2, "short"), (2, "short"), (3, None), (4, ""), (None, ""), (None, "alone"), (None, "alone"),
    (5, LONG), (6, LONG), (7, LONG[:-1]), (8, LONG[:-1] + "\0"), (9, "a" * 100_000), (10, "a" * 100_000),
    (11, "a" * 99_999), (12, LONG[1:]), (13, LONG + LONG), (14, "Short"), (15, "short "), (16, "漢字" * 3000),
]
ROWS += [(100 + i, "copied a thousand times " * 40) for i in range(1000)]
#: Texts of the same chunks in another order, or with one repeated.
BLOCKS = ["x" * 16384, "y" * 16384, "z" * 16384]
ROWS += [(20, "".join(BLOCKS)), (21, "".join(BLOCKS[::-1])), (22, "".join(BLOCKS[:2] + BLOCKS)), (23, "".join(BLOCKS))]


def plain(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    out = []
    for text, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is None, -(i or 0)))
        for k, i in enumerate(order):
            out.append((i, order[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    names = ("id", "hash", "bytes", "row", "ids", "text_sha256", "n_bytes", "numbers", "keep_id", "sha256")
    return docs.withColumns({c: F.lit("clash") for c in names})


def found(spark, rows, **options):
    got = chunk_dedup.find_copies(frame(spark, rows), **options)
    names = ("id", "keep_id", "group_size", "kept", "text_sha256")
    return sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr)


def test_whole_table(spark):
    assert found(spark, ROWS) == plain(ROWS)


@pytest.mark.parametrize("bits", [1, 4])
def test_contents_that_share_a_hash(spark, bits):
    """With hashes of one bit nearly all contents share one; bytes tell them apart."""
    assert found(spark, ROWS, hash_bits=bits) == plain(ROWS)


def test_empty(spark):
    assert found(spark, []) == []


def test_cuts_depend_on_the_text_alone():
    texts = [noise(n) .encode() for n in (0, 1, 15, 511, 512, 513, 5000, 70_000, 3_000_000)] + [b"a" * 50_000]
    alone = [chunk_dedup.cuts([t])[0] for t in texts]
    assert chunk_dedup.cuts(texts) == alone
    assert chunk_dedup.cuts(texts[::-1]) == alone[::-1]
    for text, ends in zip(texts, alone, strict=True):
        sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
        assert sum(sizes) == len(text) and all(s <= chunk_dedup.MOST for s in sizes)
        assert all(s >= chunk_dedup.LEAST for s in sizes[:-1])
    # An insertion changes the chunks near it only.
    text = texts[8]
    changed = text[:1_000_000] + b"inserted" + text[1_000_000:]
    chunks = [{t[a:b] for a, b in zip([0, *e], e, strict=False)} for t in (text, changed) for e in chunk_dedup.cuts([t])]
    assert len(chunks[1] - chunks[0]) <= 4


def test_distinct_chunks_move_without_documents(spark):
    """Copies add no chunk: a chunk is sent once however many documents hold it."""
    rows = [(i, LONG) for i in range(200)]
    distinct = chunk_dedup.distinct_chunks(frame(spark, rows).select("text"))
    assert distinct.count() == len(chunk_dedup.cuts([LONG.encode()])[0])


def test_rows_that_stay(spark):
    docs = frame(spark, ROWS)
    stays = chunk_dedup.keep_one(docs)
    assert stays.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"] or "") for r in stays.collect()), key=repr)
    want = {(w[1], w[4]) for w in plain(ROWS)}
    assert [(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in got] == sorted(
        ((i, s) for i, s in want), key=lambda x: repr([g for g in got if hashlib.sha256(g[1].encode()).hexdigest() == x[1]][0])
    )

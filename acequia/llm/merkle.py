"""Merkle manifest of a table: checkpointed levels, proofs regenerated from them.

Every row is a leaf, the digest of its fields. The leaves of one source, in
order of id, form a tree of arity 3, its top the source's subroot; the subroots
in order of source form a tree of the same kind, its top the root.

*Checkpoint*: of every tree only each ``every``-th level is stored, as blocks of
``3 ** every`` neighbouring nodes, one row a block. A block is an aligned
subtree: its interior follows from it alone. A level is made from the stored
one below by one grouped list of bounded length, so a tree of N leaves takes
log(N) / log(81) rounds, and no task sees more of a source than its blocks.

*Recompute*: proofs go from the root down. A block is joined with the path of
its top, the nodes between are hashed anew, each child's siblings are emitted
and the nodes are discarded. A proof is the path of a leaf to the root, a place
and the other nodes of the run for each level.

*Places*: rows are sorted by range over (source, id, leaf), counted per source
and range, and numbered by the cumulative counts, so a source that holds a
third of all rows is spread over tasks like the rest.

Defined cases: a null field is ``-``, a null source the first one; null ids
come first; rows of one id are ordered by leaf, and equal rows may change
places, which changes no digest; a lone leaf is its own subroot, a lone subroot
the root, and the proof then has no siblings (digest of nothing); an empty
table has no root and gives no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acequia.llm.common import batch_of, col
from acequia.session import materialize

ARITY = 3
#: Levels from one stored level to the next.
EVERY = 4

_STEP = T.StructType(
    [T.StructField("place", T.IntegerType()), T.StructField("others", T.ArrayType(T.StringType()))]
)
_PATH = [
    T.StructField("above", T.ArrayType(_STEP)),
    T.StructField("subroot", T.StringType()),
    T.StructField("root", T.StringType()),
]
_NODE = T.StructType(
    [
        T.StructField("tree", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("hash", T.StringType()),
    ]
)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    told = []
    for field in fields:
        value = field.cast("string")
        told.append(
            F.when(value.isNull(), "-").otherwise(
                F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
            )
        )
    return F.sha2(F.concat(*told), 256)


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def subtree(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a block level by level, the given ones first; a run of one is hashed too."""
    made = [nodes]
    for _ in range(levels):
        below = made[-1]
        made.append([digest(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return made


def siblings(made: list[list[str]], at: int) -> list[tuple[int, list[str]]]:
    """For child ``at`` of a block: its place in its run and the run's others, level by level."""
    steps = []
    for nodes in made[:-1]:
        first = at - at % ARITY
        run = nodes[first : first + ARITY]
        steps.append((at % ARITY, run[: at - first] + run[at - first + 1 :]))
        at //= ARITY
    return steps


def fold(node: str, steps: list[tuple[int, list[str]]]) -> str:
    """The top that ``node`` leads to with these siblings."""
    for place, others in steps:
        node = digest([*others[:place], node, *others[place:]])
    return node


def with_places(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, ...) with ``pos``, the place within the tree from 0, and ``n``, the tree's rows."""
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    by = ["tree", *order, "tie"]
    ranged = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    line = F.monotonically_increasing_id()  # the task, and the place in it
    ranged = materialize(ranged.withColumn("line", line), "merkle-order")
    ranged = ranged.withColumn("task", F.shiftright("line", 33))
    counted = ranged.groupBy("tree", "task").agg(F.min("line").alias("first"), F.count("*").alias("own"))
    counted = counted.select(
        "tree",
        "task",
        (F.expr("sum(own) over (partition by tree order by task) - own") - F.col("first")).alias("shift"),
        F.expr("sum(own) over (partition by tree)").alias("n"),
    )
    placed = ranged.join(counted, ["tree", "task"])
    return placed.withColumn("pos", F.col("line") + F.col("shift")).drop("line", "task", "shift")


@dataclass
class Tree:
    """Stored levels of the trees of one kind and their tops.

    ``levels[c]`` holds the nodes ``c * every`` levels above the leaves:
    (tree, block, n, items), ``n`` the nodes of that level in the tree.
    """

    levels: list[DataFrame]
    tops: DataFrame  # tree, hash, level: the number of the stored level below the top
    every: int


def _up(block_rows: DataFrame, every: int) -> DataFrame:
    """The node above each block: (tree, pos, n, hash), ``n`` the nodes on its level."""
    width = ARITY**every

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            tops = [subtree(r["nodes"], min(every, height(r["n"])))[-1][0] for r in rows]
            left = [-(-r["n"] // width) for r in rows]
            yield batch_of(_NODE, [[r["tree"] for r in rows], [r["block"] for r in rows], left, tops])

    return block_rows.select("tree", "block", "n", F.col("items.hash").alias("nodes")).mapInArrow(run, _NODE)


def build(rows: DataFrame, order: list[str], *, every: int = EVERY) -> Tree:
    """Trees over ``rows`` (tree, hash, and what each leaf carries), leaves by ``order`` and hash."""
    width = ARITY**every
    carried = [c for c in rows.columns if c != "tree"]
    nodes = with_places(rows, [*order, "hash"])
    levels, tops = [], []
    while True:
        item = F.struct("pos", *[c for c in nodes.columns if c in carried])
        blocks = nodes.groupBy("tree", "n", F.expr(f"pos div {width}").alias("block")).agg(
            F.array_sort(F.collect_list(item), lambda a, b: (a["pos"] - b["pos"]).cast("int")).alias("items")
        )
        levels.append(materialize(blocks, "merkle-level"))
        above = _up(levels[-1], every)
        tops.append(above.where("n = 1").select("tree", "hash", F.lit(len(tops)).alias("level")))
        if levels[-1].where(f"n > {width}").isEmpty():
            break
        nodes = above.where("n > 1")
        carried = ["hash"]
    found = tops[0]
    for more in tops[1:]:
        found = found.union(more)
    return Tree(levels, materialize(found, "merkle-tops"), every)


def _down(blocks: DataFrame, tops: DataFrame, every: int, emit, schema: T.StructType) -> DataFrame:
    """For each child of each block what ``emit`` makes of it and its path to the root."""
    joined = blocks.join(tops.withColumnRenamed("pos", "block"), ["tree", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few blocks at a time: paths are longer than what they are made from.
            for at in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(at, 64).to_pylist():
                    made = subtree([i["hash"] for i in r["items"]], min(every, height(r["n"])))
                    above = [(s["place"], s["others"]) for s in r["above"]]
                    for k, item in enumerate(r["items"]):
                        out.append(emit(r, item, siblings(made, k) + above))
                yield batch_of(schema, list(zip(*out, strict=True)) or [[] for _ in schema.fields])

    return joined.mapInArrow(run, schema)


def descend(tree: Tree, paths: DataFrame, emit, schema: T.StructType) -> DataFrame:
    """``emit`` of every leaf; ``paths`` (tree, above, subroot, root) lead from the tops to the root."""
    kind = T.StructType([T.StructField("tree", T.StringType()), T.StructField("pos", T.LongType()), *_PATH])

    def node(row: dict, item: dict, steps: list) -> tuple:
        named = [{"place": p, "others": o} for p, o in steps]
        return row["tree"], item["pos"], named, row["subroot"], row["root"]

    tops = tree.tops.join(paths, "tree").withColumn("pos", F.lit(0).cast("long"))
    known = None
    for level in range(len(tree.levels) - 1, -1, -1):
        here = tops.where(F.col("level") == level).select(*kind.names)
        here = here if known is None else here.union(known)
        last = level == 0
        known = _down(tree.levels[level], here, tree.every, emit if last else node, schema if last else kind)
    return known


@dataclass
class Manifest:
    """Trees of the sources, the tree of their subroots and (in one row) the root."""

    sources: Tree
    table: Tree

    @property
    def root(self) -> DataFrame:
        return self.table.tops.select(F.col("hash").alias("root"))


def manifest(
    rows: DataFrame, *, id: str = "doc_id", source: str = "source", hash: str = "leaf", claim: str | None = None,
    every: int = EVERY,
) -> Manifest:
    """The manifest of ``rows`` with a leaf digest each, and a claimed digest to be verified against it."""
    # Keeps the order of sources, null first, and joins null with null.
    tree = F.coalesce(F.concat(F.lit("="), col(source).cast("string")), F.lit("")).alias("tree")
    leaves = rows.select(
        tree, col(id).alias("id"), col(hash).alias("hash"), col(claim or hash).alias("claim")
    )
    sources = build(leaves, ["id"], every=every)
    subroots = sources.tops.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "hash")
    return Manifest(sources, build(subroots, ["source"], every=every))


def prove(made: Manifest, *, with_siblings: bool = False) -> DataFrame:
    """One row per leaf: its proof's digest, and where its claim leads with the proof's siblings.

    ``with_siblings`` adds the proof itself: a place and the others of the run
    for each level, up to the root.
    """
    text = T.StringType()
    kind = T.StructType([T.StructField("tree", text), *_PATH])

    def subroot(row: dict, item: dict, steps: list) -> tuple:
        named = [{"place": p, "others": o} for p, o in steps]
        return item["source"], named, item["hash"], row["root"]

    top = made.table.tops.select(
        "tree", F.expr("array()").cast(_PATH[0].dataType).alias("above"), F.lit("").alias("subroot"),
        F.col("hash").alias("root"),
    )
    paths = descend(made.table, top, subroot, kind)

    id_kind = made.sources.levels[0].schema["items"].dataType.elementType["id"].dataType
    out = T.StructType(
        [
            T.StructField("id", id_kind),
            *[T.StructField(c, text) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")],
            T.StructField("verified", T.BooleanType()),
            *([T.StructField("proof", _PATH[0].dataType)] if with_siblings else []),
        ]
    )

    def result(row: dict, item: dict, steps: list) -> tuple:
        told = digest([h for _, others in steps for h in others])
        folded = fold(item["claim"], steps)
        found = (item["id"], item["hash"], row["subroot"], row["root"], told, folded, folded == row["root"])
        return (*found, [{"place": p, "others": o} for p, o in steps]) if with_siblings else found

    return descend(made.sources, paths, result, out)

"""Merkle dataset manifest: a proof for every row, with a small upper tree that is built on the driver and broadcast.

Leaves are digests of rows.  Those of one tree (a language, say) stand in the order of their ids; while several nodes remain, every ``FANOUT``
consecutive ones (the last run may have fewer, even one) become the digest of their digests.  What remains is the tree's subroot; a lone
leaf is one itself.  The subroots, in the order of their trees' names (null first, then UTF-8 bytewise), give the root in the same way.

* Order.  Leaves are stored, range-partitioned by (tree, id, digest, a number of the row), sorted, and numbered where they lie.  The rows of each tree in each
  partition are counted, and the sums of the counts turn numbers into places, so no task sorts a whole tree, and an id that a third of the rows share fills none.
* Large blocks.  ``FANOUT ** levels`` consecutive leaves are a block, which one task reduces to one node (``levels`` times at once).  While more than ``top`` nodes are left, nodes are
  reduced again in blocks; with two rounds and the defaults, 6 x 10^10 leaves leave fewer than ``top``.
* Upper tree.  The driver builds the rest, and broadcasts for each of its at most ``top`` nodes the suffix of the path: the siblings from there to the root
  (a few kilobytes a node).  Suffixes of nodes below later rounds are finished by the executors, block by block, and joined.
* Proofs.  Executors meet each block of leaves with its suffix and write every row's proof, from which ``fold`` computes a root again, row by row, as an expression.

Nulls: a null field of a leaf is ``-``; a null tree is a tree of its own and comes first; null ids come first in their tree.  Rows with equal ids are ordered by
their digests; rows that repeat are leaves of their own.  Empty texts have the length 0.  An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protomill.llm.common import stored

#: Nodes that become one.
FANOUT = 8
#: Levels that a block of leaves is reduced by: 4,096 leaves become one node.
LEVELS = 4
#: Nodes that the driver builds the upper tree from, at most.
TOP = 4096
#: Siblings to the left and right of a node, level by level, as text.
PROOF = "array<struct<before:string,after:string>>"
_PROOF_TYPE = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

Step = tuple[str, str]


def field(c: Column) -> Column:
    """A field of a leaf: its length in bytes and its text, or ``-`` if null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """The digest of a row's fields, in order."""
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def climb(nodes: list[str], levels: int | None = None) -> list[list[str]]:
    """Levels from ``nodes`` up: so many, or until one node is left."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([digest(last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return out


def proofs(levels: list[list[str]], suffix: list[Step]) -> list[list[Step]]:
    """The steps of every node of the lowest level, ending with those of the one node at the top."""
    paths = [suffix]
    for nodes in reversed(levels[:-1]):
        mine = []
        for i in range(len(nodes)):
            first = i - i % FANOUT
            mine.append([("".join(nodes[first:i]), "".join(nodes[i + 1 : first + FANOUT])), *paths[i // FANOUT]])
        paths = mine
    return paths


@dataclass
class Above:
    """What lies above a node: the rest of its path, its tree's subroot and the root."""

    path: list[Step]
    subroot: str
    root: str


def upper_tree(nodes: list[tuple[str, int, str]], forest: bool = True) -> dict[tuple[str, int], Above]:
    """By (tree, place): what lies above each of the (tree, place, digest).  Without ``forest`` there is one tree, whose subroot is the root."""
    trees: dict[str, list[str]] = {}
    for tree, _, node in sorted(nodes):
        trees.setdefault(tree, []).append(node)
    own = {tree: climb(some) for tree, some in trees.items()}
    over = climb([levels[-1][0] for levels in own.values()])
    rest = proofs(over, []) if forest and own else [[] for _ in own]
    out = {}
    for (tree, levels), path in zip(own.items(), rest, strict=True):
        for place, steps in enumerate(proofs(levels, path)):
            out[tree, place] = Above(steps, levels[-1][0], over[-1][0])
    return out


def in_places(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (with ``tree``) and ``pos``, the place in the tree by ``order``, and ``size``, the tree's rows."""
    numbered = stored(rows.withColumn("row", F.monotonically_increasing_id()), "merkle-rows")  # read twice: for its sample and its order
    keys = ["tree", *[F.col(c).asc_nulls_first() for c in order], "row"]
    ranged = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("row")
    lined = stored(ranged.withColumn("seq", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftrightunsigned("seq", 33)  # the number of the partition
    counts = lined.groupBy("tree", part.alias("part")).agg(F.min("seq").alias("least"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("tree", "part", "least", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    placed = lined.withColumn("part", part).join(starts, ["tree", "part"])
    return placed.withColumn("pos", F.col("seq") - F.col("least") + F.col("before")).drop("seq", "part", "least", "before")


def _sorted_nodes(table: pa.Table) -> tuple[pa.Table, list[str]]:
    table = table.sort_by("pos")
    return table, [x.hex() for x in table.column("node").to_pylist()]


def _levels_of(size: int, levels: int) -> int | None:
    """Levels that a block of a tree of ``size`` nodes goes up: until one node is left if it is the only one."""
    return levels if size > FANOUT**levels else None


def reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, node, size): one node for each block of nodes."""

    def reduce(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        size = table.column("size")[0].as_py()
        _, found = _sorted_nodes(table)
        top = climb(found, _levels_of(size, levels))[-1]
        after = -(-size // FANOUT**levels)
        return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "node": [bytes.fromhex(top[0])], "size": pa.array([after], pa.int64())})

    some = nodes.select("tree", _block(levels), "pos", "node", "size")
    return some.groupBy("tree", "block").applyInArrow(reduce, "tree string, pos long, node binary, size long")


def _block(levels: int) -> Column:
    return F.shiftright("pos", 3 * levels).alias("block")


def above_nodes(nodes: DataFrame, levels: int, top: int, forest: bool = True) -> dict[tuple[str, int], Above] | DataFrame:
    """What lies above every node: from the driver if there are at most ``top``, else a table (tree, pos, path, subroot, root)."""
    some = nodes.limit(top + 1).collect()
    if len(some) <= top:
        return upper_tree([(r["tree"], r["pos"], r["node"].hex()) for r in some], forest)
    if forest and not nodes.where("size > 1").take(1):  # more trees than that: their subroots are the leaves of one tree
        lined = in_places(nodes.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), "name")
        lined = stored(lined, "merkle-subroots")
        found = with_above(lined, ["name"], above_nodes(stored(reduced(lined, levels), "merkle-nodes"), levels, top, forest=False), levels)
        return found.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("proof").alias("path"), F.lower(F.hex("node")).alias("subroot"), "root")
    above = above_nodes(stored(reduced(nodes, levels), "merkle-nodes"), levels, top, forest)
    return with_above(nodes, ["tree", "pos"], above, levels).select("tree", "pos", F.col("proof").alias("path"), "subroot", "root")


def with_above(nodes: DataFrame, keep: list[str], above: dict[tuple[str, int], Above] | DataFrame, levels: int) -> DataFrame:
    """``keep``, node, proof, subroot and root of every node; ``above`` says what lies above each block of them."""
    some = nodes.select("tree", _block(levels), "node", "size", *[c for c in dict.fromkeys([*keep, "pos"]) if c != "tree"])
    schema = T.StructType([*some.select(*keep, "node").schema.fields, *T.StructType.fromDDL(f"proof {PROOF}, subroot string, root string").fields])

    def finish(table: pa.Table, over: Above) -> pa.Table:
        table, found = _sorted_nodes(table)
        size = table.column("size")[0].as_py()
        steps = proofs(climb(found, _levels_of(size, levels)), over.path)
        proof = pa.array([[{"before": b, "after": a} for b, a in s] for s in steps], _PROOF_TYPE)
        columns = [table.column(c) for c in [*keep, "node"]]
        columns += [proof, pa.array([over.subroot] * len(found)), pa.array([over.root] * len(found))]
        return pa.table(columns, names=schema.names)

    if isinstance(above, DataFrame):

        def meet(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
            r = right.to_pylist()[0]
            return finish(left, Above([(s["before"], s["after"]) for s in r["path"]], r["subroot"], r["root"]))

        return some.groupBy("tree", "block").cogroup(above.groupBy("tree", "pos")).applyInArrow(meet, schema)

    shared = nodes.sparkSession.sparkContext.broadcast(above)  # ``top`` suffixes at most

    def alone(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return finish(table, shared.value[key[0].as_py(), key[1].as_py()])

    return some.groupBy("tree", "block").applyInArrow(alone, schema)


def manifest(rows: DataFrame, keep: list[str], leaf: str = "leaf", tree: str = "lang", order: str = "doc_id", levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """``keep`` and leaf, subroot, root and proof of every row.

    ``leaf`` has the rows' digests in hexadecimal; ``tree`` names the tree that a row belongs to, and ``order`` its place there.  Columns may have any names; a
    kept one with the name of a new one is replaced.
    """
    kept = [c for c in keep if c not in ("leaf", "subroot", "root", "proof")]
    name = F.coalesce(F.concat(F.lit("+"), F.col(f"`{tree}`").cast("string")), F.lit(""))  # null before all others
    own = [f"k{i}" for i in range(len(kept))]
    leaves = rows.select(
        name.alias("tree"), F.col(f"`{order}`").alias("id"), F.unhex(F.col(f"`{leaf}`")).alias("node"), *[F.col(f"`{c}`").alias(o) for c, o in zip(kept, own, strict=True)]
    )
    placed = in_places(leaves, "id", "node")
    above = above_nodes(stored(reduced(placed, levels), "merkle-nodes"), levels, top)
    found = with_above(placed, own, above, levels)
    return found.select(*[F.col(o).alias(c) for c, o in zip(kept, own, strict=True)], F.lower(F.hex("node")).alias("leaf"), "subroot", "root", "proof")

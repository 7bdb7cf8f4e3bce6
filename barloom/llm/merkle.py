"""A Merkle manifest of a table: a leaf for each row, a tree for each source, a tree over the sources, and for every row a proof that is folded back to the root.

A parent keeps a copy of its hash state before each child, so a changed child is put in by resuming that copy and hashing it and what stands right of it; nothing
left of it is hashed again. Nodes are numbered within their tree by a range partitioned, stored order, so a source of any size is many tasks: pieces of PIECE nodes
become one node each, pieces of these the next, and the way from a piece to the root comes back down, one row a piece. Texts are read once, for the leaves."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import cut_lineage

FAN, LEVELS = 16, 2
PIECE = FAN ** LEVELS                  # nodes that one group folds, LEVELS levels at once
_HEX = 64                              # a digest's length: one block of the hash, so a state before a child is a few words
_DOWN = "tree string, pos bigint, left array<string>, right array<string>"


def levels_of(nodes: int) -> int:
    """Levels above `nodes` nodes: none above a single one."""
    count = 0
    while nodes > 1:
        nodes, count = -(-nodes // FAN), count + 1
    return count


class Tree:
    """Some levels over a run of nodes, with each parent's hash states before its children."""

    def __init__(self, nodes: list[str], levels: int):
        self.lines, self.states = [], []
        for _ in range(levels):
            line, states, parents = "".join(nodes).encode(), [], []
            for start in range(0, len(nodes), FAN):
                state = hashlib.sha256()
                for at in range(start, min(start + FAN, len(nodes))):
                    states.append(state.copy())
                    state.update(line[at * _HEX:(at + 1) * _HEX])
                parents.append(state.hexdigest())
            self.lines.append(line)
            self.states.append(states)
            nodes = parents
        self.top = nodes

    def beside(self, at: int) -> list[tuple[bytes, bytes]]:
        """Siblings left and right of a node and of each of its parents."""
        out = []
        for line in self.lines:
            start = at - at % FAN
            out.append((line[start * _HEX:at * _HEX], line[(at + 1) * _HEX:(start + FAN) * _HEX]))
            at //= FAN
        return out

    def fold(self, at: int, node: bytes) -> bytes:
        """The top with another node at this place."""
        for line, states in zip(self.lines, self.states, strict=True):
            state = states[at].copy()
            state.update(node + line[(at + 1) * _HEX:(at - at % FAN + FAN) * _HEX])
            node, at = state.hexdigest().encode(), at // FAN
        return node


class Way:
    """The levels from a piece's top to the root: for each the state before the node on the way, and what stands right of it."""

    def __init__(self, left: list[str], right: list[str]):
        self.steps = [(hashlib.sha256(a.encode()), b.encode()) for a, b in zip(left, right, strict=True)]
        self.siblings = "".join(a + b for a, b in zip(left, right, strict=True)).encode()

    def fold(self, node: bytes) -> bytes:
        for state, right in self.steps:
            state = state.copy()
            state.update(node + right)
            node = state.hexdigest().encode()
        return node


# --- leaves and places ------------------------------------------------------------------------------------------------------------------------------------------

def leaf(text: Column) -> Column:
    """The digest of a document's fields, with this text."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[field(F.col(c).cast("string")) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def _leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf and the leaf after tampering (null where there is none); a tree's name sorts as its source does, null first."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    other = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf(F.translate("text", upper, upper.lower())))
    return docs.select(F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0")).alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       leaf(F.col("text").cast("string")).alias("node"), other.alias("other"), F.monotonically_increasing_id().alias("_row"))


def _numbered(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes with `pos`, their place from 0 within their tree, and `size`, its nodes. Only the first tree of a part can begin in an earlier one."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(nodes.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "placed")
    counts = placed.groupBy("_part", "tree").agg(F.count(F.lit(1)).alias("_n"))
    trees = Window.partitionBy("tree")                                           # a tree has at most a row a part here
    counts = counts.select("_part", "tree", F.coalesce(F.sum("_n").over(trees.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(trees).alias("size"))
    inside = Window.partitionBy("_part", "tree").orderBy(*keys)
    ranked = placed.withColumn("_at", F.row_number().over(inside) - 1)
    return ranked.join(counts, ["_part", "tree"]).withColumn("pos", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


# --- up and down ------------------------------------------------------------------------------------------------------------------------------------------------

def _piece(batch) -> tuple[np.ndarray, list, int]:
    """Order of a piece's rows, its nodes in that order, and how many levels it folds."""
    pos = batch.column("pos").to_numpy()
    order = np.argsort(pos)
    return order, batch.column("node").take(pa.array(order)).to_pylist(), min(LEVELS, levels_of(batch.column("size")[0].as_py()))


def _tops(table):
    """One node for a piece."""
    _, nodes, levels = _piece(table)
    size = -(-table.column("size")[0].as_py() // PIECE)
    return pa.table({"tree": [table.column("tree")[0].as_py()], "pos": pa.array([table.column("pos")[0].as_py() // PIECE], pa.int64()), "node": Tree(nodes, levels).top, "size": pa.array([size], pa.int64())})


def _ways(nodes, above):
    """For each node of a piece the siblings from there to the root, nearest first."""
    order, lines, levels = _piece(nodes)
    tree = Tree(lines, levels)
    rest = above.slice(0, 1).to_pylist()[0]
    beside = [tree.beside(i) for i in range(len(order))]
    return pa.table({"tree": nodes.column("tree"), "pos": nodes.column("pos").take(pa.array(order)), "left": pa.array([[a.decode() for a, _ in b] + rest["left"] for b in beside], pa.list_(pa.string())),
                     "right": pa.array([[b.decode() for _, b in s] + rest["right"] for s in beside], pa.list_(pa.string()))})


def _pieces(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("piece", F.floor(F.col("pos") / PIECE))


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, then one for each of their pieces, and so on until every tree is one node; each step is stored."""
    steps, largest = [nodes], nodes.agg(F.max("size")).first()[0] or 0            # one number
    while largest > 1:
        up = _pieces(steps[-1]).groupBy("tree", "piece").applyInArrow(_tops, "tree string, pos bigint, node string, size bigint")
        steps.append(cut_lineage(up, "nodes"))
        largest = -(-largest // PIECE)
    return steps


def _descend(steps: list[DataFrame], ways: DataFrame) -> DataFrame:
    """From the ways of each tree's top to those of the pieces of its lowest nodes."""
    for nodes in reversed(steps[1:-1]):
        ways = cut_lineage(_pieces(nodes).groupBy("tree", "piece").cogroup(ways.groupBy("tree", "pos")).applyInArrow(_ways, _DOWN), "ways")
    return ways


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of `docs`.

    Null fields are hashed as `-`, empty ones as `0:`; a null source is a tree of its own and the first, a null doc_id is the first of its source and never
    tampered with. Rows that repeat an id stand in order of their leaf; equal rows are each a leaf. A very long text is hashed by the engine, never in pieces here.
    An empty table gives no rows; of a single row the leaf is the root and the proof is the digest of nothing. Other columns are left out, whatever their names."""
    nodes = cut_lineage(_leaves(docs), "leaves")
    steps = _climb(cut_lineage(_numbered(nodes, ["tree", "doc_id", "node", "_row"]), "numbered"))
    subroots = steps[-1].select("tree", "node")
    crown = _climb(cut_lineage(_numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), ["tree", "name"]), "sources"))
    root = crown[-1].select("node").first()
    if root is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    root = root[0]
    start = crown[-1].select("tree", "pos", F.array().cast("array<string>").alias("left"), F.array().cast("array<string>").alias("right"))
    if len(crown) > 1:
        lowest = _descend(crown, start)
        start = cut_lineage(_pieces(crown[0]).groupBy("tree", "piece").cogroup(lowest.groupBy("tree", "pos")).applyInArrow(_ways, _DOWN), "ways")
    sources = crown[0].select(F.col("tree").alias("t"), "pos", "name", F.col("node").alias("subroot")).join(start.withColumnRenamed("tree", "t"), ["t", "pos"])
    sources = cut_lineage(sources.select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "left", "right", "subroot"), "ways")
    ways = _descend(steps, sources.select("tree", "pos", "left", "right"))
    ways = ways.join(sources.select("tree", "subroot"), "tree")

    def prove(rows, above):
        order, nodes, levels = _piece(rows)
        way = above.slice(0, 1).to_pylist()[0]
        tree, up = Tree(nodes, levels), Way(way["left"], way["right"])
        others, proofs, folded = rows.column("other").take(pa.array(order)).to_pylist(), [], []
        for i, node in enumerate(nodes):
            beside = tree.beside(i)
            proofs.append(hashlib.sha256(b"".join(x for pair in beside for x in pair) + up.siblings).hexdigest())
            folded.append(up.fold(tree.fold(i, (others[i] or node).encode())).decode())
        k = len(nodes)
        return pa.table({"doc_id": rows.column("doc_id").take(pa.array(order)), "leaf": nodes, "subroot": [way["subroot"]] * k, "root": [root] * k, "proof_sha256": proofs, "folded_root": folded,
                         "verified": [f == root for f in folded]})
    placed = _pieces(steps[0]).select("tree", "piece", "pos", "size", "doc_id", "node", "other")
    return placed.groupBy("tree", "piece").cogroup(ways.groupBy("tree", "pos")).applyInArrow(
        prove, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")

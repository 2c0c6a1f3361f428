"""A Merkle manifest of a table: a digest per row, a ternary tree per source, a tree over the sources, and every row's authentication path.

Leaves stand in range-sorted order, so that no task holds a source; aligned blocks of FAN ** LEVELS of
them are trees of their own. A block's paths come from fractal traversal: of each band of heights one
subtree stands over the leaf at hand and the next one is in the making, a leaf a step. What lies above
a block is a far smaller table of the same kind, whose paths are appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import written

#: Children of a node; heights of a block of leaves; heights of a subtree of the traversal.
FAN, LEVELS, BAND = 3, 8, 2
#: A level of a path: where the node stands among its run, and the others of the run, as hex digests from left to right.
PROOF = "array<struct<at: int, others: string>>"
DIGITS = 64


def leaf_digest(*values: Column) -> Column:
    """Hex sha256 of the values in order, each as its count of UTF-8 bytes, a colon and the value, '-' where it is null; numbers are decimal."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _joined(run: Sequence[bytes]) -> bytes:
    """The node over a run; there is none over a run without nodes."""
    return hashlib.sha256(b"".join(run)).hexdigest().encode() if run and run[0] else b""


class _Subtree:
    """The nodes of heights bottom to top - 1 over the FAN ** top leaves from first on, made from one leaf a step; b'' stands for nodes beyond the last leaf."""

    def __init__(self, leaves: Sequence[bytes], first: int, bottom: int, top: int):
        self.leaves, self.next, self.bottom, self.top = leaves, first, bottom, top
        self.rows: list[list[bytes]] = [[] for _ in range(bottom, top)]
        self.open: list[list[bytes]] = [[] for _ in range(top)]

    def step(self) -> None:
        node = self.leaves[self.next] if self.next < len(self.leaves) else b""
        self.next += 1
        for height, run in enumerate(self.open):
            if height >= self.bottom:
                self.rows[height - self.bottom].append(node)
            run.append(node)
            if len(run) < FAN:
                return
            node = _joined(run)
            run.clear()

    def whole(self) -> _Subtree:
        for _ in range(FAN**self.top):
            self.step()
        return self


def authentication_paths(leaves: Sequence[bytes], height: int, band: int = BAND) -> Iterator[list[tuple[int, bytes]]]:
    """Each leaf's path up to the given height: per level its place in the run and the run's other nodes.

    Of every band of heights there is the subtree over the leaf at hand and the one that comes next, so
    beside the leaves some FAN ** band nodes a band are held, whatever the height.
    """
    bands = [(b, min(b + band, height)) for b in range(0, height, band)]
    coming = lambda first, b, t: _Subtree(leaves, first, b, t) if first < len(leaves) else None
    here = [_Subtree(leaves, 0, b, t).whole() for b, t in bands]
    desired = [coming(FAN**t, b, t) for b, t in bands]
    for i in range(len(leaves)):
        path = []
        for k, (bottom, top) in enumerate(bands):
            if i and i % FAN**top == 0:
                here[k], desired[k] = desired[k], coming(i + FAN**top, bottom, top)
            inside = i % FAN**top
            for height_, row in enumerate(here[k].rows, bottom):
                at = inside // FAN**height_
                start = at - at % FAN
                path.append((at % FAN, b"".join(row[start:at] + row[at + 1 : start + FAN])))
        yield path
        for tree in desired:
            if tree:
                tree.step()


def _height(n: int, levels: int) -> int:
    """Heights of a block in a tree of n nodes of its level: levels, or as many as lead to one node where the block is all there is."""
    height = 0
    while n > FAN**height and height < levels:
        height += 1
    return height


def _placed(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes (tree, ...) with pos, the place in the tree by the given columns, and n, the tree's count. Sorted by ranges; rows that tie in all columns are dealt to several ranges by the column row."""
    by = ("tree", *order, "row")
    nodes = written(nodes.withColumn("row", F.monotonically_increasing_id()), "merkle-nodes")
    ranged = nodes.repartitionByRange(*by).sortWithinPartitions(*by).drop("row")
    ranged = written(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "merkle-order")
    parts = ranged.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    tree = W.partitionBy("tree")  # as many rows as ranges
    ahead = F.coalesce(F.sum("rows").over(tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tree", "part", (ahead - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    return ranged.join(parts, ["tree", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def _blocks(nodes: DataFrame, levels: int, *columns: str) -> DataFrame:
    return nodes.select("tree", F.expr(f"pos div {FAN**levels}").alias("block"), "pos", "n", "digest", *columns)


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """One node a block: (tree, pos, n, digest) of the next level."""

    def run(key: tuple, block: pa.Table) -> pa.Table:
        block, n = block.sort_by("pos"), block.column("n")[0].as_py()
        level = [d.encode() for d in block.column("digest").to_pylist()]
        for _ in range(_height(n, levels)):
            level = [_joined(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "n": [-(-n // FAN**levels)], "digest": [level[0].decode()]})

    return _blocks(nodes, levels).groupBy("tree", "block").applyInArrow(run, "tree string, pos long, n long, digest string")


def _with_paths(nodes: DataFrame, above: DataFrame, levels: int, keep: str = "") -> DataFrame:
    """nodes with the columns of keep (name type, ...), their paths in their blocks and then those of above (tree, pos, proof, subroot, root) for the block."""
    names = [c.split()[0] for c in keep.split(", ")] if keep else []
    above = above.select("tree", F.col("pos").alias("block"), "proof", "subroot", "root")
    step = pa.struct([("at", pa.int32()), ("others", pa.string())])

    def run(block: pa.Table, over: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        leaves = [d.encode() for d in block.column("digest").to_pylist()]
        upper = [(s["at"], s["others"]) for s in over.column("proof")[0].as_py()]
        at, others, ends = [], [], [0]
        for path in authentication_paths(leaves, _height(block.column("n")[0].as_py(), levels)):
            at += [a for a, _ in path] + [a for a, _ in upper]
            others += [o.decode() for _, o in path] + [o for _, o in upper]
            ends.append(len(at))
        proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(others, pa.string())], fields=list(step)))
        same = lambda name: pa.array([over.column(name)[0].as_py()] * len(leaves), pa.string())
        out = {"tree": block.column("tree"), "pos": block.column("pos"), "digest": block.column("digest")} | {c: block.column(c) for c in names}
        return pa.table(out | {"proof": proof, "subroot": same("subroot"), "root": same("root")})

    schema = f"tree string, pos long, digest string, {keep + ', ' if keep else ''}proof {PROOF}, subroot string, root string"
    return _blocks(nodes, levels, *names).groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(run, schema)


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """The roots of all trees of stored nodes: (tree, digest)."""
    while nodes.filter("n > 1").limit(1).count():
        nodes = written(_roots(nodes, levels), "merkle-level")
    return nodes.select("tree", "digest")


def _paths(nodes: DataFrame, roots: DataFrame, over: DataFrame, levels: int, keep: str = "") -> DataFrame:
    """nodes, of whose blocks the roots are stored, with their paths up to the root of their tree, and then those of over (tree, proof, subroot, root). A level more for each factor of FAN ** levels in the largest tree."""
    if roots.filter("n > 1").limit(1).count():
        above = written(_paths(roots, written(_roots(roots, levels), "merkle-level"), over, levels), "merkle-paths")
    else:
        above = roots.select("tree", "pos").join(over, "tree")
    return _with_paths(nodes, above, levels, keep)


def authenticated(leaves: DataFrame, keep: str = "", levels: int = LEVELS) -> DataFrame:
    """leaves (source, doc_id, leaf, and the columns of keep, as 'name type, ...') with pos in the source, proof, subroot and root.

    The tree of a source stands over its leaves in order of doc_id, nulls first, ties by the leaf; a source that is null is
    a source of its own, the first. Rows that repeat each other are leaves of their own, in any order. A lone leaf is its
    tree's root. proof goes from the leaf up to the root over all sources and folds to it by folded(). An empty table gives
    an empty one; a null leaf counts as absent and is an error of the caller.
    """
    tree = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    names = [c.split()[0] for c in keep.split(", ")] if keep else []
    nodes = _placed(leaves.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), F.col("leaf").alias("digest"), *names), "doc_id", "digest")
    roots = written(_roots(nodes, levels), "merkle-level")
    whole = _placed(_tops(roots, levels).select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), "source")
    top = written(_roots(whole, levels), "merkle-level")
    root = _tops(top, levels).select(F.lit("").alias("tree"), F.array().cast(PROOF).alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    over = written(_paths(whole, top, root, levels, "source string").select(F.col("source").alias("tree"), "proof", F.col("digest").alias("subroot"), "root"), "merkle-sources")
    found = _paths(nodes, roots, over, levels, "doc_id long" + (f", {keep}" if keep else ""))
    source = F.when(F.col("tree") != "0", F.expr("substring(tree, 2)"))
    return found.select(source.alias("source"), "doc_id", "pos", F.col("digest").alias("leaf"), *names, "proof", "subroot", "root")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""

    def over(node: Column, level: Column) -> Column:
        others, before = level["others"], level["at"] * DIGITS
        return F.sha2(F.concat(F.substring(others, F.lit(1), before), node, F.substring(others, before + 1, F.length(others))), 256)

    return F.aggregate(proof, leaf, over)


def proof_digest(proof: Column) -> Column:
    """Hex sha256 of a proof's nodes, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["others"]), ""), 256)


def document_leaf(docs: DataFrame, text: Column | None = None) -> Column:
    """The leaf of a row of documents; text stands in for its own text."""
    return leaf_digest(docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"], docs["text"] if text is None else text)


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of documents: source, doc_id, pos, leaf, proof, subroot, root. Nulls, ties and empty tables as in authenticated; other columns take no part."""
    return authenticated(docs.select("source", "doc_id", document_leaf(docs).alias("leaf")), levels=levels)


def tamper_audit(docs: DataFrame, presented: Column, levels: int = LEVELS) -> DataFrame:
    """documents as they were committed, and whether the texts now presented still lead to the root: doc_id, source, leaf, subroot, root, proof, proof_sha256, folded_root, verified.

    The proofs are those of the committed rows; only the leaf is taken from the presented text. Nulls, ties and empty tables as in authenticated.
    """
    rows = docs.select("source", "doc_id", document_leaf(docs).alias("leaf"), document_leaf(docs, presented).alias("now"))
    found = authenticated(rows, "now string", levels)
    out = found.select("doc_id", "source", "leaf", "subroot", "root", "proof", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.col("now"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

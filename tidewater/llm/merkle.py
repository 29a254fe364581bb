"""A manifest of a table as Merkle trees: a digest for each row, a root for each source, one root for all, and a proof for each row.

Rows stand in order within their source. Aligned blocks of ``arity ** levels`` consecutive nodes are walked by a recursive postorder
traversal: it returns the digest of a subtree and, while it unwinds, appends the siblings met there to the leaves inside. The blocks'
roots are the nodes of another distributed traversal, and so on until a source has one root; the sources' roots are walked likewise.
No source is ever in one task: places are counted by range, blocks are small, and a proof is joined from those of the blocks above.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import placed, written

#: Children of a node, and levels of a block.
ARITY, LEVELS = 3, 6
#: What a leaf is made of, in this order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")

Proof = list[tuple[bytes, bytes]]


def leaf(**changed: Column) -> Column:
    """The digest of a row, in hex: of each field ``-`` if null, else the length of its UTF-8 bytes, a colon and itself."""

    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, LEAF)), 256)


def depth(nodes: int, arity: int = ARITY) -> int:
    """Levels until one of ``nodes`` nodes remains."""
    found = 0
    while nodes > 1:
        nodes, found = -(-nodes // arity), found + 1
    return found


def traverse(leaves: list[bytes], height: int, arity: int = ARITY) -> tuple[bytes, list[Proof]]:
    """The digest of the subtree of ``height`` levels over ``leaves`` (in hex), and of each leaf the siblings to its left and right, from below."""
    proofs: list[Proof] = [[] for _ in leaves]

    def visit(first: int, above: int) -> bytes:
        if not above:
            return leaves[first]
        size = arity ** (above - 1)
        starts = range(first, min(first + size * arity, len(leaves)), size)
        children = [visit(start, above - 1) for start in starts]
        for k, start in enumerate(starts):
            beside = b"".join(children[:k]), b"".join(children[k + 1 :])
            for inside in range(start, min(start + size, len(leaves))):
                proofs[inside].append(beside)
        return sha256(b"".join(children)).hexdigest().encode()

    return visit(0, height), proofs


def climbed(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """(tree, place, n, proof, top) of ``nodes`` (tree, place, n, digest) within their blocks; ``n`` counts the nodes of the tree."""
    block = arity**levels
    proof = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))

    def walk(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        digests = [x.hex().encode() for x in group.column("digest").to_pylist()]
        top, proofs = traverse(digests, min(levels, depth(group.column("n")[0].as_py(), arity)), arity)
        raw = [[{"left": bytes.fromhex(a.decode()), "right": bytes.fromhex(b.decode())} for a, b in p] for p in proofs]
        added = {"proof": pa.array(raw, proof), "top": pa.array([bytes.fromhex(top.decode())] * len(group), pa.binary())}
        return pa.table({c: group.column(c) for c in ("tree", "place", "n")} | added)

    dealt = nodes.select("tree", "place", "n", "digest", F.expr(f"place div {block}").alias("block"))
    return dealt.groupBy("tree", "block").applyInArrow(walk, "tree string, place long, n long, proof array<struct<left: binary, right: binary>>, top binary")


def proven(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """(tree, place, proof, root) of ``nodes`` (tree, place, n, digest): the siblings from each node to the root of its tree.

    A round for each ``levels`` levels of the tallest tree, each over a ``arity ** levels``-th of the nodes of the one before.
    """
    block = arity**levels
    rounds = [written(climbed(nodes, arity, levels), "merkle-blocks")]
    while (most := rounds[-1].agg(F.max("n")).first()[0] or 0) > block:
        roots = rounds[-1].where(f"place % {block} = 0")
        above = roots.select("tree", F.expr(f"place div {block}").alias("place"), F.expr(f"(n + {block - 1}) div {block}").alias("n"), F.col("top").alias("digest"))
        rounds.append(written(climbed(above, arity, levels), "merkle-blocks"))
        assert rounds[-1].agg(F.max("n")).first()[0] < most
    found = rounds.pop().select("tree", "place", "proof", F.col("top").alias("root"))
    while rounds:
        upper = found.select("tree", F.col("place").alias("block"), F.col("proof").alias("rest"), "root")
        lower = rounds.pop().select("tree", F.expr(f"place div {block}").alias("block"), "place", "proof")
        found = lower.join(upper, ["tree", "block"]).select("tree", "place", F.concat("proof", "rest").alias("proof"), "root")
    return found


def siblings() -> Column:
    """All siblings of a ``proof``, in hex, level by level and left to right."""
    return F.lower(F.expr("array_join(transform(proof, x -> concat(hex(x.left), hex(x.right))), '')"))


def folded(start: Column) -> Column:
    """The root, in hex, that a leaf ``start`` (in hex) and the siblings of ``proof`` give."""
    return F.aggregate("proof", start, lambda node, x: F.sha2(F.concat(F.lower(F.hex(x["left"])), node, F.lower(F.hex(x["right"]))), 256))


def manifest(docs: DataFrame, arity: int = ARITY, levels: int = LEVELS, **also: Column) -> DataFrame:
    """(doc_id, source, leaf, proof, subroot, root, and ``also``) for each row of ``docs``, all digests in hex.

    ``proof`` has a struct (left, right) for each level from the leaf to the subroot and on to the root: the digests (32 bytes each)
    that stand beside the node's own. ``folded(leaf)`` works the root out from it. A run's last node may stand alone; it is hashed like any
    other, and a tree of one leaf is that leaf. ``also`` are further columns that are worked out on ``docs`` and kept.

    A null in any field is told apart from an empty text. Null sources are one source, the first; rows without doc_id come first in
    their source. Rows that share a doc_id go in order of their leaves; repeated rows are leaves each. An empty table gives an empty
    result. Other columns of ``docs`` aren't read.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null first; the rest in their order
    leaves = docs.select("doc_id", "source", tree.alias("tree"), F.unhex(leaf()).alias("digest"), *[c.alias(f"also_{name}") for name, c in also.items()])
    leaves = written(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    placed_leaves = placed(leaves, ["tree"], ["doc_id", "digest", "row"])
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("n"))
    nodes = written(placed_leaves.join(sizes, "tree"), "merkle-nodes")
    lower = written(proven(nodes, arity, levels), "merkle-proofs")
    tops = written(lower.where("place = 0").select(F.col("tree").alias("name"), F.col("root").alias("digest"), F.lit("").alias("tree")), "merkle-sources")
    ordered = placed(tops, ["tree"], ["name"]).withColumn("n", F.lit(tops.count()).cast("long"))
    upper = proven(written(ordered, "merkle-tops"), arity, levels).withColumnRenamed("proof", "rest").withColumnRenamed("root", "all")
    upper = upper.join(ordered.select("place", "name"), "place").select(F.col("name").alias("tree"), "rest", "all")
    out = nodes.join(lower, ["tree", "place"]).join(upper, "tree")
    text = lambda c: F.lower(F.hex(c))
    kept = [F.col(f"also_{name}").alias(name) for name in also]
    return out.select("doc_id", "source", text("digest").alias("leaf"), F.concat("proof", "rest").alias("proof"), text("root").alias("subroot"), text("all").alias("root"), *kept)

"""Merkle manifests: against a plain tree, and rows that are out of the ordinary."""

from __future__ import annotations

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidewater.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def plain_tree(leaves, arity=3):
    """The root, and of each leaf its siblings level by level, as one text."""
    level, at, seen = list(leaves), list(range(len(leaves))), [""] * len(leaves)
    while len(level) > 1:
        for leaf, i in enumerate(at):
            first = i // arity * arity
            seen[leaf] += "".join(x for j, x in enumerate(level[first : first + arity], first) if j != i)
        level = [digest(*level[i : i + arity]) for i in range(0, len(level), arity)]
        at = [i // arity for i in at]
    return level[0], seen


def plain_manifest(rows, arity=3):
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r))
    by = {}
    for r in sorted(rows, key=key):
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([plain_leaf(r) for r in by[s]], arity) for s in sources}
    root, above = plain_tree([trees[s][0] for s in sources], arity)
    return sorted(
        (str(r["doc_id"]), plain_leaf(r), trees[s][0], root, digest(seen + above[k])) for k, s in enumerate(sources) for r, seen in zip(by[s], trees[s][1], strict=True)
    )


def made(r, n, sources):
    pick = lambda *x: r.choice(x)
    return [dict(doc_id=pick(None, *range(n)) if r.random() < 0.1 else i, text=pick(None, "", "a\nb", "ü ß\n" * 5, str(i)), lang=pick(None, "en"), source=r.choice(sources), n_chars=pick(None, i)) for i in range(n)]


@pytest.mark.parametrize(("n", "sources", "arity", "levels"), [(1, ["a"], 3, 2), (2, ["a", None], 3, 1), (90, [None, "", "a", "ä", "b"], 3, 2), (100, ["only"], 3, 1), (60, [f"s{i}" for i in range(40)], 2, 3), (28, ["x"], 3, 3)])
def test_manifest_is_that_of_a_plain_tree(spark, n, sources, arity, levels):
    rows = made(random.Random(n), n, sources)
    rows += rows[: n // 4]
    docs = spark.createDataFrame([tuple(x[c.split()[0]] for c in DOCS.split(", ")) for x in rows], DOCS).withColumns({c: F.lit("x") for c in ("tree", "place", "digest", "row", "n", "proof", "root", "place_at")})
    found = merkle.manifest(docs, arity, levels).withColumn("sum", F.sha2(merkle.siblings(), 256)).withColumn("again", merkle.folded(F.col("leaf"))).withColumn("wrong", merkle.folded(F.sha2("leaf", 256))).collect()
    assert sorted((str(x.doc_id), x.leaf, x.subroot, x.root, x.sum) for x in found) == plain_manifest(rows, arity)
    assert all(x.again == x.root and x.wrong != x.root for x in found)


def test_an_empty_table_has_an_empty_manifest(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_very_long_texts(spark):
    rows = [dict(doc_id=1, text="long ü " * 200_000, lang="en", source="a", n_chars=5)]
    docs = spark.createDataFrame([(1, rows[0]["text"], "en", "a", 5)], DOCS)
    assert merkle.manifest(docs).first().leaf == plain_leaf(rows[0])

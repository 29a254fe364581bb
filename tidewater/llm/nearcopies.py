"""Near copies for the pipeline: texts whose five-word shingles have a Jaccard similarity of 0.8 or more, besides close fingerprints.

The pigeonhole principle on sets: two sets that are alike share one, at least, of the first shingles of each (a fifth of them, and one) in
any fixed order. Shingles that a bounded sample finds common come last in that order, by which the search costs less; every order finds
every pair. Candidates are verified on their texts, so the links are those of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm import simhash
from tidewater.llm.common import components, gram_hashes, map_rows, mixed, shielded, texts_of, word_hashes, written

#: Words in a shingle; sets are alike if PARTS times their intersection is at least ALIKE times their union.
WORDS, ALIKE, PARTS = 5, 4, 5
#: Documents, about, in which common shingles are counted, and shingles that may be named common; fixed, whatever the size of the corpus.
SAMPLE, COMMON = 4096, 100_000
#: Longs of a text's bitmap: a bit for each hash of 512, odd or even by its shingles.
LONGS = 8
BITS = [f"b{i}" for i in range(LONGS)]
#: Bits of the bitmaps that tell long texts apart before the texts themselves are moved.
WIDE = 8192


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; of a text with fewer words, that of all its words."""
    words = text.lower().split()
    return np.unique(gram_hashes(word_hashes(words), min(WORDS, len(words)))) if words else np.zeros(0, np.uint64)


def first_shingles(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """As many of the rarest shingles as two alike sets can't both differ in; ``common`` is sorted, ``counts`` says how common each is."""
    need = len(found) - (ALIKE * len(found) + PARTS - 1) // PARTS + 1
    if not len(found) or not len(common):
        return found[:need]
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    often = np.where(common[at] == found, counts[at], 0)
    return found[np.lexsort((found, often))[:need]]


def bitmap(found: np.ndarray) -> np.ndarray:
    """Two sets differ in as many shingles, at least, as their bitmaps in bits."""
    odd = np.bincount((found & np.uint64(64 * LONGS - 1)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide(found: np.ndarray) -> bytes:
    """Like ``bitmap``, of ``WIDE`` bits."""
    return np.packbits((np.bincount((found & np.uint64(WIDE - 1)).astype(np.int64), minlength=WIDE) & 1).astype(np.uint8)).tobytes()


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of three documents or more of the sample, in order, and their counts."""
    every = max(1, docs.count() // SAMPLE)

    def work():
        def each(batch):
            found = [shingles(t) for t in texts_of(batch, "text")]
            yield {"h": np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)}

        return each

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(every)) == 0).select("text")
    often = map_rows(some, "h long", work).groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    rows = often.orderBy(F.desc("n"), "h").limit(COMMON).collect()
    hashes, counts = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, fp, node, n, bitmap, firsts): for each document a hash of its text, its fingerprint, its set (with the fingerprint) and its first shingles."""
    common, counts = common_shingles(docs)

    def work():
        def each(batch):
            texts = texts_of(batch, "text")
            sets = [shingles(t) for t in texts]
            fp = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
            # Sums of mixed hashes: a set's hash doesn't hang on its order.
            whole = np.array([int(mixed(s).sum(dtype=np.uint64)) for s in sets], np.uint64)
            maps = np.array([bitmap(s) for s in sets]).reshape(-1, LONGS)
            yield {
                "doc_id": batch.column(0),
                "tag": batch.column(1),
                "fp": fp.view(np.int64),
                "node": mixed(whole * np.uint64(3) + mixed(fp)).view(np.int64),
                "n": np.array([len(s) for s in sets], np.int64),
                **{b: maps[:, i] for i, b in enumerate(BITS)},
                "firsts": pa.array([first_shingles(s, common, counts).view(np.int64) for s in sets], pa.list_(pa.int64())),
            }

        return each

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    columns = ["doc_id long", "tag long", "fp long", "node long", "n long", *[f"{b} long" for b in BITS], "firsts array<long>"]
    return map_rows(narrow, ", ".join(columns), work)


def perhaps_alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose wide bitmaps don't rule out that the texts are alike."""

    def maps():
        def each(batch):
            sets = [shingles(t) for t in texts_of(batch, "text")]
            yield {"node": batch.column(0), "n": np.array([len(s) for s in sets], np.int64), "map": pa.array([wide(s) for s in sets], pa.binary())}

        return each

    def compare():
        def each(batch):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (3, 4))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            keep = pa.array(apart * (PARTS + ALIKE) <= batch.column(2).to_numpy() * (PARTS - ALIKE))
            yield {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

        return each

    found = written(map_rows(texts, "node long, n long, map binary", maps), "near-maps")
    side = lambda s: found.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("map").alias(f"map_{s}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "map_a", "map_b")
    return written(map_rows(joined, "a long, b long", compare), "near-perhaps")


def similarity(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, shared, united) of the pairs (a, b): how many shingles their texts share, and have together.

    Pairs that wide bitmaps show not to be alike are left out before their texts are moved.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "tag"), "node")
    all_texts = docs.select(F.xxhash64("text").alias("tag"), F.coalesce("text", F.lit("")).alias("text"))
    texts = written(all_texts.join(wanted.select("tag").distinct(), "tag", "left_semi").dropDuplicates(["tag"]).join(wanted, "tag").select("node", "text"), "near-texts")
    pairs = perhaps_alike(pairs, texts)

    def work():
        def each(batch):
            shared, united = [], []
            for x, y in zip(texts_of(batch, "x"), texts_of(batch, "y"), strict=True):
                x, y = shingles(x), shingles(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                shared.append(both)
                united.append(len(x) + len(y) - both)
            yield {"a": batch.column(0), "b": batch.column(1), "shared": np.array(shared, np.int64), "united": np.array(united, np.int64)}

        return each

    joined = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    joined = joined.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    return map_rows(joined, "a long, b long, shared long, united long", work)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike: bitmaps rule most of the others out, then texts decide."""
    maps = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), *[F.col(b).alias(f"{b}_{s}") for b in BITS])
    apart = sum((F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in BITS), F.lit(0))
    # Alike sets differ in at most this share of their sizes' sum.
    few = apart * (PARTS + ALIKE) <= (F.col("n_a") + F.col("n_b")) * (PARTS - ALIKE)
    left = written(pairs.join(maps("a"), "a").join(maps("b"), "b").where(few).select("a", "b"), "near-pairs")
    return similarity(left, nodes, docs).where(f"{PARTS} * shared >= {ALIKE} * united").select("a", "b")


def joined(nodes: DataFrame, firsts: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the edges ``known`` (a, b) and of all pairs of alike sets; alike sets share a first shingle.

    ``firsts`` has (key, at, node, n) for each first shingle, the ``at``-th of its set in the order of all. Two sets of which it is the first that
    they share have no more in common than stands from there on in either, which rules out pairs before they are made. At first each text is compared with one of each first shingle's texts: that whose own
    first shingles are shared most, as those of a text are that others were copied from. What is joined by then needs no comparison, so of a
    shingle's texts only those outside its largest group are compared with those of other groups.
    """
    ends = F.min("node").alias("low"), F.max("node").alias("high")
    shared = written(firsts.groupBy("key").agg(*ends, F.count("*").alias("size")).where("low <> high").select("key", "size"), "near-keys")
    rows = written(firsts.join(shared.hint("merge"), "key").distinct(), "near-firsts")
    fame = rows.groupBy("node").agg(F.sum("size").alias("fame"))
    pivot = rows.join(fame.hint("merge"), "node").groupBy("key").agg(F.max(F.struct("fame", "node", "n")).alias("p"))
    like_sizes = PARTS * F.least("n_a", "n_b") >= ALIKE * F.greatest("n_a", "n_b")
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    enough = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) * (PARTS + ALIKE) >= (F.col("n_a") + F.col("n_b")) * ALIKE
    stars = rows.join(pivot.hint("merge"), "key").select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("p.node").alias("b"), F.col("p.n").alias("n_b"))
    tried = written(pair(stars.where((F.col("a") != F.col("b")) & like_sizes)), "near-stars")
    groups = written(components(verified(tried, nodes, docs).unionByName(known)), "near-groups")
    of = rows.join(groups.hint("merge"), "node", "left").select("key", "at", "node", "n", F.coalesce("component", "node").alias("group"))
    sizes = of.groupBy("key", "group").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "group")).alias("m"), F.count("*").alias("groups"))
    apart = written(of.join(sizes.where("groups > 1").select("key", F.col("m.group").alias("main")).hint("merge"), "key"), "near-apart")
    side = lambda df, s: df.select("key", F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("at").alias(f"at_{s}"), F.col("group").alias(f"g_{s}"), "main")
    once = (F.col("g_a") != F.col("g_b")) & ((F.col("g_b") == F.col("main")) | (F.col("a") < F.col("b")))
    both = side(apart.where("group <> main"), "a").drop("main").join(side(apart, "b"), "key").where(once & like_sizes & enough)
    left = written(pair(both).join(tried.hint("merge"), ["a", "b"], "left_anti"), "near-rest")
    if left.isEmpty():
        return groups
    group = lambda s: groups.select(F.col("node").alias(s), F.col("component").alias(f"g_{s}"))
    more = verified(left, nodes, docs).join(group("a"), "a", "left").join(group("b"), "b", "left").select(F.coalesce("g_a", "a").alias("a"), F.coalesce("g_b", "b").alias("b"))
    top = written(components(more), "near-joined")
    both = groups.join(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    # Nodes that no edge had before are in no group: their own number is their group's.
    fresh = top.join(groups, "node", "left_anti")
    return both.unionByName(fresh)


@shielded
def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies: that of smallest doc_id.

    Texts are near copies if their sets of five-word shingles have a Jaccard similarity of 0.8 or more, or their fingerprints
    differ by no more than the radius of ``simhash``; groups are joined over both. Texts without words are near copies of each
    other. Rows that share a doc_id and text count as one document, of which one row stays, the first by its other columns; rows that share a
    doc_id only are judged each by its text. Rows without doc_id stay, one for each text. An empty table gives an empty result.
    """
    found = written(marked(docs), "near-marks")
    place = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tag"))).alias("least")
    nodes = written(found.groupBy("node", "fp", "n", *BITS).agg(F.min("tag").alias("tag"), place), "near-nodes")
    # Texts of one fingerprint hang on the first of them, and linked fingerprints' first texts on each other; then one search joins all.
    heads = written(nodes.groupBy("fp").agg(F.min("node").alias("head")), "near-heads")
    stars = nodes.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    head = lambda s: heads.select(F.col("fp").alias(s), F.col("head").alias(f"head_{s}"))
    linked = simhash.links(heads.select("fp")).join(head("a"), "a").join(head("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    near = joined(nodes, found.select(F.posexplode("firsts").alias("at", "key"), "node", "n"), docs, stars.unionByName(linked))
    labelled = nodes.select("node", "least").join(near, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    kept = labelled.groupBy("component").agg(F.min("least").alias("kept"))
    kept = labelled.join(kept, "component").select("node", "kept")
    gone = found.select("doc_id", "tag", "node").join(kept, "node").where(F.struct("doc_id", "tag") != F.col("kept")).where("doc_id is not null")
    again = found.groupBy("doc_id", "tag").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "tag", F.lit(1).alias("kind"))
    # 0: goes. 1: stands more than once.
    marks = gone.select("doc_id", "tag", F.lit(0).alias("kind")).unionByName(again).groupBy("doc_id", "tag").agg(F.min("kind").alias("_kind"))
    marks = written(marks.select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"), "_kind"), "near-gone")
    own = docs.withColumn("_own", F.xxhash64("text"))
    left = own.join(marks, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_tag")), "left").drop("_doc", "_tag")
    # Of rows that stand more than once, the first by all their columns stays.
    order = Window.partitionBy("doc_id", "_own").orderBy(*[F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")])
    first = left.where("_kind = 1").withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    return left.where("_kind is null").unionByName(first.drop("_rank")).select(*docs.columns)

"""SimHash near-duplicates: fingerprints linked within a Hamming radius by the generalised pigeonhole principle.

Bits that go together are grouped into partitions. Each partition has a threshold of its own; the thresholds sum to
``radius - partitions + 1``, so two fingerprints within the radius agree, in one partition at least, up to that
partition's threshold. Dynamic programming picks the thresholds (and the number of partitions) by the candidates that a
bounded sample of fingerprints makes it expect. The plan only decides what the search costs: every plan finds every link.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import components, cut, map_rows, texts_of, written

BITS = 64
#: Fingerprints that plan a search; fixed, whatever the size of the corpus.
SAMPLE = 1024
#: Distinct fingerprints in a bucket above which its links are found without pairs.
CROWDED = 128


def fingerprint(text: bytes, words_per_shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text: bit i is set if it is set in over half of its shingles' hashes; 0 without words."""
    words = text.lower().split()  # bytes: A-Z only, and only the six ASCII spaces
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= words_per_shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    last = ends[words_per_shingle - 1 :] - 1
    first = np.concatenate([[0], ends])[: len(last)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(last))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a long. A null text has no words."""

    def work():
        def each(batch):
            found = [fingerprint(t, words_per_shingle) for t in texts_of(batch, "text")]
            yield {"doc_id": batch.column(0), "fp": np.array(found, np.uint64).view(np.int64)}

        return each

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(narrow, "doc_id long, fp long", work)


@dataclass(frozen=True)
class Plan:
    """Bit masks of the partitions and the threshold of each (-1: not probed)."""

    masks: tuple[int, ...]
    thresholds: tuple[int, ...]


def grouped_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of like size, correlated bits together."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    spread = bits - bits.mean(axis=0)
    scale = np.sqrt((spread**2).mean(axis=0)) + 1e-9
    likeness = np.abs(spread.T @ spread / max(1, len(bits)) / np.outer(scale, scale))
    np.fill_diagonal(likeness, 0)
    free, groups = list(range(BITS)), []
    for g in range(parts):
        room = len(free) // (parts - g)
        group = [max(free, key=lambda b: (likeness[b, free].max(), -b))]
        free.remove(group[0])
        while len(group) < room:
            best = max(free, key=lambda b: (likeness[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def near_share(sample: np.ndarray, group: list[int], most: int) -> list[float]:
    """The share of pairs that differ in at most t bits of ``group``, for t from 0 to ``most``, by the sample; never below what random bits give."""
    mask = np.uint64(sum(1 << b for b in group))
    part = sample & mask
    counts = np.zeros(most + 1)
    for row in range(len(part)):
        apart = np.bitwise_count(part[row + 1 :] ^ part[row])
        counts += [(apart <= t).sum() for t in range(most + 1)]
    pairs = max(1, len(part) * (len(part) - 1) // 2)
    random = [sum(comb(len(group), i) for i in range(t + 1)) / 2.0 ** len(group) for t in range(most + 1)]
    return [max(c / pairs, r) for c, r in zip(counts, random, strict=True)]


def plan(sample: np.ndarray, radius: int, total: int) -> Plan:
    """The cheapest partitions and thresholds for ``total`` fingerprints, as the sample (uint64) lets one expect."""
    best: tuple[float, Plan] | None = None
    for parts in range(1, radius + 2):
        groups = grouped_bits(sample, parts)
        cost = []
        for group in groups:
            shares = near_share(sample, group, radius)
            probes = [sum(comb(len(group), i) for i in range(t + 1)) for t in range(radius + 1)]
            cost.append({-1: 0.0} | {t: total * (1 + probes[t]) + total * total / 2 * shares[t] for t in range(radius + 1)})
        budget = radius - parts + 1
        # table: sum of the thresholds so far -> (cost, thresholds)
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for choices in cost:
            grown: dict[int, tuple[float, tuple[int, ...]]] = {}
            for spent, (so_far, chosen) in table.items():
                for t, c in choices.items():
                    if spent + t not in grown or so_far + c < grown[spent + t][0]:
                        grown[spent + t] = (so_far + c, (*chosen, t))
            table = grown
        found, thresholds = table[budget]
        if best is None or found < best[0]:
            best = (found, Plan(tuple(sum(1 << b for b in g) for g in groups), thresholds))
    return best[1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def flips(mask: int, most: int) -> list[int]:
    """All changes of up to ``most`` bits within ``mask``."""
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return [signed(sum(c)) for t in range(most + 1) for c in combinations(bits, t)]


def links(distinct: DataFrame, radius: int = 2, crowded: int = CROWDED) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``fp``, that join the same components as all pairs within ``radius`` would.

    Buckets with up to ``crowded`` fingerprints are probed and their pairs verified. A larger bucket isn't paired: each
    fingerprint in it, or probing it, names all values within half the radius, and is linked to the smallest fingerprint
    that names the same one. Two fingerprints within the radius always share such a value half-way, and those that
    share one are within twice half the radius; an odd radius verifies that.
    """
    total = distinct.count()
    if total < 2:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    rows = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r.fp for r in rows], np.int64).view(np.uint64)
    chosen = plan(sample, radius, total)
    used = [(i, m, t) for i, (m, t) in enumerate(zip(chosen.masks, chosen.thresholds, strict=True)) if t >= 0]

    def keyed(probing: bool) -> DataFrame:
        entries = []
        for i, mask, threshold in used:
            key = F.col("fp").bitwiseAND(F.lit(signed(mask)))
            changes = flips(mask, threshold) if probing else [0]
            entries += [F.struct(F.lit(i).alias("part"), key.bitwiseXOR(F.lit(c)).alias("key")) for c in changes]
        return distinct.select("fp", F.explode(F.array(*entries)).alias("k")).select("fp", "k.part", "k.key")

    index, probes = keyed(False), keyed(True)
    sizes = index.groupBy("part", "key").agg(F.count("*").alias("n"))
    sizes = written(sizes.where("n > 1"), "buckets")
    quiet, crowd = sizes.where(F.col("n") <= crowded).select("part", "key"), sizes.where(F.col("n") > crowded).select("part", "key")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius
    if all(t == 0 for _, _, t in used):
        quiet_index = index.join(quiet, ["part", "key"])
        quiet_probes = quiet_index
    else:
        single = index.join(crowd, ["part", "key"], "left_anti")
        quiet_index, quiet_probes = single, probes
    pairs = (
        quiet_probes.select("part", "key", F.col("fp").alias("a"))
        .join(quiet_index.select("part", "key", F.col("fp").alias("b")), ["part", "key"])
        .where((F.col("a") < F.col("b")) & near("a", "b"))
        .select("a", "b")
    )
    half = (radius + 1) // 2
    if crowd.isEmpty():
        return pairs
    packed = probes.join(crowd, ["part", "key"], "left_semi").select("fp").distinct()
    all_bits = (1 << BITS) - 1
    named = packed.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(c)) for c in flips(all_bits, half)])).alias("z"))
    if radius % 2 == 0:
        least = named.groupBy("z").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
        star = named.join(least, "z").where("fp <> b").select(F.col("fp").alias("a"), "b")
    else:
        # Within an odd radius one of the two ends may be a bit nearer: name one side by the smaller half.
        inner = packed.select(F.col("fp").alias("b"), F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(c)) for c in flips(all_bits, radius // 2)])).alias("z"))
        star = named.withColumnRenamed("fp", "a").join(inner, "z").where((F.col("a") != F.col("b")) & near("a", "b")).select("a", "b")
    return pairs.unionByName(star.select("a", "b"))


def near_duplicates(docs: DataFrame, radius: int = 2, words_per_shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for each document.

    ``fingerprint`` is ``fp`` as 16 hexadecimal digits; ``component_id`` is the smallest doc_id reachable over links of at
    most ``radius`` differing bits, the document itself included. Null and empty texts have fingerprint zero and are linked
    like any other. Rows with a null doc_id get one too; a component of such rows only has a null component_id. Repeated rows
    are kept. Only ids and fingerprints are shuffled, equal fingerprints as one.
    """
    marked = written(fingerprints(docs, words_per_shingle, text, doc_id), "fingerprints")
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(distinct.select("fp"), radius))
    labelled = distinct.join(joined.hint("merge"), distinct.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    found = labelled.join(smallest.hint("merge"), "component").select("fp", "component_id")
    return marked.join(found.hint("merge"), "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

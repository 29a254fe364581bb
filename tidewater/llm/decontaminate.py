"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

Every item has a fingerprint; every window of a document that is as long as some item, and shares a shingle with any, has one
too (a window that shares none has similarity zero). Fingerprints of ``BITS`` bits are cut into blocks, and each item is filed
under all values within ``radius // blocks`` bits of its own in every block: a fingerprint within the radius agrees with one of
them in at least one block, so the look-up misses none. Candidates are verified by the Jaccard similarity of shingles, weighted by how rare
they are in the whole benchmark, or plain. Benchmarks are held by every task in portions of bounded size, one after the other; the corpus is
read once for each and never shuffled.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import gram_hashes, map_rows, mixed, shielded, texts_of, word_hashes, written

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 64, 4, 19
#: Bytes of benchmark text, and items, that one reading of the corpus is compared with, about. An item takes 32 kB in the index.
PORTION, ITEMS = 2 << 20, 2048
#: Windows taken at once, and places in a text whose bits are summed at once.
CHUNK, STRETCH = 4096, 1 << 15


def shingle_hashes(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """A hash for each shingle of ``k`` words; with fewer words, one for all of them."""
    return gram_hashes(hashes, min(k, len(hashes))) if len(hashes) else np.zeros(0, np.uint64)


def sign_bits(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of BITS bits of each shingle's hash."""
    return np.unpackbits(mixed(shingles).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


class Benchmark:
    """Items ready to be looked up: weights of shingles, fingerprints, and the blocks they are filed under.

    ``known`` are the items' shingles in order and ``counts`` in how many different items of the whole benchmark each stands; ``total`` is how many
    those are. Without them they are counted here.
    """

    def __init__(self, items: list[tuple[int, bytes]], k: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, known: np.ndarray | None = None, counts: np.ndarray | None = None, total: int = 0):
        self.k, self.similarity, self.radius = k, similarity, radius
        kept = [(i, h) for i, h in ((i, word_hashes(t.lower().split())) for i, t in items) if len(h)]
        kept.sort(key=lambda x: len(x[1]))  # items of one length stand together
        self.ids = [i for i, _ in kept]
        self.lengths = np.array([len(h) for _, h in kept], np.int64)
        shingles = [shingle_hashes(h, k) for _, h in kept]
        #: Each item's different shingles in order, and how often it has them.
        self.bags = [np.unique(s, return_counts=True) for s in shingles]
        if known is None:
            different = {s.tobytes(): u for s, (u, _) in zip(shingles, self.bags, strict=True)}
            known, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *different.values()]), return_counts=True)
            total = len(different)
        #: The rarer a shingle is among the items, the more it weighs; one that no item has weighs most.
        self.most = float(np.log1p(total))
        self.known, self.known_weights = known, np.log1p(total / np.maximum(counts, 1)).astype(np.float32)
        self.totals = [float((n * self.weigh(u)[0]).sum(dtype=np.float64)) for u, n in self.bags]
        #: Items of each length, from and to.
        self.by_length = {int(n): (int(np.searchsorted(self.lengths, n)), int(np.searchsorted(self.lengths, n, "right"))) for n in np.unique(self.lengths)}
        prints = [packed((sign_bits(s) * self.weigh(s)[0][:, None]).sum(axis=0)[None]) for s in shingles]
        self.prints = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        self._file()

    def weigh(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of shingles, and whether an item has them."""
        if not hasattr(self, "sieve"):
            self.sieve = np.zeros(1 << 16, bool)
            self.sieve[(self.known >> np.uint64(48)).astype(np.int64)] = True
        out, have = np.full(len(shingles), self.most, np.float32), np.zeros(len(shingles), bool)
        maybe = np.flatnonzero(self.sieve[(shingles >> np.uint64(48)).astype(np.int64)])
        if len(maybe) and len(self.known):
            at = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
            same = self.known[at] == shingles[maybe]
            have[maybe[same]] = True
            out[maybe[same]] = self.known_weights[at[same]]
        return out, have

    def _file(self) -> None:
        """For each block, a table from its values to a bit for each item to try; items of a length begin a byte, so that a look-up takes only theirs."""
        wide = BITS // BLOCKS
        changes = np.array([sum(1 << b for b in c) for t in range(self.radius // BLOCKS + 1) for c in combinations(range(wide), t)], np.int64)
        self.bytes, width = {}, 0
        for length, (a, b) in self.by_length.items():
            self.bytes[length] = (width, width + (b - a + 7) // 8)
            width = self.bytes[length][1]
        self.filed = [np.zeros((1 << wide, width), np.uint8) for _ in range(BLOCKS)]
        for block, table in enumerate(self.filed):
            for length, (a, b) in self.by_length.items():
                for j in range(a, b):
                    value = int(self.prints[j]) >> (block * wide) & ((1 << wide) - 1)
                    table[changes ^ value, self.bytes[length][0] + (j - a) // 8] |= 1 << ((j - a) % 8)

    def probe(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs whose fingerprints are within the radius."""
        wide, (a, b), (first, last) = BITS // BLOCKS, self.by_length[length], self.bytes[length]
        hits = np.zeros((len(prints), last - first), np.uint8)
        for block, table in enumerate(self.filed):
            value = (prints >> np.uint64(block * wide)).astype(np.int64) & ((1 << wide) - 1)
            hits |= table[value, first:last]
        bits = np.unpackbits(hits, axis=1, bitorder="little")[:, : b - a]
        window, item = np.nonzero(bits)
        near = np.bitwise_count(prints[window] ^ self.prints[a + item]) <= self.radius
        return window[near], a + item[near]

    def similar(self, shingles: np.ndarray, item: int) -> float:
        """Jaccard similarity of a window's shingles and an item's, with repeats: weighted or plain, whichever is more."""
        own, n_own = self.bags[item]
        found, n = np.unique(shingles, return_counts=True)
        weights = self.weigh(found)[0].astype(np.float64)
        at = np.minimum(np.searchsorted(own, found), len(own) - 1)
        both = np.where(own[at] == found, np.minimum(n, n_own[at]), 0)
        common, plain = float((both * weights).sum()), int(both.sum())
        weighed = common / max(float((n * weights).sum()) + self.totals[item] - common, 1e-9)
        return max(weighed, plain / max(1, int(n.sum()) + int(n_own.sum()) - plain))

    def matches(self, text: bytes) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best window for each item that the text has."""
        words = text.lower().split()
        if not words or not self.ids:
            return []
        hashes = word_hashes(words)
        best: dict[int, tuple[float, int]] = {}
        full = shingle_hashes(hashes, self.k)
        weights, have = self.weigh(full)
        seeds = np.flatnonzero(have)
        for length in self.by_length:
            if length < self.k and length <= len(words):
                # Items shorter than a shingle: windows are single shingles of their length.
                self._short(hashes, length, best)
        starts = {n: self.starts(seeds, len(words), n) for n in self.by_length if n >= self.k} if len(seeds) else {}
        longest = min(max(starts, default=0), len(words))
        # A stretch at a time, so that sums take bounded memory in texts of any length.
        for begin in range(0, len(full), STRETCH) if starts else ():
            here = {n: x[np.searchsorted(x, begin) : np.searchsorted(x, begin + STRETCH)] for n, x in starts.items()}
            if not any(map(len, here.values())):
                continue
            part = slice(begin, begin + STRETCH + longest - self.k + 1)
            signs = sign_bits(full[part]) * weights[part, None]
            cumulated = np.concatenate([np.zeros((1, BITS)), np.cumsum(signs, axis=0, dtype=np.float64)])
            for length, places in here.items():
                self._verify(full, places, begin, cumulated, length, best)
        return [(self.ids[j], start, min(int(self.lengths[j]), len(words)), value) for j, (value, start) in sorted(best.items())]

    def starts(self, seeds: np.ndarray, words: int, length: int) -> np.ndarray:
        """First words of the windows of ``length`` words that hold a shingle of some item, in order; a shorter text is one window."""
        length = min(length, words)
        inside = length - self.k + 1  # shingles of a window
        change = np.zeros(words + 2, np.int64)
        np.add.at(change, np.maximum(seeds - inside + 1, 0), 1)
        np.add.at(change, seeds + 1, -1)
        return np.flatnonzero(np.cumsum(change[: words - length + 1]) > 0)

    def _verify(self, full: np.ndarray, starts: np.ndarray, begin: int, cumulated: np.ndarray, length: int, best: dict[int, tuple[float, int]]) -> None:
        """Looks windows up and keeps the best of each item; ``cumulated`` sums the signs from ``begin`` on."""
        inside = min(length - self.k + 1, len(full))
        for at in range(0, len(starts), CHUNK):
            part = starts[at : at + CHUNK]
            prints = packed(cumulated[part - begin + inside] - cumulated[part - begin])
            for w, item in zip(*(x.tolist() for x in self.probe(prints, length)), strict=True):
                start = int(part[w])
                value = self.similar(full[start : start + inside], item)
                if value >= self.similarity and (item not in best or value > best[item][0]):
                    best[item] = (value, start)

    def _short(self, hashes: np.ndarray, length: int, best: dict[int, tuple[float, int]]) -> None:
        runs = gram_hashes(hashes, length)
        for item in range(*self.by_length[length]):
            found = np.flatnonzero(runs == self.bags[item][0][0])
            if len(found):
                best[item] = (1.0, int(found[0]))


def counted(items: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(s, n): in how many different items each shingle stands; and how many different items there are. ``items`` has different texts."""

    def work():
        def each(batch):
            found = [np.unique(shingle_hashes(word_hashes(t.lower().split()), k)) for t in texts_of(batch, "text")]
            yield {"s": np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)}

        return each

    return written(map_rows(items.select("text"), "s long", work).groupBy("s").agg(F.count("*").alias("n")), "item-shingles"), items.count()


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    item_id: str = "item_id",
    portion: int = PORTION,
    most_items: int = ITEMS,
) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): a row for each document and benchmark item found in it.

    The span is the window of the item's length (the whole text, if that is shorter) that is most like it, the first of equal ones. Words are lower-cased A-Z and
    split at ASCII white space. Items without words are never found; those of fewer words than a shingle are found
    whole only. Null and empty texts have no rows; rows with a null doc_id are reported under null. Of repeated rows each
    is reported, items that share a text each by its id. Clean documents have no rows. The driver holds one portion of the benchmark at a time.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, first_word int, n_words int, similarity double"
    sc = docs.sparkSession.sparkContext
    items = written(benchmark.where(F.col("text").isNotNull()).select(F.col(item_id).cast("long").alias("item"), "text"), "items")
    size, n = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    parts = max(1, -(-(size or 0) // portion), -(-n // most_items))
    counts, total = counted(items.select("text").distinct(), shingle)
    items = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))

    def against(part: int) -> DataFrame:
        rows = items.where(F.col("part") == part)
        held = sorted(((r.item, r.text.encode()) for r in rows.select("item", "text").collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
        own = np.unique(np.concatenate([np.zeros(0, np.uint64), *(shingle_hashes(word_hashes(t.lower().split()), shingle) for _, t in held)]))
        if parts == 1:
            known = counts
        else:
            wanted = docs.sparkSession.createDataFrame(pa.table({"s": own.view(np.int64)}))
            known = counts.join(F.broadcast(wanted), "s", "left_semi")
        known = known.orderBy("s").toArrow()
        s, k = known["s"].to_numpy().view(np.uint64), known["n"].to_numpy()
        order = np.argsort(s)
        shared = sc.broadcast((held, s[order], k[order]))  # about ``portion`` bytes of text, or one item, and what its shingles take

        def work():
            rows, s, k = shared.value
            index = Benchmark(rows, shingle, similarity, radius, s, k, total)

            def each(batch):
                out = {k: [] for k in ("doc_id", "item_id", "first_word", "n_words", "similarity")}
                for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                    for item, start, n, value in index.matches(text):
                        for k, v in zip(out, (doc, item, start, n, round(value, 6)), strict=True):
                            out[k].append(v)
                yield out

            return each

        found = written(map_rows(narrow, schema, work), "leaks")
        shared.unpersist()
        return found

    return reduce(DataFrame.unionByName, [against(p) for p in range(parts)])


@shielded
def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item. Rows with a null doc_id stay."""
    found = written(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_found")).distinct(), "leaks")
    return docs.join(found, docs["doc_id"] == F.col("_found"), "left_anti")

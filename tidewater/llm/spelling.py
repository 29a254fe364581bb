"""Spelling variants: words at one edit from another, by Levenshtein automata that walk a trie of all words.

The words, in order, are cut into shards of a bounded count, each a compact trie: labels and first children by level, in a few arrays.
Shards are broadcast, a bounded number of bytes at a time. Each word's automaton for distance one is intersected with every shard
depth-first: its state says whether the path is the word's beginning so far, and with which edits it is one but for that edit, so a node is
visited once and a branch ends where no state is left. Where the automaton accepts, the path spells a neighbour. Counts and best forms are
reduced by word.

Words go through the tries in order, so what words that begin alike have in common is walked once. A shard is a stretch of the words in
order: those that begin otherwise leave it after a few nodes.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import placed, written

#: Runs of these letters are words; each is one byte in Latin-1.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
#: Least code points and occurrences of a word; how many times commoner than a word its form is, at least.
SIZE, OCCURRENCES, TIMES = 5, 3, 2
#: Of as many runs one loses a code point (see ``words``).
RARE = 97
#: Words in a shard, and bytes of tries that are broadcast at a time. Of words beyond LONG code points, a shard has the fewer the longer they are.
SHARD, PORTION, LONG = 65_536, 32 << 20, 64
#: Words, about, that a task takes through the tries of a lot.
TASK = 32_768


def words(docs: DataFrame, size: int = SIZE, occurrences: int = OCCURRENCES, rare: int = RARE) -> DataFrame:
    """(word, n): the words of all texts with at least ``size`` code points and ``occurrences`` occurrences.

    Only A-Z are lower-cased. Where ``rare`` divides the CRC-32 of doc_id (null: nothing), a colon and the run, one of the run's code points,
    the CRC's remainder by the run's length, is left out: slips of the pen that anyone can repeat.
    """
    run = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS), F.lit(0))).alias("run")
    # The whole-string functions fold capitals beyond A-Z as well.
    low = F.when(F.col("run").rlike("[\\u00C0-\\u00DE]"), F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower("run"))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), run).select("doc", low.alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    less = F.concat(F.expr("substring(run, 1, int(h % char_length(run)))"), F.expr("substring(run, int(h % char_length(run)) + 2)"))
    word = F.when(F.col("h") % rare == 0, less).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= size).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def packed(entries: list[tuple[bytes, int]]) -> bytes:
    """A trie of ``entries`` (word, count), whose words are distinct and sorted, level by level: of each node the letter that leads to it, how
    many children it has and whether it ends a word; then the words' counts."""
    labels, degrees, ends, counts = bytearray(b"\0"), [], [], []
    level, depth = [(0, len(entries))], 0
    while level:
        below = []
        for a, b in level:
            whole = a < b and len(entries[a][0]) == depth
            ends.append(whole)
            if whole:
                counts.append(entries[a][1])
                a += 1
            heads = [entries[i][0][depth] for i in range(a, b)]
            cuts = [a + i for i, (x, y) in enumerate(pairwise([None, *heads])) if x != y] + [b]
            parts = list(pairwise(cuts)) if a < b else []
            labels.extend(entries[i][0][depth] for i, _ in parts)
            degrees.append(len(parts))
            below += parts
        level, depth = below, depth + 1
    arrays = np.array(degrees, np.uint8), np.packbits(np.array(ends, bool)), np.array(counts, np.int64)
    return len(degrees).to_bytes(8, "little") + b"".join([bytes(labels), *(x.tobytes() for x in arrays)])


class Forest:
    """Tries side by side in a few arrays: node i's children are those from ``first[i]`` to ``first[i + 1]``, ``ends[i]`` is its word's number or -1."""

    def __init__(self, packs: list[bytes]):
        labels, first, ends, counts, self.roots = [], [], [], [], []
        at = words = 0
        for data in packs:
            n = int.from_bytes(data[:8], "little")
            bits = (n + 7) // 8
            degrees = np.frombuffer(data, np.uint8, n, 8 + n)
            whole = np.unpackbits(np.frombuffer(data, np.uint8, bits, 8 + 2 * n), count=n).astype(bool)
            self.roots.append(at)
            labels.append(data[8 : 8 + n] + b"\0")  # a node without children after each trie
            first.append(at + np.concatenate([[1], 1 + np.cumsum(degrees, dtype=np.int64)]))
            ends.append(np.append(np.where(whole, words + np.cumsum(whole) - 1, -1), -1))
            counts.append(np.frombuffer(data[8 + 2 * n + bits :], np.int64))
            at, words = at + n + 1, words + len(counts[-1])
        # Arrays of plain numbers: a few bytes a node, and quick to read one by one.
        whole = lambda parts: array("q", np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64).tobytes())
        self.labels, self.first, self.ends, self.counts = b"".join(labels), whole([*first, [at]]), whole(ends), whole(counts)

    def near(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, nodes of the words at one edit from it) for each of ``words``, best in order.

        The automata of all words go through the tries together, depth-first: a word's automaton is in the states of the one before it as far
        as the two words agree. A state (node, exact, edits) says that the path to the node may be the word's beginning, or be so but for
        a letter more (1), another letter (2) or a letter less (4). Where no state is left, the branch ends.
        """
        first, labels, ends = self.first, self.labels, self.ends
        find = labels.find
        held: list[list[tuple[int, bool, int]]] = []  # the states at each depth
        last = b""
        for word in words:
            size, same = len(word), 0
            for x, y in zip(word, last, strict=False):
                if x != y:
                    break
                same += 1
            del held[same:]  # the states at a depth hang on one letter more than that
            last = word
            if not held:
                held.append([(root, True, 4 if size else 0) for root in self.roots])
            while len(held) < size + 2 and held[-1]:
                depth = len(held)
                more = word[depth - 2] if 1 < depth < size + 2 else -1  # the letters that each kind of state waits for
                other = word[depth - 1] if depth <= size else -1
                less = word[depth] if depth < size else -1
                skip, change = 4 if depth < size else 0, 2 if depth <= size else 0
                states = []
                for node, exact, edits in held[-1]:
                    a, b = first[node], first[node + 1]
                    if a == b:
                        continue
                    if exact:
                        for child in range(a, b):
                            c = labels[child]
                            after = 1 | (edits & 2 if c == other else 0) | (edits & 4 if c == less else 0)
                            states.append((child, True, after | skip) if c == other else (child, False, after | change))
                        continue
                    for c, bit in ((more, 1), (other, 2), (less, 4)):
                        if edits & bit and c >= 0:
                            after = bit
                            if bit < 2 and edits & 2 and c == other:
                                after |= 2
                            if bit < 4 and edits & 4 and c == less:
                                after |= 4
                            edits &= ~after
                            child = find(c, a, b)
                            if child >= 0:
                                states.append((child, False, after))
                held.append(states)
            found = []
            for depth, bit in ((size - 1, 4), (size, 2), (size + 1, 1)):
                if 0 <= depth < len(held):
                    found += [node for node, exact, edits in held[depth] if edits & bit and ends[node] >= 0 and not (exact and depth == size)]
            yield word, found

    def count(self, node: int) -> int:
        return self.counts[self.ends[node]]

    def spelt(self, node: int) -> bytes:
        """The path from the root to a node."""
        path = bytearray()
        while node not in self.roots:
            path.append(self.labels[node])
            node = bisect_right(self.first, node) - 1
        return bytes(reversed(path))


def tries(vocabulary: DataFrame, shard: int = SHARD) -> DataFrame:
    """(shard, trie, size) over ``vocabulary`` (word, n): a trie for each stretch of at most ``shard`` of the words in order."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        entries = [(w.encode("latin-1"), n) for w, n in zip(group.column("word").to_pylist(), group.column("n").to_pylist(), strict=True)]
        trie = packed(entries)
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.string()), "trie": pa.array([trie], pa.binary()), "size": pa.array([len(trie)], pa.int64())})

    # Latin-1 has the order of code points, and so has UTF-8. Classes of words by length: each twice as long, and half as many in a shard.
    kinds = vocabulary.withColumn("kind", F.greatest(F.lit(0), F.ceil(F.log2(F.char_length("word") / LONG))).cast("int"))
    ordered = placed(kinds, ["kind"], ["word"])
    name = F.expr(f"concat_ws(':', kind, place div greatest(1, shiftright({shard}, least(kind, 31))))")
    cut = ordered.select("word", "n", "place", name.alias("shard"))
    return cut.groupBy("shard").applyInArrow(pack, "shard string, trie binary, size long")


def portions(sizes: list[tuple[str, int]], most: int) -> Iterator[list[str]]:
    """Shards (name, bytes) in lots of at most ``most`` bytes, one at least."""
    lot, total = [], 0
    for shard, size in sizes:
        if lot and total + size > most:
            yield lot
            lot, total = [], 0
        lot.append(shard)
        total += size
    if lot:
        yield lot


def neighbours(vocabulary: DataFrame, shard: int = SHARD, portion: int = PORTION) -> DataFrame:
    """(word, n_near, best, best_n) for each word of ``vocabulary`` (word, n) that has a neighbour: how many, and the commonest (ties: the first in order).

    Each lot of shards is one pass over the words, whose tasks hold the lot and a batch; a word gives a row for a lot at most.
    """
    spark = vocabulary.sparkSession
    shards = written(tries(vocabulary, shard), "spelling-tries")
    schema = "word string, n_near long, best string, best_n long"
    # In order, so that words that begin alike go through the tries together.
    words = vocabulary.select("word").repartitionByRange(-(-vocabulary.count() // TASK) or 1, "word").sortWithinPartitions("word")
    out = None
    for lot in portions([tuple(r) for r in shards.select("shard", "size").orderBy("shard").collect()], portion):
        sent = spark.sparkContext.broadcast([bytes(r.trie) for r in shards.where(F.col("shard").isin(lot)).orderBy("shard").collect()])

        def walk(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            forest = Forest(sent.value)
            for batch in batches:
                rows: list[tuple] = []
                for word, found in forest.near(x.encode("latin-1") for x in batch.column(0).to_pylist()):
                    if found:
                        most = max(map(forest.count, found))
                        best = min(forest.spelt(x) for x in found if forest.count(x) == most)
                        rows.append((word.decode("latin-1"), len(found), best.decode("latin-1"), most))
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                kinds = pa.string(), pa.int64(), pa.string(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n_near", "best", "best_n"])

        found = written(words.mapInArrow(walk, schema), "spelling-near")
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("b")
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def grouped(vocabulary: DataFrame, times: int = TIMES, shard: int = SHARD, portion: int = PORTION) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``vocabulary`` (word, n), whose words are distinct Latin-1 texts.

    ``form`` is the commonest of the words at one edit, if it is ``times`` times as common at least; ``root`` is what forms lead to in the end.
    As each form is at least twice as common, chains have at most some 60 words, and their lengths double with each of a few joins.
    """
    near = neighbours(vocabulary, shard, portion)
    enough = F.col("best_n") >= times * F.col("n")
    found = vocabulary.select("word", "n").join(near.hint("merge"), "word", "left")
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")), "spelling-forms")
    root = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(root.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        root = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return found.join(root.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, size: int = SIZE, occurrences: int = OCCURRENCES, times: int = TIMES, shard: int = SHARD, portion: int = PORTION) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of ``docs`` (see ``words`` and ``grouped``).

    Null and empty texts have no words; repeated rows count as often as they stand; an empty table gives an empty result. A text of any
    length is read whole. Other columns of ``docs`` aren't read.
    """
    return grouped(written(words(docs.select("doc_id", "text"), size, occurrences), "spelling-words"), times, shard, portion)

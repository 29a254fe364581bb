"""Exact removal of repeated passages: FM-index shards, dealt out by content.

A document never has to meet every shard. Each window of ``window`` words is dealt out by its minimiser (the run of
``GRAM`` words in it with the smallest hash), which equal windows share wherever they stand; consecutive windows of one
minimiser make one fragment. Fragments whose minimiser occurs once in the corpus hold no repeat. Equal fragments count once,
at their earliest place. What is left where fragments of one minimiser differ goes to FM-index shards of bounded size: the
fragments stream through backward search, whose matching statistics say which windows occur twice or more and where first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import MULTIPLIER, gram_hashes, map_rows, texts_of, word_hashes, written
from tidewater.llm.fmindex import FMIndex

WINDOW = 20
#: Words in a minimiser.
GRAM = 8
#: Words that are worked on at once, about.
PACK = 100_000
#: Words in one index shard, about.
SHARD = 400_000
#: Different fragments of one minimiser above which its windows are dealt out one by one instead.
CROWDED = 4096


def packs(texts: list[bytes], window: int) -> Iterator[tuple[list[int], list[bytes], np.ndarray]]:
    """Texts of ``window`` words or more, in packs of about ``PACK`` words: which they are, their words, and how many each has.

    Short texts are taken together, so that work on arrays pays; a text is never split.
    """
    which, words, lengths = [], [], []
    for i, text in enumerate(texts):
        own = text.split()
        if len(own) < window:
            continue
        which.append(i)
        words += own
        lengths.append(len(own))
        if len(words) >= PACK:
            yield which, words, np.array(lengths)
            which, words, lengths = [], [], []
    if which:
        yield which, words, np.array(lengths)


def fragments_of(hashes: np.ndarray, window: int, gram: int, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of each run of windows that share one occurrence of a minimiser.

    ``hashes`` are those of several texts' words in a row if ``lengths`` is given; no window reaches beyond its text.
    """
    grams = gram_hashes(hashes, gram)
    span = window - gram + 1
    n = len(hashes) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    # Leftmost smallest gram of each window, by doubling: the smaller of two overlapping halves.
    best, reach = np.arange(len(grams)), 1
    while reach < span:
        step = min(reach, span - reach)
        left, right = best[:-step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        reach += step
    if lengths is None:
        inside = np.arange(n)
    else:
        ends = np.repeat(np.cumsum(lengths), lengths)[:n]
        inside = np.flatnonzero(np.arange(n) + window <= ends)
    chosen = best[inside]
    # Two texts' windows are never side by side, as those across their border are left out.
    first = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (np.diff(inside) != 1)]))
    return grams[chosen[first]], inside[first], np.diff(np.append(first, len(inside)))


def content_hashes(hashes: np.ndarray, start: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A hash of the words in each [start, start + words), by differences of one running sum."""
    powers, back = _powers(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[: len(hashes)], dtype=np.uint64)])
    return (sums[start + words] - sums[start]) * back[start]


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(12, n.bit_length())
        up, down = MULTIPLIER | 1, pow(MULTIPLIER | 1, -1, 1 << 64)
        for name, by in (("up", up), ("down", down)):
            steps = np.full(size, by, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def documents_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The columns this module reads. ``tag`` tells texts apart that share a doc_id."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("tag"), F.col(text).alias("text"))


def minimisers(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(m): the minimiser of each fragment."""

    def work():
        def each(batch):
            found = []
            for _, words, lengths in packs(texts_of(batch, "text"), window):
                found.append(fragments_of(word_hashes(words), window, gram, lengths)[0])
            yield {"m": np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64)}

        return each

    return map_rows(docs.select("text"), "m long", work)


def fragments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(m, c, doc_id, tag, start, n): a row for each fragment; ``c`` is a hash of its words, ``n`` counts windows."""

    def work():
        def each(batch):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            found = [[] for _ in range(6)]
            for which, words, lengths in packs(texts_of(batch, "text"), window):
                hashes = word_hashes(words)
                m, start, n = fragments_of(hashes, window, gram, lengths)
                c = content_hashes(hashes, start, n + window - 1)
                ends = np.cumsum(lengths)
                of = np.searchsorted(ends, start, "right")
                row, local = np.array(which)[of], start - (ends - lengths)[of]
                for out, part in zip(found, (m.view(np.int64), c.view(np.int64), ids[row], tags[row], local, n), strict=True):
                    out.append(part)
            empty = [np.zeros(0, np.int64)]
            yield {k: np.concatenate(v or empty).astype(np.int64 if k not in ("start", "n") else np.int32) for k, v in zip(("m", "c", "doc_id", "tag", "start", "n"), found, strict=True)}

        return each

    return map_rows(docs.where("doc_id is not null"), "m long, c long, doc_id long, tag long, start int, n int", work)


def cut_out(wanted: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """Adds ``words`` (bytes) to rows of ``wanted`` (doc_id, tag, start, n and more), gathered by document: (doc_id, tag, place)."""
    columns = ["m", "c", "start", "n", "crowded"]
    places = wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct(*columns)).alias("place"))
    joined = docs.join(places, ["doc_id", "tag"]).select("doc_id", "tag", "text", "place")

    def work():
        def each(batch):
            ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = {k: [] for k in ("m", "c", "doc_id", "tag", "start", "n", "crowded", "words")}
            for doc, tag, text, place in zip(ids, tags, texts_of(batch, "text"), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                for p in place:
                    singly = range(p["start"], p["start"] + p["n"]) if p["crowded"] else [p["start"]]
                    n = 1 if p["crowded"] else p["n"]
                    for start in singly:
                        for k, v in (("m", p["m"]), ("c", p["c"]), ("doc_id", doc), ("tag", tag), ("start", start), ("n", n), ("crowded", p["crowded"])):
                            out[k].append(v)
                        out["words"].append(b" ".join(words[start : start + n + window - 1]))
            yield out

        return each

    schema = "m long, c long, doc_id long, tag long, start int, n int, crowded boolean, words binary"
    return map_rows(joined, schema, work)


def repeated_in_shard(words: list[bytes], starts: list[tuple[int, int, int]], window: int) -> list[np.ndarray]:
    """For each fragment (in order of its place): which of its windows occur earlier in the shard.

    Builds the shard's index and streams the fragments through it.
    """
    known: dict[bytes, int] = {}
    sequences = [[known.setdefault(w, len(known) + 1) for w in f.split()] for f in words]
    lengths = np.array([len(s) + 1 for s in sequences])
    symbols = np.fromiter((x for s in sequences for x in (*s, 0)), np.int64, int(lengths.sum()))
    index = FMIndex(symbols, window)
    begins = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    counts = lengths - window  # windows of each
    of = np.repeat(np.arange(len(words)), counts)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begins[of] + offset
    length, low, high = index.statistics(at + window - 1)
    hit = np.flatnonzero(length == window)
    later = np.zeros(len(of), bool)
    later[hit] = index.earliest(low[hit], high[hit]) < at[hit]
    # A place that counts twice (a repeated row) isn't earlier than itself.
    if len(set(starts)) < len(starts):
        first: dict[tuple[int, int, int], int] = {}
        again = np.array([first.setdefault(s, i) != i for i, s in enumerate(starts)])
        later &= ~again[of]
    return [offset[a:b][later[a:b]] for a, b in zip(np.cumsum(counts) - counts, np.cumsum(counts), strict=True)]


def indexed(quiet: DataFrame, shards: int, window: int) -> DataFrame:
    """(m, c, later): the windows of each fragment that occur in an earlier one, found by a shard's index."""

    def search(key, pdf):
        pdf = pdf.sort_values(["doc_id", "tag", "start"], kind="stable")
        places = list(zip(pdf.doc_id.tolist(), pdf.tag.tolist(), pdf.start.tolist(), strict=True))
        found = repeated_in_shard(pdf["words"].tolist(), places, window)
        pdf = pdf[["m", "c"]].assign(later=[x.tolist() for x in found])
        return pdf[[len(x) > 0 for x in found]]

    dealt = quiet.withColumn("shard", F.pmod(F.xxhash64("m"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(search, "m long, c long, later array<int>")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, tag, start, words): runs of words to remove; they may overlap. ``docs`` as ``documents_of`` makes it."""
    # Written, so that the join below is between two plain exchanges, of which Spark splits the part of a frequent minimiser.
    often = written(minimisers(docs, window, gram).groupBy("m").agg(F.count("*").alias("k")).where("k > 1").select("m"), "minimisers")
    found = written(fragments(docs, window, gram).join(often, "m", "left_semi"), "fragments")
    place = F.struct("doc_id", "tag", "start")
    each = found.groupBy("m", "c").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"))
    each = written(each, "contents")
    kinds = each.groupBy("m").agg(F.count("*").alias("kinds")).where("kinds > 1").withColumn("crowded", F.col("kinds") > crowded)
    mixed_kinds = each.join(kinds, "m").select("m", "c", "first.*", "n", "crowded")
    pieces = written(cut_out(mixed_kinds, docs, window), "pieces")
    quiet, crowd = pieces.where("not crowded"), pieces.where("crowded")
    total = quiet.agg(F.sum(F.col("n") + window)).first()[0] or 0
    by_index = indexed(quiet, max(1, -(-total // shard)), window)

    # Windows of crowded minimisers: grouped by their words, spread over all tasks; the earliest place stays.
    marked = crowd.select("m", "c", "doc_id", "tag", "start", F.xxhash64("words").alias("h"), F.xxhash64(F.lit(1), "words").alias("g"))
    least = written(marked.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("k")).where("k > 1"), "windows")
    by_content = marked.join(least, ["h", "g"]).where(place > F.col("first")).select("doc_id", "tag", "start", F.lit(window).alias("words"))

    # Copies of a fragment but the first go whole; of the first, the windows that an earlier fragment holds.
    copies = (
        found.join(each.where("copies > 1").select("m", "c", "first"), ["m", "c"])
        .where(place > F.col("first"))
        .select("doc_id", "tag", "start", (F.col("n") + window - 1).alias("words"))
    )
    firsts = (
        by_index.join(each.select("m", "c", "first"), ["m", "c"])
        .select("first.*", F.explode("later").alias("offset"))
        .select("doc_id", "tag", (F.col("start") + F.col("offset")).alias("start"), F.lit(window).alias("words"))
    )
    return reduce(DataFrame.unionByName, (copies, firsts, by_content))


def kept_words(text: bytes, runs: list[dict] | None) -> tuple[list[bytes], int]:
    """The words of a text outside ``runs``, and how many there were."""
    words = text.split()
    if not runs:
        return words, len(words)
    change = np.zeros(len(words) + 1, np.int64)
    start = np.array([r["start"] for r in runs])
    np.add.at(change, start, 1)
    np.add.at(change, start + np.array([r["words"] for r in runs]), -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)], len(words)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, crowded: int = CROWDED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, kept, n_words, n_removed, kept_sha256): each document without the words of repeated windows.

    A window is ``window`` consecutive words of one document; its words go if the same words also start earlier: in a
    document of smaller doc_id, or earlier in the same one. Windows are judged on the input. ``kept`` has the words left, joined
    by one space. Null and empty texts, and those with less than ``window`` words, lose nothing. Rows that share doc_id and
    text count as one document; rows with a null doc_id keep all their words.
    """
    narrow = documents_of(docs, text, doc_id)
    runs = repeats(narrow, window, gram, shard, crowded).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "words")).alias("runs"))
    joined = narrow.join(runs, ["doc_id", "tag"], "left").select("doc_id", "text", "runs")

    def work():
        def each(batch):
            out = {k: [] for k in ("kept", "n_words", "n_removed", "kept_sha256")}
            for whole, runs in zip(texts_of(batch, "text"), batch.column(2).to_pylist(), strict=True):
                left, n = kept_words(whole, runs)
                kept = b" ".join(left)
                for k, v in (("kept", kept), ("n_words", n), ("n_removed", n - len(left)), ("kept_sha256", hashlib.sha256(kept).hexdigest())):
                    out[k].append(v)
            yield out | {"doc_id": batch.column(0), "kept": pa.array(out["kept"], pa.binary()).cast(pa.string())}

        return each

    return map_rows(joined, "doc_id long, kept string, n_words long, n_removed long, kept_sha256 string", work)

"""Quality classifier of supervised subword embeddings.

A word is the mean of learned vectors of its hashed parts (itself whole, and its character n-grams), two words in a row have a
vector by their hash; a document is the mean of both; a softmax layer tells the classes. Trained by stochastic gradient descent
in numpy, one document a step, in one task over a bounded sample; the driver gets the model only.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import MULTIPLIER, WordRows, held_out, learned, map_rows, mixed, subword_buckets, texts_of, word_hashes

BITS, WIDTH, SIZES = 17, 16, (3, 4, 5)
#: Labelled documents of each class that the model is fitted on, about, and bytes of each class's text; the only bounds on what it learns from.
SAMPLE, SAMPLE_BYTES = 4000, 12 << 20
EPOCHS, RATE = 4, 0.6
#: Bits of a word's hash that pairs of words are hashed from; as many as a double holds exactly.
HASH = np.uint64((1 << 52) - 1)


def pair_buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of each two words in a row, by the words' hashes."""
    return (mixed(hashes[:-1] * np.uint64(MULTIPLIER) + hashes[1:]) & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass
class Model:
    """``parts``: each bucket's share in the log odds of class 1, which is all that scoring needs of vectors and layer."""

    parts: np.ndarray
    bias: float
    bits: int = BITS
    sizes: tuple[int, ...] = SIZES

    def table(self) -> WordRows:
        """For a word: the mean of its parts, and its hash."""

        def fill(words: list[bytes]) -> np.ndarray:
            flat, n = subword_buckets(words, self.sizes, self.bits)
            return np.column_stack([np.add.reduceat(self.parts[flat], np.cumsum(n) - n) / n, (word_hashes(words) & HASH).astype(np.float64)])

        return WordRows(fill, 2, np.float64)

    def score(self, text: bytes, table: WordRows) -> float:
        words, odds = text.split(), self.bias
        if words:
            rows = table.of(words)
            pairs = self.parts[pair_buckets(rows[:, 1].astype(np.uint64), self.bits)]
            odds += float((rows[:, 0].sum() + pairs.sum(dtype=np.float64)) / (len(words) + len(pairs)))
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


class Sample:
    """Documents to learn from as numbers in flat arrays: distinct words with their counts, and pairs of words."""

    def __init__(self, bits: int = BITS, sizes: tuple[int, ...] = SIZES):
        self.bits, self.sizes, self.index = bits, sizes, {}
        self.words, self.counts, self.pairs, self.labels = [], [], [], []

    def add(self, text: bytes, label: int) -> None:
        words = text.split()
        counted = Counter(words)
        ids = np.fromiter((self.index.setdefault(w, len(self.index)) for w in counted), np.int32, len(counted))
        self.words.append(ids)
        self.counts.append(np.fromiter(counted.values(), np.float32, len(counted)))
        self.pairs.append(pair_buckets(word_hashes(words) & HASH, self.bits).astype(np.int32))
        self.labels.append(label)

    def bags(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each document its distinct buckets and their weights, which sum to one. The numbers go as they are used."""
        words = list(self.index)
        self.index.clear()
        found = [subword_buckets(words[i : i + 50_000], self.sizes, self.bits) for i in range(0, len(words), 50_000)]
        parts = np.concatenate([f.astype(np.int32) for f, _ in found] or [np.zeros(0, np.int32)])
        n_parts = np.concatenate([n for _, n in found] or [np.zeros(0, np.int64)])
        first, out = np.cumsum(n_parts) - n_parts, []
        del words, found
        for ids, counts, pairs in zip(self.words, self.counts, self.pairs, strict=True):
            n = n_parts[ids]
            at = np.repeat(first[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            share = np.concatenate([np.repeat(counts / n, n), np.ones(len(pairs))]) / max(1, counts.sum() + len(pairs))
            bucket, which = np.unique(np.concatenate([parts[at], pairs]), return_inverse=True)
            out.append((bucket, np.bincount(which, share).astype(np.float32)))
        self.words, self.counts, self.pairs = [], [], []
        return out


def train(rows: Sample, prior: float, width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """A model of the rows' labels (0 or 1). ``prior`` is the share of class 1 where it will be used, whatever the sample's."""
    labels, bits = rows.labels, rows.bits
    classes = sorted(set(labels))
    if len(classes) < 2:
        sure = 0.5 if not classes else float(classes[0])
        return Model(np.zeros(1 << bits, np.float32), (sure - 0.5) * 20, bits)
    bags = rows.bags()
    random = np.random.default_rng(seed)
    vectors = (random.random((1 << bits, width), np.float32) - 0.5) / width
    layer, bias = np.zeros((width, 2), np.float32), np.zeros(2, np.float32)
    steps, step = epochs * len(labels), 0
    for _ in range(epochs):
        for i in random.permutation(len(labels)):
            now = rate * (1 - step / steps)
            step += 1
            bucket, share = bags[i]
            mean = share @ vectors[bucket]
            odds = mean @ layer + bias
            p = np.exp(odds - odds.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= now * np.outer(mean, p)
            bias -= 0.1 * now * p
            # Shares sum to one: scaled by their number, so that a step moves as far for long texts as for short ones.
            vectors[bucket] -= (now * min(len(bucket), 400)) * share[:, None] * back
    apart = layer[:, 1] - layer[:, 0]
    rate_1 = float(np.mean(labels))
    shift = np.log(prior / (1 - prior)) - np.log(rate_1 / (1 - rate_1)) if 0 < prior < 1 else 0.0
    return Model((vectors @ apart).astype(np.float32), float(bias[1] - bias[0] + shift), bits)


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label, size) of labelled documents that may be learned from; those labelled both ways count as 0. No text is moved for it."""
    known = labels.where(F.col(label).isin(0, 1)).where(~held_out()).groupBy("doc_id").agg(F.min(label).alias("label"))
    return known.join(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, **options) -> Model:
    """Learns from about ``sample`` documents and ``most_bytes`` of text of each class at most, picked by a hash; held-out ones are never read for it.

    Rows of labels other than 0 and 1, or without doc_id, are ignored. Without any label of a class all scores are alike.
    """
    known = labelled(docs, labels, label)
    counts = {r.label: r for r in known.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    prior = counts[1].n / sum(r.n for r in counts.values()) if 1 in counts else 0.0
    share = {k: min(1.0, sample / r.n, most_bytes / max(1, r.size)) for k, r in counts.items()} or {0: 0.0}
    pick = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000))
    at = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    picked = known.select("doc_id", "label", pick.alias("pick")).where(F.col("pick") < 1_000_000 * at[F.col("label")]).distinct()
    # Ids of a sample of fixed size: texts stay where they are until the sample's own are fetched.
    found = docs.join(F.broadcast(picked), "doc_id").select("pick", "doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))

    def learn(batches) -> bytes:
        rows, left = Sample(), {0: 2 * most_bytes, 1: 2 * most_bytes}
        for batch in batches:
            for k, text in zip(batch.column(2).to_pylist(), texts_of(batch, "text"), strict=True):
                if len(text) <= left[k]:  # a text beyond the bound is left out whole
                    left[k] -= len(text)
                    rows.add(text, k)
        model = train(rows, prior, **options)
        return np.float64(model.bias).tobytes() + model.parts.astype(np.float32).tobytes()

    raw = learned(found, learn, ["pick", "doc_id", "text"])
    return Model(np.frombuffer(raw, np.float32, offset=8), float(np.frombuffer(raw, np.float64, 1)[0]), BITS)


def scores(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (likelihood of label 1) and ``predicted`` (1 if that is ``threshold`` or more).

    Whole texts are read; null and empty ones get the score that no words give. Columns of these names are replaced. Repeated rows, and rows
    without doc_id, are scored each. An empty table gives an empty result.
    """
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema] + ["score double"])

    def work():
        table = held.value.table()

        def each(batch):
            found = [held.value.score(t, table) for t in texts_of(batch, "text")]
            yield {c: batch.column(i) for i, c in enumerate(columns)} | {"score": found}

        return each

    return map_rows(docs.select(*columns), schema, work).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    return scores(docs, fit(docs, labels, label), threshold).where("predicted = 1").select(*docs.columns)

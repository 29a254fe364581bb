"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with an elastic net (absolute and squared penalties), then calibrated by one
temperature on rows that training didn't see. Inverse document frequencies are counted over all documents that may be learned from.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import WordRows, held_out, learned, map_rows, subword_buckets, texts_of

BITS, SIZES = 15, (1, 2, 3)
#: Documents of each language that the model is fitted on, about, and as many again by a quarter that calibrate it;
#: and documents and bytes of all languages together, which the languages share evenly.
SAMPLE, SAMPLE_ALL, SAMPLE_BYTES = 1500, 24_000, 24 << 20
#: Weights of a model at most: the more languages, the fewer buckets of n-grams, 256 at least. And languages that one model tells apart, the
#: largest ones, more than there are codes of languages.
WEIGHTS, MOST_LANGUAGES = 1 << 23, 8192
LETTER = re.compile(r"[^\W\d_]")


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().split()


def has_letter(text: bytes) -> bool:
    """Whether any character is of a letter's category (numbers such as one half are not)."""
    return any(found.group().isalpha() for found in LETTER.finditer(text.decode("utf-8", "replace")))


def document_frequencies(docs: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """In how many documents each bucket of n-grams occurs, and how many documents with words there are.

    Counted where the documents are; a task hands on one row for each bucket, so what reaches the driver has a fixed size.
    """

    def work():
        known: dict[bytes, np.ndarray] = {}
        seen = np.zeros(1 << bits, bool)

        def each(batch):
            counts, n = np.zeros(1 << bits, np.int64), 0
            for text in texts_of(batch, "text"):
                words = set(words_of(text))
                if not words:
                    continue
                n += 1
                new = [w for w in words if w not in known]
                if new:
                    if len(known) > 200_000:
                        known.clear()
                        new = list(words)
                    flat, sizes = subword_buckets(new, SIZES, bits)
                    known.update(zip(new, np.split(flat.astype(np.int32), np.cumsum(sizes)[:-1]), strict=True))
                seen[:] = False
                seen[np.concatenate([known[w] for w in words])] = True
                counts += seen
            hit = np.flatnonzero(counts)
            yield {"bucket": np.append(hit, -1), "n": np.append(counts[hit], n)}

        return each

    found = map_rows(docs.select("text"), "bucket long, n long", work).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts, total = np.zeros(1 << bits, np.int64), 0
    for r in found:
        if r.bucket < 0:
            total = r.n
        else:
            counts[r.bucket] = r.n
    return counts, total


@dataclass
class Model:
    languages: list[str]
    #: Weight of each bucket for each language, times the bucket's inverse document frequency.
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    bits: int = BITS

    def table(self) -> WordRows:
        """For a word: its n-grams' sums for each language, and how many they are."""

        def fill(words: list[bytes]) -> np.ndarray:
            flat, n = subword_buckets(words, SIZES, self.bits)
            return np.column_stack([np.add.reduceat(self.weights[flat], np.cumsum(n) - n, axis=0), n])

        return WordRows(fill, len(self.languages) + 1, np.float64)

    def odds(self, text: bytes, table: WordRows) -> np.ndarray:
        words = words_of(text)
        if not words:
            return self.bias / self.temperature
        total = table.of(words).sum(axis=0)
        return (total[:-1] / total[-1] + self.bias) / self.temperature

    def predict(self, text: bytes, table: WordRows) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        p = softmax(self.odds(text, table))
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(odds: np.ndarray) -> np.ndarray:
    e = np.exp(odds - odds.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Leader:
    """Follow-the-regularised-leader (proximal), a learning rate for each weight."""

    def __init__(self, rows: int, classes: int, alpha: float, beta: float, absolute: float, squared: float):
        self.z, self.n = np.zeros((rows, classes)), np.zeros((rows, classes))
        self.alpha, self.beta, self.absolute, self.squared = alpha, beta, absolute, squared

    def weights(self, rows=slice(None)) -> np.ndarray:
        z = self.z[rows]
        shrunk = np.sign(z) * self.absolute - z
        return np.where(np.abs(z) <= self.absolute, 0.0, shrunk / ((self.beta + np.sqrt(self.n[rows])) / self.alpha + self.squared))

    def step(self, rows, gradient: np.ndarray, now: np.ndarray) -> None:
        n = self.n[rows]
        grown = n + gradient**2
        self.z[rows] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * now
        self.n[rows] = grown


def train(rows: list[tuple[bytes, str]], inverse: np.ndarray, bits: int = BITS, epochs: int = 4, alpha: float = 20.0, beta: float = 1.0, absolute: float = 0.02, squared: float = 0.001, seed: int = 7) -> Model:
    languages = sorted({k for _, k in rows})
    index = {k: i for i, k in enumerate(languages)}
    bags, target = [], []
    for text, label in rows:
        words = words_of(text)
        if words and has_letter(text):
            flat, _ = subword_buckets(words, SIZES, bits)
            count = np.bincount(flat, minlength=1 << bits)
            bucket = np.flatnonzero(count)
            bags.append((bucket.astype(np.int32), (count[bucket] / len(flat) * inverse[bucket]).astype(np.float32)))
            target.append(index[label])
    leader = Leader((1 << bits) + 1, len(languages), alpha, beta, absolute, squared)
    random, last = np.random.default_rng(seed), 1 << bits
    for _ in range(epochs):
        for i in random.permutation(len(bags)):
            bucket, value = bags[i]
            rows = np.append(bucket, last)  # the last row is the bias, which isn't penalised
            x = np.append(value, 1.0)
            now = leader.weights(rows)
            p = softmax(x @ now)
            p[target[i]] -= 1
            leader.step(rows, np.outer(x, p), now)
    weights = leader.weights()
    return Model(languages, weights[:-1] * inverse[:, None], weights[-1], 1.0, bits)


def calibrate(model: Model, rows: list[tuple[bytes, str]]) -> Model:
    """The temperature at which the model's probabilities are likeliest for rows it wasn't trained on."""
    table, index = model.table(), {k: i for i, k in enumerate(model.languages)}
    rows = [(model.odds(t, table), index[k]) for t, k in rows if k in index and has_letter(t)]
    if not rows or len(model.languages) < 2:
        return model
    odds, target = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

    def loss(t: float) -> float:
        return float(-np.log(softmax(odds / t)[np.arange(len(target)), target] + 1e-12).mean())

    model.temperature = min(np.geomspace(0.01, 10, 121).tolist(), key=loss)
    return model


def fit(docs: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_ALL, most_bytes: int = SAMPLE_BYTES, weights: int = WEIGHTS) -> Model:
    """Learns from rows with a language that aren't held out: counts from all of them, weights from a bounded sample, a share of each language.

    The sample goes to one task on an executor, which trains; the driver gets the model. Rows without text, and repeated ones, count as they are.
    """
    known = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull())
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    found = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(size).alias("size")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    bits = max(8, min(BITS, (weights // max(1, len(found))).bit_length() - 1))
    counts, total = document_frequencies(known, bits)
    inverse = np.log((1 + total) / (1 + counts)) + 1
    each, each_bytes = min(sample, most // max(1, len(found))) or 1, most_bytes // max(1, len(found))
    share = {r["lang"]: min(each / r["n"], each_bytes / max(1, r["size"])) for r in found}
    at = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) / 1_000_000 / F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")] if share else F.lit(None).cast("double")
    picked = known.select("doc_id", "lang", at.alias("at"), F.coalesce("text", F.lit("")).alias("text")).where("at < 1.25")

    def learn(batches) -> bytes:
        rows, rest, left = [], [], 2 * most_bytes
        for batch in batches:
            for k, a, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts_of(batch, "text"), strict=True):
                if len(text) <= left:  # a text beyond the bound is left out whole
                    left -= len(text)
                    (rows if a < 1 else rest).append((text, k))
        return pickle.dumps(calibrate(train(rows, inverse, bits), rest or rows))

    return pickle.loads(learned(picked, learn, ["at", "doc_id", "text", "lang"]))  # noqa: S301 (bytes of our own task)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each document, from its whole text alone.

    ``lang_pred`` is a learned language, or "und" with score 0 if the text is null or has no letter.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # ``WEIGHTS`` bounds its size

    def work():
        table = held.value.table()

        def each(batch):
            found = [held.value.predict(t, table) for t in texts_of(batch, "text")]
            yield {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": [k for k, _ in found], "score": [s for _, s in found]}

        return each

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return map_rows(narrow, "doc_id long, held_out boolean, lang_pred string, score double", work)

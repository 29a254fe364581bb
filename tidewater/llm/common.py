"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` splits on exactly these.
SPACES = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of documents that no model learns from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Where none is named, one is made only if everything runs on one machine; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and a lost executor loses nothing. It goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewater-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``place``: the number, from 0 on, that a row has within its group ``by`` in ``order`` (nulls first).

    Rows are dealt out by ranges of both, so a group of any size lies in many tasks; only a count for each task and group is summed up.
    ``rows`` should be a written table, and ``order`` should tell rows apart. No column of ``by`` may be null.
    """
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("place_at", F.monotonically_increasing_id())
    dealt = written(dealt, "placed").withColumn("place_in", F.shiftright("place_at", 33))
    counts = dealt.groupBy(*by, "place_in").agg(F.count("*").alias("n"), F.min("place_at").alias("place_first"))
    before = Window.partitionBy(*by).orderBy("place_in").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "place_in", "place_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("place_before"))
    found = dealt.join(starts, [*by, "place_in"])
    return found.select(*rows.columns, (F.col("place_before") + F.col("place_at") - F.col("place_first")).alias("place"))


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose own columns, which begin with an underscore, meet no column of its first table: such ones go through it under other names."""

    @wraps(operator)
    def run(docs: DataFrame, *given, **named) -> DataFrame:
        safe = {c: f"kept{i}-{uuid.uuid4().hex}" for i, c in enumerate(docs.columns) if c.startswith("_")}
        out = operator(docs.withColumnsRenamed(safe) if safe else docs, *given, **named)
        return out.withColumnsRenamed({held: c for c, held in safe.items()}) if safe else out

    return run


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for small tables that loops read again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_rows(df: DataFrame, schema: str, work: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]]) -> DataFrame:
    """``mapInArrow`` over ``df``. ``work()`` runs once a task and returns what turns a batch into column dicts."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    arrow = _arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in batches:
            for columns in each(batch):
                yield pa.RecordBatch.from_arrays([_array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, fields)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=kind)


def _arrow_schema(fields) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


class WordRows:
    """Numbers for words, worked out once for each new word of a task.

    ``fill(words)`` returns a row of ``width`` numbers for each of a list of words. ``rows(words)`` returns
    the indices of the words' rows in ``values``. At ``most`` words the table starts anew, so memory is bounded.
    """

    def __init__(self, fill: Callable[[list[bytes]], np.ndarray], width: int, dtype, most: int = 400_000):
        self.fill, self.most = fill, most
        self.values = np.zeros((4096, width), dtype)
        self.index: dict[bytes, int] = {}

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > self.most:
            self.index.clear()
        index = self.index
        new = set(words).difference(index)
        if new:
            new = list(new)
            at = len(index)
            while at + len(new) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            self.values[at : at + len(new)] = self.fill(new)
            index.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def of(self, words: list[bytes]) -> np.ndarray:
        """The words' rows themselves."""
        rows = self.rows(words)  # may renew ``values``
        return self.values[rows]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word. (Hashing anew is cheaper than looking words up among very many.)"""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread uint64 values over all bits (the finaliser of a well-known 64-bit generator)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


MULTIPLIER = 0x9E3779B97F4A7C15


def gram_hashes(h: np.ndarray, k: int, multiplier: int = MULTIPLIER) -> np.ndarray:
    """A hash for each run of ``k`` consecutive values of ``h`` (uint64); empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= np.uint64(multiplier)
        out += h[i : n + i]
    return mixed(out)


def subword_buckets(words: list[bytes], sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the character n-grams (of code points) of ``<word>``, and how many each word has (one at least: the whole word).

    Grams of one word lie together. Words count whole as well, under a hash of their own.
    """
    marked = [b"<" + w + b">" for w in words]
    joined = b"".join(marked)
    begins = (np.frombuffer(joined, np.uint8) & 0xC0) != 0x80  # the bytes that begin a character
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    length = np.add.reduceat(begins, np.cumsum(size) - size, dtype=np.int64) if words else size
    raw = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(length)
    owner = np.repeat(np.arange(len(words)), length)
    left = np.repeat(ends, length) - np.arange(len(raw))  # characters from here to the word's end
    whole = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in marked), np.uint64, len(marked))
    buckets, owners = [whole], [np.arange(len(words))]
    for k in sizes:
        n = len(raw) - k + 1
        if n <= 0:
            continue
        g = raw[:n].copy()
        for i in range(1, k):
            g *= np.uint64(0x100000001B3)
            g += raw[i : n + i]
        keep = left[:n] >= k
        buckets.append(mixed(g[keep] + np.uint64(k << 56)))
        owners.append(owner[:n][keep])
    bucket, who = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return (bucket[order] & np.uint64((1 << bits) - 1)).astype(np.int64), np.bincount(who, minlength=len(words))


def learned(rows: DataFrame, learn: Callable[[Iterator[pa.RecordBatch]], bytes], order: list[str]) -> bytes:
    """What ``learn`` makes of ``rows``, sorted by ``order``, in one task on an executor: only the model comes to the driver.

    ``rows`` is a sample whose size its caller bounds. A task that is lost is run again and learns the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"model": pa.array([learn(batches)], pa.binary())})

    found = rows.repartition(1).sortWithinPartitions(*order).mapInArrow(run, "model binary").first()
    return bytes(found[0]) if found else learn(iter(()))  # without rows Spark may run no task


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): (node, component), where component is the smallest node.

    Large-star and small-star steps by turns: each pulls a node's neighbours towards its smallest one, so
    no group is ever gathered, edges never outnumber those given, and rounds grow with the logarithm
    of the longest chain. Nulls are ignored; nodes without an edge don't appear.
    """
    now = cut(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Both sides grow with the corpus: joined by sorting, at every size.
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Edges now point from the larger node to the smaller.
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("merge"), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = cut(small.where("a <> b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

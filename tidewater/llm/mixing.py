"""Mixing sources to target weights by Pfair scheduling.

A source of weight w releases its k-th block at slot floor(k / w) and wants it by ceil((k + 1) / w). Of the blocks that are
released, the one with the earliest deadline goes first; then, at every slot, each source has had its share to within one
block. Weights are taken as the exact ratios that their floats are, so the bound holds against the weights given. When a
source runs out, the others go on by their weights among themselves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import shielded, written

#: Documents in a block.
BLOCK = 64
#: Documents in a bucket within which places are counted, at most about, and buckets of a source at most.
BUCKET, MOST_BUCKETS = 1024, 65_536


def release(k: int, part: int, units: int) -> int:
    """The first slot in which block ``k`` of a source of ``part`` in ``units`` may stand."""
    return k * units // part


def deadline(k: int, part: int, units: int) -> int:
    """The slot before which it must have stood."""
    return -(-(k + 1) * units // part)


def exact(weights: list[float]) -> list[int]:
    """Weights as integers in exactly their ratios."""
    if any(not 0 <= w < float("inf") for w in weights):
        raise ValueError("a weight is negative or not a number")
    ratios = [float(w).as_integer_ratio() for w in weights]
    most = max((d for _, d in ratios), default=1)  # powers of two
    return [n * (most // d) for n, d in ratios]


def schedule(sources: list[tuple[str, int, float]]) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(source, block, phase, slot, release, deadline) of all blocks of ``sources`` (name, blocks, weight), in order of slots.

    Of released blocks the earliest deadline goes first; ties by weight, then name. A phase ends when a source runs out.
    Sources of no weight go when the others have run out, by equal weights. Memory grows with sources only, time with blocks.
    """
    whole = exact([w for *_, w in sources])
    some = [(s, n, w) for (s, n, _), w in zip(sources, whole, strict=True) if n and w]
    phase = at = 0
    for group in (some, [(s, n, 1) for (s, n, _), w in zip(sources, whole, strict=True) if n and not w]):
        group = sorted(group, key=lambda x: (-x[2], x[0]))
        left, used = [n for _, n, _ in group], [0] * len(group)
        total = sum(w for *_, w in group)
        # Sources in a ring with a gate at the end; those that have had nothing in a phase stand in order of their deadlines.
        gate = len(group)
        after, before = [*range(1, gate + 1), 0], [gate, *range(gate)]
        while after[gate] != gate:
            waiting: list[tuple[int, int, int]] = []  # (release, source, block of the phase)
            ready: list[tuple[int, int, int, int]] = []  # (deadline, source, block of the phase, release)
            fresh, slot = after[gate], 0
            while True:
                while waiting and waiting[0][0] <= slot:
                    freed, i, k = heapq.heappop(waiting)
                    heapq.heappush(ready, (deadline(k, group[i][2], total), i, k, freed))
                first = (deadline(0, group[fresh][2], total), fresh, 0, 0) if fresh != gate else None
                if first is not None and (not ready or first < ready[0]):
                    due, i, k, freed = first
                    fresh = after[fresh]
                else:
                    due, i, k, freed = heapq.heappop(ready)
                if due <= slot:
                    raise AssertionError("a deadline was missed")
                yield group[i][0], used[i], phase, at + slot, at + freed, at + due
                used[i] += 1
                slot += 1
                if used[i] == left[i]:
                    break
                heapq.heappush(waiting, (release(k + 1, group[i][2], total), i, k + 1))
            after[before[i]], before[after[i]] = after[i], before[i]
            total -= group[i][2]
            at, phase = at + slot, phase + 1


BLOCKS = "_source string, mix_block long, mix_phase int, mix_slot long, mix_release long, mix_deadline long"


def planned(sources: DataFrame, rows: int = 16_384) -> DataFrame:
    """The schedule of ``sources`` (_source, _blocks, _weight), a row for each block: worked out in one task and given out as it goes."""
    schema = pa.schema([("_source", pa.string()), ("mix_block", pa.int64()), ("mix_phase", pa.int32()), *[(c, pa.int64()) for c in ("mix_slot", "mix_release", "mix_deadline")]])

    def run(batches):
        given = [row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
        part = []
        for block in schedule(given):
            part.append(block)
            if len(part) == rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
                part = []
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

    return sources.select("_source", "_blocks", "_weight").repartition(1).mapInArrow(run, BLOCKS)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_place``: a number from 0 on within each source, in an order that hashes decide.

    A source is dealt into buckets by hash, as many as the whole table would need; places are counted within buckets, and a
    bucket's first place is the count of those before it. No source is ever in one task; only the counts of its buckets are, and they are bounded.
    """
    buckets = min(MOST_BUCKETS, -(-docs.count() // BUCKET)) or 1
    dealt = docs.withColumn("_hash", F.xxhash64("doc_id"))
    dealt = dealt.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_source", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_hash", "doc_id")
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(firsts, ["_source", "_bucket"]).withColumn("_place", F.col("_first") + F.col("_rank")).drop("_bucket", "_first", "_rank", "_hash")


@shielded
def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, source: str = "source") -> DataFrame:
    """``docs`` with its place in the mixture: all rows, none twice.

    Adds ``mix_block`` (the block's number in its source), ``mix_slot`` (the slot of that block), ``mix_release`` and
    ``mix_deadline`` (the slots between which it was due), ``mix_phase`` (how many times sources had run out) and
    ``mix_position`` (the order of documents: by slot, then within the block; unique, but not without gaps where a source's
    last block isn't full). Up to any slot of a phase, a source has had its share of the phase's slots to within one block.

    ``weights`` are the target weights by source; sources without one weigh as the least of those given. Without
    ``weights``, a source weighs the square root of its count of documents. A null source is a source of its own (None in ``weights``), the empty name another.
    Rows with a null doc_id, and repeated ones, are placed like any other, in any order among those that are wholly alike in it. Sources of equal weight
    go in order of their names where their deadlines agree. Columns with the added names are replaced; all others stay, whatever their names.
    An empty table gives an empty result. Any number of sources will do; the table of sources never reaches the driver.
    """
    added = ("mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_phase", "mix_position")
    # A name of its own for rows without source, which no source can have.
    docs = docs.drop(*added).withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")))
    counts = docs.groupBy("_source").agg(F.count("*").alias("_n"))
    weight = F.sqrt("_n")
    if weights is not None:
        given = docs.sparkSession.createDataFrame([("" if s is None else f"={s}", float(w)) for s, w in weights.items()], "_source string, _given double")
        counts, weight = counts.join(F.broadcast(given), "_source", "left"), F.coalesce("_given", F.lit(float(min(weights.values()))))
    blocks = written(planned(counts.select("_source", F.expr(f"(_n + {block - 1}) div {block}").alias("_blocks"), weight.alias("_weight"))), "mix-blocks")
    # A row for each block, and a source's blocks lie apart: a hot source is many keys of a block each.
    dealt = numbered(docs).withColumn("mix_block", F.expr(f"_place div {block}"))
    out = dealt.join(blocks, ["_source", "mix_block"]).withColumn("mix_position", F.expr(f"mix_slot * {block} + _place % {block}"))
    return out.select(*[c for c in docs.columns if c != "_source"], *added)

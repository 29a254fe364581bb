"""Scans over the ordered rows of a group that is too large for one task: numbered by range, cut into pieces, each piece worked out for
every state it may be entered in, the outcomes composed, and the pieces gone through again from the states they are entered in."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.session import settled

#: Rows of a piece; groups of fewer rows are scanned in one go. Outcomes that are composed in one task.
PIECE, FAN = 16_384, 64


def matched(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A join on ``by`` by which a null key meets a null key."""
    other = right.withColumnsRenamed({c: f"_{c}_" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}_"))
    return left.join(other, same, how).drop(*[f"_{c}_" for c in by])


def placed(rows: DataFrame, by: list[str], order: list[Column], place: str = "_place") -> DataFrame:
    """``rows``, written, with their number from 0 on within their group, in ``order``.

    Rows are dealt out by ranges of both, so a group lies in as many tasks as its size needs; what tasks hold of each group is summed up.
    """
    held = settled(rows.withColumn("_row", F.monotonically_increasing_id()))  # so that ranges are drawn of the same rows that are dealt
    keys = [*[F.col(c) for c in by], *order, F.col("_row")]
    dealt = settled(held.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row").withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_task", F.shiftright("_at", 33))
    sums = dealt.groupBy(*by, "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "_task", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = matched(dealt, starts, [*by, "_task"])
    return found.withColumn(place, F.col("_before") + F.col("_at") - F.col("_first")).select(*rows.columns, place)


def parted(rows: DataFrame, by: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of at most ``most`` rows, and those of larger ones (none: there is no such group)."""
    large = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*by, F.lit(True).alias("_large"))
    if large.isEmpty():
        return rows, None
    marked = matched(rows, settled(large), by, "left")
    return marked.where("_large is null").drop("_large"), marked.where("_large").drop("_large")


def entered(outcomes: DataFrame, by: list[str], fan: int = FAN) -> DataFrame:
    """(by, piece, entry, ...) for each piece: the state it is entered in, as what stands before it makes it.

    ``outcomes`` (by, piece, leaves, count, held) has for each state that a piece may be entered in (its index in the lists) the state it is left
    in, how much it counts by then, and one more number that goes with the state it is left in. A group's first piece is entered in state 0.
    The result has ``entry``, ``count`` (of all pieces before) and ``held`` (of the piece before; 0 for the first).
    Outcomes of ``fan`` pieces at a time are composed to one, and so on until one is left; then states are handed down again.
    """
    lists = "leaves array<long>, count array<long>, held array<long>"
    fields = ", ".join(f"`{c}` {kind}" for c, kind in outcomes.select(*by).dtypes)
    levels = [outcomes]
    while (levels[-1].agg(F.max("piece")).first()[0] or 0) > 0:

        def compose(key: tuple, group: pa.Table) -> pa.Table:
            group = group.sort_by("piece")
            leaves = count = held = None
            for a, b, c in zip(*(group.column(n).to_pylist() for n in ("leaves", "count", "held")), strict=True):
                a, b, c = np.array(a), np.array(b), np.array(c)
                leaves, count, held = (a, b, c) if leaves is None else (a[leaves], count + b[leaves], c[leaves])
            own = {n: group.column(n).slice(0, 1) for n in by}
            return pa.table(own | {"piece": pa.array([key[-1].as_py()], pa.int64())} | {n: pa.array([x.tolist()], pa.list_(pa.int64())) for n, x in (("leaves", leaves), ("count", count), ("held", held))})

        above = levels[-1].withColumn("_above", F.expr(f"piece div {fan}"))
        levels.append(settled(above.groupBy(*by, "_above").applyInArrow(compose, f"{fields}, piece long, {lists}")))
    found = levels.pop().select(*by, "piece", *[F.lit(0).cast("long").alias(c) for c in ("entry", "count", "held")])
    while levels:

        def hand_down(group: pa.Table) -> pa.Table:
            group = group.sort_by("piece")
            state, total, more = (group.column(c)[0].as_py() for c in ("_entry", "_count", "_held"))
            rows = []
            for a, b, c in zip(*(group.column(n).to_pylist() for n in ("leaves", "count", "held")), strict=True):
                rows.append((state, total, more))
                state, total, more = a[state], total + b[state], c[state]
            return pa.table({c: group.column(c) for c in (*by, "piece")} | {n: pa.array(x, pa.int64()) for n, x in zip(("entry", "count", "held"), zip(*rows, strict=True), strict=True)})

        upper = found.select(*by, F.col("piece").alias("_above"), *[F.col(c).alias(f"_{c}") for c in ("entry", "count", "held")])
        lower = matched(levels.pop().withColumn("_above", F.expr(f"piece div {fan}")), upper, [*by, "_above"])
        found = settled(lower.groupBy(*by, "_above").applyInArrow(hand_down, f"{fields}, piece long, entry long, count long, held long"))
    return found


def outcomes(rows: DataFrame, by: list[str], piece: int, ahead: int, value: str, work: Callable[[np.ndarray, int], tuple[list[int], list[int], list[int]]]) -> DataFrame:
    """(by, piece, leaves, count, held) of the pieces of ``rows`` (by, _place, and ``value``, a long).

    ``work`` gets the values of a piece in order, with up to ``ahead`` of those that follow (fewer than a piece), and how many are the piece's own.
    """
    fields = ", ".join(f"`{c}` {kind}" for c, kind in rows.select(*by).dtypes)

    def each(group: pa.Table) -> pa.Table:
        group = group.sort_by("_place")
        values = group.column("_value").to_numpy()
        own = int(group.column("_own").to_numpy().sum())
        made = work(values, own)
        return pa.table({c: group.column(c).slice(0, 1) for c in (*by, "piece")} | {n: pa.array([x], pa.list_(pa.int64())) for n, x in zip(("leaves", "count", "held"), made, strict=True)})

    at = F.expr(f"_place div {piece}")
    own = rows.select(*by, "_place", F.col(value).alias("_value"), at.alias("piece"), F.lit(1).alias("_own"))
    next_ones = rows.where((F.col("_place") >= piece) & (F.col("_place") % piece < ahead)).select(*by, "_place", F.col(value).alias("_value"), (at - 1).alias("piece"), F.lit(0).alias("_own"))
    return settled(own.unionByName(next_ones).groupBy(*by, "piece").applyInArrow(each, f"{fields}, piece long, leaves array<long>, count array<long>, held array<long>"))

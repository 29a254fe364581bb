"""Operators over ordered rows of a tenant: chunks and their context, and limits that depend on what was let in before.

Where a row's fate depends on a running state, rows are dealt out by tenant, sorted, and streamed through a small state in
Arrow batches: a tenant of any size takes the memory of one batch. The rows of a tenant that has many are dealt out in pieces, each
entered in the state that those before it make (``pieces``). Everything else is windows and joins.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidewater.functions import text as x
from tidewater.functions import vocabulary as v
from tidewater.operators.pieces import PIECE, entered, matched, outcomes, parted, placed


def in_order(rows: DataFrame, by: list[str], order: list[Column], needs: list[str], added: str, fresh: Callable[[], object], step: Callable[..., list]) -> DataFrame:
    """``rows`` with the columns ``added``, worked out by ``step(state, *columns)`` on each group's rows in ``order``, a batch at a time.

    ``fresh()`` is a group's first state; ``needs`` are the columns that steps get, as Arrow arrays. A null key is a group like any other. The
    rows' own columns pass through as they came, but for those of ``needs`` that begin with an underscore, which are left out.
    """
    kept = [f for f in rows.schema if not (f.name in needs and f.name.startswith("_"))]
    names, new = [f.name for f in kept], StructType.fromDDL(added)
    fields = list(to_arrow_schema(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731  used within this turn
            change = np.zeros(n, bool)
            for k in by:  # codes tell nulls from values, and never round
                code = column(k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                change[1:] |= code[1:] != code[:-1]
            cuts, parts = [0, *np.flatnonzero(change).tolist(), n], []
            given = [column(c) for c in needs]
            for a, b in zip(cuts, cuts[1:], strict=False):
                key = tuple(column(k)[a].as_py() for k in by)
                if key != held:
                    held, state = key, fresh()
                parts.append(step(state, *(c.slice(a, b - a) for c in given)))
            made = [pa.array(np.concatenate(p), f.type) for p, f in zip(zip(*parts, strict=True), fields, strict=True)]
            own = [column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*own, *made], names=[*names, *(f.name for f in fields)])

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, StructType([*kept, *new]))


def canonical(at: str = "sent_at", ordinal: str = "source_ordinal", row_id: str = "id") -> list[Column]:
    """The order of messages: by time, then by line (those without one first), then by id."""
    return [F.col(at).asc_nulls_first(), F.coalesce(F.col(ordinal), F.lit(-1)), F.col(row_id).cast("string")]


def chunk_ends(t: np.ndarray, starts: np.ndarray, least: int, most: int, gap: int, span: int) -> np.ndarray:
    """Where a chunk ends that begins at each of ``starts``: when it is full, at the first row beyond its span, or at the next gap once it has enough rows."""
    gaps = np.append(np.flatnonzero(np.diff(t) >= gap) + 1, len(t))
    quiet = gaps[np.minimum(np.searchsorted(gaps, starts + max(1, least)), len(gaps) - 1)]
    return np.minimum.reduce([starts + most, np.searchsorted(t, t[starts] + span, "right"), quiet, np.full(len(starts), len(t))])


def chunked(
    messages: DataFrame, by: list[str], at: str, order: list[Column], least: int = v.LEAST_FOR_GAP, most: int = v.MOST_ROWS, gap_s: int = v.QUIET_GAP_S, span_s: int = v.SPAN_S, piece: int = PIECE
) -> DataFrame:
    """``messages`` with ``chunk_id`` (from 0 in each group) and ``chunk_place`` (from 1).

    A chunk ends before a message that is over ``span_s`` after its first, or that comes after a gap of ``gap_s`` when it has
    ``least`` rows, and at ``most`` rows. ``at`` is a timestamp without nulls. An empty table gives an empty one.

    A group of over ``piece`` rows is cut into pieces. A chunk's end hangs on its start alone, and the first start in a piece is one of
    its first ``most`` rows: for each of these the piece works out where it leaves off, which is composed over all pieces.
    """
    gap, span, piece = gap_s * 1_000_000, span_s * 1_000_000, max(piece, most)

    def step(state: dict, times: pa.Array, *entry: pa.Array) -> list:
        t = times.to_numpy()
        if not state:
            first, count, held = (x[0].as_py() for x in entry) if entry else (0, 0, 0)
            # ``lead`` rows still belong to the chunk that was open before.
            state.update(lead=first, n=held if first else 0, chunk=count - 1 if first else count, first=0, last=0)
        chunk, place = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
        at = min(state["lead"], len(t))
        chunk[:at], place[:at] = state["chunk"], np.arange(state["n"] + 1, state["n"] + 1 + at)
        state["lead"], state["n"] = state["lead"] - at, state["n"] + at
        if at and not state["lead"]:
            state.update(n=0, chunk=state["chunk"] + 1)
        n, first, now = state["n"], state["first"], state["chunk"]
        gaps = np.flatnonzero(np.diff(t, prepend=state["last"] if n else t[0]) >= gap)
        while at < len(t):
            if not n:
                first = t[at]
            after = int(np.searchsorted(gaps, at + max(0 if n else 1, least - n)))
            end = min(len(t), at + most - n, int(np.searchsorted(t, first + span, "right")), int(gaps[after]) if after < len(gaps) else len(t))
            chunk[at:end], place[at:end] = now, np.arange(n + 1, n + 1 + end - at)
            n, at = n + end - at, end
            if at < len(t):
                now, n = now + 1, 0
        state.update(n=n, first=first, last=t[-1], chunk=now)
        return [chunk, place]

    def work(t: np.ndarray, own: int) -> tuple[list[int], list[int], list[int]]:
        ends = chunk_ends(t, np.arange(own), least, most, gap, span).tolist()
        leaves, count, held = [0] * max(own, most), [0] * max(own, most), [0] * max(own, most)
        for i in range(own - 1, -1, -1):
            e = ends[i]
            leaves[i], count[i], held[i] = (e - own, 1, own - i) if e >= own else (leaves[e], count[e] + 1, held[e])
        return leaves[:most], count[:most], held[:most]

    added, fresh = "chunk_id long, chunk_place long", dict
    rows = messages.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    few, many = parted(rows, by, piece)
    found = in_order(few, by, order, ["_us"], added, fresh, step)
    if many is not None:
        line = placed(many, by, order)
        states = entered(outcomes(line, by, piece, most, "_us", work), by).select(*by, F.col("piece").alias("_piece"), *[F.col(c).alias(f"_{c}") for c in ("entry", "count", "held")])
        line = matched(line.withColumn("_piece", F.expr(f"_place div {piece}")), states, [*by, "_piece"])
        walked = in_order(line, [*by, "_piece"], [F.col("_place")], ["_us", "_entry", "_count", "_held"], added, fresh, step)
        found = found.unionByName(walked.drop("_piece", "_place"))
    return found


def contexts(chunks: DataFrame, by: list[str], at: str, order: list[Column], rows: int = v.OVERLAP_ROWS, age_s: int = v.OVERLAP_AGE_S, before: DataFrame | None = None) -> DataFrame:
    """(by, chunk_id, handle, context_place, and the columns of a message): what each chunk may read of the messages before it.

    The last ``rows`` messages before its first one, as far as they are at most ``age_s`` older. ``before`` are messages already
    dealt with, which come before all chunks. A join on positions, so nothing is paired that isn't kept.
    """
    line = chunks.withColumn("_old", F.lit(1))
    if before is not None:
        line = line.unionByName(before.withColumn("_old", F.lit(0)), allowMissingColumns=True)
    placed = line.withColumn("_pos", F.row_number().over(Window.partitionBy(*by).orderBy("_old", *order)))
    starts = placed.where("chunk_place = 1").select(*by, F.col("chunk_id").alias("_chunk"), F.col(at).alias("_first"), F.col("_pos").alias("_start"))
    wanted = starts.where("_start > 1").withColumn("_pos", F.explode(F.sequence(F.greatest(F.col("_start") - rows, F.lit(1)), F.col("_start") - 1)))
    near = placed.drop("chunk_id", "chunk_place", "_old").join(wanted, [*by, "_pos"]).where(F.col(at) >= F.col("_first") - F.expr(f"interval {age_s} seconds"))
    place = F.row_number().over(Window.partitionBy(*by, "_chunk").orderBy("_pos"))
    found = near.withColumn("context_place", place).withColumnRenamed("_chunk", "chunk_id").drop("_pos", "_start", "_first")
    return found.withColumn("handle", F.concat(F.lit("c"), F.col("context_place").cast("string")))


def handle() -> Column:
    return F.concat(F.lit("m"), F.col("chunk_place").cast("string"))


def transcript_line(handle_: Column, context: Column, at: Column, zone: str, sender: Column, kind: Column, text: Column, filename: Column, spoken: Column) -> Column:
    """One message as a line: handle, local time with the day's name, sender, and words or what was shared."""
    local = F.from_utc_timestamp(at, zone)
    words = x.collapsed(F.coalesce(text, F.lit("")))
    said = spoken & (words != "")
    labels = F.create_map(*[F.lit(n) for pair in v.MEDIA_LABELS.items() for n in pair])
    label = F.coalesce(F.element_at(labels, kind), F.lit("attachment"))
    shared = F.concat(F.lit("["), label, F.coalesce(F.concat(F.lit(": "), F.nullif(filename, F.lit(""))), F.lit("")), F.lit("] "))
    body = F.when((kind == "text") | said, words).otherwise(F.concat(shared, words))
    who = F.concat(F.coalesce(F.nullif(sender, F.lit("")), F.lit("Unknown")), F.when(said, " (voice note)").otherwise(""))
    marker = F.when(context, "context_only ").otherwise("")
    return F.rtrim(F.concat(F.lit("["), handle_, F.lit("] "), marker, F.date_format(local, "EEE yyyy-MM-dd HH:mm"), F.lit(" — "), who, F.lit(": "), body))


def halved(chunks: DataFrame, by: list[str], least: int = 30, overlap: int = v.OVERLAP_ROWS) -> tuple[DataFrame, DataFrame]:
    """The two halves of chunks that were too large, and what the second ones may read of the first.

    ``chunks`` has chunk_id and chunk_place; halves are told by ``half`` (1 or 2). Chunks of ``least`` rows or fewer have no halves.
    """
    sizes = chunks.groupBy(*by, "chunk_id").agg(F.max("chunk_place").alias("_n")).where(F.col("_n") > least)
    rows = chunks.join(sizes, [*by, "chunk_id"]).withColumn("_cut", F.floor(F.col("_n") / 2))
    half = F.when(F.col("chunk_place") <= F.col("_cut"), 1).otherwise(2)
    place = F.when(half == 1, F.col("chunk_place")).otherwise(F.col("chunk_place") - F.col("_cut"))
    context = rows.where((F.col("chunk_place") <= F.col("_cut")) & (F.col("chunk_place") > F.col("_cut") - overlap)).drop("_n", "_cut")
    return rows.withColumn("half", half).withColumn("chunk_place", place).drop("_n", "_cut"), context


def occurrences(messages: DataFrame, by: list[Column], order: list[Column]) -> DataFrame:
    """``messages`` with ``occurrence``: how many equal ones (by all of ``by``) came before in the batch."""
    return messages.withColumn("occurrence", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def admitted(hits: DataFrame, by: list[str], at: str, order: list[Column], most: int = 10, window_s: int = 3600, piece: int = PIECE) -> DataFrame:
    """``hits`` with ``let_in``: at most ``most`` in any ``window_s``, counting only those let in; one exactly that old no longer counts.

    A group of over ``piece`` hits is cut where it is certain which were the last ones let in: before a gap of a whole window, or after
    ``most`` hits of which each is let in whatever came before it, because no more than ``most`` came in the window before it. Between
    such places, in a group that is refused something all the time, hits go in order in one task, which passes over those refused in one step.
    """
    width, piece = window_s * 1_000_000, max(piece, 2 * most + 1)

    def step(state: dict, times: pa.Array, *entry: pa.Array) -> list:
        t = times.to_numpy()
        good = np.zeros(len(t), bool)
        if most <= 0:
            return [good]
        if not state:
            state["held"] = deque(entry[0][0].as_py() or [] if entry else [], most)
        held, run, i = state["held"], 0, 0
        over = np.append(np.flatnonzero(t[most:] - t[:-most] < width) + most, len(t))  # hits that may be refused
        while i < len(t):
            if len(held) == most and held[0] > t[i] - width:
                i, run = int(np.searchsorted(t, held[0] + width)), 0
                continue
            end = int(over[np.searchsorted(over, i)]) if run >= most else i + 1
            end = max(end, i + 1)
            good[i:end] = True
            held.extend(t[max(i, end - most) : end].tolist())
            i, run = end, run + end - i
        return [good]

    rows = hits.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    few, many = parted(rows, by, piece)
    found = in_order(few, by, order, ["_us"], "let_in boolean", dict, step)
    if many is not None and most > 0:
        line = placed(many, by, order).withColumn("_piece", F.expr(f"_place div {piece}"))
        # Of each piece its first row, and of the one before the last rows.
        first = line.where(F.col("_place") % piece == 0).select(*by, "_piece", F.col("_us").alias("_begins"))
        before = line.where(F.col("_place") % piece >= piece - 2 * most).select(*by, (F.col("_piece") + 1).alias("_piece"), F.struct("_place", "_us").alias("_p"))
        before = before.groupBy(*by, "_piece").agg(F.array_sort(F.collect_list("_p")).alias("_p")).withColumn("_p", F.expr("transform(_p, x -> x._us)"))
        edges = matched(first, before, [*by, "_piece"], "left")
        quiet = F.col("_begins") - F.element_at("_p", -1) >= width
        sure = F.expr(f"size(_p) = {2 * most} and forall(sequence({most}, {2 * most - 1}), i -> _p[i] - _p[i - {most}] >= {width})")
        edges = edges.withColumn("_sure", F.col("_p").isNull() | quiet | sure).withColumn("_held", F.when(quiet, F.array().cast("array<bigint>")).otherwise(F.slice("_p", most + 1, most)))
        upto = Window.partitionBy(*by).orderBy("_piece")
        edges = edges.withColumn("_stretch", F.sum(F.col("_sure").cast("long")).over(upto)).withColumn("_held", F.last(F.when(F.col("_sure"), F.struct("_held")), True).over(upto))
        line = matched(line, edges.select(*by, "_piece", "_stretch", F.coalesce("_held._held", F.array().cast("array<bigint>")).alias("_held")), [*by, "_piece"])
        walked = in_order(line, [*by, "_stretch"], [F.col("_place")], ["_us", "_held"], "let_in boolean", dict, step)
        found = found.unionByName(walked.drop("_stretch", "_place", "_piece"))
    elif many is not None:
        found = found.unionByName(many.drop("_us").withColumn("let_in", F.lit(False)))
    return found


def tumbling(hits: DataFrame, by: list[str], start: Column, limit: int) -> DataFrame:
    """(by, window_start, attempts, refused): hits in each window, counted up to one above the limit."""
    counted = hits.groupBy(*by, start.alias("window_start")).agg(F.least(F.count("*"), F.lit(limit + 1)).alias("attempts"))
    return counted.withColumn("refused", F.col("attempts") > limit)


def bursts(hits: DataFrame, by: list[str], at: str, seconds: int) -> DataFrame:
    """``hits`` with ``in_burst``: how many of the group fall in the seconds up to each, itself included."""
    back = Window.partitionBy(*by).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return hits.withColumn("in_burst", F.count("*").over(back))

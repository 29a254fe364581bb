"""Groups too large for one task, in pieces: against walks row by row."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tidewater.operators import graphs, ingest, pieces, sequences


def log(seed, count=3000, steps=(0, 1, 5, 60, 400, 4000, 50_000)):
    """(id, tenant, seconds): the tenant 0 has half of all rows, and null is a tenant too."""
    r = random.Random(seed)
    at, rows = 0, []
    for i in range(count):
        at += r.choice(steps)
        rows.append((i, r.choice((0, 0, 1, None)), at))
    return rows


def frame(spark, rows):
    shuffled = rows[:]
    random.Random(0).shuffle(shuffled)
    return spark.createDataFrame(shuffled, "id long, t long, s long").withColumn("at", F.timestamp_seconds("s")).repartition(3)


def order():
    return [F.col("at"), F.col("id")]


def test_places_are_numbers_in_order(spark):
    rows = log(1, 500)
    found = pieces.placed(frame(spark, rows), ["t"], order())
    seen, want = {}, {}
    for i, t, _ in rows:
        want[i] = seen.get(t, 0)
        seen[t] = want[i] + 1
    assert {x.id: x._place for x in found.collect()} == want


@pytest.mark.parametrize(("least", "most", "gap", "span", "steps"), [(3, 10, 300, 5000, (0, 1, 5, 60, 400, 4000)), (1, 4, 50, 10**6, (1, 60)), (5, 50, 10**6, 2000, (1, 50)), (80, 200, 3600, 86400, (1, 600, 4000)), (10**6, 30, 1, 10**9, (1, 2))])
def test_chunks_in_pieces_are_those_of_a_walk(spark, least, most, gap, span, steps):
    rows, want, state = log(3, steps=steps), {}, {}
    for i, t, s in rows:
        n, first, last, now = state.get(t, (0, 0, 0, 0))
        if n and (s - first > span or n >= least and s - last >= gap or n >= most):
            now, n = now + 1, 0
        first = s if not n else first
        state[t] = (n + 1, first, s, now)
        want[i] = (now, n + 1)
    found = sequences.chunked(frame(spark, rows), ["t"], "at", order(), least, most, gap, span, piece=64)
    assert found.columns == ["id", "t", "s", "at", "chunk_id", "chunk_place"]
    assert {x.id: (x.chunk_id, x.chunk_place) for x in found.collect()} == want


@pytest.mark.parametrize(("most", "window", "steps"), [(2, 60, (0, 1, 5, 60, 400)), (3, 100, (1, 2)), (10, 3600, (1, 300, 900, 5000)), (1, 10, (1, 9, 10, 11)), (0, 10, (1,))])
def test_admission_in_pieces_is_that_of_a_walk(spark, most, window, steps):
    rows, want, state = log(4, steps=steps), {}, {}
    for i, t, s in rows:
        held = state.setdefault(t, deque())
        while held and held[0] <= s - window:
            held.popleft()
        want[i] = len(held) < most
        if want[i]:
            held.append(s)
    found = sequences.admitted(frame(spark, rows), ["t"], "at", order(), most, window, piece=40)
    assert found.columns == ["id", "t", "s", "at", "let_in"]
    assert {x.id: x.let_in for x in found.collect()} == want


@pytest.mark.parametrize("piece", [16, 10**6])
def test_either_key_by_components_is_that_of_a_walk(spark, piece):
    r = random.Random(6)
    rows = [(i, r.choice((0, 0, 1, None)), i, r.choice((None, *range(260))), r.choice((None, *range(200)))) for i in range(400)]
    want, state = {}, {}
    for i, t, _, a, b in rows:
        ones, others = state.setdefault(t, (set(), set()))
        want[i] = a not in ones and (b is None or b not in others)
        if want[i]:
            ones.add(a)
            if b is not None:
                others.add(b)
    df = spark.createDataFrame(rows, "id long, t long, s long, content_hash long, provider_message_id long")
    found = ingest.either_key(df, ["t"], [F.col("s")], piece=piece)
    assert {x.id: x.first for x in found.collect()} == want and found.columns == [*df.columns, "first"]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (None, 3), (9, 8)]
    found = {x.node: x.component for x in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 540)} | {7: 7, 8: 8, 9: 8}

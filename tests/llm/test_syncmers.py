"""Fingerprints by closed syncmers: against a plain reading of the definition, and rows that are out of the ordinary."""

from __future__ import annotations

import random
import re
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tidewater.llm import syncmers

PRIME = 2**31 - 1


def plain_anchors(text):
    """Of each anchor the first position: runs of five units whose least inner pair is the first or the last."""
    hashes = [crc32(u.encode()) for u in re.findall("[^\x20\x09-\x0d]{1,4}", text or "")]
    if len(hashes) < 5:
        acc = 1
        for h in hashes:
            acc = (acc * 48271 + h * 69621 + 11) % PRIME
        return {acc: 0} if hashes else {}
    inner = [(a * 48271 + b * 69621 + 11) % PRIME for a, b in zip(hashes, hashes[1:], strict=False)]
    runs = [inner[i : i + 4] for i in range(len(hashes) - 4)]
    picked = [i for i, g in enumerate(runs) if min(g) in (g[0], g[3])] or range(len(runs))
    found = {}
    for i in picked:
        found.setdefault((runs[i][0] * 16807 + runs[i][2] * 39373 + runs[i][3] * 62089 + 7) % PRIME, i)
    return found


def plain_sketch(text):
    return sorted((h, min(i, 2**20 - 1)) for h, i in plain_anchors(text).items())[:48]


def plain_likeness(a, b):
    if not a and not b:
        return 1.0
    x, y = dict(a), dict(b)
    shifts = {h: x[h] - y[h] for h in x if h in y}
    middle = sorted(shifts.values())[(len(shifts) - 1) // 2] if shifts else 0
    most = max(16, max([*x.values(), *y.values()]) // 8)
    some = sorted({*x, *y})[:48]
    share = sum(h in shifts and abs(shifts[h] - middle) <= most for h in some) / len(some)
    return 2 * share / (1 + share)


def texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdeéü漢") for _ in range(r.randint(1, 11))) for _ in range(400)]
    long = " ".join(r.choice(words) for _ in range(30_000))
    return ["", None, " \t\n", "a", "a b", "a b c d", "a b c d e", "same " * 50, "no-spaces-at-all" * 30, "😀" * 40, long, long[:1000], long[5:900], "x" * 100_000] + [
        " ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(150)
    ]


def test_sketches_and_likeness_are_those_of_the_definition(spark):
    given = texts()
    docs = spark.createDataFrame([(i, t, t) for i, t in enumerate(given)], "doc_id long, text string, sketch_units string")
    found = syncmers.fingerprints(docs).withColumns({"print": syncmers.fingerprint("sketch"), "n": F.char_length("text")}).withColumn("again", syncmers.sketch("print")).collect()
    for row in found:
        want = plain_sketch(given[row.doc_id])
        assert [(x >> 20, x & (2**20 - 1)) for x in row.sketch] == want and row.again == row.sketch
        assert row.print == "".join(f"{h:08x}{i:05x}" for h, i in want)
    r = random.Random(1)
    pairs = [(i, r.randrange(len(given))) for i in range(len(given))] + [(i, i) for i in range(20)] + [(10, 11), (11, 12), (10, 12)]
    sketches = {x.doc_id: x.sketch for x in found}
    rows = spark.createDataFrame([(i, j, sketches[i], sketches[j]) for i, j in pairs], "i long, j long, a array<long>, b array<long>")
    for row in syncmers.likeness(rows, "a", "b", "near").collect():
        want = plain_likeness(plain_sketch(given[row.i]), plain_sketch(given[row.j]))
        assert row.near == pytest.approx(want, abs=1e-12)
        assert row.near == 1 if row.i == row.j else row.near <= 1


def test_an_anchor_depends_on_nothing_outside_its_run():
    r = random.Random(8)
    words = [f"{r.randrange(10**6):06x}"[:4] for _ in range(300)]
    inside = {h for h, i in plain_anchors(" ".join(words[100:200])).items()}
    for around in (words, [*words[50:100], *words[100:200], *words[:30]]):
        whole = plain_anchors(" ".join(around))
        assert inside <= whole.keys()
    at = sorted(plain_anchors(" ".join(words)).values())
    assert all(b - a <= 3 for a, b in zip(at, at[1:], strict=False))  # one of any three runs


@pytest.mark.parametrize("seed", range(3))
def test_the_next_document_follows_by_number(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice((None, *range(12))), r.choice((None, "", *["".join(r.choice("ab ") for _ in range(r.randint(1, 90))) for _ in range(9)]))) for _ in range(1 if seed == 2 else 40)]
    by = {}
    for doc_id, text in rows:
        if doc_id is not None:
            by.setdefault(doc_id, []).append(text or "")
    ids = sorted(by)
    want = []
    for doc_id, text in rows:
        head = ""
        if doc_id is not None:
            need = max(len(t) // 4 for t in by[doc_id])
            head = min(t[:need] for t in by[ids[(ids.index(doc_id) + 1) % len(ids)]])
        want.append((str(doc_id), text or "", head))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("all", "place", "of", "need", "head", "next", "n_chars")})
    found = syncmers.with_next(docs).collect()
    assert sorted((str(x.doc_id), x.text, x.head) for x in found) == sorted(want)
    assert all((x.next_sketch is None) == (x.doc_id is None) for x in found)


def test_an_empty_table(spark):
    assert syncmers.with_next(spark.createDataFrame([], "doc_id long, text string")).collect() == []

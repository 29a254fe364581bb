"""Document fingerprints by closed syncmers.

A text's units are its words, cut every four code points. Of the runs of ``RUN`` units those are anchors whose least inner run of ``INNER``
units, by hash, lies at an edge. Whether a run is an anchor depends on nothing outside it, so texts that share a passage share its anchors,
wherever it stands, and of any ``RUN - INNER`` runs in a row one at least is an anchor. A fingerprint holds the ``KEPT`` anchors of smallest
hash, each with its first position. Likeness is that of the anchor sets, estimated from the smallest of both together; an anchor that both have
counts if it is moved about as far as most of them.

All is done by DataFrame functions on arrays of numbers: a hash for each unit, and sums of a few hashes modulo a prime for runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import SPACES, placed, written

#: Code points in a unit, units in a run and in an inner run, anchors in a fingerprint.
UNIT, RUN, INNER, KEPT = 4, 5, 2, 48
#: Hashes are below this prime; a position takes the lower bits of an anchor (later ones count as the last).
PRIME, PLACES = 2**31 - 1, 20
#: Hexadecimal digits of an anchor.
DIGITS = 13
#: How far an anchor may be moved from where most are, as a part of the longer text, and in units at least.
PART, LEAST = 8, 16


def sketched(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``: the anchors of column ``text`` that its fingerprint holds, as ascending numbers of hash and position.

    A text of fewer than ``RUN`` units is one anchor; null, and texts without words, have none. If no run of a text is an anchor, which
    only texts of a few units allow, all are. Columns beginning with ``name`` and an underscore are used on the way.
    """
    units, inner, picked, packed = (f"{name}_{x}" for x in ("units", "inner", "picked", "packed"))
    assert (RUN, INNER) == (5, 2)  # a run's four inner runs begin at i to i + 3
    expr = lambda e: F.expr(e.replace("MIX", f"% {PRIME}"))
    df = df.withColumn(units, F.transform(F.regexp_extract_all(F.col(text), F.lit(f"[^{SPACES}]{{1,{UNIT}}}"), F.lit(0)), lambda u: F.crc32(u.cast("binary"))))
    less = f"greatest(size({units}) - 1, 0)"
    df = df.withColumn(inner, expr(f"zip_with(slice({units}, 1, {less}), slice({units}, 2, {less}), (a, b) -> (a * 48271 + b * 69621 + 11) MIX)"))
    places = f"sequence(0, size({units}) - {RUN})"
    edge = f"least({inner}[i], {inner}[i + 3]) <= least({inner}[i + 1], {inner}[i + 2])"
    df = df.withColumn(picked, expr(f"if(size({units}) >= {RUN}, filter({places}, i -> {edge}), array())"))
    df = df.withColumn(picked, expr(f"if(size({units}) >= {RUN} and size({picked}) = 0, {places}, {picked})"))
    number = f"(({inner}[i] * 16807 + {inner}[i + 2] * 39373 + {inner}[i + 3] * 62089 + 7) MIX) * {1 << PLACES} + least(i, {(1 << PLACES) - 1})"
    short = f"array(aggregate({units}, 1L, (acc, x) -> (acc * 48271 + x * 69621 + 11) MIX) * {1 << PLACES})"
    df = df.withColumn(packed, expr(f"case when size({units}) >= {RUN} then sort_array(transform({picked}, i -> {number})) when size({units}) > 0 then {short} else cast(array() as array<bigint>) end"))
    # Of an anchor that stands twice, the first position: numbers are in order, so it is the one after another hash.
    first = f"filter({packed}, (x, i) -> i = 0 or shiftright(x, {PLACES}) <> shiftright({packed}[i - 1], {PLACES}))"
    df = df.withColumn(name, F.coalesce(expr(f"slice({first}, 1, {KEPT})"), F.array().cast("array<bigint>")))
    return df.drop(units, inner, picked, packed)


def fingerprint(sketch: str) -> Column:
    """The fingerprint's text: ``DIGITS`` hexadecimal digits for each anchor, eight for its hash and five for its position."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), DIGITS, "0")), "")


def sketch(fingerprint: str) -> Column:
    """The anchors that a fingerprint's text holds."""
    return F.expr(f"transform(regexp_extract_all({fingerprint}, '[0-9a-f]{{{DIGITS}}}', 0), x -> cast(conv(x, 16, 10) as bigint))")


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``df`` with ``name``: how alike two sketches are, from 0 to 1, as twice the anchors that both have by all of either's.

    Equal sketches have 1, two without anchors too; a null sketch gives null. Columns beginning with ``name`` and an underscore are used on the way.
    """
    hashes = lambda c: F.transform(c, lambda x: F.shiftright(x, PLACES))
    both, shifts, middle, good, some = (f"{name}_{x}" for x in ("both", "shifts", "middle", "good", "some"))
    df = df.withColumn(both, F.array_intersect(hashes(a), hashes(b)))
    df = df.withColumn(some, F.slice(F.sort_array(F.array_union(hashes(a), hashes(b))), 1, KEPT))
    mask = (1 << PLACES) - 1
    own = lambda c: f"filter({c}, x -> array_contains({both}, shiftright(x, {PLACES})))"
    df = df.withColumn(shifts, F.expr(f"zip_with({own(a)}, {own(b)}, (x, y) -> struct(shiftright(x, {PLACES}) as h, (x & {mask}) - (y & {mask}) as d))"))
    df = df.withColumn(middle, F.expr(f"if(size({shifts}) > 0, sort_array(transform({shifts}, x -> x.d))[(size({shifts}) - 1) div 2], 0L)"))
    span = f"array_max(transform(concat({a}, {b}), x -> x & {mask}))"
    df = df.withColumn(good, F.expr(f"transform(filter({shifts}, x -> abs(x.d - {middle}) <= greatest({LEAST}, {span} div {PART})), x -> x.h)"))
    share = F.size(F.array_intersect(some, good)) / F.size(some)
    return df.withColumn(name, F.when(F.size(some) == 0, F.lit(1.0)).otherwise(2 * share / (1 + share))).drop(both, shifts, middle, good, some)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sketch) for each row of ``docs``; null texts are empty. Repeated rows are kept; other columns aren't read."""
    return sketched(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "text", "sketch")


def with_next(docs: DataFrame, part: int = 4) -> DataFrame:
    """(doc_id, text, sketch, head, next_sketch): each document with the beginning of the next one, as long as a ``part``-th of its own, and the next one's sketch.

    Documents go by ascending doc_id, and the first follows the last; one that is alone follows itself. Rows that share a doc_id have
    the same next one, and are it by the one of them that has the smallest beginning. Rows without doc_id have no place in the order:
    ``head`` is empty and ``next_sketch`` null. An empty table gives an empty result.

    Texts are dealt out once, by doc_id; of the next document only the beginning is moved again.
    """
    made = fingerprints(docs)
    known = made.where("doc_id is not null")
    quarters = made.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr(f"char_length(text) div {part}")).cast("int").alias("quarter"))
    ids = written(placed(written(quarters.withColumn("all", F.lit(0)), "next-ids"), ["all"], ["doc_id"]).drop("all"), "next-places")
    count = max(1, ids.count())
    before = ids.select(F.col("doc_id").alias("of"), F.col("quarter").alias("need"), ((F.col("place") + 1) % count).alias("place"))
    links = written(ids.join(before, "place").select("doc_id", "of", "need"), "next-links")
    begun = known.join(links.hint("merge"), "doc_id")
    begun = begun.groupBy("of").agg(F.min(F.struct(F.expr("substring(text, 1, need)").alias("head"), F.col("sketch").alias("next_sketch"))).alias("next"))
    heads = begun.select(F.col("of").alias("doc_id"), "next.head", "next.next_sketch")
    out = known.join(heads.hint("merge"), "doc_id").select("doc_id", "text", "sketch", "head", "next_sketch")
    rest = made.where("doc_id is null").select("doc_id", "text", "sketch", F.lit("").alias("head"), F.lit(None).cast("array<bigint>").alias("next_sketch"))
    return out.unionByName(rest)

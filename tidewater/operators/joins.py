"""Groups that the account joins: told from replays of old state by how many groups turn up at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import vocabulary as v


def first_sightings(events: DataFrame, group: str, at: str, order: list[str]) -> DataFrame:
    """``events`` with ``first``: whether nothing of the group came before, of any kind. A group's earliest event counts, ties by ``order``."""
    earliest = events.groupBy(group).agg(F.min(F.struct(at, *order)).alias("_e"))
    return events.join(earliest, group).withColumn("first", F.struct(at, *order) == F.col("_e")).drop("_e")


def slots(sightings: DataFrame, us: Column, width: int) -> DataFrame:
    """Each row in the slot of its time (``own``) and in those beside it: what is at most ``width`` from an own row stands in its slot."""
    near = F.explode(F.array(*[F.struct((F.floor(us / width) + k).alias("slot"), F.lit(k == 0).alias("own")) for k in (-1, 0, 1)]))
    return sightings.withColumn("_s", near).select("*", F.col("_s.slot").alias("slot"), F.col("_s.own").alias("own")).drop("_s")


def outcomes(events: DataFrame, group: str, at: str, kind: str, order: list[str], window_s: int = v.JOIN_BURST_S, joined: str = "joined") -> DataFrame:
    """``events`` with ``outcome``, ``appeared`` and ``appeared_later``: what becomes of each event of a group.

    ``not_a_join``: an event of another kind, which only makes the group known. ``already_known``: something of the group came before.
    ``burst_suppressed``: another group was first seen in the ``window_s`` up to the join (``appeared`` counts them, itself included; one exactly that
    old no longer counts). ``withheld``: when asked again ``window_s`` later, with twice the window, another one had turned up
    (``appeared_later``). ``welcomed``: it joined alone. Counts are null for events that aren't a group's first. A window of 0 or less counts nothing.

    Rows with a null group or time have no outcome and are left out. First sightings are counted in slots of the window's width, each with
    those beside it, so no task sees all of them.
    """
    width = window_s * 1_000_000
    known = first_sightings(events.where(F.col(group).isNotNull() & F.col(at).isNotNull()), group, at, order)
    if width <= 0:
        counted = known.where("first").withColumns({"appeared": F.lit(0).cast("long"), "appeared_later": F.lit(0).cast("long")})
    else:
        us = F.unix_micros(F.col(at).cast("timestamp"))
        line = Window.partitionBy("slot").orderBy("_us")
        near = slots(known.where("first").withColumn("_us", us), F.col("_us"), width)
        near = near.withColumn("appeared", F.count("*").over(line.rangeBetween(1 - width, 0))).withColumn("appeared_later", F.count("*").over(line.rangeBetween(1 - width, width)))
        counted = near.where("own").drop("slot", "own", "_us")
    none = F.lit(None).cast("long")
    rows = counted.unionByName(known.where("not first").withColumns({"appeared": none, "appeared_later": none}))
    outcome = F.when(F.coalesce(F.col(kind) != joined, F.lit(True)), "not_a_join").when(~F.col("first"), "already_known").when(F.col("appeared") > 1, "burst_suppressed")
    return rows.withColumn("outcome", outcome.when(F.col("appeared_later") > 1, "withheld").otherwise("welcomed")).drop("first")

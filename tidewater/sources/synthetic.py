"""Chats that never were: export lines made from a seed, with what they must parse to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import spread

PEOPLE = ("Ada", "Bo", "Cy", "Dee")
WORDS = ("tea", "walk", "rain", "pills", "bus", "garden", "late", "well")


def chats(files: DataFrame, messages: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Lines (file, at, raw) of the exports that ``files`` (file, a name each) asks for, and the messages (file, source_ordinal, sender, text, sent_at) in them.

    The same names and seed give the same chats, however the rows are dealt out. Every fifth message goes on over a second line.
    """
    n = F.col("source_ordinal")
    pick = lambda of, salt: F.get(F.array(*[F.lit(x) for x in of]), F.pmod(F.xxhash64("file", n, F.lit(seed), F.lit(salt)), F.lit(len(of))).cast("int"))
    text = F.concat_ws(" ", *[pick(WORDS, i) for i in range(4)])
    text = F.when(n % 5 == 4, F.concat(text, F.lit("\n"), pick(WORDS, 9))).otherwise(text)
    begun = F.lit(1_700_000_000) + F.pmod(F.xxhash64("file", F.lit(seed)), F.lit(10_000_000))
    at = F.timestamp_seconds(begun + n * 97 + F.pmod(F.xxhash64("file", n, F.lit(seed)), F.lit(60)))
    each = spread(files.select("file"), "file").select("file", F.explode(F.sequence(F.lit(0), F.lit(messages - 1))).alias("source_ordinal"))
    rows = each.select("file", "source_ordinal", pick(PEOPLE, 5).alias("sender"), text.alias("text"), at.alias("sent_at"))
    line = F.concat(F.lit("["), F.date_format("sent_at", "dd/MM/yyyy, HH:mm:ss"), F.lit("] "), "sender", F.lit(": "), "text")
    parts = F.posexplode(F.split(line, "\n")).alias("part", "raw")
    return rows.select("file", "source_ordinal", parts).select("file", F.struct(F.col("source_ordinal"), F.col("part")).alias("at"), "raw"), rows

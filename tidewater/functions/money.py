"""What calls cost, in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import vocabulary as v

COST = "decimal(10,6)"


def token_cost(model: Column, read: Column, cached: Column, written: Column, prices: dict[str, tuple[str, str]]) -> Column:
    """Dollars for a call. ``read`` includes ``cached``, which costs a tenth; a model without a price is an error.

    ``prices``: for each model, the price of a million tokens read, and of a million written.
    """
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(12,0)")
    found = F
    for name, (inward, outward) in prices.items():
        i, o, rate = (F.lit(n).cast("decimal(8,4)") for n in (inward, outward, v.CACHED_RATE))
        fresh = F.greatest(whole(read) - whole(cached), F.lit(0).cast("decimal(12,0)"))
        total = (fresh * i + whole(cached) * (i * rate).cast("decimal(12,6)") + whole(written) * o).cast("decimal(28,6)")
        found = found.when(model == name, F.round(total / F.lit(1_000_000).cast("decimal(7,0)"), 6).cast(COST))
    return found.otherwise(F.raise_error(F.concat(F.lit("no price for model "), model)).cast(COST))


def audio_cost(model: Column, seconds: Column, prices: dict[str, str] | None = None) -> Column:
    """Dollars for a transcription; below zero seconds counts as zero."""
    found = F
    for name, price in (prices or v.AUDIO_PRICES).items():
        total = F.greatest(seconds.cast("decimal(14,3)"), F.lit(0).cast("decimal(14,3)")) * F.lit(price).cast("decimal(6,4)") / F.lit(60).cast("decimal(2,0)")
        found = found.when(model == name, F.round(total, 6).cast(COST))
    return found.otherwise(F.raise_error(F.concat(F.lit("no price for model "), model)).cast(COST))


def audio_seconds(size: Column) -> Column:
    """Seconds that a file of so many bytes is billed for where nothing tells its length."""
    return F.greatest(size, F.lit(0)) * 8 / F.lit(v.AUDIO_BITS_PER_S)


def chunk_count(messages: Column) -> Column:
    return F.ceil(F.greatest(messages, F.lit(0)) / v.TARGET).cast("long")


def estimate(chunks: DataFrame, price: tuple[str, str], fixed: int = 1400, written: int = 760, at_once: int = 4, seconds: int = 12) -> DataFrame:
    """(chunks, read, cost, minutes) of ``chunks`` (tokens: what each reads beside the fixed part)."""
    i, o = (F.lit(p).cast("decimal(8,4)") for p in price)
    sums = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.col("tokens") + fixed), F.lit(0)).alias("read"))
    total = (F.col("read").cast("decimal(18,0)") * i + (F.col("chunks") * written).cast("decimal(18,0)") * o) / F.lit(1_000_000).cast("decimal(7,0)")
    minutes = F.greatest(F.lit(1), F.bround(F.col("chunks") / at_once * seconds / 60).cast("int"))
    return sums.select("chunks", "read", F.round(total, 4).cast("decimal(18,4)").alias("cost"), minutes.alias("minutes"))

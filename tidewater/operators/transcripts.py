"""Voice notes: which are worth writing down, and what becomes of the message when they are."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import money, nested, times
from tidewater.functions import vocabulary as v
from tidewater.operators.calls import TransientError, backoff


def skip_reason(on: bool = True, provider: str = "gateway", longest_s: int = 600) -> Column:
    """Why a message isn't written down; null if it is to be. Columns: message_type, text, payload (JSON text), provider, provider_message_id."""
    if not on:
        return F.lit("disabled")
    marked = F.coalesce(F.get_json_object("payload", "$.transcribed"), F.lit("false"))
    fetched = (F.col("provider") == provider) & (F.coalesce(F.col("provider_message_id"), F.lit("")) != "")
    return (
        F.when(~F.coalesce(F.lower("message_type").isin(*v.AUDIO_TYPES), F.lit(False)), "not_audio")
        .when(F.coalesce(F.col("text"), F.lit("")) != "", "already_has_text")
        .when(~marked.isin("false", "null", "", "0"), "already_transcribed")
        .when(~F.coalesce(fetched, F.lit(False)), "no_downloadable_media")
        .when(times.duration(F.col("payload")) > longest_s, "too_long")
    )


def media(spark: SparkSession, path: str, most_bytes: int = v.AUDIO_BYTES) -> DataFrame:
    """(file, length, content) of the files under ``path``; of those over ``most_bytes`` the content is null, and isn't read."""
    found = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", "content")
    return found.where(F.col("length") <= most_bytes).unionByName(found.where(F.col("length") > most_bytes).withColumn("content", F.lit(None).cast("binary")))


def transcribed(audio: DataFrame, call: Callable[[bytes, str], dict], model: str, prices: dict[str, str] | None = None, attempts: int = 3, at_once: int = 4, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """``audio`` (id, file, content, payload) with the outcome of writing each down, one row each, and what it is to be billed.

    ``call`` gets the bytes and the file's name, and gives ``text`` and perhaps ``duration_seconds``; it is called in tasks, ``at_once`` at a time, and
    again after an error that passes. status: done (``words``, which may be silence), failed, no_media (null content). Adds words, model,
    status, attempts, error, duration_seconds (as reported, else as the payload declares; null if neither says), billed_seconds (of what
    was done; by size where nobody knows the length) and cost. The bytes themselves aren't kept.
    """
    kept = [f for f in audio.schema if f.name != "content"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["_size long", "words string", "status string", "attempts int", "error string", "_reported double"])

    def one(content: bytes | None, name: str) -> tuple:
        if content is None:
            return 0, None, "no_media", 0, None, None
        error = None
        for tried in range(1, attempts + 1):
            try:
                answer = call(bytes(content), name)
            except TransientError as e:
                error = type(e).__name__
                if tried < attempts:
                    wait(backoff(tried - 1))
                continue
            except Exception as e:  # any other error is the outcome, and is reported as such
                return len(content), None, "failed", tried, type(e).__name__, None
            return len(content), answer.get("text") or "", "done", tried, None, answer.get("duration_seconds")
        return len(content), None, "failed", attempts, error, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([one(c, n) for c, n in zip(pdf["content"], pdf["file"], strict=True)], pdf.index, ["_size", "words", "status", "attempts", "error", "_reported"])
            yield pd.concat([pdf[[f.name for f in kept]], out.astype({"_reported": "float64"})], axis=1)

    done = audio.repartition(at_once).mapInPandas(run, schema)
    known = F.coalesce(F.when(F.col("_reported") > 0, F.col("_reported")), times.duration(F.col("payload")))
    billed = F.when(F.col("status") == "done", F.coalesce(known, money.audio_seconds(F.col("_size")))).otherwise(F.lit(0.0))
    found = done.withColumns({"model": F.lit(model), "duration_seconds": known, "billed_seconds": billed})
    return found.withColumn("cost", money.audio_cost(F.col("model"), F.col("billed_seconds"), prices)).drop("_size", "_reported")


def written_down(messages: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``messages`` with the words of ``transcripts`` (id, words, model, billed_seconds, duration_seconds) and a mark in their payload.

    Silence changes nothing, and neither does a transcript of a message that has text by now: the first one stands. Of several for one message
    the first by words counts.
    """
    said = transcripts.withColumn("words", F.btrim("words")).where("words <> ''")
    one = said.groupBy("id").agg(F.min(F.struct("words", "model", "billed_seconds", "duration_seconds")).alias("_t"))
    rows = messages.join(one, "id", "left")
    takes = F.col("_t").isNotNull() & F.col("text").isNull()
    meta = F.struct("_t.model", "_t.billed_seconds", "_t.duration_seconds", F.col("_t.duration_seconds").isNull().alias("duration_estimated"))
    mark = F.to_json(F.struct(F.lit(True).alias("transcribed"), meta.alias("transcription")), {"ignoreNullFields": "false"})
    new = {"text": F.when(takes, F.col("_t.words")).otherwise(F.col("text")), "payload": F.when(takes, nested.json_laid_over(F.coalesce("payload", F.lit("{}")), mark)).otherwise(F.col("payload"))}
    return rows.withColumns(new).select(*messages.columns)

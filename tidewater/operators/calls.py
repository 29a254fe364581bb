"""Calls to a model as a step of a job: rendered chunks go out from tasks, events and an audit row come back.

What answers is any function from a request to a response, so tests and offline runs pass one that needs no network. It is
called in tasks, once a chunk, with retries for errors that pass; a driver never holds requests or answers.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import money, nested
from tidewater.functions import vocabulary as v
from tidewater.operators import sequences
from tidewater.operators.pieces import placed
from tidewater.session import settled as settled_rows
from tidewater.sources.keyed import KeyedTable
from tidewater.sources.storage import VersionedTable

#: Levels of effort, from least to most.
EFFORTS = ("none", "low", "medium", "high", "xhigh")
SCHEMA = "status string, attempts int, output string, input_tokens long, cached_input_tokens long, output_tokens long, error string"


class TransientError(Exception):
    """An error that another try may not meet."""


def backoff(attempt: int, jitter: float = 0.0) -> float:
    return min(8.0, 0.75 * 2**attempt) + jitter


def notch_down(effort: str) -> str:
    return EFFORTS[max(0, EFFORTS.index(effort) - 1)]


def answered(call: Callable[[dict], dict], request: dict, attempts: int = 3, most_output: int = 16_000, wait: Callable[[float], None] = time.sleep) -> dict:
    """One request's outcome: completed, no more than ``attempts`` tries, one more with twice the room if the answer was cut off.

    status: completed, filtered (consumed, without events), too_large (to be halved), failed.
    """
    tried, error, widened = 0, None, False
    while tried < attempts:
        tried += 1
        try:
            response = call(request)
        except TransientError as e:
            error = type(e).__name__
            if tried < attempts:
                wait(backoff(tried - 1))
            continue
        except Exception as e:  # any other error is the caller's answer, and is audited as such
            return {"status": "failed", "attempts": tried, "error": type(e).__name__}
        used = {k: int(response.get(k) or 0) for k in ("input_tokens", "cached_input_tokens", "output_tokens")}
        if response.get("status") == "truncated":
            if widened:
                return used | {"status": "too_large", "attempts": tried}
            widened = True
            request = request | {"max_output": min(2 * request["max_output"], most_output), "effort": notch_down(request["effort"])}
            attempts = max(attempts, tried + 1)
            continue
        if response.get("status") == "filtered":
            return used | {"status": "filtered", "attempts": tried, "output": json.dumps({"events": []})}
        try:
            json.loads(response["output"])
        except (KeyError, TypeError, ValueError):
            return used | {"status": "failed", "attempts": tried, "error": "unreadable"}
        return used | {"status": "completed", "attempts": tried, "output": response["output"]}
    return {"status": "failed", "attempts": tried, "error": error}


def called(requests: DataFrame, call: Callable[[dict], dict], prompt: str = "prompt", max_output: int = 4000, effort: str = "low", at_once: int = 4) -> DataFrame:
    """``requests`` with the outcome of each. ``at_once`` calls run at a time, whatever the cluster's size."""
    columns = requests.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema] + [SCHEMA])
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [answered(call, {"prompt": p, "max_output": max_output, "effort": effort}) for p in pdf[prompt]]
            kinds = {"attempts": "int32"} | {k: "int64" for k in ("input_tokens", "cached_input_tokens", "output_tokens")}
            done = pd.DataFrame({k: pd.Series([o.get(k) or (0 if k in kinds else None) for o in out], pdf.index, kinds.get(k, object)) for k in names})
            yield pd.concat([pdf[columns], done], axis=1)

    return requests.repartition(at_once).mapInPandas(run, schema)


def called_down(chunks: DataFrame, by: list[str], render: Callable[[DataFrame], DataFrame], call: Callable[[dict], dict], settle: Callable[[DataFrame], DataFrame], least: int = 30, overlap: int = v.OVERLAP_ROWS, **options) -> DataFrame:
    """Outcomes of chunks (by, chunk_id, chunk_place and what ``render`` makes a ``prompt`` for each chunk of): those too large are asked again in halves.

    Rows of a chunk whose ``context`` is true may be read only, and have places of their own; without that column there are none. The first half
    of a chunk keeps its context, the second has the last ``overlap`` rows of the first. Halves of chunk "3" are "3.1" and "3.2"; chunks of
    ``least`` rows or fewer are left as they are, so it ends. Each round is ``settle``d (written), so that nobody is asked twice.
    """
    rest, found = chunks.withColumn("chunk_id", F.col("chunk_id").cast("string")), None
    if "context" not in rest.columns:
        rest = rest.withColumn("context", F.lit(False))
    while True:
        done = settle(called(render(rest), call, **options))
        sizes = rest.where("not context").groupBy(*by, "chunk_id").agg(F.max("chunk_place").alias("_n"))
        split = (F.col("status") == "too_large") & (F.col("_n") > least)
        judged = done.join(sizes, [*by, "chunk_id"])
        kept = judged.where(~split).drop("_n")
        found = kept if found is None else found.unionByName(kept)
        large = judged.where(split).select(*by, "chunk_id")
        if large.isEmpty():
            return found
        mine = rest.join(large, [*by, "chunk_id"], "left_semi")
        halves, tails = sequences.halved(mine.where("not context"), by, least, overlap)
        first = mine.where("context").withColumn("half", F.lit(1))
        second = tails.withColumns({"context": F.lit(True), "half": F.lit(2)})
        parts = halves.unionByName(first).unionByName(second)
        rest = settle(parts.withColumn("chunk_id", F.concat_ws(".", "chunk_id", F.col("half").cast("string"))).drop("half"))


def called_within(requests: DataFrame, by: list[str], number: str, call: Callable[[dict], dict], runs: KeyedTable, limit: str, model: str, prices: dict[str, tuple[str, str]], spent: DataFrame | None = None, monthly: str = "15", at_once: int = 4, **options) -> tuple[DataFrame, DataFrame]:
    """Outcomes of the requests of runs (by) that must not cost more than ``limit``, and the requests that were left, with ``reason``.

    A run's requests go ``at_once`` at a time in order of ``number``; what the audit in ``runs`` (a table by ``by`` and ``number``) says they cost
    decides whether the next ones go out: a run goes on until it has spent ``limit``, so it may go over by one round. Runs go side by side. A run whose
    ``spent`` (by, spent: what was spent before, by any run) has reached ``monthly`` isn't begun.

    Each round is in the audit, whole, before the next one begins. After a crash the same call goes on where the audit ends: only requests of the
    round that was lost are asked again. ``reason``: budget (not begun), spend_cap.
    """
    spark, key = requests.sparkSession, [*by, number]
    kept = [c for c in requests.columns if c not in key and c != "prompt"]
    cost = money.token_cost(F.lit(model), F.col("input_tokens"), F.col("cached_input_tokens"), F.col("output_tokens"), prices)
    shut = spark.createDataFrame([], requests.select(*by).schema) if spent is None else spent.where(F.col("spent") >= F.lit(monthly).cast("decimal(10,2)")).select(*by).distinct()
    # A round asks a bounded number of requests of each run; ``settled`` calls are made once, however often they are read.
    while True:
        audit = runs.read()
        waiting = requests.join(shut, by, "left_anti")
        if audit is not None:
            over = audit.groupBy(*by).agg(F.sum("cost").alias("_c")).where(F.col("_c") >= F.lit(limit).cast("decimal(12,6)")).select(*by)
            waiting = waiting.join(audit.select(*key), key, "left_anti").join(over, by, "left_anti")
        turn = waiting.withColumn("_turn", F.row_number().over(Window.partitionBy(*by).orderBy(number))).where(F.col("_turn") <= at_once).drop("_turn")
        if turn.isEmpty():
            break
        done = settled_rows(called(turn, call, at_once=at_once, **options))
        runs.put(done.select(*key, *kept, F.lit(model).alias("model"), "status", "attempts", "output", "input_tokens", "cached_input_tokens", "output_tokens", cost.alias("cost"), "error"))
    left = requests if audit is None else requests.join(audit.select(*key), key, "left_anti")
    begun = left.join(shut.withColumn("_shut", F.lit(True)), by, "left")
    return runs.read(), begun.withColumn("reason", F.when(F.col("_shut"), "budget").otherwise("spend_cap")).drop("_shut")


def audited(outcomes: DataFrame, runs: VersionedTable, by: list[str], purpose: str, model: str, prices: dict[str, tuple[str, str]]) -> DataFrame:
    """The audit rows of calls (by, purpose, status, attempts, tokens, cost, error), added to ``runs``, whatever became of the calls."""
    cost = money.token_cost(F.lit(model), F.col("input_tokens"), F.col("cached_input_tokens"), F.col("output_tokens"), prices)
    rows = outcomes.select(*by, F.lit(purpose).alias("purpose"), F.lit(model).alias("model"), "status", "attempts", "input_tokens", "cached_input_tokens", "output_tokens", cost.alias("cost"), "error")
    runs.append(rows)
    return runs.read()


def prompts(transcripts: DataFrame, brief: str, instructions: str) -> DataFrame:
    """``transcripts`` (chunk columns, transcript) with ``prompt``."""
    return transcripts.withColumn("prompt", F.concat_ws("\n\n", F.lit(instructions), F.lit(brief), F.col("transcript")))


def events_of(outcomes: DataFrame, by: list[str], schema: str) -> DataFrame:
    """(by, event_no, fields): the events that completed answers hold. ``schema`` is an event's, as a DDL struct."""
    found = outcomes.where("status = 'completed'").select(*by, F.from_json("output", f"events array<struct<{schema}>>").alias("o"))
    return found.select(*by, F.posexplode("o.events").alias("event_no", "e")).select(*by, F.col("event_no").cast("long"), "e.*")


def guarded(requests: DataFrame, spent: DataFrame, tenant: str, estimate: str, limit: str = "15") -> DataFrame:
    """``requests`` with ``allowed``: those of a tenant that has spent its limit, or would with the requests before, are to be refused.

    ``spent``: tenant and spent. Requests of a tenant go in order of ``request_no``, each counted by its ``estimate``.
    """
    before = F.sum(estimate).over(Window.partitionBy(tenant).orderBy("request_no").rowsBetween(Window.unboundedPreceding, -1))
    rows = requests.join(spent.select(tenant, "spent"), tenant, "left")
    return rows.withColumn("allowed", F.coalesce("spent", F.lit(0)) + F.coalesce(before, F.lit(0)) < F.lit(limit).cast("decimal(10,2)")).drop("spent")


def record(outcomes: DataFrame, order: list[Column], path: str) -> DataFrame:
    """(number, response) of calls that were made, written to ``path``: their outputs under their numbers (from 1) in ``order``, for replays.

    Calls without output have a null response, so the others keep their numbers. Nothing is written over.
    """
    numbered = placed(outcomes, [], order, "_number")
    numbered.select((F.col("_number") + 1).alias("number"), F.col("output").alias("response")).write.parquet(f"{path}/recorded")
    return outcomes.sparkSession.read.schema("number long, response string").parquet(f"{path}/recorded")


def replayed(requests: DataFrame, recorded: DataFrame, order: list[Column]) -> DataFrame:
    """``requests`` with the ``response`` recorded under their number (from 1), in ``order``; null beyond the last. For runs that call nobody.

    Rows are numbered by ranges of ``order`` (``placed``), so a long run is no single task.
    """
    numbered = placed(requests, [], order, "_number").withColumn("number", F.col("_number") + 1).drop("_number")
    return numbered.join(recorded.select(F.col("number").cast("long").alias("number"), "response"), "number", "left")


def recorded(spark, path: str) -> DataFrame:
    """(number, response): the files NNN.json of a recorded run."""
    found = spark.read.option("wholetext", True).text(path)
    return found.select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json$", 1).cast("long").alias("number"), F.col("value").alias("response"))


def settled(pairs: DataFrame, call: Callable[[dict], dict], instructions: str, at_once: int = 4) -> DataFrame:
    """``pairs`` (existing and incoming: structs of events) with ``separate`` and ``merged``: what a model makes of two mentions that differ.

    A merged event whose body begins by saying that they differ leaves both as they are. What they cite is put together from the two, never
    taken from the answer; an answer that can't be read leaves the pair separate.
    """
    asked = F.concat(F.lit(instructions), F.lit("\n<existing>"), F.to_json("existing"), F.lit("</existing>\n<new>"), F.to_json("incoming"), F.lit("</new>"))
    kind = pairs.schema["existing"].dataType
    done = called(pairs.withColumn("prompt", asked), call, at_once=at_once)
    answer = F.from_json("output", kind)
    differ = F.upper(F.ltrim(F.coalesce(answer["body"], F.lit("")))).startswith(v.DIFFERENT)
    apart = (F.col("status") != "completed") | answer.isNull() | differ
    union = lambda f: nested.ordered_union(F.col(f"existing.{f}"), F.col(f"incoming.{f}"))
    fields = [union(f.name).alias(f.name) if f.name in ("quotes", "source_message_handles") else answer[f.name].alias(f.name) for f in kind]
    return done.select(*pairs.columns, apart.alias("separate"), F.when(~apart, F.struct(*fields)).alias("merged"))


def strict(schema):
    """A JSON schema as strict output wants it: no defaults, nothing but the properties named, and all of them required."""
    if isinstance(schema, list):
        return [strict(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: strict(x) for k, x in schema.items() if k != "default"}
    return out | ({"additionalProperties": False, "required": list(out.get("properties", {}))} if out.get("type") == "object" else {})

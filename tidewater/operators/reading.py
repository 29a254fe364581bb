"""What is read back: feeds, open items, rollups and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import times
from tidewater.functions import vocabulary as v


def live(rows: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    """``rows`` without those that carry a mark of deletion, which stays in the table for its key. Tables without such a mark pass whole."""
    return rows.where(F.col(deleted).isNull()) if deleted in rows.columns else rows


def feed(events: DataFrame, at: str, event_id: str, limit: int, before: Column | None = None) -> DataFrame:
    """The newest ``limit`` events that aren't deleted, before a moment if one is given. Only the top rows of each task are shuffled."""
    rows = live(events) if before is None else live(events).where(F.col(at) < before)
    return rows.orderBy(F.col(at).desc_nulls_first(), F.col(event_id).desc()).limit(limit)


def upcoming(events: DataFrame, at: str, event_id: str, now: Column, limit: int = 50) -> DataFrame:
    return live(events).where(F.col(at) > now).orderBy(F.col(at).asc_nulls_last(), F.col(event_id).asc()).limit(limit)


def next_before(page: DataFrame, at: str, limit: int) -> DataFrame:
    """The page with the moment from which the next one goes on; null on a page that isn't full."""
    last = page.agg(F.when(F.count("*") == limit, F.min(at)).alias("next_before"))
    return page.crossJoin(F.broadcast(last))  # a page has a limit, and the other side one row


def newest(rows: DataFrame, by: list[str], order: list[Column], n: int, oldest_first: list[Column] | None = None) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, numbered by ``place`` from 1 (in ``oldest_first`` order, if given)."""
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*oldest_first))) if oldest_first else top


def rollup(people: DataFrame, messages: DataFrame, on: Column, by: list[str], at: str, created: str | None = None) -> DataFrame:
    """``by`` with n_messages, first_at and last_at; people who never wrote count zero (and were last seen when ``created``)."""
    found = people.join(messages, on, "left").groupBy(*by, *([created] if created and created not in by else [])).agg(
        F.count(at).alias("n_messages"), F.min(at).alias("first_at"), F.max(at).alias("last_at")
    )
    return found.withColumn("last_at", F.coalesce("last_at", created)) if created else found


def due(pending: DataFrame, tenant: str, at: str, now: Column, count: int = v.GATE_COUNT, age_s: int = v.GATE_AGE_S) -> DataFrame:
    """Tenants with enough rows waiting, or with one that waits long enough."""
    sums = pending.groupBy(tenant).agg(F.count("*").alias("waiting"), F.min(at).alias("oldest"))
    return sums.where((F.col("waiting") >= count) | (F.col("oldest") < now - F.expr(f"interval {age_s} seconds")))


def in_run_order(events: DataFrame, by: list[str], at: str = "occurred_at_utc", key: str = "dedup_key") -> DataFrame:
    """``events`` with ``place`` from 1: by time, those without one last, then by key."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(at).asc_nulls_last(), F.col(key))))


def open_digest(events: DataFrame, by: list[str], n: int = 10) -> DataFrame:
    """(by, digest): a line for each of the first ``n`` open events, dated ones first, the newest of them first.

    ``events`` has kind, occurred_at (text; "undated": none), title, detail. Of equal dates, by title.
    """
    dated = F.col("occurred_at") != "undated"
    top = newest(events, by, [dated.desc(), F.desc("occurred_at"), F.col("title"), F.col("kind"), F.col("detail")], n)
    line = F.concat(F.lit("[E"), F.col("place").cast("string"), F.lit("] "), F.concat_ws(" ", "kind", "occurred_at", "title"), F.coalesce(F.concat(F.lit(" — "), F.nullif("detail", F.lit(""))), F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))  # ``n`` at most
    return top.groupBy(*by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("digest"))


def day_runs(events: DataFrame, by: list[str], day: Column, order: list[Column]) -> DataFrame:
    """(by, run, day, n, first and last place): consecutive events of one day, in ``order``."""
    ahead = Window.partitionBy(*by).orderBy(*order)
    rows = events.select(*by, day.alias("day"), F.row_number().over(ahead).alias("place"), F.lag(day).over(ahead).alias("_was"))
    rows = rows.withColumn("run", F.sum(F.when(F.col("day").eqNullSafe(F.col("_was")) & (F.col("place") > 1), 0).otherwise(1)).over(Window.partitionBy(*by).orderBy("place")))
    return rows.groupBy(*by, "run", "day").agg(F.count("*").alias("n"), F.min("place").alias("first_place"), F.max("place").alias("last_place"))


def latest_per_key(events: DataFrame, by: list[str], key: Column, order: list[Column], keep: Column | None = None, n: int = 5) -> DataFrame:
    """The newest row of each key of a group, then those to ``keep``, then the first ``n`` of the group."""
    newest_ = events.withColumn("key", key).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "key").orderBy(*order))).where("_r = 1").drop("_r")
    kept = newest_ if keep is None else newest_.where(keep)
    return newest(kept, by, order, n)


def ambiguous(people: DataFrame, by: list[str], name: Column) -> DataFrame:
    """Folded names that several people of a group have."""
    return people.groupBy(*by, name.alias("name")).agg(F.count("*").alias("n")).where("n > 1 and name is not null")


def actors(events: DataFrame, people: DataFrame, by: list[str], event_id: str, names: str, person: str, name: Column, fold) -> DataFrame:
    """(by, event_id, person): for each event the first of its named actors who can only be one person."""
    sure = people.groupBy(*by, name.alias("_name")).agg(F.count("*").alias("_n"), F.min(person).alias(person)).where("_n = 1 and _name is not null").drop("_n")
    each = events.select(*by, event_id, F.posexplode(names).alias("_i", "_actor")).withColumn("_name", fold(F.col("_actor")))
    return each.join(sure, [*by, "_name"]).groupBy(*by, event_id).agg(F.min_by(person, "_i").alias(person))


def roster(people: DataFrame, by: list[str], name: str) -> DataFrame:
    """The names of a group in one line; "unknown" if it has none."""
    listed = F.array_join(F.sort_array(F.collect_list(F.nullif(F.trim(F.col(name)), F.lit("")))), ", ")
    return people.groupBy(*by).agg(F.coalesce(F.nullif(listed, F.lit("")), F.lit("unknown")).alias("names"))


def report(events: DataFrame, by: list[str], order: list[Column], limit: int = 200) -> DataFrame:
    """A section for each kind of each group: heading, sentences with their citations, and how many there are.

    ``events`` has event_id, kind, occurred_at (text), title, body. Events are numbered E1, E2, … over all kinds in ``order``,
    up to ``limit``. Nothing is inferred: each sentence is an event's own words.
    """
    rows = newest(live(events), by, order, limit).withColumn("handle", F.concat(F.lit("E"), F.col("place").cast("string")))
    body = F.when(F.coalesce(F.col("body"), F.lit("")) != "", F.concat(F.lit(": "), F.trim("body"))).otherwise("")
    sentence = F.concat("title", body, F.lit(" ["), "handle", F.lit("]"))
    cited = F.struct("place", "handle", "event_id", "kind", "occurred_at", "title", sentence.alias("sentence"))
    names = F.create_map(*[F.lit(x) for pair in v.SECTIONS.items() for x in pair])
    found = rows.groupBy(*by, "kind").agg(F.array_sort(F.collect_list(cited)).alias("c"))
    return found.select(
        *by,
        "kind",
        F.coalesce(F.element_at(names, F.col("kind")), F.col("kind")).alias("heading"),
        F.size("c").cast("long").alias("n"),
        F.array_join(F.transform("c", lambda c: c["sentence"]), " ").alias("body_markdown"),
        F.transform("c", lambda c: c["handle"]).alias("handles"),
        F.slice(F.array_distinct(F.transform("c", lambda c: c["title"])), 1, 5).alias("titles"),
    )


def summary(sections: DataFrame, by: list[str]) -> DataFrame:
    """A line for each group that counts its events by kind, what to watch, and what is missing."""
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    sums = sections.groupBy(*by).agg(F.sum("n").alias("_all"), *[n(k).alias(k) for k in v.KINDS], F.first(F.when(F.col("kind") == "symptom", F.col("titles")), ignorenulls=True).alias("watch_items"))
    text = F.concat(
        F.lit("This summary covers "), F.col("_all"), F.lit(" recorded care events: "), F.col("symptom"), F.lit(" symptom updates, "),
        F.col("appointment"), F.lit(" appointments, "), F.col("medication"), F.lit(" medication updates and "), F.col("note"), F.lit(" care notes."),
    )
    gaps = F.array(
        F.when(F.col("appointment") == 0, "No appointments were recorded during this period."), F.when(F.col("medication") == 0, "No medication updates were recorded during this period.")
    )
    return sums.select(*by, text.alias("summary"), F.coalesce("watch_items", F.array().cast("array<string>")).alias("watch_items"), F.array_compact(gaps).alias("data_gaps"))


def spend(calls: DataFrame, tenant: str, at: str, cost: str, now: Column, days: int = 30, limit: str = "15") -> DataFrame:
    """What each tenant spent in the last ``days``, and whether that ends its budget."""
    recent = (F.col(at) > now - F.expr(f"interval {days} days")) & (F.col(at) <= now)
    sums = calls.groupBy(tenant).agg(F.coalesce(F.sum(F.when(recent, F.col(cost))), F.lit(0)).alias("spent"))
    return sums.withColumn("refused", F.col("spent") >= F.lit(limit).cast("decimal(10,2)"))


def spend_ceiling(chunks: DataFrame, by: list[str], order: list[Column], cost: str, cap: Column, at_once: int = 4) -> DataFrame:
    """``chunks`` with ``processed``: they go in batches of ``at_once``, and none starts once the batches before cost the cap."""
    ahead = Window.partitionBy(*by).orderBy(*order)
    rows = chunks.withColumn("batch", F.floor((F.row_number().over(ahead) - 1) / at_once).cast("long"))
    before = F.sum(cost).over(Window.partitionBy(*by).orderBy("batch").rangeBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("processed", F.coalesce(before, F.lit(0)) < cap)


def run_totals(chunks: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sums of runs (tokens, cost, handles and the share that is invalid), and their dropped events by reason.

    ``chunks`` has input_tokens, output_tokens, cost, handles_cited, invalid_handles, and ``drops`` (reason to count).
    """
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cost", "handles_cited", "invalid_handles")]
    totals = chunks.groupBy(*by).agg(F.count("*").alias("chunks"), *sums)
    totals = totals.withColumn("invalid_rate", F.coalesce(F.try_divide("invalid_handles", "handles_cited"), F.lit(0.0)))
    drops = chunks.select(*by, F.explode("drops").alias("reason", "n")).groupBy(*by, "reason").agg(F.sum("n").alias("n"))
    return totals, drops


def awaiting_transcription(now: Column, on: bool = True, provider: str = "gateway", grace_s: int = v.TRANSCRIPTION_GRACE_S) -> Column:
    """True for a voice note whose words may still come. Columns: message_type, provider, provider_message_id, payload, ingested_at."""
    from tidewater.functions.nested import json_has

    if not on:
        return F.lit(False)
    return (
        F.col("message_type").isin("audio", "voice")
        & (F.col("provider") == provider)
        & F.col("provider_message_id").isNotNull()
        & ~json_has(F.col("payload"), "transcribed")
        & (F.col("ingested_at") > now - F.expr(f"interval {grace_s} seconds"))
    )


def pending(messages: DataFrame, now: Column, transcribing: bool = True) -> DataFrame:
    """Messages that nothing has been extracted from yet, but for system lines and notes whose words may still come."""
    return messages.where(F.col("extracted_at").isNull() & (F.col("message_type") != "system") & ~F.coalesce(awaiting_transcription(now, transcribing), F.lit(False)))


def as_json(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """(body): a JSON object for each row, of the columns that ``names`` maps to keys; instants in ISO form, nulls as null."""
    kinds = dict(rows.dtypes)
    value = lambda c: times.iso(F.col(c)) if kinds[c] == "timestamp" else F.col(c)
    return rows.select(F.to_json(F.struct(*[value(c).alias(key) for c, key in names.items()]), {"ignoreNullFields": "false"}).alias("body"))

"""Chat exports: text files of stamped lines, read and parsed as one job over any number of files of any size.

A file is read in the blocks that Spark splits it into, each in a task of its own. A first pass counts lines and starts by block; their sums
over the blocks before number a block's lines and records. What is open where a block ends (the record that goes on, and how long it is by
then) is summed up the same way, so no step sorts or gathers a file.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewater.functions import text as x
from tidewater.functions import vocabulary as v


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, raw): the lines of text files; ``at`` has the block of the file that a line was read in, and its row in it."""
    lines = spark.read.option("lineSep", "\n").text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.col("value").alias("raw"))


def stamped(line: Column) -> Column:
    """(stamp, rest, style) of a line that begins a message; null for any other. The line itself is searched once."""
    whole = F.regexp_extract(line, v.START, 0)
    bracket = F.startswith(whole, F.lit("["))
    stamp = F.trim(F.when(bracket, F.substring_index(F.substring(whole, 2, 48), "]", 1)).otherwise(F.regexp_replace(whole, r"\s-\s$", "")))
    rest = F.substring(line, F.char_length(whole) + 1, F.char_length(line))
    return F.when(stamp.rlike(v.CLOCK), F.struct(stamp.alias("stamp"), rest.alias("rest"), F.when(bracket, "ios").otherwise("android").alias("style")))


def limits(lines: DataFrame, most_bytes: int = v.EXPORT_BYTES, most_messages: int = v.EXPORT_MESSAGES) -> DataFrame:
    """(file, n_bytes, n_messages, refusal): what a file holds, line ends included, and why it is refused ("bytes" or "messages"; null: it isn't)."""
    start = stamped(x.visible(F.regexp_replace("raw", r"[\r\n]+$", ""))).isNotNull()
    sums = lines.groupBy("file").agg(F.sum(F.octet_length("raw") + 1).alias("n_bytes"), F.count_if(start).alias("n_messages"))
    return sums.withColumn("refusal", F.when(F.col("n_bytes") > most_bytes, "bytes").when(F.col("n_messages") > most_messages, "messages"))


def classified(lines: DataFrame) -> DataFrame:
    """``lines`` (file, at, raw) with ``block``, ``n`` (from 1), ``start`` (as ``stamped``), ``record`` (from 1; 0 before the first) and
    ``kind``: start, continuation or unparsed.

    Where ``at`` is a struct of block and row, a file's blocks are numbered each by itself, after what those before it hold; any other ``at`` only
    orders a file's lines, which are one block then.
    """
    kind = lines.schema["at"].dataType
    split = isinstance(kind, T.StructType) and kind.fieldNames()[:1] == ["block"]
    raw = F.replace(F.regexp_replace("raw", r"[\r\n]+$", ""), F.lit("\x00"), F.lit(""))
    rows = lines.select("file", (F.col("at.block") if split else F.lit(0)).cast("long").alias("block"), "at", raw.alias("raw")).withColumn("line", x.visible(F.col("raw")))
    rows = rows.withColumn("start", stamped(F.col("line")))
    order = Window.partitionBy("file", "block").orderBy("at")
    rows = rows.select("*", F.row_number().over(order).alias("n"), F.count("start").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("record")).drop("at")
    if split:
        before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over blocks, not lines
        sums = rows.groupBy("file", "block").agg(F.max("n").alias("_n"), F.max("record").alias("_r"))
        sums = sums.select("file", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_r")])
        rows = rows.join(sums, ["file", "block"]).withColumns({"n": F.col("n") + F.col("_n"), "record": F.col("record") + F.col("_r")}).drop("_n", "_r")
    kind = F.when(F.col("start").isNotNull(), "start").when((F.col("record") == 0) | F.col("line").rlike(v.NEAR_START), "unparsed").otherwise("continuation")
    return rows.withColumn("kind", kind)


def _ends(rows: DataFrame, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with ``_end``: how many characters (``_size``) a line's record has with it, if it has over a body's limit in all; else 0.

    A record that goes on over blocks brings what those before have of it. Only the lines of records that are too long are looked at one by one.
    """
    sums = rows.groupBy("file", "record").agg(F.sum("_size").alias("_sum")).where((F.col("record") > 0) & (F.col("_sum") > v.BODY_CHARS))
    if sums.isEmpty():
        return rows.withColumn("_end", F.lit(0).cast("long"))
    marked = rows.join(settle(sums.select("file", "record", F.lit(True).alias("_large"))), ["file", "record"], "left")
    some = marked.where("_large")
    some = some.withColumn("_end", F.sum("_size").over(Window.partitionBy("file", "block", "record").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("file", "record").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over blocks, not lines
    sums = some.groupBy("file", "record", "block").agg(F.sum("_size").alias("_s"))
    carried = sums.select("file", "record", "block", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_carry"))
    some = some.join(carried, ["file", "record", "block"]).withColumn("_end", F.col("_end") + F.col("_carry"))
    short = marked.where("_large is null").withColumn("_end", F.lit(0).cast("long"))
    return short.drop("_large").unionByName(some.drop("_large", "_carry"))


def sniff(lines: DataFrame, first: int = v.SNIFF_LINES) -> DataFrame:
    """A row for each file of what its first lines suggest: dayfirst, evidence, style, is_12h, has_seconds, samples. Nothing is decided here."""
    found = classified(lines).where((F.col("kind") == "start") & (F.col("n") <= first)).select("file", "n", "start.*")
    one, two, short = _parts(F.col("stamp"))
    over = lambda c: F.coalesce(F.max(F.when(short, c > 12)), F.lit(False))
    head = F.min(F.struct("n", "stamp", "style"))
    sums = found.groupBy("file").agg(
        over(one).alias("_first"), over(two).alias("_second"), head.alias("_head"), F.slice(F.array_sort(F.collect_set(F.struct("n", "stamp"))), 1, v.PREVIEW).alias("_samples")
    )
    clock = F.coalesce(F.nullif(F.trim(F.regexp_extract("_head.stamp", ",(.*)$", 1)), F.lit("")), F.col("_head.stamp"))
    proof = evidence(F.col("_first"), F.col("_second"))
    return sums.select(
        "file",
        (proof != "month>12").alias("dayfirst"),
        proof.alias("evidence"),
        F.col("_head.style").alias("style"),
        clock.rlike(v.MERIDIEM).alias("is_12h"),
        (F.regexp_count(clock, F.lit(":")) >= 2).alias("has_seconds"),
        F.transform("_samples", lambda s: s["stamp"]).alias("samples"),
    )


def _parts(stamp: Column) -> tuple[Column, Column, Column]:
    """The first two numbers of a date, and whether they tell day from month (a leading year doesn't)."""
    parts = F.split(F.trim(F.substring_index(stamp, ",", 1)), r"[/.\-]")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return first.try_cast("int"), second.try_cast("int"), first.rlike(r"^\d{1,3}$") & second.rlike(r"^\d+$")


def evidence(first_over: Column, second_over: Column) -> Column:
    """Which number of the dates is the day, for certain."""
    return F.when(first_over & second_over, "conflict").when(first_over, "day>12").when(second_over, "month>12").otherwise("none")


def stamp_format(stamp: Column, dayfirst: bool) -> Column:
    """The one date pattern that a stamp's shape and the chosen order of day and month allow."""
    comma = stamp.contains(",")
    date = F.trim(F.when(comma, F.substring_index(stamp, ",", 1)).otherwise(F.substring_index(stamp, " ", 1)))
    clock = F.trim(F.when(comma, F.regexp_extract(stamp, ",(.*)$", 1)).otherwise(F.regexp_extract(stamp, " (.*)$", 1)))
    between = F.when(date.contains("/"), "/").when(date.contains("."), ".").when(date.contains("-"), "-").otherwise("/")
    parts = F.split(date, r"[/.\-]")
    year = F.when(F.length(F.element_at(parts, -1)) == 4, "yyyy").otherwise("yy")
    one, two = ("d", "M") if dayfirst else ("M", "d")
    day = F.when(F.length(F.get(parts, F.lit(0))) == 4, F.concat_ws("", F.lit("yyyy"), between, F.lit("M"), between, F.lit("d"))).otherwise(
        F.concat_ws("", F.lit(one), between, F.lit(two), between, year)
    )
    seconds = F.when(F.regexp_count(clock, F.lit(":")) >= 2, ":ss").otherwise("")
    time = F.when(clock.rlike(v.MERIDIEM), F.concat(F.lit("h:mm"), seconds, F.lit(" a"))).otherwise(F.concat(F.lit("H:mm"), seconds))
    return F.concat(day, F.when(comma, ", ").otherwise(" "), time)


def _straggler(dayfirst: bool):
    @F.pandas_udf(T.StringType())
    def parse(stamp: pd.Series) -> pd.Series:
        """What a lenient parser makes of the few stamps that a file's format doesn't fit."""
        from dateutil import parser

        def each(text):
            try:
                return parser.parse(text, dayfirst=dayfirst, fuzzy=False).replace(tzinfo=None).isoformat(sep=" ") if isinstance(text, str) else None
            except (ValueError, OverflowError):
                return None

        return stamp.map(each)

    return parse


def parse(lines: DataFrame, zone: str, dayfirst: bool, settle: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """Messages and classified lines of exports. ``lines`` as ``read_lines`` gives them; no default guesses zone or day order.

    Messages: file, source_ordinal (from 0), n (line), sent_at (UTC), sender_display_name, text, message_type, system_kind, filename,
    mime_hint, body, raw, truncated, n_lines. Lines: as ``classified``, with the kind that each has in the end: those of a
    message whose stamp can't be read, and those beyond a body's limit, are unparsed.
    Work on lines is dealt out by block of a file, on messages by message. An empty input gives empty outputs. ``settle`` may write
    what several steps need and read it again, so that it is worked out once.
    """
    rows = classified(lines)
    rest = F.col("start.rest")
    named = rest.rlike(v.SENDER)
    sender = F.when(named, F.nullif(F.trim(F.regexp_replace(F.regexp_extract(rest, v.SENDER, 1), "^~+", "")), F.lit("")))
    body = F.when(named, F.substring(rest, F.char_length(F.regexp_extract(rest, v.SENDER, 0)) + 1, F.char_length(rest))).otherwise(rest)
    size = F.when(F.col("kind") == "start", F.char_length(body)).when(F.col("kind") == "continuation", F.char_length("line") + 1).otherwise(0)
    rows = rows.withColumns({"_sender": F.when(F.col("kind") == "start", sender), "_piece": F.when(F.col("kind") == "start", body).otherwise(F.col("line")), "_size": size})
    rows = _ends(settle(rows), settle)
    over = (F.col("kind") == "continuation") & (F.col("_end") > v.BODY_CHARS)
    rows = rows.withColumn("_over", over).withColumn("kind", F.when(over, "unparsed").otherwise(F.col("kind"))).withColumn("_joined", F.col("_over") | (F.col("kind") != "unparsed"))
    starts = rows.where("kind = 'start'").select("file", "record", "n", "start.stamp", "start.style", F.col("_sender").alias("sender"))
    piece = F.struct("n", F.col("_piece").alias("piece"), "raw", (F.col("kind") != "unparsed").alias("own"))
    # Lines that begin beyond the limit add nothing, however many follow.
    bodies = rows.where((F.col("record") > 0) & F.col("_joined") & (F.col("_end") - F.col("_size") <= v.BODY_CHARS)).groupBy("file", "record").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.max("_over").alias("_over"))
    whole = F.array_join(F.transform("p", lambda q: q["piece"]), "\n")
    own = F.transform(F.filter("p", lambda q: q["own"]), lambda q: q["raw"])
    bodies = bodies.select(
        "file",
        "record",
        F.left(whole, F.lit(v.BODY_CHARS)).alias("body"),
        F.array_join(own, "\n").alias("raw"),
        F.size(own).alias("n_lines"),
        (F.char_length(whole) > v.BODY_CHARS).alias("truncated"),
    )
    # A file's format: the first shape among its first stamps that reads all of them, else the first shape.
    shaped = starts.where(F.col("record") <= v.FORMAT_SAMPLE).select("file", F.struct("record", "stamp", stamp_format(F.col("stamp"), dayfirst).alias("format")).alias("s"))
    samples = shaped.groupBy("file").agg(F.array_sort(F.collect_list("s")).alias("s"))
    shapes, stamps = F.array_distinct(F.transform("s", lambda s: s["format"])), F.transform("s", lambda s: s["stamp"])
    samples = samples.select("file", shapes.alias("shapes"), stamps.alias("stamps"))
    tried = samples.select("file", F.posexplode("shapes").alias("i", "format"), "stamps")
    fits = F.forall("stamps", lambda s: F.try_to_timestamp(s, F.col("format")).isNotNull())
    best = tried.groupBy("file").agg(F.min(F.struct((~fits).alias("bad"), "i", "format")).alias("b")).select("file", F.col("b.format").alias("format"))
    found = starts.join(bodies, ["file", "record"]).join(best, "file")
    strict = F.try_to_timestamp(F.col("stamp"), F.col("format"))
    lenient = _straggler(dayfirst)(F.when(strict.isNull(), F.col("stamp"))).try_cast("timestamp")
    found = found.withColumn("sent_at", F.to_utc_timestamp(F.coalesce(strict, lenient), zone))
    good = found.where("sent_at is not null").withColumn("system_kind", x.system_kind(F.col("body"), F.col("sender")))
    good = good.withColumn("m", F.when(F.col("system_kind").isNull(), x.media(F.col("body"))))
    text = F.when(F.col("m").isNotNull(), F.nullif(F.col("m.caption"), F.lit(""))).otherwise(F.col("body"))
    messages = good.select(
        "file",
        (F.col("record") - 1).cast("int").alias("source_ordinal"),
        "n",
        "sent_at",
        F.col("sender").alias("sender_display_name"),
        text.alias("text"),
        F.when(F.col("system_kind").isNotNull(), "system").otherwise(F.coalesce("m.type", F.lit("text"))).alias("message_type"),
        "system_kind",
        F.col("m.filename").alias("filename"),
        F.col("m.mime").alias("mime_hint"),
        "body",
        "raw",
        "truncated",
        "n_lines",
    )
    lost = found.where("sent_at is null").select("file", "record", F.lit(True).alias("lost"))
    kept = rows.select("file", "n", "record", "raw", "line", "kind").join(lost, ["file", "record"], "left")
    return messages, kept.withColumn("kind", F.when(F.col("lost"), "unparsed").otherwise(F.col("kind"))).drop("lost")


def report(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """A row for each file: how its lines were used, who spoke, when, and the first and last messages of people.

    messages + continuations + system_lines + unparsed_lines = total_lines.
    """
    count = lambda kind: F.count_if(F.col("kind") == kind)
    by_line = lines.groupBy("file").agg(F.count("*").alias("total_lines"), count("continuation").alias("continuations"), count("unparsed").alias("unparsed_lines"))
    human = F.col("message_type") != "system"
    by_message = messages.groupBy("file").agg(
        F.count_if(human).alias("messages"),
        F.count_if(~human).alias("system_lines"),
        F.count_if(human & (F.col("message_type") != "text")).alias("media_placeholders"),
        F.min("sent_at").alias("first_sent_at"),
        F.max("sent_at").alias("last_sent_at"),
    )

    def few(rows: DataFrame, order: Column, at: str, value: str, most: int, name: str) -> DataFrame:
        """The first ``most`` of each file: tasks hand on no more than that."""
        ranked = rows.select("file", at, value, F.row_number().over(Window.partitionBy("file").orderBy(order)).alias("_k")).where(F.col("_k") <= most)
        return ranked.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda s: s[value]).alias(name))

    some = [
        few(lines.where("kind = 'unparsed'"), F.col("n"), "n", "line", v.UNPARSED_SAMPLES, "unparsed_samples"),
        few(messages.where(human), F.col("source_ordinal"), "source_ordinal", "body", v.PREVIEW, "preview_head"),
        few(messages.where(human), F.desc("source_ordinal"), "source_ordinal", "body", v.PREVIEW, "preview_tail"),
    ]
    said = messages.where(human & F.col("sender_display_name").isNotNull()).groupBy("file", "sender_display_name").count()
    senders = said.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("sender_display_name", "count"))).alias("senders"))
    zero = {c: 0 for c in ("messages", "system_lines", "media_placeholders")}
    found = by_line.join(by_message, "file", "left").join(senders, "file", "left").fillna(zero)
    for each in some:
        name = each.columns[-1]
        found = found.join(each, "file", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return found

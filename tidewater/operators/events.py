"""Extracted events: what their evidence supports, which are the same, and what becomes of them together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import nested, times
from tidewater.functions import text as x
from tidewater.functions import vocabulary as v
from tidewater.operators.graphs import components
from tidewater.operators.pieces import PIECE, matched, parted, placed
from tidewater.operators.sequences import in_order
from tidewater.session import settled

NOTHING = "array<string>"


def grounded(events: DataFrame, primary: DataFrame, context: DataFrame, by: list[str], zone: str, days: int = v.WINDOW_DAYS, run: list[str] | None = None) -> DataFrame:
    """``events`` with ``drop_reason`` (null: kept), what is left of handles and quotes, ``occurred_at_utc`` and ``excerpts``.

    An event needs a handle of a ``primary`` message of its chunk; a quote must stand in the messages cited (folded); an event all
    of whose quotes were invented goes, and so does one dated over ``days`` outside its run. ``events``: by (the chunk), event_no,
    source_message_handles, quotes, occurred_at, occurred_at_precision. ``primary`` and ``context``: by, handle, id, sent_at, sender, text.
    ``run`` are the columns of ``by`` that tell runs apart: all but the last unless given; without any, all is one run.
    """
    key, run = [*by, "event_no"], by[:-1] if run is None else run
    cited = events.select(*key, F.posexplode("source_message_handles").alias("_i", "handle"))
    own = primary.select(*by, "handle", F.struct("id", "sent_at", "sender", x.fold(F.col("text")).alias("folded")).alias("m"))
    met = cited.join(own, [*by, "handle"], "left").join(context.select(*by, "handle", F.lit(True).alias("_c")).distinct(), [*by, "handle"], "left")
    source = F.when(F.col("m").isNotNull(), F.struct("_i", "handle", "m"))
    found = met.groupBy(*key).agg(
        F.array_sort(F.collect_list(source)).alias("_s"), F.count("*").alias("handles_cited"), F.count_if(F.col("m").isNull()).alias("invalid_handles"), F.bool_and(F.coalesce("_c", F.lit(False))).alias("_context")
    )
    ends = F.min("sent_at").alias("_low"), F.max("sent_at").alias("_high")
    rows = events.withColumn("_q", x.fold_each(F.col("quotes"))).join(found, key, "left")
    rows = rows.join(primary.groupBy(*run).agg(*ends), run, "left") if run else rows.crossJoin(F.broadcast(primary.agg(*ends)))  # one row
    all_text = F.array_join(F.transform("_s", lambda s: s["m"]["folded"]), " ")
    pairs = F.arrays_zip(F.coalesce("quotes", F.array().cast(NOTHING)).alias("quote"), F.col("_q").alias("folded"))
    rows = rows.withColumn("_kept", F.filter(pairs, lambda p: (p["folded"] != "") & F.contains(all_text, p["folded"])))
    some = F.coalesce(F.size("_s"), F.lit(0)) > 0
    moment = times.instant(F.col("occurred_at"), F.col("occurred_at_precision"), zone)
    width = F.expr(f"interval {days} days")
    reason = (
        F.when(some & (F.size("_q") > 0) & (F.size("_kept") == 0), "invented_quotes")
        .when(~some & F.coalesce("_context", F.lit(False)), "context_only_source")
        .when(~some, "no_valid_handle")
        .when((moment < F.col("_low") - width) | (moment > F.col("_high") + width), "out_of_range_date")
    )

    def excerpt(p: Column) -> Column:
        owner = F.coalesce(F.get(F.filter("_s", lambda s: F.contains(s["m"]["folded"], p["folded"])), F.lit(0)), F.get("_s", F.lit(0)))["m"]
        return F.struct(owner["id"].alias("message_id"), times.iso(owner["sent_at"]).alias("sent_at"), owner["sender"].alias("sender"), p["quote"].alias("quote"))

    return rows.select(
        *[c for c in events.columns if c not in ("source_message_handles", "quotes")],
        F.transform("_s", lambda s: s["handle"]).alias("source_message_handles"),
        F.transform("_kept", lambda p: p["quote"]).alias("quotes"),
        F.transform("_s", lambda s: s["m"]["id"]).alias("source_message_ids"),
        F.when(some, F.transform("_kept", excerpt)).alias("excerpts"),
        moment.alias("occurred_at_utc"),
        F.coalesce("handles_cited", F.lit(0)).alias("handles_cited"),
        F.coalesce("invalid_handles", F.lit(0)).alias("invalid_handles"),
        reason.alias("drop_reason"),
    )


def merge_decision(kind: Column, edited_at: Column, details: Column, outcome: Column, follow_ups: Column, attendees: Column, dose: Column) -> Column:
    """What becomes of a mention of a known event: nothing, more evidence, or a merge that needs judgement. ``details`` is JSON."""
    had = lambda k: F.coalesce(F.get_json_object(details, f"$.{k}"), F.lit("")).isin("", "[]", "null")
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    gains = ((F.coalesce(outcome, F.lit("")) != "") & had("outcome")) | (some(follow_ups) & had("follow_up_actions")) | (some(attendees) & had("attendees"))
    sign = lambda d: F.replace(x.slug(d), F.lit("-"), F.lit(""))
    changed = (sign(dose) != "") & (sign(dose) != sign(F.get_json_object(details, "$.dose_text")))
    return (
        F.when(edited_at.isNotNull(), "no_change")
        .when(kind.isin("symptom", "note"), "append_sources")
        .when((kind == "appointment") & gains, "needs_llm_merge")
        .when((kind == "medication") & changed, "needs_llm_merge")
        .otherwise("append_sources")
    )


def _rank(ranks: dict[str, int], name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(n) for pair in ranks.items() for n in pair]), name)


def absorbed(events: DataFrame, by: list[str], order: list[str], piece: int = PIECE) -> DataFrame:
    """One event for each key of ``by``: its mentions in ``order``, merged without judgement.

    The first mention owns title and natural key. Empty fields are filled by the first later mention that has them; lists grow; a
    finer date wins; the event is over once any mention says so; the least confidence and the longest body hold. Adds mention_count.
    Columns of ``events`` that it names none of keep the first mention's value. Mentions that agree in ``order`` go by their other columns.

    The mentions of an event are gathered if they are ``piece`` at most, and otherwise summed up (``_summed``), with the same result. ``events`` is
    read twice, to count mentions and to merge them: it should be cheap to read, or written.
    """
    few, many = parted(events, by, piece)
    found = _gathered(few, by, order)
    return found if many is None else found.unionByName(_summed(many, by, order))


def _summed(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``absorbed`` for events of any number of mentions: these are numbered by range, and of each field aggregates tell which one holds.

    What a list grows by is aggregated by its values first, so what comes together is no more than the event keeps. Only the date depends on
    all mentions before: their dates are streamed through a state of one.
    """
    fields = [c for c in events.columns if c not in by]
    rows = placed(events, by, [F.col(c) for c in (*order, *[c for c in fields if c not in order])])
    empty, growing = F.array().cast(NOTHING), [f for f in fields if f in v.GROWN_FIELDS]
    said = lambda f: F.when(F.coalesce(F.col(f), F.lit("")) != "", F.col("_place"))
    length = F.char_length(F.coalesce("body", F.lit("")))
    future = F.when(F.count_if(~F.col("is_future")) > 0, F.lit(False)).when(F.count_if(F.col("is_future").isNull()) == 0, F.lit(True))
    sums = rows.groupBy(*by).agg(
        F.min_by(F.struct(*fields), F.col("_place")).alias("first"),
        F.struct(*[F.min_by(f, said(f)).alias(f) for f in fields if f in v.FILLED_FIELDS], F.lit(0).alias("_")).alias("filled"),
        future.alias("future"),
        F.min(F.struct(_rank(v.CONFIDENCE_RANK, F.col("confidence")).alias("r"), F.col("confidence").alias("c")))["c"].alias("least"),
        F.min_by("body", F.struct(-length, F.col("_place"))).alias("longest"),
        F.count("*").alias("mention_count"),
    )
    none = F.array().cast("array<struct<field:string,value:string,i:int>>")
    values = F.flatten(F.array(none, *[F.transform(F.coalesce(F.col(f), empty), lambda c, i: F.struct(F.lit(f).alias("field"), c.alias("value"), i.alias("i"))) for f in growing]))  # noqa: B023
    once = rows.select(*by, "_place", F.explode(values).alias("e")).groupBy(*by, "e.field", "e.value").agg(F.min(F.struct("_place", "e.i")).alias("at"))
    lists = once.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "field", "value"))).alias("lists"))

    def step(held: list, *columns) -> list:
        made = [np.full(len(columns[0]), None, object) for _ in range(3)]
        for i, (at, grain, basis, rank) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
            if not held:
                held[:] = at, grain, basis, rank
            elif rank is not None and held[3] is not None and rank > held[3]:
                held[:] = at, grain, basis or held[2], rank
            else:
                told = held[2] or basis
                held[:] = (at, grain, told, rank) if held[0] is None and at is not None else (*held[:2], told, held[3])
            for out, value in zip(made, held, strict=False):
                out[i] = value
        return made

    kind = dict(events.dtypes)
    dates = rows.select(*by, "_place", *[F.col(c).alias(f"_{c}") for c in ("occurred_at", "occurred_at_precision", "date_basis")], _rank(v.PRECISION_RANK, times.precision(F.col("occurred_at_precision"))).alias("_rank"))
    added = f"at {kind['occurred_at']}, grain {kind['occurred_at_precision']}, basis {kind['date_basis']}"
    dates = in_order(dates, by, [F.col("_place")], ["_occurred_at", "_occurred_at_precision", "_date_basis", "_rank"], added, list, step)
    last = dates.groupBy(*by).agg(F.max_by(F.struct("at", "grain", "basis"), F.col("_place")).alias("dated"))
    met = matched(matched(sums, last, by), lists, by, "left")

    def grown(f: str) -> Column:
        own = F.coalesce(F.col(f"first.{f}"), empty)
        more = F.transform(F.filter("lists", lambda e: e["field"] == f), lambda e: e["value"])
        return F.concat(own, F.array_except(F.coalesce(more, empty), own))

    merged = {"date_basis": "dated.basis", "occurred_at": "dated.at", "occurred_at_precision": "dated.grain", "is_future": "future", "confidence": "least", "body": "longest"}
    out = [F.col(f"filled.{f}") if f in v.FILLED_FIELDS else grown(f) if f in v.GROWN_FIELDS else F.col(merged.get(f, f"first.{f}")) for f in fields]
    return met.select(*by, *[c.alias(f) for c, f in zip(out, fields, strict=True)], "mention_count")


def _gathered(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``absorbed`` for events of few mentions: each event's are put in order and walked."""
    fields = [c for c in events.columns if c not in by]
    told = F.array_sort(F.collect_list(F.struct(*order, *[c for c in fields if c not in order])))
    grouped = events.groupBy(*by).agg(told.alias("e"))
    first, rest = F.get("e", F.lit(0)), F.slice("e", 2, F.size("e"))
    empty = F.array().cast(NOTHING)

    def filled(f: str) -> Column:
        return F.get(F.filter(F.transform("e", lambda m: m[f]), lambda c: F.coalesce(c, F.lit("")) != ""), F.lit(0))

    def grown(f: str) -> Column:
        own = F.coalesce(first[f], empty)
        return F.concat(own, F.array_except(F.flatten(F.transform(rest, lambda m: F.coalesce(m[f], empty))), own))

    rank = lambda p: _rank(v.PRECISION_RANK, times.precision(p))
    date = lambda at, grain, basis: F.struct(at.alias("at"), grain.alias("grain"), basis.alias("basis"))
    blank = lambda c: F.nullif(c, F.lit(""))

    def later(held: Column, m: Column) -> Column:
        at, grain = m["occurred_at"], m["occurred_at_precision"]
        finer = rank(grain) > rank(held["grain"])
        basis = F.when(finer, F.coalesce(blank(m["date_basis"]), held["basis"])).otherwise(F.coalesce(blank(held["basis"]), m["date_basis"]))
        return F.when(finer | (held["at"].isNull() & at.isNotNull()), date(at, grain, basis)).otherwise(date(held["at"], held["grain"], basis))

    def longer(held: Column, m: Column) -> Column:
        return F.when(F.char_length(F.coalesce(m["body"], F.lit(""))) > F.char_length(F.coalesce(held, F.lit(""))), m["body"]).otherwise(held)

    dated = F.aggregate(rest, date(first["occurred_at"], first["occurred_at_precision"], first["date_basis"]), later)
    values = {
        "date_basis": dated["basis"],
        "occurred_at": dated["at"],
        "occurred_at_precision": dated["grain"],
        "is_future": F.forall("e", lambda m: m["is_future"]),
        "confidence": F.array_min(F.transform("e", lambda m: F.struct(_rank(v.CONFIDENCE_RANK, m["confidence"]).alias("r"), m["confidence"].alias("c"))))["c"],
        "body": F.aggregate(rest, first["body"], longer),
    }
    out = [filled(f) if f in v.FILLED_FIELDS else grown(f) if f in v.GROWN_FIELDS else values.get(f, first[f]) for f in fields]
    return grouped.select(*by, *[c.alias(f) for c, f in zip(out, fields, strict=True)], F.size("e").cast("long").alias("mention_count"))


def free_siblings(wanted: DataFrame, stored: DataFrame, by: list[str], key: str = "dedup_key") -> DataFrame:
    """(by, key, sibling): for each key the first ``key#N``, N from 2, that is free or may be written."""
    parts = stored.where(F.col(key).rlike(r"#\d+$")).select(*by, F.regexp_extract(key, r"^(.*)#\d+$", 1).alias(key), F.regexp_extract(key, r"#(\d+)$", 1).cast("int").alias("_n"), "pinned", "deleted_at", "edited_at")
    shut = parts.where("pinned or deleted_at is not null or edited_at is not null").groupBy(*by, key).agg(F.collect_set("_n").alias("_shut"))
    rows = wanted.select(*by, key).distinct().join(shut, [*by, key], "left").withColumn("_shut", F.coalesce("_shut", F.array().cast("array<int>")))
    first = F.array_min(F.array_except(F.sequence(F.lit(2), F.size("_shut") + 2), F.col("_shut")))
    return rows.select(*by, key, F.concat(key, F.lit("#"), first.cast("string")).alias("sibling"))


def prepared(records: DataFrame, messages: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records ready to be upserted, one for each key, and counts of (tenant_id, outcome): orphaned, protected, inserted, updated.

    Sources must be the tenant's own messages; without any a record is orphaned. A record for a pinned event goes to a sibling
    key; edited and deleted events are left alone. ``records``: tenant_id, dedup_key, record_no, occurred_at, source_message_ids,
    source_excerpts, mention_count, chunk_labels and the event's fields. ``messages``: tenant_id, id, sent_at.
    ``stored``: the events, with pinned, edited_at, deleted_at.
    """
    key = ["tenant_id", "record_no"]
    cited = records.select(*key, F.posexplode("source_message_ids").alias("_i", "id"))
    own = cited.join(messages.select("tenant_id", "id", F.col("sent_at").alias("_at")), ["tenant_id", "id"])
    sources = own.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "id"))), lambda s: s["id"]).alias("_own"), F.min("_at").alias("_first"))
    rows = records.join(sources, key, "left")
    orphans = rows.where("_own is null")
    rows = rows.where("_own is not null").withColumn("source_message_ids", F.array_distinct("_own")).withColumn("occurred_at", F.coalesce("occurred_at", "_first")).drop("_own", "_first")
    state = stored.select("tenant_id", "dedup_key", F.lit(True).alias("_there"), F.col("pinned").alias("_pinned"), (F.col("edited_at").isNotNull() | F.col("deleted_at").isNotNull()).alias("_shut"))
    met = rows.join(state, ["tenant_id", "dedup_key"], "left")
    pinned = met.where("_pinned")
    moved = pinned.drop("_there", "_pinned", "_shut").join(free_siblings(pinned, stored, ["tenant_id"]), ["tenant_id", "dedup_key"]).withColumn("dedup_key", F.col("sibling")).drop("sibling")
    met = met.where("not coalesce(_pinned, false)").unionByName(moved.join(state, ["tenant_id", "dedup_key"], "left"))
    protected, open_ = met.where("coalesce(_shut, false)"), met.where("not coalesce(_shut, false)")
    fields = [c for c in records.columns if c not in ("tenant_id", "dedup_key")]
    told = open_.groupBy("tenant_id", "dedup_key").agg(F.array_sort(F.collect_list(F.struct("record_no", *[f for f in fields if f != "record_no"]))).alias("e"), F.max("_there").alias("_there"))
    all_of = lambda f: F.flatten(F.transform("e", lambda m: m[f]))
    grown = {
        "source_message_ids": F.array_distinct(all_of("source_message_ids")),
        "source_excerpts": nested.merged_excerpts(all_of("source_excerpts"), F.slice(all_of("source_excerpts"), 1, 0)),
        "mention_count": F.aggregate("e", F.lit(0).cast("long"), lambda n, m: n + m["mention_count"]),
        "chunk_labels": all_of("chunk_labels"),
        "occurred_at": F.array_min(F.transform("e", lambda m: m["occurred_at"])),
    }
    ready = told.select("tenant_id", "dedup_key", *[grown.get(f, F.get("e", F.lit(0))[f]).alias(f) for f in fields], F.coalesce("_there", F.lit(False)).alias("is_update"))
    outcome = lambda df, name: df.select("tenant_id", name.alias("outcome"))
    counts = (
        outcome(orphans, F.lit("orphaned"))
        .unionByName(outcome(protected, F.lit("protected")))
        .unionByName(outcome(ready, F.when(F.col("is_update"), "updated").otherwise("inserted")))
        .groupBy("tenant_id", "outcome")
        .agg(F.count("*").alias("n"))
    )
    return ready, counts


#: Characters of the runs by which texts are looked up, and predictions of a run and kind up to which comparing all is cheaper.
GRAM, FEW = 3, 256


def grams(text: Column) -> Column:
    """The different runs of ``GRAM`` characters of ``text``, in one pass over it; none if it is shorter."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def candidates(labels: DataFrame, predictions: DataFrame, by: list[str], few: int = FEW) -> DataFrame:
    """(by, label_no, event_no): pairs of one kind that an index leaves over; every pair that ``scored`` finds is among them.

    Where a run has ``few`` predictions of a kind or fewer, each label meets them all; the rest is looked up (``_looked_up``).
    """
    key = [*by, "kind"]
    small, predictions = parted(predictions, key, few)
    compared = labels.select(*key, "label_no").join(small.select(*key, "event_no"), key).select(*by, "label_no", "event_no")
    return compared if predictions is None else compared.unionByName(_looked_up(labels, predictions, by))


def _looked_up(labels: DataFrame, predictions: DataFrame, by: list[str]) -> DataFrame:
    """``candidates`` by an index alone.

    The index has the runs of three characters of the predictions' texts that any label of their run and kind asks for; a label is looked up by the
    one of its runs that fewest predictions hold, whichever of its words that is from, and a label with a run that none holds meets nothing. Texts
    are read once, and only ids are shuffled. Labels all of whose words are shorter meet every prediction of their kind.
    """
    key = [*by, "kind"]
    # A null among the words, or no list, is never found in a text.
    wanted = labels.select(*key, "label_no", F.array_distinct(F.flatten(F.transform("must_mention", grams))).alias("_grams")).where("_grams is not null")
    asked = wanted.select(*key, "label_no", F.explode("_grams").alias("_gram"))
    held = predictions.select(*key, "event_no", F.explode(grams(F.col("searchable"))).alias("_gram"))
    held = settled(held.join(asked.select(*key, "_gram").distinct(), [*key, "_gram"], "left_semi"))
    counts = held.groupBy(*key, "_gram").agg(F.count("*").alias("_n"))
    least = asked.join(counts, [*key, "_gram"], "left").groupBy(*key, "label_no").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("r"))
    # Written, so that its size is known before the index is read: it is broadcast if it is small, and the index isn't shuffled.
    rarest = settled(least.where("r.n > 0").select(*key, "label_no", F.col("r.gram").alias("_gram")))
    short = wanted.where(F.size("_grams") == 0).select(*key, "label_no")
    found = rarest.join(held, [*key, "_gram"]).select(*by, "label_no", "event_no")
    return found.unionByName(short.join(predictions.select(*key, "event_no"), key).select(*by, "label_no", "event_no"))


def scored(labels: DataFrame, predictions: DataFrame, by: list[str], matches: Column, few: int = FEW) -> DataFrame:
    """(by, label_no, event_no, dated): pairs of a label and a prediction of its kind that mentions all it must. Texts come folded.

    ``labels``: by, label_no, kind, must_mention; ``predictions``: by, event_no, kind, searchable; label_no and event_no tell a run's rows apart.
    ``matches`` says if the dates agree, over ``l`` and ``p``. Where a run has ``few`` predictions of a kind or fewer, texts are compared as they meet, so
    that only pairs that hold are handed on; others come from an index (``_looked_up``), and only their texts are compared.
    """
    left, said = labels.alias("l"), F.forall("l.must_mention", lambda m: F.contains(F.col("p.searchable"), m))
    found = lambda met: met.select(*[F.col(f"l.{b}") for b in by], "l.label_no", "p.event_no", F.coalesce(matches, F.lit(False)).alias("dated"))

    def same(one: str, other: str, columns: list[str]) -> Column:
        on = F.lit(True)
        for c in columns:
            on = on & (F.col(f"{one}.{c}") == F.col(f"{other}.{c}"))
        return on

    small, large = parted(predictions, [*by, "kind"], few)
    compared = found(left.join(small.alias("p"), same("l", "p", [*by, "kind"]) & said))
    if large is None:
        return compared
    pairs = _looked_up(labels, large, by).alias("c")
    met = pairs.join(left, same("c", "l", [*by, "label_no"])).join(large.alias("p"), same("c", "p", [*by, "event_no"]))
    return compared.unionByName(found(met.where(said & same("l", "p", ["kind"]))))


def assigned(pairs: DataFrame, by: list[str], piece: int = PIECE) -> DataFrame:
    """(by, label_no, event_no, role): each label, in order, takes the first free prediction, one of its date if it can.

    Others of its date are "duplicate"; the one taken is "dated" or "found". What a label takes the later ones can't have, so pairs go through in
    order, of which a task keeps what is taken only. A run of over ``piece`` pairs is parted by connected components of labels and predictions:
    labels that compete for nothing never wait for each other. ``pairs`` is read twice: it should be cheap to read, or written.
    """
    rows = pairs.where("label_no is not null and event_no is not null").withColumn("dated", F.coalesce("dated", F.lit(False)))

    def step(state: dict, *columns) -> list:
        roles = np.full(len(columns[0]), None, object)
        for i, (label, event, dated) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
            if label != state["label"]:
                state["label"], state["role"] = label, None
            if event in state["taken"]:
                continue
            if state["role"] is None:
                roles[i] = state["role"] = "dated" if dated else "found"
            elif state["role"] == "dated" and dated:
                roles[i] = "duplicate"
            if roles[i] is not None:
                state["taken"].add(event)
        return [roles]

    def walked(some: DataFrame, group: list[str]) -> DataFrame:
        fresh = lambda: {"taken": set(), "label": None, "role": None}
        done = in_order(some, group, [F.col("label_no"), F.desc("dated"), F.col("event_no")], ["label_no", "event_no", "dated"], "role string", fresh, step)
        return done.where("role is not null").select(*by, "label_no", "event_no", "role")

    few, many = parted(rows, by, piece)
    found = walked(few, by)
    if many is None:
        return found
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    node = lambda mark, number: F.sha2(F.concat_ws("\x1f", group, F.lit(mark), F.col(number).cast("string")), 256)
    many = many.withColumn("_node", node("label", "label_no"))
    groups = components(many.select(F.col("_node").alias("a"), node("event", "event_no").alias("b")))
    many = many.join(groups.select(F.col("node").alias("_node"), F.col("component").alias("_component")), "_node").drop("_node")
    return found.unionByName(walked(many, [*by, "_component"]))


def unclaimed(predictions: DataFrame, assigned_: DataFrame, sources: DataFrame, by: list[str]) -> DataFrame:
    """(by, event_no, invented) of predictions that no label took: invented if they cite none of the labels' messages.

    ``predictions``: by, event_no, source_message_ids; ``sources``: by, id of the messages that labels stand for.
    """
    left = predictions.join(assigned_.select(*by, "event_no"), [*by, "event_no"], "left_anti")
    known = left.select(*by, "event_no", F.explode("source_message_ids").alias("id")).join(sources, [*by, "id"], "left_semi").select(*by, "event_no").distinct().withColumn("_k", F.lit(True))
    return left.join(known, [*by, "event_no"], "left").select(*by, "event_no", F.col("_k").isNull().alias("invented"))


def precision_recall(labels: DataFrame, predictions: DataFrame, by: list[str]) -> DataFrame:
    """(by, labels, predictions, hits, precision, recall): ``labels`` and ``predictions`` have a boolean ``hit``; nothing of nothing is zero."""
    a = labels.groupBy(*by).agg(F.count("*").alias("labels"), F.count_if("hit").alias("found"))
    b = predictions.groupBy(*by).agg(F.count("*").alias("predictions"), F.count_if("hit").alias("right"))
    both = a.join(b, by, "full").fillna(0)
    share = lambda n, of: F.coalesce(F.try_divide(n, of), F.lit(0.0))
    return both.select(*by, "labels", "found", "predictions", "right", share("right", "predictions").alias("precision"), share("found", "labels").alias("recall"))


def passes(score: DataFrame, dated: int = 20, invented: int = 2, duplicates: int = 2) -> DataFrame:
    return score.withColumn("passed", (F.col("dated") >= dated) & (F.col("invented") <= invented) & (F.col("duplicates") <= duplicates))


def numbered(events: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    return events.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))

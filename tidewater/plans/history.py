"""Queries on the history: keys, merges, upserts, deletions, evidence. Events and orders stand for extracted events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import keys, nested, times
from tidewater.functions import text as x
from tidewater.operators import events as ev
from tidewater.operators import mutations as mu
from tidewater.plans.reading import events
from tidewater.plans.registry import AT, QUERIES, ZONE, folder, now, query, settled
from tidewater.session import table
from tidewater.sources.keyed import KeyedTable

_GRAIN = "case event_id % 5 when 0 then 'exact' when 1 then 'day' when 2 then 'week' when 3 then 'month' else 'unknown' end"
_LOCAL = f"((ts at time zone 'UTC') at time zone '{ZONE}')"


def _grain():
    i = F.col("event_id") % 5
    return F.when(i == 0, "exact").when(i == 1, "day").when(i == 2, "week").when(i == 3, "month").otherwise("unknown")


@query(f"""
with e as (select *, {_GRAIN} as grain, case when event_id % 10 < 5 then {_LOCAL}::date else ts::date end as day,
    case event_type when 'view' then 'symptom' when 'purchase' then 'medication' else 'note' end as kind from events),
b as (
  select *, case when event_id % 13 = 0 then 'undated:' || left(sha1('dr-' || event_type || '-' || event_id::varchar), 8)
      when grain = 'month' or (kind = 'medication' and event_id % 2 = 0) then strftime(day, '%Y-%m') when grain = 'week' then strftime(day, '%G-W%V') else strftime(day, '%Y-%m-%d') end as bucket from e)
select event_id, bucket, 'llm:' || sha256(kind || '|' || bucket || '|' || case when event_id % 3 = 0 then event_type || '-visit' else 'dr-' || event_type || '-' || event_id::varchar end) as dedup_key from b""")
def dedup_key(spark, sf_dir):
    """The key on which mentions of one event agree: kind, day or week or month by the tenant's clock, and a plain name."""
    i, kind = F.col("event_id"), F.when(F.col("event_type") == "view", "symptom").when(F.col("event_type") == "purchase", "medication").otherwise("note")
    zoned = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    when = F.when(i % 13 == 0, None).when(i % 10 < 5, zoned).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    title = F.concat(F.lit("D'r. "), F.col("event_type"), F.lit(" – "), i.cast("string"))
    title = F.replace(title, F.lit("D'r."), F.lit("Dr_"))
    natural = F.when(i % 3 == 0, F.concat(F.lit("Mrs. "), F.initcap("event_type"), F.lit("  VISIT!")))
    action = F.when(i % 2 == 0, "started").otherwise("missed")
    rows = events(spark, sf_dir).select("event_id", kind.alias("kind"), action.alias("action"), when.alias("when"), _grain().alias("grain"), natural.alias("natural"), title.alias("title"))
    c = [F.col(n) for n in ("kind", "action", "when", "grain", "natural", "title")]
    bucket = times.bucket(c[0], c[1], c[2], c[3], c[5], ZONE)
    return rows.select("event_id", bucket.alias("bucket"), keys.event_key(*c, ZONE).alias("dedup_key"))


@query(f"""
with e as (select *, {_GRAIN} as grain from events)
select event_id, case when event_id % 17 = 0 then null when grain = 'exact' then (date_trunc('minute', ts) at time zone '{ZONE}') at time zone 'UTC' when grain = 'week' then date_trunc('week', ts)::timestamp
  when grain = 'month' then date_trunc('month', ts)::timestamp else date_trunc('day', ts)::timestamp end as occurred_at from e""")
def precision_instant(spark, sf_dir):
    """The instant that an event is sorted by, as precise as it was told."""
    spelled = F.when(_grain() == "exact", "datetime").when(_grain() == "day", "date").otherwise(_grain())
    text = F.when(_grain() == "exact", F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).when(_grain() == "month", F.date_format("ts", "yyyy-MM")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    text = F.when(F.col("event_id") % 17 == 0, "next week").otherwise(text)
    return events(spark, sf_dir).select("event_id", times.instant(text, spelled, ZONE).alias("occurred_at"))


@query("""
select o_orderkey, case when o_orderkey % 11 = 0 then 'no_change' when o_orderstatus = 'F' then 'append_sources' when o_orderstatus = 'O' and o_orderkey % 2 = 0 then 'needs_llm_merge'
  when o_orderstatus = 'P' and o_orderkey % 3 = 1 then 'needs_llm_merge' else 'append_sources' end as decision from orders""")
def merge_decision(spark, sf_dir):
    """Whether a second mention adds evidence only, or something that takes judgement."""
    k = F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "F", "symptom").when(F.col("o_orderstatus") == "O", "appointment").otherwise("medication")
    details = F.when(k % 2 == 0, '{"outcome": null, "attendees": [], "dose_text": "5 mg"}').otherwise('{"outcome": "fine", "attendees": [], "dose_text": "5 mg"}')
    none = F.array().cast("array<string>")
    dose = F.when(k % 3 == 0, "5mg").when(k % 3 == 1, "10 mg")
    found = ev.merge_decision(kind, F.when(k % 11 == 0, now()), details, F.lit("ok"), none, none, dose)
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("decision"))


_MENTIONS = """
with m as (
  select user_id as tenant_id, event_type as dedup_key, row_number() over (partition by user_id, event_type order by ts, event_id) as no, event_id,
    'Title ' || event_id::varchar as title, case when event_id % 4 > 0 then repeat('x', floor(value / 10)::int) end as body, case when event_id % 3 = 0 then 'loc' || event_id::varchar end as location,
    case when event_id % 5 = 0 then null else strftime(ts, '%Y-%m-%d') end as occurred_at,
    case event_id % 4 when 0 then 'date' when 1 then 'week' when 2 then 'month' else 'unknown' end as grain, case event_id % 4 when 0 then 3 when 1 then 2 when 2 then 1 else 0 end as r,
    event_id % 7 <> 0 as is_future, case event_id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as confidence, 'h' || (event_id % 6)::varchar as handle
  from events)
"""


_ABSORBED = (
    _MENTIONS.replace("with m as", "with recursive m as")
    + """, d as (
  select tenant_id, dedup_key, no, occurred_at, grain, r from m where no = 1
  union all
  select m.tenant_id, m.dedup_key, m.no, case when f.t then m.occurred_at else d.occurred_at end, case when f.t then m.grain else d.grain end, case when f.t then m.r else d.r end
  from d join m on m.tenant_id = d.tenant_id and m.dedup_key = d.dedup_key and m.no = d.no + 1,
    lateral (select m.r > d.r or (d.occurred_at is null and m.occurred_at is not null) as t) f),
g as (
  select tenant_id, dedup_key, arg_min(title, no) as title, arg_min(location, no) filter (location is not null) as location, bool_and(is_future) as is_future,
    case when bool_or(confidence = 'low') then 'low' when bool_or(confidence = 'medium') then 'medium' else 'high' end as confidence,
    max(length(coalesce(body, '')))::int as body_chars, count(distinct handle)::int as n_handles, count(*)::bigint as mention_count from m group by all)
select g.*, l.occurred_at, l.grain as occurred_at_precision from g join (select tenant_id, dedup_key, arg_max(grain, no) as grain, last(occurred_at order by no) as occurred_at from d group by all) l using (tenant_id, dedup_key)"""
)
_HOT_USER = "case when user_id % 5 = 0 then -1 else user_id end"


def _mentions(spark, sf_dir, tenant):
    i = F.col("event_id")
    text = lambda c: F.lit(c).cast("string")
    return events(spark, sf_dir).select(
        tenant.alias("tenant_id"),
        F.col("event_type").alias("dedup_key"),
        F.struct("ts", "event_id").alias("no"),
        F.concat(F.lit("Title "), i.cast("string")).alias("title"),
        F.when(i % 4 > 0, F.repeat(F.lit("x"), F.floor(F.col("value") / 10).cast("int"))).alias("body"),
        F.when(i % 3 == 0, F.concat(F.lit("loc"), i.cast("string"))).alias("location"),
        F.when(i % 5 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("occurred_at"),
        F.when(i % 4 == 0, "date").when(i % 4 == 1, "week").when(i % 4 == 2, "month").otherwise("unknown").alias("occurred_at_precision"),
        text(None).alias("date_basis"),
        (i % 7 != 0).alias("is_future"),
        F.when(i % 3 == 0, "high").when(i % 3 == 1, "medium").otherwise("low").alias("confidence"),
        F.array(F.concat(F.lit("h"), (i % 6).cast("string"))).alias("source_message_handles"),
    )


def _merged(found):
    return found.select(
        "tenant_id", "dedup_key", "title", "location", "is_future", "confidence", F.char_length(F.coalesce("body", F.lit(""))).alias("body_chars"),
        F.size("source_message_handles").alias("n_handles"), "mention_count", "occurred_at", "occurred_at_precision",
    )


@query(_ABSORBED)
def absorb_mentions(spark, sf_dir):
    """All mentions of an event as one: nothing is lost, the first names it, the finest date holds."""
    return _merged(ev.absorbed(_mentions(spark, sf_dir, F.col("user_id")), ["tenant_id", "dedup_key"], ["no"]))


@query(_ABSORBED.replace("user_id", _HOT_USER))
def absorb_hot_events(spark, sf_dir):
    """The same where one tenant has a fifth of all mentions, whose events are summed up instead of gathered."""
    tenant = F.when(F.col("user_id") % 5 == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id"))
    return _merged(ev.absorbed(_mentions(spark, sf_dir, tenant), ["tenant_id", "dedup_key"], ["no"], piece=64))


_STORED = """
with stored as (
  select o_custkey as tenant_id, o_orderkey as dedup_key, o_orderstatus as kind, o_totalprice::decimal(12,2) as title, o_orderkey % 5 = 0 as edited, o_orderkey % 7 = 0 as deleted, o_orderkey % 11 = 0 as pinned,
    o_orderkey % 3 = 0 as own_title from orders where o_orderkey % 4 < 3),
incoming as (select o_custkey as tenant_id, o_orderkey as dedup_key, 'X' as kind, o_totalprice::decimal(12,2) + 1 as title from orders where o_orderkey % 4 > 1)
"""


@query(
    _STORED
    + """select tenant_id, dedup_key, case when s.tenant_id is null or (i.tenant_id is not null and not (edited or deleted or pinned)) then i.kind else s.kind end as kind,
  case when s.tenant_id is null or (i.tenant_id is not null and not (edited or deleted or pinned) and not own_title) then i.title else s.title end::decimal(12,2) as title,
  case when s.tenant_id is null then 'b' when i.tenant_id is not null and not (edited or deleted or pinned) then 'a,b' else 'a' end as sources,
  case when i.tenant_id is not null and (s.tenant_id is null or not (edited or deleted or pinned)) then 1 else 0 end as updated
from stored s full join incoming i using (tenant_id, dedup_key)"""
)
def event_upsert(spark, sf_dir):
    """Events written again: hands off what people edited, deleted or pinned; evidence only grows."""
    stored, incoming, *how = _upserts(spark, sf_dir)
    return _upserted(mu.upsert(stored, incoming, *how))


def _upserted(found):
    return found.select("tenant_id", "dedup_key", "kind", "title", F.array_join("sources", ",").alias("sources"), F.col("updated_at").isNotNull().cast("int").alias("updated"))


def _upserts(spark, sf_dir):
    k, none = F.col("o_orderkey"), F.lit(None).cast("timestamp")
    base = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tenant_id"), k.alias("dedup_key"), F.col("o_orderstatus").alias("kind"), F.col("o_totalprice").cast("decimal(12,2)").alias("title"), "o_orderkey")
    flags = lambda own: {
        "edited_at": F.when((k % 5 == 0) & F.lit(own), now()).otherwise(none),
        "deleted_at": F.when((k % 7 == 0) & F.lit(own), now()).otherwise(none),
        "pinned": (k % 11 == 0) & F.lit(own),
        "user_edited_fields": F.when((k % 3 == 0) & F.lit(own), F.array(F.lit("title"))),
        "sources": F.array(F.lit("a" if own else "b")),
        "updated_at": none,
    }
    stored = base.where("o_orderkey % 4 < 3").withColumns(flags(True)).drop("o_orderkey")
    incoming = base.where("o_orderkey % 4 > 1").withColumns({"kind": F.lit("X"), "title": (F.col("title") + 1).cast("decimal(12,2)")}).withColumns(flags(False)).drop("o_orderkey")
    evidence = {"sources": nested.ordered_union(F.col("old.sources"), F.col("new.sources"))}
    return stored, incoming, ["tenant_id", "dedup_key"], ["kind", "title"], evidence, now()


@query(QUERIES["event_upsert"].sql)
def stored_upserts(spark, sf_dir):
    """The same on a table by key: each of two upserts reads the buckets that it touches, and writes only its own rows."""
    stored, incoming, *how = _upserts(spark, sf_dir)
    held = KeyedTable(spark, folder(spark), how[0], buckets=8)
    held.overwrite(stored)
    for half in (0, 1):
        mu.upserted(held, incoming.where(F.col("dedup_key") % 2 == half), *how)
    return _upserted(held.read())


@query("""
select event_id, case when event_id % 6 = 0 then ts::timestamp when event_id % 4 = 1 then timestamp '2024-01-16 00:00:00' end as extracted_at from events""")
def cursor_stamp(spark, sf_dir):
    """The messages of a run are marked as done, and only those that weren't."""
    rows = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 6 == 0, F.col("ts")).alias("extracted_at"))
    done = rows.where("event_id % 4 = 1").select("event_id")
    once = mu.stamped(rows, done, ["event_id"], "extracted_at", now())
    return mu.stamped(once, done, ["event_id"], "extracted_at", now() + F.expr("interval 1 day"))


@query(f"""
select event_id, case when event_id % 5 = 0 then null when event_id % 5 = 1 then 'changed' else event_type end as body, case when event_id % 5 < 2 then timestamp '{AT}' end as edited_at,
  case when event_id % 5 < 2 then 'body' else '' end as edited, case when event_id % 9 = 0 then ts::timestamp when event_id % 8 = 0 then timestamp '{AT}' end as deleted_at from events""")
def patched_events(spark, sf_dir):
    """Edits by hand (a null clears, an empty patch changes nothing) and deletions."""
    i = F.col("event_id")
    rows = events(spark, sf_dir).select(
        "event_id", F.col("event_type").alias("body"), F.lit(None).cast("timestamp").alias("edited_at"), F.array().cast("array<string>").alias("user_edited_fields"), F.when(i % 9 == 0, F.col("ts")).alias("deleted_at")
    )
    none = F.lit(None).cast("string")
    patch = F.when(i % 5 == 0, F.create_map(F.lit("body"), none)).when(i % 5 == 1, F.create_map(F.lit("body"), F.lit("changed"))).when(i % 5 == 2, F.from_json(F.lit("{}"), "map<string,string>"))
    patches = rows.select("event_id", patch.alias("patch")).where("patch is not null")
    found = mu.soft_deleted(mu.patched(rows, patches, ["event_id"], ["body"], now()), rows.where("event_id % 8 = 0"), ["event_id"], now())
    return found.select("event_id", "body", "edited_at", F.array_join("user_edited_fields", ",").alias("edited"), "deleted_at")


@query("""
with m as (select case when o_custkey % 10 = 3 then o_custkey - 3 else o_custkey end as member_id, o_orderdate from orders),
c as (select c_custkey as member_id, c_name from customer where c_custkey % 10 <> 3)
select member_id, c_name, count(o_orderdate)::bigint as n_messages from c left join m using (member_id) group by all""")
def participant_merge(spark, sf_dir):
    """People who turned out to be one: messages are repointed, the loser goes."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("member_id"), "c_name")
    merges = people.where("member_id % 10 = 3").select(F.col("member_id").alias("loser"), (F.col("member_id") - 3).alias("survivor"))
    said = mu.repointed(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("member_id"), "o_orderdate"), merges, "member_id")
    left = mu.merged_members(people, merges, "member_id", ["c_name"])
    return left.join(said, "member_id", "left").groupBy("member_id", "c_name").agg(F.count("o_orderdate").alias("n_messages"))


@query("""
with gone as (select n_nationkey from nation where n_regionkey = 2),
c as (select * from customer where c_nationkey not in (select * from gone))
select 'customer' as name, count(*)::bigint as n from c union all select 'supplier', count(*) from supplier where s_nationkey not in (select * from gone)
union all select 'orphan', count(*) from orders where o_custkey not in (select c_custkey from c)""")
def tenant_cascade(spark, sf_dir):
    """Everything of tenants that leave goes; references to their rows become null."""
    gone = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("tenant"))
    tables = {"customer": table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "tenant"), "supplier": table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "tenant")}
    left = mu.without_tenants(tables, gone, "tenant")
    lost = tables["customer"].join(gone, "tenant", "left_semi").select("c_custkey")
    orders = mu.cleared(table(spark, sf_dir, "orders").select("o_custkey"), lost, "o_custkey")
    one = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return one(left["customer"], "customer").unionByName(one(left["supplier"], "supplier")).unionByName(one(orders.where("o_custkey is null"), "orphan"))


@query("""
with s as (select n_nationkey // 6 as k, 2 + n_nationkey % 6 as n, n_nationkey % 6 < n_nationkey // 6 as shut from nation)
select 'key' || k::varchar as dedup_key, 'key' || k::varchar || '#' || coalesce((select min(x) from range(2, 20) r(x) where not exists (select 1 from s b where b.k = a.k and b.n = x and b.shut)), 2)::varchar as sibling
from (select distinct k from s) a""")
def sibling_keys(spark, sf_dir):
    """Where a mention goes whose event was split off: the first numbered key that may be written."""
    n = F.col("n_nationkey")
    name = F.concat(F.lit("key"), F.floor(n / 6).cast("string"))
    none = F.lit(None).cast("timestamp")
    stored = table(spark, sf_dir, "nation").select(
        F.lit("t").alias("tenant_id"), F.concat(name, F.lit("#"), (n % 6 + 2).cast("string")).alias("dedup_key"), (n % 6 < F.floor(n / 6)).alias("pinned"), none.alias("deleted_at"), none.alias("edited_at")
    )
    wanted = table(spark, sf_dir, "nation").select(F.lit("t").alias("tenant_id"), name.alias("dedup_key"))
    return ev.free_siblings(wanted, stored, ["tenant_id"]).select("dedup_key", "sibling")


@query("""
with p as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as place, text from conversations),
e as (
  select conv_id, turn as event_no, case when turn % 4 = 3 then 'zzz never said' else left(text, 30) end as quote, case when turn % 5 = 4 then 'c1' when turn % 7 = 6 then 'm99' else 'm' || place::varchar end as handle from p)
select conv_id, event_no, case when handle = 'c1' then 'context_only_source' when handle = 'm99' then 'no_valid_handle' when event_no % 4 = 3 then 'invented_quotes' end as drop_reason,
  (handle = 'c1' or handle = 'm99')::bigint as invalid_handles, case when handle not in ('c1', 'm99') and event_no % 4 <> 3 then conv_id::varchar || '-' || event_no::varchar end as owner from e""")
def grounding(spark, sf_dir):
    """Extracted events whose handles and quotes the conversation doesn't bear out, and why."""
    turns = table(spark, sf_dir, "conversations").withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    at = F.timestamp_seconds(F.lit(1_720_000_000) + F.col("turn") * 60)
    primary = turns.select("conv_id", F.concat(F.lit("m"), F.col("place").cast("string")).alias("handle"), F.concat_ws("-", "conv_id", "turn").alias("id"), at.alias("sent_at"), F.col("role").alias("sender"), "text")
    context = turns.select("conv_id", F.lit("c1").alias("handle")).distinct()
    handle = F.when(F.col("turn") % 5 == 4, "c1").when(F.col("turn") % 7 == 6, "m99").otherwise(F.concat(F.lit("m"), F.col("place").cast("string")))
    quote = F.when(F.col("turn") % 4 == 3, "zzz never said").otherwise(F.upper(F.left("text", F.lit(30))))
    said = turns.select("conv_id", F.col("turn").alias("event_no"), F.array(handle).alias("source_message_handles"), F.array(quote).alias("quotes"), F.lit("2024-07-03").alias("occurred_at"), F.lit("date").alias("occurred_at_precision"))
    found = ev.grounded(said, primary, context, ["conv_id"], ZONE, run=["conv_id"])
    return found.select("conv_id", "event_no", "drop_reason", "invalid_handles", F.get("excerpts", F.lit(0))["message_id"].alias("owner"))


@query("""
select user_id, count(*)::bigint as labels, count(distinct ts::date)::bigint as dated, (count(*) - count(distinct ts::date))::bigint as duplicates from events group by user_id""")
def run_scores(spark, sf_dir):
    """Labelled events against those found, where all of one day compete: a day's first label takes one of them, and the others are its duplicates."""
    numbered = ev.numbered(events(spark, sf_dir), ["user_id"], [F.col("ts"), F.col("event_id")], "no")
    word = F.concat(F.lit("day "), F.date_format("ts", "yyyy-MM-dd"))
    labels = numbered.select("user_id", F.col("no").alias("label_no"), F.lit("symptom").alias("kind"), F.array(word, F.lit("an event")).alias("must_mention"), F.to_date("ts").alias("day"))
    found = numbered.select("user_id", F.col("no").alias("event_no"), F.lit("symptom").alias("kind"), x.fold_case(F.concat(F.lit("An  Event of "), word)).alias("searchable"), F.to_date("ts").alias("day"))
    pairs = settled(ev.scored(labels, settled(found), ["user_id"], F.col("l.day") == F.col("p.day")))
    roles = ev.assigned(pairs, ["user_id"])
    hits = roles.groupBy("user_id").agg(F.count_if(F.col("role") == "dated").alias("dated"), F.count_if(F.col("role") == "duplicate").alias("duplicates"))
    return labels.groupBy("user_id").agg(F.count("*").alias("labels")).join(hits, "user_id").select("user_id", "labels", "dated", "duplicates")


@query("""
with l as (select item_id, substr(text, 1, 24) as a, substr(text, 25, 24) as b from benchmark where text is not null)
select item_id, count(doc_id)::bigint as documents, min(doc_id) as first from l left join documents on contains(text, a) and contains(text, b) group by item_id""")
def quoted_items(spark, sf_dir):
    """Documents in which the first words of a benchmark's items stand, by the rarest three characters of each."""
    items = table(spark, sf_dir, "benchmark").where("text is not null")
    kind, words = F.lit("quote").alias("kind"), F.array(F.substring("text", 1, 24), F.substring("text", 25, 24)).alias("must_mention")
    labels = items.select(F.col("item_id").alias("label_no"), kind, words)
    found = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("event_no"), kind, F.col("text").alias("searchable"))
    pairs = ev.scored(labels, found, [], F.lit(None))
    counts = pairs.groupBy(F.col("label_no").alias("item_id")).agg(F.count("*").alias("documents"), F.min("event_no").alias("first"))
    return items.select("item_id").join(counts, "item_id", "left").fillna(0, ["documents"])


@query("""
with e as (select user_id as tenant_id, event_id as record_no, ts, event_type from events),
r as (select *, case when record_no % 9 = 0 then 'orphaned' when event_type = 'error' then 'protected' when event_type = 'click' then 'updated' else 'inserted' end as outcome from e)
select tenant_id, outcome, count(distinct case when outcome in ('updated', 'inserted') then event_type else record_no::varchar end)::bigint as n from r group by all""")
def prepared_records(spark, sf_dir):
    """A run's records before they are written: without sources, protected, new, or further evidence."""
    i, none = F.col("event_id"), F.lit(None).cast("timestamp")
    rows = events(spark, sf_dir)
    source = F.struct(i.cast("string").alias("message_id"), times.iso(F.col("ts")).alias("sent_at"), F.lit("s").alias("sender"), F.lit("q").alias("quote"))
    records = rows.select(
        F.col("user_id").cast("string").alias("tenant_id"), F.col("event_type").alias("dedup_key"), i.alias("record_no"), none.alias("occurred_at"), F.array(i.cast("string")).alias("source_message_ids"),
        F.array(source).alias("source_excerpts"), F.lit(1).cast("long").alias("mention_count"), F.array(F.lit("1")).alias("chunk_labels"),
    )
    sent = rows.where("event_id % 9 <> 0").select(F.col("user_id").cast("string").alias("tenant_id"), i.cast("string").alias("id"), F.col("ts").alias("sent_at"))
    stored = rows.where("event_type in ('error', 'click')").select(F.col("user_id").cast("string").alias("tenant_id"), F.col("event_type").alias("dedup_key")).distinct()
    stored = stored.select("*", F.lit(False).alias("pinned"), F.when(F.col("dedup_key") == "error", now()).alias("edited_at"), none.alias("deleted_at"))
    counts = ev.prepared(records, sent, stored)[1]
    return counts.select(F.col("tenant_id").cast("long").alias("tenant_id"), "outcome", "n")

"""Queries on messages: exports, webhooks, ingestion, chunks. Conversations and events stand for the message log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import keys, times
from tidewater.functions import text as x
from tidewater.operators import ingest as ing
from tidewater.operators import joins
from tidewater.operators import sequences as s
from tidewater.plans.reading import events
from tidewater.plans.registry import query, settled
from tidewater.session import table
from tidewater.sources import exports, webhook

_FOLD = "replace(lower({}), 'ß', 'ss')"


def _export(spark, sf_dir):
    """Conversations as lines of exports, a file each: one minute a turn, local time of London in summer."""
    turns = table(spark, sf_dir, "conversations").where("length(text) > 0")
    at = F.timestamp_seconds(F.lit(1_720_000_020) + F.col("conv_id") * 86400 + F.col("turn") * 60)
    head = F.concat(F.date_format(F.from_utc_timestamp(at, "Europe/London"), "dd/MM/yyyy, HH:mm"), F.lit(" - "), F.col("role"), F.lit(": "))
    lines = F.split(F.concat(head, "text"), "\n")
    rows = turns.select(F.col("conv_id").cast("string").alias("file"), "turn", F.posexplode(lines).alias("i", "raw"))
    return rows.select("file", _at(F.col("turn"), F.col("i")), "raw")


def _at(turn, i):
    """Where a line stands: four turns are a block of the file."""
    return F.struct(F.floor(turn / 4).alias("block"), F.struct(turn.cast("long").alias("turn"), i.alias("i")).alias("row")).alias("at")


def _odd_lines(spark, sf_dir):
    """What else stands in each export: a line before all stamps, a notice of the app, and a picture that isn't there."""
    first = F.timestamp_seconds(F.lit(1_720_000_020) + F.col("conv_id") * 86400 - 120)
    head = F.concat(F.date_format(F.from_utc_timestamp(first, "Europe/London"), "dd/MM/yyyy, HH:mm"), F.lit(" - "))
    lines = F.array(F.lit("Exported chat"), F.concat(head, F.lit("Messages and calls are end-to-end encrypted.")), F.concat(head, F.lit("user: \u200e<Media omitted>")))
    talks = table(spark, sf_dir, "conversations").where("length(text) > 0").select("conv_id").distinct()
    return talks.select(F.col("conv_id").cast("string").alias("file"), F.posexplode(lines).alias("i", "raw")).select("file", _at(F.lit(-1), F.col("i")), "raw")


@query(r"""
with t as (select conv_id, turn, role, text from conversations where length(text) > 0)
select conv_id::varchar as file, (row_number() over (partition by conv_id order by turn) - 1)::int as source_ordinal, make_timestamp((1720000020 + conv_id * 86400 + turn * 60) * 1000000) as sent_at,
  role as sender_display_name, left(replace(replace(text, chr(160), ' '), chr(8239), ' '), 8000) as body from t""")
def export_round_trip(spark, sf_dir):
    """Conversations written as chat exports and parsed back."""
    messages, _ = exports.parse(_export(spark, sf_dir), "Europe/London", dayfirst=True, settle=settled)
    return messages.select("file", "source_ordinal", "sent_at", "sender_display_name", "body")


@query(r"""
with t as (select conv_id, turn, role, text, length(text) - length(replace(text, chr(10), '')) + 1 as lines from conversations where length(text) > 0)
select conv_id::varchar as file, (sum(lines) + 3)::bigint as total_lines, (count(*) + 1)::bigint as messages, 1::bigint as system_lines, (sum(lines) - count(*))::bigint as continuations, 1::bigint as unparsed_lines,
  1::bigint as media_placeholders, make_timestamp((1720000020 + conv_id * 86400 - 120) * 1000000) as first_sent_at, make_timestamp(max(1720000020 + conv_id * 86400 + turn * 60) * 1000000) as last_sent_at,
  len(list_distinct(list_append(list(role), 'user')))::int as senders, 'Exported chat' as unparsed from t group by conv_id""")
def parse_report(spark, sf_dir):
    """How the lines of each export were used, who spoke and when."""
    lines = _export(spark, sf_dir).unionByName(_odd_lines(spark, sf_dir))
    messages, kinds = exports.parse(lines, "Europe/London", dayfirst=True, settle=settled)
    found = exports.report(settled(messages), kinds)
    counts = ("total_lines", "messages", "system_lines", "continuations", "unparsed_lines", "media_placeholders")
    return found.select("file", *counts, "first_sent_at", "last_sent_at", F.size("senders").alias("senders"), F.array_join("unparsed_samples", ",").alias("unparsed"))


@query("""
with d as (select conv_id, day(to_timestamp(1720000020 + conv_id * 86400 + turn * 60) at time zone 'Europe/London') as d, month(to_timestamp(1720000020 + conv_id * 86400 + turn * 60) at time zone 'Europe/London') as m
  from conversations where length(text) > 0)
select conv_id::varchar as file, case when max(d) > 12 and max(m) > 12 then 'conflict' when max(d) > 12 then 'day>12' when max(m) > 12 then 'month>12' else 'none' end as evidence,
  'android' as style, false as is_12h, false as has_seconds, true as dayfirst from d group by conv_id""")
def export_sniff(spark, sf_dir):
    return exports.sniff(_export(spark, sf_dir)).select("file", "evidence", "style", "is_12h", "has_seconds", "dayfirst")


@query(f"""
with d as (select doc_id, {_FOLD.format("trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))")} as folded from documents where text is not null)
select min(doc_id) as doc_id, sha256(concat_ws(chr(31), 't', '2024-01-01T00:00', 'system:', folded, '0')) as content_hash, count(*)::bigint as copies from d group by folded""")
def content_hash_dedup(spark, sf_dir):
    """One message of all that say the same, by content hash."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    at = F.lit("2024-01-01 00:00:30").cast("timestamp")
    hashed = docs.select("doc_id", keys.content_hash(F.lit("t"), at, F.lit("system:"), x.fold(F.col("text")), F.lit(0)).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""
select event_id, user_id, event_type, row_number() over (partition by user_id, event_type, ts::date order by event_id) - 1 as occurrence from events""")
def occurrence_ordinal(spark, sf_dir):
    found = s.occurrences(events(spark, sf_dir), [F.col("user_id"), F.col("event_type"), F.to_date("ts")], [F.col("event_id")])
    return found.select("event_id", "user_id", "event_type", F.col("occurrence").cast("long").alias("occurrence"))


def _records(spark, sf_dir):
    """A first upload of conversations' turns, and a second one that overlaps it by half."""
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select(
        (F.col("conv_id") % 7).cast("string").alias("tenant_id"),
        F.lit(None).cast("string").alias("wa_jid"),
        F.lit(None).cast("string").alias("wa_lid"),
        F.initcap("role").alias("display_name"),
        F.timestamp_seconds(F.lit(1_720_000_000) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("sent_at"),
        F.when(F.col("turn") == 3, "").otherwise(F.col("text")).alias("text"),
        F.lit("text").alias("message_type"),
        F.lit("{}").alias("payload"),
        F.when(F.col("turn") % 2 == 0, F.concat_ws("-", F.col("conv_id"), F.col("turn"))).alias("provider_message_id"),
        F.struct("conv_id", "turn").alias("source_ordinal"),
        F.col("conv_id"),
    )
    return rows.where("conv_id % 4 < 3").withColumn("batch", F.lit(1)), rows.where("conv_id % 4 > 1").withColumn("batch", F.lit(2))


@query("""
with r as (select conv_id % 7 as tenant_id, conv_id, turn = 3 or length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) = 0 as empty from conversations),
b as (select 1 as batch, * from r where conv_id % 4 < 3 union all select 2, * from r where conv_id % 4 > 1)
select tenant_id::varchar as tenant_id, batch, count(*)::bigint as received, count(*) filter (empty)::bigint as skipped, count(*) filter (not empty and (batch = 1 or conv_id % 4 = 3))::bigint as inserted,
  count(*) filter (not empty and batch = 2 and conv_id % 4 <> 3)::bigint as duplicates from b group by all""")
def ingest_accounting(spark, sf_dir):
    """Two uploads that overlap: what each brought, what was there already, what was empty."""
    first, second = _records(spark, sf_dir)
    both = first.unionByName(second)
    nobody = spark.createDataFrame([], "tenant_id string, member_id string, display_name string, wa_jid string, wa_lid string, created_at timestamp")
    resolved, _ = ing.resolve(both.select("tenant_id", "wa_jid", "wa_lid", "display_name"), nobody)
    hashed = settled(ing.hashed(both, resolved, [F.col("source_ordinal")], ["batch"]).select("tenant_id", "batch", "sent_at", "content_hash", "provider_message_id", "message_type", "text", "payload"))
    fresh = settled(ing.either_key(hashed, ["tenant_id", "batch"], [F.col("sent_at"), F.col("content_hash")]).where("first"))
    one, two = fresh.where("batch = 1"), fresh.where("batch = 2")
    inserted = one.unionByName(ing.not_stored(two, one).select(*one.columns))
    return ing.accounted(both, inserted, ["tenant_id", "batch"])


@query("""
with recursive o as (select user_id, event_id, floor(value)::bigint as a, case when event_id % 3 > 0 then (props->>'$.k')::int end as b, row_number() over (partition by user_id order by ts, event_id) as k from events),
w as (
  select user_id, event_id, k, [a] as la, case when b is null then [] else [b] end as lb, true as first from o where k = 1
  union all
  select o.user_id, o.event_id, o.k, case when f.ok then list_append(w.la, o.a) else w.la end, case when f.ok and o.b is not null then list_append(w.lb, o.b) else w.lb end, f.ok
  from w join o on o.user_id = w.user_id and o.k = w.k + 1, lateral (select not list_contains(w.la, o.a) and (o.b is null or not list_contains(w.lb, o.b)) as ok) f)
select user_id, event_id, first from w""")
def batch_either_key(spark, sf_dir):
    """The first rows of a batch by either of two keys."""
    rows = events(spark, sf_dir).select("user_id", "event_id", "ts", F.floor("value").cast("long").alias("content_hash"), F.when(F.col("event_id") % 3 > 0, F.get_json_object("props", "$.k")).alias("provider_message_id"))
    return ing.either_key(rows, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "first")


@query("""
select n_regionkey::varchar as tenant_id, s_suppkey as sender, n_name as display_name from supplier join nation on s_nationkey = n_nationkey""")
def resolve_senders(spark, sf_dir):
    """Suppliers write for their nation: from its number under no name of its own, from its hidden number, or under its name in odd letters."""
    nation, n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey"), F.col("s_suppkey")
    number = lambda mark, where: F.when(where, F.concat(F.lit(mark), n.cast("string"), F.lit("@s.net")))
    members = nation.select(
        F.col("n_regionkey").cast("string").alias("tenant_id"), F.concat(F.lit("m"), n.cast("string")).alias("member_id"), F.col("n_name").alias("display_name"),
        number("4470000000", n % 2 == 0).alias("wa_jid"), number("9900000000", n % 3 == 0).alias("wa_lid"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )
    said = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == n)
    by_jid, by_lid = (n % 2 == 0) & (k % 2 == 0), (n % 3 == 0) & (k % 2 == 1)
    odd = F.when(by_jid, "Nobody").when(by_lid, None).when(k % 4 < 2, F.lower("n_name")).otherwise(F.col("n_name"))
    senders = said.select(F.col("n_regionkey").cast("string").alias("tenant_id"), number("4470000000", by_jid).alias("wa_jid"), number("9900000000", by_lid).alias("wa_lid"), odd.alias("display_name"), k.alias("sender"))
    resolved, after = ing.resolve(senders, members)
    asked = resolved.select("member_id", *[F.col(c).alias(f"_{c}") for c in ("tenant_id", "wa_jid", "wa_lid", "display_name")])
    same = senders["tenant_id"] == F.col("_tenant_id")
    for c in ("wa_jid", "wa_lid", "display_name"):
        same = same & senders[c].eqNullSafe(F.col(f"_{c}"))
    met = senders.join(asked, same).select("tenant_id", "sender", "member_id")
    return met.join(after.select("tenant_id", "member_id", "display_name"), ["tenant_id", "member_id"]).select("tenant_id", "sender", "display_name")


@query("""
with recursive o as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as k from events),
w as (
  select user_id, event_id, k, ts as first, ts as prev, 1 as n, 0 as chunk_id from o where k = 1
  union all
  select o.user_id, o.event_id, o.k, case when f.cut then o.ts else w.first end, o.ts, case when f.cut then 1 else w.n + 1 end, case when f.cut then w.chunk_id + 1 else w.chunk_id end
  from w join o on o.user_id = w.user_id and o.k = w.k + 1,
    lateral (select w.n >= 40 or o.ts - w.first > interval 14 day or (w.n >= 20 and o.ts - w.prev >= interval 4 hour) as cut) f)
select user_id, event_id, chunk_id::bigint as chunk_id, n::bigint as chunk_place, 'm' || n::varchar as handle from w""")
def chunk_assignment(spark, sf_dir):
    """Each user's log cut into chunks at quiet gaps, by size and by span."""
    found = s.chunked(events(spark, sf_dir).select("user_id", "event_id", "ts"), ["user_id"], "ts", [F.col("ts"), F.col("event_id")], least=20, most=40)
    return found.select("user_id", "event_id", "chunk_id", "chunk_place", s.handle().alias("handle"))


def _hot(spark, sf_dir, every):
    """Events by tenant: one tenant has those of every so-manieth user, each other user is a tenant."""
    tenant = F.when(F.col("user_id") % every == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id"))
    return events(spark, sf_dir).select(tenant.alias("tenant"), "event_id", "ts")


@query("""
with recursive e as (select case when user_id % 2 = 0 then -1 else user_id end as tenant, event_id, ts from events),
o as (select tenant, event_id, ts, row_number() over w as k, lag(ts) over w as prev from e window w as (partition by tenant order by ts, event_id)),
f as (
  select *, least(k + 200, 1 + max(k) over (partition by tenant order by ts range between current row and interval 14 day following),
    coalesce(min(case when ts - prev >= interval 4 hour then k end) over (partition by tenant order by k rows between 80 following and 199 following), k + 200)) as next from o),
w as (select tenant, k, next, 0 as chunk_id from f where k = 1 union all select f.tenant, f.k, f.next, chunk_id + 1 from w join f on f.tenant = w.tenant and f.k = w.next)
select f.tenant, f.event_id, w.chunk_id::bigint as chunk_id, (f.k - w.k + 1)::bigint as chunk_place from f join w on f.tenant = w.tenant and f.k >= w.k and f.k < w.next""")
def hot_tenant_chunks(spark, sf_dir):
    """Chunks by the limits of the contract where one tenant has half of the log, which goes in pieces."""
    found = s.chunked(_hot(spark, sf_dir, 2), ["tenant"], "ts", [F.col("ts"), F.col("event_id")], piece=1024)
    return found.select("tenant", "event_id", "chunk_id", "chunk_place")


@query("""
with recursive o as (
  select tenant, event_id, ts, row_number() over (partition by tenant order by ts, event_id) as k from (select case when user_id % 5 = 0 then -1 else user_id end as tenant, event_id, ts from events)),
w as (
  select tenant, event_id, k, [ts] as held, true as let_in from o where k = 1
  union all
  select o.tenant, o.event_id, o.k, case when len(f.held) < 2 then list_append(f.held, o.ts) else f.held end, len(f.held) < 2
  from w join o on o.tenant = w.tenant and o.k = w.k + 1, lateral (select list_filter(w.held, lambda t: t > o.ts - interval 15 minute) as held) f)
select tenant, event_id, let_in from w""")
def hot_tenant_admission(spark, sf_dir):
    """At most two in any quarter of an hour where one tenant has a fifth of the log, which is cut where its state is certain."""
    found = s.admitted(_hot(spark, sf_dir, 5), ["tenant"], "ts", [F.col("ts"), F.col("event_id")], 2, 900, piece=256)
    return found.select("tenant", "event_id", "let_in")


@query("""
with o as (select user_id, event_id, ts, (row_number() over w - 1) // 25 as chunk_id, row_number() over w as pos from events window w as (partition by user_id order by ts, event_id)),
st as (select user_id, chunk_id, min(pos) as start, min(ts) as first from o group by all),
c as (select o.user_id, st.chunk_id, o.event_id, row_number() over (partition by o.user_id, st.chunk_id order by o.pos) as place
  from st join o on o.user_id = st.user_id and o.pos < st.start and o.pos >= st.start - 20 and o.ts >= st.first - interval 6 hour)
select user_id, chunk_id::bigint as chunk_id, event_id, 'c' || place::varchar as handle from c""")
def chunk_context(spark, sf_dir):
    """What each chunk may read of the messages before it."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    chunks = events(spark, sf_dir).select("user_id", "event_id", "ts", F.floor(place / 25).cast("long").alias("chunk_id"), (place % 25 + 1).alias("chunk_place"))
    return s.contexts(chunks, ["user_id"], "ts", [F.col("ts"), F.col("event_id")]).select("user_id", "chunk_id", "event_id", "handle")


@query("""
select conv_id, turn, rtrim('[m' || row_number() over (partition by conv_id order by turn)::varchar || '] ' || strftime(to_timestamp(1720000020 + turn * 60) at time zone 'Europe/London', '%a %Y-%m-%d %H:%M') || ' — ' || role || ': '
  || case when turn % 3 = 1 then '[photo] ' else '' end || trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) as line from conversations""")
def transcript_lines(spark, sf_dir):
    """Messages as a model is shown them."""
    turns = table(spark, sf_dir, "conversations").withColumn("chunk_place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    at = F.timestamp_seconds(F.lit(1_720_000_020) + F.col("turn") * 60)
    line = s.transcript_line(s.handle(), F.lit(False), at, "Europe/London", F.col("role"), F.when(F.col("turn") % 3 == 1, "image").otherwise("text"), F.col("text"), F.lit(None).cast("string"), F.lit(False))
    return turns.select("conv_id", "turn", line.alias("line"))


@query("""
select c.conv_id::varchar || '@g.us' as group_external_id, c.conv_id::varchar || '-' || turn::varchar as provider_message_id, '44' || (700000000 + conv_id)::varchar || '@s.net' as sender_wa_jid,
  make_timestamp((1720000000 + turn) * 1000000) as sent_at, text, case when turn % 4 = 2 then 'image' else 'text' end as message_type
from conversations c where role = 'user' and turn % 5 <> 4""")
def webhook_messages(spark, sf_dir):
    """Envelopes as a gateway sends them, told apart and adapted to records."""
    t = F.col("turn")
    seconds = F.lit(1_720_000_000) + t
    stamp = F.when(t % 3 == 0, seconds.cast("string")).when(t % 3 == 1, (seconds * 1000).cast("string")).otherwise(times.iso(F.timestamp_seconds(seconds)))
    payload = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.concat(F.col("conv_id").cast("string"), F.lit("@g.us")).alias("chat_id"),
        stamp.alias("timestamp"),
        (F.col("role") != "user").alias("is_from_me"),
        F.concat(F.lit("+44"), (F.lit(700_000_000) + F.col("conv_id")).cast("string"), F.lit(":3@S.net")).alias("from"),
        F.when(t % 4 != 2, F.col("text")).alias("body"),
        F.when(t % 4 == 2, F.struct(F.col("text").alias("caption"))).alias("image"),
        F.when(t % 5 == 4, "revoked").alias("type"),
    )
    bodies = table(spark, sf_dir, "conversations").select(F.to_json(F.struct(F.lit("message").alias("event"), payload.alias("payload"))).alias("body"))
    return webhook.messages(webhook.checked(bodies)).select("group_external_id", "provider_message_id", "sender_wa_jid", "sent_at", "text", "message_type")


_JOINS = """
with e as (select user_id as grp, event_id, ts, case when event_type in ('signup', 'view') then 'joined' else event_type end as kind from events),
k as (select *, row_number() over (partition by grp order by ts, event_id) = 1 as first from e),
f as (
  select event_id, count(*) over (order by ts range between interval '899.999999' second preceding and current row) as appeared,
    count(*) over (order by ts range between interval '899.999999' second preceding and interval 900 second following) as appeared_later from k where first),
j as (
  select k.grp, k.event_id, k.ts, kind, appeared, appeared_later,
    case when kind <> 'joined' then 'not_a_join' when not first then 'already_known' when appeared > 1 then 'burst_suppressed' when appeared_later > 1 then 'withheld' else 'welcomed' end as outcome
  from k left join f using (event_id))
"""


@query(_JOINS + "select grp, event_id, outcome, appeared, appeared_later from j")
def group_joins(spark, sf_dir):
    """What becomes of each group's events: of those that join, only the ones that turn up alone are welcomed."""
    rows = events(spark, sf_dir).select(F.col("user_id").alias("grp"), "event_id", "ts", F.when(F.col("event_type").isin("signup", "view"), "joined").otherwise(F.col("event_type")).alias("kind"))
    return joins.outcomes(rows, "grp", "ts", "kind", ["event_id"], 900).select("grp", "event_id", "outcome", "appeared", "appeared_later")

"""Read queries: feeds, rollups, reports, windows of time. Events stand for the history, customers for its people."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import money, nested, times
from tidewater.functions import text as x
from tidewater.operators import events as ev
from tidewater.operators import mutations
from tidewater.operators import reading as r
from tidewater.operators import sequences as s
from tidewater.plans.registry import AT, ZONE, folder, now, query, settled, utc
from tidewater.session import table
from tidewater.sources.keyed import KeyedTable


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", utc("ts"))


@query(f"""
with page as (select * from events where event_type <> 'error' and ts < timestamp '{AT}' order by ts desc, event_id desc limit 200)
select event_id, ts::timestamp as ts, user_id, event_type, value, c_name as who,
  (select case when count(*) = 200 then min(ts)::timestamp end from page) as next_before
from page left join customer on user_id = c_custkey""")
def feed_page(spark, sf_dir):
    """A page of a feed: the newest events before a moment with whoever they belong to, and where the next page goes on."""
    page = r.feed(events(spark, sf_dir).where("event_type <> 'error'"), "ts", "event_id", 200, now())
    people = table(spark, sf_dir, "customer")
    found = r.next_before(page, "ts", 200).join(people, F.col("user_id") == people.c_custkey, "left")
    return found.select("event_id", "ts", "user_id", "event_type", "value", F.col("c_name").alias("who"), "next_before")


@query(f"""
select event_id, ts::timestamp as ts, user_id, event_type, c_name as who
from (select * from events where ts > timestamp '{AT}' order by ts, event_id limit 50) left join customer on user_id = c_custkey""")
def upcoming(spark, sf_dir):
    page = r.upcoming(events(spark, sf_dir), "ts", "event_id", now())
    people = table(spark, sf_dir, "customer")
    return page.join(people, page.user_id == people.c_custkey, "left").select("event_id", "ts", "user_id", "event_type", F.col("c_name").alias("who"))


@query("""
select event_id, ts::timestamp as ts, event_type, value, c_name as who from events left join customer on user_id = c_custkey where event_id = 77 and user_id >= 0""")
def single_event(spark, sf_dir):
    one = events(spark, sf_dir).where("event_id = 77 and user_id >= 0")
    people = table(spark, sf_dir, "customer")
    return one.join(people, one.user_id == people.c_custkey, "left").select("event_id", "ts", "event_type", "value", F.col("c_name").alias("who"))


@query("""
select c_custkey, c_name, count(o_orderkey)::bigint as n_messages, min(o_orderdate)::timestamp as first_at, coalesce(max(o_orderdate), timestamp '1990-01-01')::timestamp as last_at
from customer left join orders on c_custkey = o_custkey and o_orderpriority = '1-URGENT' group by all""")
def participant_rollup(spark, sf_dir):
    """How much each person wrote, and when; people who never did are listed too."""
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("1990-01-01").cast("timestamp").alias("created_at"))
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", utc("o_orderdate").alias("at"))
    found = r.rollup(people, orders, F.col("c_custkey") == F.col("o_custkey"), ["c_custkey", "c_name"], "at", "created_at")
    return found.select("c_custkey", "c_name", "n_messages", "first_at", "last_at")


@query(f"""
select user_id, count(*)::bigint as waiting, min(ts)::timestamp as oldest from events where event_type <> 'error' group by user_id
having count(*) >= 60 or min(ts) < timestamp '{AT}' - interval 15 day""")
def due_list(spark, sf_dir):
    return r.due(events(spark, sf_dir).where("event_type <> 'error'"), "user_id", "ts", now(), 60, 15 * 86400)


@query(f"""
select user_id, coalesce(sum(case when ts > timestamp '{AT}' - interval 30 day and ts <= timestamp '{AT}' then value::decimal(10,6) end), 0)::decimal(20,6) as spent,
  coalesce(sum(case when ts > timestamp '{AT}' - interval 30 day and ts <= timestamp '{AT}' then value::decimal(10,6) end), 0) >= 500 as refused
from events group by user_id""")
def rolling_spend(spark, sf_dir):
    calls = events(spark, sf_dir).withColumn("cost", F.col("value").cast("decimal(10,6)"))
    return r.spend(calls, "user_id", "ts", "cost", now(), 30, "500").withColumn("spent", F.col("spent").cast("decimal(20,6)"))


@query("""
select (select count(*) from events where event_type <> 'error')::bigint as n_events, (select count(*) from conversations)::bigint as n_messages,
  (select count(*) from customer)::bigint as n_tenants""")
def session_counts(spark, sf_dir):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    counts = one(table(spark, sf_dir, "events").where("event_type <> 'error'"), "n_events")
    for df, name in ((table(spark, sf_dir, "conversations"), "n_messages"), (table(spark, sf_dir, "customer"), "n_tenants")):
        counts = counts.crossJoin(F.broadcast(one(df, name)))  # one row each
    return counts


@query(f"""
select user_id, count(*) filter (event_type <> 'error' and ts >= timestamp '{AT}')::bigint as extracted, count(*)::bigint as inserted,
  round(count(*) filter (event_type <> 'error' and ts >= timestamp '{AT}') / count(*), 6) as progress from events group by user_id""")
def extracted_count(spark, sf_dir):
    """How far each tenant's import has come."""
    done = F.count_if((F.col("event_type") != "error") & (F.col("ts") >= now()))
    return events(spark, sf_dir).groupBy("user_id").agg(done.alias("extracted"), F.count("*").alias("inserted"), F.round(done / F.count("*"), 6).alias("progress"))


@query(f"""
select event_type, first_seen::timestamp as first_seen, n_seen, last_seen::timestamp as last_seen, last_seen >= timestamp '{AT}' - interval 45 second as within
from (select event_type, min(ts) as first_seen, count(*)::bigint as n_seen, max(ts) as last_seen from events where ts <= timestamp '{AT}' group by event_type)
order by last_seen desc, event_type limit 20""")
def first_seen(spark, sf_dir):
    """When each group was first and last seen: the twenty seen last."""
    sums = events(spark, sf_dir).where(F.col("ts") <= now()).groupBy("event_type").agg(F.min("ts").alias("first_seen"), F.count("*").alias("n_seen"), F.max("ts").alias("last_seen"))
    top = sums.orderBy(F.desc("last_seen"), "event_type").limit(20)
    return top.withColumn("within", F.col("last_seen") >= now() - F.expr("interval 45 seconds"))


@query("""
select o_orderstatus as status, n_nationkey is not null as known, count(*)::bigint as n from orders left join nation on n_nationkey = o_custkey % 40 group by all""")
def routed_groups(spark, sf_dir):
    """Records of groups that a tenant is linked to, and of those that none is."""
    from tidewater.operators.ingest import routed

    records = table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_custkey") % 40).cast("int").alias("group_external_id"))
    links = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group_external_id"), F.col("n_name").alias("tenant_id"))
    known, unknown = routed(records, links)
    rows = known.select(F.col("o_orderstatus").alias("status"), F.lit(True).alias("known")).unionByName(unknown.select(F.col("o_orderstatus").alias("status"), F.lit(False).alias("known")))
    return rows.groupBy("status", "known").agg(F.count("*").alias("n"))


_KIND = "case event_type when 'view' then 'symptom' when 'click' then 'appointment' when 'purchase' then 'medication' else 'note' end"
_REPORT = f"""
with n as (
  select user_id, {_KIND} as kind, 'Event ' || value::decimal(12,2)::varchar as title, case when event_id % 3 = 0 then ' at ' || event_id::varchar || ' ' end as body,
    row_number() over (partition by user_id order by ts desc, event_id desc) as place
  from events where ts >= timestamp '2024-01-05' and ts <= timestamp '{AT}'),
s as (
  select user_id, kind, count(*)::bigint as n, string_agg(title || coalesce(': ' || trim(body), '') || ' [E' || place::varchar || ']', ' ' order by place) as body_markdown,
    array_to_string(list('E' || place::varchar order by place), ',') as handles
  from n where place <= 200 group by user_id, kind)
"""


def _sections(spark, sf_dir):
    rows = events(spark, sf_dir).where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("ts") <= now()))
    kind = F.when(F.col("event_type") == "view", "symptom").when(F.col("event_type") == "click", "appointment").when(F.col("event_type") == "purchase", "medication").otherwise("note")
    rows = rows.select(
        "user_id",
        "event_id",
        "ts",
        kind.alias("kind"),
        times.iso(F.col("ts")).alias("occurred_at"),
        F.concat(F.lit("Event "), F.col("value").cast("decimal(12,2)").cast("string")).alias("title"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" at "), F.col("event_id").cast("string"), F.lit(" "))).alias("body"),
    )
    return r.report(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")])


@query(
    _REPORT
    + """select user_id, kind, case kind when 'symptom' then 'Symptoms and wellbeing' when 'appointment' then 'Appointments' when 'medication' then 'Medication' else 'Care and logistics' end as heading,
  n, body_markdown, handles from s"""
)
def report_by_kind(spark, sf_dir):
    """A section of sentences and citations for each kind of a tenant's events in a period."""
    return _sections(spark, sf_dir).select("user_id", "kind", "heading", "n", "body_markdown", F.array_join("handles", ",").alias("handles"))


@query(
    _REPORT
    + """select user_id, 'This summary covers ' || sum(n)::varchar || ' recorded care events: ' || coalesce(sum(n) filter (kind = 'symptom'), 0)::varchar || ' symptom updates, '
  || coalesce(sum(n) filter (kind = 'appointment'), 0)::varchar || ' appointments, ' || coalesce(sum(n) filter (kind = 'medication'), 0)::varchar || ' medication updates and '
  || coalesce(sum(n) filter (kind = 'note'), 0)::varchar || ' care notes.' as summary,
  (coalesce(sum(n) filter (kind = 'appointment'), 0) = 0)::int + (coalesce(sum(n) filter (kind = 'medication'), 0) = 0)::int as gaps from s group by user_id"""
)
def report_summary(spark, sf_dir):
    return r.summary(_sections(spark, sf_dir), ["user_id"]).select("user_id", "summary", F.size("data_gaps").alias("gaps"))


@query("""
select o_custkey % 50 as run, count(*)::bigint as chunks, sum(o_orderkey % 1000)::bigint as input_tokens, sum(o_orderkey % 77)::bigint as output_tokens, sum(o_totalprice::decimal(12,2))::decimal(22,2) as cost,
  sum(o_orderkey % 9)::bigint as handles_cited, sum(case when o_orderstatus = 'F' then o_orderkey % 3 else 0 end)::bigint as invalid_handles,
  round(coalesce(sum(case when o_orderstatus = 'F' then o_orderkey % 3 else 0 end) / nullif(sum(o_orderkey % 9), 0), 0), 9) as invalid_rate
from orders group by 1""")
def run_totals(spark, sf_dir):
    key = F.col("o_orderkey")
    chunks = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("run"),
        (key % 1000).alias("input_tokens"),
        (key % 77).alias("output_tokens"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("cost"),
        (key % 9).alias("handles_cited"),
        F.when(F.col("o_orderstatus") == "F", key % 3).otherwise(0).alias("invalid_handles"),
        F.create_map("o_orderpriority", F.lit(1)).alias("drops"),
    )
    return r.run_totals(chunks, ["run"])[0].withColumn("invalid_rate", F.round("invalid_rate", 9))


@query("select o_custkey % 50 as run, o_orderpriority as reason, count(*)::bigint as n from orders group by all")
def drops_by_reason(spark, sf_dir):
    chunks = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("run"), F.create_map("o_orderpriority", F.lit(1)).alias("drops"))
    for c in ("input_tokens", "output_tokens", "cost", "handles_cited", "invalid_handles"):
        chunks = chunks.withColumn(c, F.lit(0))
    return r.run_totals(chunks, ["run"])[1]


@query("""
with c as (select conv_id, sum(length(coalesce(text, '')) // 4)::bigint as tokens from conversations group by conv_id),
s as (select count(*)::bigint as chunks, coalesce(sum(tokens + 1400), 0)::bigint as read from c)
select chunks, read, round((read::decimal(18,0) * 5 + chunks * 760 * 30) / 1000000, 4)::decimal(18,4) as cost, greatest(1, round_even(chunks / 4 * 12 / 60, 0))::int as minutes from s""")
def cost_estimate(spark, sf_dir):
    chunks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(x.tokens(F.col("text"))).alias("tokens"))
    return money.estimate(chunks, ("5", "30"))


@query("""
with w as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn desc) as k from conversations where role <> 'system')
select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) as place from w where k <= 2""")
def context_tail(spark, sf_dir):
    """The last turns of each conversation, oldest first."""
    turns = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return r.newest(turns, ["conv_id"], [F.col("turn").desc_nulls_first()], 2, [F.col("turn").asc_nulls_last()])


@query(f"""
with w as (
  select user_id, event_id, ts, value, (props->>'$.k')::int as k,
    row_number() over (partition by user_id order by ts desc, event_id desc) as place
  from events where event_type = 'click' and ts > timestamp '{AT}' - interval 400 day and props->>'$.k' <> '50')
select user_id, event_id, ts::timestamp as ts, k, 'E' || place::varchar as handle from w where place <= 10""")
def open_items(spark, sf_dir):
    """The newest appointments of each tenant that haven't been attended, with their handles."""
    k = F.get_json_object("props", "$.k")
    rows = events(spark, sf_dir).where((F.col("event_type") == "click") & (F.col("ts") > now() - F.expr("interval 400 days")) & (k != "50"))
    top = r.newest(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 10)
    return top.select("user_id", "event_id", "ts", k.cast("int").alias("k"), F.concat(F.lit("E"), F.col("place").cast("string")).alias("handle"))


@query(
    _REPORT
    + f""", h as (select *, case kind when 'symptom' then 1 when 'appointment' then 2 when 'medication' then 3 else 4 end as place,
  case kind when 'symptom' then 'Symptoms and wellbeing' when 'appointment' then 'Appointments' when 'medication' then 'Medication' else 'Care and logistics' end as heading from s)
select user_id, string_agg(heading, '|' order by place) as headings, string_agg(body_markdown, '|' order by place) as bodies, sum(n)::bigint as cited, timestamp '{AT}' as period_end, 'ready' as status from h group by user_id"""
)
def stored_reports(spark, sf_dir):
    """Reports of all tenants, filed twice by the same job and read back."""
    sections = settled(_sections(spark, sf_dir))
    held = KeyedTable(spark, folder(spark), ["user_id", "report_id"], buckets=8)
    for _ in range(2):
        mutations.filed(held, sections, r.summary(sections, ["user_id"]), ["user_id"], F.lit("2024-01-05").cast("timestamp"), now(), "Care summary", now())
    part = lambda f: F.array_join(F.transform("sections", lambda s: s[f]), "|")
    cited = F.size(F.flatten(F.transform("sections", lambda s: s["handles"]))).cast("long")
    return held.read().select("user_id", part("heading").alias("headings"), part("body_markdown").alias("bodies"), cited.alias("cited"), "period_end", "status")


@query(f"""
with p as (select event_id as report_id, user_id, ts as period_end, ts + (event_id % 90) * interval 1 minute as created_at from events)
select report_id, user_id, period_end::timestamp as period_end, created_at::timestamp as created_at from p where period_end between timestamp '2024-01-05' and timestamp '{AT}'""")
def report_list(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("event_id").alias("report_id"), "user_id", F.col("ts").alias("period_end"))
    rows = rows.withColumn("created_at", F.timestamp_micros(F.unix_micros("period_end") + (F.col("report_id") % 90) * 60_000_000))
    rows = rows.where(F.col("period_end").between(F.lit("2024-01-05").cast("timestamp"), now()))
    return rows.orderBy(F.desc("period_end"), F.desc("created_at"), "report_id")


_DAY = f"((ts::timestamp at time zone 'UTC') at time zone '{ZONE}')::date"


@query(f"""
with o as (select user_id, {_DAY} as day, row_number() over w as place, lag({_DAY}) over w as was from events window w as (partition by user_id order by ts desc, event_id desc)),
g as (select *, sum(case when day = was then 0 else 1 end) over (partition by user_id order by place) as run from o)
select user_id, run::bigint as run, day, count(*)::bigint as n, min(place)::int as first_place, max(place)::int as last_place from g group by all""")
def day_runs(spark, sf_dir):
    """A feed's days: consecutive events of one local day, newest first."""
    return r.day_runs(events(spark, sf_dir), ["user_id"], times.local_day(F.col("ts"), ZONE), [F.desc("ts"), F.desc("event_id")])


@query("""
with o as (select *, row_number() over (partition by user_id, lower(trim(event_type)) order by ts desc, event_id desc) as k from events),
f as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as place from o where k = 1 and event_type <> 'error')
select user_id, event_id, event_type as key, place::int as place from f where place <= 3""")
def latest_per_key(spark, sf_dir):
    """What each tenant takes now: the newest word on each medication, unless that is that it stopped."""
    key = F.lower(F.trim("event_type"))
    found = r.latest_per_key(events(spark, sf_dir), ["user_id"], key, [F.desc("ts"), F.desc("event_id")], F.col("event_type") != "error", 3)
    return found.select("user_id", "event_id", "key", "place")


@query("""
with o as (select user_id, (props->>'$.k')::int % 10 as k, ts, event_id, row_number() over (partition by user_id, (props->>'$.k')::int % 10 order by ts desc, event_id desc) as n from events),
f as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as place from o where n = 1)
select user_id, array_to_string(list(k order by place), ',') as recent from f where place <= 5 group by user_id""")
def recent_distinct(spark, sf_dir):
    """The five symptoms named last by each tenant."""
    rows = events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("int") % 10)
    found = r.latest_per_key(rows, ["user_id"], F.col("k"), [F.desc("ts"), F.desc("event_id")])
    named = F.transform(F.array_sort(F.collect_list(F.struct("place", "k"))), lambda p: p["k"].cast("string"))
    return found.groupBy("user_id").agg(F.array_join(named, ",").alias("recent"))


@query("""
select event_type, count(*) filter (list_contains(json_keys(props), 'k'))::bigint as has_k, count(*) filter (list_contains(json_keys(props), 'z'))::bigint as has_z,
  count(*) filter (props->>'$.k' <> '7')::bigint as not_seven, min((props->>'$.k')::int) as least from events group by event_type""")
def json_predicates(spark, sf_dir):
    rows, k = events(spark, sf_dir), F.get_json_object("props", "$.k")
    return rows.groupBy("event_type").agg(
        F.count_if(nested.json_has(F.col("props"), "k")).alias("has_k"), F.count_if(nested.json_has(F.col("props"), "z")).alias("has_z"), F.count_if(k != "7").alias("not_seven"), F.min(k.cast("int")).alias("least")
    )


@query(f"""
with m as (
  select event_id, user_id, ts, case when event_id % 4 = 0 then 'audio' when event_type = 'error' then 'system' else 'text' end as message_type,
    case when event_id % 3 = 0 then 'gateway' else 'export' end as provider, case when event_id % 5 <> 0 then event_id::varchar end as pid,
    event_id % 7 = 0 as marked, case when event_id % 11 = 0 then ts end as extracted_at
  from events)
select event_id, user_id, message_type from m
where extracted_at is null and message_type <> 'system'
  and not (message_type = 'audio' and provider = 'gateway' and pid is not null and not marked and ts > timestamp '{AT}' - interval 300 second)""")
def pending_cursor(spark, sf_dir):
    """Messages to extract from next: not done, not system lines, not waiting for their words."""
    i = F.col("event_id")
    rows = events(spark, sf_dir).select(
        "event_id",
        "user_id",
        F.col("ts").alias("ingested_at"),
        F.when(i % 4 == 0, "audio").when(F.col("event_type") == "error", "system").otherwise("text").alias("message_type"),
        F.when(i % 3 == 0, "gateway").otherwise("export").alias("provider"),
        F.when(i % 5 != 0, i.cast("string")).alias("provider_message_id"),
        F.when(i % 7 == 0, '{"transcribed": null}').otherwise("{}").alias("payload"),
        F.when(i % 11 == 0, F.col("ts")).alias("extracted_at"),
    )
    return r.pending(rows, now()).select("event_id", "user_id", "message_type")


@query("""
with p as (select lang, quality, case when n_chars >= 400 then 1 else 0 end as guess from documents join labels using (doc_id))
select lang, count(*) filter (quality = 1)::bigint as labels, count(*) filter (quality = 1 and guess = 1)::bigint as found, count(*) filter (guess = 1)::bigint as predictions,
  count(*) filter (quality = 1 and guess = 1)::bigint as "right",
  round(coalesce(count(*) filter (quality = 1 and guess = 1) / nullif(count(*) filter (guess = 1), 0), 0), 9) as precision,
  round(coalesce(count(*) filter (quality = 1 and guess = 1) / nullif(count(*) filter (quality = 1), 0), 0), 9) as recall
from p where quality = 1 or guess = 1 group by lang""")
def label_scores(spark, sf_dir):
    """Precision and recall of a guess by length against the labels, by language."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("guess", F.col("n_chars") >= 400)
    labels = rows.where("quality = 1").select("lang", F.col("guess").alias("hit"))
    predictions = rows.where("guess").select("lang", (F.col("quality") == 1).alias("hit"))
    found = ev.precision_recall(labels, predictions, ["lang"])
    return found.select("lang", "labels", "found", "predictions", "right", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("""
with w as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) as a, row_number() over (partition by conv_id order by turn desc) as b from conversations where role <> 'system')
select conv_id, array_to_string(list(turn order by turn) filter (a <= 2), ',') as head, array_to_string(list(turn order by turn) filter (b <= 2), ',') as tail from w group by conv_id""")
def head_tail(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role <> 'system'")
    ends = lambda order, name: r.newest(turns, ["conv_id"], [order], 2).groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list("turn")).cast("array<string>"), ",").alias(name))
    return ends(F.asc("turn"), "head").join(ends(F.desc("turn"), "tail"), "conv_id")


@query("""
with s as (select min(ts) - interval 5 day as low, max(ts) + interval 5 day as high from events)
select o_orderkey, (o_orderdate + interval 24 year)::timestamp as moved from orders, s where o_orderdate + interval 24 year between low and high""")
def date_window(spark, sf_dir):
    """Dates that lie near the span of the messages."""
    span = events(spark, sf_dir).agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("interval 24 years")).cast("timestamp").alias("moved"))
    width = F.expr("interval 5 days")
    near = rows.crossJoin(F.broadcast(span)).where(F.col("moved").between(F.col("low") - width, F.col("high") + width))  # one row
    return near.select("o_orderkey", "moved")


@query("""
with a as (select n_regionkey, n_nationkey, case when n_nationkey % 5 = 0 then 'same' else lower(n_name) end as name from nation),
sure as (select n_regionkey, name, min(n_nationkey) as n_nationkey from a group by all having count(*) = 1),
e as (select n_regionkey, s_suppkey, unnest([n1, n2]) as actor, unnest([1, 2]) as i from
  (select n_regionkey, s_suppkey, 'same' as n1, lower(n_name) as n2 from supplier join nation on s_nationkey = n_nationkey))
select n_regionkey, s_suppkey, arg_min(n_nationkey, i) as n_nationkey from e join sure using (n_regionkey) where e.actor = sure.name group by all""")
def actor_lookup(spark, sf_dir):
    """Who an event is about: the first named person whom no one else of the tenant is named like."""
    nation = table(spark, sf_dir, "nation")
    people = nation.withColumn("name", F.when(F.col("n_nationkey") % 5 == 0, "Same").otherwise(F.col("n_name")))
    named = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", "s_suppkey", F.array(F.lit(" SAME "), "n_name").alias("actors"))
    return r.actors(named, people, ["n_regionkey"], "s_suppkey", "actors", "n_nationkey", x.fold_name(F.col("name")), x.fold_name)


@query("""
select n_regionkey, string_agg(n_name, ', ' order by n_name) as names, (select count(*) from nation b where b.n_regionkey = a.n_regionkey and b.n_nationkey % 5 = 0)::bigint as same from nation a group by n_regionkey""")
def roster(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    twice = r.ambiguous(nation, ["n_regionkey"], F.when(F.col("n_nationkey") % 5 == 0, "same").otherwise(F.lower("n_name")))
    names = r.roster(nation, ["n_regionkey"], "n_name")
    counts = nation.where("n_nationkey % 5 = 0").groupBy("n_regionkey").agg(F.count("*").alias("_n"))
    both = names.join(twice.select("n_regionkey", "n"), "n_regionkey", "left").join(counts, "n_regionkey", "left")
    return both.select("n_regionkey", "names", F.coalesce("n", "_n", F.lit(0)).alias("same"))


@query("""
with c as (select user_id, event_id, (row_number() over (partition by user_id order by ts, event_id) - 1) // 4 as batch, value::decimal(10,2) as cost from events),
b as (select user_id, batch, sum(cost) as cost from c group by all), u as (select user_id, batch, coalesce(sum(cost) over (partition by user_id order by batch rows between unbounded preceding and 1 preceding), 0) as before from b)
select c.user_id, event_id, batch::bigint as batch, before < 150 as processed from c join u using (user_id, batch)""")
def spend_ceiling(spark, sf_dir):
    chunks = events(spark, sf_dir).withColumn("cost", F.col("value").cast("decimal(10,2)"))
    return r.spend_ceiling(chunks, ["user_id"], [F.col("ts"), F.col("event_id")], "cost", F.lit(150)).select("user_id", "event_id", "batch", "processed")


@query("""
select user_id, make_timestamp((epoch_us(ts) // 86400000000) * 86400000000) as window_start, least(count(*), 3)::bigint as attempts, count(*) > 2 as refused from events group by all""")
def tumbling_limiter(spark, sf_dir):
    return s.tumbling(events(spark, sf_dir), ["user_id"], times.window_start(F.col("ts"), 86400), 2)


@query("select event_id, user_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row)::bigint as in_burst from events")
def burst_count(spark, sf_dir):
    return s.bursts(events(spark, sf_dir), ["user_id"], "ts", 3600).select("event_id", "user_id", "in_burst")


@query("""
with recursive o as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as k from events),
w as (
  select user_id, event_id, k, [ts] as held, true as let_in from o where k = 1
  union all
  select o.user_id, o.event_id, o.k, case when len(f.held) < 2 then list_append(f.held, o.ts) else f.held end, len(f.held) < 2
  from w join o on o.user_id = w.user_id and o.k = w.k + 1, lateral (select list_filter(w.held, lambda t: t > o.ts - interval 1 day) as held) f)
select user_id, event_id, let_in from w""")
def sliding_admission(spark, sf_dir):
    """At most two in any day, counting only those let in."""
    found = s.admitted(events(spark, sf_dir), ["user_id"], "ts", [F.col("ts"), F.col("event_id")], 2, 86400)
    return found.select("user_id", "event_id", "let_in")

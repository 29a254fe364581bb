"""Queries on what is written about records: lines, facts, deletions, links, imports, transcripts, answers. Events stand for messages and events."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidewater.functions import keys, lines, nested, times
from tidewater.functions import text as x
from tidewater.operators import calls, mutations, transcripts
from tidewater.operators import events as ev
from tidewater.operators import ingest as ing
from tidewater.operators import reading as r
from tidewater.plans.reading import events
from tidewater.plans.registry import AT, ZONE, folder, now, query, settled
from tidewater.session import table
from tidewater.sources import exports, storage, synthetic
from tidewater.sources.keyed import KeyedTable

_LOCAL = f"((ts at time zone 'UTC') at time zone '{ZONE}')"


@query(f"""
select event_id, ts::timestamp as ts, user_id from events where event_id % 7 <> 0 and ts < timestamp '{AT}' order by ts desc, event_id desc limit 200""")
def live_feed(spark, sf_dir):
    """Deleted events keep their row and aren't read."""
    rows = events(spark, sf_dir).withColumn("deleted_at", F.when(F.col("event_id") % 7 == 0, F.col("ts")))
    return r.feed(rows, "ts", "event_id", 200, now()).select("event_id", "ts", "user_id")


@query("""
select user_id, event_id, row_number() over (partition by user_id order by case when event_id % 4 > 0 then ts end nulls last, 'k' || (event_id % 3)::varchar || '-' || event_id::varchar)::int as place from events""")
def run_order(spark, sf_dir):
    i = F.col("event_id")
    key = F.concat(F.lit("k"), (i % 3).cast("string"), F.lit("-"), i.cast("string"))
    rows = events(spark, sf_dir).select("user_id", "event_id", F.when(i % 4 > 0, F.col("ts")).alias("occurred_at_utc"), key.alias("dedup_key"))
    return r.in_run_order(rows, ["user_id"]).select("user_id", "event_id", "place")


@query("""
with e as (select user_id, case when event_id % 3 = 0 then 'undated' else strftime(ts, '%Y-%m-%d') end as said, 'Event ' || event_id::varchar as title, case when event_id % 2 = 0 then event_type end as detail, event_type as kind from events),
p as (select *, row_number() over (partition by user_id order by (said <> 'undated') desc, said desc, title) as k from e)
select user_id, string_agg('[E' || k::varchar || '] ' || kind || ' ' || said || ' ' || title || coalesce(' — ' || detail, ''), chr(10) order by k) as digest from p where k <= 10 group by user_id""")
def open_digest(spark, sf_dir):
    i = F.col("event_id")
    at = F.when(i % 3 == 0, "undated").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    rows = events(spark, sf_dir).select("user_id", F.col("event_type").alias("kind"), at.alias("occurred_at"), F.concat(F.lit("Event "), i.cast("string")).alias("title"), F.when(i % 2 == 0, F.col("event_type")).alias("detail"))
    return r.open_digest(rows, ["user_id"])


@query(f"""
with e as (select *, case event_id % 4 when 0 then 'exact' when 1 then 'week' when 2 then 'month' else 'unknown' end as grain, repeat('word ', (event_id % 60)::int) as body from events),
d as (select *, case grain when 'exact' then strftime({_LOCAL}, '%Y-%m-%d %H:%M') when 'week' then 'week of ' || strftime({_LOCAL}, '%Y-%m-%d') when 'month' then strftime({_LOCAL}, '%Y-%m') || ' (month only)'
  else strftime({_LOCAL}, '%Y-%m-%d') || ' (date uncertain)' end as day, trim(body) as words from e)
select event_id, day || ' ' || event_type || ': T' || event_id::varchar || case when ts > timestamp '{AT}' then ' (upcoming)' else '' end
  || case when event_id % 2 = 0 then ' [status: done, location: ' || event_type || ']' else ' [status: done]' end
  || case when words = '' then '' when length(words) <= 220 then ' — ' || words else ' — ' || words[:214] || '…' end as line from d""")
def event_lines(spark, sf_dir):
    i = F.col("event_id")
    grain = F.when(i % 4 == 0, "exact").when(i % 4 == 1, "week").when(i % 4 == 2, "month").otherwise("unknown")
    details = F.to_json(F.struct(F.lit("done").alias("status"), F.lit("unknown").alias("severity"), F.when(i % 2 == 0, F.col("event_type")).otherwise("other").alias("location")))
    body = F.repeat(F.lit("word "), (i % 60).cast("int"))
    line = lines.event_line(F.col("event_type"), F.col("ts"), grain, F.concat(F.lit(" T"), i.cast("string")), body, details, ZONE, now())
    return events(spark, sf_dir).select("event_id", line.alias("line"))


@query(f"""
select event_id, strftime({_LOCAL}, '%Y-%m-%d %H:%M') || ' ' || case when event_id % 3 = 0 then 'someone' else 'P' || user_id::varchar end || ': '
  || case when event_id % 4 = 0 then '(' || event_type || ', no text)' else 'said ' || event_id::varchar end as line from events""")
def message_lines(spark, sf_dir):
    i = F.col("event_id")
    sender = F.when(i % 3 != 0, F.concat(F.lit(" P"), F.col("user_id").cast("string")))
    text = F.when(i % 4 != 0, F.concat(F.lit("  said \n"), i.cast("string")))
    return events(spark, sf_dir).select("event_id", lines.message_line(F.col("ts"), sender, text, F.col("event_type"), ZONE).alias("line"))


@query("""
select event_id, case event_type when 'view' then 'Symptom: cough; ' || case when event_id % 2 = 0 then 'Severity: mild; ' else '' end || 'Duration: ' || event_id::varchar || ' days'
  when 'click' then 'Type: GP; With: Dr ' || user_id::varchar || '; Who went: Ann, Bob; Follow-up: call; rest'
  when 'purchase' then 'Medication: m' || user_id::varchar || '; What happened: Dose changed' else 'Category: other' end as facts,
  case event_type when 'view' then 'Symptom' when 'click' then 'Appointment' when 'purchase' then 'Medication' else 'Note' end as label, 'PQ' as initials from events""")
def event_facts(spark, sf_dir):
    """What is shown of an event's details."""
    i, user = F.col("event_id"), F.col("user_id").cast("string")
    kind = F.when(F.col("event_type") == "view", "symptom").when(F.col("event_type") == "click", "appointment").when(F.col("event_type") == "purchase", "medication").otherwise("note")
    symptom = F.to_json(F.struct(F.lit("cough").alias("symptom"), F.when(i % 2 == 0, "mild").otherwise("unknown").alias("severity"), F.lit("").alias("body_site"), F.concat(i.cast("string"), F.lit(" days")).alias("duration_text")))
    appointment = F.to_json(F.struct(F.lit("gp").alias("appointment_kind"), F.concat(F.lit("Dr "), user).alias("provider_name"), F.array(F.lit("Ann"), F.lit("Bob")).alias("attendees"), F.array(F.lit("call"), F.lit("rest")).alias("follow_up_actions")))
    medication = F.to_json(F.struct(F.concat(F.lit("m"), user).alias("medication_name"), F.lit("changed").alias("action"), F.lit("").alias("dose_text")))
    details = F.when(kind == "symptom", symptom).when(kind == "appointment", appointment).when(kind == "medication", medication).otherwise('{"category":"other"}')
    shown = F.array_join(F.transform(lines.facts(kind, details), lambda f: F.concat_ws(": ", f["label"], f["value"])), "; ")
    return events(spark, sf_dir).select("event_id", shown.alias("facts"), lines.kind_label(kind).alias("label"), lines.initials(F.lit("pat quin roe")).alias("initials"))


@query(f"""
with e as (select event_id, ts, case event_id % 5 when 0 then 'exact' when 1 then 'day' when 2 then 'week' when 3 then 'month' else 'unknown' end as grain,
    case when event_id % 11 > 0 then ts + (event_id % 9) * interval 5 hour end as got, case when event_id % 2 = 0 then 'exact' else 'day' end as got_grain from events),
d as (select *, case when grain = 'exact' then {_LOCAL}::date else ts::date end as a, case when got_grain = 'exact' then ((got at time zone 'UTC') at time zone '{ZONE}')::date else got::date end as b from e)
select event_id, grain = 'unknown' or coalesce(case grain when 'month' then date_trunc('month', a) = date_trunc('month', b) when 'week' then date_trunc('week', a) = date_trunc('week', b) else a = b end, false) as agrees from d""")
def date_agreement(spark, sf_dir):
    """Dates agree as precisely as they are said."""
    i = F.col("event_id")
    grain = F.when(i % 5 == 0, "exact").when(i % 5 == 1, "day").when(i % 5 == 2, "week").when(i % 5 == 3, "month").otherwise("unknown")
    got = F.when(i % 11 > 0, F.timestamp_micros(F.unix_micros("ts") + (i % 9) * 18_000_000_000))
    return events(spark, sf_dir).select("event_id", times.date_matches(F.col("ts"), grain, got, F.when(i % 2 == 0, "exact").otherwise("day"), ZONE).alias("agrees"))


_NOTE = """
  select event_id, case when event_id % 3 = 0 then 'Voice' when event_id % 3 = 1 then 'audio' else 'text' end as message_type, case when event_id % 5 = 0 then 'words' end as text,
    case when event_id % 7 = 0 then '{"transcribed": true}' when event_id % 7 = 1 then '{"duration": 900}' else '{"a": [1, "x"]}' end as payload,
    case when event_id % 4 > 0 then 'gateway' else 'export' end as provider, case when event_id % 9 > 0 then event_id::varchar end as pid from events"""


def _notes(spark, sf_dir):
    i = F.col("event_id")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        F.when(i % 3 == 0, "Voice").when(i % 3 == 1, "audio").otherwise("text").alias("message_type"),
        F.when(i % 5 == 0, "words").alias("text"),
        F.when(i % 7 == 0, '{"transcribed": true}').when(i % 7 == 1, '{"duration": 900}').otherwise('{"a": [1, "x"]}').alias("payload"),
        F.when(i % 4 > 0, "gateway").otherwise("export").alias("provider"),
        F.when(i % 9 > 0, i.cast("string")).alias("provider_message_id"),
    )


@query(f"""
with m as ({_NOTE})
select event_id as id, case when message_type = 'text' then 'not_audio' when text is not null then 'already_has_text' when event_id % 7 = 0 then 'already_transcribed'
  when provider <> 'gateway' or pid is null then 'no_downloadable_media' when event_id % 7 = 1 then 'too_long' end as why from m""")
def transcription_gate(spark, sf_dir):
    return _notes(spark, sf_dir).select("id", transcripts.skip_reason().alias("why"))


@query(f"""
with m as ({_NOTE})
select event_id as id, case when text is null and event_id % 6 > 1 then 'heard ' || event_id::varchar else text end as text,
  case when text is null and event_id % 6 > 1 then 'true' else json_extract_string(payload, '$.transcribed') end as transcribed,
  case when text is null and event_id % 6 > 1 then 'm' end as model, json_extract_string(payload, '$.a[1]') as kept, json_extract_string(payload, '$.duration') as duration from m""")
def transcripts_written(spark, sf_dir):
    """Words that came back, laid into messages that have none; what else a payload says stays."""
    i = F.col("id")
    said = _notes(spark, sf_dir).where(i % 6 > 0).select("id", F.when(i % 6 == 1, "  ").otherwise(F.concat(F.lit(" heard "), i.cast("string"))).alias("words"), F.lit("m").alias("model"), F.lit(3.0).alias("billed_seconds"), F.lit(None).cast("double").alias("duration_seconds"))
    done = transcripts.written_down(_notes(spark, sf_dir), said)
    path = lambda p: F.get_json_object("payload", p)
    return done.select("id", "text", path("$.transcribed").alias("transcribed"), path("$.transcription.model").alias("model"), path("$.a[1]").alias("kept"), path("$.duration").alias("duration"))


@query("""
with links as (select c_custkey::varchar as tenant_id, 'g' || c_custkey::varchar || '@g.us' as g from customer where c_custkey % 3 = 0),
w as (select o_custkey::varchar as tenant_id, o_custkey as k, 'g' || (o_custkey - o_custkey % 2)::varchar || case when o_custkey % 7 = 0 then '@s' else '@g.us' end as g, min(o_orderdate)::timestamp as asked_at from orders group by all),
f as (select w.*, o.tenant_id as owner, h.g as had, row_number() over (partition by w.g order by asked_at, w.tenant_id) as r from w left join links o on o.g = w.g left join links h on h.tenant_id = w.tenant_id)
select tenant_id, g as group_external_id, case when k % 7 = 0 then 'not_a_group' when owner = tenant_id then 'unchanged' when owner is not null or r > 1 then 'conflict' when had is not null then 'moved' else 'linked' end as outcome from f""")
def linked_groups(spark, sf_dir):
    """Tenants ask for groups: theirs already, free, taken, or none at all."""
    name = lambda k: F.concat(F.lit("g"), k.cast("string"), F.lit("@g.us"))
    key = F.col("o_custkey")
    links = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("tenant_id"), name(F.col("c_custkey")).alias("group_external_id"))
    group = F.when(key % 7 == 0, F.concat(F.lit(" g"), (key - key % 2).cast("string"), F.lit("@s"))).otherwise(name(key - key % 2))
    wanted = table(spark, sf_dir, "orders").groupBy(key.cast("string").alias("tenant_id"), group.alias("group_external_id")).agg(F.min(F.col("o_orderdate").cast("timestamp")).alias("asked_at"))
    return mutations.linked(links, wanted)[1].select("tenant_id", "group_external_id", "outcome")


@query("""
with p as (select o_custkey as import_id, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderstatus, c := o_orderkey)) as status, count(*) from orders group by o_custkey)
select c_custkey as import_id, coalesce(p.status, 'importing') as status from customer left join p on p.import_id = c_custkey""")
def import_status(spark, sf_dir):
    """What became of each import, by the last word on it."""
    imports = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("import_id"), F.lit("importing").alias("status"), F.lit(0).alias("inserted_count"))
    progress = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("import_id"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("inserted_count"))
    return mutations.advanced(imports, progress).select("import_id", "status")


@query("""
select user_id as tenant_id, sha256(event_type) as sha256, bool_or(event_id % 2 = 0) as known from events group by all""")
def known_uploads(spark, sf_dir):
    """Files that a tenant has imported before are known by their hash."""
    rows = events(spark, sf_dir).select(F.col("user_id").alias("tenant_id"), F.sha2("event_type", 256).alias("file_sha256"), "event_id")
    uploads = rows.select("tenant_id", F.col("file_sha256").alias("sha256")).distinct()
    return storage.already_imported(uploads, rows.where("event_id % 2 = 0"))


@query("""
with l as (select 'c' || (user_id % 50)::varchar as file, '[15/01/2024, 10:00:00] A: ' || event_id::varchar as raw from events)
select file, sum(strlen(raw) + 1)::bigint as n_bytes, count(*)::bigint as n_messages, case when sum(strlen(raw) + 1) > 6000 then 'bytes' when count(*) > 190 then 'messages' end as refusal from l group by file""")
def export_limits(spark, sf_dir):
    raw = F.concat(F.lit("[15/01/2024, 10:00:00] A: "), F.col("event_id").cast("string"))
    found = events(spark, sf_dir).select(F.concat(F.lit("c"), (F.col("user_id") % 50).cast("string")).alias("file"), raw.alias("raw"))
    return exports.limits(found, 6000, 190)


@query("""
select event_id, case when event_id % 3 = 0 then 'mild' when event_id % 3 = 1 then null else 'severe' end as severity, case when event_id % 4 > 0 then event_type end as site from events""")
def tolerant_details(spark, sf_dir):
    """Details of closed vocabularies: what isn't in them is left out, with keys that nobody knows."""
    i = F.col("event_id")
    raw = F.to_json(F.struct(F.when(i % 3 == 0, "mild").when(i % 3 == 1, "awful").otherwise("severe").alias("severity"), F.when(i % 4 > 0, F.col("event_type")).alias("site"), F.lit(1).alias("else")))
    d = nested.tolerant(raw, "severity string, site string", {"severity": ("mild", "moderate", "severe", "unknown")})
    return events(spark, sf_dir).select("event_id", d["severity"].alias("severity"), d["site"].alias("site"))


@query("""
with q as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as k, value::decimal(10,2) as cost from events),
s as (select user_id, sum(case when event_id % 5 = 0 then value::decimal(10,2) else 0 end) as spent from events group by user_id)
select event_id, coalesce(spent, 0) + coalesce(sum(cost) over (partition by user_id order by k rows between unbounded preceding and 1 preceding), 0) < 300 as allowed from q left join s using (user_id)""")
def budget_guard(spark, sf_dir):
    """Requests are refused once what a tenant has spent, and its requests before, reach its limit."""
    rows = events(spark, sf_dir).withColumn("cost", F.col("value").cast("decimal(10,2)"))
    requests = ev.numbered(rows, ["user_id"], [F.col("ts"), F.col("event_id")], "request_no").select("event_id", "user_id", "cost", "request_no")
    spent = rows.groupBy("user_id").agg(F.sum(F.when(F.col("event_id") % 5 == 0, F.col("cost")).otherwise(0)).alias("spent"))
    return calls.guarded(requests, spent, "user_id", "cost", "300").select("event_id", "allowed")


@query("""
select event_id, event_id % 3 = 0 as separate, case when event_id % 3 > 0 then 'T ' || event_id::varchar end as title, case when event_id % 3 > 0 then 'a,b,c' end as quotes from events""")
def paid_merges(spark, sf_dir):
    """Two mentions of one event go to a model, here one that answers by rule; what they cite is put together."""

    def call(request: dict) -> dict:
        asked = json.loads(request["prompt"].split("<new>")[1].split("</new>")[0])
        n = int(asked["title"])
        body = "  different events: no" if n % 3 == 0 else "one"
        return {"output": json.dumps({"title": f"T {n}", "body": body, "quotes": ["made up"]}), "input_tokens": 1}

    event = lambda title, *quotes: F.struct(title.alias("title"), F.lit("b").alias("body"), F.array(*[F.lit(q) for q in quotes]).alias("quotes"))
    pairs = events(spark, sf_dir).select("event_id", event(F.lit("old"), "a", "b").alias("existing"), event(F.col("event_id").cast("string"), "b", "c").alias("incoming"))
    return calls.settled(pairs, call, "Are these one event?").select("event_id", "separate", "merged.title", F.array_join("merged.quotes", ",").alias("quotes"))


@query("""
with n as (select conv_id, turn, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat_ws('|', conv_id::varchar, turn::varchar, coalesce(role, ''), coalesce(text, '')))) as h from conversations)
select conv_id, turn, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', 1 + (('0x' || h[17:17])::int & 3), 1) || h[18:20] || '-' || h[21:32] as id from n""")
def message_ids(spark, sf_dir):
    """Identifiers of messages that come without one, from what they are: the same whenever they are worked out."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    name = F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), blank("role"), blank("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", keys.name_uuid(F.lit("6ba7b810-9dad-11d1-80b4-00c04fd430c8"), name).alias("id"))


@query("""
select c_custkey, c_custkey as lock_of, length(c_name) as n from customer""")
def hidden_addresses(spark, sf_dir):
    """Addresses under a keyed hash, and numbers to lock by: the same for the same name, different for others."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", keys.keyed_hash(b"secret")(F.col("c_name")).alias("h"), keys.lock_key(F.col("c_name")).alias("l"))
    once = rows.groupBy("h").agg(F.min("c_custkey").alias("lock_of"), F.count_distinct("l").alias("m"))
    return rows.join(once.where("m = 1"), "h").where("length(h) = 32").select("c_custkey", "lock_of", F.char_length("c_name").alias("n"))


@query("select 'chat-' || c_custkey::varchar as file, 10::bigint as messages, true as as_made from customer")
def synthetic_chats(spark, sf_dir):
    """A chat for each customer, made from a seed, parses to what it was made of."""
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("chat-"), F.col("c_custkey").cast("string")).alias("file"))
    found, made = synthetic.chats(files, 10, 7)
    messages, _ = exports.parse(found, "UTC", dayfirst=True, settle=settled)
    back = messages.select("file", "source_ordinal", F.col("sender_display_name").alias("_sender"), F.col("text").alias("_text"), F.col("sent_at").alias("_at"))
    same = (F.col("_sender") == F.col("sender")) & (F.col("_text") == F.col("text")) & (F.col("_at") == F.col("sent_at"))
    return made.join(back, ["file", "source_ordinal"], "left").groupBy("file").agg(F.count("*").alias("messages"), F.bool_and(F.coalesce(same, F.lit(False))).alias("as_made"))


@query(f"""
select '{{"id":' || event_id::varchar || ',"occurred_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","kind":"' || event_type || '","who":' || coalesce('"' || c_name || '"', 'null') || '}}' as body
from (select * from events where ts < timestamp '{AT}' order by ts desc, event_id desc limit 200) left join customer on user_id = c_custkey""")
def feed_bodies(spark, sf_dir):
    """A page of a feed as it is sent."""
    page = r.feed(events(spark, sf_dir), "ts", "event_id", 200, now())
    people = table(spark, sf_dir, "customer")
    return r.as_json(page.join(people, F.col("user_id") == people.c_custkey, "left"), {"event_id": "id", "ts": "occurred_at", "event_type": "kind", "c_name": "who"})


@query("select 'human:' || event_id::varchar as dedup_key, true as pinned, 0 as n from events")
def entered_events(spark, sf_dir):
    found = mutations.entered(events(spark, sf_dir))
    return found.select("dedup_key", "pinned", F.size("source_message_ids").alias("n"))


@query(f"""select o_orderkey, ((o_orderdate + interval 9 hour) at time zone '{ZONE}') at time zone 'UTC' as at from orders""")
def wall_clocks(spark, sf_dir):
    """Times as clocks of a zone show them, as instants."""
    shown = F.col("o_orderdate") + F.expr("interval 9 hours")
    return table(spark, sf_dir, "orders").select("o_orderkey", times.from_wall_clock(shown, ZONE).alias("at"))


@query("""
with a as (select event_id, row_number() over (order by ts, event_id) as number from events),
b as (select event_id, row_number() over (order by event_id) as number from events)
select b.event_id, b.number, '{"said": ' || a.event_id::varchar || '}' as response from b join a using (number)""")
def replayed_run(spark, sf_dir):
    """A run's answers, recorded in the order of their asking, answer the same number of requests of another run, which asks nobody."""
    rows = events(spark, sf_dir).select("event_id", "ts", F.col("event_id").cast("string").alias("prompt"))
    asked = calls.called(rows, lambda request: {"output": json.dumps({"said": int(request["prompt"])})})
    kept = calls.record(asked, [F.col("ts"), F.col("event_id")], folder(spark))
    return calls.replayed(rows, kept, [F.col("event_id")]).select("event_id", "number", "response")


@query("""
with q as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as k, 1 + event_id % 3 as cost from events),
r as (select *, coalesce(sum(cost) over (partition by user_id order by (k - 1) // 4 range between unbounded preceding and 1 preceding), 0) as before from q)
select event_id, case when user_id % 10 = 0 then 'budget' when before < 14 then 'completed' else 'spend_cap' end as fate from r""")
def spending_runs(spark, sf_dir):
    """Each user's requests go out four at a time until a run has spent its limit by the audit; users who have spent the month's aren't begun."""
    requests = ev.numbered(events(spark, sf_dir), ["user_id"], [F.col("ts"), F.col("event_id")], "request_no")
    requests = settled(requests.select("event_id", "user_id", "request_no", F.col("event_id").cast("string").alias("prompt")))
    spent = requests.select("user_id", F.when(F.col("user_id") % 10 == 0, 15).otherwise(14).cast("decimal(10,2)").alias("spent")).distinct()
    audit = KeyedTable(spark, folder(spark), ["user_id", "request_no"], buckets=8)
    call = lambda request: {"output": "{}", "input_tokens": 1_000_000 * (1 + int(request["prompt"]) % 3)}
    done, left = calls.called_within(requests, ["user_id"], "request_no", call, audit, "14", "m", {"m": ("1", "1")}, spent)
    return done.select("event_id", F.col("status").alias("fate")).unionByName(left.select("event_id", F.col("reason").alias("fate")))


@query("select conv_id, turn, coalesce(text, '') as body, coalesce(role, '') as deep, 'xy' as half from conversations")
def storable_payloads(spark, sf_dir):
    """Payloads with NULs and halves of characters at any depth, cleaned as they are."""
    nul, half = F.lit("\x00"), '{"half":"x\\ud83d\\u0000y",'
    made = F.struct(F.concat(nul, F.coalesce("text", F.lit("")), nul).alias("body"), F.array(F.struct(F.concat(F.coalesce("role", F.lit("")), nul).alias("deep"))).alias("list"))
    payload = x.storable_json(F.concat(F.lit(half), F.substring(F.to_json(made), 2, 2**31 - 1)))
    at = lambda path: F.get_json_object("p", path)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", payload.alias("p"))
    return rows.select("conv_id", "turn", at("$.body").alias("body"), at("$.list[0].deep").alias("deep"), at("$.half").alias("half"))


@query("""
select (c_nationkey % 2)::varchar as tenant_id, c_custkey as sender, c_name as display_name, c_custkey % 3 = 2 as is_new from customer""")
def people_by_components(spark, sf_dir):
    """Customers write from their number, under their name in odd letters, or for the first time, where two tenants share them all."""
    k, tenant = F.col("c_custkey"), (F.col("c_nationkey") % 2).cast("string").alias("tenant_id")
    jid = F.concat(F.lit("44"), (k + 7_000_000_000).cast("string"), F.lit("@s.net"))
    people = table(spark, sf_dir, "customer")
    members = people.where(k % 3 != 2).select(tenant, k.cast("string").alias("member_id"), F.col("c_name").alias("display_name"), F.when(k % 3 == 0, jid).alias("wa_jid"), F.lit(None).cast("string").alias("wa_lid"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    said = people.select(tenant, F.when(k % 3 == 0, jid).alias("wa_jid"), F.lit(None).cast("string").alias("wa_lid"), F.when(k % 3 == 0, "Nobody").when(k % 3 == 1, F.upper("c_name")).otherwise(F.col("c_name")).alias("display_name"), k.alias("sender"))
    resolved, after = ing.resolve(said.drop("sender"), members, most=64)
    resolved = resolved.withColumnRenamed("tenant_id", "t").withColumnRenamed("wa_jid", "j").select("t", "j", F.col("display_name").alias("d"), "member_id", "is_new")
    met = said.join(resolved, (F.col("tenant_id") == F.col("t")) & F.col("wa_jid").eqNullSafe(F.col("j")) & (F.col("display_name") == F.col("d")))
    return met.select("tenant_id", "sender", "member_id", "is_new").join(after.select("tenant_id", "member_id", "display_name"), ["tenant_id", "member_id"]).select("tenant_id", "sender", "display_name", "is_new")

"""Queries that put the functions to whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import keys, money, nested, times
from tidewater.functions import text as x
from tidewater.functions import vocabulary as v
from tidewater.plans.reading import events
from tidewater.plans.registry import ZONE, now, query
from tidewater.session import table

_TRIM = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query("""
select doc_id, (round(greatest(n_chars - n_chars // 3, 0)::decimal(18,1) * 5 + (n_chars // 3)::decimal(16,1) * 0.5 + (n_chars % 500)::decimal(18,1) * 30, 0) / 1000000)::decimal(10,6) as cost,
  n_chars // 4 as tokens from documents""")
def token_cost(spark, sf_dir):
    n = F.col("n_chars")
    third = F.floor(n / 3)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", money.token_cost(F.lit("gpt-5.5-2026-04-23"), n, third, n % 500, v.TOKEN_PRICES).alias("cost"), F.floor(n / 4).cast("long").alias("tokens"))


@query("""
select doc_id, round((n_chars % 400)::decimal(14,3) / 60 * 0.003, 6)::decimal(10,6) as cost, n_chars * 8 / 16000 as seconds, ceil(n_chars / 120)::bigint as chunks from documents""")
def audio_cost(spark, sf_dir):
    docs, n = table(spark, sf_dir, "documents"), F.col("n_chars")
    return docs.select("doc_id", money.audio_cost(F.lit("gpt-4o-mini-transcribe"), n % 400).alias("cost"), money.audio_seconds(n).alias("seconds"), money.chunk_count(n).alias("chunks"))


@query(f"""
select doc_id, sha256(replace(lower({_TRIM.format("text")}), 'ß', 'ss')) as folded, rtrim(rtrim(left(regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g'), 80), ' ' || chr(9) || chr(10) || chr(13)), '.') as title,
  length(coalesce(text, '')) // 4 as tokens from documents""")
def text_folds(spark, sf_dir):
    docs, text = table(spark, sf_dir, "documents"), F.col("text")
    return docs.select("doc_id", F.when(text.isNotNull(), F.sha2(x.fold(text), 256)).alias("folded"), x.clamp_title(text).alias("title"), x.tokens(text).alias("tokens"))


@query("""
select c_custkey, '44' || (7000000 + c_custkey)::varchar || '@s.whatsapp.net' as address, '44' || (7000000 + c_custkey)::varchar as digits,
  'mrs-' || lower(replace(c_name, '#', '-')) as slug, 'human:' || c_custkey::varchar as human_key, left(sha256(c_custkey::varchar), 32) as pseudonym from customer""")
def identity_functions(spark, sf_dir):
    key = F.col("c_custkey")
    raw = F.concat(F.lit(" +44"), (key + 7_000_000).cast("string"), F.lit(":12@S.WhatsApp.net "))
    title = F.concat(F.lit("Dr. Mrs_"), F.col("c_name"), F.lit("!"))
    return table(spark, sf_dir, "customer").select("c_custkey", x.address(raw).alias("address"), x.digits_of(raw).alias("digits"), x.slug(title).alias("slug"), keys.human_key(key).alias("human_key"), keys.pseudonym(key).alias("pseudonym"))


@query(f"""
with e as (select *, ((ts at time zone 'UTC') at time zone '{ZONE}') as l, event_id % 5 as g from events)
select event_id, case g when 0 then strftime(l, '%Y-%m-%d %H:%M') when 1 then strftime(l, '%Y-%m-%d') when 2 then 'week of ' || strftime(l, '%Y-%m-%d') when 3 then strftime(l, '%Y-%m') || ' (month only)'
    else strftime(l, '%Y-%m-%d') || ' (date uncertain)' end as shown,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, strftime(ts, '%Y-%m-%dT%H:%M') as minute, strftime(ts, '%G-W%V') as week, datediff('day', date '2024-01-16', l::date)::int as countdown,
  case datediff('day', date '2024-01-16', l::date) when 0 then 'Today' when -1 then 'Yesterday' else strftime(l, '%A %-d %B %Y') end as heading,
  make_timestamp((epoch_us(ts) // 900000000) * 900000000) as window_start, greatest(1, (epoch_us(ts) // 900000000) * 900 + 900 - epoch_us(ts) // 1000000)::bigint as retry_after from e""")
def time_renderings(spark, sf_dir):
    i, ts = F.col("event_id") % 5, F.col("ts")
    grain = F.when(i == 0, "exact").when(i == 1, "day").when(i == 2, "week").when(i == 3, "month").otherwise("unknown")
    return events(spark, sf_dir).select(
        "event_id",
        times.shown(ts, grain, ZONE).alias("shown"),
        times.iso(ts).alias("iso"),
        times.minute(ts).alias("minute"),
        times.iso_week(ts).alias("week"),
        times.countdown(ts, now(), ZONE).alias("countdown"),
        times.day_heading(ts, now(), ZONE).alias("heading"),
        times.window_start(ts, 900).alias("window_start"),
        times.retry_after(ts, 900).alias("retry_after"),
    )


@query("""
select event_id, case event_id % 6 when 5 then null else date_trunc('second', ts) end as sent_at,
  case when n > 6000 then n / 1000 when n > 0 then n end as seconds from (select *, case when event_id % 2 = 0 then value else value * 10000 end as n from events)""")
def sniffed_values(spark, sf_dir):
    """Instants and durations whose unit has to be guessed."""
    i, ts = F.col("event_id"), F.col("ts")
    raw = F.when(i % 6 == 0, F.unix_timestamp(ts).cast("string")).when(i % 6 == 1, (F.unix_timestamp(ts) * 1000).cast("string")).when(i % 6 == 2, times.iso(ts))
    raw = raw.when(i % 6 == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(i % 6 == 4, F.concat(F.date_format(ts + F.expr("interval 1 hour"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:00"))).otherwise("soon")
    payload = F.when(i % 2 == 0, F.to_json(F.struct(F.col("value").alias("duration")))).otherwise(F.to_json(F.struct(F.struct((F.col("value") * 10000).alias("seconds")).alias("audio"))))
    return events(spark, sf_dir).select("event_id", times.sniffed(raw).alias("sent_at"), times.duration(payload).alias("seconds"))


#: Words that each kind of emergency may be told in, in the order of ``vocabulary.EMERGENCIES``.
_CALLS = (
    "is unresponsive", "was unconscious", "passed out", "collapsed", "isn't breathing", "is struggling to breathe", "has chest pain", "has pain in her chest", "banged her head", "has a head injury",
    "had a seizure", "is convulsing", "is turning blue", "is bleeding badly", "'s mouth has dropped", "is slurring her speech", "- can't wake her", "- cannot get her up", "took too many of them", "took an overdose",
)


@query(f"""
select doc_id, coalesce(regexp_matches(text, $$(?i){"|".join(v.EMERGENCIES)}$$), false) as emergency_like from documents
union all select -i, true from range(1, {len(v.EMERGENCIES) + 1}) t(i)""")
def emergencies(spark, sf_dir):
    """Texts in which help is called for; and a phrase of each kind, by negative numbers."""
    said = [(-i, f"so mum {p} just now".upper()) for i, p in enumerate(_CALLS, 1)]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(said, "doc_id long, text string"))
    return docs.select("doc_id", x.emergency(F.col("text")).alias("emergency_like"))


@query("""
select p_partkey, case when p_size % 5 = 0 then 'cancelled' when p_size % 5 = 1 then 'missed' when p_size % 2 = 0 then 'attended' else 'scheduled' end as status,
  case p_size % 4 when 0 then 'photo.jpg' when 1 then 'a-b.pdf' end as filename, case p_size % 4 when 0 then 'image' when 1 then 'document' when 2 then 'video' end as media,
  case p_size % 4 when 0 then 'see  ' || p_name when 1 then p_name when 2 then '' end as caption from part""")
def media_and_status(spark, sf_dir):
    """What is attached to a message, and what has become of an appointment."""
    n, name = F.col("p_size"), F.col("p_name")
    said = F.when(n % 5 == 0, "They CANCELLED it").when(n % 5 == 1, "We didn't go").otherwise("With the nurse")
    body = F.when(n % 4 == 0, F.concat(F.lit("see <attached: photo.jpg> "), name)).when(n % 4 == 1, F.concat(F.lit("a-b.pdf (file attached)\n"), name)).when(n % 4 == 2, "\u200e<Video omitted>").otherwise(name)
    m = x.media(x.visible(body))
    status = nested.appointment_status(name, said, F.when(n % 2 == 0, "fine"))
    rows = table(spark, sf_dir, "part").select("p_partkey", status.alias("status"), m.alias("m"))
    return rows.select("p_partkey", "status", F.col("m.filename").alias("filename"), F.col("m.type").alias("media"), F.col("m.caption").alias("caption"))


@query("""
select c_custkey, c_custkey % 4 <> 3 as spoken_to, 'how is ' || lower(c_mktsegment) || '?' as question, 'see  or ' || c_name as reply from customer""")
def mentions(spark, sf_dir):
    """Whether a message speaks to the assistant, by number, list or name; and the question it asks."""
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, "@447700900123 hello").when(k % 4 == 1, "Hi @Helper!").otherwise("at 5@home")
    payload = F.when(k % 4 == 2, '{"context": {"mentionedJid": ["447700900123:2@s.net"]}}').otherwise('{"note": ["447700900123"]}')
    asked = F.concat(F.lit(" Helper, how is  "), F.lower("c_mktsegment"), F.lit(" , helper?"))
    reply = F.concat(F.lit("see https://evil.example/x or "), F.col("c_name"))
    own = F.lit("+44 7700 900123:7@s.whatsapp.net")
    return table(spark, sf_dir, "customer").select("c_custkey", x.mentions(text, payload, own, "helper").alias("spoken_to"), x.without_mentions(asked, "helper").alias("question"), x.without_links(reply).alias("reply"))


@query("""
select o_orderkey, case when o_orderstatus = 'F' then 'b' else 'a' end as v, o_orderkey % 3 as w, 'x,y,z' as united, (3 + o_orderkey % 3)::bigint as mentions, '1,3,2' as quotes from orders""")
def nested_values(spark, sf_dir):
    """Objects merged, lists united in order, excerpts of two runs put together."""
    k = F.col("o_orderkey")
    patch = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('{"v": "b", "w": "'), (k % 3).cast("string"), F.lit('"}'))).otherwise(F.concat(F.lit('{"w": "'), (k % 3).cast("string"), F.lit('"}')))
    merged = nested.json_merge(F.lit('{"v": "a", "w": "9"}'), patch)
    united = nested.ordered_union(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z")))
    one = lambda q, at: F.struct(F.lit("m").alias("message_id"), F.lit(at).alias("sent_at"), F.lit(q).alias("quote"))
    quotes = nested.merged_excerpts(F.array(one("1", "2024-01-01"), one("2", "2024-03-01")), F.array(one("2", "2024-01-01"), one("3", "2024-02-01")))
    counts = nested.mention_count(F.array(F.struct(F.lit(3).cast("long").alias("mention_count")), F.struct((k % 3).alias("mention_count"))))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", merged["v"].alias("v"), merged["w"].cast("long").alias("w"), F.array_join(united, ",").alias("united"), counts.alias("mentions"), F.array_join(F.transform(quotes, lambda q: q["quote"]), ",").alias("quotes")
    )

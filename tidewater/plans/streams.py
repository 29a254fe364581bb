"""Queries on streams: events arrive as files, and each query takes all there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans.registry import folder, query, utc
from tidewater.session import table
from tidewater.plans.messages import _JOINS
from tidewater.streaming import flows
from tidewater.streaming import joins


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arriving(spark, sf_dir, "events").withColumn("ts", utc("ts"))


@query("""
with w as (select user_id, make_timestamp((epoch_us(ts) // 86400000000) * 86400000000) as window_start from events)
select user_id, window_start, least(count(*), 3)::bigint as attempts, count(*) > 2 as refused from w
where window_start + interval 1 day <= (select max(ts) from events) - interval 1 hour group by all""")
def stream_tumbling(spark, sf_dir):
    """Hits of each user and day, once the day is over."""
    return flows.drained(flows.tumbling(events(spark, sf_dir), ["user_id"], "ts", 86400, 2, "1 hour"), folder(spark), "tumbling")


@query("select user_id, count(distinct event_type)::bigint as kinds from events group by user_id")
def stream_without_replays(spark, sf_dir):
    """Records that a source sends again are taken once."""
    rows = events(spark, sf_dir).select("user_id", "event_type", "ts")
    once = flows.drained(flows.without_replays(rows, ["user_id", "event_type"], "ts", "60 days"), folder(spark), "replays")
    return once.groupBy("user_id").agg(F.count("*").alias("kinds"))


@query("select user_id, 1::bigint as n from events group by user_id")
def stream_first_seen(spark, sf_dir):
    seen = flows.drained(flows.first_seen(events(spark, sf_dir).select("user_id"), "user_id"), folder(spark), "first")
    return seen.groupBy("user_id").agg(F.count("*").alias("n"))


@query("""
with recursive o as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as k from events),
w as (
  select user_id, event_id, k, [ts] as held, true as let_in from o where k = 1
  union all
  select o.user_id, o.event_id, o.k, case when len(f.held) < 2 then list_append(f.held, o.ts) else f.held end, len(f.held) < 2
  from w join o on o.user_id = w.user_id and o.k = w.k + 1, lateral (select list_filter(w.held, lambda t: t > o.ts - interval 1 day) as held) f)
select user_id, event_id, let_in from w""")
def stream_admission(spark, sf_dir):
    """The trailing limit over a stream, with its state by user."""
    rows = events(spark, sf_dir).select("user_id", "event_id", "ts")
    return flows.drained(flows.admitted(rows, "user_id", "ts", "event_id", 2, 86400), folder(spark), "admission").select("user_id", "event_id", "let_in")


@query("select user_id, count(*)::bigint as waiting, min(ts) as oldest, case when count(*) >= 40 then 'count' else 'age' end as cause from events group by user_id")
def stream_gate(spark, sf_dir):
    """Users with enough messages waiting as they come in, or whose oldest, by the clock, has waited long enough."""
    return flows.drained(flows.gate(events(spark, sf_dir).select("user_id", "ts"), "user_id", "ts"), folder(spark), "gate")


@query(_JOINS + "select grp::varchar as grp, event_id, outcome from j where outcome = 'burst_suppressed' or outcome in ('welcomed', 'withheld') and ts < (select max(ts) from events) - interval 901 second")
def stream_group_joins(spark, sf_dir):
    """Joins as they come in: refused at once in a burst, else held and asked about again."""
    kind = F.when(F.col("event_type").isin("signup", "view"), "joined").otherwise(F.col("event_type"))
    rows = events(spark, sf_dir).select("user_id", "event_id", "ts", kind.alias("kind"))
    found = flows.drained(joins.joins(rows, "user_id", "ts", "kind", "event_id", window_s=900), folder(spark), "joins")
    last = table(spark, sf_dir, "events").agg(F.max(utc("ts")).alias("last"))
    at = table(spark, sf_dir, "events").select(F.col("event_id").alias("row"), utc("ts").alias("ts")).crossJoin(last)
    met = found.join(at, "row").where((F.col("outcome") == "burst_suppressed") | (F.col("ts") < F.col("last") - F.expr("interval 901 seconds")))
    return met.select(F.col("group").alias("grp"), F.col("row").alias("event_id"), "outcome")

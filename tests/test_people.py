"""Who sent what: the ladder of identities, hashes, and batches put in twice."""

from datetime import datetime

from pyspark.sql import functions as F

from tidewater.operators import ingest

MEMBERS = "tenant_id string, member_id string, display_name string, wa_jid string, wa_lid string, created_at timestamp"
SENDERS = "tenant_id string, wa_jid string, wa_lid string, display_name string"
T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def resolve(spark, members, senders):
    found, after = ingest.resolve(spark.createDataFrame(senders, SENDERS), spark.createDataFrame(members, MEMBERS))
    return {(r.wa_jid, r.wa_lid, r.display_name): r.member_id for r in found.collect()}, {r.member_id: r for r in after.collect()}


def test_jid_wins_over_a_lid_that_contradicts(spark):
    found, _ = resolve(spark, [("t", "m1", "Ann", "1@s", "9@lid", T1)], [("t", "1@s", "8@lid", "Other")])
    assert set(found.values()) == {"m1"}


def test_a_lid_that_contradicts_makes_a_new_member(spark):
    found, after = resolve(spark, [("t", "m1", "Ann", "1@s", "9@lid", T1)], [("t", "2@s", "9@lid", "Ann")])
    (new,) = found.values()
    assert new != "m1" and after[new].wa_lid is None and after[new].wa_jid == "2@s"


def test_the_longest_known_of_a_name_wins_and_learns_the_address(spark):
    found, after = resolve(spark, [("t", "m2", "SARAH  J", None, None, T2), ("t", "m1", "sarah j", None, None, T1)], [("t", "+5@S", None, "Sarah J")])
    assert set(found.values()) == {"m1"} and after["m1"].wa_jid == "5@s" and after["m2"].wa_jid is None


def test_what_one_sender_creates_the_next_one_finds(spark):
    found, after = resolve(spark, [], [("t", None, None, "Tom"), ("t", None, "7@lid", "tom"), ("t", "447@s", None, None)])
    assert found[(None, None, "Tom")] == found[(None, "7@lid", "tom")] != found[("447@s", None, None)]
    assert {r.display_name for r in after.values()} == {"Tom", "+447"}


def test_repeats_in_one_minute_and_empty_rows(spark):
    rows = [("t", None, None, "A", T1, text, "text", "{}", i, "b") for i, text in enumerate(["ok", "OK ", "", "other"])]
    records = spark.createDataFrame(rows, "tenant_id string, wa_jid string, wa_lid string, display_name string, sent_at timestamp, text string, message_type string, payload string, source_ordinal int, batch string")
    resolved, _ = ingest.resolve(records.select("tenant_id", "wa_jid", "wa_lid", "display_name"), spark.createDataFrame([], MEMBERS))
    found = ingest.hashed(records, resolved, [F.col("source_ordinal")], ["batch"]).orderBy("source_ordinal").collect()
    assert [r.occurrence for r in found] == [0, 1, 0] and len({r.content_hash for r in found}) == 3


def test_a_row_that_is_dropped_claims_nothing(spark):
    rows = [("t", 1, "h1", "p1"), ("t", 2, "h2", "p1"), ("t", 3, "h2", "p2"), ("t", 4, "h3", None), ("t", 5, "h4", None)]
    df = spark.createDataFrame(rows, "tenant_id string, n int, content_hash string, provider_message_id string")
    found = ingest.either_key(df, ["tenant_id"], [F.col("n")]).orderBy("n").collect()
    assert [r.first for r in found] == [True, False, True, True, True]


def test_a_second_run_inserts_nothing(spark):
    df = spark.createDataFrame([("t", "h1", "p1"), ("t", "h2", None)], "tenant_id string, content_hash string, provider_message_id string")
    assert ingest.not_stored(df, df.where("false")).count() == 2
    assert ingest.not_stored(df, df).count() == 0


def test_people_are_resolved_once_for_senders_and_members(spark):
    said = spark.range(400).coalesce(1).select(F.lit("t").alias("tenant_id"), F.lit(None).cast("string").alias("wa_jid"), F.lit(None).cast("string").alias("wa_lid"), F.concat(F.lit("name "), F.col("id").cast("string")).alias("display_name"))
    members = said.where("display_name < 'name 2'").select("*", F.concat(F.lit("m"), "display_name").alias("member_id"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    resolved, after = ingest.resolve(said, members, most=16)
    plans = [rows._jdf.queryExecution().optimizedPlan().toString() for rows in (resolved, after)]
    assert not any("CoGroup" in plan for plan in plans)
    known = members.count()
    assert (resolved.count(), after.count(), after.where("is_new").count()) == (400, 400, 400 - known) and 0 < known < 400

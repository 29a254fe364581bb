"""Message and group events as JSON, one envelope a row: checked, adapted to records, and told apart from what isn't a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import keys, times
from tidewater.functions import text as x
from tidewater.functions import vocabulary as v

MOST_BYTES = 256 * 1024
MEDIA = ("image", "video", "audio", "document", "sticker")


def checked(envelopes: DataFrame, secret: bytes | None = None) -> DataFrame:
    """Envelopes (body, signature) that are small enough, signed, and JSON objects, with ``event`` and ``payload`` (JSON)."""
    good = envelopes.where(F.octet_length("body") <= MOST_BYTES)
    if secret is not None:
        good = good.where(keys.signed_by(secret)(F.col("body"), F.col("signature")))
    found = good.select("*", F.get_json_object("body", "$.event").alias("event"), F.get_json_object("body", "$.payload").alias("payload"))
    return found.where("payload is not null")


def _at(key: str) -> Column:
    return F.get_json_object("payload", f"$.{key}")


def mutation() -> Column:
    """True for edits, revocations and reactions, which are no messages of their own."""
    typed = F.lower(F.coalesce(_at("type"), F.lit(""))).isin(*v.MUTATION_TYPES) | F.lower(F.coalesce(_at("action"), F.lit(""))).isin(*v.MUTATION_TYPES)
    for key in v.MUTATION_KEYS:
        typed = typed | ~F.coalesce(_at(key), F.lit("")).isin("", "false", "0", "null", "{}", "[]")
    return typed


def messages(envelopes: DataFrame) -> DataFrame:
    """Records of the groups' messages; own messages, mutations, chats that aren't groups and unreadable times have none.

    group_external_id, provider, provider_message_id, sender_wa_jid, sender_wa_lid, sender_display_name, sent_at, text, message_type, payload.
    """
    kind = F
    for m in MEDIA:
        kind = kind.when(_at(m).isNotNull(), m)
    caption = F.coalesce(*[F.get_json_object("payload", f"$.{m}.caption") for m in MEDIA])
    rows = envelopes.where("event = 'message'").where(F.coalesce(_at("chat_id"), F.lit("")).endswith(v.GROUP_SUFFIX))
    rows = rows.where(F.coalesce(_at("is_from_me"), F.lit("false")) != "true").where(~mutation())
    return rows.select(
        _at("chat_id").alias("group_external_id"),
        F.lit("gateway").alias("provider"),
        _at("id").alias("provider_message_id"),
        x.address(_at("from")).alias("sender_wa_jid"),
        x.address(_at("from_lid")).alias("sender_wa_lid"),
        F.nullif(x.stripped(_at("from_name")), F.lit("")).alias("sender_display_name"),
        times.sniffed(_at("timestamp")).alias("sent_at"),
        x.storable(F.coalesce(_at("body"), _at("text"), caption)).alias("text"),
        F.coalesce(kind, F.lit("text")).alias("message_type"),
        "payload",
    ).where("sent_at is not null")


def group_events(envelopes: DataFrame) -> DataFrame:
    """(group_external_id, action, jids, group_name, sent_at) of changes in groups' membership."""
    rows = envelopes.where(F.col("event").startswith("group")).where(F.coalesce(_at("chat_id"), F.lit("")).endswith(v.GROUP_SUFFIX))
    return rows.select(
        _at("chat_id").alias("group_external_id"),
        _at("type").alias("action"),
        F.transform(F.from_json(_at("jids"), "array<string>"), lambda j: F.lower(F.trim(j))).alias("jids"),
        _at("group_name").alias("group_name"),
        times.sniffed(_at("timestamp")).alias("sent_at"),
    )

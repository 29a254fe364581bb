"""Hashes and keys by which rows are known to be the same."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import text as x
from tidewater.functions import times

#: Between the parts of a hash: a character that texts don't hold.
BETWEEN = "\u001f"


def sender_key(member: Column, jid: Column, lid: Column, name: Column) -> Column:
    """Who sent a message: the member if known, else the best address, else the folded ``name``."""
    marked = lambda mark, c: F.concat(F.lit(mark), F.nullif(c, F.lit("")))
    return F.coalesce(marked("member:", member), marked("jid:", jid), marked("lid:", lid), marked("name:", name), F.lit("system:"))


def content_hash(tenant: Column, sent_at: Column, key: Column, folded: Column, occurrence: Column) -> Column:
    """What makes a message itself: tenant, minute, sender, folded text, and which of the equal ones in its batch it is."""
    parts = [tenant.cast("string"), times.minute(sent_at), key, F.coalesce(folded, F.lit("")), occurrence.cast("string")]
    return F.sha2(F.concat_ws(BETWEEN, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def event_key(kind: Column, action: Column, when: Column, grain: Column, natural: Column, title: Column, zone: str) -> Column:
    """The key on which mentions of one event agree."""
    name = F.coalesce(F.nullif(x.slug(natural), F.lit("")), F.nullif(x.slug(title), F.lit("")), F.lit("unkeyed"))
    return F.concat(F.lit("llm:"), F.sha2(F.concat_ws("|", kind, times.bucket(kind, action, when, grain, title, zone), name), 256))


def human_key(event_id: Column) -> Column:
    return F.concat(F.lit("human:"), event_id.cast("string"))


def pseudonym(value: Column, length: int = 32) -> Column:
    return F.left(F.sha2(value.cast("string"), 256), F.lit(length))


def name_uuid(space: Column, name: Column) -> Column:
    """A name-based identifier (version 5): SHA-1 of the space's bytes and the name. Null without a name, or if ``space`` is no identifier."""
    hexed = F.replace(space, F.lit("-"), F.lit(""))
    digest = F.sha1(F.concat(F.unhex(hexed), name.cast("binary")))
    part = lambda at, n: F.substring(digest, at, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab" * 4)
    made = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))
    return F.when((F.length(hexed) == 32) & digest.isNotNull(), made)


def signed_by(secret: bytes):
    """A function (body, signature) that tells if a body carries the secret's HMAC-SHA256, in constant time."""

    @F.pandas_udf(T.BooleanType())
    def check(body: pd.Series, signature: pd.Series) -> pd.Series:
        def each(raw, said) -> bool:
            if raw is None or not isinstance(said, str):
                return False
            raw = raw.encode() if isinstance(raw, str) else bytes(raw)
            good = hmac.new(secret, raw, hashlib.sha256).hexdigest()
            return hmac.compare_digest(good.encode(), said.removeprefix("sha256=").strip().lower().encode())

        return pd.Series([each(b, s) for b, s in zip(body, signature, strict=True)])

    return check


def keyed_hash(secret: bytes):
    """A function that hides an address: its keyed BLAKE2b hash of 16 bytes, as hexadecimal digits. Without the key it can't be guessed back."""

    @F.pandas_udf(T.StringType())
    def hidden(value: pd.Series) -> pd.Series:
        return value.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), key=secret[:64], digest_size=16).hexdigest())

    return hidden


@F.pandas_udf(T.LongType())
def lock_key(name: pd.Series) -> pd.Series:
    """A number by which all that work on one thing can agree to wait: the BLAKE2b hash of its name, 8 bytes, signed."""
    return name.map(lambda x: None if x is None else int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big", signed=True))

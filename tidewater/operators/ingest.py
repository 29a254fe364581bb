"""From records to messages: who sent them, which are already there, and what was new."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import keys, times
from tidewater.functions import text as x
from tidewater.operators import pieces
from tidewater.operators.graphs import components
from tidewater.operators.pieces import PIECE, parted
from tidewater.operators.sequences import in_order, occurrences
from tidewater.session import settled, spread

SPACE = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"


def routed(records: DataFrame, links: DataFrame, group: str = "group_external_id") -> tuple[DataFrame, DataFrame]:
    """Records with their tenant, and those of groups that no tenant is linked to. ``links``: a tenant_id for each group."""
    return records.join(links.select(group, "tenant_id"), group), records.join(links.select(group), group, "left_anti")


def empty() -> Column:
    """True for a text message without text or payload."""
    return (F.col("message_type") == "text") & (x.stripped(F.coalesce("text", F.lit(""))) == "") & F.coalesce("payload", F.lit("")).isin("", "{}")


MEMBERS = "tenant_id string, member_id string, display_name string, wa_jid string, wa_lid string, created_at timestamp, is_new boolean"
RESOLVED = "tenant_id string, kind string, member_id string, display_name string, wa_jid string, wa_lid string, name_folded string, created_at timestamp, is_new boolean, said_jid string, said_lid string, said_name string"


#: Senders and members, about, that are resolved in one group.
PEOPLE = 4096


def _parts(said: DataFrame, known: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``part``: of tenants with over ``most`` people, those who share an address or a name over any chain have the same one."""
    people = said.select("tenant_id", "wa_jid", "wa_lid", "name_folded", F.lit(None).cast("string").alias("member_id")).unionByName(known.select("tenant_id", "wa_jid", "wa_lid", "name_folded", "member_id"))
    sizes = people.groupBy("tenant_id").agg(F.count("*").alias("_size")).where(F.col("_size") > most)
    if sizes.isEmpty():
        return said.withColumn("part", F.lit(0).cast("long")), known.withColumn("part", F.lit(0).cast("long"))
    sizes, said, known = settled(sizes), settled(said), settled(known)
    people = said.select("tenant_id", "wa_jid", "wa_lid", "name_folded", F.lit(None).cast("string").alias("member_id")).unionByName(known.select("tenant_id", "wa_jid", "wa_lid", "name_folded", "member_id"))
    node = lambda mark, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat_ws("\x1f", F.coalesce("tenant_id", F.lit("")), F.lit(mark), c))
    names = [node("jid", "wa_jid"), node("lid", "wa_lid"), node("name", "name_folded")]
    large = pieces.matched(people, sizes, ["tenant_id"]).select(F.coalesce(*names, node("member", "member_id")).alias("a"), F.explode(F.array(*names, node("member", "member_id"))).alias("b"))
    groups = components(large)

    def dealt(rows: DataFrame, last) -> DataFrame:
        keyed = pieces.matched(rows.withColumn("_node", F.coalesce(*names, last)), sizes, ["tenant_id"], "left")
        found = keyed.join(groups.select(F.col("node").alias("_node"), "component"), "_node", "left")
        part = F.pmod(F.xxhash64("component"), F.ceil(F.col("_size") / most))
        return found.withColumn("part", F.coalesce(part, F.lit(0)).cast("long")).select(*rows.columns, "part")

    return dealt(said, F.lit(None).cast("string")), dealt(known, node("member", "member_id"))


def resolve(senders: DataFrame, members: DataFrame, most: int = PEOPLE) -> tuple[DataFrame, DataFrame]:
    """(tenant_id, wa_jid, wa_lid, display_name, member_id) for each distinct sender, and the members afterwards.

    A sender is the member of the same jid; else of the same lid, if nothing contradicts it (if something does, a new one); else
    the longest known member of the same folded name that nothing contradicts; else a new member. Members learn addresses they
    lack. Senders go in order of (jid, lid, name), as each may change what the next one finds; but only what those do that share an
    address or a name, or are linked by a chain of such. So a tenant of over ``most`` people is parted by connected components, as many to
    a group as make about ``most``. ``senders``: tenant_id, wa_jid, wa_lid, display_name. ``members``: tenant_id, member_id, display_name,
    wa_jid, wa_lid, created_at.
    """
    blank = lambda c: F.nullif(x.stripped(F.col(c)), F.lit(""))
    key = ["tenant_id", "wa_jid", "wa_lid", "display_name"]
    # Different ones only go to Python, in as many tasks as shuffles have, however few files they came in; written, as filters are moved to before a shuffle.
    said = settled(spread(senders.select(F.col("tenant_id").cast("string").alias("tenant_id"), *key[1:]).distinct(), *key))
    said = said.select("tenant_id", x.address(F.col("wa_jid")).alias("wa_jid"), x.address(F.col("wa_lid")).alias("wa_lid"), blank("display_name").alias("display_name"))
    said = spread(said.where("coalesce(wa_jid, wa_lid, display_name) is not null").distinct(), *key).withColumn("name_folded", x.fold_name(F.col("display_name")))
    known = members.select(F.col("tenant_id").cast("string").alias("tenant_id"), "member_id", "display_name", "wa_jid", "wa_lid", "created_at")
    known = spread(known, "tenant_id", "member_id").withColumn("name_folded", x.fold_name(F.col("display_name")))
    said, known = _parts(said, known, most)
    said, known = (spread(rows, "tenant_id", "part").groupBy("tenant_id", "part") for rows in (said, known))
    out = settled(said.cogroup(known).applyInPandas(_resolve_tenant, RESOLVED))
    resolved = out.where("kind = 'sender'").select("tenant_id", F.col("said_jid").alias("wa_jid"), F.col("said_lid").alias("wa_lid"), F.col("said_name").alias("display_name"), "member_id", "is_new")
    after = out.where("kind = 'member'").select("tenant_id", "member_id", "display_name", "wa_jid", "wa_lid", "created_at", "is_new")
    return resolved, after


def _resolve_tenant(key, senders: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    text = lambda value: value if isinstance(value, str) and value else None
    people = [
        {"member_id": m.member_id, "display_name": text(m.display_name), "wa_jid": text(m.wa_jid), "wa_lid": text(m.wa_lid), "name_folded": text(m.name_folded), "created_at": m.created_at, "is_new": False}
        for m in members.itertuples()
    ]
    by, named = {"wa_jid": {}, "wa_lid": {}}, {}
    for m in people:
        for k in by:
            if m[k]:
                by[k][m[k]] = m
        named.setdefault(m["name_folded"], []).append(m)

    def agrees(m: dict, s: dict) -> bool:
        return all(not m[k] or not s[k] or m[k] == s[k] for k in by)

    def match(s: dict) -> dict | None:
        if s["wa_jid"] in by["wa_jid"]:
            return by["wa_jid"][s["wa_jid"]]
        if s["wa_lid"] in by["wa_lid"]:
            m = by["wa_lid"][s["wa_lid"]]
            return m if agrees(m, s) else None
        same = [m for m in named.get(s["name_folded"], ()) if s["name_folded"] and agrees(m, s)]
        return min(same, key=lambda m: (pd.isna(m["created_at"]), m["created_at"] if not pd.isna(m["created_at"]) else pd.Timestamp(0), m["member_id"]), default=None)

    rows = []
    wanted = [{k: text(getattr(s, k)) for k in ("wa_jid", "wa_lid", "display_name", "name_folded")} for s in senders.itertuples()]
    for s in sorted(wanted, key=lambda s: (s["wa_jid"] or "", s["wa_lid"] or "", s["display_name"] or "")):
        m = match(s)
        if m is None:
            user = (s["wa_jid"] or s["wa_lid"] or "").partition("@")[0]
            name = s["display_name"] or (f"+{user}" if user.isdigit() else user or "Unknown")
            said = "\x1f".join([str(key[0]), s["wa_jid"] or "", s["wa_lid"] or "", s["display_name"] or ""])
            m = {"member_id": str(uuid.uuid5(uuid.UUID(SPACE), said)), "display_name": name, "created_at": pd.NaT, "is_new": True}
            m |= {k: s[k] if s[k] and s[k] not in by[k] else None for k in by} | {"name_folded": s["name_folded"]}
            people.append(m)
            named.setdefault(m["name_folded"], []).append(m)
            for k in by:
                if m[k]:
                    by[k][m[k]] = m
        else:
            for k in by:
                if s[k] and not m[k] and s[k] not in by[k]:
                    m[k] = s[k]
                    by[k][s[k]] = m
            if s["display_name"] and not (m["display_name"] or "").strip():
                m["display_name"] = s["display_name"]
        rows.append({"kind": "sender", "member_id": m["member_id"], "is_new": m["is_new"], "said_jid": s["wa_jid"], "said_lid": s["wa_lid"], "said_name": s["display_name"]})
    rows += [{"kind": "member"} | m for m in people]
    columns = [f.split()[0] for f in RESOLVED.split(", ")]
    out = pd.DataFrame(rows, columns=columns)
    out["tenant_id"] = str(key[0])
    out["created_at"] = pd.to_datetime(out["created_at"])
    return out.replace({np.nan: None}) if not len(out) else out.astype({c: object for c in columns if c not in ("created_at", "is_new")}).where(out.notna(), None).assign(created_at=out["created_at"], is_new=out["is_new"].astype(bool))


def hashed(records: DataFrame, resolved: DataFrame, order: list[Column], batch: list[str]) -> DataFrame:
    """Records that aren't empty, with member_id, sender_key, occurrence and content_hash.

    Equal messages (minute, sender, folded text) of one ``batch`` are told apart by their place in it. ``records``: tenant_id, wa_jid,
    wa_lid, display_name, sent_at, text, message_type, payload and the columns of ``batch`` and ``order``.
    """
    blank = lambda c: F.nullif(x.stripped(F.col(c)), F.lit(""))
    rows = records.where(~empty()).withColumns({"wa_jid": x.address(F.col("wa_jid")), "wa_lid": x.address(F.col("wa_lid")), "display_name": blank("display_name")})
    r = resolved.select(*[F.col(c).alias(f"_{c}") for c in ("tenant_id", "wa_jid", "wa_lid", "display_name")], "member_id")
    same = F.col("tenant_id").cast("string") == F.col("_tenant_id")
    for c in ("wa_jid", "wa_lid", "display_name"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = rows.join(r, same, "left").drop("_tenant_id", "_wa_jid", "_wa_lid", "_display_name")
    key = keys.sender_key(F.col("member_id"), F.col("wa_jid"), F.col("wa_lid"), x.fold(F.col("display_name")))
    rows = rows.withColumns({"sender_key": key, "folded": x.fold(F.col("text")), "minute": times.minute(F.col("sent_at"))})
    rows = occurrences(rows, [*[F.col(b) for b in batch], F.col("tenant_id"), F.col("minute"), F.col("sender_key"), F.col("folded")], order)
    return rows.withColumn("content_hash", keys.content_hash(F.col("tenant_id"), F.col("sent_at"), F.col("sender_key"), F.col("folded"), F.col("occurrence")))


def either_key(rows: DataFrame, by: list[str], order: list[Column], one: str = "content_hash", other: str = "provider_message_id", piece: int = PIECE) -> DataFrame:
    """``rows`` with ``first``: false if an earlier one that is first has the same ``one``, or the same ``other`` (null: none).

    A row that isn't first claims neither key for itself, so rows go through in order. Only those need to that share a key with another: the
    rest, nearly all, are first whatever stands before them, and never meet in one task. Where over ``piece`` rows of a group share keys,
    they are parted by connected components of their keys, since a row's fate hangs on no other component. ``rows`` is read twice, for
    both keys' counts at once and for the rows: it should be cheap to read, or written.
    """
    names = {c: f"_{c}" for c in by}
    # Counted before they are shuffled, so that a key in a third of all rows is no task of its own. A kind of key for each key.
    kinds = F.explode(F.array(F.struct(F.lit(1).alias("kind"), F.col(one).cast("string").alias("key")), F.struct(F.lit(2).alias("kind"), F.col(other).cast("string").alias("key"))))
    keyed = rows.select(*by, kinds.alias("k")).where("k.key is not null")
    twice = keyed.groupBy(*by, "k").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(*by, "k.kind", "k.key").withColumnsRenamed(names)
    marked = rows
    for kind, (key, mark) in enumerate(((one, "_n"), (other, "_m")), 1):
        held = twice.where(F.col("kind") == kind).select(*names.values(), F.col("key").alias("_key"), F.lit(True).alias(mark))
        same = F.col(key).cast("string") == F.col("_key")
        for c, name in names.items():
            same = same & F.col(c).eqNullSafe(F.col(name))
        marked = marked.join(held, same, "left").drop(*names.values(), "_key")
    marked = marked.withColumn("_alone", F.col("_n").isNull() & F.col("_m").isNull() & F.col(one).isNotNull()).drop("_n", "_m")
    clear = marked.where("_alone").drop("_alone").withColumn("first", F.lit(True))

    def step(state: tuple[set, set], some: pa.Array, more: pa.Array) -> list:
        ones, others = state
        good = np.zeros(len(some), bool)
        for i, (a, b) in enumerate(zip(some.to_pylist(), more.to_pylist(), strict=True)):
            if a not in ones and (b is None or b not in others):
                good[i] = True
                ones.add(a)
                if b is not None:
                    others.add(b)
        return [good]

    fresh = lambda: (set(), set())
    few, many = parted(marked.where("not _alone").drop("_alone"), by, piece)
    found = clear.unionByName(in_order(few, by, order, [one, other], "first boolean", fresh, step))
    if many is None:
        return found
    # Nodes are keys, with their group; a row joins its two.
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    node = lambda c, mark: F.sha2(F.concat_ws("\x1f", group, F.lit(mark), F.coalesce(F.col(c).cast("string"), F.lit(""))), 256)
    mine = F.when(F.col(one).isNull(), node(one, "none")).otherwise(node(one, "one"))
    many = many.withColumn("_node", mine)
    groups = components(many.select(F.col("_node").alias("a"), F.coalesce(F.when(F.col(other).isNotNull(), node(other, "other")), F.col("_node")).alias("b")))
    many = many.join(groups.select(F.col("node").alias("_node"), F.col("component").alias("_component")), "_node").drop("_node")
    return found.unionByName(in_order(many, [*by, "_component"], order, [one, other], "first boolean", fresh, step).drop("_component"))


def not_stored(rows: DataFrame, stored: DataFrame, tenant: str = "tenant_id", one: str = "content_hash", other: str = "provider_message_id") -> DataFrame:
    """Rows that agree with no stored one in either key. Run twice, nothing is inserted the second time."""
    fresh = rows.join(stored.select(tenant, one), [tenant, one], "left_anti")
    ids = stored.where(F.col(other).isNotNull()).select(F.col(tenant).alias("_t"), F.col(other).alias("_o"))
    return fresh.join(ids, (F.col(tenant) == F.col("_t")) & (F.col(other) == F.col("_o")), "left_anti")


def accounted(received: DataFrame, inserted: DataFrame, by: list[str]) -> DataFrame:
    """(by, received, skipped, inserted, duplicates): received = inserted + duplicates + skipped."""
    came = received.groupBy(*by).agg(F.count("*").alias("received"), F.count_if(empty()).alias("skipped"))
    kept = inserted.groupBy(*by).agg(F.count("*").alias("inserted"))
    found = came.join(kept, by, "left").fillna({"inserted": 0})
    return found.withColumn("duplicates", F.col("received") - F.col("skipped") - F.col("inserted"))

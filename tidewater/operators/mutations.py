"""Changes to stored rows, each as a join that gives the table afterwards; ``sources.storage`` puts it in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import keys
from tidewater.functions import vocabulary as v
from tidewater.sources.keyed import KeyedTable

#: Columns of an event that a hand edit keeps from being overwritten.
PROTECTABLE = ("kind", "occurred_at", "occurred_at_precision", "title", "body", "details", "actor_member_id")


def insert_if_absent(stored: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """``stored`` and those of ``rows`` whose key it lacks."""
    return stored.unionByName(rows.join(stored.select(*on), on, "left_anti"))


def upsert(stored: DataFrame, rows: DataFrame, on: list[str], protectable: list[str], evidence: dict[str, Column], now: Column) -> DataFrame:
    """The table after an upsert. Both sides have the same columns, keys are unique on each.

    A stored row that is edited, deleted or pinned stays as it is. Otherwise ``protectable`` columns take the incoming value unless
    ``user_edited_fields`` names them (or, for details, a part of them), ``evidence`` columns the value given over ``old`` and ``new``,
    and updated_at becomes ``now``.
    """
    old, new = stored.alias("old"), rows.alias("new")
    same = F.lit(True)
    for k in on:
        same = same & (F.col(f"old.{k}") == F.col(f"new.{k}"))
    there, comes = F.col(f"old.{on[0]}").isNotNull(), F.col(f"new.{on[0]}").isNotNull()
    shut = F.col("old.edited_at").isNotNull() | F.col("old.deleted_at").isNotNull() | F.coalesce("old.pinned", F.lit(False))
    writes = comes & ~F.coalesce(shut, F.lit(False))

    def value(c: str) -> Column:
        was, will = F.col(f"old.{c}"), F.col(f"new.{c}")
        if c in on:
            return F.coalesce(was, will)
        if c in protectable:
            edited = F.exists("old.user_edited_fields", lambda f: (f == c) | f.startswith(f"{c}."))
            return F.when(writes & ~F.coalesce(edited, F.lit(False)), will).otherwise(was)
        if c in evidence:
            return F.when(writes & there, evidence[c]).when(writes, will).otherwise(was)
        if c == "updated_at":
            return F.when(writes, now).otherwise(was)
        return F.when(there, was).otherwise(will)

    return old.join(new, same, "full").select(*[value(c).alias(c) for c in stored.columns])


def upserted(table: KeyedTable, rows: DataFrame, on: list[str], protectable: list[str], evidence: dict[str, Column], now: Column) -> int:
    """``upsert`` on a table that others may change too: reads the buckets that ``rows`` fall in and writes only rows of their keys."""

    def work(stored: DataFrame | None) -> tuple[DataFrame, None]:
        return upsert(rows.limit(0) if stored is None else stored.select(*rows.columns), rows, on, protectable, evidence, now), None

    return table.change(rows, work)


def stamped(rows: DataFrame, ids: DataFrame, on: list[str], column: str, now: Column) -> DataFrame:
    """``rows`` with ``column`` set to ``now`` where it is null and the key is among ``ids``; a second time changes nothing."""
    hit = rows.join(ids.select(*on).distinct().withColumn("_hit", F.lit(True)), on, "left")
    return hit.withColumn(column, F.when(F.col(column).isNull() & F.col("_hit"), now).otherwise(F.col(column))).select(*rows.columns)


def soft_deleted(rows: DataFrame, ids: DataFrame, on: list[str], now: Column) -> DataFrame:
    """Tombstones keep their key, so nothing brings the event back; the first deletion's time stays."""
    return stamped(rows, ids, on, "deleted_at", now)


def patched(rows: DataFrame, patches: DataFrame, on: list[str], fields: list[str], now: Column) -> DataFrame:
    """``rows`` changed by hand. ``patches``: the key, and ``patch``, a map of the fields given (a null value clears a field).

    Sets edited_at and adds the fields' names to user_edited_fields. An empty patch changes nothing.
    """
    met = rows.join(patches.select(*on, F.col("patch").alias("_patch")), on, "left")
    some = F.coalesce(F.size("_patch") > 0, F.lit(False))
    given = lambda f: some & F.map_contains_key("_patch", f)
    types = {f.name: f.dataType for f in rows.schema}
    out = {f: F.when(given(f), F.element_at("_patch", f).cast(types[f])).otherwise(F.col(f)) for f in fields}
    out["edited_at"] = F.when(some, now).otherwise(F.col("edited_at"))
    named = F.coalesce("user_edited_fields", F.array().cast("array<string>"))
    out["user_edited_fields"] = F.when(some, F.sort_array(F.array_union(named, F.map_keys("_patch")))).otherwise(F.col("user_edited_fields"))
    return met.select(*[out.get(c, F.col(c)).alias(c) for c in rows.columns])


def repointed(rows: DataFrame, merges: DataFrame, column: str) -> DataFrame:
    """``rows`` with ids of ``column`` that were merged away replaced. ``merges``: loser, survivor (a loser once, no survivor a loser)."""
    met = rows.join(merges.select(F.col("loser").alias("_loser"), "survivor"), F.col(column) == F.col("_loser"), "left")
    return met.withColumn(column, F.coalesce("survivor", column)).select(*rows.columns)


def merged_members(members: DataFrame, merges: DataFrame, member: str, fill: list[str]) -> DataFrame:
    """``members`` without the losers; survivors take over what they lack in ``fill``, from the loser of smallest id."""
    lost = merges.join(members.select(F.col(member).alias("loser"), *fill), "loser")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("loser")))
    more = lost.groupBy(F.col("survivor").alias("_s")).agg(*[first(c).alias(f"_{c}") for c in fill])
    left = members.join(merges.select(F.col("loser").alias(member)), member, "left_anti").join(more, F.col(member) == F.col("_s"), "left")
    return left.withColumns({c: F.coalesce(c, f"_{c}") for c in fill}).select(*members.columns)


def without_tenants(tables: dict[str, DataFrame], gone: DataFrame, tenant: str) -> dict[str, DataFrame]:
    """Every table without the rows of tenants that are gone."""
    return {name: df.join(gone.select(tenant), tenant, "left_anti").select(*df.columns) for name, df in tables.items()}


def cleared(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """``rows`` with references to rows that are gone set to null."""
    met = rows.join(gone.select(F.col(gone.columns[0]).alias("_gone")).distinct(), F.col(column) == F.col("_gone"), "left")
    return met.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*rows.columns)


def linked(links: DataFrame, wanted: DataFrame, suffix: str = "@g.us") -> tuple[DataFrame, DataFrame]:
    """The links after tenants asked for groups, and each wish's outcome: linked, moved, unchanged, conflict or not_a_group.

    ``links``: tenant_id, group_external_id, one each way. ``wanted``: tenant_id, group_external_id, asked_at; of several wishes of a tenant the last
    counts, of several tenants for a free group the first. A group that another tenant has, before these wishes, stays with it.
    """
    order = Window.partitionBy("tenant_id").orderBy(F.desc("asked_at"), "group_external_id")
    last = wanted.withColumn("group_external_id", F.btrim("group_external_id")).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    owners = links.select("group_external_id", F.col("tenant_id").alias("_owner"))
    own = links.select("tenant_id", F.col("group_external_id").alias("_had"))
    rows = last.join(owners, "group_external_id", "left").join(own, "tenant_id", "left")
    first = F.row_number().over(Window.partitionBy("group_external_id").orderBy("asked_at", "tenant_id"))
    rows = rows.withColumn("_good", F.endswith("group_external_id", F.lit(suffix))).withColumn("_first", first)
    outcome = (
        F.when(~F.col("_good"), "not_a_group")
        .when(F.col("_owner") == F.col("tenant_id"), "unchanged")
        .when(F.col("_owner").isNotNull() | (F.col("_first") > 1), "conflict")
        .when(F.col("_had").isNotNull(), "moved")
        .otherwise("linked")
    )
    said = rows.select("tenant_id", "group_external_id", "asked_at", outcome.alias("outcome"))
    new = said.where(F.col("outcome").isin("linked", "moved")).select("tenant_id", "group_external_id")
    return links.join(new.select("tenant_id"), "tenant_id", "left_anti").unionByName(new), said


def filed(table: KeyedTable, sections: DataFrame, summaries: DataFrame, by: list[str], start: Column, end: Column, title: str, now: Column) -> int:
    """Puts a report of each group in ``table`` (keyed by ``by`` and report_id), made of what ``reading.report`` and ``reading.summary`` give.

    Columns: by, report_id, status, title, period_start, period_end, summary, sections (heading, body_markdown and handles, in the fixed order of
    kinds), watch_items, data_gaps, created_at. Its id is drawn from group, period and time, so a job that is run again files nothing twice.
    """
    place = F.array_position(F.array(*[F.lit(k) for k in v.KINDS]), F.col("kind"))
    one = F.struct(place.alias("place"), "heading", "body_markdown", "handles")
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda s: F.struct(s["heading"].alias("heading"), s["body_markdown"].alias("body_markdown"), s["handles"].alias("handles")))
    rows = sections.groupBy(*by).agg(listed.alias("sections")).join(summaries, by)
    rows = rows.withColumns({"status": F.lit("ready"), "title": F.lit(title), "period_start": start, "period_end": end, "created_at": now})
    name = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in (*by, "period_start", "period_end", "created_at")])
    names = ("report_id", "status", "title", "period_start", "period_end", "summary", "sections", "watch_items", "data_gaps", "created_at")
    return table.insert(rows.withColumn("report_id", F.left(F.sha2(name, 256), F.lit(32))).select(*by, *names))


def advanced(imports: DataFrame, progress: DataFrame) -> DataFrame:
    """``imports`` (import_id, status, inserted_count) after ``progress`` (import_id, at, status, inserted_count): the last word on each counts; what it leaves null stays."""
    last = progress.groupBy("import_id").agg(F.max_by(F.struct("status", "inserted_count"), F.struct("at", "status")).alias("_p"))
    new = {c: F.coalesce(F.col(f"_p.{c}"), F.col(c)) for c in ("status", "inserted_count")}
    return imports.join(last, "import_id", "left").withColumns(new).drop("_p")


def entered(events: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Events that a person wrote down: each is its own, by its id, and pinned, so that nothing extracted is merged into it."""
    return events.withColumns({"dedup_key": keys.human_key(F.col(event_id)), "pinned": F.lit(True), "source_message_ids": F.array().cast("array<string>")})

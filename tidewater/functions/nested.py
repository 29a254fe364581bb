"""Functions of arrays, structs and JSON objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions import vocabulary as v


def ordered_union(first: Column, second: Column) -> Column:
    """All different values, in the order first seen. Null counts as empty."""
    empty = F.array().cast("array<string>")
    return F.array_union(F.coalesce(first, empty), F.coalesce(second, empty))


def merged_excerpts(first: Column, second: Column) -> Column:
    """Excerpts of both arrays, one for each (message_id, quote), the first seen; oldest first by ``sent_at``.

    Elements are structs with message_id, quote and sent_at. An element's place breaks ties.
    """
    numbered = F.transform(F.concat(first, second), lambda e, i: F.struct(F.coalesce(e["sent_at"], F.lit("")).alias("at"), i.alias("i"), e.alias("e")))
    same = lambda a, b: (a["message_id"].eqNullSafe(b["message_id"])) & (a["quote"].eqNullSafe(b["quote"]))
    first_ones = F.filter(numbered, lambda n: ~F.exists(numbered, lambda m: (m["i"] < n["i"]) & same(m["e"], n["e"])))
    return F.transform(F.array_sort(first_ones), lambda n: n["e"])


def mention_count(occurrences: Column) -> Column:
    """How often an event was mentioned: each occurrence may stand for several mentions."""
    return F.aggregate(occurrences, F.lit(0).cast("long"), lambda n, o: n + F.coalesce(o["mention_count"], F.lit(1)))


def json_map(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def json_merge(old: Column, patch: Column) -> Column:
    """The object ``old`` with the keys of ``patch`` over it, as a map; one level deep."""
    a, b = json_map(old), json_map(patch)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def json_laid_over(old: Column, patch: Column) -> Column:
    """The object ``old`` with the keys of ``patch`` over it, as JSON text: values of any kind stay as they are; one level deep."""
    kept = F.map_filter(F.coalesce(F.from_json(old, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>")), lambda k, _: ~F.coalesce(F.array_contains(F.json_object_keys(patch), k), F.lit(False)))
    body = F.regexp_replace(F.to_json(kept), r"^\{|\}$", "")
    over = F.regexp_replace(patch, r"^\s*\{|\}\s*$", "")
    return F.concat(F.lit("{"), F.concat_ws(",", F.nullif(body, F.lit("")), F.nullif(F.btrim(over), F.lit(""))), F.lit("}"))


def json_has(text: Column, key: str) -> Column:
    """True if an object has a key, whatever its value."""
    return F.coalesce(F.array_contains(F.json_object_keys(text), key), F.lit(False))


def tolerant(details: Column, schema: str, allowed: dict[str, tuple[str, ...]]) -> Column:
    """A struct read from a JSON object: unknown keys go, and so do values outside a closed vocabulary."""
    found = F.from_json(details, schema)
    fields = [f.strip().split()[0] for f in schema.split(",")]
    return F.struct(*[(F.when(found[f].isin(*allowed[f]), found[f]) if f in allowed else found[f]).alias(f) for f in fields])


def appointment_status(title: Column, body: Column, outcome: Column) -> Column:
    said = F.lower(F.concat_ws(" ", title, F.coalesce(body, F.lit(""))))
    return (
        F.when(said.contains("cancel"), "cancelled")
        .when(said.contains("missed") | said.contains("didn't go") | said.contains("did not go"), "missed")
        .when(F.coalesce(outcome, F.lit("")) != "", "attended")
        .otherwise("scheduled")
    )


def of_kind(events, kind: str = "kind"):
    """``events`` with the fields of other kinds emptied, and texts clamped to the sizes they are kept in."""
    for owner, fields in v.KIND_FIELDS.items():
        for f in fields:
            if f in events.columns:
                empty = F.array().cast("array<string>") if f in v.KIND_LISTS else F.lit(None)
                events = events.withColumn(f, F.when(F.col(kind) == owner, F.col(f)).otherwise(empty))
    return events


def details(e: Column | None = None) -> Column:
    """The JSON object of what belongs to an event's kind; ``e`` is a struct, or None for columns."""
    at = (lambda f: F.col(f)) if e is None else (lambda f: e[f])
    other = lambda f, default: F.coalesce(F.nullif(at(f), F.lit("")), F.lit(default))
    keep = {"ignoreNullFields": "false"}
    symptom = F.struct(at("symptom_name").alias("symptom"), other("severity", "unknown").alias("severity"), at("body_site").alias("body_site"), at("duration_text").alias("duration_text"))
    appointment = F.struct(
        other("appointment_kind", "other").alias("appointment_kind"),
        *[at(f).alias(f) for f in ("provider_name", "location", "attendees", "outcome", "follow_up_actions")],
        appointment_status(at("title"), at("body"), at("outcome")).alias("status"),
    )
    medication = F.struct(at("medication_name").alias("medication_name"), at("dose_text").alias("dose_text"), other("medication_action", "other").alias("action"), at("prescriber").alias("prescriber"))
    return (
        F.when(at("kind") == "symptom", F.to_json(symptom, keep))
        .when(at("kind") == "appointment", F.to_json(appointment, keep))
        .when(at("kind") == "medication", F.to_json(medication, keep))
        .otherwise(F.to_json(F.struct(other("note_category", "other").alias("category")), keep))
    )

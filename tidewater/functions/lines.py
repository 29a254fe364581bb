"""Lines that people and models read: events, messages, facts about an event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions import text as x
from tidewater.functions import times
from tidewater.functions import vocabulary as v


def _named(names: dict[str, str], value: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(n) for pair in names.items() for n in pair]), value)


def initials(name: Column) -> Column:
    """The first letters of the first two words, in capitals."""
    words = F.slice(F.split(name, r"\s+", -1), 1, 2)
    return F.upper(F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), ""))


def event_line(kind: Column, at: Column, grain: Column, title: Column, body: Column, details: Column, zone: str, now: Column) -> Column:
    """An event's date (as precise as it is known), kind, title, what its ``details`` (JSON text) tell, and its body in short."""

    def told(key: str) -> Column:
        value = F.get_json_object(details, f"$.{key}")
        return F.when(~value.isin(*v.UNINFORMATIVE), F.concat(F.lit(f"{key}: "), value))

    extras = F.concat_ws(", ", *[told(k) for k in v.DETAIL_KEYS])
    words = x.truncated(x.collapsed(body), v.LINE_BODY_CHARS)
    return F.concat(
        times.shown(at, grain, zone), F.lit(" "), kind, F.lit(": "), x.stripped(title), F.when(at > now, " (upcoming)").otherwise(""),
        F.when(extras != "", F.concat(F.lit(" ["), extras, F.lit("]"))).otherwise(""), F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(" — "), words)).otherwise(""),
    )


def message_line(at: Column, sender: Column, text: Column, kind: Column, zone: str) -> Column:
    """A message's local time, sender, and words in short; what it is, if it has none."""
    said = x.collapsed(F.coalesce(text, F.lit("")))
    said = F.when(said == "", F.concat(F.lit("("), kind, F.lit(", no text)"))).otherwise(said)
    who = x.stripped(F.coalesce(F.nullif(sender, F.lit("")), F.lit("someone")))
    return F.concat(F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd HH:mm"), F.lit(" "), who, F.lit(": "), x.truncated(said, v.EXCERPT_CHARS))


def facts(kind: Column, details: Column) -> Column:
    """(label, value) of what an event's ``details`` (JSON text) say, in reading order; what is empty has none."""
    at = lambda key: F.nullif(F.get_json_object(details, f"$.{key}"), F.lit(""))
    listed = lambda key, between: F.nullif(F.array_join(F.from_json(F.get_json_object(details, f"$.{key}"), "array<string>"), between), F.lit(""))
    severity = F.when(at("severity") != "unknown", at("severity"))
    by_kind = {
        "symptom": {"Symptom": at("symptom"), "Severity": severity, "Where": at("body_site"), "Duration": at("duration_text")},
        "appointment": {
            "Type": _named(v.APPOINTMENT_NAMES, at("appointment_kind")), "Status": at("status"), "With": at("provider_name"), "Where": at("location"),
            "Who went": listed("attendees", ", "), "Outcome": at("outcome"), "Follow-up": listed("follow_up_actions", "; "),
        },
        "medication": {"Medication": at("medication_name"), "What happened": _named(v.ACTION_NAMES, at("action")), "Dose": at("dose_text"), "Prescribed by": at("prescriber")},
        "note": {"Category": at("category")},
    }
    found = F.lit(None)
    for name, fields in by_kind.items():
        each = [F.when(value.isNotNull(), F.struct(F.lit(label).alias("label"), value.alias("value"))) for label, value in fields.items()]
        found = F.when(kind == name, F.array_compact(F.array(*each))).otherwise(found)
    return found


def kind_label(kind: Column) -> Column:
    return _named(v.KIND_NAMES, kind)

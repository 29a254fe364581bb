"""Chat formatting: a finite-state machine checks the order of roles, a template turns each conversation into text segments.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the markers, escaped where texts hold them: see ``escaped``.
ESCAPES = (("&", "&amp;"), ("</turn>", "&lt;/turn>"), ("###", "##&num;"))
END = "</turn>\n"


@dataclass(frozen=True)
class Template:
    """What a format is made of.

    ``moves`` maps (state, role) to the next state; a role without a move is out of turn. A conversation is valid
    if all its turns are in turn and it ends in one of ``final``. ``learned`` are the roles whose texts carry loss.
    """

    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    final: tuple[str, ...] = ("answered",)
    learned: tuple[str, ...] = ("assistant",)
    before: str = "### "
    after: str = ": "


def escaped(text: Column) -> Column:
    """``text`` without any control string of the template; ``unescaped`` takes it back exactly.

    Every ``&`` is escaped, so each ``&amp;``, ``&lt;`` and ``&num;`` in the result is the escape's own.
    """
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for safe, plain in (("&num;", "#"), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def escaped_role(role: Column) -> Column:
    """A role as it stands in a header, where a colon ends it."""
    return F.replace(escaped(role), F.lit(":"), F.lit("&colon;"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&colon;"), F.lit(":")))


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """(conv_id, n_turns, segments, formatted, valid, state) for each conversation.

    ``turns`` has conv_id, turn, role and text. Turns stand in order of ``turn``, nulls first; of equal turns, by role and
    text. A null text or role counts as empty. ``segments`` is an array of (text, loss): for each turn its header,
    its escaped text and its end mark; only texts of learned roles carry loss. ``formatted`` is the segments' texts in
    order. Conversations that are not valid are formatted all the same; ``state`` says where the machine ended ("invalid"
    if a turn was out of order). Each row with a null conv_id is a conversation of its own. Other columns are ignored. A conversation is one row, as
    its format is one text. Repeated rows are turns like any other.
    """
    rows = turns.select(
        F.col("conv_id"),
        F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    # Rows that no conversation claims stand alone, and are never gathered.
    known = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _by_turn).alias("turns"))
    talks = known.unionByName(rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns")))
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    step = lambda state, t: F.coalesce(F.element_at(moves, F.concat(state, F.lit("\n"), t["role"])), F.lit("invalid"))
    learned = F.array(*[F.lit(r) for r in template.learned])

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.before), escaped_role(t["role"]), F.lit(template.after))
        parts = ((head, F.lit(False)), (escaped(t["text"]), F.array_contains(learned, t["role"])), (F.lit(END), F.lit(False)))
        return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts])

    out = talks.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
        F.aggregate("turns", F.lit("start"), step).alias("state"),
    )
    return out.select(
        "conv_id",
        "n_turns",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("state").isin(*template.final).alias("valid"),
        "state",
    )


def _by_turn(a: Column, b: Column) -> Column:
    def order(x: Column, y: Column) -> Column:
        # Nulls first.
        return (
            F.when(x.isNull() & y.isNull(), 0)
            .when(x.isNull(), -1)
            .when(y.isNull(), 1)
            .when(x < y, -1)
            .when(x > y, 1)
            .otherwise(0)
        )

    by_turn, by_role = order(a["turn"], b["turn"]), order(a["role"], b["role"])
    return F.when(by_turn != 0, by_turn).when(by_role != 0, by_role).otherwise(order(a["text"], b["text"]))


def parse(formatted: Column, template: Template = Template()) -> Column:  # noqa: B008
    """The turns of a formatted conversation, as an array of (role, text). End marks stand only where turns end."""
    pieces = F.split(formatted, END, -1)
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    first = len(template.before) + 1

    def turn(piece: Column) -> Column:
        at = F.instr(piece, template.after)
        role = F.substring(piece, F.lit(first), at - F.lit(first))
        text = F.substring(piece, at + F.lit(len(template.after)), F.char_length(piece))
        return F.struct(unescaped_role(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(whole, turn)


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """What a formatted conversation holds, read back from ``formatted`` and ``segments``."""
    lines = F.transform(parse(F.col("formatted"), template), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    back = formatted.select("*", F.array_join(lines, "").alias("_turns"), F.array_join(loss, "").alias("_loss"))
    return back.select(
        "conv_id",
        F.size(F.filter(F.split("formatted", END, -1), lambda p: p != "")).cast("long").alias("n_turns"),
        F.sha2("_turns", 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "state",
    )

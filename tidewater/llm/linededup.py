"""Line deduplication by winnowing over line hashes.

A window is the shortest run of lines, from a line on or up to a line, that is long enough to count: ``CHARACTERS`` characters or
``LINES`` lines. Of each window the line with the smallest hash is selected, as the window's fingerprint; a line that several windows select is one
fingerprint, and equal windows select the same line wherever they stand, so no repeated run escapes. Fingerprints that stand once in
the corpus are done with. The positions of the others are joined, and matches extended from the selected line to both sides as
far as the lines agree with those around an earlier position, over a window or more; what a later document has of them goes.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import shielded, written

#: What a run of lines must have to count as repeated: so many characters, in one line or several, or so many lines.
CHARACTERS, LINES = 24, 3
BLANKS = " \t\r\f\x0b"


def trimmed(line: Column) -> Column:
    """``line`` without the spaces around it; most have none, and Spark's trim by characters looks at every one."""
    return F.when(F.substring(line, 1, 1).isin(*BLANKS) | F.substring(line, -1, 1).isin(*BLANKS), F.btrim(line, F.lit(BLANKS))).otherwise(line)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(text: Column) -> Column:
    """(h, i, n) of the lines that are not blank: a hash of the line without the spaces around it, its index, and its characters."""
    each = F.transform(lines_of(text), lambda x, i: F.struct(trimmed(x).alias("line"), i.alias("i")))
    return F.transform(
        F.filter(each, lambda x: x["line"] != ""), lambda x: F.struct(F.xxhash64(x["line"]).alias("h"), x["i"].alias("i"), F.char_length(x["line"]).alias("n"))
    )


def selecting(characters: int, most: int) -> Column:
    """The windows that select the line in the middle of ``x``: their hash, and their lines' indices; null for runs that are none or select another."""
    field = lambda name, k: F.col(f"x.{name}{k + most - 1}")
    found = []
    for back, on in ((b, n - 1 - b) for n in range(1, most + 1) for b in range(n)):
        span = range(-back, on + 1)
        sizes = [field("n", k) for k in span]
        total = sum(sizes[1:], sizes[0])
        window = (total >= characters) if len(span) < most else total.isNotNull()
        if len(span) > 1:  # the shortest from its first line on, or up to its last
            window = window & ((total - sizes[-1] < characters) | (total - sizes[0] < characters))
        for k in span:
            if k:
                window = window & ((field("h", 0) < field("h", k)) if k < 0 else (field("h", 0) <= field("h", k)))
        found.append(F.when(window, F.struct(F.xxhash64(*[field("h", k) for k in span]).alias("context"), F.array(*[field("i", k) for k in span]).alias("rows"))))
    return F.array(*found)


def fingerprints(docs: DataFrame, characters: int = CHARACTERS, most: int = LINES) -> DataFrame:
    """(fp, at, doc_id, tag, context, rows): the selected lines of a document, a row for each window that selects one.

    ``fp`` is the line's hash, ``at`` its index in the text; ``context`` is a hash of the window's lines, ``rows`` are their indices.
    A window selects the smallest of its hashes, the first of equal ones.
    """
    hashed = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("tag"), hashed_lines(F.col("text")).alias("lines"))
    near = lambda i: [F.get("lines", i + k)[c].alias(f"{c}{k + most - 1}") for k in range(1 - most, most) for c in ("h", "i", "n")]
    each = hashed.select("doc_id", "tag", F.explode(F.transform("lines", lambda _, i: F.struct(*near(i)))).alias("x"))
    here = [F.col(f"x.{c}{most - 1}") for c in ("h", "i")]
    found = each.select(here[0].alias("fp"), here[1].alias("at"), "doc_id", "tag", selecting(characters, most).alias("all"))
    return found.select("fp", "at", "doc_id", "tag", F.explode_outer("all").alias("w")).where("w is not null").select("fp", "at", "doc_id", "tag", "w.context", "w.rows")


def repeated_runs(docs: DataFrame, characters: int = CHARACTERS, most: int = LINES) -> DataFrame:
    """(doc_id, tag, gone): indices of the lines of a document that belong to a run found earlier.

    Fingerprints that stand at one place only are done with. The places of one fingerprint meet by what stands around them, window by window:
    each later one is compared with the earliest with the same lines to both sides, never with each other, so that a line in a third of all
    documents costs a row each. Windows of one document that match overlap and make up its run. Where Spark groups it combines before it shuffles.
    """
    found = written(fingerprints(docs, characters, most), "line-prints")
    at = F.struct("doc_id", "tag", "at")
    shared = found.groupBy("fp").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a <> b").select("fp")
    # Joins are between plain exchanges, of which Spark splits the part of a frequent line; merged at every size.
    places = written(found.join(written(shared, "line-shared").hint("merge"), "fp").select("fp", "doc_id", "tag", "context", "rows"), "line-places")
    place = F.struct("doc_id", "tag", "rows")
    first = places.groupBy("fp", "context").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("fp", "context", "first")
    later = places.join(written(first, "line-firsts").hint("merge"), ["fp", "context"]).where(place > F.col("first"))
    return later.groupBy("doc_id", "tag").agg(F.array_distinct(F.flatten(F.collect_set("rows"))).alias("gone"))


@shielded
def without_repeated_lines(docs: DataFrame, characters: int = CHARACTERS, most: int = LINES, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with ``text`` less its repeated runs of lines, and the long columns ``n_lines`` and ``n_removed`` after it.

    A run is consecutive lines (blank ones not counted) of ``characters`` characters or more, or ``most`` lines or more. A run goes if the
    same lines stand earlier: in a document of smaller doc_id, or earlier in the same one; both are judged on the input. Lines are the same if they
    agree without the spaces around them; those spaces are not counted. Blank lines stay. A null text stays null. Rows that share a doc_id and text count
    as one document; rows with a null doc_id stay as they are. With ``drop_emptied``, documents that had lines and have
    none left go. Columns named ``n_lines`` or ``n_removed`` are replaced.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    runs = written(repeated_runs(docs.select("doc_id", "text"), characters, most), "line-runs")
    runs = runs.select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"), F.col("gone").alias("_gone"))
    joined = docs.select(*columns).join(runs.hint("merge"), (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_tag")), "left")
    lines = lines_of(F.col("text"))
    # The lines are bound once; kept indices keep their order.
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    left = F.transform(F.array(lines), lambda all_: F.array_join(F.transform(kept, lambda i: F.get(all_, i)), "\n"))[0]
    out = joined.select(
        *[F.when(F.col("_gone").isNotNull(), left).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in columns],
        F.size(F.filter(lines, lambda x: trimmed(x) != "")).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
    return out.where("not (n_removed > 0 and n_removed = n_lines)") if drop_emptied else out

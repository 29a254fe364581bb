"""Parsing of chat exports: our own small files, in the shapes that apps write."""

import pytest
from pyspark.sql import functions as F

from tidewater.session import settled
from tidewater.sources import exports, storage, synthetic

IOS = """[14/07/2026, 21:04:11] Sarah: the cat slept on the sofa
then under it

and back on it
[14/07/2026, 21:09:00] ~ Tom: I'll ring them
17/03/2026, 09:1 - broken line
[14/07/2026, 21:10:00] Messages and calls are end-to-end encrypted.
[14/07/2026, 21:11:00] Tom: ‎<attached: 00000012-PHOTO-2026.jpg>
[14/07/2026, 21:12:00] Tom: the bins go out on Friday
[14/07/2026, 21:13:00] Tom: added Jean
[14/07/2026, 21:14:00] Tom: letter.pdf (file attached)
"""
US = """junk before the first
7/4/26, 9:04 PM - Ann: hello
7/25/26, 9:05 PM - Ann: <Media omitted>
"""


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("exports")
    (folder / "ios.txt").write_text("﻿" + IOS, encoding="utf-8", newline="")
    lines = exports.read_lines(spark, str(folder / "ios.txt"))
    return exports.parse(lines, "Europe/London", dayfirst=True)


def test_messages(parsed):
    rows = parsed[0].orderBy("source_ordinal").collect()
    assert [r.message_type for r in rows] == ["text", "text", "system", "image", "text", "system", "document"]
    assert rows[0].text == "the cat slept on the sofa\nthen under it\n\nand back on it"
    assert [r.sender_display_name for r in rows[:3]] == ["Sarah", "Tom", None]
    assert str(rows[0].sent_at) == "2026-07-14 20:04:11"
    assert [r.system_kind for r in rows if r.system_kind] == ["encryption", "member_added"]
    assert (rows[3].filename, rows[3].mime_hint, rows[3].text) == ("00000012-PHOTO-2026.jpg", "image/jpeg", None)
    assert rows[6].filename == "letter.pdf"


def test_every_line_is_accounted_for(parsed):
    r = exports.report(*parsed).first()
    assert r.messages + r.system_lines + r.continuations + r.unparsed_lines == r.total_lines == 11
    assert (r.unparsed_lines, r.unparsed_samples) == (1, ["17/03/2026, 09:1 - broken line"])
    assert r.senders == {"Sarah": 1, "Tom": 4}
    assert r.preview_head[0].startswith("the cat") and r.preview_tail[-1].startswith("letter.pdf")


def test_lines_of_messages(parsed):
    found = {(r.line, r.source_ordinal) for r in storage.lines_of_messages(parsed[1]).collect()}
    assert {(1, 0), (2, 0), (4, 0), (5, 1), (7, 2)} <= found and not any(line == 6 for line, _ in found)


def _lines(spark, text):
    rows = [("f", i, line) for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, at int, raw string")


def test_twelve_hour_american(spark):
    lines = _lines(spark, US)
    s = exports.sniff(lines).first()
    assert (s.evidence, s.dayfirst, s.style, s.is_12h, s.has_seconds) == ("month>12", False, "android", True, False)
    rows = exports.parse(lines, "UTC", dayfirst=False)[0].orderBy("source_ordinal").collect()
    assert [str(r.sent_at) for r in rows] == ["2026-07-04 21:04:00", "2026-07-25 21:05:00"]
    assert [r.message_type for r in rows] == ["text", "unknown"]


@pytest.mark.parametrize(
    "stamps, proof",
    [(["01/02/2026, 10:00"], "none"), (["13/02/2026, 10:00"], "day>12"), (["02/13/2026, 10:00"], "month>12"), (["13/02/2026, 10:00", "02/13/2026, 10:00"], "conflict"), (["2026/07/14, 10:00"], "none")],
)
def test_evidence(spark, stamps, proof):
    assert exports.sniff(_lines(spark, "\n".join(f"{s} - A: x" for s in stamps))).first().evidence == proof


def test_a_long_body_is_cut_and_its_lines_counted(spark):
    text = "01/02/2026, 10:00 - A: " + "x" * 7990 + "\n" + "y" * 20 + "\nz"
    messages, lines = exports.parse(_lines(spark, text), "UTC", dayfirst=True)
    row = messages.first()
    assert len(row.body) == 8000 and row.body.endswith("\n" + "y" * 9) and row.truncated and row.n_lines == 1
    r = exports.report(messages, lines).first()
    assert (r.total_lines, r.messages, r.continuations, r.unparsed_lines) == (3, 1, 0, 2)


def test_an_unreadable_stamp_takes_its_lines_along(spark):
    text = "01/02/2026, 10:00 - A: x\n45/45/2026, 10:00 - B: lost\nmore"
    r = exports.report(*exports.parse(_lines(spark, text), "UTC", dayfirst=True)).first()
    assert (r.messages, r.continuations, r.unparsed_lines) == (1, 0, 2)


def test_empty(spark):
    messages, lines = exports.parse(_lines(spark, "").where("false"), "UTC", dayfirst=True)
    assert messages.count() == lines.count() == exports.sniff(lines.select("file", F.col("n").alias("at"), "raw")).count() == 0


def test_files_are_known_by_their_content(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text("same")
    assert storage.file_hashes(spark, str(tmp_path)).select("sha256").distinct().count() == 1


@pytest.fixture(scope="module")
def big(tmp_path_factory):
    """A file of many records, some of them longer than a block, some longer than a body may be, with broken lines between."""
    import random

    r = random.Random(7)
    lines = ["before the first", "and more"]
    for i in range(400):
        stamp = f"{1 + i // 40:02d}/07/2026, {9 + i % 40 // 4:02d}:{i % 60:02d}"
        lines.append(f"{stamp} - {r.choice(('Ann', '~ Tom', 'Jo'))}: " + "word " * r.randrange(30))
        if i % 50 == 3:
            lines += ["long line " * 20] * r.choice((1, 12, 45, 120))
        lines += ["goes on" for _ in range(r.choice((0, 0, 1, 3)))]
        if i % 61 == 0:
            lines += ["17/03/2026, 09:1 - broken"]
    folder = tmp_path_factory.mktemp("big")
    (folder / "big.txt").write_text("\n".join(lines), newline="")
    return str(folder / "big.txt")


def test_a_file_in_many_blocks_is_that_file(spark, big):
    """Read in one piece and in blocks of 4 kB: the same messages, lines and report."""
    found = []
    for size in ("128m", "4096"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if size == "4096" else "4m")
        try:
            lines = settled(exports.read_lines(spark, big))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        blocks = lines.select("at.block").distinct().count()
        assert blocks == 1 if size == "128m" else blocks > 10
        whole = lines.select("file", "at.row", "raw").withColumnRenamed("row", "at") if size == "128m" else lines
        messages, kinds = exports.parse(whole, "UTC", dayfirst=True, settle=settled)
        report = exports.report(messages, kinds).first().asDict()
        found.append((sorted(messages.collect()), sorted(kinds.select("n", "record", "raw", "kind").collect()), report, exports.sniff(whole).collect()))
    one, many = found
    assert one[0] == many[0] and len(one[0]) == 400 and any(m.truncated for m in one[0])
    assert one[1:] == many[1:]
    counts = one[2]
    assert counts["messages"] + counts["system_lines"] + counts["continuations"] + counts["unparsed_lines"] == counts["total_lines"]


def test_made_up_chats_are_made_in_as_many_tasks_as_shuffles_have(spark):
    files = spark.range(40).coalesce(1).select(F.concat(F.lit("chat-"), F.col("id").cast("string")).alias("file"))
    lines, made = synthetic.chats(files, 10, 7)
    assert lines.rdd.getNumPartitions() == made.rdd.getNumPartitions() == 4
    assert made.count() == 400 and lines.count() == 480

"""Small contracts, one by one: signatures, identifiers, details, labels, orders, gates, clean-ups, budgets and halves."""

from __future__ import annotations

import hashlib
import hmac
import json
import random
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewater.functions import keys, nested
from tidewater.functions import text as x
from tidewater.operators import calls, ingest, mutations, sequences, transcripts
from tidewater.operators import events as ev
from tidewater.session import settled
from tidewater.sources import exports, storage, webhook
from tidewater.sources.keyed import KeyedTable


def test_bodies_are_signed(spark):
    good = hmac.new(b"secret", b'{"event":"message","payload":{}}', hashlib.sha256).hexdigest()
    rows = [(1, '{"event":"message","payload":{}}', good), (2, '{"event":"message","payload":{}}', f"sha256={good.upper()} "), (3, '{"event":"message","payload":{} }', good), (4, '{"event":"message","payload":{}}', None), (5, None, good)]
    found = webhook.checked(spark.createDataFrame(rows, "id long, body string, signature string"), b"secret")
    assert {r.id for r in found.collect()} == {1, 2}
    large = spark.range(1).select(F.concat(F.lit('{"event":"e","payload":{"a":"'), F.repeat(F.lit("x"), F.lit(webhook.MOST_BYTES)), F.lit('"}}')).alias("body"))
    assert webhook.checked(large).count() == 0


def test_changes_of_a_group(spark):
    body = json.dumps({"event": "group.participants", "payload": {"chat_id": "1@g.us", "type": "join", "jids": [" A@S.net ", "b@s.net"], "group_name": "G", "timestamp": "1720000000"}})
    other = json.dumps({"event": "group.joined", "payload": {"chat_id": "1@s.net", "timestamp": "1720000000"}})
    found = webhook.group_events(webhook.checked(spark.createDataFrame([(body,), (other,)], "body string"))).collect()
    assert [(r.group_external_id, r.action, r.jids, r.group_name, str(r.sent_at)) for r in found] == [("1@g.us", "join", ["a@s.net", "b@s.net"], "G", "2024-07-03 09:46:40")]


def test_hidden_addresses_have_the_digests_of_their_standard(spark):
    row = spark.createDataFrame([("203.0.113.7", "tenant:1")], "a string, b string").select(keys.keyed_hash(b"secret")(F.col("a")).alias("h"), keys.lock_key(F.col("b")).alias("l")).first()
    assert row.h == hashlib.blake2b(b"203.0.113.7", key=b"secret", digest_size=16).hexdigest()
    assert row.l == int.from_bytes(hashlib.blake2b(b"tenant:1", digest_size=8).digest(), "big", signed=True)


def test_identifiers_from_names(spark):
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    rows = [(space, "www.example.org"), (space, "ü|2|3"), (space, ""), (None, "x"), (space, None)]
    found = spark.createDataFrame(rows, "s string, n string").select("s", "n", keys.name_uuid(F.col("s"), F.col("n")).alias("u")).collect()
    assert [r.u for r in found] == [str(uuid.uuid5(uuid.UUID(s), n)) if s and n is not None else None for s, n in rows]


def test_details_by_kind(spark):
    fields = "kind string, title string, body string, symptom_name string, severity string, body_site string, duration_text string, appointment_kind string, provider_name string, location string, attendees array<string>, outcome string, follow_up_actions array<string>, medication_name string, dose_text string, medication_action string, prescriber string, note_category string"
    names = [f.split()[0] for f in fields.split(", ")]
    made = lambda **own: tuple(own.get(n) for n in names)
    rows = [made(kind="symptom", title="t", symptom_name="cough", dose_text="5 mg"), made(kind="appointment", title="cancelled it", attendees=["a"]), made(kind="medication", title="t", medication_name="m", medication_action=""), made(kind="note", title="t")]
    found = [json.loads(r.d) for r in nested.of_kind(spark.createDataFrame(rows, fields)).select(nested.details().alias("d")).collect()]
    assert found[0] == {"symptom": "cough", "severity": "unknown", "body_site": None, "duration_text": None}
    assert found[1]["status"] == "cancelled" and found[1]["appointment_kind"] == "other" and found[1]["attendees"] == ["a"]
    assert found[2] == {"medication_name": "m", "dose_text": None, "action": "other", "prescriber": None} and found[3] == {"category": "other"}


def test_labels_are_read(spark, tmp_path):
    label = {"id": "e1", "kind": "note", "occurred_at": "2026-07-14T09:00:00Z", "occurred_at_precision": "day", "title": "t", "must_mention": ["a", "b"], "source_line_numbers": [3, 4], "notes": "n"}
    (tmp_path / "labels.json").write_text(json.dumps([label, label | {"id": "e2", "must_mention": []}]))
    found = storage.labels(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, str(r.occurred_at), r.must_mention, r.source_line_numbers) for r in found] == [("e1", "2026-07-14 09:00:00", ["a", "b"], [3, 4]), ("e2", "2026-07-14 09:00:00", [], [3, 4])]


def test_messages_have_one_order(spark):
    t = datetime(2024, 1, 1)
    rows = [(t, 2, "b"), (t, None, "z"), (t, 10, "a"), (None, 1, "q"), (t, 2, "a")]
    found = spark.createDataFrame(rows, "sent_at timestamp, source_ordinal int, id string").orderBy(*sequences.canonical()).collect()
    assert [(r.source_ordinal, r.id) for r in found] == [(1, "q"), (None, "z"), (2, "a"), (2, "b"), (10, "a")]


def test_only_absent_rows_are_inserted(spark):
    stored, rows = spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k long, v string")
    once = mutations.insert_if_absent(stored, rows, ["k"])
    assert sorted(map(tuple, mutations.insert_if_absent(once, rows, ["k"]).collect())) == [(1, "a"), (2, "b")]


def test_stamps_that_no_format_fits_go_to_the_lenient_parser(spark):
    text = "01/07/2026, 09:00 - Ann: one\n02/07/2026, 9:05 pm - Ann: two\n03/07/2026, 09:00 - Ann: three\n99/99/2026, 09:00 - Ann: never"
    lines = spark.createDataFrame([("f", i, line) for i, line in enumerate(text.split("\n"))], "file string, at int, raw string")
    messages, kinds = exports.parse(lines, "UTC", dayfirst=True)
    assert [(r.body, str(r.sent_at)) for r in messages.orderBy("n").collect()] == [("one", "2026-07-01 09:00:00"), ("two", "2026-07-02 21:05:00"), ("three", "2026-07-03 09:00:00")]
    assert [r.kind for r in kinds.orderBy("n").collect()] == ["start", "start", "start", "unparsed"]


@pytest.mark.parametrize(("dated", "invented", "duplicates", "passed"), [(20, 2, 2, True), (19, 0, 0, False), (30, 3, 0, False), (30, 0, 3, False)])
def test_the_gate_of_scores(spark, dated, invented, duplicates, passed):
    row = spark.createDataFrame([(dated, invented, duplicates)], "dated long, invented long, duplicates long")
    assert ev.passes(row).first().passed is passed


def plain_clean(value):
    """A tree without NULs and lone surrogates, as a walk over it gives."""
    if isinstance(value, str):
        return value.replace("\x00", "").encode("utf-8", "ignore").decode()
    if isinstance(value, list):
        return [plain_clean(v) for v in value]
    return {plain_clean(k): plain_clean(v) for k, v in value.items()} if isinstance(value, dict) else value


def test_payloads_are_cleaned_however_deep(spark):
    r = random.Random(4)
    parts = ["a", "\x00", "\\", "\\u0000", "\\\\u0000", '"', "\ud83d", "\ude00", "😀", "ü", "u0000", "\n", "\x01"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(0, 7)))

    def tree(depth):
        kind = r.random()
        if depth == 0 or kind < 0.3:
            return r.choice((word(), 1, None, True, 1.5))
        return [tree(depth - 1) for _ in range(3)] if kind < 0.6 else {f"{i}{word()}": tree(depth - 1) for i in range(3)}

    trees = [tree(4) for _ in range(300)] + ["\ud83d😀\ude00", {"k\x00": {"\ud83d": ["\x00\x00"]}}, "\\\x00", "\\\\\x00"]
    deep = "\x00"
    for _ in range(400):
        deep = [deep]
    texts = [json.dumps(t) for t in [*trees, deep]]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i long, t string").select("i", x.storable_json(F.col("t")).alias("c")).collect()
    for row in found:
        assert row.c is None if row.i < 0 else json.loads(row.c) == plain_clean(json.loads(texts[row.i]))


def people(seed, n):
    r = random.Random(seed)
    pick = lambda mark, k: r.choice((None, *[f"{mark}{i}@s.net" for i in range(k)]))
    names = [f"Name {i}" for i in range(n // 3)]
    senders = [("t", pick("44", n), pick("99", n), r.choice((None, *names))) for _ in range(n)] + [("u", None, None, "Name 1")]
    members = [("t", f"m{i}", r.choice((*names, "")), f"44{i}@s.net" if i % 2 else None, f"99{i + 1}@s.net" if i % 3 == 0 else None, None) for i in range(n // 2)]
    return senders, members


@pytest.mark.parametrize("seed", range(2))
def test_people_by_components_are_those_of_the_tenant(spark, seed):
    senders, members = people(seed, 90)
    s = spark.createDataFrame(senders, "tenant_id string, wa_jid string, wa_lid string, display_name string")
    m = spark.createDataFrame(members, "tenant_id string, member_id string, display_name string, wa_jid string, wa_lid string, created_at timestamp")
    whole, parts = ([sorted(map(str, df.collect())) for df in ingest.resolve(s, m, most)] for most in (10**6, 8))
    assert whole == parts


def test_the_second_half_may_read_the_end_of_the_first(spark):
    rows = [(1, 0, -1, "before", True)] + [(1, 0, i + 1, f"line {i}", False) for i in range(70)]
    chunks = spark.createDataFrame(rows, "t long, chunk_id long, chunk_place long, text string, context boolean")

    def render(some):
        lines = F.transform(F.array_sort(F.collect_list(F.struct(~F.col("context"), "chunk_place", "text", "context"))), lambda q: F.concat(F.when(q["context"], "c ").otherwise("m "), q["text"]))
        return some.groupBy("t", "chunk_id").agg(F.array_join(lines, "\n").alias("prompt"))

    def call(request):
        lines = request["prompt"].split("\n")
        return {"status": "truncated"} if len(lines) > 60 else {"output": json.dumps({"lines": lines})}

    got = {r.chunk_id: json.loads(r.output)["lines"] for r in calls.called_down(chunks, ["t"], render, call, settled).collect()}
    assert got["0.1"] == ["c before", *[f"m line {i}" for i in range(35)]]
    assert got["0.2"] == [*[f"c line {i}" for i in range(15, 35)], *[f"m line {i}" for i in range(35, 70)]]


def test_a_run_stops_when_it_has_spent_its_limit_and_goes_on_after_a_crash(spark, tmp_path):
    """Two runs of twelve requests, a dollar each; the caller dies once, and nobody whose answer is in the audit is asked twice."""
    asked = tmp_path / "asked"
    asked.mkdir()
    requests = spark.createDataFrame([(t, i, f"{t}{i}") for t in ("a", "b", "c") for i in range(1, 13)], "run string, no long, prompt string")
    spent = spark.createDataFrame([("c", "15.00"), ("a", "14.99")], "run string, spent string").withColumn("spent", F.col("spent").cast("decimal(10,2)"))
    runs = KeyedTable(spark, str(tmp_path / "runs"), ["run", "no"], buckets=4)
    dies = tmp_path / "dies"
    dies.write_text("")

    def call(request):
        with open(asked / request["prompt"], "a") as f:
            f.write("x")
        if request["prompt"] == "a6" and dies.exists():
            dies.unlink()
            raise SystemExit("the machine is gone")
        return {"output": "{}", "input_tokens": 1_000_000, "output_tokens": 0}

    prices = {"m": ("1", "1")}
    args = (requests, ["run"], "no", call, runs, "6", "m", prices, spent)
    with pytest.raises(Exception):  # noqa: B017
        calls.called_within(*args)
        spark.conf.get("spark.no.such.setting")  # where Spark itself has tried the lost task again, the run was whole
    done, left = calls.called_within(*args)
    assert sorted((r.run, r.no) for r in done.collect()) == [(t, i) for t in ("a", "b") for i in range(1, 9)]
    assert {(r.run, r.reason) for r in left.collect()} == {("a", "spend_cap"), ("b", "spend_cap"), ("c", "budget")} and left.count() == 4 + 4 + 12
    times = {p.name: len(p.read_text()) for p in asked.iterdir()}
    assert all(times[f"{t}{i}"] == 1 for t in ("a", "b") for i in range(1, 5)) and not any(n.startswith("c") for n in times)
    assert calls.called_within(*args)[0].count() == 16 and {p.name: len(p.read_text()) for p in asked.iterdir()} == times


def test_voice_notes_are_written_down(spark, tmp_path):
    """Bytes up to a limit go to a function of our own: one that fails once, one that fails for good, one too large, silence."""
    audio = tmp_path / "audio"
    audio.mkdir()
    for name, content in {"1.ogg": b"one" * 1000, "2.ogg": b"two", "3.ogg": b"bad", "4.ogg": b"x" * 5000, "5.ogg": b"hush"}.items():
        (audio / name).write_bytes(content)
    (tmp_path / "once").write_text("")
    once = str(tmp_path / "once")

    def call(content, name):
        import os

        if content == b"bad":
            raise ValueError("not audio")
        if content == b"two" and os.path.exists(once):
            os.unlink(once)
            raise calls.TransientError
        return {"text": "" if content == b"hush" else f"words of {name.rpartition('/')[2]}", "duration_seconds": 30.0 if content == b"two" else None}

    files = transcripts.media(spark, str(audio), 4000).withColumn("id", F.regexp_extract("file", r"(\d)\.ogg", 1).cast("long"))
    files = files.withColumn("payload", F.when(F.col("id") == 5, '{"duration": 12}').otherwise("{}")).select("id", "file", "content", "payload")
    found = settled(transcripts.transcribed(files, call, "whisper-1", wait=lambda s: None))
    got = {r.id: (r.status, r.attempts, r.words, r.billed_seconds, str(r.cost)) for r in found.collect()}
    assert got == {
        1: ("done", 1, "words of 1.ogg", 1.5, "0.000150"), 2: ("done", 2, "words of 2.ogg", 30.0, "0.003000"), 3: ("failed", 1, None, 0.0, "0.000000"),
        4: ("no_media", 0, None, 0.0, "0.000000"), 5: ("done", 1, "", 12.0, "0.001200"),
    }
    messages = spark.createDataFrame([(i, None, "{}") for i in range(1, 6)], "id long, text string, payload string")
    after = {r.id: (r.text, json.loads(r.payload).get("transcribed")) for r in transcripts.written_down(messages, found.where("status = 'done'")).collect()}
    assert after == {1: ("words of 1.ogg", True), 2: ("words of 2.ogg", True), 3: (None, None), 4: (None, None), 5: (None, None)}

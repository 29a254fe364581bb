"""Chunks, evidence, merges, scores, changes, and calls to a model that isn't there."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewater.functions import money, nested, times
from tidewater.functions import text as x
from tidewater.operators import calls, events, mutations, sequences
from tidewater.sources.storage import VersionedTable

T = datetime(2024, 1, 1)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def chunks(spark, minutes):
    df = spark.createDataFrame([("t", i, T + timedelta(minutes=m)) for i, m in enumerate(minutes)], "t string, id int, at timestamp")
    return sequences.chunked(df, ["t"], "at", [F.col("at"), F.col("id")])


@pytest.mark.parametrize(
    "minutes, sizes",
    [(range(450), [200, 200, 50]), ([*range(79), 79 + 240], [80]), ([*range(80), 79 + 240], [80, 1]), ([0, 14 * 1440], [2]), ([0, 14 * 1440 + 1], [1, 1]), ([], [])],
)
def test_chunks(spark, minutes, sizes):
    found = chunks(spark, minutes).groupBy("chunk_id").count().orderBy("chunk_id").collect()
    assert [r["count"] for r in found] == sizes


def test_context_is_the_last_twenty_within_six_hours(spark):
    df = chunks(spark, [*range(200), 201, 202 + 361])
    found = sequences.contexts(df, ["t"], "at", [F.col("at"), F.col("id")]).orderBy("context_place").collect()
    assert [r.id for r in found] == list(range(180, 200)) and found[0].handle == "c1"
    first, second = sequences.halved(df, ["t"])
    assert {(r.chunk_id, r.half): r["count"] for r in first.groupBy("chunk_id", "half").count().collect()} == {(0, 1): 100, (0, 2): 100}
    assert second.count() == 20


def test_admission_forgets_at_exactly_the_window(spark):
    df = spark.createDataFrame([("t", i, T + timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 3600, 3600, 3601])], "t string, id int, at timestamp")
    found = sequences.admitted(df, ["t"], "at", [F.col("at"), F.col("id")], most=2).orderBy("id").collect()
    assert [r.let_in for r in found] == [True, True, False, True, False, True]


@pytest.mark.parametrize(
    "said, grain, want",
    [("2026-07-14T21:04", "datetime", "2026-07-14 20:04:00"), ("2026-07-14T21:04Z", "exact", "2026-07-14 21:04:00"), ("2026-07-16", "week", "2026-07-13 00:00:00"), ("2026-08", "month", "2026-08-01 00:00:00"), ("2026-07-14", "date", "2026-07-14 00:00:00"), ("soon", "day", "None"), (None, "day", "None")],
)
def test_instants(spark, said, grain, want):
    assert str(value(spark, times.instant(F.lit(said).cast("string"), F.lit(grain), "Europe/London"))) == want


def test_the_fold_of_a_clock_takes_the_earlier_reading(spark):
    assert str(value(spark, times.instant(F.lit("2026-10-25T01:30"), F.lit("exact"), "Europe/London"))) == "2026-10-25 00:30:00"
    assert str(value(spark, times.instant(F.lit("2026-03-29T01:30"), F.lit("exact"), "Europe/London"))) == "2026-03-29 01:30:00"


def test_text(spark):
    assert value(spark, x.slug(F.lit("Dr. Àziz,  Sister — ward 5"))) == "aziz-ward-5"
    assert value(spark, x.fold(F.lit("  ﬁne  STRASSE ß "))) == "fine strasse ss"
    assert value(spark, x.truncated(F.lit("one two three four"), 11)) == "one two…"
    assert value(spark, x.clamp_title(F.lit("  A title... "))) == "A title"
    assert value(spark, x.emergency(F.lit("She can't breathe"))) and not value(spark, x.emergency(F.lit("she had a stroke two years ago")))
    assert value(spark, nested.json_has(F.lit('{"a": null}'), "a"))


def test_money(spark):
    cost = money.token_cost(F.lit("m"), F.lit(5600), F.lit(0), F.lit(760), {"m": ("5", "30")})
    assert str(value(spark, cost)) == "0.050800"
    assert str(value(spark, money.audio_cost(F.lit("whisper-1"), F.lit(20)))) == "0.002000"
    with pytest.raises(Exception, match="no price"):
        value(spark, money.token_cost(F.lit("other"), F.lit(1), F.lit(0), F.lit(1), {"m": ("5", "30")}))


def test_grounding_and_excerpts(spark):
    primary = spark.createDataFrame([("c", "m1", "a", T, "S", "She slept  badly"), ("c", "m2", "b", T, "T", "ring the SURGERY")], "c string, handle string, id string, sent_at timestamp, sender string, text string")
    context = spark.createDataFrame([("c", "c1")], "c string, handle string")
    rows = [
        (0, ["m1", "m2", "m9"], ["ring the surgery", "never said"], "2024-01-02"),
        (1, ["m1"], ["never said"], None),
        (2, ["c1"], ["x"], None),
        (3, [], [], None),
        (4, ["m2"], [], "2030-01-01"),
        (5, ["m2"], [], None),
    ]
    said = spark.createDataFrame([("c", n, h, q, at, "date") for n, h, q, at in rows], "c string, event_no long, source_message_handles array<string>, quotes array<string>, occurred_at string, occurred_at_precision string")
    found = events.grounded(said, primary, context, ["c"], "UTC").orderBy("event_no").collect()
    assert [r.drop_reason for r in found] == [None, "invented_quotes", "context_only_source", "no_valid_handle", "out_of_range_date", None]
    assert found[0].quotes == ["ring the surgery"] and found[0].excerpts[0].message_id == "b" and found[0].invalid_handles == 1


def test_labels_take_predictions_in_turn(spark):
    pairs = spark.createDataFrame([("r", 1, 1, False), ("r", 1, 2, True), ("r", 1, 3, True), ("r", 2, 2, True), ("r", 2, 1, False)], "r string, label_no long, event_no long, dated boolean")
    found = {(r.label_no, r.event_no): r.role for r in events.assigned(pairs, ["r"]).collect()}
    assert found == {(1, 2): "dated", (1, 3): "duplicate", (2, 1): "found"}
    predictions = spark.createDataFrame([("r", 4, ["a"]), ("r", 5, ["z"]), ("r", 2, ["a"])], "r string, event_no long, source_message_ids array<string>")
    taken = spark.createDataFrame([("r", 2)], "r string, event_no long")
    left = events.unclaimed(predictions, taken, spark.createDataFrame([("r", "a")], "r string, id string"), ["r"])
    assert {r.event_no: r.invented for r in left.collect()} == {4: False, 5: True}


def test_upsert_twice_is_upsert_once(spark):
    schema = "t string, k string, title string, sources array<string>, edited_at timestamp, deleted_at timestamp, pinned boolean, user_edited_fields array<string>, updated_at timestamp"
    stored = spark.createDataFrame([("t", "1", "old", ["a"], None, None, False, ["title"], None), ("t", "2", "old", ["a"], None, T, False, None, None)], schema)
    rows = spark.createDataFrame([("t", k, "new", ["b"], None, None, False, None, None) for k in "123"], schema)
    evidence = {"sources": nested.ordered_union(F.col("old.sources"), F.col("new.sources"))}
    once = mutations.upsert(stored, rows, ["t", "k"], ["title"], evidence, F.lit(T))
    twice = mutations.upsert(once, rows, ["t", "k"], ["title"], evidence, F.lit(T))
    want = {"1": ("old", ["a", "b"]), "2": ("old", ["a"]), "3": ("new", ["b"])}
    for df in (once, twice):
        assert {r.k: (r.title, r.sources) for r in df.collect()} == want


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    assert table.overwrite(spark.range(3)) == 1 and table.overwrite(table.read().where("id > 0")) == 2
    assert table.read().count() == 2


def test_calls():
    said = []

    def flaky(request):
        said.append(request)
        if len(said) < 3:
            raise calls.TransientError
        return {"status": "completed", "output": json.dumps({"events": []}), "input_tokens": 5}

    request = {"prompt": "p", "max_output": 4000, "effort": "low"}
    assert calls.answered(flaky, request, wait=lambda _: None)["attempts"] == 3
    widths = []
    cut = calls.answered(lambda r: widths.append((r["max_output"], r["effort"])) or {"status": "truncated"}, request)
    assert cut["status"] == "too_large" and widths == [(4000, "low"), (8000, "none")]
    assert calls.answered(lambda r: {"status": "filtered"}, request)["status"] == "filtered"
    assert calls.answered(lambda r: {"status": "completed", "output": "{"}, request)["error"] == "unreadable"


def test_calls_from_tasks(spark):
    def fake(request):
        return {"status": "completed", "output": json.dumps({"events": [{"kind": "note", "title": request["prompt"]}]}), "output_tokens": 1}

    done = calls.called(spark.createDataFrame([(1, "hello")], "chunk int, prompt string"), fake)
    row = calls.events_of(done, ["chunk"], "kind string, title string").first()
    assert (row.chunk, row.event_no, row.kind, row.title) == (1, 0, "note", "hello")


def test_null_and_large_keys_are_groups_of_their_own(spark):
    """A null tenant's rows are limited together, and ids beyond 2^53 come out as they went in."""
    big = 9_007_199_254_740_993
    rows = [(i, None, f"2024-01-01 00:0{i}:00") for i in range(5)] + [(5, big, "2024-01-01 00:00:00"), (6, big - 1, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "id long, t long, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1)
    let_in = sequences.admitted(df, ["t"], "at", [F.col("at"), F.col("id")], most=2)
    assert {r.id: (r.t, r.let_in) for r in let_in.collect()} == {0: (None, True), 1: (None, True), 2: (None, False), 3: (None, False), 4: (None, False), 5: (big, True), 6: (big - 1, True)}
    chunks = sequences.chunked(df, ["t"], "at", [F.col("at"), F.col("id")])
    assert {(r.id, r.chunk_id, r.chunk_place) for r in chunks.where("t is null").collect()} == {(i, 0, i + 1) for i in range(5)}


def test_chunks_are_those_of_a_row_by_row_walk(spark):
    r = random.Random(3)
    at, rows = 0, []
    for i in range(3000):
        at += r.choice([1, 5, 60, 400, 4000, 50_000])
        rows.append((i, i % 2, at))
    df = spark.createDataFrame(rows, "id long, t long, s long").withColumn("at", F.timestamp_seconds("s"))
    for least, most, gap, span in ((3, 10, 300, 5000), (1, 4, 50, 10**6), (5, 50, 10**6, 2000), (80, 200, 3600, 86400)):
        want, state = {}, {}
        for i, t, s in rows:
            n, first, last, now = state.get(t, (0, 0, 0, 0))
            if n and (s - first > span or n >= least and s - last >= gap or n >= most):
                now, n = now + 1, 0
            first = s if not n else first
            state[t] = (n + 1, first, s, now)
            want[i] = (now, n + 1)
        found = sequences.chunked(df, ["t"], "at", [F.col("at"), F.col("id")], least, most, gap, span)
        assert {x.id: (x.chunk_id, x.chunk_place) for x in found.collect()} == want


def test_efforts_go_down_a_step():
    assert [calls.notch_down(e) for e in ("xhigh", "high", "medium", "low", "none")] == ["high", "medium", "low", "none", "none"]


def test_chunks_too_large_are_asked_in_halves(spark, tmp_path):
    """A model that can't take more than 40 lines: each message is answered once, whatever else a half may read, and every call has a row in the audit."""
    rows = [(1, 0, i + 1, f"line {i}") for i in range(150)] + [(1, 1, i + 1, f"other {i}") for i in range(20)]
    chunks = spark.createDataFrame(rows, "t long, chunk_id long, chunk_place long, text string")

    def render(some):
        lines = F.transform(F.array_sort(F.collect_list(F.struct("chunk_place", "text"))), lambda x: x["text"])
        return some.where("not context").groupBy("t", "chunk_id").agg(F.array_join(lines, "\n").alias("prompt"))

    def call(request):
        n = request["prompt"].count("\n") + 1
        return {"status": "truncated"} if n > 40 else {"output": json.dumps({"n": n}), "input_tokens": n, "output_tokens": 1}

    settled = iter(range(100))

    def settle(df):
        path = str(tmp_path / f"round-{next(settled)}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    found = calls.called_down(chunks, ["t"], render, call, settle)
    got = {r.chunk_id: (r.status, json.loads(r.output)["n"]) for r in found.collect()}
    assert sum(n for _, n in got.values()) == 170 and {s for s, _ in got.values()} == {"completed"} and "1" in got and set(got) - {"1"} == {"0.1.1", "0.1.2", "0.2.1", "0.2.2"}
    audit = calls.audited(found, VersionedTable(spark, str(tmp_path / "runs")), ["t", "chunk_id"], "extract", "m", {"m": ("5", "30")})
    assert audit.count() == 5 and audit.where("cost > 0 and purpose = 'extract'").count() == 5


def test_recorded_answers_are_replayed(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"{i:03d}.json").write_text(json.dumps({"n": i}))
    requests = spark.createDataFrame([("b",), ("a",), ("c",)], "q string")
    found = calls.replayed(requests, calls.recorded(spark, str(tmp_path)), [F.col("q")])
    assert {r.q: r.response and json.loads(r.response)["n"] for r in found.collect()} == {"a": 1, "b": 2, "c": None}


def test_strict_schemas():
    loose = {"type": "object", "default": 1, "properties": {"a": {"type": "string", "default": "x"}, "b": {"anyOf": [{"type": "object", "properties": {}}, {"type": "null"}]}}}
    tight = calls.strict(loose)
    assert tight["required"] == ["a", "b"] and tight["additionalProperties"] is False and "default" not in tight and "default" not in tight["properties"]["a"]
    assert tight["properties"]["b"]["anyOf"][0] == {"type": "object", "properties": {}, "additionalProperties": False, "required": []} and loose["default"] == 1


def _greedy(pairs):
    """Roles of the pairs of one run, label by label."""
    taken, roles = set(), {}
    for label in sorted({p[0] for p in pairs}):
        free = sorted((e, d) for one, e, d in pairs if one == label and e not in taken)
        dated = [e for e, d in free if d]
        for e in dated or [e for e, _ in free[:1]]:
            roles[label, e] = ("duplicate" if dated and e != dated[0] else "dated" if dated else "found")
            taken.add(e)
    return roles


@pytest.mark.parametrize("piece", [5, 16_384])
def test_labels_of_large_runs_take_what_they_would_in_one_go(spark, piece):
    rng = random.Random(piece)
    runs = {r: sorted({(rng.randrange(12), rng.randrange(40)) for _ in range(n)}) for r, n in (("a", 60), ("b", 25), (None, 30), ("c", 3))}
    rows = [(r, a, b, rng.random() < 0.4) for r, some in runs.items() for a, b in some]
    pairs = spark.createDataFrame(rows, "r string, label_no long, event_no long, dated boolean")
    found = {(r.r, r.label_no, r.event_no): r.role for r in events.assigned(pairs, ["r"], piece=piece).collect()}
    want = {(r, *k): role for r in runs for k, role in _greedy([(a, b, d) for run, a, b, d in rows if run == r]).items()}
    assert found == want


def test_candidates_of_a_large_run_come_from_an_index(spark):
    # 100,000 predictions hold common words; every thousandth holds a rare one too.
    n = F.col("id")
    words = F.concat(F.lit("seen at the surgery with a cough "), F.when(n % 1000 == 7, F.concat(F.lit("and xylitol "), n.cast("string"))).otherwise(""))
    predictions = spark.range(100_000).select(F.lit("r").alias("run"), n.alias("event_no"), F.lit("note").alias("kind"), words.alias("searchable"))
    rows = [("r", 0, "note", ["the surgery", "xylitol"]), ("r", 1, "note", ["cough", "zebra"]), ("r", 2, "note", ["xylitol 7007"]), ("r", 3, "other", ["cough"]), ("q", 4, "note", ["cough"]), ("r", 5, "note", ["cough", None]), ("r", 6, "note", None)]
    labels = spark.createDataFrame(rows, "run string, label_no long, kind string, must_mention array<string>")
    met = events.candidates(labels, predictions, ["run"]).groupBy("label_no").count().collect()
    # All pairs of a kind would be 500,000. Label 2 is looked up by "700", which 70007 has too.
    assert {r.label_no: r["count"] for r in met} == {0: 100, 2: 2}
    found = events.scored(labels, predictions, ["run"], F.lit(True)).groupBy("label_no").count().collect()
    assert {r.label_no: r["count"] for r in found} == {0: 100, 2: 1}


def test_texts_of_small_runs_are_compared_where_they_meet(spark):
    day = F.concat(F.lit("day "), F.lpad((F.col("id") % 50).cast("string"), 2, "0"))
    rows = spark.range(1000).select((F.col("id") % 7).alias("run"), F.col("id").alias("no"), day.alias("day"))
    labels = rows.select("run", F.col("no").alias("label_no"), F.lit("k").alias("kind"), F.array("day").alias("must_mention"))
    predictions = rows.select("run", F.col("no").alias("event_no"), F.lit("k").alias("kind"), F.concat(F.lit("on "), "day").alias("searchable"))
    pairs = events.scored(labels, predictions, ["run"], F.lit(True))
    found = {(r.run, r.label_no, r.event_no) for r in pairs.collect()}
    assert found == {(a % 7, a, b) for a in range(1000) for b in range(a % 7, 1000, 7) if a % 50 == b % 50}
    # Pairs that don't hold are never handed on: the one join has the texts in its condition.
    plan = [line for line in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert len(plan) == 1 and "searchable" in plan[0]


@pytest.mark.parametrize("few", [0, 60, 256])
def test_candidates_leave_out_no_pair(spark, few):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé\n𝔸") for _ in range(rng.randrange(6)))
    labels = [(i, rng.choice("xy"), [word() for _ in range(rng.randrange(3))]) for i in range(40)] + [(40, None, ["a"]), (41, "x", [])]
    texts = [(i, rng.choice("xy"), "".join(word() for _ in range(rng.randrange(8)))) for i in range(120)] + [(120, "x", None), (121, None, "aab"), (122, "x", "")]
    left = spark.createDataFrame(labels, "label_no long, kind string, must_mention array<string>")
    right = spark.createDataFrame(texts, "event_no long, kind string, searchable string")
    found = {(r.label_no, r.event_no) for r in events.scored(left, right, [], F.lit(None), few=few).collect()}
    assert found == {(i, j) for i, k, must in labels for j, kind, text in texts if k is not None and k == kind and all(text is not None and m in text for m in must)}


def test_a_recorded_run_is_replayed(spark, tmp_path):
    asked = spark.createDataFrame([(3, "z"), (1, None), (2, "y")], "n int, output string")
    kept = calls.record(asked, [F.col("n")], str(tmp_path))
    again = calls.replayed(asked.select("n"), kept, [F.desc("n")])
    assert {(r.n, r.number, r.response) for r in again.collect()} == {(3, 1, None), (2, 2, "y"), (1, 3, "z")}
    assert calls.replayed(asked.select("n").limit(0), kept, [F.col("n")]).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_mentions_of_large_events_are_merged_like_those_of_small_ones(spark, seed):
    rng = random.Random(seed)
    some = lambda *of: rng.choice(of)
    lists = lambda: some(None, [], [some("a", "b", "c", None) for _ in range(rng.randrange(4))])
    rows = [
        (some("t", None), f"k{rng.randrange(3)}", rng.randrange(20), f"Title {n}", some(None, "", "x", "yy", "zz"), some(None, "", "here"), some(None, f"2024-01-0{n % 9 + 1}"), some("date", "exact", "week", "month", "unknown", "odd", None),
         some(None, "", f"basis {n}"), some(True, True, True, True, False, None) if seed == 1 else some(True, None), some("high", "medium", "low", None), lists())
        for n in range(90)
    ]
    schema = "tenant_id string, dedup_key string, no int, title string, body string, location string, occurred_at string, occurred_at_precision string, date_basis string, is_future boolean, confidence string, source_message_handles array<string>"
    mentions = spark.createDataFrame(rows, schema)
    merge = lambda piece: sorted(map(str, events.absorbed(mentions, ["tenant_id", "dedup_key"], ["no"], piece=piece).collect()))
    want = merge(1000)
    assert len(want) == 6 and merge(4) == want and merge(15) == want

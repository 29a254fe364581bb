"""The corpus operators on small tables: brute force, round trips, held-out accuracy, and rows that are out of the ordinary."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF, same_rows
from tidewater.llm import chat, decontaminate, fmindex, html, language, linededup, mixing, nearcopies, queries, rules, simhash, substring, subwords
from tidewater.llm.common import components, held_out, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(300)]


def documents(spark, texts, lang="en"):
    rows = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], lang, "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    """Empty, null, blank and very long texts, exact copies, rows without id, repeated rows."""
    r = random.Random(1)
    base = " ".join(r.choice(WORDS) for _ in range(80))
    long = " ".join(r.choice(WORDS) for _ in range(20_000))
    return ["", None, " \t\n ", base, base, base + " more", long, long[: len(long) // 2], "one", "x y z", (None, base), (None, None), (3, base), "ü ß é " * 40, "a\n\nb\n a \na"]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, odd_texts()).withColumns({"fp": F.lit(1), "start": F.lit(2), "n_lines": F.lit("x"), "component": F.lit(3)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_are_those_of_the_sql(spark, duck, name):
    same_rows(queries.queries()[name](spark, SF), duck, queries.oracle_sql()[name])


# Rules


def test_binomial_tail(spark):
    from math import comb

    cases = [(10, 0, 0.1), (50, 3, 0.02), (400, 9, 0.01), (5, 5, 0.5), (3, 0, 0.9)]
    df = spark.createDataFrame(cases, "n long, x long, p double")
    for row in df.select("*", rules.tail(F.col("n"), F.col("x"), F.col("p")).alias("t")).collect():
        want = sum(comb(row.n, k) * row.p**k * (1 - row.p) ** (row.n - k) for k in range(row.x + 1))
        assert row.t == pytest.approx(want, rel=1e-9)


def test_rules_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = rules.judged(odd, labels)
    assert found.count() == odd.count()
    row = found.where("doc_id = 8").first()
    assert (row.n_words, row.base_failed, row.kept) == (1, True, False)
    assert found.where("doc_id = 3").select("n_repeat_words").distinct().count() == 1
    assert rules.judged(none, labels).count() == 0
    assert rules.judged(odd, labels.where("false")).where("not base_failed and not kept").count() == 0


def test_the_bound_stops_inside_the_grid_and_differs_by_stratum(spark):
    """Goods of stratum a spread over all levels, those of b don't; c has too few to certify anything."""
    grid = {"x": [0.95 - 0.05 * i for i in range(19)], "y": [2.0] * 19}
    rows = [("a", i / 400, 0.0) for i in range(400)] + [("b", 0.01, 0.0)] * 200 + [("c", 0.01, 0.0)] * 10
    holdout = spark.createDataFrame(rows, "s string, x double, y double").withColumn("good", F.lit(True))
    found = {r.stratum: r for r in rules.cutoffs(holdout, "s", 0.2, 0.05, grid).collect()}
    assert set(found) == {"a", "b"} and found["b"].level == 18 and found["b"].cutoffs == {"x": pytest.approx(0.05), "y": 2.0}
    # 0.8 would reject a fifth; the bound lets fewer go, but some.
    assert 0 < found["a"].rejected < 80 and found["a"].cutoffs["x"] == pytest.approx(0.85)


def test_false_rejections_stay_within_the_risk(spark):
    """Over many draws, the certified level's true share of false rejections is above the risk no more often than the error allows."""
    r, draws, error, risk = random.Random(5), 300, 0.1, 0.2
    grid = {"x": [1 - 0.02 * (i + 1) for i in range(40)]}
    rows = [(i, r.random()) for i in range(draws) for _ in range(120)]
    holdout = spark.createDataFrame(rows, "s int, x double").withColumn("good", F.lit(True))
    found = rules.cutoffs(holdout, "s", risk, error * draws, grid).collect()  # the error of each stratum is ``error``
    wrong = sum(1 - x.cutoffs["x"] > risk + 1e-9 for x in found)
    assert len(found) > 250 and wrong <= draws * error * 1.5 and max(x.cutoffs["x"] for x in found) > min(x.cutoffs["x"] for x in found)


def test_rules_reject_more_than_the_base_at_small_scale(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    found = rules.judged(docs, labels)
    assert found.where("not base_failed and not kept").groupBy("stratum").count().count() >= 2


# Line dedup


def brute_lines(rows, characters=linededup.CHARACTERS, most=linededup.LINES):
    """Texts without the lines of any run, of whatever length, that counts and stands earlier too."""
    lines = {d: [(i, x.strip(" \t\r\f\x0b")) for i, x in enumerate(t.split("\n"))] for d, t in rows}
    lines = {d: [(i, x) for i, x in found if x] for d, found in lines.items()}
    seen, gone = set(), defaultdict(set)
    for d, found in sorted(lines.items()):
        for a in range(len(found)):
            for b in range(a + 1, len(found) + 1):
                run = tuple(x for _, x in found[a:b])
                if len(run) < most and sum(map(len, run)) < characters:
                    continue
                if run in seen:
                    gone[d] |= {i for i, _ in found[a:b]}
                seen.add(run)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}


def test_line_runs(spark, odd, none):
    long = "a line that is long enough by itself"
    passage = " ".join(f"word{i}" for i in range(60))
    texts = ["a\nb\nc", "x\na\n\nb\n c \ny", "b\na", long, f"q\n{long} \nz", f"q\n{long}\nq", None, "", "a\nb\nc", passage, f"{long[:9]}\n{passage}\nend"]
    found = {r.doc_id: (r.text, r.n_removed) for r in linededup.without_repeated_lines(documents(spark, texts)).collect()}
    want = ["a\nb\nc", "x\n\ny", "b\na", long, "q\nz", "q", None, "", "", passage, f"{long[:9]}\nend"]
    assert {k: v[0] for k, v in found.items()} == dict(enumerate(want)) and [found[i][1] for i in range(11)] == [0, 3, 0, 0, 1, 2, 0, 0, 3, 0, 1]
    out = linededup.without_repeated_lines(odd)
    assert out.count() == odd.count() and set(out.columns) == set(odd.columns) | {"n_removed"}
    assert linededup.without_repeated_lines(none).count() == 0
    assert linededup.without_repeated_lines(documents(spark, [long, long]), drop_emptied=True).count() == 1


@pytest.mark.parametrize("characters, most", [(24, 3), (6, 4), (1, 1), (40, 2)])
def test_lines_against_brute_force(spark, characters, most):
    """Runs of every length, whose fingerprints lie at either end and inside, with short, long, blank and frequent lines."""
    r = random.Random(7)
    short, long = [f"s{i}" for i in range(12)], [f"this is long line number {i} of a few" for i in range(12)]
    passages = [[r.choice(short + long) for _ in range(r.randint(1, 7))] for _ in range(8)]
    rows = []
    for i in range(60):
        lines = [r.choice([*short, f"own line {i} {r.random()}", "", "  ", "menu"]) for _ in range(r.randint(0, 6))]
        for p in r.sample(passages, r.randint(0, 3)):
            at = r.randint(0, len(lines))
            lines[at:at] = p
        rows.append((i, "\n".join(lines)))
    found = linededup.without_repeated_lines(documents(spark, rows), characters, most)
    assert {x.doc_id: x.text for x in found.collect()} == brute_lines(rows, characters, most)


def test_few_lines_are_selected_where_windows_are_long(spark):
    """Winnowing's point: windows of many short lines share their smallest."""
    docs = documents(spark, ["\n".join(f"{i:02d}" for i in range(60))])
    assert linededup.fingerprints(docs, 10**6, 8).select("at").distinct().count() < 30


# Chat


def test_chat_round_trip_and_states(spark):
    nasty = "&amp;&lt;/turn>###  </turn>\n### user: x &num; ##&num;"
    turns = [(1, 0, "system", "s"), (1, 1, "user", nasty), (1, 2, "assistant", nasty), (2, 0, "assistant", "no"), (3, 0, "user", None), (4, None, None, None), (None, 0, "us:er", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1)).withColumn("segments", F.lit(2))
    formatted = chat.format_conversations(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.p] for r in formatted.select("conv_id", chat.parse(F.col("formatted")).alias("p")).collect()}
    assert back == {1: [("system", "s"), ("user", nasty), ("assistant", nasty)], 2: [("assistant", "no")], 3: [("user", "")], 4: [("", "")], None: [("us:er", "")]}
    assert {r.conv_id: r.state for r in formatted.collect()} == {1: "answered", 2: "invalid", 3: "asked", 4: "invalid", None: "invalid"}
    one = chat.digests(formatted).where("conv_id = 1").first()
    assert (one.n_turns, one.loss_chars) == (3, len(nasty)) and one.loss_sha256 == hashlib.sha256(nasty.encode()).hexdigest()
    assert chat.format_conversations(df.where("false")).count() == 0


# Classifiers


def test_quality_on_held_out_documents(spark):
    found = queries.op4_quality_classifier(spark, SF)
    assert found.count() == table(spark, SF, "documents").count() and found.where("score < 0 or score > 1 or score is null").count() == 0
    judged = found.join(table(spark, SF, "labels"), "doc_id").where("held_out")
    assert judged.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] >= 0.85


def test_quality_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    model = subwords.fit(odd, labels)
    assert subwords.scores(odd, model).count() == odd.count() and subwords.scores(none, model).count() == 0
    assert subwords.scores(odd, subwords.fit(odd, labels.where("false"))).select("score").distinct().count() == 1


def test_language_on_held_out_documents(spark):
    found = queries.op7_language_id(spark, SF).where("held_out").join(table(spark, SF, "documents"), "doc_id").where("lang is not null")
    assert found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] >= 0.95


def test_language_on_odd_rows(spark, odd, none):
    model = language.fit(odd)
    found = {r.doc_id: r.lang_pred for r in language.identify(documents(spark, ["", None, "123 !", "word"]), model).collect()}
    assert found == {0: "und", 1: "und", 2: "und", 3: "en"}
    assert language.identify(odd, model).count() == odd.count()
    assert language.identify(odd, language.fit(none)).where("lang_pred <> 'und'").count() == 0


# Substring dedup


def brute_repeats(rows, window):
    seen, out = set(), {}
    for doc, words in sorted(rows):
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("crowded, shard", [(4096, 400_000), (1, 400), (3, 1000)])
def test_substrings_against_brute_force(spark, crowded, shard):
    r = random.Random(2)
    passages = [[r.choice(WORDS) for _ in range(r.randint(15, 60))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = [r.choice(WORDS) for _ in range(r.randint(0, 50))]
        for p in r.sample(passages, r.randint(0, 3)):
            at = r.randint(0, len(words))
            words[at:at] = p
        rows.append((i, words))
    rows.append((60, ["z"] * 90))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = substring.without_repeats(docs, crowded=crowded, shard=shard)
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in found.collect()} == brute_repeats(rows, substring.WINDOW)


def test_substrings_on_odd_rows(spark, odd, none):
    found = substring.without_repeats(odd)
    assert found.count() == odd.count() and substring.without_repeats(none).count() == 0
    assert found.where("doc_id = 4").first().n_removed == 80 and found.where("doc_id = 1").first().n_words == 0


def test_matching_statistics():
    import numpy as np

    r = random.Random(3)
    text = np.array([r.randint(0, 3) for _ in range(300)])
    index = fmindex.FMIndex(text, 6)
    length, _, _ = index.statistics(np.arange(300))
    places = defaultdict(set)
    for n in range(1, 7):
        for i in range(300 - n + 1):
            if 0 not in text[i : i + n]:
                places[tuple(text[i : i + n])].add(i)
    for end in range(300):
        want = max([n for n in range(1, 7) if end - n + 1 >= 0 and len(places.get(tuple(text[end - n + 1 : end + 1]), ())) > 1], default=0)
        assert length[end] == want


# Pages


def test_main_text():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><h1>A &amp; B</h1><p>One  two\nthree&nbsp;four " + "word " * 40 + "</p><script>if (a<b) x()</script>"
    page += "<p>Second <b>bold</b> part " + "more " * 40 + "</p><div class='comments'><p>nice post " + "yes " * 50 + "</p></div><footer>© us</footer></body></html>"
    text = html.main_text(page)
    assert "One two three four word" in text and "Second bold part more" in text
    assert not any(x in text for x in ("Home", "nice post", "© us", "x()", "p{}"))
    assert html.main_text("") == html.main_text("<p>") == html.main_text("<!-- ") == "" and html.main_text("<div>a < b") != ""


def test_pages_on_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, ""), (2, "v", "<p>" + "long " * 200_000)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    found = html.extract(pages).collect()
    assert len(found) == 4 and [r.n_chars for r in found if r.page_id == 2] == [999_999]
    assert html.extract(pages.where("false")).count() == 0


# Mixing


def test_every_prefix_has_its_shares(spark):
    sources = ["a"] * 700 + ["b"] * 260 + [None] * 40
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "doc_id long, source string").withColumn("mix_slot", F.lit("x"))
    out = mixing.mix(docs, {"a": 2.0, "b": 1.0, None: 1.0}, block=4).collect()
    assert sorted(r.doc_id for r in out) == list(range(1000)) and len({r.mix_position for r in out}) == 1000
    slots = {r.mix_slot: r.source or "" for r in out}
    assert sorted(slots) == list(range(len(slots)))
    first = max(r.mix_slot for r in out if r.mix_phase == 0) + 1
    shares, seen = {"a": 0.5, "b": 0.25, "": 0.25}, Counter()
    for slot in range(first):
        seen[slots[slot]] += 1
        assert all(abs(seen[s] - w * (slot + 1)) < 1 for s, w in shares.items())
    assert mixing.mix(docs.where("false")).count() == 0
    # Slots, releases and deadlines of a block are those of its number in its phase.
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in out)


@pytest.mark.parametrize("n_sources, blocks", [(10, 4000), (100, 4000), (400, 6000)])
def test_shares_are_those_of_the_weights_given(n_sources, blocks):
    from fractions import Fraction

    weights = {"hot": 0.5} | {f"s{i}": 0.5 / (n_sources - 1) for i in range(n_sources - 1)}
    total = sum(Fraction(w) for w in weights.values())
    shares = {s: Fraction(w) / total for s, w in weights.items()}
    seen, blocks_seen, last = Counter(), set(), -1
    for s, k, phase, slot, release, deadline in mixing.schedule([(s, int(blocks * 0.5) if s == "hot" else blocks, w) for s, w in weights.items()]):
        assert slot == last + 1 and release <= slot < deadline and (s, k) not in blocks_seen
        last = slot
        blocks_seen.add((s, k))
        if phase:
            break
        seen[s] += 1
        for x in ("hot", s, "s0", "s8"):
            assert abs(seen[x] - shares[x] * (slot + 1)) < 1
    assert seen["hot"] == blocks * 0.5


@pytest.mark.parametrize("weights", [(2.0, 1.0), (1.0, 1e-6), (2**0.5, 3**0.5, 3.14159265, 1 / 7), (5.0, 5.0, 5.0)])
def test_deviation_stays_below_a_block_for_long(weights):
    from fractions import Fraction

    total, slots = sum(Fraction(w) for w in weights), 100_000
    shares, seen = [Fraction(w) / total for w in weights], [0] * len(weights)
    for s, _, phase, slot, *_ in mixing.schedule([(str(i), slots, w) for i, w in enumerate(weights)]):
        if slot == slots or phase:
            break
        seen[int(s)] += 1
        if slot % 97 == 0 or slot > slots - 50:
            assert all(abs(n - share * (slot + 1)) < 1 for n, share in zip(seen, shares, strict=True))
    assert slot >= slots - 1


def test_schedule_is_that_of_a_plain_search():
    """At each slot, of all released blocks the one of earliest deadline, then largest weight, then least name."""
    r = random.Random(14)
    for _ in range(20):
        given = [(f"s{i}", r.randint(1, 30), float(r.randint(1, 9))) for i in range(r.randint(1, 5))]
        left = {s: n for s, n, _ in given}
        weight, used, want = {s: int(w) for s, _, w in given}, Counter(), []
        while left:
            total, done = sum(weight[s] for s in left), Counter()
            for slot in range(10**6):
                ready = [s for s in left if done[s] * total // weight[s] <= slot]
                s = min(ready, key=lambda s: (-(-(done[s] + 1) * total // weight[s]), -weight[s], s))
                want.append((s, used[s]))
                done[s] += 1
                used[s] += 1
                if used[s] == left[s]:
                    del left[s]
                    break
        assert [(s, k) for s, k, *_ in mixing.schedule(given)] == want


def test_mixing_odd_rows(spark, odd):
    out = mixing.mix(odd, block=2)
    assert out.count() == odd.count() and out.select("mix_position").distinct().count() == odd.count()
    assert set(out.columns) == set(odd.columns) | {"mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_phase", "mix_position"}


def test_null_and_empty_sources_share_no_block(spark):
    docs = spark.createDataFrame([(i, (None, "", "=")[i % 3]) for i in range(600)], "doc_id long, source string")
    out = mixing.mix(docs, block=8).collect()
    by = defaultdict(set)
    for r in out:
        by[r.mix_slot].add(r.source)
    assert all(len(s) == 1 for s in by.values()) and {s for x in by.values() for s in x} == {None, "", "="} and len(out) == 600


def test_columns_of_any_name_come_through(spark):
    """Names that operators use on the way, on tables that have them: each comes out as it went in."""
    names = ["_hash", "_gone", "_doc", "_tag", "_found", "_place", "_own", "_bucket", "_rank", "_first", "_source", "_kind"]
    r = random.Random(3)
    docs = documents(spark, [" ".join(r.choice(WORDS) for _ in range(30)) for _ in range(12)]).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    benchmark = spark.createDataFrame([(1, "what no document says at all in so many words")], "item_id long, text string")
    for out in (mixing.mix(docs, block=2), linededup.without_repeated_lines(docs), decontaminate.without_contaminated(docs, benchmark), nearcopies.one_of_each(docs)):
        rows = out.collect()
        assert len(rows) == 12 and all(row[n] == f"{n}{row.doc_id}" for row in rows for n in names) and set(docs.columns) <= set(out.columns)


def test_more_sources_than_a_driver_would_list(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("site"), F.col("id") % 1500)).alias("source"))
    out = mixing.mix(docs, block=4).collect()
    assert sorted(r.doc_id for r in out) == list(range(9000)) and len({r.mix_position for r in out}) == 9000
    assert {r.mix_slot for r in out} == set(range(750 + 1500)) and all(r.mix_release <= r.mix_slot < r.mix_deadline for r in out)


def test_every_source_runs_out():
    given = [("a", 5, 3.0), ("b", 1, 0.1), ("c", 4, 0.0), ("d", 2, 0.0), ("e", 0, 1.0)]
    found = list(mixing.schedule(given))
    assert Counter(x[0] for x in found) == {"a": 5, "b": 1, "c": 4, "d": 2} and [x[3] for x in found] == list(range(12))
    assert {x[0] for x in found[6:]} == {"c", "d"} and list(mixing.schedule([])) == []


# SimHash


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, odd):
    found = simhash.fingerprints(odd).join(odd.select("doc_id", "text"), "doc_id").collect()
    assert found and all(r.fp & (1 << 64) - 1 == brute_print(r.text) for r in found)


def brute_components(prints, radius):
    parent = {p: p for p in prints}

    def top(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= radius:
                parent[top(b)] = top(a)
    groups = defaultdict(set)
    for p in prints:
        groups[top(p)].add(p)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("radius, crowded", [(2, 128), (2, 2), (3, 4), (1, 128)])
def test_links_join_what_all_pairs_would(spark, radius, crowded):
    r = random.Random(4)
    centres = [r.getrandbits(64) for _ in range(12)]
    prints = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for c in centres for _ in range(12)} | {r.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    found = components(simhash.links(df, radius, crowded))
    groups = defaultdict(set)
    for row in found.collect():
        groups[row.component].add(row.node & (1 << 64) - 1)
    alone = prints - set().union(*groups.values()) if groups else prints
    assert {frozenset(g) for g in groups.values()} | {frozenset([p]) for p in alone} == brute_components(prints, radius)


def test_no_and_one_fingerprint(spark):
    one = spark.createDataFrame([(5,)], "fp long")
    assert simhash.links(one).count() == 0 == simhash.links(one.where("false")).count()


def test_simhash_on_odd_rows(spark, odd, none):
    found = simhash.near_duplicates(odd)
    assert found.count() == odd.count() and simhash.near_duplicates(none).count() == 0
    got = {r.doc_id: r.component_id for r in found.collect() if r.doc_id is not None}
    assert got[0] == got[1] == got[2] == 0 and got[3] == got[4] == 3


# Near copies in the pipeline


def brute_near_copies(rows):
    """Texts by (doc_id, text) that have one of smaller doc_id in their group, groups by five-word Jaccard or fingerprints, of all pairs."""
    words = [t.lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    prints = [brute_print(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    n_near = 0
    for i in range(len(rows)):
        for j in range(i):
            near = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            n_near += near and rows[i][1] != rows[j][1]
            if near or (prints[i] ^ prints[j]).bit_count() <= 2:
                top[find(i)] = find(j)
    groups = defaultdict(list)
    for i, row in enumerate(rows):
        groups[find(i)].append(row)
    return sorted(set(rows) - {min(g) for g in groups.values()}), n_near


def test_near_copies_are_those_of_all_pairs(spark):
    r = random.Random(8)
    texts = []
    for _ in range(8):
        base = [r.choice(WORDS) for _ in range(r.randint(20, 150))]
        texts.append(base)
        for _ in range(9):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 30))):
                copy[r.randrange(len(copy))] = "new"
            texts.append(copy)
    r.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    # A text of its own and a near copy that share a doc_id: only the copy goes.
    rows += [(0, " ".join(r.choice(WORDS) for _ in range(60))), (3, " ".join([*texts[0], "tail"]))]
    gone, n_near = brute_near_copies(rows)
    kept = {(x.doc_id, x.text) for x in nearcopies.one_of_each(documents(spark, rows)).collect()}
    assert n_near > 50 and sorted(set(rows) - kept) == gone


def test_copies_of_one_text_are_joined_through_it(spark):
    """Copies that are alike to what they were made from, not to each other, and chains of small changes; few pairs are compared."""
    r = random.Random(10)
    base = [f"b{i}" for i in range(200)]
    texts = [base]
    for _ in range(80):
        copy = list(base)
        for at in r.sample(range(200), 4):
            copy[at] = f"new{r.random()}"
        texts.append(copy)
    chain = [f"c{i}" for i in range(120)]
    for i in range(30):
        chain = chain[:4 * i] + [f"d{i}"] + chain[4 * i + 1 :]
        texts.append(list(chain))
    r.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    gone, n_near = brute_near_copies(rows)
    kept = {(x.doc_id, x.text) for x in nearcopies.one_of_each(documents(spark, rows)).collect()}
    assert sorted(set(rows) - kept) == gone and n_near < 80 * 79 / 4 and len(kept) <= 4


def test_pipeline_drops_near_copies(spark, odd, none):
    r = random.Random(9)
    base = [r.choice(WORDS) for _ in range(100)]
    copy = [*base[:50], "x", "y", *base[52:]]
    docs = documents(spark, [" ".join(base), " ".join(copy), " ".join(reversed(base))])
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [0, 2]
    kept = [x.doc_id for x in corpus_pipeline.near_dedup(spark, odd, SF).collect()]
    assert 4 not in kept and kept.count(3) == 1 and 8 in kept and kept.count(None) == 2
    assert corpus_pipeline.near_dedup(spark, none, SF).count() == 0


# Decontamination


def test_leaks_are_found_and_clean_documents_left(spark, none):
    r = random.Random(5)
    many = [f"v{i}" for i in range(5000)]
    items = [[r.choice(many) for _ in range(n)] for n in (3, 30, 30, 45, 60)]
    changed = list(items[3])
    changed[0], changed[-1] = "new", "other"
    filler = lambda n: [r.choice(many) for _ in range(n)]
    texts = [filler(100) + items[1] + filler(50), filler(500), items[0], filler(10) + changed + filler(10), items[4][:30] + filler(60), " ".join(items[2]).upper().split(), None, []]
    docs = documents(spark, [None if t is None else " ".join(t) for t in texts]).withColumn("item_id", F.lit(9))
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    found = {(x.doc_id, x.item_id): x for x in decontaminate.contaminated(docs, benchmark).collect()}
    assert set(found) == {(0, 1), (2, 0), (3, 3), (5, 2)} and found[(0, 1)].first_word == 100
    assert sorted(x.doc_id for x in decontaminate.without_contaminated(docs, benchmark).collect()) == [1, 4, 6, 7]
    assert decontaminate.contaminated(docs, benchmark.where("false")).count() == 0 == decontaminate.contaminated(none, benchmark).count()
    assert decontaminate.contaminated(docs, benchmark, portion=200).count() == 4


def test_leaks_in_long_and_short_texts(monkeypatch):
    r = random.Random(6)
    items = [[f"v{r.randint(0, 5000)}" for _ in range(n)] for n in (20, 40, 60)]
    index = decontaminate.Benchmark([(i, " ".join(t).encode()) for i, t in enumerate(items)])
    filler = lambda n: [f"u{r.randint(0, 5000)}" for _ in range(n)]
    text = " ".join(filler(90) + items[2] + filler(500) + items[0] + filler(70) + items[1] + filler(9)).encode()
    whole = index.matches(text)
    assert [(m[0], m[1], m[2]) for m in whole] == [(0, 650, 20), (1, 740, 40), (2, 90, 60)]
    for stretch in (1, 7, 64, 100):
        monkeypatch.setattr(decontaminate, "STRETCH", stretch)
        assert [m[:3] for m in index.matches(text)] == [m[:3] for m in whole]
    # A text shorter than the item is one window.
    assert [m[:3] for m in index.matches(" ".join(items[2][3:]).encode())] == [(2, 0, 57)]
    assert index.matches(" ".join(items[2][:20]).encode()) == [] == index.matches(b"one two") == index.matches(b"")


def test_altered_items_are_found():
    """Of windows whose five-word Jaccard similarity with an item is 0.8 or more, nearly all are within the radius."""
    r = random.Random(11)
    items = [[f"v{r.randint(0, 3000)}" for _ in range(r.randint(30, 120))] for _ in range(60)]
    index = decontaminate.Benchmark([(i, " ".join(t).encode()) for i, t in enumerate(items)])
    grams = lambda t: Counter(tuple(t[i : i + 5]) for i in range(len(t) - 4))
    near = found = 0
    for i, item in enumerate(items):
        for _ in range(12):
            copy = list(item)
            for _ in range(r.randint(1, 3)):
                copy[r.choice([r.randrange(len(copy)), r.randrange(4)])] = "new"
            both = sum((grams(copy) & grams(item)).values())
            if 5 * both < 4 * (2 * (len(item) - 4) - both):
                continue
            near += 1
            text = [f"u{r.randint(0, 99)}" for _ in range(50)] + copy + [f"u{r.randint(0, 99)}" for _ in range(50)]
            found += i in {m[0] for m in index.matches(" ".join(text).encode())}
    assert near > 300 and found >= 0.98 * near


def brute_leaks(texts, items):
    """(text, item), by their places: items of which a text has a window of the item's length with similarity 0.8 or more, plain or weighted."""
    split = lambda t: t.encode().lower().split()
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    words = [split(t) for t in items]
    bags = [grams(w) for w in words]
    stands = Counter(g for bag in {tuple(w): bag for w, bag in zip(words, bags, strict=True)}.values() for g in bag)
    weight = lambda g: math.log1p(len({tuple(w) for w in words if w}) / max(1, stands[g]))

    def alike(window, bag):
        both, either = window & bag, window | bag
        return max(sum(both.values()) / sum(either.values()), sum(n * weight(g) for g, n in both.items()) / sum(n * weight(g) for g, n in either.items()))

    found = set()
    for d, text in enumerate(map(split, texts)):
        for i, (item, bag) in enumerate(zip(words, bags, strict=True)):
            n, size = min(len(item), len(text)), min(5, len(item))
            shared = [a for a in range(len(text) - size + 1) if tuple(text[a : a + size]) in bag] if bag else []
            starts = {a for at in shared for a in range(max(0, at - n + size), min(at, len(text) - n) + 1)}
            if any(alike(grams(text[a : a + n]), bag) >= 0.8 - 1e-9 for a in starts):
                found.add((d, i))
    return found


def test_items_found_are_those_of_a_plain_search():
    """Words replaced, put in and left out, and items that share passages."""
    r = random.Random(14)
    word = lambda: f"v{r.randint(0, 400)}"
    shared = [word() for _ in range(12)]
    items = [[word() for _ in range(r.randint(8, 60))] for _ in range(30)] + [[*shared, *[word() for _ in range(r.randint(2, 30))]] for _ in range(10)]
    texts, changes = [], []
    for _ in range(160):
        copy = list(r.choice(items))
        how = r.choice(["replaced", "put in", "left out", "as it is"])
        for _ in range(0 if how == "as it is" else r.randint(1, 2)):
            at = r.choice([0, 1, len(copy) - 1, r.randrange(len(copy))])
            copy[at : at + (how != "put in")] = [] if how == "left out" else ["new"]
        texts.append(" ".join([*[word() for _ in range(r.randint(0, 30))], *copy, *[word() for _ in range(r.randint(0, 30))]]))
        changes.append(how)
    items = [" ".join(t) for t in items]
    index = decontaminate.Benchmark([(i, t.encode()) for i, t in enumerate(items)])
    found = {(d, m[0]) for d, text in enumerate(texts) for m in index.matches(text.encode())}
    want = brute_leaks(texts, items)
    assert min(Counter(changes[d] for d, _ in want)[how] for how in set(changes)) > 5
    assert found <= want and len(found) >= 0.98 * len(want), (len(found), len(want))


def test_items_of_many_lengths_take_little_memory():
    r = random.Random(12)
    items = [(n, " ".join(f"v{r.randint(0, 3000)}" for _ in range(n)).encode()) for n in range(5, 305)]
    index = decontaminate.Benchmark(items)
    assert sum(t.nbytes for t in index.filed) <= 300 * 4 * 65_536 and [m[0] for m in index.matches(items[100][1])][:1] == [items[100][0]]


def test_repeated_items_do_not_weigh_their_text_down(spark):
    r = random.Random(13)
    item = [f"v{r.randint(0, 3000)}" for _ in range(50)]
    copy = [*item[:25], "new", *item[26:]]
    benchmark = spark.createDataFrame([(i, " ".join(item)) for i in range(100)] + [(100 + i, f"q{i} " * 30) for i in range(100)], "item_id long, text string")
    for most in (2048, 64):
        found = decontaminate.contaminated(documents(spark, [" ".join(copy)]), benchmark, most_items=most)
        assert sorted(x.item_id for x in found.collect()) == list(range(100))


# Pipeline


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near-duplicates", "decontamination", "source mixing"]
    docs = table(spark, SF, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        if name != "source mixing":
            assert after.columns == list(corpus_pipeline.COLUMNS)
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after.checkpoint() if spark.sparkContext.getCheckpointDir() else after
    assert 0 < before.count() < docs.count()
    leaked = decontaminate.contaminated(before, table(spark, SF, "benchmark")).count()
    assert leaked == 0 and simhash.near_duplicates(before).where("doc_id <> component_id").count() == 0


def test_pipeline_against_plain_stages(spark):
    """All but the learned stage worked out by brute force, each on what the plain stage before it leaves."""
    accepted = {x.doc_id for x in queries.op4_quality_classifier(spark, SF).where("predicted = 1").collect()}
    docs = [(x.doc_id, x.text) for x in table(spark, SF, "documents").collect() if x.doc_id in accepted]
    deduped = brute_lines(docs)
    had = lambda t: any(x.strip(" \t\r\f\x0b") for x in t.split("\n"))
    left = [(d, deduped[d]) for d, t in docs if had(deduped[d]) or not had(t)]
    gone, _ = brute_near_copies(left)
    single = sorted(set(left) - set(gone))
    leaks = {d for d, _ in brute_leaks([t for _, t in single], [x.text for x in table(spark, SF, "benchmark").collect()])}
    want = [row for d, row in enumerate(single) if d not in leaks]
    found = corpus_pipeline.run(spark, SF).orderBy("mix_position").collect()
    assert sorted((x.doc_id, x.text) for x in found) == want and len(docs) > len(left) >= len(single) > len(want) > 50
    counts = Counter(x.source for x in found)
    blocks = {(x.mix_slot, x.source, x.mix_block) for x in found}
    assert Counter(s for _, s, _ in blocks) == {s: -(-n // mixing.BLOCK) for s, n in counts.items()} and len({x.mix_position for x in found}) == len(found)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, odd, none, name, stage):
    """Nulls, empty and long texts, repeated rows, columns of other names; and no rows at all. Labels and items are those of the test tables."""
    after = stage(spark, odd, SF)
    assert set(corpus_pipeline.COLUMNS) <= set(after.columns) and after.count() <= odd.count()
    assert after.select("doc_id", "text").exceptAll(odd.select("doc_id", "text")).count() == 0 or name == "line dedup"
    assert stage(spark, none, SF).count() == 0


def test_accepted_are_those_predicted(spark):
    docs, labels = (table(spark, SF, t) for t in ("documents", "labels"))
    found = queries.op4_quality_classifier(spark, SF).where("predicted = 1").select("doc_id")
    assert sorted(found.collect()) == sorted(subwords.accepted(docs, labels).select("doc_id").collect())


def test_classifiers_in_another_script(spark):
    """Letters of two bytes: n-grams are of characters."""
    from tidewater.llm.common import subword_buckets

    flat, n = subword_buckets(["дом".encode(), b"dom"], (1, 2), 20)
    assert n.tolist() == [1 + 5 + 4] * 2
    r = random.Random(15)
    words = {"ru": ["дом", "кот", "лес", "река", "снег"], "el": ["σπίτι", "γάτα", "δάσος", "ποτάμι", "χιόνι"], "zh": ["房子", "猫", "森林", "河", "雪"]}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(12)), k, "s", 0) for i, k in enumerate(r.choice(list(words)) for _ in range(240))]
    docs = spark.createDataFrame(rows, DOCS)
    found = language.identify(docs, language.fit(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.count() > 30 and found.where("lang_pred <> lang").count() == 0
    assert [language.has_letter(t.encode()) for t in ("½ ² ① 7", "ß", "猫", "_", "½a")] == [False, True, True, False, True]


def test_many_languages_take_fewer_buckets(spark):
    rows = [(i, f"word{i % 600} " * 5, f"l{i % 600:03d}", "s", 0) for i in range(2400)]
    model = language.fit(spark.createDataFrame(rows, DOCS), weights=1 << 18)
    assert len(model.languages) > 550 and model.bits == 8


def test_held_out_is_by_id(spark):
    import zlib

    rows = spark.range(50).select(F.col("id").alias("doc_id"), held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)

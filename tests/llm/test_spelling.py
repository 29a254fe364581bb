"""Spelling variants: automata against all pairs, forms and roots against plain loops, and rows that are out of the ordinary."""

from __future__ import annotations

import itertools
import random
import re
from binascii import crc32
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewater.llm import spelling


def at_one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def made(seed, count, longest=7, letters="abé"):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(1, longest))) for _ in range(count)})


@pytest.mark.parametrize("seed", range(6))
def test_automaton_finds_the_neighbours_of_all_pairs(seed):
    words = made(seed, 150)
    counts = {w: i + 1 for i, w in enumerate(words)}
    entries = [(w.encode("latin-1"), counts[w]) for w in words]
    asked = [*words, "", "zzz", "aaaaaaaaa"]
    for cuts in ([0, len(words)], [0, 7, 60, len(words)]):
        forest = spelling.Forest([spelling.packed(entries[a:b]) for a, b in itertools.pairwise(cuts)])
        for order in (sorted(asked), asked[::-1]):
            for word, nodes in forest.near(w.encode("latin-1") for w in order):
                found = sorted((forest.spelt(x).decode("latin-1"), forest.count(x)) for x in nodes)
                assert found == sorted((w, counts[w]) for w in words if at_one_edit(w, word.decode("latin-1")))


def test_a_trie_is_compact():
    words = [w.encode() for w in made(1, 30_000, 12, "abcdefghij")]
    assert len(spelling.packed([(w, 1) for w in words])) < sum(map(len, words)) * 2.2 + 8 * len(words)


def plain(counts, times=2):
    near = {w: [x for x in counts if at_one_edit(w, x)] for w in counts}
    best = {w: min(xs, key=lambda x: (-counts[x], x)) for w, xs in near.items() if xs}
    form = {w: x for w, x in best.items() if counts[x] >= times * counts[w]}
    rows = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(rows, key=str)


@pytest.mark.parametrize(("shard", "portion"), [(65_536, 32 << 20), (7, 200), (40, 1)])
def test_forms_and_roots_are_those_of_all_pairs(spark, shard, portion):
    r = random.Random(5)
    counts = {w: r.choice((1, 1, 2, 2, 4, 9, 20, 50, 120)) for w in made(9, 120, 6, "abc")}
    found = spelling.grouped(spark.createDataFrame(list(counts.items()), "word string, n long"), shard=shard, portion=portion)
    assert sorted(map(tuple, found.collect()), key=str) == plain(counts)


def plain_words(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def test_words_of_odd_texts(spark):
    r = random.Random(2)
    words = [*made(4, 60, 9, "abcdeÀÉß"), "KelvinK", "İstanbul", "STRASSE", "ÀÉÎ" * 30, "z" * 300]
    rows = [(r.choice((None, i)), " ".join(r.choice(words) for _ in range(200))) for i in range(60)] + [(1, None), (2, ""), (3, "12 -- \n")] * 2 + [(9, "word word2 words " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "run", "h", "doc", "kind", "place")})
    counts = plain_words(rows)
    assert {x.word: x.n for x in spelling.words(docs).collect()} == counts
    assert sorted(map(tuple, spelling.variants(docs).collect()), key=str) == plain(counts)


def test_an_empty_table_has_no_words(spark):
    found = spelling.variants(spark.createDataFrame([], "doc_id long, text string"))
    assert found.collect() == [] and found.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_a_letter_that_repeats_without_end(spark):
    counts = {"x" * 3000: 3, "x" * 3001: 9, "y" + "x" * 2999: 4, "hello": 3}
    found = spelling.grouped(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert sorted(map(tuple, found.collect()), key=str) == plain(counts)

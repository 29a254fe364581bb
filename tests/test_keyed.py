"""Tables by key: what a change writes, writers that meet, deltas that are folded, and the upsert over them."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import mutations
from tidewater.sources.keyed import KeyedTable


def rows(spark, pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def held(table):
    return {r.k: r.v for r in table.read().collect()}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_an_upsert_writes_little(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=16)
    big = spark.range(200_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    table.overwrite(big)
    before = size(tmp_path / "t" / "data")
    table.put(big.where("k % 1000 = 7").withColumn("v", F.lit("new")))  # 0.1 % of the keys, in all buckets
    assert size(tmp_path / "t" / "data") - before < before / 20
    assert table.read().where("v = 'new'").count() == 200 and table.read().count() == 200_000


def test_changes_are_those_of_a_dict(spark, tmp_path):
    r = random.Random(1)
    table, want = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=3, deltas=3), {}
    assert table.read() is None
    for turn in range(14):
        pairs = {r.randrange(30): f"{turn}" for _ in range(r.choice((1, 3, 8)))}
        what = r.choice(("put", "put", "insert", "delete")) if turn else "put"
        if what == "delete":
            table.delete(rows(spark, pairs.items()))
            want = {k: v for k, v in want.items() if k not in pairs}
        else:
            getattr(table, what)(rows(spark, pairs.items()))
            want = want | pairs if what == "put" else pairs | want
        assert held(table) == want
    assert all(len(x) <= 4 for x in table.state()[1].values()) and table.unreferenced()
    table.overwrite(rows(spark, [(1, "only")]))
    assert held(table) == {1: "only"}


def test_two_writers_lose_nothing(spark, tmp_path):
    """One adds to what it read, and another has committed since: in the same bucket it is asked again, in another one it isn't."""
    for buckets in (1, 64):
        table = KeyedTable(spark, str(tmp_path / f"t{buckets}"), ["k"], buckets=buckets)
        table.overwrite(rows(spark, [(1, "a"), (2, "a")]))
        other, asked = KeyedTable(spark, table.path, ["k"], buckets=buckets), []

        def work(stored, other=other, asked=asked):
            if not asked:
                other.put(rows(spark, [(2, "theirs")]))
                if buckets == 1:
                    other.put(rows(spark, [(1, "theirs")]))
            asked.append(1)
            return stored.withColumn("v", F.concat("v", F.lit("+"))), None

        table.change(rows(spark, [(1, "")]), work)
        assert held(table) == ({1: "theirs+", 2: "theirs"} if buckets == 1 else {1: "a+", 2: "theirs"})
        assert len(asked) == (2 if buckets == 1 else 1)


def test_the_log_is_summed_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidewater.sources.keyed.SUMMED", 3)
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=1, deltas=2)
    for i in range(7):
        table.put(rows(spark, [(i, "x")]))
    assert sum(n.startswith("sum-") for n in table._names()) >= 2 and held(table) == {i: "x" for i in range(7)}


def test_a_commit_number_is_taken_once(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    assert table._put("commit-000000000001", {"a": 1}) and not table._put("commit-000000000001", {"a": 2})
    assert table._get("commit-000000000001") == {"a": 1}


@pytest.mark.parametrize("share", [0.1])
def test_upserts_of_events_are_those_of_the_whole_table(spark, tmp_path, share):
    schema = "tenant_id long, dedup_key long, title string, sources array<string>, edited_at timestamp, deleted_at timestamp, pinned boolean, user_edited_fields array<string>, updated_at timestamp"
    r = random.Random(2)
    made = lambda k, own: (k % 3, k, r.choice("abc"), [own], None, None, r.random() < 0.2 and own == "old", r.choice((None, ["title"])) if own == "old" else None, None)
    stored = spark.createDataFrame([made(k, "old") for k in range(200)], schema)
    incoming = spark.createDataFrame([made(k, "new") for k in range(190, 190 + int(200 * share))], schema)
    evidence = {"sources": F.array_union(F.col("old.sources"), F.col("new.sources"))}
    args = (["tenant_id", "dedup_key"], ["title"], evidence, F.lit("2024-01-01").cast("timestamp"))
    table = KeyedTable(spark, str(tmp_path / "t"), ["tenant_id", "dedup_key"], buckets=8)
    table.overwrite(stored)
    mutations.upserted(table, incoming, *args)
    want = mutations.upsert(stored, incoming, *args)
    assert sorted(map(str, table.read().select(*want.columns).collect())) == sorted(map(str, want.collect()))

"""Hot-key paths give the same rows as plain windows, and the ledger the same as a plain loop."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from webloom.operators.ledger import guarded_ledger, skip_immediate_repeats
from webloom.operators.ordered import Ordered, has_hot_key
from webloom.operators.paging import numbered_pages, page, page_after, page_count
from webloom.operators.pool import allot
from webloom.operators.sessions import collect_actions, sessions


KEYS = ["hot", "hot", "a", "b", "c"]


def skewed(spark, count=600, seed=3):
    """Half the rows belong to one key."""
    rng = random.Random(seed)
    data = [(rng.choice(KEYS), i, rng.choice("xyz"), rng.randint(-9, 9)) for i in range(count)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, at int, site string, amount int").repartition(6)


def test_hot_key_check(spark):
    frame = skewed(spark)
    assert has_hot_key(frame, ["k"], 100) and not has_hot_key(frame, ["k"], 1000)
    assert has_hot_key(frame, [], 100)


@pytest.mark.parametrize("keys", [["k"], []])
def test_split_order_equals_plain_window(spark, rows, keys):
    frame = skewed(spark)

    def numbered(hot_rows):
        ordered = Ordered(frame, keys, ["at"], hot_rows)
        return ordered.split, ordered.changed("site", "new").running_sum(F.col("amount"), "total").row_number("n").result()

    plain_split, plain = numbered(10_000)
    hot_split, hot = numbered(20)
    assert (plain_split, hot_split) == (False, True)
    assert rows(hot, *plain.columns) == rows(plain)


def test_null_keys_are_one_key(spark, rows, monkeypatch):
    monkeypatch.setitem(globals(), "KEYS", [None, None, "a"])
    frame = skewed(spark, 200)
    for hot_rows in (10, 1000):
        found = Ordered(frame, ["k"], ["at"], hot_rows).row_number("n").result().filter("k is null").orderBy("at")
        assert [r.n for r in found.collect()] == list(range(1, frame.filter("k is null").count() + 1))
    found = guarded_ledger(frame, "k", ["at"], "amount")
    assert found.columns == [*frame.columns, "accepted", "balance"] and found.count() == frame.count()
    assert {tuple(r) for r in found.filter("k is null").select("accepted", "balance").collect()} == {(False, None)}
    alone = guarded_ledger(frame.filter("k is not null"), "k", ["at"], "amount")
    assert rows(found.filter("k is not null")) == rows(alone)


def test_sessions_on_a_hot_user(spark, rows):
    frame = skewed(spark)
    assert rows(sessions(frame, "k", "site", ["at"], hot_rows=20), "at", "session_id") == rows(
        sessions(frame, "k", "site", ["at"]), "at", "session_id")
    assert rows(skip_immediate_repeats(frame, "k", "site", ["at"], hot_rows=20), "at") == rows(
        skip_immediate_repeats(frame, "k", "site", ["at"]), "at")


def test_first_session_of_a_null_site(spark, rows):
    frame = spark.createDataFrame([("u", 1, None), ("u", 2, None), ("u", 3, "a")], "k string, at int, site string")
    for hot_rows in (1, 100):
        found = sessions(frame, "k", "site", ["at"], hot_rows)
        assert rows(found, "at", "session_id") == [(1, 1), (2, 1), (3, 2)]


def test_action_logs_in_parts_are_whole(spark):
    frame = skewed(spark)
    logs = collect_actions(frame, ["k"], ["at"], ["at"], F.floor(F.col("at") / 50)).collect()
    assert len(logs) > 4
    for key in ("hot", "a"):
        joined = [a["at"] for r in sorted((r for r in logs if r.k == key), key=lambda r: r.part) for a in r.actions]
        assert joined == sorted(r["at"] for r in frame.filter(F.col("k") == key).collect())


def test_pages(spark, rows):
    frame = spark.range(23).withColumn("v", F.col("id") * 2)
    assert rows(page_count(frame)) == [(5,)]
    assert [r.id for r in page(frame, ["id"], 5).collect()] == [20, 21, 22]
    assert [r.id for r in page_after(frame, "id", 19).collect()] == [20, 21, 22]
    for hot_rows in (5, 1000):
        numbered = numbered_pages(frame, ["id"], hot_rows=hot_rows)
        assert {r.id: r.page for r in numbered.collect()} == {i: i // 5 + 1 for i in range(23)}
    with pytest.raises(ValueError):
        page(frame, ["id"], 0)


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_allotment_uses_each_pool_row_once(spark, hot_rows):
    requests = spark.range(200).select(F.col("id").alias("task_id"), F.when(F.col("id") < 150, "scrape").when(
        F.col("id") < 190, "store").otherwise("unknown").alias("task_type"))
    pool = spark.range(100).select(
        F.concat(F.lit("t_"), F.col("id").cast("string")).alias("topic_name"), "id",
        F.when(F.col("id") < 60, "scrape").otherwise("store").alias("task_type"), (F.col("id") % 10 == 0).alias("assigned"))
    got = allot(requests, pool, ["task_id"], ["id"], hot_rows).collect()
    assert len(got) == 200
    taken = [r.topic_name for r in got if r.topic_name]
    assert len(taken) == len(set(taken)) == 54 + 36
    assert all(r.topic_name is None for r in got if r.task_type == "unknown")
    first = sorted((r for r in got if r.task_type == "scrape"), key=lambda r: r.task_id)
    assert [r.topic_name for r in first[:3]] == ["t_1", "t_2", "t_3"] and first[54].topic_name is None


def loop(events, opening=0):
    """The plain sequential ledger."""
    balance, result = opening, []
    for at, amount in sorted(events):
        accepted = amount >= 0 or balance + amount >= 0
        balance += amount if accepted else 0
        result.append((at, amount, accepted, balance))
    return result


def test_ledger_golden(spark, rows):
    frame = spark.createDataFrame([("u", 1, 10), ("u", 2, -4), ("u", 3, -8), ("u", 4, -6)], "k string, at int, amount int")
    got = rows(guarded_ledger(frame, "k", ["at"], "amount"), "at", "accepted", "balance")
    assert got == [(1, True, 10), (2, True, 6), (3, False, 6), (4, True, 0)]
    opening = spark.createDataFrame([("u", 5)], "k string, balance bigint")
    got = rows(guarded_ledger(frame, "k", ["at"], "amount", opening), "at", "accepted", "balance")
    assert got == [(1, True, 15), (2, True, 11), (3, True, 3), (4, False, 3)]


@pytest.mark.parametrize("chunk_rows,hot_rows", [(7, 20), (7, 10_000), (1, 20), (300, 10_000)])
def test_chunked_ledger_equals_the_loop(spark, chunk_rows, hot_rows):
    frame = skewed(spark, 300, seed=chunk_rows)
    got = guarded_ledger(frame, "k", ["at"], "amount", chunk_rows=chunk_rows, hot_rows=hot_rows).collect()
    for key in ("hot", "a", "b", "c"):
        events = [(r["at"], r.amount) for r in frame.filter(F.col("k") == key).collect()]
        assert sorted((r["at"], r.amount, r.accepted, r.balance) for r in got if r.k == key) == loop(events)


def test_ledger_replays_long_rejecting_runs(spark, monkeypatch):
    """Several rounds: each may replay two chunks only."""
    from webloom.operators import ledger

    monkeypatch.setattr(ledger, "RUN_CHUNKS", 2)
    data = [("u", i, -5 if i % 3 else 4) for i in range(120)] + [("v", i, 1) for i in range(60)]
    frame = spark.createDataFrame(data, "k string, at int, amount int")
    got = guarded_ledger(frame, "k", ["at"], "amount", chunk_rows=8).collect()
    for key in ("u", "v"):
        assert sorted((r["at"], r.amount, r.accepted, r.balance) for r in got if r.k == key) == loop(
            [(at, amount) for k, at, amount in data if k == key])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=40))
def test_ledger_never_goes_negative(amounts):
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    frame = session.createDataFrame([("u", i, a) for i, a in enumerate(amounts)], "k string, at int, amount int")
    got = guarded_ledger(frame, "k", ["at"], "amount", chunk_rows=6).collect()
    assert sorted((r["at"], r.amount, r.accepted, r.balance) for r in got) == loop(list(enumerate(amounts)))
    assert min(r.balance for r in got) >= 0


def test_small_inputs_are_not_read_to_choose_the_plan(spark, tmp_path):
    skewed(spark).write.parquet(str(tmp_path / "rows"))
    frame = spark.read.parquet(str(tmp_path / "rows"))
    context = spark.sparkContext
    context.setJobGroup("choose", "building the plan")
    try:
        found = sessions(frame, "k", "site", ["at"])
        assert not list(context.statusTracker().getJobIdsForGroup("choose"))
        assert found.count() == frame.count()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)

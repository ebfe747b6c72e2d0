"""Streams over several micro-batches: keyed state, ids that are remembered, merged tables, late rows."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from test_streams import EVENTS, at, files_of, write_files
from webloom.operators.ledger import guarded_ledger
from webloom.plans import streams
from webloom.streaming import generations
from webloom.streaming.generations import IdStore, once_sink, upsert_table
from webloom.streaming.keyed_ledger import Ledger, keyed_ledger
from webloom.streaming.run import start_batches, table_sink
from webloom.streaming.steps import in_steps, time_part
from webloom.streaming.windowed import windowed_aggregate

MOVES = "email string, id string, timestamp timestamp, amount long"


# -- merged tables ---------------------------------------------------------------

def test_merged_table_reads_one_generation(spark, rows, tmp_path):
    table = upsert_table(spark, str(tmp_path / "t"), ["k"], compact_every=3)
    assert table.read() is None
    now = {}
    for batch in range(11):
        data = [(f"k{(batch * i) % 7}", batch * 10 + i) for i in range(1, 5)]
        frame = spark.createDataFrame(data, "k string, v int")
        for _ in range(2):      # a replayed batch changes nothing
            table.append(frame, batch)
        latest = {}
        for k, v in data:
            latest[k] = max(v, latest.get(k, v))
        now |= latest
        assert rows(table.read()) == sorted(now.items())
    generation, through = table.current()
    assert generation == 3 and through == 8 and table.deltas() == [9, 10]
    opened = {f.split("/t/")[1].rsplit("/", 1)[0] for f in table.read().inputFiles()}
    assert opened == {"base/generation=3", "delta/batch_id=9", "delta/batch_id=10"}
    assert table.folder.names("base") == ["generation=2", "generation=3"]


def test_a_merge_that_breaks_off_is_done_again(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table = upsert_table(spark, path, ["k"], compact_every=2)
    batches = [spark.createDataFrame([("a", i), (f"b{i}", i)], "k string, v int") for i in range(4)]
    for i in range(2):
        table.append(batches[i], i)
    monkeypatch.setattr(generations.Folder, "create_empty", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.append(batches[2], 2)
    assert table.current() == (0, -1) and rows(table.read()) == [("a", 1), ("b0", 0), ("b1", 1)]
    monkeypatch.undo()
    again = upsert_table(spark, path, ["k"], compact_every=2)     # a new start finds the leftover and replaces it
    for i in (2, 3):
        again.append(batches[i], i)
    assert again.current() == (1, 1)
    assert rows(again.read()) == [("a", 3), ("b0", 0), ("b1", 1), ("b2", 2), ("b3", 3)]


def test_window_updates_into_a_merged_table(spark, rows, tmp_path):
    times = [[3, 8], [14], [15, 16], [22], [9, 30], [31]]
    write_files(spark, tmp_path, EVENTS, [[("t", {"k": str(m)}, at(m)) for m in f] for f in times])
    spec = {"e": "count", "k": "avg"}
    table = upsert_table(spark, str(tmp_path / "windows"), ["window"], compact_every=2)
    for _ in range(2):      # stopped and started again
        result = windowed_aggregate(files_of(spark, tmp_path, EVENTS), spec, delay="1 hour")
        start_batches(result, table.append, str(tmp_path / "checkpoint"), "update", once=True).awaitTermination()
    batch = windowed_aggregate(spark.read.schema(EVENTS).json(str(tmp_path / "in")), spec)
    assert rows(table.read()) == rows(batch) and table.current()[0] >= 2


# -- ids -------------------------------------------------------------------------

def test_ids_count_once_over_years(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    store = IdStore(spark, str(tmp_path / "ids"), ["id"], buckets=8, blocks=2, compact_every=2)
    sink = once_sink(store, ["ts"], table_sink(path))
    schema = "id string, ts timestamp, amount int"
    years = [[(f"s{(y * 37 + i) % 90}", dt.datetime(2000 + y, 1, 1, i % 24), y) for i in range(60)] + [(None, dt.datetime(2000 + y, 1, 1), y)] for y in range(7)]
    first = {}
    for y, data in enumerate(years):
        for id_, ts, amount in data:
            if id_ not in first or (first[id_][1] == amount and ts < first[id_][0]):
                first[id_] = (ts, amount)
        for _ in range(1 + (y in (2, 6))):      # replayed batches
            sink(spark.createDataFrame(data, schema), y)
    got = {r.id: (r.ts, r.amount) for r in spark.read.parquet(path).collect()}
    assert got == first and spark.read.parquet(path).count() == len(first)
    assert store.seen.current()[0] >= 2


def test_new_ids_open_no_bucket_and_known_ones_only_theirs(spark, tmp_path):
    store = IdStore(spark, str(tmp_path / "ids"), ["id"], buckets=16, blocks=8)
    store.remember(store.unseen(spark.range(2000), 0).drop("bucket"), 0)
    opened = lambda df: df._jdf.queryExecution().executedPlan().toString()
    fresh = store.unseen(spark.range(10_000, 10_500), 1)
    assert fresh.count() == 500
    bits = store.blooms.read().agg(F.count("*"), F.max(F.length("bits"))).first()
    assert bits[0] <= 16 * 8 and bits[1] == 4096      # what a batch reads of filters does not grow with the ids
    assert store.unseen(spark.range(20_000, 60_000), 1).count() == 40_000
    none = store.unseen(spark.range(70_000, 70_001), 1)
    assert none.count() == 1 and "/ids/delta" not in opened(none)
    one = store.unseen(spark.range(5, 6), 1)
    bucket = spark.range(5, 6).select(F.pmod(F.xxhash64("id"), F.lit(16))).first()[0]
    assert one.count() == 0
    pruned = opened(one).split("PartitionFilters: [")[1:]
    assert any(f"= {bucket})" in p.split("]")[0] for p in pruned)


def test_full_filters_stay_exact(spark, rows, tmp_path):
    store = IdStore(spark, str(tmp_path / "ids"), ["a", "b"], buckets=2, blocks=1)
    pairs = spark.range(60_000).select(F.col("id").alias("a"), (F.col("id") % 5).cast("string").alias("b"))
    store.remember(store.unseen(pairs, 0).drop("bucket"), 0)
    asked = pairs.filter("a < 100").union(spark.range(100).select(F.col("id"), F.lit("x")))
    assert store.unseen(asked, 1).filter("b <> 'x'").count() == 0 and store.unseen(asked, 1).count() == 100


# -- keyed state -----------------------------------------------------------------

def test_keyed_ledger_over_batches(spark, rows, tmp_path):
    files = [[("u", "e2", at(2), -4), ("u", "e1", at(1), 10), ("v", "f1", at(2), -1), (None, "x", at(1), 5)],
             [("u", "e3", at(3), -8), ("u", "e1", at(1), 10)],
             [("u", "e4", at(4), -6), ("v", "f2", at(4), 3), ("u", "e4", at(4), -6)],
             [("w", "g1", at(500), 7)], [("u", "e4", at(4), -6), ("w", "g2", at(501), -7)]]
    write_files(spark, tmp_path, MOVES, files)
    for _ in range(2):      # the second start finds nothing new
        entries = keyed_ledger(files_of(spark, tmp_path, MOVES), "email", "id", "timestamp", ["timestamp", "id"], "amount", "1 hour")
        start_batches(entries, table_sink(str(tmp_path / "rows")), str(tmp_path / "checkpoint"), once=True).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "rows"))
    assert rows(found, "email", "id", "accepted", "balance") == [
        ("u", "e1", True, 10), ("u", "e2", True, 6), ("u", "e3", False, 6), ("u", "e4", True, 0),
        ("v", "f1", False, 0), ("v", "f2", True, 3), ("w", "g1", True, 7), ("w", "g2", True, 0)]
    plain = guarded_ledger(spark.createDataFrame(sorted({r for f in files for r in f if r[0]}), MOVES), "email", ["timestamp", "id"], "amount")
    assert rows(found, "id", "balance") == rows(plain, "id", "balance")
    state = spark.read.format("statestore").option("stateVarName", "applied").load(str(tmp_path / "checkpoint"))
    left = {(r.key["email"], r.user_map_key["id"]) for r in state.select("key", F.col("user_map_key")).collect()} if "user_map_key" in state.columns else None
    assert left is None or not {x for x in left if x[0] == "u"}


def test_keyed_ledger_buckets(spark, rows, tmp_path):
    """Users share buckets: one key's null or late events leave the others' alone, and ids go when the watermark has passed them."""
    files = [[("u", "a", at(1), 2**60 + 1), ("v", "a", at(2), None), ("v", "b", at(3), 4), ("u", "b", at(90), -1)],
             [("u", "b", at(90), -1), ("v", "c", at(95), -4), ("v", "a", at(2), 9)],
             [("w", "a", at(400), 1)]]
    write_files(spark, tmp_path, MOVES, files)
    found = {}
    for buckets in (1, 64):
        path = str(tmp_path / str(buckets))
        entries = keyed_ledger(files_of(spark, tmp_path, MOVES), "email", "id", "timestamp", ["timestamp", "id"], "amount", "1 hour", buckets)
        start_batches(entries, table_sink(f"{path}/rows"), f"{path}/checkpoint", once=True).awaitTermination()
        found[buckets] = rows(spark.read.parquet(f"{path}/rows"), "email", "id", "amount", "accepted", "balance")
        held = spark.read.format("statestore").option("stateVarName", "applied").option("flattenCollectionTypes", "true").load(f"{path}/checkpoint")
        assert {u for r in held.select(F.col("list_element.users").alias("users")).collect() for u in r.users} == {"w"}
    assert found[1] == found[64] == sorted([
        ("u", "a", 2**60 + 1, True, 2**60 + 1), ("u", "b", -1, True, 2**60), ("v", "a", None, False, 0), ("v", "b", 4, True, 4),
        ("v", "c", -4, True, 0), ("w", "a", 1, True, 1)], key=repr)


class CountedState:
    def __init__(self):
        self.calls, self.value, self.elements = 0, None, []

    def __getattr__(self, name):
        def call(x=None, *_):
            self.calls += 1
            if name == "get":
                return self.value
            if name in ("getValueState", "getListState", "getMapState"):
                return self
            if name == "update":
                self.value = x
        return call


def test_a_ledger_calls_its_state_for_a_bucket_not_for_an_event():
    class Listed(CountedState):
        def get(self):
            self.calls += 1
            return iter(self.elements)

        def appendValue(self, x):
            self.calls += 1
            self.elements.append(x)

    class Handle(CountedState):
        def getListState(self, *_):
            self.listed = Listed()
            return self.listed

    def batch(first):
        n = 4000
        return pd.DataFrame({"u": [i % 500 for i in range(n)], "id": range(first, first + n), "at": pd.to_datetime([i * 10**6 for i in range(n)], unit="us").astype("datetime64[us]"),
                             "m": [i % 7 - 3 for i in range(n)]}).assign(amount_known=True, amount_whole=lambda d: d["m"])

    handle, ledger = Handle(), Ledger("u", "id", "at", ["at", "id"], "m", T.LongType())
    ledger.init(handle)
    made = [len(out) for first in (0, 4000, 2000) for out in ledger.handleInputRows((0,), iter([batch(first)]), None)]
    assert made == [4000, 4000] and handle.calls + handle.listed.calls <= 20      # before: three and more an event


# -- steps -----------------------------------------------------------------------

def test_steps_move_the_watermark(spark, tmp_path):
    minutes = [0, 7, 61, 3, 62, 130, 1, 131]      # the fourth and the seventh come late
    data = spark.createDataFrame([("t", {"k": "1"}, at(m), i) for i, m in enumerate(minutes)], EVENTS + ", n int")
    table = upsert_table(spark, str(tmp_path / "windows"), ["window"])

    def begin(stream):
        return start_batches(windowed_aggregate(stream.drop("n"), {"e": "count"}), table.append, str(tmp_path / "checkpoint"), "update")

    in_steps(data, F.col("n"), len(minutes) + 2, str(tmp_path / "steps"), begin)
    kept = {int((r.window.start - at(0)).total_seconds() // 60): r.e_count for r in table.read().collect()}
    assert kept == {-5: 1, 0: 2, 5: 1, 55: 2, 60: 2, 125: 2, 130: 2}


def test_time_parts(spark, rows):
    frame = spark.createDataFrame([(at(m),) for m in (0, 1, 49, 50, 99)], "ts timestamp")
    parts = frame.select(time_part(F.col("ts"), F.lit(at(0)), F.lit(at(99)), 2).alias("p"))
    assert [r.p for r in parts.collect()] == [0, 0, 0, 1, 1]


# -- given tables as streams -------------------------------------------------------

def test_a_table_of_several_files_streams_whole(spark, rows, tmp_path):
    html = "<nav><ul><li><a href='/{0}'>link {0}</a></li></ul></nav>"
    pages = spark.createDataFrame([(i, f"u{i}", html.format(i)) for i in range(12)], "page_id long, url string, html string")
    pages.repartition(3).write.parquet(str(tmp_path / "many/pages.parquet"))
    pages.limit(0).write.parquet(str(tmp_path / "many/orders.parquet"))     # another table beside it
    (tmp_path / "one").mkdir()
    pages.coalesce(1).write.parquet(str(tmp_path / "part"))
    next((tmp_path / "part").glob("part-*.parquet")).rename(tmp_path / "one/pages.parquet")
    expected = sorted((f'{{"link":"link {i}","page_id":{i}}}',) for i in range(12))
    for folder in ("many", "one"):
        assert rows(streams.stream_page_records(spark, str(tmp_path / folder))) == expected

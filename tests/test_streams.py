"""Streams over small file folders: late data, replays, restarts, and agreement with the batch form."""

import datetime as dt

import pytest

from webloom.dom.extract import container_records
from webloom.dom.shred import shred
from webloom.operators.dedup import distinct_on
from webloom.sinks.messages import record_messages
from webloom.sources.tables import stream_table
from webloom.streaming.crawl import page_messages
from webloom.streaming.ledger import balances_before, current_balances, ledger_sink, once_per_event
from webloom.streaming.route import Routes, decode_tasks, split_malformed, with_route
from webloom.streaming.run import consume, latest_rows, routed_sink, start, start_batches, table_sink
from webloom.streaming.windowed import (
    aggregates, as_messages, decode_events, split_timeless, windowed_aggregate,
)

EVENTS = "task_id string, payload map<string,string>, timestamp timestamp"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def write_files(spark, folder, schema, files):
    """One file per list of rows, read back in this order."""
    import os
    import time

    (folder / "in").mkdir(exist_ok=True)
    for i, data in enumerate(files):
        path = folder / "raw" / f"{i:03d}"
        spark.createDataFrame(data, schema).coalesce(1).write.json(str(path))
        for name in os.listdir(path):
            if name.startswith("part"):
                target = folder / "in" / f"part-{i:03d}.json"
                target.write_bytes((path / name).read_bytes())
                os.utime(target, (time.time() - 1000 + i, time.time() - 1000 + i))


def files_of(spark, folder, schema, per_batch=1):
    return stream_table(spark, str(folder / "in"), schema, "json", per_batch)


def run(result, path, mode="append"):
    start_batches(result, table_sink(str(path / "rows")), str(path / "checkpoint"), mode, once=True).awaitTermination()
    return result.sparkSession.read.parquet(str(path / "rows"))


def windows_of(frame):
    return {(r.window.start.hour * 60 + r.window.start.minute + (r.window.start.day - 1) * 1440): r.e_count
            for r in frame.collect()}


def test_late_rows_drop_one_batch_after_the_watermark_moves(spark, tmp_path):
    times = [[3], [60], [61], [4], [57]]
    write_files(spark, tmp_path, EVENTS, [[("t", {"k": "1"}, at(m)) for m in f] for f in times])
    result = windowed_aggregate(files_of(spark, tmp_path, EVENTS), {"e": "count"})
    kept = windows_of(latest_rows(run(result, tmp_path, "update"), ["window"]))
    assert kept[0] == 1 and kept[50] == 1 and kept[55] == 3 and kept[60] == 2


def test_a_late_row_right_after_the_advance_is_still_counted(spark, tmp_path):
    write_files(spark, tmp_path, EVENTS, [[("t", {"k": "1"}, at(m))] for m in (3, 60, 4)])
    result = windowed_aggregate(files_of(spark, tmp_path, EVENTS), {"e": "count"})
    assert windows_of(latest_rows(run(result, tmp_path, "update"), ["window"]))[0] == 2


def test_stream_equals_batch_on_time_ordered_data(spark, rows, tmp_path):
    data = [[(f"t{i}", {"k": str(i), "x": "no number"}, at(i * 2))] for i in range(8)]
    write_files(spark, tmp_path, EVENTS, data)
    spec = {"e": "count", "k": "avg", "x": "avg"}
    stream = latest_rows(run(windowed_aggregate(files_of(spark, tmp_path, EVENTS), spec), tmp_path, "update"), ["window"])
    batch = windowed_aggregate(spark.createDataFrame([r for f in data for r in f], EVENTS), spec)
    assert rows(stream, *batch.columns) == rows(batch)


def test_aggregate_list_is_checked():
    for spec in ({}, {"x": "median"}):
        with pytest.raises(ValueError):
            aggregates(spec)


def test_decode_and_dead_letters(spark, rows):
    messages = spark.createDataFrame([
        ('{"task_id":"a","payload":{"k":"1"},"timestamp":"2024-01-01T00:00:00Z"}',), ("not json",),
        ('{"task_id":"b","payload":{"k":"2"}}',)], "value string")
    timed, dead = split_timeless(decode_events(messages))
    assert rows(timed, "task_id") == [("a",)] and len(rows(dead, "task_id")) == 2
    good, bad = split_malformed(spark.createDataFrame([("{}",), ("[1]",), ("1",), (None,), ("{",)], "value string"))
    assert rows(good) == [("{}",)] and bad.count() == 4
    keyed = as_messages(windowed_aggregate(timed, {"e": "count"}))
    assert rows(keyed)[1] == (
        "{2024-01-01 00:00:00, 2024-01-01 00:10:00}",
        '{"window":{"start":"2024-01-01T00:00:00.000Z","end":"2024-01-01T00:10:00.000Z"},"e_count":1}')


def test_routes(spark, rows, tmp_path):
    messages = spark.createDataFrame([
        ('{"task_type":"transform","payload":{"a":1}}',), ('{"task_type":"task","payload":{"task_type":"store"}}',),
        ('{"task_type":"task","payload":{"x":1}}',), ('{"task_type":"other","payload":"p"}',), ("bad",)], "value string")
    assert rows(with_route(decode_tasks(messages), ["transform", "store"]), "route") == [
        ("store",), ("transform",), ("unrouted",), ("unrouted",), ("unrouted",)]
    write = routed_sink(Routes({"transform": lambda df: df, "store": lambda df: df}), str(tmp_path))
    for _ in range(2):      # the replay of a batch replaces it
        write(decode_tasks(messages), 0)
    assert [spark.read.parquet(str(tmp_path / r)).count() for r in ("transform", "store", "unrouted")] == [1, 1, 3]


def test_restart_from_the_checkpoint(spark, rows, tmp_path):
    schema = "task_type string, payload string"
    write_files(spark, tmp_path, schema, [[("a", "1")], [("b", "2")]])
    assert run(files_of(spark, tmp_path, schema), tmp_path).count() == 2
    (tmp_path / "in" / "part-9.json").write_text('{"task_type":"c","payload":"3"}\n')
    again = run(files_of(spark, tmp_path, schema), tmp_path)
    assert rows(again, "task_type", "batch_id") == [("a", 0), ("b", 1), ("c", 2)]


def test_checkpoint_is_required_and_slide_is_checked(spark, tmp_path):
    schema = "task_type string, payload string"
    write_files(spark, tmp_path, schema, [[("a", "1")]])
    stream = files_of(spark, tmp_path, schema)
    for begin in (lambda: start(stream, "console", ""), lambda: start_batches(stream, lambda df, i: None, "")):
        with pytest.raises(ValueError):
            begin()
    with pytest.raises(Exception, match="(?i)slide"):
        windowed_aggregate(spark.createDataFrame([("t", {}, at(1))], EVENTS), {"e": "count"}, "5 minutes",
                           "10 minutes").collect()


def test_console_and_memory_sinks(spark, tmp_path):
    schema = "task_type string, payload string"
    write_files(spark, tmp_path, schema, [[("a", "1")], [("b", "2")]])
    start(files_of(spark, tmp_path, schema), "console", str(tmp_path / "c1"), once=True).awaitTermination()
    start(files_of(spark, tmp_path, schema), "memory", str(tmp_path / "c2"), once=True, name="wl_out").awaitTermination()
    assert spark.table("wl_out").count() == 2


def test_stream_dedup(spark, rows, tmp_path):
    schema = "session string, timestamp timestamp"
    write_files(spark, tmp_path, schema, [[("s1", at(0)), ("s1", at(1))], [("s1", at(2)), ("s2", at(3))]])
    unique = distinct_on(files_of(spark, tmp_path, schema), ["session"], "timestamp", "1 hour")
    assert rows(run(unique, tmp_path), "session") == [("s1",), ("s2",)]
    with pytest.raises(ValueError):
        distinct_on(files_of(spark, tmp_path, schema), ["session"])


LEDGER = "email string, id string, timestamp timestamp, amount int"


def test_stream_ledger(spark, rows, tmp_path):
    files = [[("u", "e1", at(1), 10), ("u", "e2", at(2), -4), ("v", "f1", at(2), -1)],
             [("u", "e3", at(3), -8), ("u", "e1", at(1), 10)],
             [("u", "e4", at(4), -6), ("v", "f2", at(4), 3)]]
    write_files(spark, tmp_path, LEDGER, files)
    events = once_per_event(files_of(spark, tmp_path, LEDGER), "id", "timestamp", "1 hour")
    path = str(tmp_path / "ledger")
    sink = ledger_sink(path, "email", ["timestamp", "id"], "amount", chunk_rows=2)
    start_batches(events, sink, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert rows(current_balances(spark, path, "email")) == [("u", 0), ("v", 3)]
    entries = spark.read.parquet(f"{path}/entries")
    assert rows(entries, "id", "accepted") == [
        ("e1", True), ("e2", True), ("e3", False), ("e4", True), ("f1", False), ("f2", True)]


def test_stream_ledger_replay_and_snapshots(spark, rows, tmp_path, monkeypatch):
    from webloom.streaming import ledger

    monkeypatch.setattr(ledger, "SNAPSHOT_EVERY", 3)
    path = str(tmp_path / "ledger")
    sink = ledger_sink(path, "email", ["timestamp", "id"], "amount")
    for batch in range(8):
        key = "u" if batch % 2 else "v"
        frame = spark.createDataFrame([(key, f"e{batch}", at(batch), batch)], LEDGER)
        sink(frame, batch)
        sink(frame, batch)      # a replayed batch changes nothing
    assert rows(current_balances(spark, path, "email"), "email", "balance") == [("u", 16), ("v", 12)]
    assert rows(balances_before(spark, path, "email", 7)) == [("u", 9), ("v", 12)]
    assert rows(balances_before(spark, path, "email", 2)) == [("u", 1), ("v", 0)]


def test_page_stream_sends_every_page(spark, rows, tmp_path):
    schema = "page_id int, html string"
    card = '<div class="card"><h2>t{0}</h2><p>p{0}</p></div>'
    write_files(spark, tmp_path, schema, [[(i, card.format(i) * 2)] for i in range(4)])
    fields = {"title": "h2", "price": "p"}
    sent = run(page_messages(files_of(spark, tmp_path, schema), ".card", fields, "page_id"), tmp_path)
    pages = spark.createDataFrame([(i, card.format(i) * 2) for i in range(4)], schema)
    batch = record_messages(container_records(shred(pages), ".card", fields, "page_id").drop("container_pre"))
    assert rows(sent, "value") == rows(batch, "value") and sent.count() == 8


def test_window_job_over_files(spark, rows, tmp_path):
    import json

    from webloom.jobs.windowed_aggregation import arguments, window_messages

    args = arguments(["--input_topic", "i", "--output_topic", "o", "--checkpoint", "c", "--kafka_brokers", "b", "--dead_letters", "d", "--aggregation_fields",
                      '{"task": "count", "k": "avg"}', "--slide_interval", "10 minutes"])
    texts = [json.dumps({"task_id": "t", "payload": {"k": str(k)}, "timestamp": f"2024-01-01T00:0{k}:00Z"})
             for k in (1, 2)] + ["broken"]
    write_files(spark, tmp_path, "value string", [[(t,)] for t in texts])
    sent = run(window_messages(files_of(spark, tmp_path, "value string"), args), tmp_path, "update")
    assert rows(latest_rows(sent, ["key"]))[0][0] == "{2024-01-01 00:00:00, 2024-01-01 00:10:00}"
    assert json.loads(rows(latest_rows(sent, ["key"]))[0][1]) == {
        "window": {"start": "2024-01-01T00:00:00.000Z", "end": "2024-01-01T00:10:00.000Z"}, "task_count": 2, "k_avg": 1.5}


def test_dead_letters_of_the_window_job(spark, rows):
    from webloom.streaming.windowed import dead_letters

    texts = ['{"task_id":"t","payload":{"k":"1"},"timestamp":"2024-01-01T00:00:00Z"}', "broken", '{"task_id":"t"}', None]
    found = dead_letters(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert rows(found) == sorted([("broken", "unreadable"), ('{"task_id":"t"}', "no timestamp"), (None, "unreadable")], key=repr)


def test_workflow_job_routes(spark, rows):
    from webloom.jobs.workflow_tasks import default_routes

    raw = '{"payload":{"a":1},"task_type":"transform"}'
    handled = default_routes().apply(decode_tasks(spark.createDataFrame([(raw,)], "value string")))
    assert rows(handled["transform"], "document") == [(
        '{"transformed":"{\\"payload\\":{\\"a\\":1},\\"task_type\\":\\"transform\\"}"}',)]
    assert handled["store"].count() == handled["unrouted"].count() == 0


def test_one_consumer_per_task_type(spark, rows, tmp_path):
    schema = "task_type string, payload string"
    inner = '{"task_type":"store","k":4}'     # what the producer queues: the type is inside
    write_files(spark, tmp_path, schema, [[("transform", "1"), ("store", "2")], [("store", "3"), ("task", inner), ("task", "{}")]])
    for task_type in ("transform", "store"):
        for _ in range(2):      # a second start resumes and finds nothing new
            consume(files_of(spark, tmp_path, schema), task_type, lambda df: df.drop("task_type"),
                    str(tmp_path / task_type), str(tmp_path / "checkpoints"), once=True).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "store")), "payload") == [("2",), ("3",), (inner,)]
    assert rows(spark.read.parquet(str(tmp_path / "transform")), "payload") == [("1",)]

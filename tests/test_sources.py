"""Data sources: a message log with offsets and groups, document collections with filters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from webloom.sources import collections, folder_log
from webloom.sources.collections import read_collection, write_collection
from webloom.sources.folder_log import append_messages, committed_offsets, log_stream
from webloom.streaming.run import start_batches, table_sink


def messages(spark, first, n, topic="t"):
    return spark.createDataFrame([(topic, f"k{i % 5}", f"m{i}\u2028é") for i in range(first, first + n)], "topic string, key string, value string")


def all_values(n):
    return sorted(f"m{i}\u2028é" for i in range(n))


def drain(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_log_offsets(spark, tmp_path):
    path = str(tmp_path / "log")
    append_messages(messages(spark, 0, 40), path, token="a")
    append_messages(messages(spark, 0, 40), path, token="a")      # a repeated call adds nothing
    append_messages(messages(spark, 40, 30), path)
    append_messages(messages(spark, 0, 5, "other"), path)
    folder_log.register(spark)
    found = spark.read.format("folder_log").option("path", path).option("topics", "t").load().collect()
    assert sorted(r.value for r in found) == all_values(70)
    for p in range(3):
        assert sorted(r.offset for r in found if r.partition == p) == list(range(sum(r.partition == p for r in found)))
    assert len({(r.key, r.partition) for r in found}) == 5
    with pytest.raises(Exception, match="starting"):
        log_stream(spark, path, "t", "nowhere").writeStream.format("noop").start().processAllAvailable()


def test_commit_after_processing_and_resume_after_a_crash(spark, tmp_path):
    """Earliest offset first; what a crashed batch had is read again; the group's position never runs ahead of the table."""
    path, rows = str(tmp_path / "log"), str(tmp_path / "rows")
    append_messages(messages(spark, 0, 40), path)
    write, crash = table_sink(rows), []

    def sink(batch, batch_id):
        if crash:
            raise RuntimeError("sink is down")
        write(batch, batch_id)

    def begin():
        return start_batches(log_stream(spark, path, "t", "earliest", "g"), sink, str(tmp_path / "checkpoint"))

    drain(begin())
    assert sorted(r.value for r in spark.read.parquet(rows).collect()) == all_values(40)
    append_messages(messages(spark, 40, 30), path)
    crash.append(True)
    before = committed_offsets(path, "g")
    with pytest.raises(Exception, match="sink is down"):
        drain(begin())
    done = spark.read.parquet(rows).groupBy("partition").agg((F.max("offset") + 1).alias("end")).collect()
    ends = {f"t/partition={r.partition}": r.end for r in done}
    assert sum(ends.values()) == 40 and all(n <= ends[p] for p, n in committed_offsets(path, "g").items()) and before.items() <= ends.items()
    crash.clear()
    query = begin()
    query.processAllAvailable()
    append_messages(messages(spark, 70, 10), path)
    drain(query)
    stored = spark.read.parquet(rows)
    assert sorted(r.value for r in stored.collect()) == all_values(80) and stored.select("partition", "offset").distinct().count() == 80
    assert 70 <= sum(committed_offsets(path, "g").values()) <= 80


def test_a_group_goes_on_from_its_commit(spark, tmp_path):
    path = str(tmp_path / "log")
    append_messages(messages(spark, 0, 20), path)
    folder_log.StreamReader({"path": path, "topics": "t", "group": "g"}).commit(folder_log.Log({"path": path}).ends())
    append_messages(messages(spark, 20, 15), path)
    for starting, expected in (("committed", all_values(35)[-0:] and sorted(set(all_values(35)) - set(all_values(20)))), ("earliest", all_values(35)), ("latest", [])):
        out = str(tmp_path / starting)
        query = start_batches(log_stream(spark, path, "t", starting, "g"), table_sink(out), str(tmp_path / f"c-{starting}"))
        drain(query)
        got = sorted(r.value for r in spark.read.parquet(out).collect()) if (tmp_path / starting).exists() else []
        assert got == expected, starting


# -- collections -----------------------------------------------------------------

def people(spark):
    at = dt.datetime(2024, 5, 1, 12, 30, 15, 123456)
    data = [(i, i % 3, i / 4, i % 2 == 0, f"näme {i}" if i % 5 else None, at + dt.timedelta(hours=i), "x" * 50) for i in range(500)]
    return spark.createDataFrame(data, "id long, n int, d double, even boolean, name string, at timestamp, secret string")


@pytest.mark.parametrize("range_bytes", [1, 97, 5000, 1 << 25])
def test_collection_ranges(spark, rows, tmp_path, range_bytes):
    frame, path = people(spark).limit(60 if range_bytes < 100 else 500), str(tmp_path / "people")
    write_collection(frame, path, hidden=("secret",))
    found = read_collection(spark, path, range_bytes)
    assert found.schema.names == ["id", "n", "d", "even", "name", "at"]
    assert rows(found) == rows(frame.drop("secret"))


def test_collection_filters_reach_the_reader(spark, rows, tmp_path):
    path = str(tmp_path / "people")
    frame = people(spark)
    write_collection(frame, path)
    for condition in ("id >= 490", "n = 1 and even", "name is null and id < 30", "id in (3, 400, 7777)", "d > 120.5 and name like '%9'",
                      "at < '2024-05-02 00:00:00'", "name = 'näme 7' or id = 2", "n <> 1"):
        found = read_collection(spark, path).filter(condition)
        assert rows(found) == rows(frame.filter(condition)), condition
    plan = read_collection(spark, path).filter("id >= 490 and n = 1")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "490" not in plan, plan      # nothing is left for Spark to filter
    reader = collections.CollectionReader(path, collections.pa.schema([("id", collections.pa.int64())]), 1 << 25)
    kept = list(reader.pushFilters([collections.GreaterThan(("id",), 5), collections.GreaterThan(("other",), 5)]))
    assert len(kept) == 1 and len(reader.filters) == 1


def test_collection_without_a_schema_raises(spark, tmp_path):
    with pytest.raises(Exception, match="_schema.json"):
        read_collection(spark, str(tmp_path)).collect()

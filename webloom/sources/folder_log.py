"""A message log in folders as a Spark stream: offsets, partitions, commits (SRC-3, SRC-4).

It has what consumers of a message broker count on, without one: a topic has numbered partitions, a message an offset
in its partition, a reader starts at the earliest offset, the latest, or where its group has committed, and a group's
position is committed after its messages have been processed. ``<topic>/partition=<p>`` holds segments of JSON lines that
never change; a segment's name tells its first offset and its number of messages, so offsets are found by listing names.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from webloom.sources.folders import Files

FORMAT = "folder_log"
SCHEMA = "topic string, partition int, offset long, key string, value string"
ARROW = pa.schema([("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("key", pa.string()), ("value", pa.string())])
ROWS = 10_000


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("folder_log")`` and ``readStream`` known; once per session."""
    spark.dataSource.register(FolderLog)


@dataclass
class Segment(InputPartition):
    """Messages from ``start`` to before ``end`` of one segment."""

    place: str
    first: int
    start: int
    end: int


class FolderLog(DataSource):
    """Options: ``path``; ``topics``, comma-separated, all if absent; ``starting`` (earliest, latest or committed); ``group``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(self.options)


class Log:
    def __init__(self, options):
        self.path = options["path"]
        self.group = options.get("group")
        self.starting = options.get("starting", "earliest")
        if self.starting not in ("earliest", "latest", "committed"):
            raise ValueError(f"unknown starting position {self.starting!r}")
        if self.starting == "committed" and not self.group:
            raise ValueError("a committed position needs a group")
        self.topics = [t for t in options.get("topics", "").split(",") if t]

    def places(self) -> list[str]:
        """``topic/partition=p`` of all partitions."""
        files = Files(self.path)
        return [f"{t}/{p}" for t in self.topics or files.folders() for p in files.folders(t) if p.startswith("partition=")]

    def segments(self, place: str) -> list[tuple[int, int, str]]:
        """(first offset, messages, name) in order."""
        return sorted((int(n.split("-")[0]), int(n.split("-")[1]), n) for n in Files(self.path).sizes(place) if n.endswith(".jsonl"))

    def ends(self) -> dict[str, int]:
        return {place: max((first + count for first, count, _ in self.segments(place)), default=0) for place in self.places()}

    def committed(self) -> dict[str, int]:
        content = Files(self.path).read(f"_groups/{self.group}.json")
        return json.loads(content) if content else {}

    def between(self, start: dict, end: dict) -> list[Segment]:
        parts = []
        for place, high in end.items():
            low = start.get(place, 0)
            parts += [Segment(f"{place}/{name}", first, max(low, first), min(high, first + count))
                      for first, count, name in self.segments(place) if first < high and first + count > low]
        return parts

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        topic, number, _ = partition.place.split("/")
        rows = []
        with Files(self.path).open(partition.place) as file:
            for offset, line in enumerate(io.TextIOWrapper(file, "utf-8", newline="\n"), partition.first):
                if offset >= partition.end:
                    break
                if offset >= partition.start:
                    message = json.loads(line)
                    rows.append((topic, int(number.split("=")[1]), offset, message.get("key"), message.get("value")))
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)


class BatchReader(DataSourceReader):
    """All messages that are there when it is planned."""

    def __init__(self, options):
        self.log = Log(options)

    def partitions(self) -> list[Segment]:
        return self.log.between({}, self.log.ends())

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return self.log.read(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.log = Log(options)

    def initialOffset(self) -> dict:
        if self.log.starting == "latest":
            return self.log.ends()
        return self.log.committed() if self.log.starting == "committed" else {}

    def latestOffset(self) -> dict:
        return self.log.ends()

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return self.log.between(start, end)

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return self.log.read(partition)

    def commit(self, end: dict) -> None:
        """Spark calls this when the messages before ``end`` have been processed and the sink has them."""
        if self.log.group:
            Files(self.log.path).write(f"_groups/{self.log.group}.json", json.dumps(end).encode())


def committed_offsets(path: str, group: str) -> dict[str, int]:
    """The position of a group, by ``topic/partition=p``; empty before its first commit."""
    return Log({"path": path, "group": group}).committed()


def append_messages(messages: DataFrame, path: str, partitions: int = 3, token: str | None = None) -> None:
    """Append ``(topic, key, value)``: a message goes to the partition of its key's hash, in the order given within a task.

    Each partition gets one new segment, written whole by one task; with the same ``token`` it is written once,
    however often the task or the call is repeated. A batch of messages for one partition fits a task.
    """
    token = token or uuid.uuid4().hex

    def write(rows: pa.Table) -> pa.Table:
        topic, number = rows.column("topic")[0].as_py(), rows.column("partition")[0].as_py()
        place, log = f"{topic}/partition={number}", Log({"path": path})
        there = log.segments(place)
        if not any(name.endswith(f"-{token}.jsonl") for _, _, name in there):
            first = max((f + n for f, n, _ in there), default=0)
            lines = "".join(json.dumps({"key": k, "value": v}, ensure_ascii=False) + "\n"
                            for k, v in zip(rows.column("key").to_pylist(), rows.column("value").to_pylist()))
            Files(path).write(f"{place}/{first:020d}-{rows.num_rows}-{token}.jsonl", lines.encode())
        return pa.table({"topic": [topic], "messages": pa.array([rows.num_rows], pa.int64())})

    dealt = messages.select("topic", F.pmod(F.hash("key"), F.lit(partitions)).alias("partition"), F.col("key").cast("string").alias("key"), "value")
    dealt.groupBy("topic", "partition").applyInArrow(write, "topic string, messages long").write.format("noop").mode("overwrite").save()


def log_stream(spark: SparkSession, path: str, topics: str = "", starting: str = "earliest", group: str | None = None) -> DataFrame:
    """SRC-4: topics as a stream of messages."""
    register(spark)
    reader = spark.readStream.format(FORMAT).option("path", path).option("topics", topics).option("starting", starting)
    return (reader.option("group", group) if group else reader).load()

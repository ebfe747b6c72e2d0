"""Document collections with a declared schema as a Spark data source (SRC-5, SRC-8).

A collection is a folder of JSON-lines files. ``_schema.json`` declares its fields as a schema table does: name, type,
hidden. A scan reads byte ranges in parallel, gives the declared columns that are not hidden, and takes over
comparisons of columns with values, so that documents that do not match never leave the reader.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import json as arrow_json
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
)

from webloom.sources.folders import Files
from webloom.sources.tables import DECLARED_TYPES

FORMAT = "document_collection"
SCHEMA_FILE = "_schema.json"
RANGE = 32 << 20
COMPARED = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
ARROW = {"bigint": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "varchar": pa.string(), "timestamp": pa.timestamp("us", "UTC")}


@dataclass
class Range(InputPartition):
    """The lines of a file that begin in [start, end)."""

    name: str
    start: int
    end: int


class DocumentCollection(DataSource):
    """Options: ``path``; ``rangeBytes``, the bytes a task reads, 32 MB if absent."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def declared(self) -> list[dict]:
        content = Files(self.options["path"]).read(SCHEMA_FILE)
        if content is None:
            raise ValueError(f"no {SCHEMA_FILE} in {self.options['path']}")
        fields = json.loads(content)["fields"]
        unknown = {f["type"] for f in fields} - set(ARROW)
        if unknown:
            raise ValueError(f"unknown declared types: {sorted(unknown)}")
        return [f for f in fields if not f.get("hidden")]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f["name"], DECLARED_TYPES[f["type"]]) for f in self.declared()])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        kinds = {f["name"]: ARROW[f["type"]] for f in self.declared()}
        return CollectionReader(self.options["path"], pa.schema([(c, kinds[c]) for c in schema.names]), int(self.options.get("rangeBytes", RANGE)))


class CollectionReader(DataSourceReader):
    def __init__(self, path: str, schema: pa.Schema, range_bytes: int):
        self.path, self.columns, self.range_bytes = path, schema, range_bytes
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps the comparisons of own columns; gives back the rest, which Spark evaluates."""
        for f in filters:
            if type(f) in (*COMPARED, In, IsNull, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in self.columns.names:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Range]:
        return [Range(name, at, min(at + self.range_bytes, size)) for name, size in sorted(Files(self.path).sizes().items())
                for at in range(0, size, self.range_bytes)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with Files(self.path).open(partition.name) as file:
            data = lines_in(file, partition.start, partition.end)
        if not data.strip():
            return
        options = arrow_json.ParseOptions(explicit_schema=self.columns, unexpected_field_behavior="ignore")
        found = arrow_json.read_json(io.BytesIO(data), arrow_json.ReadOptions(block_size=max(1 << 20, len(data) + 1)), options)
        for f in self.filters:
            found = found.filter(matches(f, found.column(f.attribute[0])))
        yield from found.select(self.columns.names).cast(self.columns).to_batches()


def matches(f: Filter, column: pa.ChunkedArray):
    """Which values satisfy a filter; comparisons with null hold for none."""
    if isinstance(f, IsNull):
        return pc.is_null(column)
    if isinstance(f, IsNotNull):
        return pc.is_valid(column)
    if isinstance(f, In):
        values = pa.array([v for v in f.value if v is not None], column.type)
        return pc.is_in(column, value_set=values)
    return pc.fill_null(COMPARED[type(f)](column, pa.scalar(f.value, column.type)), False)


def lines_in(file, start: int, end: int) -> bytes:
    """The whole lines that begin in [start, end): a line that begins before ``start`` belongs to the range before."""
    at = start
    if start:
        file.seek(start - 1)
        rest = file.read(1)
        while rest and rest != b"\n":
            block = file.read(1 << 16)
            cut = block.find(b"\n")
            at += len(block) if cut < 0 else cut + 1
            rest = block if cut < 0 else b"\n"
    if at >= end:
        return b""
    file.seek(at)
    data = file.read(end - at)
    while data and not data.endswith(b"\n"):
        block = file.read(1 << 16)
        if not block:
            break
        cut = block.find(b"\n")
        data += block if cut < 0 else block[:cut + 1]
    return data


def write_collection(rows: DataFrame, path: str, hidden: tuple[str, ...] = ()) -> None:
    """A table as a collection, its schema declared; ``hidden`` fields are stored and not scanned."""
    names = {type(kind): name for name, kind in DECLARED_TYPES.items()}
    fields = [{"name": f.name, "type": names[type(f.dataType)], "hidden": f.name in hidden} for f in rows.schema]
    rows.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    Files(path).write(SCHEMA_FILE, json.dumps({"fields": fields}).encode())


def read_collection(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """SRC-5: a collection in its declared schema."""
    spark.dataSource.register(DocumentCollection)
    return spark.read.format(FORMAT).option("path", path).option("rangeBytes", range_bytes).load()

"""Web archives: a writer that stores equal payloads once, and a splittable reader.

Every record is one gzip member, so a reader may begin anywhere. A reading task gets a byte range of
a file, looks for the gzip magic, accepts a candidate only when it decodes to a record header, and owns
the records that *start* inside its range; it reads past the end of the range to finish the last one.

Files are opened with ``pyarrow.fs`` by their full address, so the folder may be any store that it
knows (``file``, ``hdfs``, ``s3``, ``gs``, ``abfs``). A writing task names its files freshly and
reports them in the manifest; files of lost attempts are in no manifest and so are never read.

Nulls: a null payload is empty, a null address is an empty one, a null key is written as a record
without a key and read as null. Payloads of fewer than ``least`` bytes are always responses. Rows with
the same key and payload are each written; they count as one for the choice of the response. An empty
table gives no files and no records. Other columns of the input are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.registry import query, table
from webloom.runtime import cut, working_path

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
LEAST = 100
RANGE = 8 << 20
FILE = 128 << 20
TASKS = 20_000
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "warc_type string, page_id long, url string, refers_to long, digest string, payload_length long, payload binary"


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", least: int = LEAST) -> DataFrame:
    """Payload, digest, type and, for revisits, the key of the response they refer to."""
    payload = F.coalesce(pages[body], F.lit("")).cast("binary")
    rows = pages.select(pages[key].cast("long").alias("page_id"), F.coalesce(pages[url], F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("long")})
    copies = (rows.where(F.col("payload_length") >= least).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
              .select("digest", "first"))
    again = F.col("first").isNotNull() & (F.col("payload_length") >= least) & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.join(copies, "digest", "left").select(
        "page_id", "url", "digest", "payload_length", F.when(again, F.col("first")).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"))


def record_id(key: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(key))}>"


def member(page_id: int | None, url: str, digest: str, length: int, refers_to: int | None, payload: bytes | None, level: int) -> bytes:
    """One record as one gzip member."""
    address = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {address}", f"WARC-Payload-Digest: sha256:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Payload-Length: {length}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def full_address(spark: SparkSession, path: str) -> str:
    """The path with its store, as tasks need it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def write_archives(records: DataFrame, folder: str, level: int = 6, file_bytes: int = FILE) -> DataFrame:
    """Write planned records under ``folder``; the manifest of finished files (path, bytes)."""
    folder = full_address(records.sparkSession, folder)
    columns = ("page_id", "url", "digest", "payload_length", "refers_to", "payload")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        out, path, size, done = None, "", 0, []

        def close() -> None:
            out.close()
            done.append((f"{folder}/{path}", size))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if out is None:
                    store.create_dir(root, recursive=True)
                    path, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                data = member(*row, level)
                out.write(data)
                size += len(data)
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
                                         names=["path", "bytes"])

    return cut(records.select(*columns).mapInArrow(write, "path string, bytes long"))


class Source:
    """Bytes of a file by position, read in blocks."""

    def __init__(self, file):
        self.file, self.size, self.low, self.data = file, file.size(), 0, b""

    def at(self, position: int, least: int = 1) -> bytes:
        """What is in memory from ``position`` on: ``least`` bytes or more, fewer only at the end of the file."""
        if not (self.low <= position and position + least <= self.low + len(self.data)):
            self.file.seek(position)
            self.low, self.data = position, self.file.read(max(BLOCK, least))
        return self.data[position - self.low:]

    def find(self, position: int, stop: int) -> int:
        """Position of the next magic that starts before ``stop``, or -1."""
        while position < min(stop, self.size):
            here = self.at(position, len(MAGIC))
            found = here.find(MAGIC)
            if found >= 0:
                return position + found if position + found < stop else -1
            position += max(1, len(here) - len(MAGIC) + 1)
        return -1


def parse_head(text: bytes) -> tuple[dict[str, str], int] | None:
    """Fields of a record header and where its block begins; None if this is no complete header."""
    end = text.find(b"\r\n\r\n")
    if not text.startswith(b"WARC/1.") or end < 0:
        return None
    fields = dict(line.split(":", 1) for line in text[:end].decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
    return (fields, end + 4) if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


def decode(source: Source, position: int) -> tuple[bytes, int] | None:
    """The member at ``position`` and the position after it; None if it is no record."""
    unpack, parts, checked, at = zlib.decompressobj(31), [], False, position
    try:
        while not unpack.eof:
            fed = source.at(at)
            if not fed:
                return None
            parts.append(unpack.decompress(fed))
            at += len(fed) - len(unpack.unused_data)
            if not checked:
                head = b"".join(parts)
                parts = [head]
                if not head.startswith(b"WARC/1.") and len(head) >= 7:
                    return None
                checked = b"\r\n\r\n" in head
    except zlib.error:
        return None
    return b"".join(parts), at


def records_in(source: Source, start: int, stop: int) -> Iterator[tuple]:
    """Records that start in [start, stop)."""
    position = start
    while (position := source.find(position, stop)) >= 0:
        got = decode(source, position)
        head = parse_head(got[0]) if got else None
        if head is None:
            position += 1
            continue
        fields, begin = head
        block = got[0][begin:begin + int(fields["content-length"])]
        body = block[block.find(b"\r\n\r\n") + 4:] if fields.get("content-type", "").startswith("application/http") else block
        number = lambda name: int(fields[name]) if name in fields else None
        kind = fields["warc-type"]
        yield (kind, number("x-page-id"), fields.get("warc-target-uri", ""), number("x-refers-to-page"),
               fields.get("warc-payload-digest", "").removeprefix("sha256:"), number("x-payload-length"),
               None if kind == "revisit" else body)
        position = got[1]


def read_archives(manifest: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """All records of the files of a manifest (path, bytes); each task reads byte ranges."""
    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(range_bytes))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("bytes")).alias("stop"))
    # a stated number of tasks: rows this small would be gathered into one task by their size
    ranges = ranges.repartition(min(max(1, ranges.count()), TASKS))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in RECORD.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as file:
                    rows, held = [], 0
                    for row in records_in(Source(file), start, stop):
                        rows.append(row)
                        held += len(row[-1] or b"")
                        if held >= 4 << 20 or len(rows) >= 4096:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    return ranges.mapInArrow(read, RECORD)


@query("op5_warc", """
with p as (
  select page_id, coalesce(html, '') as body, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes from pages
), f as (
  select body, min(page_id) as first_id from p where payload_bytes >= 100 group by body
)
select p.page_id, p.payload_bytes, sha256(p.body) as payload_digest,
  case when f.first_id <> p.page_id then 'revisit' else 'response' end as record_type,
  case when f.first_id <> p.page_id then f.first_id end as refers_to
from p left join f on p.body = f.body
""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = working_path(spark, "warc")
    read = read_archives(write_archives(plan_records(table(spark, sf_dir, "pages")), folder))
    stored = F.col("warc_type") == "response"
    return read.select(
        "page_id", F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(stored, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), "refers_to")

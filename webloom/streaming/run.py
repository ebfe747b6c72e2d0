"""Starting streams: checkpoints, sinks, replays (SRC-3, SRC-4, SNK-4, SNK-5, STR-3, STR-4)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from webloom.streaming.route import route_of

BATCH = "batch_id"


def start(result: DataFrame, sink: str, checkpoint: str, mode: str = "append", once: bool = False,
          options: dict[str, str] | None = None, name: str | None = None) -> StreamingQuery:
    """Start a stream into a named sink format.  The checkpoint is what makes it resume; it is required."""
    if not checkpoint:
        raise ValueError("a stream needs a checkpoint location")
    writer = result.writeStream.format(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    for key, value in (options or {}).items():
        writer = writer.option(key, value)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_batches(result: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append", once: bool = False) -> StreamingQuery:
    """Start a stream that hands each micro-batch to ``write(batch, batch_id)``."""
    if not checkpoint:
        raise ValueError("a stream needs a checkpoint location")
    writer = (result.writeStream.foreachBatch(write).outputMode(mode)
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()


def consume(tasks: DataFrame, task_type: str, handler: Callable[[DataFrame], DataFrame], path: str,
            checkpoints: str, once: bool = False) -> StreamingQuery:
    """SRC-3: one resumable query per task type, its position kept under ``<task_type>_consumer``.

    Messages queued as plain ``task`` go by the type inside their payload, as everywhere.
    """
    handled = handler(tasks.filter(route_of(F.col("task_type"), F.col("payload")) == task_type))
    return start_batches(handled, table_sink(path), f"{checkpoints}/{task_type}_consumer", once=once)


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """SNK-5: replace the folder of this batch, so a replayed batch does not append twice."""
    batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, batch_id: write_batch(batch, batch_id, path)


def latest_rows(updates: DataFrame, keys: Sequence[str], batch: str = BATCH) -> DataFrame:
    """STR-3: update-mode output to current rows: per key, the row of the latest batch."""
    rest = [c for c in updates.columns if c not in (*keys, batch)]
    last = F.max_by(F.struct(*rest), F.col(batch)).alias("_row")
    return updates.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def routed_sink(routes, path: str) -> Callable[[DataFrame, int], None]:
    """PRJ-3 and SNK-5: route each micro-batch, one folder per route; the batch is read once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for name, rows in routes.apply(batch).items():
                write_batch(rows, batch_id, f"{path}/{name}")
        finally:
            batch.unpersist()

    return write


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A table written batch by batch, or None while nothing has been written; any other trouble is raised."""
    reader = spark.read.option("basePath", path)
    try:
        return (reader.schema(schema) if schema else reader).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise

"""STR-7: credits ledger over a stream of signed amounts.

Each micro-batch is applied with the batch operator, starting from the balances of the batches
before it, so one user with very many events is cut into chunks here too and never meets one
state handler whole.  Batches apply in arrival order; inside a batch the stated order holds.

State is a log of balances: a batch adds the balances it changed, in its own folder, and every
``SNAPSHOT_EVERY``-th batch adds all of them, so a batch reads back to the last snapshot only.  A
replayed batch reads earlier batches alone and replaces its own folder: the same result again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from webloom.operators.dedup import distinct_on
from webloom.operators.ledger import CHUNK_ROWS, guarded_ledger
from webloom.streaming.run import BATCH, latest_rows, read_table, write_batch

SNAPSHOT_EVERY = 50


def once_per_event(events: DataFrame, event_id: str, event_time: str, delay: str) -> DataFrame:
    """DDP-3 on the stream: a replayed event id counts once within the delay."""
    return distinct_on(events, [event_id], event_time, delay)


def balances_before(spark: SparkSession, path: str, key: str, batch_id: int) -> DataFrame | None:
    """Balances after all batches before this one, or None when there are none."""
    log = read_table(spark, f"{path}/balances")
    if log is None or batch_id == 0:
        return None
    snapshot = (batch_id - 1) // SNAPSHOT_EVERY * SNAPSHOT_EVERY
    if read_table(spark, f"{path}/balances/{BATCH}={snapshot}") is None:
        snapshot = 0
    return latest_rows(log.filter((F.col(BATCH) >= snapshot) & (F.col(BATCH) < batch_id)), [key])


def ledger_sink(path: str, key: str, order: list[str], amount: str, chunk_rows: int = CHUNK_ROWS):
    """A ``write(batch, batch_id)`` that keeps ``<path>/entries`` and ``<path>/balances``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        snapshot = batch_id > 0 and batch_id % SNAPSHOT_EVERY == 0
        batch = batch.persist()     # read several times, and its state work must run once
        try:
            if not snapshot and batch.isEmpty():
                return
            opening = balances_before(spark, path, key, batch_id)
            entries = guarded_ledger(batch, key, order, amount, opening, chunk_rows)
            write_batch(entries, batch_id, f"{path}/entries")
        finally:
            batch.unpersist()
        entries = spark.read.schema(entries.schema).parquet(f"{path}/entries/{BATCH}={batch_id}")
        closing = entries.groupBy(key).agg(F.max_by("balance", F.struct(*order)).alias("balance"))
        if opening is not None and snapshot:
            closing = closing.unionByName(opening.join(closing, key, "left_anti"))
        write_batch(closing, batch_id, f"{path}/balances")

    return write


def current_balances(spark: SparkSession, path: str, key: str) -> DataFrame:
    return latest_rows(spark.read.parquet(f"{path}/balances"), [key])

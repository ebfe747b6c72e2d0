"""STR-5: a given table fed to a stream part by part, so that its watermark moves one step at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from webloom.streaming.generations import Folder

PART = "_part"


def time_part(time: Column, lowest: Column, highest: Column, parts: int) -> Column:
    """Number of the equal part of the time span that a time lies in, from 0."""
    at, low, high = (F.unix_micros(c.cast("timestamp")) for c in (time, lowest, highest))
    return F.least(F.lit(parts - 1), F.floor((at - low) * parts / (high - low + 1))).cast("int")


def in_steps(rows: DataFrame, part: Column, parts: int, path: str, begin: Callable[[DataFrame], StreamingQuery]) -> None:
    """Run a query over the parts of a table in the order of their numbers, from 0 to ``parts`` - 1.

    All parts are written in one pass; then one after the other is moved into the folder that the query watches, and is
    worked off before the next one comes. ``begin`` gets the stream and starts the query.
    """
    spark, folder = rows.sparkSession, Folder(rows.sparkSession, path)
    rows.withColumn(PART, part).write.partitionBy(PART).parquet(f"{path}/dealt")
    folder.make("in")
    query = begin(spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{path}/in"))
    try:
        there = folder.names("dealt")
        for k in range(parts):
            if f"{PART}={k}" in there:
                folder.rename(f"dealt/{PART}={k}", f"in/{k:06d}")
                query.processAllAvailable()
    finally:
        query.stop()

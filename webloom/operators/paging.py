"""Previews and pages of a table (SRT-1 to SRT-4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from webloom.operators.ordered import HOT_ROWS, Ordered

PAGE_SIZE = 5


def preview(df: DataFrame, order: Sequence[str], rows: int = 10) -> DataFrame:
    """SRT-2: the first rows in a stated order (top-k per partition, then merged)."""
    return df.orderBy(*order).limit(rows)


def page_count(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """SRT-3: ``ceil(rows / size)``."""
    return df.agg(F.ceil(F.count(F.lit(1)) / size).alias("total_pages"))


def page(df: DataFrame, order: Sequence[str], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """SRT-3: page ``number`` (1-based).  For a page far in, use ``page_after`` or ``numbered_pages``."""
    if number < 1:
        raise ValueError("pages start at 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, key: str, last_seen, size: int = PAGE_SIZE) -> DataFrame:
    """SRT-3 by key: the page after the last key seen; the filter reaches the scan."""
    return df.filter(F.col(key) > F.lit(last_seen)).orderBy(key).limit(size)


def numbered_pages(df: DataFrame, order: Sequence[str], size: int = PAGE_SIZE,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """SRT-3 for all pages at once: every row with its page number, without a single-task sort."""
    numbered = Ordered(df, [], order, hot_rows).row_number("_n").result()
    return numbered.withColumn("page", (F.floor((F.col("_n") - 1) / size) + 1).cast("bigint")).drop("_n")


def write_pages(df: DataFrame, order: Sequence[str], path: str, size: int = PAGE_SIZE, tasks: int | None = None) -> None:
    """SRT-3 for deep pages: write the rows in order, range by range, with a directory of pages.

    ``<path>/rows`` holds the rows, each file one range of keys; ``<path>/directory`` the number of rows before each file's
    range. Rows are counted where they lie; nothing is sorted in one task. ``order`` must tell all rows apart.
    """
    spark = df.sparkSession
    ranged = (df.repartitionByRange(tasks, *order) if tasks else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    numbered = ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    numbered.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    counts = spark.read.parquet(f"{path}/rows").groupBy("_range").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)     # a row per file
    counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}/directory")


def read_page(spark: SparkSession, path: str, order: Sequence[str], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """SRT-3: page ``number`` (1-based) of what ``write_pages`` wrote: only the ranges that hold it are opened, only its rows read."""
    if number < 1:
        raise ValueError("pages start at 1")
    low, high = (number - 1) * size, number * size
    held = spark.read.parquet(f"{path}/directory").filter((F.col("before") < high) & (F.col("before") + F.col("rows") > low)).collect()
    rows = spark.read.parquet(f"{path}/rows")
    asked = F.lit(False)
    for r in held:      # at most the ranges that a page touches
        asked = asked | ((F.col("_range") == r["_range"]) & (F.col("_at") >= low - r["before"]) & (F.col("_at") < high - r["before"]))
    return rows.filter(asked).orderBy(*order).drop("_range", "_at")


def cap_pages(df: DataFrame, pages: Column, page_no: str = "page_no") -> DataFrame:
    """SRT-4: at most ``pages`` pages per crawl."""
    return df.filter(F.col(page_no) <= pages)


def storage_order(df: DataFrame, scraped_at: str = "scraped_at", clustered: bool = False) -> DataFrame:
    """SRT-1: rows sorted by time inside each written file, without a shuffle.

    ``clustered`` first gives each file its own time range, for rewriting a table.
    """
    return (df.repartitionByRange(scraped_at) if clustered else df).sortWithinPartitions(scraped_at)

"""Row generators (SRC-9 to SRC-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLOCK = 65_536

# Topics created and pool rows seeded per task type.
TOPIC_COUNTS = {"scrape": 20, "transform": 10, "store": 5}
POOL_COUNTS = {"scrape": 10, "transform": 5, "store": 3}


def number_rows(df: DataFrame, count: Column, name: str) -> DataFrame:
    """Each row repeated with ``name`` = 1..count; none when the count is missing or not positive.

    Every row first becomes one row per block of ``BLOCK`` numbers (one row, for most), and the blocks
    are dealt out before they expand, so one huge count is no single task's work. The input is read once.
    """
    rows = df.withColumn("_total", count.cast("bigint")).filter(F.col("_total") > 0)
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_total") - 1) / BLOCK).cast("bigint"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = F.sequence(F.col("_block") * BLOCK + 1, F.least((F.col("_block") + 1) * BLOCK, F.col("_total")))
    return (rows.withColumn("_block", F.explode(blocks)).repartition(tasks)
            .withColumn(name, F.explode(inside)).drop("_block", "_total"))


def page_urls(specs: DataFrame, url: str = "url", pages: str = "page_num") -> DataFrame:
    """SRC-9: ``url?page=i`` for i = 1..pages."""
    numbered = number_rows(specs, F.col(pages), "page_no")
    return numbered.withColumn("page_url", F.concat(F.col(url), F.lit("?page="), F.col("page_no").cast("string")))


def count_rows(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """A small dictionary of counts as a table."""
    return spark.createDataFrame(list(counts.items()), "task_type string, n int")


def topic_names(counts: DataFrame, task_type: str = "task_type", count: str = "n") -> DataFrame:
    """SRC-10: ``<type>_<i>`` for i = 1..count."""
    numbered = number_rows(counts.select(F.col(task_type).alias("task_type"), F.col(count).alias("_n")),
                           F.col("_n"), "i")
    return numbered.select(
        F.concat_ws("_", F.col("task_type"), F.col("i").cast("string")).alias("topic_name"), "task_type")


def seed_pool(counts: DataFrame, task_type: str = "task_type", count: str = "n") -> DataFrame:
    """SRC-11: free pool rows for each generated name."""
    return topic_names(counts, task_type, count).select(
        "topic_name", "task_type", F.lit(False).alias("assigned"), F.lit("").alias("workflow_id"))

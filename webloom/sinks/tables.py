"""Table and file sinks (SNK-5 to SNK-11, SCL-12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from webloom.functions.text import site_key
from webloom.operators.records import widen
from webloom.operators.sessions import collect_actions


def stamped(df: DataFrame, at: Column | None = None) -> DataFrame:
    """SCL-12: the ingest time."""
    return df.withColumn("scraped_at", F.current_timestamp() if at is None else at)


MONTH = "scraped_month"


def append_by_month(rows: DataFrame, path: str, gather: bool = False) -> None:
    """Append rows in one folder per month of ``scraped_at``, so a time filter opens only its months.

    Each task sorts its rows and writes them where they are, without a shuffle: an append of new rows holds few
    months. With ``gather`` rows meet by month first, a few files a month, a busy month split by Spark's
    rebalancing: for loading many months at once, and for ``compact_months``.
    """
    dated = rows.withColumn(MONTH, F.trunc("scraped_at", "month"))
    dated = dated.hint("rebalance", MONTH) if gather else dated
    dated.sortWithinPartitions(MONTH, "scraped_at").write.mode("append").partitionBy(MONTH).parquet(path)


def compact_months(spark: SparkSession, path: str, target: str) -> None:
    """Rewrite what many appends left as a new table with few files a month."""
    append_by_month(spark.read.parquet(path).drop(MONTH), target, gather=True)


def read_between(spark: SparkSession, path: str, first=None, end=None) -> DataFrame:
    """Rows written by ``append_by_month`` with ``first <= scraped_at < end``; only the months in question are read."""
    rows = spark.read.parquet(path)
    if first is not None:
        first = F.lit(first).cast("timestamp_ntz")
        rows = rows.filter((F.col(MONTH) >= F.trunc(first, "month")) & (F.col("scraped_at") >= first))
    if end is not None:
        end = F.lit(end).cast("timestamp_ntz")
        rows = rows.filter((F.col(MONTH) <= F.trunc(end, "month")) & (F.col("scraped_at") < end))
    return rows.drop(MONTH)


def append_long(rows: DataFrame, path: str) -> None:
    """SNK-6: append ``(url, field, content, scraped_at)`` by month."""
    append_by_month(rows.select("url", "field", "content", "scraped_at"), path)


def document_rows(records: DataFrame, url: str, fields: Sequence[str], at: Column) -> DataFrame:
    """SNK-7: ``(url, content, scraped_at)`` with the record as JSON."""
    return records.select(F.col(url).alias("url"), F.to_json(F.struct(*fields)).alias("content"),
                          at.alias("scraped_at"))


def append_documents(rows: DataFrame, path: str) -> None:
    """SNK-7: append document rows by month."""
    append_by_month(rows.select("url", "content", "scraped_at"), path)


def append_collection(rows: DataFrame, path: str) -> None:
    """SNK-5 for a batch: append rows to a named collection."""
    rows.write.mode("append").parquet(path)


def write_csv(records: DataFrame, path: str, record: str | None = None) -> None:
    """SNK-8: CSV with a header, values quoted, quotes doubled; a map column becomes one column per key first."""
    wide = records if record is None else widen(records, record)
    wide.write.mode("overwrite").options(header=True, quoteAll=True, escape='"').csv(path)


def action_logs(actions: DataFrame, origin: str, order: Sequence[str], fields: Sequence[str], part: Column) -> DataFrame:
    """SNK-9: ``(site_key, website, part, piece, actions)`` per site and part, such as the day, in pieces of bounded length."""
    logs = collect_actions(actions, [origin], order, fields, part)
    return logs.select(site_key(F.col(origin)).alias("site_key"), F.col(origin).alias("website"), "part", "piece", "actions")


def write_action_logs(logs: DataFrame, path: str) -> None:
    """SNK-9: one JSON folder per site."""
    logs.write.mode("overwrite").partitionBy("site_key").json(path)


def workflow_documents(tasks: DataFrame, order: str = "task_id") -> DataFrame:
    """SNK-11: one document per workflow, its tasks as the array ``tasks``, in order.  A workflow is written by a person; its tasks fit a row."""
    rest = [c for c in tasks.columns if c not in ("user_id", "workflow_id")]
    first = [order, *[c for c in rest if c != order]]
    return tasks.groupBy("user_id", "workflow_id").agg(F.array_sort(F.collect_list(F.struct(*first))).alias("tasks"))


def write_workflows(workflows: DataFrame, path: str) -> None:
    """SNK-11: workflow documents as JSON in a folder per user, a user's documents in few files."""
    workflows.hint("rebalance", "user_id").write.mode("overwrite").partitionBy("user_id").json(path)

"""Resource pool: initialise, allot, release (JON-2, JON-3, JON-4, WIN-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webloom.functions.text import token
from webloom.operators.ordered import HOT_ROWS, Ordered


def add_missing_topics(pool: DataFrame, topics: DataFrame) -> DataFrame:
    """JON-2: insert topics not in the pool yet; rows already there stay as they are.

    The task type is the second ``_`` token of the topic name.
    """
    new = (topics.select("topic").distinct().join(pool, "topic", "left_anti")
           .select("topic", token(F.col("topic"), "_", 2).alias("task_type"),
                   F.lit("available").alias("status"), F.lit(None).cast("string").alias("workflow_id")))
    return pool.select("topic", "task_type", "status", "workflow_id").unionByName(new)


def rank_within_type(df: DataFrame, task_type: str, order: list[str], name: str = "slot",
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """WIN-2: 1-based rank within a type; types are few, so large ones are split over tasks."""
    return Ordered(df, [task_type], order, hot_rows).row_number(name).result()


def allot(requests: DataFrame, pool: DataFrame, request_order: list[str], pool_order: list[str],
          hot_rows: int = HOT_ROWS) -> DataFrame:
    """JON-3: the n-th request of a type takes the n-th free pool row of that type.

    Requests beyond the supply keep a null ``topic_name``.  The join key holds the rank, so it
    spreads evenly however few the types are.
    """
    free = pool.filter(~F.col("assigned")).select("task_type", "topic_name", *[
        c for c in pool_order if c not in ("task_type", "topic_name")])
    offered = rank_within_type(free, "task_type", pool_order, "slot", hot_rows).select(
        "task_type", "slot", "topic_name")
    wanted = rank_within_type(requests, "task_type", request_order, "slot", hot_rows)
    return wanted.join(offered, ["task_type", "slot"], "left")


def release(pool: DataFrame, finished: DataFrame) -> DataFrame:
    """JON-4: rows held by a finished workflow become free.

    Free rows hold no workflow (null or empty) and are most of a pool: they stay out of the join, where they
    would all have one key.
    """
    done = finished.select("workflow_id", F.lit(True).alias("_done")).filter("workflow_id <> ''").distinct()
    joined = pool.filter("workflow_id <> ''").join(done, "workflow_id", "left")
    freed = F.col("_done").isNotNull()
    held = joined.select(*[
        F.when(freed, F.lit(False)).otherwise(F.col(c)).alias(c) if c == "assigned"
        else F.when(freed, F.lit("")).otherwise(F.col(c)).alias(c) if c == "workflow_id"
        else F.col(c) for c in pool.columns])
    return held.unionByName(pool.filter("workflow_id is null or workflow_id = ''"))

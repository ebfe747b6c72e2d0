"""Counters and histograms per task type (AGG-4, AGG-5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Upper bounds in seconds; the last bucket is unbounded.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def processed_count(tasks: DataFrame, task_type: str = "task_type", succeeded: Column | None = None) -> DataFrame:
    """AGG-4: successfully handled tasks per type."""
    done = tasks if succeeded is None else tasks.filter(succeeded)
    return done.groupBy(task_type).agg(F.count(F.lit(1)).alias("processed"))


def bucket_name(bound: float) -> str:
    return "le_" + f"{bound:g}".replace(".", "_")


def duration_histogram(tasks: DataFrame, duration: str, task_type: str = "task_type",
                       buckets: Sequence[float] = BUCKETS) -> DataFrame:
    """AGG-5: cumulative bucket counts, sum and count per type, in one aggregation pass."""
    seconds = F.col(duration)
    counts = [F.count(F.when(seconds <= b, 1)).alias(bucket_name(b)) for b in buckets]
    return tasks.groupBy(task_type).agg(
        *counts, F.count(seconds).alias("le_inf"), F.sum(seconds).alias("duration_sum"),
        F.count(seconds).alias("duration_count"))

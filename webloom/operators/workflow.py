"""Workflow tables: task fan-out and dependency ends (PRJ-13, JON-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fan_out(workflows: DataFrame, tasks: str = "tasks") -> DataFrame:
    """PRJ-13: one row per task of a JSON task array; each task stays JSON text."""
    rest = [c for c in workflows.columns if c != tasks]
    parsed = F.from_json(F.col(tasks), "array<string>")
    return workflows.select(*rest, F.posexplode(parsed).alias("task_index", "task"))


def root_tasks(tasks: DataFrame, depends_on: str = "depends_on") -> DataFrame:
    """JON-8: tasks without dependencies (none listed, or an empty list)."""
    return tasks.filter(F.col(depends_on).isNull() | (F.size(depends_on) == 0))


def terminal_tasks(tasks: DataFrame, keys: list[str], task: str = "task_id",
                   depends_on: str = "depends_on") -> DataFrame:
    """JON-8: tasks nobody depends on, within the same workflow ``keys``."""
    needed = tasks.select(*keys, F.explode(depends_on).alias(task)).distinct()
    return tasks.join(needed, [*keys, task], "left_anti")

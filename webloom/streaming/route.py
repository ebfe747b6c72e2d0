"""Task messages: decode, split, route, handle (PRJ-1 to 5, PRJ-3, UDF-1, AGG-4)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

TASK_SCHEMA = "task_type string, payload string"
Handler = Callable[[DataFrame], DataFrame]


def is_json_object(raw: Column) -> Column:
    """Whether a text is one valid JSON object; only texts that begin like one are parsed."""
    begins = F.coalesce(raw.rlike(r"^[ \t\n\r]*\{"), F.lit(False))
    return F.when(begins, F.try_parse_json(raw).isNotNull()).otherwise(F.lit(False))


def with_status(messages: DataFrame, value: str = "value") -> DataFrame:
    """PRJ-5 in one pass: ``status`` is ``readable`` or ``dead``."""
    return messages.withColumn("status", F.when(is_json_object(F.col(value)), "readable").otherwise("dead"))


def split_malformed(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """PRJ-5: (readable messages, dead letters)."""
    ok = is_json_object(F.col(value))
    return messages.filter(ok), messages.filter(~ok)


def decode_tasks(messages: DataFrame, value: str = "value") -> DataFrame:
    """PRJ-1 for task messages; the raw text stays in ``raw``, an object payload stays JSON text."""
    text = F.col(value).cast("string")
    return messages.select(text.alias("raw"), F.from_json(text, TASK_SCHEMA).alias("data")).select("raw", "data.*")


def route_of(task_type: Column, payload: Column) -> Column:
    """PRJ-3: messages queued as plain ``task`` go by the type inside their payload."""
    inner = F.get_json_object(payload, "$.task_type")
    return F.when(task_type == "task", F.coalesce(inner, task_type)).otherwise(task_type)


def with_route(tasks: DataFrame, known: list[str]) -> DataFrame:
    """Route name per message; types without a route get ``unrouted``."""
    route = route_of(F.col("task_type"), F.col("payload"))
    return tasks.withColumn("route", F.when(route.isin(*known), route).otherwise("unrouted"))


def transform_tasks(tasks: DataFrame) -> DataFrame:
    """PRJ-2 and PRJ-4: transform messages, with the payload copied to ``processed_payload``."""
    return tasks.filter(F.col("task_type") == "transform").withColumn("processed_payload", F.col("payload"))


class Routes:
    """UDF-1: handlers per task type, each ``DataFrame -> DataFrame``."""

    def __init__(self, handlers: Mapping[str, Handler] | None = None):
        self.handlers: dict[str, Handler] = dict(handlers or {})

    def register(self, task_type: str, handler: Handler) -> None:
        self.handlers[task_type] = handler

    def apply(self, tasks: DataFrame) -> dict[str, DataFrame]:
        """Handled rows per route, plus the rows no route takes."""
        routed = with_route(tasks, list(self.handlers))
        result = {name: handler(routed.filter(F.col("route") == name)) for name, handler in self.handlers.items()}
        result["unrouted"] = routed.filter(F.col("route") == "unrouted")
        return result

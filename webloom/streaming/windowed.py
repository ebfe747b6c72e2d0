"""Sliding-window aggregates, one function for batch and stream (AGG-1 to 3, STR-1, 2, 6, SNK-1)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

# The event message and the defaults of the window job.
EVENT_SCHEMA = "task_id string, payload map<string,string>, timestamp timestamp"
WINDOW, SLIDE, DELAY = "10 minutes", "5 minutes", "5 minutes"


def aggregates(spec: Mapping[str, str], payload: str = "payload") -> list[Column]:
    """Aggregate list from ``{field: "count" | "avg"}``.

    ``count`` counts rows, whatever the field holds; ``avg`` averages a payload entry read as a
    number, skipping values that are none.  An empty list or another function name raises.
    """
    result = []
    for field, function in spec.items():
        if function == "count":
            result.append(F.count(F.lit(1)).alias(f"{field}_count"))
        elif function == "avg":
            value = F.try_element_at(F.col(payload), F.lit(field)).try_cast("double")
            result.append(F.avg(value).alias(f"{field}_avg"))
        else:
            raise ValueError(f"unknown aggregate {function!r} for {field!r}")
    if not result:
        raise ValueError("no aggregates given")
    return result


def decode_events(messages: DataFrame, value: str = "value") -> DataFrame:
    """PRJ-1: message text to event columns; unreadable text gives a row of nulls."""
    parsed = F.from_json(F.col(value).cast("string"), EVENT_SCHEMA)
    return messages.select(parsed.alias("data")).select("data.*")


def dead_letters(messages: DataFrame, value: str = "value") -> DataFrame:
    """STR-6: the raw text of messages that no window takes, and why."""
    raw = F.col(value).cast("string")
    parsed = messages.select(raw.alias("raw"), F.from_json(raw, EVENT_SCHEMA).alias("data"))
    reason = F.when(F.col("data").isNull() | (F.col("data.task_id").isNull() & F.col("data.payload").isNull()
                                              & F.col("data.timestamp").isNull()), "unreadable").otherwise("no timestamp")
    return parsed.filter(F.col("data.timestamp").isNull()).select("raw", reason.alias("reason"))


def split_timeless(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """STR-6: (events with a time, dead letters without one); the latter fall in no window."""
    timed = F.col("timestamp").isNotNull()
    return events.filter(timed), events.filter(~timed)


def windowed_aggregate(events: DataFrame, spec: Mapping[str, str], window: str = WINDOW, slide: str = SLIDE,
                       delay: str = DELAY) -> DataFrame:
    """Aggregates per sliding window; partial per task before the one shuffle.

    The watermark drops late rows of a stream and is without effect on a batch.
    """
    columns = aggregates(spec)
    return (events.withWatermark("timestamp", delay)
            .groupBy(F.window("timestamp", window, slide)).agg(*columns))


def as_messages(result: DataFrame) -> DataFrame:
    """SNK-1: window text as key, the row as JSON value."""
    return result.select(F.col("window").cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))

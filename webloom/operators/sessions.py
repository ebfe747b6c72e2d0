"""Recorded browser actions: sessions and exports (WIN-1, AGG-7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from webloom.operators.ordered import HOT_ROWS, Ordered


def sessions(actions: DataFrame, user: str, site: str, order: Sequence[str],
             hot_rows: int = HOT_ROWS, split: bool | None = None) -> DataFrame:
    """WIN-1: a user's log starts anew when the site changes; adds ``session_id`` from 1.

    ``split`` is the answer of ``has_hot_key`` where it is known already.
    """
    ordered = Ordered(actions, [user], order, hot_rows, split).changed(site, "_changed")
    return ordered.running_sum(F.col("_changed").cast("bigint"), "session_id").result().drop("_changed")


MOST_ACTIONS = 10_000


def collect_actions(actions: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str],
                    part: Column, most: int = MOST_ACTIONS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """AGG-7: the ordered action arrays of each group and ``part``, in pieces of at most ``most`` actions.

    ``part`` is a stated column, such as the day; ``piece`` counts from 0 within it. Both follow from the actions and their
    order, so a log has the same pieces at any size, and concatenated in this order they are the whole log.
    """
    placed = Ordered(actions.withColumn("part", part), [*keys, "part"], order, hot_rows).row_number("_n").result()
    placed = placed.withColumn("piece", F.floor((F.col("_n") - 1) / most).cast("int"))
    entry = F.struct("_n", F.struct(*fields).alias("_a"))
    return (placed.groupBy(*keys, "part", "piece").agg(F.array_sort(F.collect_list(entry)).alias("actions"))
            .withColumn("actions", F.transform("actions", lambda a: a["_a"])))

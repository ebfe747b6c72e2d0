"""Binding a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Catalyst merges projections into lambda bodies, where they run once per array element; a
    lambda variable is not merged.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))

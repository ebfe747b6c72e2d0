"""Row order within a key, safe for keys that hold much of the data.

A plain window sorts each key in one task.  ``Ordered`` asks first whether any
key is larger than ``hot_rows``.  If not, it uses plain windows.  If so, it
range-partitions by (key, order), which spreads a hot key over many tasks,
computes inside each (key, part), and carries values over the part borders.
Only keys that straddle a border need a carry, so the carry table has at most
two rows per partition whatever the data size; that bound is what allows
broadcasting it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from webloom.runtime import cut

HOT_ROWS = 1_000_000
PART = "_part"
FIRST = "_first"


def _join_small(df: DataFrame, small: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join a table bounded by the partition count; null keys match each other."""
    right = small.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in small.columns])
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return df.join(F.broadcast(right), condition, how).drop(*[f"_on_{c}" for c in on])


def has_hot_key(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> bool:
    """Whether some key holds more rows than one task should sort."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return not counts.filter(F.col("n") > hot_rows).select(F.lit(1)).limit(1).isEmpty()


LEAST_ROW = 8  # bytes a row takes at least, stored


def may_be_large(df: DataFrame, rows: int) -> bool:
    """Whether the planner's size estimate allows more than ``rows`` rows; reads nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > rows * LEAST_ROW


class Ordered:
    """``df`` seen in the total order ``order`` within ``keys`` (``keys`` may be empty).

    ``split`` says whether some key is too large for one task; both ways give the same rows.  Where it is not
    stated, an input that cannot hold ``hot_rows`` rows by the planner's estimate is not read to find
    out; of a larger one the key columns are counted first.  A hot key is then range-partitioned.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int = HOT_ROWS,
                 split: bool | None = None):
        self.keys, self.order = list(keys), list(order)
        self.split = (may_be_large(df, hot_rows) and has_hot_key(df, self.keys, hot_rows)) if split is None else split
        if not self.split:
            self.df = df
            self.window = Window.partitionBy(*self.keys).orderBy(*self.order)
            return
        # Range bounds come from sampling; writing the rows makes one choice of parts final.
        ranged = df.repartitionByRange(*self.keys, *self.order).withColumn(PART, F.spark_partition_id())
        ranged = cut(ranged)
        self.window = Window.partitionBy(*self.keys, PART).orderBy(*self.order)
        self.borders = cut(self._border_keys(ranged)) if self.keys else None
        self.df = ranged.withColumn(FIRST, F.row_number().over(self.window) == 1)

    def _border_keys(self, ranged: DataFrame) -> DataFrame:
        """First and last key of each part; every key over several parts is among them."""
        key = F.struct(*self.keys)
        edges = ranged.groupBy(PART).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
        return edges.select(F.explode(F.array("lo", "hi")).alias("k")).select("k.*").distinct()

    def _straddling(self) -> DataFrame:
        return self.df if self.borders is None else _join_small(self.df, self.borders, self.keys, "left_semi")

    def _with_carry(self, name: str, per_part: Column, over_parts, combine) -> "Ordered":
        """Join each (key, part) with a value carried from the earlier parts of its key."""
        before = Window.partitionBy(*self.keys).orderBy(PART)
        carry = (self._straddling().groupBy(*self.keys, PART).agg(per_part.alias("_v"))
                 .select(*self.keys, PART, over_parts(F.col("_v"), before).alias("_carry")))
        joined = _join_small(self.df, carry, [*self.keys, PART], "left")
        self.df = joined.withColumn(name, combine(F.col("_carry"))).drop("_carry")
        return self

    def changed(self, column: str, name: str) -> "Ordered":
        """Whether ``column`` differs from the previous row; true in the first row of a key."""
        def differs(before: Column) -> Column:
            return before.isNull() | ~before["value"].eqNullSafe(F.col(column))

        # Boxed, so that a missing row and a null value stay apart.
        box = F.struct(F.col(column).alias("value"))
        inside = F.lag(box).over(self.window)
        if not self.split:
            self.df = self.df.withColumn(name, differs(inside))
            return self
        self.df = self.df.withColumn("_before", inside)
        self._with_carry(name, F.max_by(box, F.struct(*self.order)), lambda v, w: F.lag(v).over(w),
                         lambda carry: differs(F.when(F.col(FIRST), carry).otherwise(F.col("_before"))))
        self.df = self.df.drop("_before")
        return self

    def running_sum(self, value: Column, name: str) -> "Ordered":
        """Sum of ``value`` up to and with this row."""
        rows = (Window.unboundedPreceding, Window.currentRow)
        inside = F.sum(value).over(self.window.rowsBetween(*rows))
        if not self.split:
            self.df = self.df.withColumn(name, inside)
            return self
        self.df = self.df.withColumn("_step", value).withColumn("_sum", F.sum("_step").over(
            self.window.rowsBetween(*rows)))
        self._with_carry(name, F.sum("_step"),
                         lambda v, w: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                         lambda carry: F.col("_sum") + F.coalesce(carry, F.lit(0)))
        self.df = self.df.drop("_step", "_sum")
        return self

    def row_number(self, name: str) -> "Ordered":
        """1-based position, as a bigint."""
        if not self.split:
            self.df = self.df.withColumn(name, F.row_number().over(self.window).cast("bigint"))
            return self
        return self.running_sum(F.lit(1).cast("bigint"), name)

    def result(self) -> DataFrame:
        return self.df.drop(PART, FIRST) if self.split else self.df

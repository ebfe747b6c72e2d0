"""De-duplication (DDP-1, DDP-2, STR-8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T


# A hash aggregate needs buffers of fixed width; these types have it.
FIXED_WIDTH = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType,
               T.TimestampType, T.TimestampNTZType)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """DDP-1: one row per key, the first in ``order``, nulls last; of equal ones any.

    The keys themselves are grouped, so they differ wherever their values do.  Where all else has a fixed width, one hash
    aggregate is the whole plan: copies collapse in the task that reads them.  Values of any width, such as pages, are in
    no aggregate: the first of each key is found by its order alone, and the rows come in by a join on both.
    Orders of several columns aggregate whole rows.
    """
    rows = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    place = lambda c: f"c{df.columns.index(c)}"
    group, by = [place(k) for k in keys], [place(o) for o in order]
    rest = [c for c in rows.columns if c not in group]
    if not rest:
        return df.distinct()
    fixed = lambda c: isinstance(rows.schema[c].dataType, FIXED_WIDTH)
    if len(by) > 1 or not fixed(by[0]):
        at = F.struct(*[x for c in by for x in (F.col(c).isNull(), F.col(c))])
        first = rows.groupBy(*group).agg(F.min_by(F.struct(*rest), at).alias("row"))
        kept = first.select(*group, *[F.col(f"row.{c}").alias(c) for c in rest])
    elif all(fixed(c) for c in rest):
        # all columns follow the same comparisons, so they come from the same row
        none = F.min(by[0]).isNull()
        kept = rows.groupBy(*group).agg(*[F.when(none, F.first(c)).otherwise(F.min_by(c, by[0])).alias(c) for c in rest])
    else:
        first = rows.groupBy(*group).agg(F.min(by[0]).alias("f")).toDF(*[f"f_{c}" for c in (*group, by[0])])
        same = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in (*group, by[0])]
        kept = rows.join(first, same, "left_semi")
        nth = F.row_number().over(Window.partitionBy(*group, by[0]).orderBy(F.lit(1)))
        kept = kept.withColumn("n", nth).filter("n = 1").drop("n")
    return kept.select(*rows.columns).toDF(*df.columns)


def distinct_on(df: DataFrame, keys: Sequence[str], event_time: str | None = None,
                delay: str = "5 minutes") -> DataFrame:
    """DDP-1 / STR-8: any one row per key; on a stream, within a watermark that bounds the state."""
    if df.isStreaming:
        if event_time is None:
            raise ValueError("a streaming de-duplication needs an event time")
        return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))


def first_content(pages: DataFrame, url: str = "url", content: str = "html", order: str = "fetched_at") -> DataFrame:
    """DDP-2: the first content seen for a URL wins; which one that is is found without the content."""
    return keep_first(pages.select(url, content, order), [url], [order]).select(url, content)

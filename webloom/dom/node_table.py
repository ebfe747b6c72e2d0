"""Elements as a written table, and relations between them without arrays (JON-6, JON-7).

A page whose elements outgrow a row is handled element by element. The table is bucketed by page and sorted by page
and position, so relations need no shuffle: an element's descendants are those whose position lies in its interval, and
intervals of one page are nested or apart. One pass over a page's elements in order, with the containers that are open
on a stack, gives all pairs; memory holds the open containers and a batch, never a page.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from webloom.dom.shred import node_rows, slice_text
from webloom.runtime import working_path

BUCKETS = 64
OUT_ROWS = 10_000


def write_nodes(shredded: DataFrame, name: str, key: str = "page_id", buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """Write all elements with their texts as table ``name``, bucketed by page, in document order; returns the table."""
    spark = shredded.sparkSession
    rows = shredded.select(key, F.col("text").alias("_text"), F.explode("nodes").alias("n"))
    rows = rows.select(key, "n.*", slice_text(F.col("_text"), F.col("n")).alias("content"))
    writer = rows.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key, "pre")
    writer.option("path", path or working_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def by_page(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """A page's elements in one task, in order; a bucketed table has them so."""
    return nodes.sortWithinPartitions(key, "pre")


def containment(nodes: DataFrame, outer: Column, inner: Column, key: str = "page_id", content: str = "content") -> DataFrame:
    """JON-6: ``(key, outer_pre, pre, content)`` for every element that passes ``inner`` strictly inside one that passes ``outer``.

    ``nodes`` has the pages of a partition whole, as ``write_nodes`` leaves them.
    """
    marked = nodes.select(F.col(key).alias("key"), "pre", "last", outer.alias("is_outer"), inner.alias("is_inner"), F.when(inner, F.col(content)).alias("content"))
    marked = by_page(marked.filter("is_outer or is_inner"), "key")
    kind = nodes.schema[key].dataType.simpleString()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, open_ = None, []      # open containers of the page, outermost first
        out: tuple[list, ...] = ([], [], [], [])
        types = None
        for batch in batches:
            types = [batch.schema.field(c).type for c in ("key", "pre", "pre", "content")]
            columns = [batch.column(c).to_pylist() for c in ("key", "pre", "last", "is_outer", "is_inner", "content")]
            for key_, pre, last, is_outer, is_inner, text in zip(*columns):
                if key_ != page:
                    page, open_ = key_, []
                while open_ and open_[-1][1] < pre:
                    open_.pop()
                if is_inner:
                    for start, _ in open_:
                        for values, x in zip(out, (key_, start, pre, text)):
                            values.append(x)
                if is_outer:
                    open_.append((pre, last))
                if len(out[0]) >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=["key", "outer_pre", "pre", "content"])
                    out = ([], [], [], [])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=["key", "outer_pre", "pre", "content"])

    return marked.mapInArrow(pairs, f"key {kind}, outer_pre int, pre int, content string").withColumnRenamed("key", key)


def children(nodes: DataFrame, parent: Column, child: Column, key: str = "page_id") -> DataFrame:
    """JON-7: the elements that pass ``child`` and whose parent passes ``parent``: a join on page and parent, co-located by page."""
    parents = nodes.filter(parent).select(F.col(key).alias("_page"), F.col("pre").alias("_pre"))
    found = nodes.filter(child)
    return found.join(parents.hint("merge"), (F.col(key) == F.col("_page")) & (F.col("parent") == F.col("_pre"))).drop("_page", "_pre")


BUCKET_SETTINGS = {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextmanager
def whole_buckets(spark: SparkSession) -> Iterator[None]:
    """While plans are run in it, tasks read whole buckets, and a join on more columns than the bucket's needs no shuffle."""
    before = {name: spark.conf.get(name) for name in BUCKET_SETTINGS}
    for name, value in BUCKET_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)

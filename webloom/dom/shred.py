"""EXT-0 / UDF-2: HTML pages to node arrays.

``shred`` keeps one row per page: the page text (UTF-8 bytes, all text nodes
in document order) and its elements in pre-order.  An element's subtree is
the id interval ``pre..last`` and its text is one slice of the page text, so
nothing is copied per ancestor, and every selector or record operator can
work inside the row: no shuffle, and the page is the unit of parallelism.
``node_rows`` gives the same elements as a plain table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from webloom.dom import markup
from webloom.dom.markup import page_nodes

# The helper travels inside the UDF, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(markup)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 1024 * 1024
BLANKS = str.maketrans("\t\n\f\r", "    ")
NODE = T.StructType([
    T.StructField("pre", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("id_attr", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text_start", T.IntegerType()),
    T.StructField("text_len", T.IntegerType()),
])
SHREDDED = T.StructType([
    T.StructField("text", T.BinaryType()),
    T.StructField("nodes", T.ArrayType(NODE)),
])


def class_names(value: str) -> list[str]:
    """The parts between the white space of the HTML standard."""
    return [part for part in value.translate(BLANKS).split(" ") if part]


def page_slices(html: pa.Array) -> Iterator[list[bytes | None]]:
    """The pages of a batch in slices of at most ``SLICE_BYTES``; a larger page is alone. An empty batch is one slice."""
    slice_, size = [], 0
    for value in html.cast(pa.binary()):     # bytes, since a column may hold text that is no valid UTF-8
        source = value.as_py()
        length = len(source or b"")
        if slice_ and size + length > SLICE_BYTES:
            yield slice_
            slice_, size = [], 0
        slice_.append(source)
        size += length
    yield slice_


@F.arrow_udf(SHREDDED)
def shred_html(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Memory holds the nodes of one slice of pages, however many pages a batch has."""
    for html in batches:
        for pages in page_slices(html):
            yield shred_pages(pages)


def shred_pages(pages: list[bytes | None]) -> pa.Array:
    texts, node_offsets = [], [0]
    columns = {f.name: [] for f in NODE}
    class_offsets, class_items = [0], []
    attr_offsets, attr_keys, attr_values = [0], [], []
    for source in pages:
        if source is None:
            texts.append(None)
            node_offsets.append(node_offsets[-1])
            continue
        page = page_nodes(source.decode("utf-8", "replace"))
        count = len(page.tag)
        texts.append(b"".join(page.chunks))
        node_offsets.append(node_offsets[-1] + count)
        columns["pre"].extend(range(count))
        for name in ("last", "parent", "depth", "tag", "text_start", "text_len"):
            columns[name].extend(getattr(page, name))
        for attrs in page.attrs:
            columns["id_attr"].append(attrs.get("id"))
            class_items.extend(class_names(attrs.get("class", "")))
            class_offsets.append(len(class_items))
            attr_keys.extend(attrs.keys())
            attr_values.extend(attrs.values())
            attr_offsets.append(len(attr_keys))
    int32, string = pa.int32(), pa.string()
    arrays = {name: pa.array(values, string if name in ("tag", "id_attr") else int32)
              for name, values in columns.items() if name not in ("classes", "attrs")}
    arrays["classes"] = pa.ListArray.from_arrays(pa.array(class_offsets, int32), pa.array(class_items, string))
    arrays["attrs"] = pa.MapArray.from_arrays(
        pa.array(attr_offsets, int32), pa.array(attr_keys, string), pa.array(attr_values, string))
    node_array = pa.StructArray.from_arrays([arrays[f.name] for f in NODE], names=[f.name for f in NODE])
    nodes = pa.ListArray.from_arrays(pa.array(node_offsets, int32), node_array)
    return pa.StructArray.from_arrays([pa.array(texts, pa.binary()), nodes], names=["text", "nodes"])


def shred(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the ``html`` column by ``text`` (bytes) and ``nodes``.

    Filter pages before, not after: a filter on the parsed columns moves below them and parses
    each page a second time.  For several extractions over the same pages, write the result as a
    table once and read that.
    """
    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, shred_html(F.col(html)).alias("_dom")).select(
        *rest, F.col("_dom.text").alias("text"), F.col("_dom.nodes").alias("nodes"))


def slice_text(text: Column, node: Column) -> Column:
    """Text of a node: a byte slice, so the cost follows the slice and not the page."""
    return F.substring(text, node["text_start"] + 1, node["text_len"]).cast("string")


def node_rows(shredded: DataFrame, *keep: str) -> DataFrame:
    """One row per element, in the columns of ``NODE``."""
    return shredded.select(*keep, F.inline("nodes"))


def register_dom_nodes(spark, name: str = "shred_html") -> None:
    """UDF-2: pages to elements in SQL.

    ``select n.tag, substring(d.text, n.text_start + 1, n.text_len) from (select shred_html(html) as d from pages)
    lateral view inline(d.nodes) n ...`` parses each page once per row batch; elements and texts are JVM work.
    """
    spark.udf.register(name, shred_html)

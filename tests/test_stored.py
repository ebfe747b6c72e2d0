"""Written tables: elements by page, views of the catalog, headers of very many keys, deep pages."""

import pytest
from pyspark.sql import functions as F

from webloom.dom.css import descendant_pairs, match_rows
from webloom.dom.node_table import children, containment, whole_buckets, write_nodes
from webloom.dom.shred import shred
from webloom.operators.paging import read_page, write_pages
from webloom.operators.records import header, long_layout, widen
from webloom.operators.views import create_stored_view, list_catalog, publish, typed_literal


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def bucketed(spark):
    with whole_buckets(spark):
        yield


# -- elements --------------------------------------------------------------------

def test_relations_of_a_node_table(spark, rows, bucketed):
    nested = "<div class=c>" * 30 + "<p>x</p>" + "</div>" * 30
    html = [nested, "<div class=c><ul><li><p>a</p></li></ul><p>b</p></div><p>out</p><div class=c></div>", "<p>only</p>", "", None] * 3
    pages = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id long, html string")
    shredded = shred(pages)
    table = write_nodes(shredded, "stored_nodes", buckets=4)
    try:
        outer, inner = (F.col("tag") == "div") & F.array_contains("classes", "c"), F.col("tag") == "p"
        found = containment(table, outer, inner)
        assert rows(found) == rows(descendant_pairs(shredded, "div.c", "p", "page_id"), "page_id", "outer_pre", "pre", "content")
        below = children(table, F.col("tag") == "li", inner)
        assert rows(below, "page_id", "pre", "content") == rows(match_rows(shredded, "li > p", "page_id"), "page_id", "pre", "content")
        for df in (found, below):
            assert "Exchange" not in plan(df) and "Bucketed: true" in plan(df)
        assert table.count() == shredded.select(F.sum(F.size("nodes"))).first()[0]
    finally:
        spark.sql("drop table stored_nodes")


def test_a_page_of_many_elements(spark, bucketed, tmp_path):
    n = 300_000
    nodes = spark.range(1, n).select(F.lit(1).alias("page_id"), F.col("id").cast("int").alias("pre"), F.col("id").cast("int").alias("last"), F.lit("p").alias("tag"),
                                     F.lit("x").alias("content"))
    root = spark.createDataFrame([(1, 0, n - 1, "div", ""), (2, 0, 0, "div", "")], nodes.schema)
    found = containment(nodes.union(root).coalesce(1), F.col("tag") == "div", F.col("tag") == "p")
    assert found.agg(F.count("*"), F.sum("pre")).first()[:] == (n - 1, n * (n - 1) // 2)


# -- catalog ---------------------------------------------------------------------

def test_a_view_survives_its_session(spark, rows, tmp_path):
    odd = "it's `x`\\'; drop table t --"
    frame = spark.createDataFrame([(1, "a", odd), (2, "b", "plain"), (3, "a", "ünïcode")], "workflow_id long, user string, `od``d` string")
    publish(frame, "stored_runs", str(tmp_path / "runs"))
    try:
        assert create_stored_view(spark, "stored_runs", "zeta", "2") == "zeta_view"
        other = spark.newSession()
        assert rows(other.table("zeta_view")) == [(2, "b", "plain")]
        create_stored_view(other, "stored_runs", "zeta", odd, "od`d", ["workflow_id"])      # replaced, from the other session
        assert rows(spark.table("zeta_view")) == [(1,)]
        create_stored_view(spark, "stored_runs", "zeta", "no number")
        assert rows(spark.table("zeta_view")) == []
        names = {r.name for r in list_catalog(other).filter("kind = 'table'").collect()}
        assert {"stored_runs", "zeta_view"} <= names
        assert "PushedFilters: [IsNotNull(workflow_id), EqualTo(workflow_id,2)]" in plan(spark.table(create_stored_view(spark, "stored_runs", "zeta", 2)))
        for bad in ("a b", "x;y", ""):
            with pytest.raises(ValueError):
                create_stored_view(spark, "stored_runs", f"{bad}-", 1)
    finally:
        spark.sql("drop view if exists zeta_view")
        spark.sql("drop table stored_runs")


@pytest.mark.parametrize("value,kind", [("x'y\\", "string"), (5, "int"), (None, "date"), ("2024-02-29", "date"), ("1.50", "decimal(5,2)"), ("x", "int")])
def test_typed_literals(spark, value, kind):
    expected = spark.range(1).select(F.lit(None if value is None else str(value)).try_cast(kind)).first()[0]
    assert spark.sql(f"select {typed_literal(value, kind)}").first()[0] == expected


# -- headers ---------------------------------------------------------------------

def test_header_of_odd_keys(spark, rows):
    data = [(1, {"b": "1", "a b": None, "x.y": "2", "`q`": "3", "Ü,<:>": "4"}), (2, {}), (3, None), (4, {"b": "5", "B": "6", "": "7"})]
    frame = spark.createDataFrame(data, "id int, r map<string,string>")
    keys = sorted({k for _, r in data for k in r or {}})
    assert header(frame, "r") == keys
    assert header(frame.filter("id = 3"), "r") == header(frame.filter("id = 2"), "r") == []
    long = long_layout(frame, "r", "id")
    assert rows(long) == sorted(((i, k, v) for i, r in data for k, v in (r or {}).items()), key=repr)
    assert rows(widen(frame.filter("id = 1"), "r"), "b", "`a b`") == [("1", None)]


def test_header_of_a_hundred_thousand_keys(spark):
    n = 100_000
    frame = spark.range(n).select("id", F.create_map(F.concat(F.lit("k"), "id"), F.lit("v"), F.lit("all"), F.lit("w")).alias("r"))
    assert header(frame, "r") == sorted([f"k{i}" for i in range(n)] + ["all"])
    assert long_layout(frame, "r", "id").count() == 2 * n


# -- deep pages ------------------------------------------------------------------

def test_deep_pages(spark, rows, tmp_path):
    n, size, path = 200_000, 7, str(tmp_path / "pages")
    frame = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), (F.col("id") % 3).alias("g"), F.lit("x").alias("v"))
    order = ["g", "k"]
    write_pages(frame, order, path, size, tasks=16)
    plain = [tuple(r) for r in frame.orderBy(*order).select("g", "k").collect()]
    for number in (1, 2, 1000, 14_000, 28_571, 28_572, 30_000):
        page = read_page(spark, path, order, number, size)
        assert [tuple(r) for r in page.select("g", "k").collect()] == plain[(number - 1) * size:number * size]
    deep = read_page(spark, path, order, 20_000, size)
    assert deep.columns == frame.columns and "PartitionFilters: [" in plan(deep)
    directory = spark.read.parquet(f"{path}/directory").collect()
    assert len(directory) <= 16 and sum(r["rows"] for r in directory) == n
    with pytest.raises(ValueError):
        read_page(spark, path, order, 0)


def test_documents_of_a_stretch_of_months(spark, rows, tmp_path):
    import datetime as dt

    from webloom.sinks.tables import append_documents, compact_months, read_between

    data = [(f"u{i}", "c", dt.datetime(2020 + i // 12, i % 12 + 1, 15)) for i in range(60)]
    frame = spark.createDataFrame(data, "url string, content string, scraped_at timestamp_ntz")
    loose, path = str(tmp_path / "loose"), str(tmp_path / "months")
    append_documents(frame.repartition(6), loose)
    compact_months(spark, loose, path)
    assert rows(read_between(spark, loose)) == rows(read_between(spark, path)) == rows(frame)
    assert len(spark.read.parquet(path).inputFiles()) <= len(spark.read.parquet(loose).inputFiles())
    some = read_between(spark, path, "2021-02-01", "2022-03-01")
    assert rows(some) == rows(frame.filter("scraped_at >= '2021-02-01' and scraped_at < '2022-03-01'")) and "PartitionFilters: [isnotnull(scraped_month" in plan(some)

"""Registered queries: one Spark plan and, where SQL can say it, one independent SQL text each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.dom.shred import shred
from webloom.sources.tables import read_pages, read_table, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

def query(name: str, sql: str | None = None):
    """Register a query under its name; ``sql`` is its check on the same tables."""
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for CPU-heavy rows: a file too small to give every core a split is spread over them."""
    return spread(table(spark, sf_dir, name), spark.sparkContext.defaultParallelism)


def shredded_pages(spark: SparkSession, sf_dir: str, edited=None) -> DataFrame:
    """The given pages, parsed; ``edited`` is an expression for the html to parse instead."""
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    if edited is not None:
        pages = pages.withColumn("html", edited)
    return shred(spread(pages, spark.sparkContext.defaultParallelism))

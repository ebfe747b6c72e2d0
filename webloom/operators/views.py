"""Filtered views, row-level rules and catalog listing (PRJ-6, PRJ-7, SQL-1, SQL-2, SQL-3)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*$")


def workflow_rows(df: DataFrame, workflow_id, column: str = "workflow_id") -> DataFrame:
    """PRJ-6: the rows of one workflow.

    The value is cast to the column's type, so the filter reaches the scan; a value that is no
    such type matches nothing.
    """
    kind = df.schema[column].dataType.simpleString()
    return df.filter(F.col(column) == F.lit(str(workflow_id)).try_cast(kind))


def create_view(df: DataFrame, user_id: str, workflow_id, column: str = "workflow_id") -> str:
    """SQL-1: create or replace ``<user>_view`` over one workflow and return its name."""
    name = f"{user_id}_view"
    if not NAME.match(name):
        raise ValueError(f"not a view name: {name!r}")
    workflow_rows(df, workflow_id, column).createOrReplaceTempView(name)
    if not view_exists(df.sparkSession, name):
        raise RuntimeError(f"view {name} was not created")
    return name


def publish(df: DataFrame, name: str, path: str) -> DataFrame:
    """SQL-1: write rows as a table of the catalog, for views and sessions beside this one."""
    _checked(name)
    df.write.mode("overwrite").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def typed_literal(value, kind: str) -> str:
    """A value as SQL text of the given type. The text holds hexadecimal digits only, so no value can end it."""
    if value is None:
        return f"cast(null as {kind})"
    return f"try_cast(decode(unhex('{str(value).encode().hex()}'), 'utf-8') as {kind})"


def create_stored_view(spark: SparkSession, table: str, user_id: str, workflow_id, column: str = "workflow_id",
                       columns: list[str] | None = None) -> str:
    """SQL-1: create or replace the view ``<user>_view`` in the catalog, over one workflow of a table, and return its name.

    The view stays for other sessions; the value is compared as the column's type.
    """
    name = _checked(f"{user_id}_view")
    stored = spark.table(_checked(table))
    kind = stored.schema[column].dataType.simpleString()
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    picked = ", ".join(quoted(c) for c in columns or stored.columns)
    spark.sql(f"create or replace view {name} as select {picked} from {table} where {quoted(column)} = {typed_literal(workflow_id, kind)}")
    if not view_exists(spark, name):
        raise RuntimeError(f"view {name} was not created")
    return name


def _checked(name: str) -> str:
    if not NAME.match(name):
        raise ValueError(f"not a table or view name: {name!r}")
    return name


def view_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def visible_rows(df: DataFrame, policies: DataFrame, dataset: str, user: str, column: str) -> DataFrame:
    """PRJ-7: the rows a user may see: ``column`` among the policy values of (dataset, user).

    ``policies(dataset, user_id, value)``; a value that is none of the column's type allows nothing.  A semi join; Spark broadcasts the policy side only
    while its measured size is under the session's limit.
    """
    allowed = policies.filter((F.col("dataset") == dataset) & (F.col("user_id") == user)).select(
        F.col("value").try_cast(df.schema[column].dataType).alias(column)).dropna().distinct()
    return df.join(allowed, column, "left_semi")


def list_catalog(spark: SparkSession) -> DataFrame:
    """SQL-2: catalogs, schemas of the current catalog and tables of the current schema."""
    rows = [("catalog", c.name) for c in spark.catalog.listCatalogs()]
    rows += [("schema", d.name) for d in spark.catalog.listDatabases()]
    rows += [("table", t.name) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "kind string, name string")


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None, args=None) -> DataFrame:
    """SQL-3: SQL text over registered tables; values go in as named arguments, never as text."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args)

"""Table, file and schema-table scans (SRC-5 to SRC-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Type names of declared schemas.
DECLARED_TYPES = {"bigint": T.LongType(), "integer": T.IntegerType(), "double": T.DoubleType(),
                  "boolean": T.BooleanType(), "varchar": T.StringType(), "timestamp": T.TimestampType()}
FORM_SCHEMA = "website string, form struct<fields:array<string>,actions:array<string>>, html string"


def read_table(spark: SparkSession, location: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """SRC-5: a document table by format and options."""
    return spark.read.format(fmt).options(**options).load(location)


def stream_table(spark: SparkSession, folder: str, schema, fmt: str = "parquet", files_per_batch: int | None = None,
                 **options: str) -> DataFrame:
    """A folder that grows, as a stream."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: a JSON array document of form examples."""
    return spark.read.schema(FORM_SCHEMA).option("multiLine", True).json(path)


def explode_forms(forms: DataFrame, part: str) -> DataFrame:
    """SCL-16: website by field (``part="fields"``) or by action (``part="actions"``)."""
    return forms.select("website", F.explode(f"form.{part}").alias(part.rstrip("s")))


def read_pages(spark: SparkSession, location: str, fmt: str = "parquet") -> DataFrame:
    """SRC-7: the page corpus; html reaches a plan only if it is used."""
    return read_table(spark, location, fmt).select("page_id", "url", "html")


def spread(df: DataFrame, tasks: int) -> DataFrame:
    """At least ``tasks`` partitions for CPU-heavy work; large scans have them already and are left alone."""
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def _declared_type(name: str) -> T.DataType:
    name = name.strip().lower()
    if name not in DECLARED_TYPES:
        raise ValueError(f"unknown declared type: {name!r}")
    return DECLARED_TYPES[name]


def declared_schema(schemas: DataFrame, table: str, hidden: bool = False) -> T.StructType:
    """SRC-8: the schema of one table from a schema table ``(table, fields[name, type, hidden])``.

    One row, a schema, comes to the driver.
    """
    row = schemas.filter(F.col("table") == table).select("fields").first()
    if row is None:
        raise ValueError(f"no schema for table {table!r}")
    return T.StructType([T.StructField(f["name"], _declared_type(f["type"]))
                         for f in row["fields"] if hidden or not f["hidden"]])


def apply_schema(documents: DataFrame, value: str, schema: T.StructType) -> DataFrame:
    """SRC-8: JSON documents in the declared columns."""
    return documents.select(F.from_json(value, schema).alias("_d")).select("_d.*")



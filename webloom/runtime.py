"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# What the library counts on: of repeated JSON keys the last one counts, an Arrow batch of pages stays small, and
# data sources written in Python are asked for filters.
SETTINGS = {"spark.sql.variant.allowDuplicateKeys": "true",
            "spark.sql.python.filterPushdown.enabled": "true",
            "spark.sql.execution.arrow.maxBytesPerBatch": str(32 * 1024 * 1024)}


def configure(spark: SparkSession) -> SparkSession:
    """Apply ``SETTINGS``; an application calls this once, when it has its session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; on a cluster that would be another disk on
    every machine, so it is an error there.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="webloom-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def working_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, owned by this application."""
    return f"{shared_folder(spark)}/webloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Remove all tables this application wrote for itself; frames that read them are no use after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/webloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from there.

    The rows are fixed, a lost executor costs no recomputation, and later steps read only the
    columns they use.
    """
    path = working_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

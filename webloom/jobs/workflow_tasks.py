"""spark-submit job: the task topics of all users, routed to one collection per task type."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from webloom.operators.records import wrap_transformed
from webloom.runtime import configure
from webloom.sources.kafka import workflow_stream
from webloom.streaming.route import Routes, decode_tasks
from webloom.streaming.run import routed_sink, start_batches


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser()
    parser.add_argument("--kafka_brokers", required=True)
    parser.add_argument("--collections", required=True, help="folder of the stored collections")
    parser.add_argument("--checkpoint", required=True, help="folder that keeps the offsets")
    return parser.parse_args(argv)


def default_routes() -> Routes:
    """Transform messages are wrapped, store messages kept as they came."""
    def transformed(rows: DataFrame) -> DataFrame:
        return rows.select("route", wrap_transformed(F.col("raw")).alias("document"))

    def stored(rows: DataFrame) -> DataFrame:
        return rows.select("route", F.col("raw").alias("document"))

    return Routes({"transform": transformed, "store": stored})


def main() -> None:
    args = arguments()
    spark = configure(SparkSession.builder.appName("workflow-tasks").getOrCreate())
    tasks = decode_tasks(workflow_stream(spark, args.kafka_brokers, starting="earliest"))
    start_batches(tasks, routed_sink(default_routes(), args.collections), args.checkpoint).awaitTermination()


if __name__ == "__main__":
    main()

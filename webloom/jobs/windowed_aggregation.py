"""spark-submit job: windowed aggregates from one topic to another.

    spark-submit --packages org.apache.spark:spark-sql-kafka-0-10_2.13:4.1.2 \\
      webloom/jobs/windowed_aggregation.py --input_topic events --output_topic windows \\
      --aggregation_fields '{"task": "count", "price": "avg"}' --kafka_brokers broker:9092 \\
      --checkpoint /shared/windows --dead_letters /shared/dead
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from webloom.runtime import configure
from webloom.sources.kafka import event_stream
from webloom.streaming.run import start
from webloom.streaming.windowed import (
    DELAY, SLIDE, WINDOW, as_messages, dead_letters, decode_events, split_timeless, windowed_aggregate,
)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser()
    parser.add_argument("--input_topic", required=True)
    parser.add_argument("--output_topic", required=True)
    parser.add_argument("--aggregation_fields", required=True, type=json.loads, help='JSON, field to "count" or "avg"')
    parser.add_argument("--time_window", default=WINDOW)
    parser.add_argument("--slide_interval", default=SLIDE)
    parser.add_argument("--watermark", default=DELAY)
    parser.add_argument("--kafka_brokers", required=True)
    parser.add_argument("--checkpoint", required=True, help="folder that keeps offsets and window state")
    parser.add_argument("--dead_letters", required=True, help="folder for messages that are unreadable or have no time")
    return parser.parse_args(argv)


def window_messages(messages: DataFrame, args: argparse.Namespace) -> DataFrame:
    """Message text in, window messages out; what falls in no window is in ``dead_letters``."""
    timed, _ = split_timeless(decode_events(messages))
    return as_messages(windowed_aggregate(timed, args.aggregation_fields, args.time_window, args.slide_interval,
                                          args.watermark))


def main() -> None:
    args = arguments()
    spark = configure(SparkSession.builder.appName("windowed-aggregation").getOrCreate())
    messages = event_stream(spark, args.kafka_brokers, args.input_topic)
    start(window_messages(messages, args), "kafka", f"{args.checkpoint}/windows", "update", options={
        "kafka.bootstrap.servers": args.kafka_brokers, "topic": args.output_topic})
    start(dead_letters(messages), "parquet", f"{args.checkpoint}/dead_letters", options={"path": args.dead_letters})
    spark.streams.awaitAnyTermination()


if __name__ == "__main__":
    main()

"""Message-log scans (SRC-1 to SRC-4).

The Kafka connector is a separate jar (``org.apache.spark:spark-sql-kafka-0-10``), added at
deployment; nothing else in the package depends on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from webloom.functions.text import topic_name


def event_stream(spark: SparkSession, brokers: str, topic: str, starting: str = "latest") -> DataFrame:
    """SRC-1 / SRC-4: a topic as text; ``starting="earliest"`` reads it from its beginning.

    Offsets are kept in the query's checkpoint, which takes the place of consumer groups.
    """
    return _as_text(spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers)
                    .option("subscribe", topic).option("startingOffsets", starting).load())


def workflow_stream(spark: SparkSession, brokers: str, prefix: str = "workflow", starting: str = "latest") -> DataFrame:
    """SRC-2: the topics of all users in one stream, with ``user_id`` from the topic name."""
    messages = _as_text(spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers)
                        .option("subscribePattern", f"{prefix}_.*").option("startingOffsets", starting).load())
    return messages.withColumn("user_id", user_of_topic(F.col("topic"), prefix))


def user_topic(user_id: str, prefix: str = "workflow") -> Column:
    return topic_name(prefix, F.lit(user_id))


def user_of_topic(topic: Column, prefix: str = "workflow") -> Column:
    return F.regexp_extract(topic, rf"^\Q{prefix}_\E(.*)$", 1)


def _as_text(messages: DataFrame) -> DataFrame:
    return messages.select("topic", F.col("value").cast("string").alias("value"))

"""Message payloads (SNK-2, SNK-3) and message-log writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from webloom.operators.records import flatten_json, flatten_struct, quoted_name


def _fixed_names(schema: T.StructType) -> bool:
    """Whether the dotted field names follow from the schema alone."""
    return all(not isinstance(f.dataType, (T.MapType, T.VariantType))
               and (not isinstance(f.dataType, T.StructType) or _fixed_names(f.dataType)) for f in schema)


def record_messages(records: DataFrame) -> DataFrame:
    """SNK-2: one flat JSON message per record, keys sorted, no message key; absent fields are left out."""
    if not _fixed_names(records.schema):
        return records.select(F.to_json(F.struct("*")).alias("json")).select(flatten_json("json").alias("value"))
    flat = flatten_struct(records)
    return flat.select(F.to_json(F.struct(*[F.col(quoted_name(c)) for c in sorted(flat.columns)])).alias("value"))


def envelope(task_type: Column, payload: Column) -> Column:
    """``{"payload": ..., "task_type": ...}``; the payload nests as it is, a string as a JSON string."""
    return F.to_json(F.struct(payload.alias("payload"), task_type.alias("task_type")))


def task_messages(tasks: DataFrame, task_type: str = "task_type", payload: str = "payload",
                  keyed: bool = True, json_payload: bool = True) -> DataFrame:
    """SNK-3: enveloped messages, keyed by task type or without a key.

    With ``json_payload`` a text payload is JSON and nests as a value.
    """
    kind, content = F.col(task_type), F.col(payload)
    if json_payload and isinstance(tasks.schema[payload].dataType, T.StringType):
        content = F.parse_json(content)
    value = envelope(kind, content).alias("value")
    return tasks.select(kind.alias("key"), value) if keyed else tasks.select(value)


def write_kafka(messages: DataFrame, brokers: str, topic: str) -> None:
    """Batch write to a topic (needs the Kafka connector)."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic).save()

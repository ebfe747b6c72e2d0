"""Messages, windows, routes and metrics over the event table (PRJ, AGG-1 to 5, SNK payloads)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators.metrics import BUCKETS, bucket_name, duration_histogram, processed_count
from webloom.operators.records import wrap_transformed
from webloom.plans.registry import query, table, wide_table
from webloom.sinks.messages import record_messages, task_messages
from webloom.streaming.route import Routes, decode_tasks, transform_tasks, with_route, with_status
from webloom.streaming.windowed import (
    as_messages, decode_events, split_timeless, windowed_aggregate,
)


def event_messages(events):
    """Events as JSON messages of the window job: task id, payload map, time."""
    payload = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("kind"), F.col("event_type"))
    row = F.struct(F.col("event_type").alias("task_id"), payload.alias("payload"), F.col("ts").alias("timestamp"))
    return events.select(F.to_json(row, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("value"))


def window_events(events):
    """The decoded form of the same events, without the trip through JSON text."""
    payload = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"))
    return events.select(F.col("event_type").alias("task_id"), payload.alias("payload"), F.col("ts").alias("timestamp"))


def task_rows(events):
    """Events as task messages: odd kinds travel as plain ``task`` with the type inside the payload."""
    kind = (F.when(F.col("event_type") == "click", "transform").when(F.col("event_type") == "view", "store")
            .when(F.col("event_type") == "signup", "task").otherwise(F.col("event_type")))
    payload = F.concat(F.lit('{"task_type":"store","k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return events.select("event_id", kind.alias("task_type"), payload.alias("payload"))


def task_messages_of(events):
    return task_messages(task_rows(events).drop("event_id"), keyed=False)


WINDOWED = """
with parts as (
  select time_bucket(interval 5 minutes, ts) - to_minutes(5 * o) as window_start, (props->>'k')::double as k
  from events, (values (0), (1)) v(o))
select window_start, window_start + interval 10 minutes as window_end, count(*) as task_count, avg(k) as k_avg
from parts group by 1
"""


@query("agg1_agg2_sliding_window", WINDOWED)
def sliding_window(spark, sf_dir):
    """The configured aggregate, from decoded events, default window and slide."""
    result = windowed_aggregate(window_events(table(spark, sf_dir, "events")), {"task": "count", "k": "avg"})
    return result.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                         "task_count", "k_avg")


@query("str2_tumbling_window", """
select time_bucket(interval 1 hour, ts) as window_start, count(*) as task_count,
       avg((props->>'k')::double) as k_avg
from events group by 1
""")
def tumbling_window(spark, sf_dir):
    result = windowed_aggregate(window_events(table(spark, sf_dir, "events")), {"task": "count", "k": "avg"},
                                window="1 hour", slide="1 hour")
    return result.select(F.col("window.start").alias("window_start"), "task_count", "k_avg")


@query("agg2_avg_of_text", """
with parts as (
  select time_bucket(interval 5 minutes, ts) - to_minutes(5 * o) as window_start,
    case when event_type not in ('click', 'view') then (props->>'k')::double end as k
  from events, (values (0), (1)) v(o))
select window_start, avg(k) as kind_avg, count(*) as any_count from parts group by 1
""")
def avg_of_text(spark, sf_dir):
    """Values that are no numbers are skipped; ``count`` counts rows whatever the field."""
    k = F.get_json_object("props", "$.k")
    kind = F.when(F.col("event_type") == "click", "many").when(F.col("event_type") == "view", "").otherwise(k)
    row = F.struct(F.col("event_type").alias("task_id"), F.create_map(F.lit("kind"), kind).alias("payload"), F.col("ts").alias("timestamp"))
    messages = wide_table(spark, sf_dir, "events").select(F.to_json(row, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("value"))
    result = windowed_aggregate(decode_events(messages), {"kind": "avg", "any": "count"})
    return result.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "kind_avg", "any_count")


@query("snk1_window_messages", """
with parts as (
  select time_bucket(interval 5 minutes, ts) - to_minutes(5 * o) as w from events, (values (0), (1)) v(o)),
agg as (select w, count(*) as n from parts group by 1)
select '{' || strftime(w, '%Y-%m-%d %H:%M:%S') || ', ' || strftime(w + interval 10 minutes, '%Y-%m-%d %H:%M:%S') || '}'
         as key,
       '{"window":{"start":"' || strftime(w, '%Y-%m-%dT%H:%M:%S.000') || '","end":"'
         || strftime(w + interval 10 minutes, '%Y-%m-%dT%H:%M:%S.000') || '"},"task_count":' || n || '}' as value
from agg
""")
def window_messages(spark, sf_dir):
    return as_messages(windowed_aggregate(window_events(table(spark, sf_dir, "events")), {"task": "count"}))


@query("prj1_decode_events", """
select event_type as task_id, props->>'k' as k, ts as timestamp from events
""")
def decode(spark, sf_dir):
    events = decode_events(event_messages(wide_table(spark, sf_dir, "events")))
    return events.select("task_id", F.col("payload.k").alias("k"), F.col("timestamp").cast("timestamp_ntz").alias(
        "timestamp"))


@query("prj1_decode_props", "select event_id, (props->>'k')::bigint as k from events")
def decode_props(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.from_json("props", "k bigint").alias("d")).select("event_id", "d.k")


@query("str6_timeless_events", """
select case when event_type = 'error' then 'dead' else 'timed' end as status, count(*) as n from events group by 1
""")
def timeless(spark, sf_dir):
    events = window_events(table(spark, sf_dir, "events")).withColumn(
        "timestamp", F.when(F.col("task_id") != "error", F.col("timestamp")))
    timed, dead = split_timeless(events)
    both = timed.select(F.lit("timed").alias("status")).union(dead.select(F.lit("dead")))
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


TASKS = """
with tasks as (
  select event_id, case event_type when 'click' then 'transform' when 'view' then 'store' when 'signup' then 'task'
                   else event_type end as task_type,
         '{"k":' || (props->>'k') || ',"task_type":"store"}' as payload
  from events)
"""


@query("prj2_prj4_transform_tasks", TASKS + """
select task_type, payload, payload as processed_payload from tasks where task_type = 'transform'
""")
def transform(spark, sf_dir):
    tasks = decode_tasks(task_messages_of(wide_table(spark, sf_dir, "events")))
    return transform_tasks(tasks).select("task_type", "payload", "processed_payload")


@query("prj3_routes", TASKS + """
, routed as (select case when task_type in ('transform', 'store') then task_type
                         when task_type = 'task' then 'store' else 'unrouted' end as route, payload from tasks)
select route, count(*) as n, sum((payload->>'k')::bigint)::bigint as k_sum from routed group by route
""")
def routes(spark, sf_dir):
    tasks = with_route(decode_tasks(task_messages_of(wide_table(spark, sf_dir, "events"))), ["transform", "store"])
    k = F.get_json_object("payload", "$.k").cast("bigint")
    return tasks.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"))


@query("udf1_route_handlers", TASKS + """
select 'transform' as route, payload from tasks where task_type = 'transform'
union all select 'store', upper(payload) from tasks where task_type in ('store', 'task')
union all select 'unrouted', payload from tasks where task_type not in ('transform', 'store', 'task')
""")
def route_handlers(spark, sf_dir):
    registry = Routes({"transform": lambda rows: rows})
    registry.register("store", lambda rows: rows.withColumn("payload", F.upper("payload")))
    handled = registry.apply(decode_tasks(task_messages_of(wide_table(spark, sf_dir, "events"))))
    parts = [rows.select("route", "payload") for rows in handled.values()]
    return parts[0].union(parts[1]).union(parts[2])


RAW = """
with raw as (
  select props as value from events union all select text from conversations
  union all select '[' || event_id || ']' from events
  union all select '{"k":' || event_id || ',"k":' || user_id || '}' from events)
"""


def raw_messages(spark, sf_dir):
    events, talk = table(spark, sf_dir, "events"), table(spark, sf_dir, "conversations")
    arrays = events.select(F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]")).alias("value"))
    number = lambda c: F.col(c).cast("string")
    repeated = events.select(F.concat(F.lit('{"k":'), number("event_id"), F.lit(',"k":'), number("user_id"), F.lit("}")).alias("value"))
    return events.select(F.col("props").alias("value")).union(talk.select("text")).union(arrays).union(repeated)


@query("prj5_malformed_messages", RAW + """
select case when json_valid(value) and json_type(value) = 'OBJECT' then 'readable' else 'dead' end as status,
       md5(value) as value_md5 from raw
""")
def malformed(spark, sf_dir):
    return with_status(raw_messages(spark, sf_dir)).select("status", F.md5("value").alias("value_md5"))


@query("prj12_wrap_transformed", """
select event_id, '{"transformed":"{\\"k\\": ' || (props->>'k') || '}"}' as document from events
""")
def wrap(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", wrap_transformed(F.col("props")).alias("document"))


@query("snk2_record_messages", """
select '{"event_id":' || event_id || ',"event_type":"' || event_type || '","props.k":' || (props->>'k') || '}' as value
from events
""")
def flat_messages(spark, sf_dir):
    records = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.from_json("props", "k bigint").alias("props"))
    return record_messages(records)


@query("snk3_enveloped_messages", TASKS + """
select task_type as key, '{"payload":' || payload || ',"task_type":"' || task_type || '"}' as value
from tasks
""")
def enveloped(spark, sf_dir):
    return task_messages(task_rows(table(spark, sf_dir, "events")))


@query("agg4_processed_count", TASKS + """
select task_type, count(*) as processed from tasks where (payload->>'k')::int >= 10 group by task_type
""")
def processed(spark, sf_dir):
    tasks = decode_tasks(task_messages_of(wide_table(spark, sf_dir, "events")))
    return processed_count(tasks, succeeded=F.get_json_object("payload", "$.k").cast("int") >= 10)


@query("agg5_duration_histogram", "select event_type, " + ", ".join(
    f"count(*) filter (value / 10 <= {b}) as {bucket_name(b)}" for b in BUCKETS) + """,
  count(*) as le_inf, sum((value / 10)::decimal(18, 3))::double as duration_sum, count(*) as duration_count
from events group by event_type
""")
def histogram(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_type", (F.col("value") / 10).alias("_d"),
        (F.col("value") / 10).cast("decimal(18,3)").alias("duration"))
    return duration_histogram(events, "duration", "event_type").withColumn(
        "duration_sum", F.col("duration_sum").cast("double"))

"""Streams over the given tables: each file query runs to the end of its input and is read back as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators.dedup import distinct_on
from webloom.operators.metrics import processed_count
from webloom.plans.credits import LEDGER
from webloom.plans.extraction import FACTS
from webloom.plans.messages import TASKS, WINDOWED, task_messages_of, window_events
from webloom.plans.registry import query, table
from webloom.runtime import working_path
from webloom.sources.folder_log import append_messages, log_stream
from webloom.sources.tables import stream_table
from webloom.streaming.crawl import page_messages
from webloom.streaming.generations import Folder, IdStore, once_sink, upsert_table
from webloom.streaming.keyed_ledger import keyed_ledger
from webloom.streaming.ledger import current_balances, ledger_sink, once_per_event
from webloom.streaming.route import Routes, decode_tasks, transform_tasks
from webloom.streaming.run import consume, latest_rows, routed_sink, start, start_batches, table_sink
from webloom.streaming.steps import in_steps, time_part
from webloom.streaming.windowed import windowed_aggregate


def stream_of(spark, sf_dir, name):
    """A given table, a folder of files or one file, as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    if Folder(spark, f"{sf_dir}/{name}.parquet").exists():
        return stream_table(spark, f"{sf_dir}/{name}.parquet", schema)
    return stream_table(spark, sf_dir, schema, pathGlobFilter=f"{name}.parquet")


def timed(events):
    """Event time must be an instant for a watermark."""
    return events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def run_to_table(result, label, mode="append"):
    """Run a stream until its input is used up, batch by batch into a table; returns the table path."""
    path = working_path(result.sparkSession, label)
    start_batches(result, table_sink(f"{path}/rows"), f"{path}/checkpoint", mode, once=True).awaitTermination()
    return f"{path}/rows"


@query("str3_stream_window_updates", WINDOWED)
def window_updates(spark, sf_dir):
    """SRC-1, STR-1 to 3: update-mode windows; the table keeps the latest row of each window."""
    result = windowed_aggregate(timed(window_events(stream_of(spark, sf_dir, "events"))), {"task": "count", "k": "avg"})
    path = run_to_table(result, "windows", "update")
    rows = latest_rows(spark.read.parquet(path), ["window"])
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                       F.col("window.end").cast("timestamp_ntz").alias("window_end"), "task_count", "k_avg")


@query("str1_stream_closed_windows", "with w as (" + WINDOWED + """)
select window_start, task_count, k_avg from w
where window_end <= (select time_bucket(interval 1 millisecond, max(ts)) - interval 5 minutes from events)
""")
def closed_windows(spark, sf_dir):
    """STR-1: append mode gives a window once the watermark, five minutes behind, has passed its end."""
    result = windowed_aggregate(timed(window_events(stream_of(spark, sf_dir, "events"))), {"task": "count", "k": "avg"})
    path = run_to_table(result, "closed")
    return spark.read.parquet(path).select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"), "task_count", "k_avg")


@query("str4_stream_pass_through", TASKS + "select task_type, payload from tasks where task_type = 'transform'")
def pass_through(spark, sf_dir):
    """SRC-2, PRJ-2, STR-4: stateless append of transform messages, through a file sink."""
    tasks = transform_tasks(decode_tasks(task_messages_of(stream_of(spark, sf_dir, "events"))))
    path = working_path(spark, "transform")
    start(tasks.select("task_type", "payload"), "parquet", f"{path}/checkpoint", once=True,
          options={"path": f"{path}/rows"}).awaitTermination()
    return spark.read.parquet(f"{path}/rows")


@query("src3_consumers", TASKS + """
select task_type, count(*) as n, sum((payload->>'k')::bigint)::bigint as k_sum from (
  select case when task_type = 'task' then 'store' else task_type end as task_type, payload from tasks
  where task_type in ('transform', 'store', 'task')) group by 1
""")
def consumers(spark, sf_dir):
    """SRC-3: one consumer per task type; what was queued as plain ``task`` goes by its inner type."""
    path = working_path(spark, "consumers")
    parts = []
    for task_type in ("transform", "store"):
        tasks = decode_tasks(task_messages_of(stream_of(spark, sf_dir, "events")))
        consume(tasks, task_type, lambda rows: rows.select("payload"), f"{path}/{task_type}", f"{path}/checkpoints", once=True).awaitTermination()
        parts.append(spark.read.parquet(f"{path}/{task_type}").select(F.lit(task_type).alias("task_type"), "payload"))
    k = F.get_json_object("payload", "$.k").cast("bigint")
    return parts[0].union(parts[1]).groupBy("task_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"))


@query("prj3_stream_routes", TASKS + """
select 'transform' as route, count(*) as n from tasks where task_type = 'transform'
union all select 'store', count(*) from tasks where task_type in ('store', 'task')
union all select 'unrouted', count(*) from tasks where task_type not in ('transform', 'store', 'task')
""")
def stream_routes(spark, sf_dir):
    """PRJ-3 and SNK-5: one stream, one collection per route."""
    path = working_path(spark, "routes")
    tasks = decode_tasks(task_messages_of(stream_of(spark, sf_dir, "events")))
    routes = Routes({"transform": lambda rows: rows, "store": lambda rows: rows})
    start_batches(tasks, routed_sink(routes, path), f"{path}/checkpoint", once=True).awaitTermination()
    parts = [spark.read.parquet(f"{path}/{name}").select("route") for name in ("transform", "store", "unrouted")]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("agg4_stream_processed_count", """
select event_type as task_type, count(*) as processed from events group by event_type
""")
def stream_counter(spark, sf_dir):
    counts = processed_count(stream_of(spark, sf_dir, "events"), "event_type")
    path = run_to_table(counts, "counter", "update")
    return latest_rows(spark.read.parquet(path), ["event_type"]).withColumnRenamed("event_type", "task_type")


@query("str8_stream_dedup", "select distinct user_id, event_type from events")
def stream_dedup(spark, sf_dir):
    """DDP-1 and DDP-3 on a stream: the watermark spans the table, so every repeat is caught."""
    events = timed(stream_of(spark, sf_dir, "events").select(
        "user_id", "event_type", F.col("ts").alias("timestamp")))
    unique = distinct_on(events, ["user_id", "event_type"], "timestamp", "400 days")
    return spark.read.parquet(run_to_table(unique.select("user_id", "event_type"), "unique")).select(
        "user_id", "event_type")


@query("str7_stream_ledger", LEDGER + """
select o_custkey, balances[-1] as balance from folded
""")
def stream_ledger(spark, sf_dir):
    """STR-7: balances after the whole stream of orders."""
    amount = F.when(F.col("o_orderstatus") == "F", F.floor(F.col("o_totalprice") / 100)).otherwise(
        -F.floor(F.col("o_totalprice") / 90)).cast("bigint")
    moves = stream_of(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", amount.alias("amount"))
    path = working_path(spark, "ledger")
    moves = once_per_event(moves.withColumn("at", F.col("o_orderdate").cast("timestamp")), "o_orderkey", "at", "8000 days")
    sink = ledger_sink(path, "o_custkey", ["o_orderdate", "o_orderkey"], "amount")
    start_batches(moves, sink, f"{path}/checkpoint", once=True).awaitTermination()
    return current_balances(spark, path, "o_custkey")


@query("ext14_stream_page_records", FACTS + """
, cells as (select page_id, unnest(links) as link from facts)
select '{"link":' || to_json(trim(link))::varchar || ',"page_id":' || page_id || '}' as value from cells
where link <> ''
""")
def stream_page_records(spark, sf_dir):
    """EXT-14, SRC-7, SNK-2: pages stream to flat record messages; every page is sent."""
    messages = page_messages(stream_of(spark, sf_dir, "pages").select("page_id", "html"), "nav li",
                             {"link": "a"}, "page_id")
    return spark.read.parquet(run_to_table(messages, "records")).select("value")


# -- several micro-batches -------------------------------------------------------
def _arrivals(rows, time, event_id, parts, late):
    """The part in which a row arrives: its part of the time span, and one in seven two parts later."""
    span = rows.agg(F.min(time).alias("low"), F.max(time).alias("high")).first()     # one row
    part = time_part(F.col(time), F.lit(span.low), F.lit(span.high), parts)
    return part + F.when(F.lit(late) & (F.col(event_id) % 7 == 0), 2).otherwise(0)


ARRIVED = """
with span as (select epoch_us(min(ts)) as low, epoch_us(max(ts)) as high from events),
arrived as (
  select event_id, ts, event_type, user_id, (props->>'k')::double as k,
         least(4, (epoch_us(ts) - low) * 5 // (high - low + 1)) + case when event_id % 7 = 0 then 2 else 0 end as part
  from events, span),
marks as (
  select p.part, (select time_bucket(interval 1 millisecond, max(ts)) - interval 5 minutes from arrived a where a.part < p.part) as mark
  from (select distinct part from arrived) p)
"""


@query("str5_late_rows", ARRIVED + """
, parts as (
  select time_bucket(interval 5 minutes, ts) - to_minutes(5 * o) as window_start, k, mark
  from arrived join marks using (part), (values (0), (1)) v(o))
select window_start, window_start + interval 10 minutes as window_end, count(*) as task_count, avg(k) as k_avg
from parts where mark is null or window_start + interval 10 minutes > mark group by 1
""")
def late_rows(spark, sf_dir):
    """STR-5, STR-3: events in seven parts, one in seven late; windows that the watermark has passed take none of them.

    The windows are merged by key as they change.
    """
    events = table(spark, sf_dir, "events")
    path = working_path(spark, "late")
    windows = upsert_table(spark, f"{path}/windows", ["window"], compact_every=3)

    def begin(stream):
        result = windowed_aggregate(timed(window_events(stream)), {"task": "count", "k": "avg"})
        return start_batches(result, windows.append, f"{path}/checkpoint", "update")

    in_steps(events, _arrivals(events, "ts", "event_id", 5, True), 7, path, begin)
    return windows.read().select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                                 F.col("window.end").cast("timestamp_ntz").alias("window_end"), "task_count", "k_avg")


@query("str8_exact_dedup", ARRIVED + """
select user_id, event_type, min_by(event_id, (part, ts, event_id)) as event_id from arrived group by user_id, event_type
""")
def exact_dedup(spark, sf_dir):
    """STR-8, DDP-3: the first arrival of each user and type, over all batches and without a watermark."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    path = working_path(spark, "once")
    store = IdStore(spark, f"{path}/ids", ["user_id", "event_type"], buckets=16, blocks=8, compact_every=3)
    sink = once_sink(store, ["ts", "event_id"], table_sink(f"{path}/rows"))
    in_steps(events, _arrivals(events, "ts", "event_id", 5, True), 7, path, lambda stream: start_batches(stream, sink, f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/rows").select("user_id", "event_type", "event_id")


@query("str7_keyed_ledger", LEDGER + """
select o_custkey, o_orderkey, amount, before + amount >= 0 as accepted, balance from entries
""")
def keyed_ledger_query(spark, sf_dir):
    """STR-7, DDP-3, WIN-3: orders in four parts, the first of them sent again with the third, through keyed state."""
    amount = F.when(F.col("o_orderstatus") == "F", F.floor(F.col("o_totalprice") / 100)).otherwise(
        -F.floor(F.col("o_totalprice") / 90)).cast("bigint")
    moves = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), amount.alias("amount"))
    part = _arrivals(moves, "at", "o_orderkey", 4, False)
    sent = moves.withColumn("part", part)
    sent = sent.union(sent.filter("part = 0").withColumn("part", F.lit(2)))
    path = working_path(spark, "keyed")

    def begin(stream):
        entries = keyed_ledger(stream.drop("part"), "o_custkey", "o_orderkey", "at", ["at", "o_orderkey"], "amount", "30 days")
        return start_batches(entries, table_sink(f"{path}/rows"), f"{path}/checkpoint")

    in_steps(sent, F.col("part"), 4, path, begin)
    return spark.read.parquet(f"{path}/rows").drop("batch_id")


@query("src4_offset_log", """
select event_type, count(*) as n, sum((props->>'k')::bigint)::bigint as k_sum, count(*) as offsets from events group by event_type
""")
def offset_log(spark, sf_dir):
    """SRC-3, SRC-4: events through a log of three partitions per topic, in two appends, read from the earliest offset and committed."""
    path = working_path(spark, "log")
    events = table(spark, sf_dir, "events")
    messages = events.select(F.col("event_type").alias("topic"), F.col("user_id").alias("key"), F.col("props").alias("value"), "event_id")
    query = None
    try:
        for half in (0, 1):
            append_messages(messages.filter(F.col("event_id") % 2 == half), f"{path}/log")
            query = query or start_batches(log_stream(spark, f"{path}/log", group="g"), table_sink(f"{path}/rows"), f"{path}/checkpoint")
            query.processAllAvailable()
    finally:
        if query:
            query.stop()
    k = F.get_json_object("value", "$.k").cast("bigint")
    return spark.read.parquet(f"{path}/rows").groupBy(F.col("topic").alias("event_type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.count_distinct("partition", "offset").alias("offsets"))

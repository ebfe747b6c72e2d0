"""Sources, sinks, views, pages, unions and de-duplication over the given tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from webloom.operators.dedup import distinct_on, first_content, keep_first
from webloom.operators.paging import (
    cap_pages, numbered_pages, page, page_after, page_count, preview, read_page, storage_order, write_pages,
)
from webloom.operators.records import (
    append_batches, credit_rules, map_fields, reject_reason, repair_pages, widen, workflow_rules,
)
from webloom.operators.sessions import collect_actions, sessions
from webloom.operators.views import create_stored_view, create_view, list_catalog, publish, run_sql, visible_rows, workflow_rows
from webloom.operators.workflow import fan_out, root_tasks, terminal_tasks
from webloom.plans.registry import query, table, wide_table
from webloom.runtime import cut, working_path
from webloom.sinks.tables import (
    action_logs, append_documents, append_long, document_rows, read_between, stamped, workflow_documents, write_action_logs,
    write_csv, write_workflows,
)
from webloom.sources.collections import read_collection, write_collection
from webloom.sources.generators import page_urls, seed_pool, topic_names
from webloom.sources.tables import apply_schema, declared_schema, explode_forms, read_forms, read_table


# -- sources -----------------------------------------------------------------
@query("src5_document_scan", """
select user_id as workflow_id, event_id as task_id, event_type as field1, (props->>'k') as field2 from events
""")
def document_scan(spark, sf_dir):
    tasks = read_table(spark, f"{sf_dir}/events.parquet", "parquet", mergeSchema="false").select(
        F.col("user_id").alias("workflow_id"), F.col("event_id").alias("task_id"),
        F.create_map(F.lit("field1"), "event_type", F.lit("field2"), F.get_json_object("props", "$.k")).alias("data"))
    return widen(tasks, "data", ["field1", "field2"])


@query("src6_form_examples", """
select n_name as website, field, 'go_' || n_regionkey as first_action
from (select n_name, n_regionkey, unnest(['name', 'key' || n_nationkey]) as field from nation)
""")
def form_examples(spark, sf_dir):
    """A JSON array document of forms, written from a table and read back."""
    number = lambda c: F.col(c).cast("string")
    form = F.struct(F.array(F.lit("name"), F.concat(F.lit("key"), number("n_nationkey"))).alias("fields"),
                    F.array(F.concat(F.lit("go_"), number("n_regionkey"))).alias("actions"))
    forms = table(spark, sf_dir, "nation").select(F.to_json(F.struct(F.col("n_name").alias("website"), form.alias("form"), F.lit("<form>").alias("html"))).alias("value"))
    path = working_path(spark, "forms")
    # one document per file: each partition becomes a JSON array
    lines = forms.groupBy(F.spark_partition_id()).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("value"), ",\n"), F.lit("\n]")).alias("value"))
    lines.select("value").write.text(path)
    read = read_forms(spark, path)
    return explode_forms(read, "fields").join(explode_forms(read, "actions"), "website").select("website", "field", F.col("action").alias("first_action"))


@query("src7_page_corpus", "select page_id, url, length(html)::int as html_chars from pages")
def page_corpus(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("html_chars"))


@query("src8_declared_schema", """
select event_id, (props->>'k')::bigint as k from events
""")
def declared(spark, sf_dir):
    """Columns, types and hidden fields come from a schema row; the documents are the event properties."""
    kinds = table(spark, sf_dir, "events").select(F.lit("tasks").alias("table"), F.array(
        F.struct(F.lit("k").alias("name"), F.lit("bigint").alias("type"), F.lit(False).alias("hidden")),
        F.struct(F.lit("_id").alias("name"), F.lit("varchar").alias("type"), F.lit(True).alias("hidden")),
        F.struct(F.lit("event_id").alias("name"), F.lit("bigint").alias("type"), F.lit(False).alias("hidden")),
    ).alias("fields"))
    schema = declared_schema(kinds, "tasks")
    document = F.concat(F.lit('{"_id":"x","event_id":'), F.col("event_id").cast("string"), F.lit(',"k":'),
                        F.get_json_object("props", "$.k"), F.lit("}"))
    return apply_schema(table(spark, sf_dir, "events").select(document.alias("d")), "d", schema)


@query("src9_page_urls", """
select p_partkey, page_no, p_name || '?page=' || page_no as page_url
from (select p_partkey, p_name, unnest(range(1, p_size - 9)) as page_no from part where p_size > 10)
""")
def page_urls_query(spark, sf_dir):
    """Sizes less ten stand for page counts, so some are zero or negative and give no rows."""
    specs = table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_size") - 10).alias("page_num"))
    return page_urls(specs, url="p_name").select("p_partkey", "page_no", "page_url")


TYPE_COUNTS = "with counts as (select event_type, count(*) as n from events group by 1)\n"


@query("src10_topic_names", TYPE_COUNTS + """
select event_type || '_' || i as topic_name, event_type as task_type
from (select event_type, unnest(range(1, n + 1)) as i from counts)
""")
def topic_names_query(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return topic_names(counts, "event_type")


@query("src11_pool_seed", """
select s_nationkey || '_' || i as topic_name, s_nationkey::varchar as task_type, false as assigned, '' as workflow_id
from (select s_nationkey, unnest(range(1, count(*) + 1)) as i from supplier group by s_nationkey)
""")
def pool_seed(spark, sf_dir):
    counts = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"))
    return seed_pool(counts, "kind")


# -- sinks: written, then read back ---------------------------------------------
@query("snk6_long_form_append", """
select l_orderkey::varchar as url, 'returnflag' as field, l_returnflag as content, l_shipdate as scraped_at from lineitem
union all
select l_orderkey::varchar, 'linestatus', l_linestatus, l_shipdate from lineitem
""")
def long_form(spark, sf_dir):
    items = wide_table(spark, sf_dir, "lineitem")
    cells = items.select(
        F.col("l_orderkey").cast("string").alias("url"), F.col("l_shipdate").alias("scraped_at"),
        F.explode(F.array(
            F.struct(F.lit("returnflag").alias("field"), F.col("l_returnflag").alias("content")),
            F.struct(F.lit("linestatus").alias("field"), F.col("l_linestatus").alias("content")))).alias("c"))
    path = working_path(spark, "long")
    append_long(cells.select("url", "c.field", "c.content", "scraped_at"), path)
    return read_between(spark, path)


@query("snk7_document_append", """
select o_orderkey::varchar as url,
       '{"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}' as content,
       o_orderdate as scraped_at
from orders
""")
def document_append(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("url", F.col("o_orderkey").cast("string"))
    path = working_path(spark, "documents")
    append_documents(document_rows(orders, "url", ["o_orderstatus", "o_orderpriority"], F.col("o_orderdate")), path)
    return read_between(spark, path)


@query("snk8_csv_export", """
select event_id::varchar as event_id, props->>'k' as k, event_type as kind from events
""")
def csv_export(spark, sf_dir):
    records = table(spark, sf_dir, "events").select("event_id", F.create_map(
        F.lit("kind"), "event_type", F.lit("k"), F.get_json_object("props", "$.k")).alias("record"))
    path = working_path(spark, "csv")
    write_csv(records, path, "record")
    return spark.read.option("header", True).csv(path)


SITE = "'https://site' || (props->>'k') || '.example'"


@query("snk9_action_logs", f"""
select site_key, website, part, piece, count(*)::int as n_actions, md5(string_agg(event_type, ',' order by ts, event_id)) as log_md5
from (select 'site' || (props->>'k') || '.example' as site_key, {SITE} as website, ts::date::varchar as part, ts, event_id, event_type,
             ((row_number() over (partition by props->>'k', ts::date order by ts, event_id) - 1) // 10000)::int as piece from events)
group by 1, 2, 3, 4
""")
def action_logs_query(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn(
        "origin", F.concat(F.lit("https://site"), F.get_json_object("props", "$.k"), F.lit(".example")))
    path = working_path(spark, "actions")
    day = F.to_date("ts").cast("string")
    write_action_logs(action_logs(events, "origin", ["ts", "event_id"], ["event_type", "ts"], day), path)
    logs = spark.read.schema("website string, part string, piece int, actions array<struct<event_type:string>>, site_key string").json(
        path)
    return logs.select("site_key", "website", "part", "piece", F.size("actions").alias("n_actions"),
                       F.md5(F.array_join("actions.event_type", ",")).alias("log_md5"))


@query("snk11_workflow_json", """
select c_mktsegment as user_id, 'w' || c_nationkey as workflow_id, count(*)::int as n_tasks,
       md5(string_agg(c_name || ':' || c_custkey % 7, ',' order by c_name)) as tasks_md5
from customer group by 1, 2
""")
def workflow_json(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    workflows = customers.select(
        F.col("c_mktsegment").alias("user_id"), F.concat(F.lit("w"), F.col("c_nationkey").cast("string")).alias(
            "workflow_id"), F.col("c_name").alias("task_id"), (F.col("c_custkey") % 7).alias("kind"))
    path = working_path(spark, "workflows")
    write_workflows(workflow_documents(workflows), path)
    stored = spark.read.schema("workflow_id string, tasks array<struct<task_id:string,kind:bigint>>, user_id string").json(path)
    names = F.transform("tasks", lambda t: F.concat(t["task_id"], F.lit(":"), t["kind"].cast("string")))
    return stored.select("user_id", "workflow_id", F.size("tasks").alias("n_tasks"), F.md5(F.array_join(names, ",")).alias("tasks_md5"))


@query("scl12_ingest_time", "select l_orderkey, l_linenumber, l_shipdate as scraped_at, 1::bigint as stamps from lineitem")
def ingest_time(spark, sf_dir):
    """A given time stays as it is; the current time is one and the same for all rows of a run, and not before its start."""
    before = datetime.now(timezone.utc)
    items = stamped(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")).withColumnRenamed("scraped_at", "now")
    stamps = items.agg(F.count_distinct(F.when(F.col("now") >= F.lit(before), F.col("now"))).alias("stamps"))
    return stamped(items, F.col("l_shipdate")).select("l_orderkey", "l_linenumber", "scraped_at", stamps.scalar().alias("stamps"))


# -- views and rules ---------------------------------------------------------
@query("prj6_workflow_view", """
select o_orderkey, o_custkey, o_orderpriority from orders where o_orderpriority = '1-URGENT'
""")
def workflow_view(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return workflow_rows(orders, "1-URGENT", "o_orderpriority")


@query("sql1_created_view", """
select event_type, count(*) as n from events where user_id = 8 group by event_type
""")
def created_view(spark, sf_dir):
    """The view compares a bigint column with the text a request carries."""
    name = create_view(table(spark, sf_dir, "events"), "acme", "8", "user_id")
    return spark.table(name).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("sql1_stored_view", """
select event_type, count(*) as n from events where user_id = 8 group by event_type
""")
def stored_view(spark, sf_dir):
    """SQL-1: a table and a view of the catalog, read in a second session; written out before both are dropped."""
    user = f"u{uuid.uuid4().hex}"
    publish(table(spark, sf_dir, "events"), f"events_{user}", working_path(spark, "events"))
    name = create_stored_view(spark, f"events_{user}", user, "8", "user_id")
    try:
        return cut(spark.newSession().table(name).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
    finally:
        spark.sql(f"drop view {name}")
        spark.sql(f"drop table events_{user}")


@query("sql2_catalog", """
select 'table' as kind, count(*) as n from (values ('t'), ('v'))
""")
def catalog_listing(spark, sf_dir):
    """SQL-2: a table of the given events and a view of it are listed."""
    user = f"u{uuid.uuid4().hex}"
    publish(table(spark, sf_dir, "events").select("event_id", "user_id"), f"events_{user}", working_path(spark, "events"))
    name = create_stored_view(spark, f"events_{user}", user, 8, "user_id")
    try:
        listed = list_catalog(spark).filter(F.col("name").isin(name, f"events_{user}"))
        return cut(listed.groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
    finally:
        spark.sql(f"drop view {name}")
        spark.sql(f"drop table events_{user}")


@query("src5_collection_scan", """
select o_orderkey, o_totalprice, o_orderpriority from orders where o_orderkey >= 1000 and o_orderstatus = 'O'
""")
def collection_scan(spark, sf_dir):
    """SRC-5, SRC-8: orders as a document collection, read in its declared schema; the reader itself filters."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_totalprice").cast("double").alias("o_totalprice"),
                                                   "o_orderstatus", "o_orderpriority", F.lit("x").alias("internal"))
    path = working_path(spark, "collection")
    write_collection(orders, path, hidden=("internal",))
    found = read_collection(spark, path)
    return found.filter((F.col("o_orderkey") >= 1000) & (F.col("o_orderstatus") == "O")).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("srt3_deep_page", """
select event_id, user_id, ts from events order by ts, event_id limit 100 offset (select 100 * (count(*) // 100 * 3 // 4 - 1) from events)
""")
def deep_page(spark, sf_dir):
    """SRT-3: a page three quarters in, by the directory of written pages."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    path, order, size = working_path(spark, "pages"), ["ts", "event_id"], 100
    write_pages(events, order, path, tasks=16)
    return read_page(spark, path, order, events.count() // size * 3 // 4, size)


@query("sql3_ad_hoc_sql", """
select o_orderstatus, count(*) as n, max(o_totalprice) as max_price from orders
where o_totalprice > 1000 group by o_orderstatus
""")
def ad_hoc_sql(spark, sf_dir):
    return run_sql(spark, "select o_orderstatus, count(*) as n, max(o_totalprice) as max_price from wl_orders "
                          "where o_totalprice > :floor group by o_orderstatus",
                   {"wl_orders": table(spark, sf_dir, "orders")}, {"floor": 1000})


@query("prj7_row_level_rules", """
select c_custkey, c_nationkey, c_mktsegment from customer
where c_nationkey in (select n_nationkey from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA')
""")
def row_level_rules(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    policies = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lit("customer").alias("dataset"), F.col("r_name").alias("user_id"),
        F.col("n_nationkey").cast("string").alias("value"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return visible_rows(customers, policies, "customer", "ASIA", "c_nationkey")


@query("prj8_credit_validation", """
select event_id, case when coalesce(try_cast(credits as int) > 0, false) then null else 'invalid credit amount' end
       as reject_reason
from (select event_id, case event_type when 'click' then 'many' when 'view' then '-3' when 'error' then '0'
                       else props->>'k' end as credits from events)
""")
def credit_validation(spark, sf_dir):
    credits = (F.when(F.col("event_type") == "click", "many").when(F.col("event_type") == "view", "-3")
               .when(F.col("event_type") == "error", "0").otherwise(F.get_json_object("props", "$.k")))
    rows = table(spark, sf_dir, "events").select("event_id", credits.alias("credits"))
    return rows.select("event_id", reject_reason(credit_rules()).alias("reject_reason"))


@query("prj8_workflow_validation", """
select conv_id, case when max(turn) filter (role = 'system') is not null then 'missing user_id'
                     when max(turn) < 1 then 'no tasks' end as reject_reason
from conversations group by conv_id
""")
def workflow_validation(spark, sf_dir):
    """A conversation as a workflow: its turns after the first are its tasks."""
    talk = table(spark, sf_dir, "conversations")
    later = F.when(F.col("turn") >= 1, F.lit("t"))
    workflows = talk.groupBy("conv_id").agg(
        F.when(F.max(F.when(F.col("role") == "system", 1)).isNull(), F.lit("u")).otherwise("").alias("user_id"),
        F.lit("w").alias("workflow_id"), F.collect_set(later).alias("tasks"))
    return workflows.select("conv_id", reject_reason(workflow_rules()).alias("reject_reason"))


@query("prj9_repair_pages", """
select p_partkey, case when p_size - 10 <= 0 or p_brand = 'Brand#1' then 1 else p_size - 10 end as pages from part
""")
def repair(spark, sf_dir):
    pages = F.when(F.col("p_brand") != "Brand#1", F.col("p_size") - 10)
    return table(spark, sf_dir, "part").select("p_partkey", repair_pages(pages).alias("pages"))


@query("prj10_field_mapping", """
select c_custkey as id, c_name as "fullName", c_mktsegment as segment from customer
""")
def field_mapping(spark, sf_dir):
    return map_fields(table(spark, sf_dir, "customer"),
                      {"c_custkey": "id", "c_name": "fullName", "c_mktsegment": "segment"})


@query("prj11_dynamic_header", """
select event_id, case when event_type = 'click' then props->>'k' end as click,
       case when event_type = 'error' then props->>'k' end as error,
       case when event_type = 'purchase' then props->>'k' end as purchase,
       case when event_type = 'signup' then props->>'k' end as signup,
       case when event_type = 'view' then props->>'k' end as view
from events
""")
def dynamic_header(spark, sf_dir):
    records = table(spark, sf_dir, "events").select(
        "event_id", F.create_map("event_type", F.get_json_object("props", "$.k")).alias("record"))
    return widen(records, "record")


@query("prj13_task_fan_out", """
select doc_id, (i - 1)::int as task_index, md5(parts[i]) as task_md5
from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i
      from (select doc_id, string_split(text, chr(10)) as parts from documents))
""")
def task_fan_out(spark, sf_dir):
    """A document as a workflow whose tasks are its lines."""
    workflows = table(spark, sf_dir, "documents").select(
        "doc_id", F.to_json(F.split("text", "\n", -1)).alias("tasks"))
    return fan_out(workflows).select("doc_id", "task_index", F.md5("task").alias("task_md5"))


# -- workflow dependencies ---------------------------------------------------
def _turns(spark, sf_dir):
    """Each turn depends on the one before it."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("task_id"),
        F.when(F.col("turn") > 0, F.array(F.col("turn") - 1)).otherwise(F.array().cast("array<bigint>")).alias(
            "depends_on"))


@query("jon8_root_tasks", "select conv_id, turn as task_id from conversations where turn = 0")
def roots(spark, sf_dir):
    return root_tasks(_turns(spark, sf_dir)).select("conv_id", "task_id")


@query("jon8_terminal_tasks", """
select conv_id, turn as task_id from conversations c
where not exists (select 1 from conversations d where d.conv_id = c.conv_id and d.turn = c.turn + 1)
""")
def terminals(spark, sf_dir):
    return terminal_tasks(_turns(spark, sf_dir), ["conv_id"]).select("conv_id", "task_id")


# -- sessions ----------------------------------------------------------------
CHANGES = """
with sited as (select *, event_type as site from events),
lagged as (select *, lag(site) over (partition by user_id order by ts, event_id) as before from sited),
sessions as (select *, sum(case when before is not distinct from site then 0 else 1 end)
             over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session_id
             from lagged)
"""


def _actions(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", F.col("event_type").alias("site"), F.get_json_object("props", "$.k").alias("k"))


@query("win1_sessions", CHANGES + "select event_id, user_id, site, session_id from sessions")
def sessions_query(spark, sf_dir):
    found = sessions(_actions(spark, sf_dir), "user_id", "site", ["ts", "event_id"])
    return found.select("event_id", "user_id", "site", "session_id")


@query("agg7_session_actions", CHANGES + """
select user_id, session_id, site, part, piece, string_agg(props->>'k', ',' order by ts, event_id) as actions
from (select *, ts::date as part, ((row_number() over (partition by user_id, session_id, site, ts::date order by ts, event_id) - 1) // 10000)::int as piece
      from sessions)
group by user_id, session_id, site, part, piece
""")
def session_actions(spark, sf_dir):
    actions = _actions(spark, sf_dir)
    found = sessions(actions, "user_id", "site", ["ts", "event_id"])
    logs = collect_actions(found, ["user_id", "session_id", "site"], ["ts", "event_id"], ["k"], F.to_date("ts"))
    return logs.withColumn("actions", F.array_join("actions.k", ","))


# -- sorting and paging ------------------------------------------------------
@query("srt1_storage_order", """
select l_shipdate as scraped_at, count(*) as n from lineitem group by 1
""")
def storage_order_query(spark, sf_dir):
    """Rewritten in time ranges, read back: the rows are the same, and each file holds one range."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("scraped_at"))
    path = working_path(spark, "ordered")
    storage_order(rows, clustered=True).write.parquet(path)
    return spark.read.parquet(path).groupBy("scraped_at").agg(F.count(F.lit(1)).alias("n"))


@query("srt2_preview", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def preview_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return preview(orders, [F.desc("o_totalprice"), "o_orderkey"])


@query("srt3_page_slice", "select o_orderkey, o_custkey from orders order by o_orderkey limit 5 offset 10")
def page_slice(spark, sf_dir):
    return page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 3)


@query("srt3_page_after_key", "select o_orderkey, o_custkey from orders where o_orderkey > 100 order by o_orderkey limit 5")
def page_after_key(spark, sf_dir):
    return page_after(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100)


@query("srt3_page_count", "select ceil(count(*) / 5.0)::bigint as total_pages from lineitem")
def page_count_query(spark, sf_dir):
    return page_count(table(spark, sf_dir, "lineitem"))


@query("srt3_numbered_pages", """
select o_orderkey, o_totalprice,
       ((row_number() over (order by o_totalprice desc, o_orderkey) - 1) // 5 + 1)::bigint as page
from orders
""")
def numbered_pages_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    keyed = orders.withColumn("_by", -F.col("o_totalprice"))
    return numbered_pages(keyed, ["_by", "o_orderkey"]).drop("_by")


@query("srt4_page_cap", "select conv_id, turn from conversations where turn + 1 <= 3")
def page_cap(spark, sf_dir):
    crawl = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") + 1).alias("page_no"))
    return cap_pages(crawl, repair_pages(F.lit(3))).drop("page_no")


# -- unions and de-duplication -----------------------------------------------
@query("set1_append_batches", """
select 'customers' as batch, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer
union all select 'suppliers', s_name, s_acctbal, null from supplier
""")
def append_batches_query(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return append_batches({"customers": customers, "suppliers": suppliers})


@query("ddp1_keep_first", """
select source, lang, doc_id, md5(text) as text_md5
from (select *, row_number() over (partition by source, lang, text order by doc_id) as rn from documents) where rn = 1
""")
def keep_first_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return keep_first(docs, ["source", "lang", "text"], ["doc_id"]).select(
        "source", "lang", "doc_id", F.md5("text").alias("text_md5"))


@query("ddp1_distinct_on", "select distinct user_id, event_type from events")
def distinct_on_query(spark, sf_dir):
    return distinct_on(table(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@query("ddp2_first_content", """
select origin, min_by(md5(html), page_id) as html_md5
from (select *, regexp_extract(url, '^[a-z]+://[^/?#]+') as origin from pages) group by origin
""")
def first_content_query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0).alias("origin"), F.col("page_id").alias("fetched_at"), "html")
    return first_content(pages, "origin").select("origin", F.md5("html").alias("html_md5"))

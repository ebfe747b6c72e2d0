"""SCL and SET expressions over whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import text as X
from webloom.functions.urls import origin
from webloom.operators.records import flatten_json
from webloom.plans.registry import query, table, wide_table
from webloom.sources.tables import explode_forms


@query("scl1_unicode_trim", """
select doc_id, md5(trim(chr(160) || ' ' || chr(133) || text || chr(9) || chr(8195) || ' ',
                        ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8195)))
       as trimmed_md5
from documents
""")
def unicode_trim(spark, sf_dir):
    docs = wide_table(spark, sf_dir, "documents")
    padded = F.concat(F.lit("  \u0085"), "text", F.lit("\t  "))
    return docs.select("doc_id", F.md5(X.unicode_trim(padded)).alias("trimmed_md5"))


@query("scl2_upper_values", """
select event_id, upper(event_type) as kind, upper(props) as props from events
""")
def upper_values(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    record = F.create_map(F.lit("kind"), "event_type", F.lit("props"), "props")
    upper = events.select("event_id", X.upper_values(record).alias("r"))
    return upper.select("event_id", F.col("r.kind").alias("kind"), F.col("r.props").alias("props"))


@query("scl3_token", """
select p_partkey, split_part(p_name, ' ', 2) as token from part
""")
def token(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.token(F.col("p_name"), " ", 2).alias("token"))


@query("scl5_strip_marker", """
select p_partkey, 'div.' || p_type || ' p' as selector from part
""")
def strip_marker(spark, sf_dir):
    marked = F.concat(F.lit("div."), "p_type", F.lit(".highlight p"))
    return table(spark, sf_dir, "part").select("p_partkey", X.strip_marker(marked).alias("selector"))


@query("scl6_selector_fields", """
with lists as (select doc_id, string_split(text, ' ') as words from documents)
select doc_id, words[1] as container, len(words) - 1 as n_fields, words[2] as field1, words[len(words)] as last_field
from lists where len(words) > 1
union all
select doc_id, words[1], 0, null, null from lists where len(words) = 1
""")
def selector_fields(spark, sf_dir):
    words = F.split("text", " ", -1)
    spec = wide_table(spark, sf_dir, "documents").select(
        "doc_id", X.container_of(words).alias("container"), X.numbered_fields(words).alias("fields"))
    size = F.size("fields")
    return spec.select("doc_id", "container", size.cast("bigint").alias("n_fields"),
                       F.try_element_at("fields", F.lit("field1")).alias("field1"),
                       F.try_element_at("fields", F.concat(F.lit("field"), size.cast("string"))).alias("last_field"))


@query("scl7_flatten_json", """
select event_id, '{"event.kind":' || to_json(event_type)::varchar || ',"event.props.k":' || (props->>'k')
       || ',"id":' || event_id || ',"tags":["' || event_type || '"]}' as flat
from events
""")
def flatten(spark, sf_dir):
    """Unknown schema: nested objects to dotted keys, arrays kept, empty objects gone."""
    nested = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"event":{"kind":"'), "event_type",
                      F.lit('","props":'), "props", F.lit(',"none":{}},"tags":["'), "event_type", F.lit('"]}'))
    return wide_table(spark, sf_dir, "events").select("event_id", nested.alias("json")).select(
        "event_id", flatten_json("json").alias("flat"))


@query("scl8_json_round_trip", """
select o_orderkey, o_orderpriority, o_custkey,
       '{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '"}' as json
from orders
""")
def json_round_trip(spark, sf_dir):
    encoded = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.to_json(F.struct("o_custkey", "o_orderpriority")).alias("json"))
    decoded = F.from_json("json", "o_custkey bigint, o_orderpriority string")
    return encoded.select("o_orderkey", "json", decoded.alias("d")).select("o_orderkey", "json", "d.*")


@query("scl9_base64_payload", """
select event_id, props as payload from events
""")
def base64_payload(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.base64(F.encode("props", "UTF-8")).alias("encoded"))
    return events.select("event_id", X.decode_base64(F.col("encoded")).alias("payload"))


@query("scl10_site_key", """
select page_id, replace(replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+'), 'https?://', ''),
                                '/', '_'), ':', '_') as site_key
from pages
""")
def site_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.site_key(origin(F.col("url"))).alias("site_key"))


@query("scl11_with_site", "select p_partkey, 'https://site.example' || '/' || p_name as link from part")
def with_site(spark, sf_dir):
    link = X.with_site("https://site.example", F.concat(F.lit("/"), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", link.alias("link"))


@query("scl14_topic_name", """
select c_custkey, 'workflow_' || c_custkey as workflow_topic, 'pipeline_' || c_name as pipeline_topic from customer
""")
def topic_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", X.topic_name("workflow", F.col("c_custkey")).alias("workflow_topic"),
        X.topic_name("pipeline", F.col("c_name")).alias("pipeline_topic"))


@query("scl15_fill_actions", """
select p_partkey, 'fill(' || split_part(p_name, ' ', 1) || '), '
       || case when p_type = 'SMALL' then 'upload(' else 'fill(' end || p_type || ')' as actions
from part
""")
def fill_actions(spark, sf_dir):
    fields = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(", "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", X.fill_actions(fields, ("SMALL",)).alias("actions"))


@query("scl16_form_fields", """
select p_partkey::varchar as website, unnest(string_split(p_name, ' ')) as field from part
""")
def form_fields(spark, sf_dir):
    """Parts as form examples: the words of a name are the fields."""
    forms = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("website"),
        F.struct(F.split("p_name", " ", -1).alias("fields"), F.array("p_type").alias("actions")).alias("form"))
    return explode_forms(forms, "fields")


@query("scl17_price_in_cents", "select p_partkey, p_size * 100 as cents from part")
def price_in_cents(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.price_in_cents(F.col("p_size")).alias("cents"))


BASE = "['" + "', '".join(X.BLOCKERS) + "']"


@query("set2_add_selectors", f"""
with lists as (
  select doc_id, list_transform(string_split(text, ','), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)
                 || chr(160))) as items from documents),
kept as (
  select doc_id, {BASE}
         || list_filter(items, lambda x, i: x <> '' and list_position(items, x) = i) as selectors from lists)
select doc_id, len(selectors) as n, md5(array_to_string(selectors, '|')) as selectors_md5 from kept
""")
def add_selectors(spark, sf_dir):
    base = F.array(*[F.lit(s) for s in X.BLOCKERS])
    merged = wide_table(spark, sf_dir, "documents").select("doc_id", X.add_selectors(base, F.col("text")).alias("s"))
    return merged.select("doc_id", F.size("s").cast("bigint").alias("n"),
                         F.md5(F.array_join("s", "|")).alias("selectors_md5"))


@query("set3_edit_selectors", """
with lists as (select doc_id, lang, string_split(text, ' ') as words from documents),
added as (select doc_id, case when list_contains(words, lang) then words else words || [lang] end as words from lists)
select doc_id, len(words) - 1 as n, md5(array_to_string(words[2:], ' ')) as words_md5 from added
""")
def edit_selectors(spark, sf_dir):
    words = F.split("text", " ", -1)
    added = wide_table(spark, sf_dir, "documents").select("doc_id", X.add_if_absent(words, F.col("lang")).alias("w"))
    left = added.select("doc_id", X.remove_at(F.col("w"), F.lit(0)).alias("w"))
    return left.select("doc_id", F.size("w").cast("bigint").alias("n"), F.md5(F.array_join("w", " ")).alias("words_md5"))

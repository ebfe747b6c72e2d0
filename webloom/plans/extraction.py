"""EXT, JON-6/7, AGG-8/9/10, DDP-4/5, SCL-4/13 on the page corpus.

The SQL checks read the raw html with regular expressions and never see the node arrays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from webloom.dom.css import descendant_pairs, match_rows, matches, with_text
from webloom.dom.extract import (
    click_targets, common_ancestor, container_records, container_rows, generalized_selectors, grouped_records,
    joined_text, link_titles, longest_field, page_fields, page_record, page_selectors, pages_without_matches,
    parent_records, positional_zip, raw_selectors, record_arrays, repeated_containers, single_field_rows, single_match_records,
)
from webloom.dom.node_table import children, containment, whole_buckets, write_nodes
from webloom.dom.shred import register_dom_nodes, slice_text
from webloom.functions.text import signature
from webloom.functions.urls import absolute_link, absolute_links_in, origin
from webloom.plans.registry import query, shredded_pages, wide_table
from webloom.runtime import cut


def _decoded(x: str) -> str:
    """References as browsers read them: these names need no semicolon."""
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    return x


def _trimmed(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


def _inner(tag: str) -> str:
    return _decoded(f"regexp_extract(html, '<{tag}[^>]*>(.*?)</{tag}>', 1, 's')")


# Page facts by regular expression: the text of each single element, and the link list.
FACTS = f"""
with facts as (
  select page_id, url, html,
    {_inner('title')} as title,
    {_inner('h1')} as heading,
    {_decoded("regexp_extract(html, '<div class=.ad.>(.*?)</div>', 1, 's')")} as ad,
    {_decoded("regexp_extract(html, '<footer>(.*?)</footer>', 1, 's')")} as footer,
    {_decoded("regexp_replace(regexp_extract(html, '</h1>(.*?)</article>', 1, 's'), '<[^>]*>', '', 'g')")} as body,
    list_transform(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'),
                                      '<a href="[^"]*">([^<]*)</a>', 1), lambda x: {_decoded('x')}) as links,
    list_transform(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'),
                                      '<a href="([^"]*)">', 1), lambda x: {_decoded('x')}) as hrefs,
    len(regexp_extract_all(html, '<p>')) as n_p
  from pages)
"""


# Source tags by name (and class), plus the inline elements a parser re-opens: the pages never close
# <b>, so each later paragraph and the footer repeat the ones still active, three at most.
ELEMENTS = """
with tags as (
  select unnest(regexp_extract_all(
    regexp_replace(html, '<script>.*?</script>', '<script></script>', 'gs'),
    '<([a-z][a-z0-9]*(?: class="[^"]*")?)', 1)) as tag
  from pages),
cut as (
  select page_id, string_split(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<p>') as parts from pages),
places as (select page_id, parts, unnest(range(2, len(parts) + 2)) as i from cut),
reopened as (
  select least(3, len(regexp_extract_all(array_to_string(parts[1:i - 1], ''), '<b>'))) as n from places
  where i > len(parts) or parts[i] not in ('', '</p>')),
elements as (
  select replace(replace(tag, ' class="', '.'), '"', '') as signature, count(*) as n from tags group by 1
  union all select 'b', sum(n) from reopened)
"""


@query("ext0_element_counts", ELEMENTS + """
select split_part(signature, '.', 1) as tag, sum(n)::bigint as n from elements group by 1
""")
def element_counts(spark, sf_dir):
    """Elements per tag over the corpus, those a parser re-opens included."""
    nodes = shredded_pages(spark, sf_dir).select(F.explode(F.transform("nodes", lambda n: n["tag"])).alias("tag"))
    return nodes.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("ext0_node_places", FACTS + """
, ids as (select page_id, links, unnest(range(len(links))) as i from facts),
nodes as (
  select page_id, 'ul' as tag, 8 as pre, (8 + 2 * len(links))::int as last, array_to_string(links, '') as content
  from facts
  union all select page_id, 'li', (9 + 2 * i)::int, (10 + 2 * i)::int, links[i + 1] from ids
  union all select page_id, 'a', (10 + 2 * i)::int, (10 + 2 * i)::int, links[i + 1] from ids
  union all select page_id, 'h1', (11 + 2 * len(links))::int, (11 + 2 * len(links))::int, heading from facts
  union all select page_id, 'title', 3, 3, title from facts)
select page_id, tag, pre, last, content from nodes
""")
def node_places(spark, sf_dir):
    """The interval table of all pages, for the tags whose ids plain text can predict."""
    tags = ("ul", "li", "a", "h1", "title")
    shredded = shredded_pages(spark, sf_dir)
    kept = F.filter("nodes", lambda n: n["tag"].isin(*tags))
    rows = with_text(lambda text: F.transform(kept, lambda n: F.struct(
        n["tag"].alias("tag"), n["pre"].alias("pre"), n["last"].alias("last"), slice_text(text, n).alias("content"))))
    return shredded.select("page_id", F.inline(rows))


@query("ext0_node_table")
def node_table(spark, sf_dir):
    """All elements of all pages with their intervals and texts. Plain text cannot predict the ids inside paragraphs, so SQL checks
    ``ext0_node_places`` and the tests the rest."""
    shredded = shredded_pages(spark, sf_dir)
    rows = with_text(lambda text: F.transform("nodes", lambda n: F.struct(
        n["tag"].alias("tag"), n["pre"].alias("pre"), n["last"].alias("last"), slice_text(text, n).alias("content"))))
    return shredded.select("page_id", F.inline(rows))


def _stored_nodes(spark, sf_dir, use):
    """What ``use`` makes of the written node table."""
    name = f"nodes_{uuid.uuid4().hex}"
    nodes = write_nodes(shredded_pages(spark, sf_dir), name, buckets=16)
    try:
        with whole_buckets(spark):
            return cut(use(nodes))
    finally:
        spark.sql(f"drop table {name}")


@query("jon6_node_table_pairs", FACTS + """
, ids as (select page_id, links, unnest(range(len(links))) as i from facts)
select page_id, 7 as outer_pre, (10 + 2 * i)::int as pre, links[i + 1] as content from ids
""")
def node_table_pairs(spark, sf_dir):
    """JON-6 over a table of elements, bucketed by page: one pass, no shuffle."""
    return _stored_nodes(spark, sf_dir, lambda nodes: containment(nodes, F.col("tag") == "nav", F.col("tag") == "a"))


@query("jon7_node_table_children", FACTS + """
select page_id, unnest(links) as content from facts
""")
def node_table_children(spark, sf_dir):
    """JON-7 over a table of elements: links directly under list items."""
    return _stored_nodes(spark, sf_dir, lambda nodes: children(nodes, F.col("tag") == "li", F.col("tag") == "a").select("page_id", "content"))


@query("udf2_dom_nodes_lateral", FACTS + """
select page_id, unnest(links) as content from facts
""")
def dom_nodes_lateral(spark, sf_dir):
    register_dom_nodes(spark)
    pages = wide_table(spark, sf_dir, "pages")
    return spark.sql("""
        select page_id, n.content from (select page_id, shred_html(html) as d from {pages})
        lateral view inline(transform(filter(d.nodes, n -> n.tag = 'a'),
            n -> named_struct('content', cast(substring(d.text, n.text_start + 1, n.text_len) as string)))) n""", pages=pages)


@query("ext1_page_fields", FACTS + f"""
, cells as (
  select page_id, unnest(['title', 'div.ad', 'h1', 'article p', 'footer', '.missing']) as field,
         unnest([title, ad, heading, body, footer, '']) as raw from facts)
select page_id, field, {_trimmed('raw')} as content from cells where {_trimmed('raw')} <> ''
""")
def page_fields_query(spark, sf_dir):
    return page_fields(shredded_pages(spark, sf_dir),
                       ["title", "div.ad", "h1", "article p", "footer", ".missing"], "page_id")


@query("ext2_page_record", FACTS + f"""
select page_id, {_trimmed('title')} as title, {_trimmed('ad')} as ad,
       {_trimmed("array_to_string(links, '')")} as links, '' as missing from facts
""")
def page_record_query(spark, sf_dir):
    return page_record(shredded_pages(spark, sf_dir),
                       {"title": "title", "ad": "div.ad", "links": "nav li a", "missing": ".missing"}, "page_id")


@query("ext3_container_rows", FACTS + f"""
, cells as (select page_id, unnest(links) as link from facts)
select page_id, {_trimmed('link')} as link, '' as heading from cells
""")
def container_rows_query(spark, sf_dir):
    return container_rows(shredded_pages(spark, sf_dir), "nav li", {"link": "a", "heading": "h1"},
                          "page_id").drop("container_pre")


@query("ext4_positional_zip", FACTS + """
, places as (select *, unnest(range(greatest(len(links), 1))) as i from facts)
select page_id, i::int as row, coalesce(links[i + 1], '') as link, case when i = 0 then ad else '' end as ad,
       null::varchar as missing from places
""")
def positional_zip_query(spark, sf_dir):
    return positional_zip(shredded_pages(spark, sf_dir),
                          {"link": "nav a", "ad": "div.ad", "missing": ".missing"}, "page_id")


@query("ext5_single_field_rows", FACTS + f"""
, cells as (
  select page_id, 'link' as field, unnest(links) as raw from facts
  union all select page_id, 'heading', heading from facts)
select page_id, field, {_trimmed('raw')} as content from cells
""")
def single_field_rows_query(spark, sf_dir):
    return single_field_rows(shredded_pages(spark, sf_dir), {"link": "nav a", "heading": "h1"}, "page_id")


@query("ext5_pages_without_matches", """
select page_id from pages where html not like '%</b>%' and html not like '%<table%'
""")
def pages_without_matches_query(spark, sf_dir):
    return pages_without_matches(shredded_pages(spark, sf_dir), {"cell": "table td", "id": "#main"}, "page_id")


@query("ext6_parent_records", FACTS + f"""
, cells as (
  select page_id, heading as heading, null::varchar as link from facts
  union all select page_id, null, unnest(links) from facts)
select page_id, nullif({_trimmed('heading')}, '') as heading, nullif({_trimmed('link')}, '') as link from cells
where {_trimmed('heading')} <> '' or {_trimmed('link')} <> ''
""")
def parent_records_query(spark, sf_dir):
    return parent_records(shredded_pages(spark, sf_dir), {"heading": "h1", "link": "nav a"},
                          "page_id").drop("container_pre")


@query("ext7_container_records", FACTS + f"""
select page_id, {_trimmed('heading')} as heading, {_trimmed('body')} as body, null::varchar as link
from facts where heading <> '' or body <> ''
""")
def container_records_query(spark, sf_dir):
    return container_records(shredded_pages(spark, sf_dir), "article",
                             {"heading": "h1", "body": "p", "link": "a"}, "page_id").drop("container_pre")


@query("snk10_record_arrays", FACTS + f"""
select page_id, '[' || array_to_string(list_transform(list_filter(links, lambda x: x <> ''),
       lambda x: '{{"link":' || to_json({_trimmed('x')})::varchar || '}}'), ',') || ']' as records from facts
""")
def record_arrays_query(spark, sf_dir):
    return record_arrays(shredded_pages(spark, sf_dir), "nav li", {"link": "a", "heading": "h1"}, "page_id")


@query("ext8_single_match_records", FACTS + f"""
select page_id, {_trimmed('heading')} as heading,
       case when len(links) = 1 then {_trimmed('links[1]')} end as link
from facts where heading <> ''
""")
def single_match_records_query(spark, sf_dir):
    return single_match_records(shredded_pages(spark, sf_dir), "body", {"heading": "h1", "link": "a"},
                                "page_id").drop("container_pre")


@query("ext9_common_ancestor", FACTS + """
select page_id, case len(links) when 0 then null when 1 then 10 else 8 end::int as lca_pre,
       case len(links) when 0 then null when 1 then 'a' else 'ul' end as lca_selector,
       case when len(links) = 0 then 'link' else '' end as missing from facts
""")
def common_ancestor_query(spark, sf_dir):
    found = common_ancestor(shredded_pages(spark, sf_dir), {"link": "nav li > a"}, "page_id")
    return found.withColumn("missing", F.array_join("missing", ","))


@query("ext9_common_ancestor_of_two", FACTS + """
select page_id, 'body' as lca_selector from facts
""")
def common_ancestor_of_two(spark, sf_dir):
    return common_ancestor(shredded_pages(spark, sf_dir), {"heading": "h1", "ad": "div.ad"},
                           "page_id").select("page_id", "lca_selector")


@query("ext10_link_titles", FACTS + f"""
, cells as (select page_id, unnest(hrefs) as href, unnest(links) as link from facts)
select page_id, 'https://site.example' || href as link, {_trimmed('link')} as title from cells
where href <> '' and {_trimmed('link')} <> ''
""")
def link_titles_query(spark, sf_dir):
    return link_titles(shredded_pages(spark, sf_dir), "nav li", "li > a", "page_id", link="a",
                       site="https://site.example")


def _classed_html():
    """The given html with classes on two ancestors and markup inside the links of the menu."""
    html = F.regexp_replace("html", "<nav>", '<nav class="menu top">')
    html = F.regexp_replace(html, "<article>", '<article class="text">')
    return F.regexp_replace(html, '<li><a href="([^"]*)">([^<]*)</a>', '<li><a href="$1"><span>$2</span></a>')


@query("ext11_generalized_selectors", FACTS + """
, cells as (
  select page_id, unnest(list_transform(links, lambda x: 'nav.menu.top span')) as selector from facts
  union all select page_id, 'div.ad' from facts union all select page_id, 'article.text h1' from facts)
select page_id, selector from cells
""")
def generalized_selectors_query(spark, sf_dir):
    return generalized_selectors(shredded_pages(spark, sf_dir, _classed_html()), "nav span, div.ad, h1", "page_id").drop("pre")


@query("ext12_click_targets", FACTS + """
, ids as (select page_id, unnest(range(len(links))) as i from facts),
cells as (
  select page_id, (9 + 3 * i)::int as pre, (9 + 3 * i)::int as target_pre from ids
  union all select page_id, (11 + 3 * i)::int, (10 + 3 * i)::int from ids
  union all select page_id, 3, 3 from facts)
select page_id, pre, target_pre from cells
""")
def click_targets_query(spark, sf_dir):
    """A click on the markup inside a link stands for the link."""
    return click_targets(shredded_pages(spark, sf_dir, _classed_html()), "nav li, nav span, title", "page_id")


@query("ext13_grouped_records", FACTS + f"""
, cells as (
  select page_id, 'links' as "group", unnest(links) as link, null::varchar as heading, null::varchar as body from facts
  union all select page_id, 'article', null, heading, body from facts)
select page_id, "group", {_trimmed('link')} as link, {_trimmed('heading')} as heading, {_trimmed('body')} as body
from cells
""")
def grouped_records_query(spark, sf_dir):
    rows = grouped_records(shredded_pages(spark, sf_dir), {
        "links": ("nav li", {"link": "a"}),
        "article": ("article", {"heading": "h1", "body": "p"}),
    }, "page_id")
    return rows.select("page_id", "group", *[
        F.try_element_at("record", F.lit(f)).alias(f) for f in ("link", "heading", "body")])


@query("jon6_descendant_pairs", FACTS + """
, ids as (select page_id, links, unnest(range(len(links))) as i from facts)
select page_id, 7 as outer_pre, (10 + 2 * i)::int as pre, links[i + 1] as content from ids
""")
def descendant_pairs_query(spark, sf_dir):
    return descendant_pairs(shredded_pages(spark, sf_dir), "nav", "a", "page_id")


@query("jon7_child_matches", FACTS + """
select page_id, unnest(links) as content from facts
union all select page_id, heading from facts
""")
def child_matches_query(spark, sf_dir):
    return match_rows(shredded_pages(spark, sf_dir), "ul > li > a, article > h1, nav > a",
                      "page_id").select("page_id", "content")


@query("agg8_joined_text", FACTS + """
select page_id, array_to_string(links, '') || array_to_string(links, '') as content from facts
""")
def joined_text_query(spark, sf_dir):
    """Nested matches count twice: each link text comes once for its item and once for itself."""
    both = with_text(lambda text: F.concat(
        joined_text(matches("nav li"), text), joined_text(matches("nav a"), text)))
    return shredded_pages(spark, sf_dir).select("page_id", both.alias("content"))


@query("agg9_longest_field", FACTS + """
select page_id, greatest(len(links), n_p, 1)::int as max_len from facts
""")
def longest_field_query(spark, sf_dir):
    return longest_field(shredded_pages(spark, sf_dir), {"link": "nav a", "par": "p", "heading": "h1"}, "page_id")


@query("agg10_repeated_containers", FACTS + """
, cells as (
  select page_id, 8 as parent_pre, 'li' as signature, len(links)::int as n from facts
  union all select page_id, (10 + 2 * len(links))::int, 'p', n_p::int from facts)
select page_id, parent_pre, signature, n from cells where n >= 2
""")
def repeated_containers_query(spark, sf_dir):
    return repeated_containers(shredded_pages(spark, sf_dir), 2, "page_id")


@query("ddp4_distinct_selectors", """
with found as (
  select page_id, 'class_' as prefix, '.' as mark,
         unnest(flatten(list_transform(regexp_extract_all(html, ' class="([^"]*)"', 1),
                                       lambda c: string_split(c, ' ')))) as v from pages
  union all select page_id, 'id_', '#', unnest(regexp_extract_all(html, ' id="([^"]*)"', 1)) from pages)
select distinct page_id, prefix || v as name, mark || v as selector from found where v <> ''
""")
def distinct_selectors(spark, sf_dir):
    return page_selectors(shredded_pages(spark, sf_dir), "page_id")


@query("ddp5_raw_selectors", """
with found as (
  select page_id, '.' || unnest(regexp_extract_all(html, ' class="([^"]*)"', 1)) as selector from pages
  union all select page_id, '#' || unnest(regexp_extract_all(html, ' id="([^"]*)"', 1)) from pages)
select page_id, selector from found
""")
def raw_selectors_query(spark, sf_dir):
    return raw_selectors(shredded_pages(spark, sf_dir), "page_id").select("page_id", "selector")


ENCODED = """array_to_string(list_transform(string_split({link}, ''), lambda c:
    case when c = '' or (ord(c) between 33 and 126 and c not in ('"', '<', '>', '`', '{{', '}}')) then c
         else regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') end), '')"""


@query("scl4_absolute_links", FACTS + f"""
, cells as (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') as base, unnest(hrefs) as href from facts)
select page_id, href, base || {ENCODED.format(link='href')} as absolute from cells
""")
def absolute_links_query(spark, sf_dir):
    """Link attributes of all anchors, resolved against the origin of their page."""
    shredded = shredded_pages(spark, sf_dir)
    anchors = F.filter("nodes", lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], "href"))
    links = shredded.select("page_id", "url", F.explode(F.transform(anchors, lambda n: n["attrs"]["href"])).alias(
        "href"))
    return links.select("page_id", "href", absolute_link(F.col("href"), origin(F.col("url"))).alias("absolute"))


@query("scl4_absolute_html", f"""
with parts as (
  select page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') as base,
         string_split_regex(html, '(?:src|href)="/[^/"][^"]*"') as between_links,
         regexp_extract_all(html, '((?:src|href)=")/[^/"][^"]*"', 1) as heads,
         regexp_extract_all(html, '(?:src|href)="(/[^/"][^"]*)"', 1) as links
  from pages)
select page_id, md5(between_links[1] || array_to_string(list_transform(range(1, len(links) + 1), lambda i:
         heads[i] || base || {ENCODED.format(link='links[i]')} || '"' || between_links[i + 1]), '')) as html_md5
from parts
""")
def absolute_html_query(spark, sf_dir):
    pages = wide_table(spark, sf_dir, "pages")
    return pages.select("page_id", F.md5(absolute_links_in(F.col("html"), origin(F.col("url")))).alias("html_md5"))


@query("scl13_signatures", ELEMENTS + "select signature, sum(n)::bigint as n from elements group by 1")
def signatures(spark, sf_dir):
    nodes = shredded_pages(spark, sf_dir).select(F.explode(F.transform(
        F.col("nodes"), lambda n: signature(n["tag"], n["classes"]))).alias("signature"))
    return nodes.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))

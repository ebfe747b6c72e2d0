"""Golden pages for the extraction operators."""

from itertools import accumulate

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.dom.css import count_below, descendant_pairs, match_rows, matches, parse
from webloom.dom.extract import (
    click_targets, common_ancestor, container_records, container_rows, generalized_selectors, grouped_records,
    link_titles, longest_field, page_fields, page_record, page_selectors, pages_without_matches, parent_records,
    positional_zip, raw_selectors, record_arrays, repeated_containers, single_field_rows, single_match_records,
)
from webloom.dom.shred import SLICE_BYTES, node_rows, register_dom_nodes, shred, shred_html, shred_pages

SHED = """<html lang="en"><head><title>Tool shed</title></head><body><section class="shelf"><h1>Tool shed</h1>
<article class="tool"><h2>Rake</h2><p class="rent">4 a day</p><em>two left</em><a rel="item" href="/shed/rake">Reserve</a></article>
<article class="tool"><a rel="item" href="/shed/saw">Reserve</a><h2>Saw</h2><p class="rent">7 a day</p></article>
<article class="tool"><h2>Ladder</h2><p class="rent">11 a day</p><a rel="item" href="/shed/ladder">Ask</a></article>
</section><footer>Open on Saturdays</footer></body></html>"""

# One field missing, one white space only, two matches of a field, a container in a same-class container.
ODD = """<body><div class="card"><h2> A </h2></div>
<div class="card" id="two"><h2>B</h2><p>   </p><a href="/b"><div><h3>B title</h3></div></a></div>
<div class="card"><h2>C</h2><h2>D</h2><div class="card"><p>$4</p></div></div>
<div class="card"></div></body>"""

FIELDS = {"title": "h2", "price": "p"}


@pytest.fixture(scope="module")
def pages(spark):
    data = [(1, SHED), (2, ODD), (3, ""), (4, None)]
    return shred(spark.createDataFrame(data, "page_id int, html string")).cache()


@pytest.fixture(scope="module")
def shed(pages):
    return pages.filter("page_id = 1")


@pytest.fixture(scope="module")
def odd(pages):
    return pages.filter("page_id = 2")


def test_null_and_empty_pages(pages, rows):
    assert rows(node_rows(pages.filter("page_id = 3"), "page_id"), "tag") == [("body",), ("head",), ("html",)]
    assert rows(node_rows(pages.filter("page_id = 4"), "page_id")) == []


def test_tool_cards(shed, rows):
    found = container_records(shed, ".tool", {"title": "h2", "price": "p.rent", "link": "a"}, "page_id")
    assert rows(found, "title", "price", "link") == [
        ("Ladder", "11 a day", "Ask"), ("Rake", "4 a day", "Reserve"), ("Saw", "7 a day", "Reserve")]


def test_container_records_presence(odd, rows):
    assert rows(container_records(odd, ".card", FIELDS), "title", "price") == sorted([
        ("A", None), ("B", ""), ("CD", "$4"), (None, "$4")], key=repr)


def test_container_rows_keep_everything(odd, rows):
    assert rows(container_rows(odd, ".card", FIELDS), "title", "price") == sorted([
        ("A", ""), ("B", ""), ("CD", "$4"), ("", "$4"), ("", "")], key=repr)


def test_single_match_records(odd, rows):
    assert rows(single_match_records(odd, ".card", FIELDS), "title", "price") == sorted([
        ("A", None), ("B", ""), (None, "$4"), (None, "$4")], key=repr)


def test_parent_records(odd, rows):
    found = rows(parent_records(odd, FIELDS), "title", "price")
    assert found == sorted([("A", None), ("B", None), ("CD", "$4"), ("CD", "$4"), ("B", None), (None, "$4")], key=repr)


def test_positional_zip_is_untrimmed_and_padded(odd, rows):
    found = rows(positional_zip(odd, {**FIELDS, "none": "table"}), "row", "title", "price", "none")
    assert found == [(0, " A ", "   ", None), (1, "B", "$4", None), (2, "C", "", None), (3, "D", "", None)]
    assert rows(positional_zip(odd, {"none": "table"})) == []


def test_page_fields_and_record(pages, rows):
    assert rows(page_fields(pages, ["h1", "h2", ".none"], "page_id")) == [
        (1, "h1", "Tool shed"), (1, "h2", "RakeSawLadder"), (2, "h2", "A BCD")]
    assert rows(page_record(pages, {"h": "h1", "p": "p"}, "page_id")) == [
        (1, "Tool shed", "4 a day7 a day11 a day"), (2, "", "$4"), (3, "", "")]


def test_single_field_rows_and_misses(pages, odd, rows):
    assert rows(single_field_rows(odd, FIELDS)) == sorted([
        ("title", "A"), ("title", "B"), ("title", "C"), ("title", "D"), ("price", ""), ("price", "$4")], key=repr)
    assert rows(pages_without_matches(pages.filter("text is not null"), FIELDS, "page_id")) == [(3,)]
    assert rows(longest_field(odd, FIELDS)) == [(4,)]


def test_grouped_records(odd, rows):
    found = grouped_records(odd, {"cards": (".card .card", {"price": "p"}), "page": ("body", {"t": "h3"})})
    assert rows(found, "group", "record") == [("cards", {"price": "$4"}), ("page", {"t": "B title"})]


def test_record_arrays(odd, rows):
    assert rows(record_arrays(odd, "#two", FIELDS)) == [('[{"title":"B","price":""}]',)]
    assert rows(record_arrays(odd, "table", FIELDS)) == [("[]",)]


def test_link_titles(pages, rows):
    assert rows(link_titles(pages, "a", "div > h3", "page_id", site="https://s")) == [(2, "https://s/b", "B title")]


def test_common_ancestor(shed, odd, rows):
    assert rows(common_ancestor(shed, {"t": "h2", "p": ".rent"}), "lca_selector", "missing") == [
        ("section.shelf", [])]
    assert rows(common_ancestor(odd, {"a": "h3", "p": "#two p"}), "lca_selector") == [("div#two",)]
    assert rows(common_ancestor(odd, {"one": "#two"}), "lca_selector") == [("div#two",)]
    assert rows(common_ancestor(odd, {"a": "h3", "x": "table"}), "lca_pre", "lca_selector", "missing") == [
        (None, None, ["x"])]


def test_generalized_selectors_and_click_targets(odd, rows):
    assert rows(generalized_selectors(odd, "h3, #two"), "selector") == [("div.card h3",), ("div.card",)]
    nested = rows(generalized_selectors(odd, ".card .card"), "selector")
    assert nested == [("div.card div.card",)]
    anchor = rows(match_rows(odd, "a"), "pre")[0][0]
    assert [t for _, t in rows(click_targets(odd, "h3, a"), "pre", "target_pre")] == [anchor, anchor]
    h2 = rows(click_targets(odd, "#two h2"), "pre", "target_pre")
    assert h2[0][0] == h2[0][1]


def test_repeated_containers(shed, odd, rows):
    assert rows(repeated_containers(shed, 3), "signature", "n") == [("article.tool", 3)]
    assert rows(repeated_containers(odd, 2), "signature", "n") == [("div.card", 4), ("h2", 2)]


def test_selector_listing(odd, rows):
    assert rows(page_selectors(odd)) == [("class_card", ".card"), ("id_two", "#two")]
    listed = [s for _, _, s in rows(raw_selectors(odd))]
    assert listed.count(".card") == 5 and listed.count("#two") == 1


def test_descendants_and_children(odd, rows):
    assert rows(descendant_pairs(odd, ".card", "p"), "content") == [("   ",), ("$4",), ("$4",)]
    assert rows(match_rows(odd, "body > .card > p"), "content") == [("   ",)]
    assert rows(match_rows(odd, ".card p, p"), "content") == [("   ",), ("$4",)]
    assert rows(match_rows(odd, "a[href] h3"), "content") == [("B title",)]
    assert len(rows(match_rows(odd, "*"))) == len(rows(node_rows(odd)))


def test_a_node_matches_once_under_nested_ancestors(spark, rows):
    page = shred(spark.createDataFrame([("<div><div><div><p>x</p></div></div></div>",)], "html string"))
    assert rows(match_rows(page, "div p"), "content") == [("x",)]
    assert rows(match_rows(page, "div div > div p"), "content") == [("x",)]


@pytest.mark.parametrize("selector", [
    "", "> a", "a:hover", "a + b", "a ~ b", "a >", ",", "a,,b", "a[href", "a[href!=x]", "a[=x]", "a b,", "a..b", "a>>b"])
def test_unsupported_selectors_raise(selector):
    with pytest.raises(ValueError):
        parse(selector)


def test_fields_are_required(odd):
    for operator in (page_record, positional_zip, parent_records, common_ancestor):
        with pytest.raises(ValueError):
            operator(odd, {})


def test_count_below(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([([1, 3, 3, 7], [7, 0, 3, 4, 8])], "v array<int>, p array<int>")
    assert frame.select(count_below(F.col("v"), F.col("p"))).first()[0] == [3, 0, 1, 3, 4]


def test_selectors_against_a_tree_walk(spark, rows):
    """Compiled selectors agree with a plain ancestor walk on a page of mixed nesting."""
    import random

    rng = random.Random(7)
    parts, stack = [], []
    for _ in range(400):
        if stack and rng.random() < 0.45:
            parts.append(f"</{stack.pop()}>")
        else:
            tag = rng.choice(["div", "section", "span"])
            parts.append(f'<{tag} class="{rng.choice("abc")}">t')
            stack.append(tag)
    page = shred(spark.createDataFrame([("".join(parts),)], "html string"))
    nodes = {n.pre: n for n in node_rows(page).collect()}

    def walk(node, tag, cls):
        return (tag == "*" or node.tag == tag) and (cls is None or cls in node.classes)

    def above(node):
        while node.parent >= 0:
            node = nodes[node.parent]
            yield node

    expected = sorted(n.pre for n in nodes.values() if walk(n, "span", None)
                      and any(walk(a, "div", "a") and a.parent >= 0 and walk(nodes[a.parent], "*", "b")
                              for a in above(n)))
    assert [p for p, in page.select(matches(".b > div.a span").alias("m")).selectExpr("inline(m)").select("pre").collect()
            ] == expected


def test_sql_shred(spark, rows):
    register_dom_nodes(spark)
    frame = spark.createDataFrame([(1, "<p>x<p>y"), (2, None)], "id int, html string")
    frame.createOrReplaceTempView("wl_pages")
    found = spark.sql("""select id, n.tag, n.content from (select id, shred_html(html) as d from wl_pages)
        lateral view inline(transform(d.nodes, n -> named_struct('tag', n.tag, 'content',
            cast(substring(d.text, n.text_start + 1, n.text_len) as string)))) n where n.tag = 'p'""")
    assert rows(found) == [(1, "p", "x"), (1, "p", "y")]


def test_large_page_stays_near_linear(spark):
    import time

    html = "".join(f'<div class="card"><h2>t{i}</h2><p>p{i}</p></div>' for i in range(30000))
    page = shred(spark.createDataFrame([(html,)], "html string")).cache()
    page.count()
    begin = time.time()
    assert container_records(page, ".card", FIELDS).count() == 30000
    assert time.time() - begin < 30


def test_selection_requests(shed, rows):
    from webloom.dom.selection import Selection

    body = """{"url": "u", "lcaSelector": ".tool", "pages": 0,
               "groups": {"fields": {"title": "h2"}, "top": {"container": "body", "head": "h1"}}}"""
    selection = Selection.from_json(body)
    assert selection.pages == 1
    assert rows(selection.records(shed), "title") == [("Ladder",), ("Rake",), ("Saw",)]
    top = Selection("u", {"top": {"container": "body", "head": "h1"}})
    assert rows(top.group_records(shed), "group", "record") == [("top", {"head": "Tool shed"})]
    listed = Selection.from_selectors("u", [".tool", "h2", "p"])
    assert rows(listed.records(shed), "field1", "field2")[0] == ("Ladder", "11 a day")
    for broken in (lambda: Selection("u").records(shed), lambda: Selection("u").group_records(shed),
                   lambda: Selection("u", {"fields": {"a": "b"}}).records(shed),
                   lambda: Selection.from_selectors("u", [])):
        with pytest.raises(ValueError):
            broken()


def test_bytes_that_are_no_text_do_not_fail_the_batch(spark, rows):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(bytearray(b"<p>a\xff\xfeb<p>\xe9"),), (bytearray("<p>é".encode()),)], "b binary")
    page = shred(frame.select(F.col("b").cast("string").alias("html")))
    assert rows(match_rows(page, "p"), "content") == sorted([("a\ufffd\ufffdb",), ("\ufffd",), ("é",)], key=repr)


@pytest.mark.parametrize("selector,expected", [
    ("[href]", "abcd"), ("a[href='/x']", "a"), ('[href="/x y, z"]', "b"), ("a[ href ^= '/x' ]", "ab"),
    ("[href$=html]", "c"), ("[href*='//']", "c"), ("[rel~=next]", "bd"), ("[lang|=en]", "ac"),
    ("""[title="it's"]""", "d"), (r"[title='a\']", "c"), ("[href^='']", ""), ("[rel~='a b']", ""),
    ("p > a[rel], a[lang=en]", "abd"), ("A.k#i[HREF]", "a"), ("p>a,p  >  a", "abcd"),
])
def test_attribute_values(spark, selector, expected):
    html = """<p><a id=i class=k href="/x" lang=en>a</a><a href="/x y, z" rel="next b">b</a>
    <a href="http://h/i.html" lang=en-GB title="a\\">c</a><a href="" rel=next title="it's">d</a></p>"""
    page = shred(spark.createDataFrame([(html,)], "html string"))
    assert "".join(sorted(r.content for r in match_rows(page, selector).collect())) == expected


def test_pages_of_a_large_batch_are_parsed_in_slices(spark):
    """What a worker holds of nodes follows a slice of pages, not the batch; every page keeps its place."""
    def page(i):
        return None if i % 97 == 5 else "" if i % 89 == 3 else f"<p class='c{i}'>{i}" + "<b>x</b>" * (40_000 if i == 400 else 250)

    html = pa.array([page(i) for i in range(1500)], pa.string())
    parts = list(shred_html.func(iter([html, html.slice(0, 0)])))
    assert [len(x) for x in parts][-1] == 0 and sum(len(x) for x in parts) == len(html)
    sizes = [sum(len(page(i) or "") for i in range(at, at + n)) for at, n in zip(accumulate([0, *map(len, parts)]), map(len, parts))]
    assert len(parts) >= 4 and all(size <= SLICE_BYTES or n == 1 for size, n in zip(sizes, map(len, parts)))
    whole = pa.concat_arrays(parts).to_pylist()
    assert all(whole[i] == shred_pages([None if s is None else s.encode()]).to_pylist()[0] for i, s in enumerate(html.to_pylist()) if i % 7 == 0 or i in (3, 5, 400))
    pages = spark.createDataFrame([(i, page(i)) for i in range(1500)], "page_id int, html string").coalesce(1)
    found = {r.page_id: r for r in shred(pages).select("page_id", F.col("text").cast("string").alias("text"), F.size("nodes").alias("n")).collect()}
    assert all(found[i].text == (None if whole[i]["text"] is None else whole[i]["text"].decode()) and found[i].n == len(whole[i]["nodes"]) for i in range(1500))

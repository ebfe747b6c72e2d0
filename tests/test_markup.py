"""The page helper: repairs, text slices, and the interval laws every operator relies on."""

import re

from hypothesis import given, settings, strategies as st

from webloom.dom.markup import page_nodes


def outline(html):
    """(depth, tag, text) per node, without the implied frame."""
    page = page_nodes(html)
    text = b"".join(page.chunks)
    return [(page.depth[i] - 2, page.tag[i], text[page.text_start[i]:page.text_start[i] + page.text_len[i]].decode())
            for i in range(len(page.tag)) if page.tag[i] not in ("html", "head", "body")]


def test_frame_is_implied():
    for html in ("", "<p>x", "<body>x", "x"):
        assert page_nodes(html).tag[:3] == ["html", "head", "body"]


def test_unclosed_paragraph_and_inline_reopen():
    assert outline("<p><b>one<br><p>two</p><p>three") == [
        (0, "p", "one"), (1, "b", "one"), (2, "br", ""),
        (0, "p", "two"), (1, "b", "two"), (0, "p", "three"), (1, "b", "three")]


def test_at_most_three_equal_inline_elements_reopen():
    tags = [tag for _, tag, _ in outline("<p><b><b><b><b><b>x<p>y")]
    assert tags.count("b") == 5 + 3


def test_misnested_inline_end_tag():
    assert outline("<b>a<i>b</b>c</i>d") == [(0, "b", "ab"), (1, "i", "b"), (0, "i", "c")]


def test_list_items_and_definitions_close_each_other():
    assert outline("<ul><li>a<li>b<ul><li>c</ul></ul>") == [
        (0, "ul", "abc"), (1, "li", "a"), (1, "li", "bc"), (2, "ul", "c"), (3, "li", "c")]
    assert [t for _, t, _ in outline("<dl><dt>a<dd>b<dt>c")] == ["dl", "dt", "dd", "dt"]


def test_table_wrappers():
    assert outline("<table><tr><td><b>x<td>y</table>") == [
        (0, "table", "xy"), (1, "tbody", "xy"), (2, "tr", "xy"), (3, "td", "x"), (4, "b", "x"), (3, "td", "y")]


def test_raw_text_keeps_markup_as_text():
    assert outline('<script>var t="</p>";if(a<b){}</script><p>x') == [
        (0, "script", 'var t="</p>";if(a<b){}'), (0, "p", "x")]
    assert outline("<body><textarea>\n<b>x</textarea>") == [(0, "textarea", "<b>x")]
    assert outline("<title>a &amp; <b>") == [(0, "title", "a & <b>")]


def test_references():
    assert outline("<p>&amp;&copy;&#233;&#x41;&nope;&lt")[0][2] == "&©éA&nope;<"
    page = page_nodes('<a href="?a=1&copy=2&amp;b=&lt;">x</a>')
    assert page.attrs[3]["href"] == "?a=1&copy=2&b=<"


def test_attributes():
    page = page_nodes("""<P ID=one Class='a b' title=it's data-x = "q" hidden id=two>x""")
    assert page.attrs[3] == {"id": "one", "class": "a b", "title": "it's", "data-x": "q", "hidden": ""}


def test_comments_and_declarations():
    assert outline("<!DOCTYPE html><!-- <p>no</p> --><p>yes<!-->!<?php x ?></p>") == [(0, "p", "yes!")]
    assert outline("<p>a<!-- open") == [(0, "p", "a")]


def test_empty_paragraph_for_stray_end_tag():
    assert outline("<div>a</p>b</div>") == [(0, "div", "ab"), (1, "p", "")]


def test_void_and_self_closing():
    assert outline("<div/>a<br/>b<svg><path/><g>c</g></svg>") == [
        (0, "div", "abc"), (1, "br", ""), (1, "svg", "c"), (2, "path", ""), (2, "g", "c")]


def test_inline_end_tag_does_not_close_a_block():
    assert outline("<span><div>a</span>b</div>c</span>d") == [(0, "span", "abc"), (1, "div", "ab")]
    assert outline("<div><span>a</div>b") == [(0, "div", "a"), (1, "span", "a")]
    assert outline("<my-card><p>a</my-card>b") == [(0, "my-card", "ab"), (1, "p", "ab")]


def test_nested_links_close():
    assert outline("<a href=1>x<a href=2>y") == [(0, "a", "x"), (0, "a", "y")]


def test_text_offsets_count_bytes():
    page = page_nodes("<p>é</p><p>日本</p>")
    assert [(page.text_start[i], page.text_len[i]) for i in (3, 4)] == [(0, 2), (2, 6)]


PIECES = st.sampled_from(
    "<p> </p> <b> </b> <i> </i> <li> <ul> </ul> <div> </div> <a> </a> <table> <tr> <td> </table> <br> <h1> </h1> "
    "<script> </script> <form> </form> <option> <select> </select> <!-- --> </body> é &amp; < > text".split(" "))


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join))
def test_interval_laws(html):
    page = page_nodes(html)
    size, total = len(page.tag), page.offset
    assert page.parent[0] == -1 and page.last[0] == size - 1
    for node in range(size):
        assert node <= page.last[node] < size
        assert 0 <= page.text_start[node] and page.text_start[node] + page.text_len[node] <= total
        if node:
            parent = page.parent[node]
            assert parent < node and page.depth[node] == page.depth[parent] + 1
            assert page.last[node] <= page.last[parent]
            assert page.text_start[parent] <= page.text_start[node]
            assert (page.text_start[node] + page.text_len[node]
                    <= page.text_start[parent] + page.text_len[parent])
    b"".join(page.chunks).decode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/ab p\"'=&;!-\n", max_size=60))
def test_any_text_is_accepted(html):
    page = page_nodes(html)
    assert page.tag[:2] == ["html", "head"]
    assert re.fullmatch(r"[\s\S]*", b"".join(page.chunks).decode())


BLANKS = "\u00a0\x0b\x85\u2003\x1c"


def page_text(html):
    return b"".join(page_nodes(html).chunks).decode()


def test_other_blanks_in_a_tag_lose_no_text():
    assert page_text('<p>one</p><a href="x"\u00a0>link</a><p>two</p>') == "onelinktwo"
    assert page_text("<p>one</p><br\x0b/><i\x85>two</i>") == "onetwo"
    page = page_nodes('<a href=x\u00a0y class="a\u00a0b c">z</a>')
    assert page.attrs[3] == {"href": "x\u00a0y", "class": "a\u00a0b c"}


def test_only_the_end_of_input_ends_a_page():
    assert page_text('<p>one</p><a href="x" <p>two</p>') == "onetwo"
    assert page_text('<p>one</p><a = "b" =>two</a>') == "onetwo"
    assert page_text("<p>one</p><a href='x'") == "one"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "div", "p", "li", "span", "td"]),
                          st.lists(st.sampled_from([" ", "\t", "\n", "/", "=", "x", 'y="1"', "z='2'", "w=3", *BLANKS]), max_size=6)), max_size=12))
def test_text_between_tags_is_never_lost(tags):
    html = "".join(f"t{i}<{tag}{''.join([' ', *parts])}>" for i, (tag, parts) in enumerate(tags))
    assert page_text(html + "end") == "".join(f"t{i}" for i in range(len(tags))) + "end"


def test_deep_nesting_is_linear():
    import time

    def seconds(depth):
        begin = time.process_time()
        page_nodes("<div><b>" * depth)
        return time.process_time() - begin

    seconds(1000)
    assert seconds(16000) < 8 * seconds(4000) + 0.2

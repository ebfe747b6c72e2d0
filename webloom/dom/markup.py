"""Page-to-node helper used inside the shredding UDF.

One forward pass over the tags of a single page.  Nodes are emitted in
pre-order while an open-element stack supplies the repairs browsers make:
implied head and body, void elements, implied end tags, re-opened inline
formatting.  Two repairs are left out, on purpose: re-parenting of content
misplaced inside tables, and of blocks inside a misnested inline end tag.
"""

from __future__ import annotations

import re
from html import unescape

# Fixed values from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE_RAW_TEXT = frozenset("textarea title".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form header hgroup hr li listing main menu nav ol p plaintext pre search section summary "
    "table ul xmp".split()
)
SCOPE = frozenset("applet caption html marquee object table td template th".split())
SPECIAL = CLOSES_P | SCOPE | frozenset("body button iframe noembed noframes script select style tbody textarea tfoot "
                                       "thead title tr".split())
MARKERS = frozenset("applet caption marquee object td th".split())
# How deep a table part nests below its table; wrappers left out by the author are opened.
TABLE_LEVEL = {"table": 0, "tbody": 1, "thead": 1, "tfoot": 1, "colgroup": 1, "caption": 1,
               "tr": 2, "col": 2, "td": 3, "th": 3}
# A start tag of the key closes an open element of the values, searched up to a boundary.
SIBLING_CLOSE = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "button": (("button",), ()),
    "rt": (("rt", "rp"), ("ruby", "rtc")),
    "rp": (("rt", "rp"), ("ruby", "rtc")),
}

# White space is what the standard calls so; other blanks belong to names and values.
MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\t\n\f\r />]*)|!--|[!?/])")
ATTRIBUTE = re.compile(r"""([^\t\n\f\r />][^\t\n\f\r />=]*)"""
                       r"""(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)"|'([^']*)'|([^\t\n\f\r >"'][^\t\n\f\r >]*)))?""")
BEFORE_ATTRIBUTE = re.compile(r"[\t\n\f\r /]*")
COMMENT_END = re.compile(r"--!?>")
ATTR_REFERENCE = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?=?")


def attribute_text(raw: str) -> str:
    """Decode references; in attributes a bare name before '=' stays as written."""
    if "&" not in raw:
        return raw
    return ATTR_REFERENCE.sub(lambda m: m[0] if m[0].endswith("=") else unescape(m[0]), raw)


class PageNodes:
    """Nodes of one page as parallel lists, plus the page text as UTF-8."""

    def __init__(self) -> None:
        self.tag, self.parent, self.depth, self.attrs = [], [], [], []
        self.last, self.text_start, self.text_len = [], [], []
        self.chunks, self.offset = [], 0
        self.open = []          # node ids, outermost first; a node stands at its own depth
        self.is_open = set()
        self.open_tags = {}     # how many open elements per tag, so most searches end at once
        self.formatting = []    # node ids to re-open; None marks a boundary
        self.in_body = False

    # -- stack primitives -------------------------------------------------
    def push(self, tag: str, attrs: dict | None = None) -> int:
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.open[-1] if self.open else -1)
        self.depth.append(len(self.open))
        self.attrs.append(attrs or {})
        self.last.append(node)
        self.text_start.append(self.offset)
        self.text_len.append(0)
        self.open.append(node)
        self.is_open.add(node)
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        return node

    def pop(self) -> str:
        node = self.open.pop()
        self.is_open.discard(node)
        self.last[node] = len(self.tag) - 1
        self.text_len[node] = self.offset - self.text_start[node]
        self.open_tags[self.tag[node]] -= 1
        if self.tag[node] in MARKERS and None in self.formatting:
            while self.formatting.pop() is not None:
                pass
        return self.tag[node]

    def pop_through(self, position: int) -> None:
        while len(self.open) > position:
            self.pop()

    def find_open(self, names, boundary=SCOPE) -> int:
        """Position of the innermost open element with one of the names, or -1."""
        if not any(self.open_tags.get(name) for name in names):
            return -1
        for position in range(len(self.open) - 1, 1, -1):
            tag = self.tag[self.open[position]]
            if tag in names:
                return position
            if tag in boundary:
                return -1
        return -1

    def close(self, names, boundary=SCOPE) -> bool:
        position = self.find_open(names, boundary)
        if position > 0:
            self.pop_through(position)
        return position > 0

    # -- document frame ---------------------------------------------------
    def need_html(self) -> None:
        if not self.tag:
            self.push("html")

    def need_head(self) -> None:
        self.need_html()
        if len(self.tag) == 1:
            self.push("head")

    def need_body(self, attrs: dict | None = None) -> None:
        if not self.in_body:
            self.need_head()
            self.pop_through(1)
            self.push("body", attrs)
            self.in_body = True

    # -- content ----------------------------------------------------------
    def text(self, text: str) -> None:
        if not text:
            return
        if not self.in_body and len(self.open) < 3:
            stripped = text.lstrip("\t\n\f\r ")
            if stripped:
                blank, text = text[: len(text) - len(stripped)], stripped
                if len(self.tag) > 1:
                    self.emit(blank)
                self.need_body()
            elif len(self.tag) < 2:
                return
        if self.in_body and not text.isspace():
            self.reopen_formatting()
        self.emit(text)

    def emit(self, text: str) -> None:
        encoded = text.encode("utf-8", "replace")
        self.chunks.append(encoded)
        self.offset += len(encoded)

    def reopen_formatting(self) -> None:
        entries = self.formatting
        start = len(entries)
        while start and entries[start - 1] is not None and entries[start - 1] not in self.is_open:
            start -= 1
        for i in range(start, len(entries)):
            entries[i] = self.push(self.tag[entries[i]], self.attrs[entries[i]])

    def remember_formatting(self, node: int) -> None:
        same = []
        for i in range(len(self.formatting) - 1, -1, -1):
            other = self.formatting[i]
            if other is None:
                break
            if self.tag[other] == self.tag[node] and self.attrs[other] == self.attrs[node]:
                same.append(i)
        if len(same) == 3:      # at most three equal entries stay remembered
            del self.formatting[same[-1]]
        self.formatting.append(node)

    def start(self, tag: str, attrs: dict, self_closing: bool) -> None:
        if tag == "html":
            if self.tag:
                self.attrs[0] = {**attrs, **self.attrs[0]}
            else:
                self.push("html", attrs)
            return
        if not self.in_body and len(self.open) < 3:
            if tag == "head":
                self.need_html()
                if len(self.tag) == 1:
                    self.push("head", attrs)
                return
            if tag == "body":
                return self.need_body(attrs)
            if tag in HEAD_ONLY:
                self.need_head()
                self.push(tag, attrs)
                if tag in VOID:
                    self.pop()
                return
            self.need_body()
        if tag in ("head", "body"):
            return
        if tag in CLOSES_P:
            self.close(("p",), SCOPE | {"button"})
        if tag in HEADINGS and self.tag[self.open[-1]] in HEADINGS:
            self.pop()
        if tag in SIBLING_CLOSE:
            names, boundary = SIBLING_CLOSE[tag]
            self.close(names, SCOPE | set(boundary))
        if tag in TABLE_LEVEL and tag != "table":
            if not self.find_open(("table",), ("template",)) > 0:
                return
            self.enter_table_part(tag)
        elif tag in ("a", "nobr"):
            self.end_formatting(tag)
        if tag not in TABLE_LEVEL and tag not in CLOSES_P:
            self.reopen_formatting()
        node = self.push(tag, attrs)
        if tag in VOID or (self_closing and self.find_open(("svg", "math")) > 0):
            self.pop()
        elif tag in FORMATTING:
            self.remember_formatting(node)
        elif tag in MARKERS:
            self.formatting.append(None)

    def enter_table_part(self, tag: str) -> None:
        level = TABLE_LEVEL[tag]
        while TABLE_LEVEL.get(self.tag[self.open[-1]], 9) >= level:
            self.pop()
        for missing in range(TABLE_LEVEL[self.tag[self.open[-1]]] + 1, level):
            self.push("colgroup" if tag == "col" else ("tbody", "tr")[missing - 1])

    def end_formatting(self, tag: str) -> None:
        for i in range(len(self.formatting) - 1, -1, -1):
            node = self.formatting[i]
            if node is None:
                return
            if self.tag[node] == tag:
                del self.formatting[i]
                if node in self.is_open:
                    position = self.depth[node]
                    if not any(self.tag[n] in CLOSES_P or self.tag[n] in SCOPE for n in self.open[position + 1:]):
                        self.pop_through(position)
                return

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return self.need_body()
        if tag == "head":
            self.need_head()
            if not self.in_body:
                self.pop_through(1)
            return
        if tag == "br":
            return self.start("br", {}, False)
        if not self.in_body and len(self.open) < 3:
            if tag == "p":
                self.need_body()
            else:
                return
        if tag == "p":
            if not self.close(("p",), SCOPE | {"button"}):
                self.push("p")
                self.pop()
        elif tag in FORMATTING:
            self.end_formatting(tag)
        elif tag in HEADINGS:
            self.close(HEADINGS)
        elif tag in TABLE_LEVEL:
            self.close((tag,), ("table", "template"))
        elif tag == "li":
            self.close(("li",), SCOPE | {"ol", "ul"})
        elif tag in CLOSES_P or tag in MARKERS or tag == "button":
            self.close((tag,))
        elif tag not in VOID:
            self.close((tag,), SPECIAL)

    def finish(self) -> "PageNodes":
        self.need_body()
        self.pop_through(0)
        return self


def read_tag(html: str, position: int):
    """Attributes of a start tag whose name ends at position; None only where the input ends inside the tag."""
    if html.startswith(">", position):
        return {}, False, position + 1
    attrs: dict[str, str] = {}
    while True:
        position = BEFORE_ATTRIBUTE.match(html, position).end()
        if position >= len(html):
            return None
        if html[position] == ">":
            return attrs, html[position - 1] == "/", position + 1
        found = ATTRIBUTE.match(html, position)  # any other character begins a name
        name, *values = found.groups()
        value = next((v for v in values if v is not None), "")
        attrs.setdefault(name.lower(), attribute_text(value))
        position = found.end()


def page_nodes(html: str) -> PageNodes:
    page = PageNodes()
    if "\r" in html:
        html = html.replace("\r\n", "\n").replace("\r", "\n")
    html = html.replace("\0", "")
    position = 0
    while position < len(html):
        found = MARKUP.search(html, position)
        if found is None:
            break
        page.text(unescape(html[position:found.start()]))
        slash, name = found.groups()
        if name is None:
            position = _skip_declaration(html, found)
            continue
        tag = name.lower()
        parsed = read_tag(html, found.end())
        if parsed is None:
            return page.finish()
        attrs, self_closing, position = parsed
        if slash:
            page.end(tag)
            continue
        before = len(page.tag)
        page.start(tag, attrs, self_closing)
        if len(page.tag) == before:
            continue
        if tag in RAW_TEXT or tag in ESCAPABLE_RAW_TEXT:
            position = _raw_text(page, html, tag, position)
        elif tag == "pre" and html.startswith("\n", position):
            position += 1
    page.text(unescape(html[position:]))
    return page.finish()


def _skip_declaration(html: str, found: re.Match) -> int:
    if found[0] != "<!--":
        end = html.find(">", found.end())
        return len(html) if end < 0 else end + 1
    if html.startswith((">", "->"), found.end()):
        return html.index(">", found.end()) + 1
    end = COMMENT_END.search(html, found.end())
    return len(html) if end is None else end.end()


def _raw_text(page: PageNodes, html: str, tag: str, position: int) -> int:
    close = re.compile(rf"</{tag}(?=[\t\n\f\r />])[^>]*>?", re.I).search(html, position)
    body = html[position:close.start() if close else len(html)]
    if tag in ESCAPABLE_RAW_TEXT:
        body = unescape(body[1:] if tag == "textarea" and body.startswith("\n") else body)
    if body:
        page.emit(body)
    page.pop()
    return close.end() if close else len(html)

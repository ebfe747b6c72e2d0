"""CSS selectors compiled to Catalyst expressions over a page's node array.

Grammar: ``*``, tag, ``.class``, ``#id``, ``[attr]``, ``[attr=value]`` with the
operators ``= ~= |= ^= $= *=``, compounds, descendant, ``>`` and comma lists.
Anything else raises.

Catalyst merges projections into lambda bodies, where they would run once per
array element.  ``let`` binds a value to a lambda variable first, so each
array here is computed once per page.  Containment uses counts over sorted
positions, never a pairwise scan, so cost stays near-linear in the page size.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from webloom.dom.shred import slice_text
from webloom.functions.binding import let

QUALIFIER = re.compile(
    r"""([.#])([\w-]+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([\w-]+))\s*)?\]""")
TAG = re.compile(r"\*|[a-zA-Z][\w-]*")
COMBINATOR = re.compile(r"\s*([>,])\s*|\s+")
SLIM = ("pre", "last", "parent", "text_start", "text_len")


def parse(selector: str) -> list[list[tuple[str, list[str]]]]:
    """Alternatives; each a list of (combinator, tests on a node ``n``) from left to right."""
    selector = selector.strip()
    alternatives, steps, combinator, position = [], [], " ", 0
    while True:
        tests, position = _compound(selector, position)
        steps.append((combinator, tests))
        if position == len(selector):
            return [*alternatives, steps]
        found = COMBINATOR.match(selector, position)
        if found is None:
            raise ValueError(f"unsupported selector: {selector!r}")
        combinator, position = found[1] or " ", found.end()
        if combinator == ",":
            alternatives.append(steps)
            steps, combinator = [], " "


def _compound(selector: str, position: int) -> tuple[list[str], int]:
    start, tests = position, []
    tag = TAG.match(selector, position)
    if tag is not None:
        position = tag.end()
        if tag[0] != "*":
            tests.append(f"n.tag = {_literal(tag[0].lower())}")
    while found := QUALIFIER.match(selector, position):
        position = found.end()
        mark, name, attribute, operator, *values = found.groups()
        if mark == ".":
            tests.append(f"array_contains(n.classes, {_literal(name)})")
        elif mark == "#":
            tests.append(f"n.id_attr <=> {_literal(name)}")
        elif operator is None:
            tests.append(f"map_contains_key(n.attrs, {_literal(attribute.lower())})")
        else:
            tests.append(_value_test(attribute.lower(), operator, next(v for v in values if v is not None)))
    if position == start:
        raise ValueError(f"unsupported selector: {selector!r}")
    return tests, position


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _value_test(attribute: str, operator: str, value: str) -> str:
    held, wanted = f"element_at(n.attrs, {_literal(attribute)})", _literal(value)
    if operator == "=":
        return f"{held} = {wanted}"
    if operator == "|=":
        return f"({held} = {wanted} or startswith({held}, {_literal(value + '-')}))"
    if value == "" or (operator == "~=" and re.search(r"\s", value)):
        return "false"
    if operator == "~=":
        return f"array_contains(split({held}, {_literal(chr(92) + 's+')}), {wanted})"
    function = {"^=": "startswith", "$=": "endswith", "*=": "contains"}[operator]
    return f"{function}({held}, {wanted})"


def _compound_nodes(tests: list[str]) -> Column:
    """The nodes that pass all tests, as slim structs."""
    slim = ", ".join(f"n.{f} as {f}" for f in SLIM)
    return F.expr(f"transform(filter(nodes, n -> {' and '.join(tests) or 'true'}), n -> struct({slim}))")


def count_below(values: Column, points: Column) -> Column:
    """For each point, in order: how many values are smaller.

    One sort of both arrays; a point's rank among the values is its place in
    the sorted list less the points before it.
    """
    def tagged(kind):
        return lambda x, i: F.struct(x.alias("at"), F.lit(kind).alias("kind"), i.alias("i"))

    merged = F.sort_array(F.concat(F.transform(points, tagged(0)), F.transform(values, tagged(1))))
    placed = F.transform(merged, lambda e, place: F.struct(
        e["i"].alias("i"), place.alias("place"), e["kind"].alias("kind")))
    ranked = F.transform(
        F.filter(placed, lambda e: e["kind"] == 0),
        lambda e, before: F.struct(e["i"].alias("i"), (e["place"] - before).alias("n")))
    return F.transform(F.sort_array(ranked), lambda e: e["n"])


def _related(upper: Column, lower: Column, combinator: str) -> Column:
    """The lower nodes that have an upper node as parent, or as a proper ancestor."""
    def keep(pair: Column) -> Column:
        up, down = pair["up"], pair["down"]
        if combinator == ">":
            parents = F.transform(down, lambda n: n["parent"])
            opened = count_below(F.transform(up, lambda n: n["pre"]), F.transform(parents, lambda p: p + 1))
            closed = count_below(F.transform(up, lambda n: n["pre"]), parents)
        else:
            here = F.transform(down, lambda n: n["pre"])
            opened = count_below(F.transform(up, lambda n: n["pre"]), here)
            closed = count_below(F.transform(up, lambda n: n["last"]), here)
        inside = F.zip_with(opened, closed, lambda a, b: a > b)
        return F.array_compact(F.zip_with(down, inside, lambda n, ok: F.when(ok, n)))

    return let(F.struct(upper.alias("up"), lower.alias("down")), keep)


def matches(selector: str) -> Column:
    """Matching nodes in document order, as an array of slim node structs."""
    found = []
    for steps in parse(selector):
        result = None
        for combinator, tests in steps:
            here = _compound_nodes(tests)
            result = here if result is None else _related(result, here, combinator)
        found.append(result)
    return found[0] if len(found) == 1 else F.array_sort(F.array_distinct(F.concat(*found)))


def with_text(body: Callable[[Column], Column]) -> Column:
    """``body(text)`` with the page text read once: a binary column is copied at every read."""
    return let(F.col("text"), body)


def texts(found: Column, text: Column) -> Column:
    """Text of each node of an array of slim nodes."""
    return F.transform(found, lambda n: slice_text(text, n))


def within(containers: Column, found: Column, body: Callable[[Column], Column]) -> Column:
    """Per container, ``body(the matches strictly inside it)``; aligned with ``containers``.

    Matches are in document order, so those inside one container are a slice.
    """
    def per_container(pair: Column) -> Column:
        position = F.transform(pair["found"], lambda n: n["pre"])
        bounds = F.concat(F.transform(pair["outer"], lambda c: c["pre"] + 1),
                          F.transform(pair["outer"], lambda c: c["last"] + 1))
        count = F.size(pair["outer"])
        return let(count_below(position, bounds), lambda n: F.zip_with(
            F.slice(n, F.lit(1), count), F.slice(n, count + 1, count),
            lambda a, b: body(F.slice(pair["found"], a + 1, b - a))))

    return let(F.struct(containers.alias("outer"), found.alias("found")), per_container)


def nearest_ancestor(nodes: Column, node: Column, test: Callable[[Column], Column]) -> Column:
    """Id of the closest proper ancestor that passes the test, or null: a walk up the parents."""
    walked = F.aggregate(
        F.sequence(F.lit(0), node["depth"]), node["parent"],
        lambda at, _: F.when((at < 0) | test(F.get(nodes, at)), at).otherwise(F.get(nodes, at)["parent"]))
    return F.when(walked >= 0, walked)


def match_rows(shredded: DataFrame, selector: str, *keep: str) -> DataFrame:
    """One row per match: ``pre, last, parent`` and the element's text."""
    rows = with_text(lambda text: F.transform(matches(selector), lambda n: F.struct(
        n["pre"].alias("pre"), n["last"].alias("last"), n["parent"].alias("parent"),
        slice_text(text, n).alias("content"))))
    return shredded.select(*keep, F.inline(rows))


def descendant_pairs(shredded: DataFrame, outer: str, inner: str, *keep: str) -> DataFrame:
    """JON-6: (container, matched element) pairs, for elements inside a container."""
    def rows(text: Column, containers: Column) -> Column:
        grouped = within(containers, matches(inner), lambda found: F.transform(found, lambda m: F.struct(
            m["pre"].alias("pre"), slice_text(text, m).alias("content"))))
        return F.flatten(F.zip_with(containers, grouped, lambda o, found: F.transform(found, lambda m: F.struct(
            o["pre"].alias("outer_pre"), m["pre"].alias("pre"), m["content"].alias("content")))))

    pairs = with_text(lambda text: let(matches(outer), lambda containers: rows(text, containers)))
    return shredded.select(*keep, F.inline(pairs))

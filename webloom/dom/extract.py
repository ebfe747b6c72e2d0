"""Record extraction (EXT): selector matches to rows, all inside the page row.

Each function is ``DataFrame -> DataFrame`` over shredded pages.  Records are
built as arrays and exploded last, so page text and node arrays are never
copied per record and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from webloom.dom.css import matches, nearest_ancestor, texts, with_text, within
from webloom.dom.shred import slice_text
from webloom.functions.binding import let
from webloom.functions.text import signature, unicode_trim


def joined_text(found: Column, text: Column) -> Column:
    """AGG-8: text of all matches in document order, no separator; nested matches count twice."""
    return F.array_join(texts(found, text), "")


def _check(fields: Mapping[str, str]) -> None:
    if not fields:
        raise ValueError("no fields given")


def page_fields(shredded: DataFrame, selectors: Sequence[str], *keep: str) -> DataFrame:
    """EXT-1: (field, content) per page; fields whose trimmed text is empty are dropped."""
    entries = with_text(lambda text: F.array(*[
        F.struct(F.lit(s).alias("field"), unicode_trim(joined_text(matches(s), text)).alias("content"))
        for s in selectors]))
    return shredded.select(*keep, F.inline(F.filter(entries, lambda e: e["content"] != "")))


def page_record(shredded: DataFrame, fields: Mapping[str, str], *keep: str) -> DataFrame:
    """EXT-2: one record per page that has a document; a field without text is ''."""
    _check(fields)
    record = with_text(lambda text: F.struct(*[
        unicode_trim(joined_text(matches(s), text)).alias(name) for name, s in fields.items()]))
    return shredded.select(*keep, F.inline(F.when(F.col("text").isNotNull(), F.array(record))))


def _container_entries(containers: Column, fields: Mapping[str, str], text: Column) -> Column:
    """Per container: its id and, per field, the number of matches inside and their raw text."""
    columns = [within(containers, matches(s),
                      lambda found: F.struct(F.size(found).alias("n"), joined_text(found, text).alias("raw")))
               for s in fields.values()]
    zipped = F.arrays_zip(F.transform(containers, lambda c: c["pre"]), *columns)
    return F.transform(zipped, lambda z: F.struct(
        z["0"].alias("container_pre"),
        *[z[str(i + 1)].alias(name) for i, name in enumerate(fields)]))


def _present(entry: Column, fields: Mapping[str, str]) -> Column:
    result = F.lit(False)
    for name in fields:
        result = result | entry[name].isNotNull()
    return result


def _records(containers: Column, fields: Mapping[str, str], value, drop_empty: bool) -> Column:
    _check(fields)
    entries = with_text(lambda text: let(containers, lambda c: _container_entries(c, fields, text)))
    records = F.transform(entries, lambda e: F.struct(
        e["container_pre"].alias("container_pre"), *[value(e[name]).alias(name) for name in fields]))
    if drop_empty:
        records = F.filter(records, lambda r: _present(r, fields))
    return records


def _present_text(field: Column) -> Column:
    return F.when(field["raw"] != "", unicode_trim(field["raw"]))


def container_rows(shredded: DataFrame, container: str, fields: Mapping[str, str], *keep: str) -> DataFrame:
    """EXT-3: one row per container; a field without text is ''."""
    rows = _records(matches(container), fields, lambda f: unicode_trim(f["raw"]), drop_empty=False)
    return shredded.select(*keep, F.inline(rows))


def container_records(shredded: DataFrame, container: str, fields: Mapping[str, str], *keep: str) -> DataFrame:
    """EXT-7: records of containers with at least one present field.

    A field is present when its raw text is not empty, so white space alone gives ''.
    """
    return shredded.select(*keep, F.inline(_records(matches(container), fields, _present_text, drop_empty=True)))


def record_arrays(shredded: DataFrame, container: str, fields: Mapping[str, str], *keep: str) -> DataFrame:
    """SNK-10: the EXT-7 records of a page as one JSON array; built in the page row, so no grouping."""
    records = _records(matches(container), fields, _present_text, drop_empty=True)
    bare = F.transform(records, lambda r: F.struct(*[r[name].alias(name) for name in fields]))
    return shredded.select(*keep, F.to_json(bare).alias("records"))


def single_match_records(shredded: DataFrame, container: str, fields: Mapping[str, str], *keep: str) -> DataFrame:
    """EXT-8: as EXT-7, but a field counts only when exactly one element matches in the container."""
    rows = _records(matches(container), fields, lambda f: F.when(f["n"] == 1, _present_text(f)), drop_empty=True)
    return shredded.select(*keep, F.inline(rows))


def parent_records(shredded: DataFrame, fields: Mapping[str, str], *keep: str) -> DataFrame:
    """EXT-6: for every match of any selector, the fields read inside its parent; duplicates stay."""
    _check(fields)
    parents = F.concat(*[
        F.transform(F.filter(matches(s), lambda m: m["parent"] >= 0),
                    lambda m: F.struct(m["parent"].alias("pre"), F.get(F.col("nodes.last"), m["parent"]).alias("last")))
        for s in fields.values()])

    def value(field: Column) -> Column:
        trimmed = unicode_trim(field["raw"])
        return F.when(trimmed != "", trimmed)

    return shredded.select(*keep, F.inline(_records(parents, fields, value, drop_empty=True)))


def positional_zip(shredded: DataFrame, fields: Mapping[str, str], *keep: str) -> DataFrame:
    """EXT-4: the i-th match of each field forms row i, untrimmed.

    Short fields are padded with ''; a field without any match is null throughout.
    """
    _check(fields)
    lists = with_text(lambda text: F.struct(*[texts(matches(s), text).alias(name) for name, s in fields.items()]))

    def rows(lists: Column) -> Column:
        zipped = F.arrays_zip(*[lists[name] for name in fields])
        return F.transform(zipped, lambda z, i: F.struct(i.alias("row"), *[
            F.when(F.size(lists[name]) > 0, F.coalesce(z[name], F.lit(""))).alias(name) for name in fields]))

    return shredded.select(*keep, F.inline(let(lists, rows)))


def longest_field(shredded: DataFrame, fields: Mapping[str, str], *keep: str) -> DataFrame:
    """AGG-9: the longest match list of a page, over its fields."""
    _check(fields)
    sizes = F.array(*[F.size(matches(s)) for s in fields.values()])
    return shredded.select(*keep, F.array_max(sizes).alias("max_len"))


def single_field_rows(shredded: DataFrame, fields: Mapping[str, str], *keep: str) -> DataFrame:
    """EXT-5: one row per matched element, trimmed; empty text is kept."""
    _check(fields)
    entries = with_text(lambda text: F.concat(*[
        F.transform(texts(matches(s), text), lambda t: F.struct(
            F.lit(name).alias("field"), unicode_trim(t).alias("content")))
        for name, s in fields.items()]))
    return shredded.select(*keep, F.inline(entries))


def pages_without_matches(shredded: DataFrame, fields: Mapping[str, str], *keep: str) -> DataFrame:
    """EXT-5: the pages that fail because no selector matches at all.

    Rows are dropped by an empty array: a filter on parsed columns would parse every page twice.
    """
    _check(fields)
    found = F.lit(0)
    for s in fields.values():
        found = found + F.size(matches(s))
    return shredded.select(F.inline(F.when(found == 0, F.array(F.struct(*keep)))))


def grouped_records(shredded: DataFrame, groups: Mapping[str, tuple[str, Mapping[str, str]]],
                    *keep: str) -> DataFrame:
    """EXT-13: several named (container, fields) groups read in one pass over the pages."""
    parts = []
    for group, (container, fields) in groups.items():
        _check(fields)
        entries = with_text(lambda text: let(matches(container), lambda c: _container_entries(c, fields, text)))
        parts.append(F.transform(entries, lambda e: F.struct(
            F.lit(group).alias("group"), e["container_pre"].alias("container_pre"),
            F.map_from_arrays(F.array(*[F.lit(n) for n in fields]),
                              F.array(*[unicode_trim(e[n]["raw"]) for n in fields])).alias("record"))))
    return shredded.select(*keep, F.inline(F.concat(*parts)))


def link_titles(shredded: DataFrame, outer: str, title: str, *keep: str, link: str | None = None,
                site: str = "") -> DataFrame:
    """EXT-10: link and title pairs; skipped when either is missing or blank.

    The link is the ``href`` of the outer element, or of the first ``link`` match inside it;
    the title is the text of the first ``title`` match inside it.
    """
    def first(found: Column) -> Column:
        return F.get(found, F.lit(0))

    def entries(containers: Column, text: Column) -> Column:
        own = F.transform(containers, lambda c: c["pre"])
        source = own if link is None else within(containers, matches(link), lambda found: first(found)["pre"])
        titles = within(containers, matches(title), lambda found: slice_text(text, first(found)))
        return F.transform(F.arrays_zip(source, titles), lambda z: F.struct(
            F.element_at(F.get(F.col("nodes"), z["0"])["attrs"], "href").alias("href"),
            unicode_trim(z["1"]).alias("title")))

    pairs = with_text(lambda text: let(matches(outer), lambda containers: entries(containers, text)))
    found = F.filter(pairs, lambda e: (e["href"] != "") & (e["title"] != ""))
    return shredded.select(*keep, F.inline(F.transform(found, lambda e: F.struct(
        F.concat(F.lit(site), e["href"]).alias("link"), e["title"].alias("title")))))


def _own_selector(node: Column) -> Column:
    return (F.when(F.coalesce(node["id_attr"], F.lit("")) != "",
                   F.concat(node["tag"], F.lit("#"), node["id_attr"]))
            .otherwise(signature(node["tag"], node["classes"])))


def common_ancestor(shredded: DataFrame, fields: Mapping[str, str], *keep: str) -> DataFrame:
    """EXT-9: the deepest element that holds every match, and its selector.

    A page where some field has no match gets a null ancestor and the list of those fields.
    """
    _check(fields)

    def describe(lists: Column) -> Column:
        spans = F.flatten(F.array(*[lists[name] for name in fields]))
        missing = F.array_compact(F.array(*[
            F.when(F.size(lists[name]) == 0, F.lit(name)) for name in fields]))
        lo, hi = F.array_min(spans), F.array_max(spans)
        ancestor = let(F.struct(lo.alias("lo"), hi.alias("hi")), lambda b: F.element_at(
            F.filter(F.col("nodes"), lambda n: (n["pre"] <= b["lo"]) & (n["last"] >= b["hi"])), -1))
        node = F.when(F.size(missing) == 0, ancestor)
        return let(node, lambda n: F.struct(
            n["pre"].alias("lca_pre"), F.when(n.isNotNull(), _own_selector(n)).alias("lca_selector"),
            missing.alias("missing")))

    lists = F.struct(*[F.transform(matches(s), lambda m: m["pre"]).alias(name) for name, s in fields.items()])
    return shredded.select(*keep, F.inline(F.array(let(lists, describe))))


def generalized_selectors(shredded: DataFrame, target: str, *keep: str) -> DataFrame:
    """EXT-11: nearest class-bearing ancestor's signature, a space, the element's own signature."""
    nodes = F.col("nodes")

    def describe(match: Column) -> Column:
        def full(node: Column) -> Column:
            near = nearest_ancestor(nodes, node, lambda n: F.size(n["classes"]) > 0)
            return let(F.get(nodes, near), lambda up: F.struct(
                node["pre"].alias("pre"),
                F.concat(F.when(up.isNotNull(), F.concat(signature(up["tag"], up["classes"]), F.lit(" ")))
                         .otherwise(F.lit("")),
                         signature(node["tag"], node["classes"])).alias("selector")))

        return let(F.get(nodes, match["pre"]), full)

    return shredded.select(*keep, F.inline(F.transform(matches(target), describe)))


def click_targets(shredded: DataFrame, target: str, *keep: str) -> DataFrame:
    """EXT-12: an element inside an anchor stands for the nearest anchor."""
    nodes = F.col("nodes")

    def describe(match: Column) -> Column:
        def full(node: Column) -> Column:
            anchor = nearest_ancestor(nodes, node, lambda n: n["tag"] == "a")
            return F.struct(node["pre"].alias("pre"),
                            F.when(node["tag"] == "a", node["pre"])
                            .otherwise(F.coalesce(anchor, node["pre"])).alias("target_pre"))

        return let(F.get(nodes, match["pre"]), full)

    return shredded.select(*keep, F.inline(F.transform(matches(target), describe)))


def repeated_containers(shredded: DataFrame, at_least: int, *keep: str) -> DataFrame:
    """AGG-10: groups of siblings with equal ``tag.classes`` under one parent, with their count.

    Sorted keys and run boundaries, so a page with very many siblings stays n log n.
    """
    keys = F.sort_array(F.transform(F.col("nodes"), lambda n: F.struct(
        n["parent"].alias("parent_pre"), signature(n["tag"], n["classes"]).alias("signature"))))

    def runs(keys: Column) -> Column:
        def is_start(key: Column, i: Column) -> Column:
            return (i == 0) | (key != F.get(keys, i - 1))

        marked = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"), is_start(k, i).alias("s")))
        return let(F.filter(marked, lambda m: m["s"]), lambda starts: F.transform(starts, lambda m, i: F.struct(
            m["k"]["parent_pre"].alias("parent_pre"), m["k"]["signature"].alias("signature"),
            (F.coalesce(F.get(starts, i + 1)["i"], F.size(keys)) - m["i"]).alias("n"))))

    groups = F.filter(let(keys, runs), lambda g: (g["n"] >= at_least) & (g["parent_pre"] >= 0))
    return shredded.select(*keep, F.inline(groups))


def page_selectors(shredded: DataFrame, *keep: str) -> DataFrame:
    """DDP-4: distinct ``(name, selector)`` of a page: ``id_x -> #x`` and ``class_x -> .x``."""
    def named(values: Column, prefix: str, mark: str) -> Column:
        return F.transform(values, lambda v: F.struct(
            F.concat(F.lit(prefix), v).alias("name"), F.concat(F.lit(mark), v).alias("selector")))

    nodes = F.col("nodes")
    ids = F.array_compact(F.transform(nodes, lambda n: n["id_attr"]))
    classes = F.flatten(F.transform(nodes, lambda n: n["classes"]))
    return shredded.select(*keep, F.inline(F.concat(
        named(F.array_distinct(ids), "id_", "#"), named(F.array_distinct(classes), "class_", "."))))


def raw_selectors(shredded: DataFrame, *keep: str) -> DataFrame:
    """DDP-5: every class attribute (whole) and id as written, in document order, repeats kept."""
    def of_node(node: Column) -> Column:
        def entry(name: str, mark: str, slot: int) -> Column:
            value = F.try_element_at(node["attrs"], F.lit(name))
            return F.when(value != "", F.struct(node["pre"].alias("pre"), F.lit(slot).alias("slot"),
                                                F.concat(F.lit(mark), value).alias("selector")))

        return F.array_compact(F.array(entry("class", ".", 0), entry("id", "#", 1)))

    return shredded.select(*keep, F.inline(F.flatten(F.transform(F.col("nodes"), of_node))))

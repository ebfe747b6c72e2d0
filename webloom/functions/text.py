"""SCL string and array expressions: all built-in, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The code points with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\u000b\f\r \u0085             "
    "    　"
)

# Elements that cover a page and are always tried first.
BLOCKERS = (
    "button.accept-cookies", "div.modal-close", "button.close-popup", ".overlay-dismiss", ".interstitial-dismiss",
)


def unicode_trim(text: Column) -> Column:
    """SCL-1: trim every Unicode white-space character, not only the space."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def upper_values(record: Column) -> Column:
    """SCL-2: upper-case each value of a string map; null values stay null."""
    return F.transform_values(record, lambda _, v: F.upper(v))


def token(text: Column, separator: str, position: int) -> Column:
    """SCL-3: 1-based token after a literal split; null past the end."""
    return F.get(F.split(text, F.lit(f"\\Q{separator}\\E"), -1), F.lit(position - 1))


def split_list(text: Column) -> Column:
    """Comma list to trimmed, non-empty items; null text counts as empty."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), ","), unicode_trim)
    return F.filter(items, lambda item: item != "")


def add_selectors(base: Column, extra: Column) -> Column:
    """SET-2: ordered union of a list and a comma list, first occurrence kept."""
    return F.array_union(base, split_list(extra))


def add_if_absent(selectors: Column, item: Column) -> Column:
    """SET-3: append unless present."""
    return F.when(F.array_contains(selectors, item), selectors).otherwise(F.array_append(selectors, item))


def remove_at(selectors: Column, position: Column) -> Column:
    """SET-3: drop the item at a 0-based position; other copies of it stay."""
    return F.filter(selectors, lambda _, i: i != position)


def strip_marker(selector: Column, marker: str = "highlight") -> Column:
    """SCL-5: drop the marker class, keeping the space before what follows."""
    return F.regexp_replace(selector, F.lit(rf"\.\Q{marker}\E\b"), F.lit(""))


def container_of(selectors: Column) -> Column:
    """SCL-6: the first selector names the container."""
    return F.get(selectors, F.lit(0))


def numbered_fields(selectors: Column) -> Column:
    """SCL-6: the other selectors become ``field1, field2, ...``."""
    rest = F.slice(selectors, 2, F.greatest(F.size(selectors) - 1, F.lit(0)))
    return F.map_from_entries(F.transform(
        rest, lambda s, i: F.struct(F.concat(F.lit("field"), (i + 1).cast("string")), s)))


def decode_base64(payload: Column) -> Column:
    """SCL-9: base64 text to UTF-8 text; null when it is not base64."""
    return F.try_to_binary(payload, F.lit("base64")).cast("string")


def site_key(origin: Column) -> Column:
    """SCL-10: file-safe name of a site."""
    bare = F.regexp_replace(origin, F.lit("https?://"), F.lit(""))
    return F.regexp_replace(bare, F.lit("[/:]"), F.lit("_"))


def with_site(site: str, link: Column) -> Column:
    """SCL-11: prefix a site to a relative link."""
    return F.concat(F.lit(site), link)


def signature(tag: Column, classes: Column) -> Column:
    """SCL-13: ``tag.class1.class2``."""
    return F.array_join(F.concat(F.array(tag), classes), ".")


def topic_name(prefix: str, user: Column) -> Column:
    """SCL-14: ``workflow_<user>`` and the like."""
    return F.concat_ws("_", F.lit(prefix), user.cast("string"))


def fill_actions(fields: Column, uploads: tuple[str, ...] = ("resume",)) -> Column:
    """SCL-15: field list to actions: ``upload(x)`` for file fields, else ``fill(x)``."""
    def action(field: Column) -> Column:
        return F.concat(F.when(field.isin(*uploads), "upload(").otherwise("fill("), field, F.lit(")"))

    return F.array_join(F.transform(F.split(fields, ", "), action), ", ")


def price_in_cents(credits: Column) -> Column:
    """SCL-17: one credit costs one hundred cents."""
    return credits * 100

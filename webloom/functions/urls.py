"""SCL-4 and URL helpers as built-in string expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from webloom.functions.binding import let

# Links that count as absolute already, the shape of a scheme, a link attribute,
# and the characters a URL path keeps unescaped.
ABSOLUTE = r"^(?:http|//)"
SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
LINK_ATTRIBUTE = r'(?:src|href)="[^"]*"'
UNESCAPED = r"[\x21-\x7e&&[^\x22<>`{}]]"


def origin(url: Column) -> Column:
    """``scheme://host[:port]`` of a URL, '' when there is none."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+", 0)


def escaped(link: Column) -> Column:
    """Percent-escape what a URL path does not keep, as its UTF-8 bytes; clean links pass as they are."""
    def escape(char: Column) -> Column:
        code = F.regexp_replace(F.hex(F.encode(char, "UTF-8")), "(..)", "%$1")
        return F.when(char.rlike(f"^{UNESCAPED}$"), char).otherwise(code)

    return F.when(link.rlike(f"^{UNESCAPED}*\\z"), link).otherwise(
        F.array_join(F.transform(F.split(link, ""), escape), ""))


def absolute_link(link: Column, base: Column) -> Column:
    """One link resolved against an origin: rooted and relative forms both land under it."""
    clean = F.btrim(F.regexp_replace(link, F.lit(r"[\t\n\r]"), F.lit("")))
    inside = F.regexp_replace(clean, F.lit(r"^/?(?:\.{1,2}/)*"), F.lit(""))
    return (F.when(link.rlike(ABSOLUTE), link).when(clean.rlike(SCHEME), clean)
            .otherwise(F.concat(base, F.lit("/"), escaped(inside))))


def absolute_links_in(html: Column, base: Column) -> Column:
    """SCL-4 on page text: rewrite double-quoted ``src`` and ``href`` values.

    The text is cut at the link attributes, each is rewritten, and the parts are joined again:
    one pass over the text, whatever its length.
    """
    def rewrite(attribute: Column) -> Column:
        return let(F.split(attribute, '"', 3), lambda cut: F.concat(
            F.get(cut, F.lit(0)), F.lit('"'), absolute_link(F.get(cut, F.lit(1)), base), F.lit('"')))

    attributes = F.transform(F.regexp_extract_all(html, F.lit(LINK_ATTRIBUTE), F.lit(0)), rewrite)
    between = F.split(html, LINK_ATTRIBUTE, -1)
    return F.array_join(F.flatten(F.zip_with(
        between, attributes, lambda text, link: F.array(text, F.coalesce(link, F.lit(""))))), "")

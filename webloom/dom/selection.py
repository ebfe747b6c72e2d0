"""A selection request: which records to read from a page, as JSON or as Python values."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from webloom.dom.css import parse
from webloom.dom.extract import container_records, grouped_records

FIELDS = "fields"


@dataclass(frozen=True)
class Selection:
    url: str
    groups: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    container: str = ""
    blockers: str = ""
    pagination: str = ""
    pages: int = 1

    @classmethod
    def from_json(cls, text: str) -> "Selection":
        """Parse a request body; a missing or non-positive page count means one page (PRJ-9)."""
        body = json.loads(text)
        pages = body.get("pages")
        return cls(body["url"], body.get("groups") or {}, body.get("lcaSelector") or "", body.get("blockers") or "",
                   body.get("paginationSelector") or "", pages if isinstance(pages, int) and pages > 0 else 1)

    @classmethod
    def from_selectors(cls, url: str, selectors: list[str]) -> "Selection":
        """SCL-6: the first selector is the container, the others are ``field1``, ``field2``, ..."""
        if not selectors:
            raise ValueError("no selectors given")
        fields = {f"field{i}": s for i, s in enumerate(selectors[1:], 1)}
        return cls(url, {FIELDS: fields}, selectors[0])

    def records(self, shredded: DataFrame, *keep: str) -> DataFrame:
        """EXT-7 for the ``fields`` group inside the container."""
        if not self.groups.get(FIELDS):
            raise ValueError("no field group 'fields' in the selection")
        parse(self.container)
        return container_records(shredded, self.container, self.groups[FIELDS], *keep)

    def group_records(self, shredded: DataFrame, *keep: str) -> DataFrame:
        """EXT-13: every group, each with its own ``container`` field."""
        groups = {}
        for name, fields in self.groups.items():
            rest = {f: s for f, s in fields.items() if f != "container"}
            groups[name] = (fields.get("container", ""), rest)
            parse(groups[name][0])
        if not groups:
            raise ValueError("no groups in the selection")
        return grouped_records(shredded, groups, *keep)

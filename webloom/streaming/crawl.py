"""EXT-14: a stream of pages to flat record messages.

Shredding and extraction work inside the page row, so the stream is stateless; every page of
every batch is sent.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from webloom.dom.extract import container_records
from webloom.dom.shred import shred
from webloom.sinks.messages import record_messages


def page_messages(pages: DataFrame, container: str, fields: Mapping[str, str], *keep: str) -> DataFrame:
    records = container_records(shred(pages), container, fields, *keep)
    return record_messages(records.drop("container_pre"))

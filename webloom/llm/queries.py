"""All registered queries of this folder."""

from webloom.llm import (  # noqa: F401
    compression, decontaminate, jaccard, language_model, lengths, mixing, parsing, periodic, ranked, recompression, secrets, surrogates, warc)
from webloom.llm.registry import ORACLE, QUERIES  # noqa: F401

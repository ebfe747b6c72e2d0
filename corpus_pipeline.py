"""A corpus pipeline: quality, near copies, benchmark passages, personal data, mixing.

Each stage takes the rows that the one before it kept and is written before the next one reads it, so a
lost executor costs one stage at most. All stages but the last return the columns of ``documents``;
so does the last, with the rows it drew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.compression import keep_sound
from webloom.llm.decontaminate import keep_uncontaminated
from webloom.llm.jaccard import one_of_each
from webloom.llm.mixing import sample
from webloom.llm.registry import table
from webloom.llm.surrogates import QUERY_SECRET, protect
from webloom.runtime import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the word rules and the compression bands."""
    return keep_sound(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, as op10's contract has them: four-word shingles, 85 percent in common."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without benchmark passages."""
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced and lengths counted anew."""
    safe = protect(docs, QUERY_SECRET)
    if "n_chars" not in safe.columns:
        return safe
    return safe.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target shares of sources, languages and topics."""
    return sample(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination),
          ("personal_data", personal_data), ("mixing", mixing)]

ORACLE_SQL = None  # zstandard ratios have no SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that come out of all stages."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

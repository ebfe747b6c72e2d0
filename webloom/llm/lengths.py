"""Exact length histogram: how many documents have each encoded length, and all that follows from it.

Every whole text is encoded with a public tokenizer and only its length is kept; lengths are counted within each
Arrow batch, then over the corpus. The histogram has one row per distinct length. Suffix sums over it
(documents and tokens of at least a length) answer, exactly and without another look at the texts, the total
of tokens, any quantile, and the total that remains when all documents are cut at any context limit.

Suffix sums are taken within blocks of ``BLOCK`` lengths and over the block totals, so no task sees more rows
than a block of lengths has, or there are blocks.

Null and empty texts have length 0. Rows count as often as they are there. An empty table gives an empty
histogram, ties are one row. Very long texts are encoded whole, one at a time. Only the text is read. The vocabulary file is read once, by the driver, and sent along (under 1 MB).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.registry import query, table
from webloom.runtime import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# The split pattern that this vocabulary was made with; fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 4096
# White space as the pattern has it (a property of Unicode; fixed value), in runs too long for the pattern's look ahead.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{5000,}")

_encoders: dict[int, object] = {}


def encoder(vocabulary: bytes, pattern: str):
    """The tokenizer of a vocabulary file, one for each Python worker."""
    import tiktoken

    key = hash((vocabulary, pattern))
    if key not in _encoders:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        _encoders[key] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def encoded_length(encoding, text: str) -> int:
    """Tokens of a text; a long run of white space is encoded as the one piece that the pattern makes of it.

    That piece is the whole run at the end of a text, and all but its last character elsewhere. Around it the pattern splits anyway.
    """
    total, at = 0, 0
    for run in LONG_BLANK.finditer(text):
        end = run.end() - (run.end() < len(text))
        total += len(encoding.encode_ordinary(text[at:run.start()])) + len(encoding._core_bpe.encode_single_piece(text[run.start():end].encode()))
        at = end
    return total + len(encoding.encode_ordinary(text[at:]))


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(length, n_docs) for every encoded length that occurs."""
    with open(vocabulary, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(content.value, pattern)
        for batch in batches:
            lengths = [encoded_length(encoding, t.as_py() or "") for t in batch.column(0)]
            found, n = np.unique(np.array(lengths, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["length", "n_docs"])

    rows = docs.select(docs[text].alias("text")).mapInArrow(count, "length long, n_docs long")
    return cut(rows.groupBy("length").agg(F.sum("n_docs").alias("n_docs")))  # read more than once


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds to each length the documents and tokens of at least that length, and the tokens left at that limit."""
    rows = histogram.withColumns({"block": F.floor(F.col("length") / BLOCK), "tokens": F.col("length") * F.col("n_docs")})
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    blocks = blocks.select("block", F.coalesce(F.sum("block_docs").over(above), F.lit(0)).alias("docs_above"),
                           F.coalesce(F.sum("block_tokens").over(above), F.lit(0)).alias("tokens_above"), F.sum("block_tokens").over(whole).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.join(blocks, "block").withColumns({
        "docs_at_least": F.col("docs_above") + F.sum("n_docs").over(inside), "tokens_at_least": F.col("tokens_above") + F.sum("tokens").over(inside)})
    return sums.select("length", "n_docs", "docs_at_least", "tokens_at_least",
                       (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("tokens_within"))


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context, docs_cut, tokens_within) for any limits: documents longer than the limit, and the tokens left."""
    total = F.max(F.when(F.col("docs_at_least") > 0, F.col("tokens_at_least")))
    answers = []
    for limit in limits:
        longer = F.col("length") > limit
        docs = F.coalesce(F.max(F.when(longer, F.col("docs_at_least"))), F.lit(0))
        tokens = F.coalesce(F.max(F.when(longer, F.col("tokens_at_least"))), F.lit(0))
        answers.append(F.struct(F.lit(limit).cast("long").alias("context"), docs.alias("docs_cut"), (total - tokens + docs * limit).alias("tokens_within")))
    return sums.agg(F.array(*answers).alias("a")).select(F.inline("a"))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, length): the smallest length that at least this share of the documents does not exceed."""
    docs = sums.agg(F.max("docs_at_least").alias("docs"))
    below = sums.select("length", (F.col("docs_at_least") - F.col("n_docs")).alias("longer"))
    answers = [F.struct(F.lit(s).alias("share"), F.min(F.when(F.col("docs") - F.col("longer") >= F.ceil(F.col("docs") * F.lit(s)), F.col("length"))).alias("length"))
               for s in shares]
    return below.withColumn("docs", docs.scalar()).agg(F.array(*answers).alias("a")).select(F.inline("a"))


@query("op6_length_histogram")
def op6_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_suffix_sums(length_histogram(table(spark, sf_dir, "documents")))

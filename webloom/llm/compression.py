"""Compression bands: text that zstandard shrinks far too well, or hardly at all, is no prose.

A text is compressed whole, and again in fixed chunks. Each length has its own band of accepted
ratios (compressed over raw bytes): short texts never shrink far, long ones always shrink some.
The whole text must lie in the band of its length; and of the chunks, those outside the band of
the chunk length may hold at most half of the bytes, so that a text that is half keyboard noise and
half one repeated line does not pass on its average.

Null and empty texts have no words, fail the base rules and have ratio 0. Rows are judged one by
one: repeated rows get the same verdict twice, ties do not arise, an empty table gives an empty result. A very long
text is handled whole and alone, in memory proportional to it. Other columns of the input are never read by ``compression_report`` and pass unchanged through ``keep_sound``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from webloom.llm.arrays import HEAD, WORD, byte_class, by_text, mix, pieces, runs, strong, totals, windows
from webloom.llm.registry import query, table

#: (bytes from, least ratio, greatest ratio). Prose of four languages at level 3 lies between 0.33 and
#: 0.73 with wide margins to both sides; script in two or three bytes a letter goes down to 0.25.
BANDS = ((0, 0.0, 2.0), (128, 0.30, 1.0), (512, 0.25, 0.85), (2048, 0.20, 0.75), (16384, 0.15, 0.70), (131072, 0.12, 0.65))
CHUNK = 4096
LEVEL = 3
PIECE = 2 << 20
SYMBOL = byte_class(*b"#*$%&|<>")
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, " \
          "kept boolean, ratio double, outside_share double"


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Words, their code points, symbols, repeated lines and words in repeated 3-word windows of each text."""
    inside = WORD[data]
    starts, ends = runs(inside, offsets)
    first = by_text(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    repeated = np.zeros(len(starts), bool)
    if len(starts) > 2:
        whole = np.flatnonzero(text[:-2] == text[2:])
        key = mix(windows(strong(data, starts, ends), 3)[whole] ^ mix(text[whole].astype(np.uint64)))
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        again = whole[count[back] > 1]
        for k in range(3):
            repeated[again + k] = True
    words = np.concatenate([[0], np.cumsum(repeated)])
    line_starts, line_ends = runs(data != 0x0A, offsets)
    filled = np.concatenate([[0], np.cumsum(inside)])
    worded = filled[line_ends] > filled[line_starts]
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_first = by_text(line_starts, offsets)
    line_text = np.repeat(np.arange(len(offsets) - 1), np.diff(line_first))
    key = mix(strong(data, line_starts, line_ends) ^ mix(line_text.astype(np.uint64)))
    _, seen = np.unique(key, return_index=True)
    return {
        "n_words": np.diff(first), "word_chars": totals(inside & HEAD[data], offsets), "n_symbols": totals(SYMBOL[data], offsets),
        "n_dup_lines": np.diff(line_first) - np.bincount(line_text[seen], minlength=len(offsets) - 1),
        "n_repeat_words": words[first[1:]] - words[first[:-1]],
    }


def limits(sizes: np.ndarray, bands) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted([b[0] for b in bands], sizes, "right") - 1
    return np.array([b[1] for b in bands])[at], np.array([b[2] for b in bands])[at]


def ratios(data: np.ndarray, offsets: np.ndarray, bands, chunk: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Ratio of each whole text, and the share of its bytes in chunks outside their band."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False).compress
    raw = memoryview(np.ascontiguousarray(data))
    sizes = np.diff(offsets)
    whole, outside = np.zeros(len(sizes)), np.zeros(len(sizes))
    for k, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if high == low:
            continue
        whole[k] = len(squeeze(raw[low:high])) / (high - low)
        if high - low <= chunk:
            continue
        cuts = np.append(np.arange(low, high, chunk), high)
        parts = np.diff(cuts)
        shares = np.array([len(squeeze(raw[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]) / parts
        least, most = limits(parts, bands)
        outside[k] = parts[(shares < least) | (shares > most)].sum() / (high - low)
    return whole, outside


def verdicts(data: np.ndarray, offsets: np.ndarray, bands=BANDS, chunk: int = CHUNK, level: int = LEVEL) -> dict[str, np.ndarray]:
    found = base_counts(data, offsets)
    words = found["n_words"]
    found["base_failed"] = (words < 50) | (100 * found["n_repeat_words"] > 50 * words)
    whole, outside = ratios(data, offsets, bands, chunk, level)
    least, most = limits(np.diff(offsets), bands)
    found["kept"] = ~found["base_failed"] & (whole >= least) & (whole <= most) & (outside <= 0.5)
    return found | {"ratio": whole, "outside_share": outside}


def compression_report(docs: DataFrame, key: str = "doc_id", text: str = "text", bands=BANDS, chunk: int = CHUNK,
                       level: int = LEVEL) -> DataFrame:
    """One row per input row: its key, the base counts, the verdict and the measured ratios."""
    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    order = T._parse_datatype_string(COLUMNS).names

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text", PIECE):
                found = verdicts(data, offsets, bands, chunk, level)
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(found[c]) for c in order)], names=["key", *order])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *T._parse_datatype_string(COLUMNS)])
    return picked.mapInArrow(report, schema).withColumnRenamed("key", key)


def keep_sound(docs: DataFrame, text: str = "text", bands=BANDS, chunk: int = CHUNK, level: int = LEVEL) -> DataFrame:
    """The rows that pass, with all their columns; column names are not touched."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch, text, PIECE):
                yield rows.filter(pa.array(verdicts(data, offsets, bands, chunk, level)["kept"]))

    return docs.mapInArrow(keep, docs.schema)


@query("op2_compression_bands")
def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_report(table(spark, sf_dir, "documents"))

"""Periodic runs of words: stretches that repeat themselves with a short period, found exactly.

A run is a stretch of consecutive words with smallest period ``q``, of at least ``least`` words and at
least ``times`` periods, that no neighbouring word extends.

1. *Recursive frequency splitting.* Every word of a run occurs at least ``times`` times in it. So a word that
   occurs less often in the current segment is in no run, and splits it; what it leaves is a segment with
   counts of its own, shorter ones than ``least`` are dropped, and this goes on until nothing changes. Ordinary
   prose is gone after a few rounds. All segments of a batch are split at once, and each round looks
   only at segments that the last one changed. After ``ROUNDS`` rounds the scan takes what is left: splitting
   saves work and never changes a result, so texts made to split one word at a time cost no more than that.
2. *Lag scan* of the surviving segments. For k = 1, 2, 4, ... words, equal groups of k words get equal numbers
   (pairs of the numbers before, so equality is exact), and each group knows the lag to its last occurrence
   in the segment. In a run whose smallest period q lies in (k/2, k] that lag is q from the run's second period on, and
   nowhere before it (three periods are enough for that), so each stretch of one constant lag is one maximal run, with its smallest period. The
   work is n log n, whatever the number of periods.

Each row is handled by itself in one pass, without a shuffle. A null or empty text has no words and no
runs; repeated rows give repeated results; ties between runs go to the smallest start, then the smallest
period. An empty table gives an empty result. Very long texts are handled whole and alone: memory is a
few numbers per word of the longest text. Only key and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.arrays import WORD, by_text, pieces, runs
from webloom.llm.registry import query, table

LEAST = 24
TIMES = 3
ROUNDS = 64
PIECE = 2 << 20
SPACES = r"[\x20\x09-\x0D]+"
RUN = "struct<start:long,length:long,period:long>"
COLUMNS = f"n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string"
ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and a number that exactly the equal words share."""
    inside = WORD[data]
    starts, ends = runs(inside, offsets)
    spans = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(spans), pa.py_buffer(data[inside])])
    return starts, ends, words.dictionary_encode().indices.to_numpy().astype(np.int64)


def groups(breaks: np.ndarray) -> np.ndarray:
    """Number of the group of each element; ``breaks`` marks the elements that begin one, but for the first."""
    return np.concatenate([[0], np.cumsum(breaks)])


def frequent_segments(ids: np.ndarray, first: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions that survive the splitting, in order, and the segment of each."""
    width = int(ids.max()) + 1 if len(ids) else 1
    at, segment = np.arange(len(ids)), np.repeat(np.arange(len(first) - 1), np.diff(first))
    stable = []
    for _ in range(ROUNDS):
        size = np.bincount(segment) if len(segment) else np.zeros(0, np.int64)
        long_enough = size[segment] >= least
        at, segment = at[long_enough], segment[long_enough]
        if not len(at):
            break
        _, back, count = np.unique(segment * width + ids[at], return_inverse=True, return_counts=True)
        rare = count[back] < times
        changed = np.bincount(segment, weights=rare) > 0
        stable.append(at[~changed[segment]])
        left = changed[segment] & ~rare
        at, segment = at[left], segment[left]
        if not len(at):
            break
        segment = groups((at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1]))
    at = np.sort(np.concatenate([*stable, at]))
    if not len(at):
        return at, at
    text = np.searchsorted(first, at, "right")
    segment = groups((at[1:] != at[:-1] + 1) | (text[1:] != text[:-1]))
    keep = np.bincount(segment)[segment] >= least
    return at[keep], segment[keep]


def lag_scan(ids: np.ndarray, segment: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs, as places in ``ids``; segments are stretches of it."""
    n, k = len(ids), 1
    found = [np.zeros((3, 0), np.int64)]
    if n:
        ends = np.append(np.flatnonzero(segment[1:] != segment[:-1]) + 1, n)
        end = np.repeat(ends, np.diff(np.append(0, ends)))
        size = np.repeat(np.diff(np.append(0, ends)), np.diff(np.append(0, ends)))
        rank, at = ids, np.arange(n)
    while n and len(at):
        key = rank[at] if k == 1 else rank[at] * (n + 1) + rank[at + k // 2]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        number = np.full(n, -1)
        number[at[order]] = groups(~same)
        here, before = at[order[1:]], at[order[:-1]]
        lag = np.zeros(n, np.int64)
        lag[here] = np.where(same & (segment[here] == segment[before]), here - before, 0)
        i = np.flatnonzero((lag > k // 2) & (lag <= k))
        if len(i):
            cut = np.flatnonzero((i[1:] != i[:-1] + 1) | (lag[i[1:]] != lag[i[:-1]])) + 1
            head, tail = i[np.append(0, cut)], i[np.append(cut - 1, len(i) - 1)]
            q = lag[head]
            start = head - q
            length = tail + k - start
            good = length >= np.maximum(least, times * q)
            found.append(np.stack([start[good], length[good], q[good]]))
        rank, k = number, 2 * k
        at = np.flatnonzero((np.arange(n) + k <= end) & (size >= times * (k // 2 + 1)))
    return tuple(np.concatenate(found, axis=1))


def periodic(data: np.ndarray, offsets: np.ndarray, least: int, times: int):
    """Words per text, runs per text (start, length, period in order of start and period), kept words as bytes per text."""
    starts, ends, ids = numbered_words(data, offsets)
    first = by_text(starts, offsets)
    at, segment = frequent_segments(ids, first, least, times)
    start, length, period = lag_scan(ids[at], segment, least, times)
    place = at[start]
    order = np.lexsort((period, place))
    place, length, period = place[order], length[order], period[order]
    text = np.searchsorted(first, place, "right") - 1
    dropped = np.zeros(len(ids) + 1, np.int64)
    np.add.at(dropped, place + period, 1)
    np.add.at(dropped, place + length, -1)
    keep = np.cumsum(dropped[:-1]) == 0
    return np.diff(first), (text, place - first[text], length, period), joined(data, starts[keep], ends[keep], offsets)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given words of each text, with one space between them: bytes and offsets."""
    first = by_text(starts, offsets)
    sizes = ends - starts + 1  # with the space that follows
    sizes[first[1:][np.diff(first) > 0] - 1] -= 1
    into = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(int(into[-1]), 0x20, np.uint8)
    marks = np.zeros(len(data) + 1, np.int8)
    marks[starts] += 1
    marks[ends] -= 1
    body = np.zeros(len(out) + 1, np.int8)
    body[into[:-1]] += 1
    body[into[:-1] + (ends - starts)] -= 1
    out[np.cumsum(body[:-1], dtype=np.int8).astype(bool)] = data[np.cumsum(marks[:-1], dtype=np.int8).astype(bool)]
    return out, into[first]


def run_report(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per input row: its key, words, runs, the run of greatest length per period, and the text without repetitions.

    ``collapsed`` holds the words that lie in no run after its first period, joined by one space.
    """
    if times < 3:
        raise ValueError("a run needs three periods at least")
    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text", PIECE):
                n_words, (owner, *run), (kept, ends) = periodic(data, offsets, least, times)
                edges = np.searchsorted(owner, np.arange(rows.num_rows + 1))
                strongest: list = [None] * rows.num_rows
                for i in np.unique(owner).tolist():
                    mine = zip(*(x[edges[i]:edges[i + 1]].tolist() for x in run))
                    start, length, period = min(mine, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
                    strongest[i] = {"start": start, "length": length, "period": period}
                listed = pa.ListArray.from_arrays(edges.astype(np.int32), pa.StructArray.from_arrays([pa.array(x) for x in run], fields=list(ARROW_RUN)))
                body = pa.LargeStringArray.from_buffers(len(n_words), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kept)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n_words), listed, pa.array(strongest, ARROW_RUN), body],
                                                 names=["key", "n_words", "runs", "strongest", "collapsed"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *T._parse_datatype_string(COLUMNS)])
    return picked.mapInArrow(report, schema).withColumnRenamed("key", key)


def planted(key: Column, text: Column) -> Column:
    """The text, made periodic from some word on for a tenth of the keys, as the query's contract says."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")
    n, h = F.size(words), F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    repeated = F.concat(F.slice(words, F.lit(1), a), F.slice(cycle, F.lit(1), n - a))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(repeated, " ")).otherwise(text)


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = run_report(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))

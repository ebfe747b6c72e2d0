"""Repeated passages by recompression of the word sequence.

A word is removed when a window of ``width`` consecutive words covers it whose word sequence also starts
anywhere else, in the same document or another one.

*Recompression.* Rounds rename the sequence of each document. A round replaces neighbours (x, y) by one symbol where a bit
of x's name is 0 and the same bit of y's is 1; every fourth round first replaces each maximal run of one symbol. Names
are 128-bit hashes of what they stand for, so that equal token runs and pairs get equal names in all documents and tasks. What a round
does at a place depends on few neighbours only. Each symbol carries the stretch of words that fixed it
(its *support*), and wherever these words stand again, the same symbol stands too. Equal substrings thus share
all symbols in their interior, and equal symbols always stand for equal substrings.

1. *Symbols meet.* On its way up, each place is covered by symbols of growing length. The first to reach ``small``
   words, and the first to reach ``width``, twice ``width`` and so on, are counted over the corpus: their names meet in
   shards, each block of documents gets back one bit for each of its names.
2. *Reveal.* A window that holds the support of a symbol that occurs once is itself the only one of its kind. That
   settles nearly all text that is not repeated. A shared symbol of ``width`` words or more verifies all windows inside it.
3. *Verify.* The windows that are left (those around the ends of long repeats) meet the same way under their own names, and
   each block hears which of its windows others have too. The first block that has a verified symbol
   names the windows inside it as well, once.
4. *Back.* The words that settled windows cover are taken out.

Documents are dealt into blocks once, by key and text, and that exchange is used three times; the rounds exchange
packed names and bits, never text. Blocks and shards are bounded in bytes, but for one longer text; a
passage that a third of the corpus holds is one name per block, so no task gathers its places.

Null and empty texts have no words. Texts shorter than ``width`` words keep all. Keys are only carried along:
null keys, rows that repeat a key, and rows that repeat key and text are documents like others, and
repeated rows remove each other's passages. An empty table gives an empty result. Very long texts are handled whole, in
memory proportional to the longest one. Only key and text are read, so other columns cannot clash.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.arrays import WORD, by_text, flat, mix, runs
from webloom.llm.periodic import joined
from webloom.llm.registry import query, table

WIDTH = 35
SMALL = 4           # words of the symbols that tell which windows are the only ones
BLOCK = 8 << 20     # bytes of text in a block of documents
SHARD = 4 << 20     # bytes of names that meet in a shard
RUN_ROUNDS = 4      # every so many rounds runs are replaced first
ROUNDS = 400        # far more than the longest text needs; fewer would cost time only
KEYS = np.array([[0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], [0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]], np.uint64)
MESSAGE = "shard int, block int, kind int, first binary, second binary, places binary"
ANSWER = "block int, shard int, kind int, bits binary"
SMALL_KIND, LARGE_KIND, WINDOW_KIND, COVER_KIND = range(4)


def combined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Names of pairs; a name is a row of two 64-bit lanes."""
    return mix(mix(x + KEYS[0][:, None]) * KEYS[1][:, None] + mix(y ^ KEYS[1][:, None]))


def word_names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and name of each word."""
    from xxhash import xxh3_128_digest

    inside = WORD[data]
    starts, ends = runs(inside, offsets)
    spans = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(spans), pa.py_buffer(data[inside])]).dictionary_encode()
    names = np.frombuffer(b"".join(map(xxh3_128_digest, words.dictionary.to_pylist())), np.uint64).reshape(-1, 2).T
    return starts, ends, names[:, words.indices.to_numpy()] if len(starts) else np.zeros((2, 0), np.uint64)


def window_names(names: np.ndarray, width: int) -> np.ndarray:
    """The name of each ``width`` consecutive words, by doubling."""
    n, done, span = names.shape[1] - width + 1, 0, 1
    if n <= 0:
        return np.zeros((2, 0), np.uint64)
    total, power = None, names
    while width >= span:
        if width & span:
            part = power[:, done:done + n]
            total = part if total is None else combined(total, part)
            done += span
        if 2 * span <= width:
            power = combined(power[:, :-span], power[:, span:])
        span *= 2
    return total


def recompress(names: np.ndarray, first: np.ndarray, small: int, width: int) -> tuple[tuple, tuple]:
    """Symbols that are the first over their words to reach ``small`` words, and those of ``width`` words and its doubles.

    Small symbols as (name, support begin, support end), large ones as (name, begin, end), in words; ``first`` tells where each document
    begins. Support that reaches over a document's edge ends outside the document.
    """
    n = names.shape[1]
    begin = np.arange(n, dtype=np.int32)
    end = begin + 1
    low, high = begin.copy(), end.copy()
    text = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    opens, closes = first[:-1].astype(np.int32), first[1:].astype(np.int32)
    smalls, larges = [], []

    def note(made: np.ndarray, before: np.ndarray) -> None:
        """Keep new symbols that cross a length; ``before`` is the longest part of each."""
        size = end[made] - begin[made]
        at = made[(before < small) & (size >= small) & (high[made] - low[made] <= width)]
        smalls.append((names[:, at], low[at], high[at]))
        # lengths crossed are width * 2^j
        crossed = (size >= width) & (np.floor(np.log2(np.maximum(size, 1) / width)) > np.floor(np.log2(np.maximum(before, 0.5) / width)).clip(-1))
        at = made[crossed]
        larges.append((names[:, at], begin[at], end[at]))

    for k in range(ROUNDS):
        n = len(begin)
        if n <= 1:
            break
        inner = text[1:] == text[:-1]  # neighbours of one document
        if not inner.any():
            break
        if k % RUN_ROUNDS == 0:
            head = np.append(True, ~(inner & (names[:, 1:] == names[:, :-1]).all(axis=0)))
            at = np.flatnonzero(head)
            last = np.append(at[1:], n) - 1
            # what ends a run on either side is part of its support
            left, right = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            left = np.where(np.append(False, inner)[at], np.minimum(left, low[at - 1]), opens[text[at]] - 1)
            right = np.where(np.append(inner, False)[last], np.maximum(right, high[np.minimum(last + 1, n - 1)]), closes[text[at]] + 1)
            many = np.flatnonzero(last > at)
            part = end[at[many]] - begin[at[many]]
            low, high, begin, end, text, names = left, right, begin[at], end[last], text[at], names[:, at]
            if len(many):
                count = np.broadcast_to((last - at + 1)[many].astype(np.uint64), (2, len(many)))
                names[:, many] = combined(mix(count), names[:, many])
                note(many, part)
            n = len(begin)
            inner = text[1:] == text[:-1]
        side = ((names[0] >> np.uint64(k % 64)) & np.uint64(1)).astype(bool)
        pair = np.append(inner & ~side[:-1] & side[1:], False)
        second = np.append(False, pair[:-1])
        keep = np.flatnonzero(~second)
        # a symbol that finds no partner: the one beside it is part of its support
        next_low, next_high = low.copy(), high.copy()
        alone = np.flatnonzero(~pair & ~second)
        ahead, behind = alone[~side[alone]], alone[side[alone]]
        same = np.append(inner, False)[ahead]
        next_high[ahead] = np.where(same, np.maximum(high[ahead], high[np.minimum(ahead + 1, n - 1)]), closes[text[ahead]] + 1)
        same = np.append(False, inner)[behind]
        next_low[behind] = np.where(same, np.minimum(low[behind], low[behind - 1]), opens[text[behind]] - 1)
        merged = np.flatnonzero(pair)
        part = np.maximum(end[merged] - begin[merged], end[merged + 1] - begin[merged + 1])
        name = combined(names[:, merged], names[:, merged + 1])
        next_low[merged] = np.minimum(low[merged], low[merged + 1])
        next_high[merged] = np.maximum(high[merged], high[merged + 1])
        end[merged] = end[merged + 1]
        names = names.copy()
        names[:, merged] = name
        low, high, begin, end, text, names = next_low[keep], next_high[keep], begin[keep], end[keep], text[keep], names[:, keep]
        place = np.cumsum(~second) - 1
        note(place[merged], part)
    gather = lambda found: tuple(np.concatenate(x, axis=-1) for x in zip(*found)) if found else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    return gather(smalls), gather(larges)


class Block:
    """The documents of a block in an order that follows from their texts, as one byte array."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("twin", "ascending"), ("text", "ascending")])  # what is equal in both is interchangeable here
        self.number = rows.column("block")[0].as_py()
        self.keys = rows.column("key").combine_chunks()
        self.data, self.offsets = flat(rows.column("text").combine_chunks())

    def symbols(self, small: int, width: int) -> tuple[np.ndarray, np.ndarray, tuple, tuple]:
        starts, _, names = word_names(self.data, self.offsets)
        first = by_text(starts, self.offsets)
        return names, first, *recompress(names, first, small, width)


def distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names (rows of lanes) in order, which of them each one is, how often each occurs, and where first."""
    order = np.lexsort(names[::-1])
    ordered = names[:, order]
    new = np.append(True, (ordered[:, 1:] != ordered[:, :-1]).any(axis=0))[:len(order)]
    at = np.flatnonzero(new)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[:, at], back, np.diff(np.append(at, len(order))), order[at]


def edges_of(names: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard begins in sorted names, and the end."""
    borders = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(names[0], borders), [names.shape[1]]])


def messages(block: int, kinds: list[tuple[int, np.ndarray, np.ndarray | None]], bits: int, extra: list[dict]) -> pa.Table:
    """One row per shard and kind: packed names, one or two lanes, and window places."""
    rows = list(extra)
    for kind, names, places in kinds:
        edges = edges_of(names, bits)
        for s in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[s], edges[s + 1]
            rows.append({"shard": s, "block": block, "kind": kind, "first": names[0, a:b].tobytes(),
                         "second": names[1, a:b].tobytes() if len(names) > 1 else b"", "places": places[a:b].tobytes() if places is not None else b""})
    return pa.Table.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()),
                                                        ("first", pa.binary()), ("second", pa.binary()), ("places", pa.binary())]))


def send_symbols(rows: pa.Table, small: int, width: int, bits: int) -> pa.Table:
    """A block's distinct symbols, by shard."""
    block = Block(rows)
    _, _, smalls, larges = block.symbols(small, width)
    return messages(block.number, [(SMALL_KIND, distinct(smalls[0][:1])[0], None), (LARGE_KIND, distinct(larges[0])[0], None)], bits, [])


def meet(rows: pa.Table) -> pa.Table:
    """In a shard: for each block, which of its names another block has too; covers are passed on.

    Of large symbols each block also hears which it is the first to have.
    """
    out = {"block": [], "shard": [], "kind": [], "bits": []}

    def tell(row: dict, answer: bytes) -> None:
        for c, v in zip(out.values(), (row["block"], row["shard"], row["kind"], answer)):
            c.append(v)

    for kind in sorted(set(rows.column("kind").to_pylist())):
        part = rows.filter(pc.equal(rows.column("kind"), kind)).sort_by("block").to_pylist()
        if kind == COVER_KIND:
            for row in part:
                tell(row, row["first"])
            continue
        lanes = ("first",) if kind == SMALL_KIND else ("first", "second")
        names = np.stack([np.frombuffer(b"".join(row[c] for row in part), np.uint64) for c in lanes])
        _, back, count, lead = distinct(names)
        shared, leads, at = (count > 1)[back], np.zeros(len(back), bool), 0
        leads[lead] = True
        for row in part:
            mine, own = shared[at:at + len(row["first"]) // 8], leads[at:at + len(row["first"]) // 8]
            at += len(mine)
            if kind == WINDOW_KIND:
                places = np.frombuffer(row["places"], np.int32)
                tell(row, places[mine & (places >= 0)].tobytes())
            else:
                tell(row, np.packbits(mine if kind == SMALL_KIND else np.concatenate([mine, own])).tobytes())
    return pa.table({"block": pa.array(out["block"], pa.int32()), "shard": pa.array(out["shard"], pa.int32()),
                     "kind": pa.array(out["kind"], pa.int32()), "bits": pa.array(out["bits"], pa.binary())})


def is_shared(names: np.ndarray, answers: list[dict], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each name of a block: does it occur anywhere else, in the block or another one; and those that this block is the first to have."""
    found, back, count, lead = distinct(names)
    shared, own, edges = count > 1, np.zeros(len(count), bool), edges_of(found, bits)
    for row in answers:
        a, b = edges[row["shard"]], edges[row["shard"] + 1]
        told = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
        shared[a:b] |= told[:b - a]
        if row["kind"] == LARGE_KIND:
            own[a:b] = told[b - a:2 * (b - a)]
    return shared[back], lead[own & shared]


def inside(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Marks the places in any of the stretches from ``low`` to before ``high``."""
    marks = np.zeros(n + 1, np.int32)
    some = low < high
    np.add.at(marks, low[some], 1)
    np.add.at(marks, high[some], -1)
    return np.cumsum(marks[:-1]) > 0


def send_windows(rows: pa.Table, answers: pa.Table, small: int, width: int, bits: int) -> pa.Table:
    """What symbols settle, as covered words; and the names of the windows they leave open, by shard."""
    block = Block(rows)
    names, first, (small_names, low, high), (large_names, begin, end) = block.symbols(small, width)
    told = {kind: [r for r in answers.to_pylist() if r["kind"] == kind] for kind in (SMALL_KIND, LARGE_KIND)}
    n = names.shape[1]
    starts = np.ones(n, bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        starts[max(a, b - width + 1):b] = False
    single = ~is_shared(small_names[:1], told[SMALL_KIND], bits)[0]
    alone = inside(n, np.maximum(high[single] - width, 0), low[single] + 1)
    double, own = is_shared(large_names, told[LARGE_KIND], bits)
    repeated = inside(n, begin[double], end[double] - width + 1)
    # the first block to have a verified symbol names its windows once, as others may meet them outside such a symbol
    speaks = inside(n, begin[own], end[own] - width + 1)
    named = np.flatnonzero(starts & ~alone & (~repeated | speaks))
    words = inside(n, named, named + width)  # only these are needed
    found, back, count, _ = distinct(window_names(names[:, words], width)[:, np.cumsum(words)[named] - 1] if len(named) else np.zeros((2, 0), np.uint64))
    often = count[back] > 1
    places = np.full(found.shape[1], -1, np.int32)
    asks = ~often & ~repeated[named]
    places[back[asks]] = named[asks]
    repeated[named[often]] = True
    settled = np.flatnonzero(repeated)
    gone = inside(n, settled, settled + width)
    runs_of = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).astype(np.int32)
    cover = {"shard": -1 - block.number, "block": block.number, "kind": COVER_KIND, "first": runs_of.tobytes(), "second": b"", "places": b""}
    return messages(block.number, [(WINDOW_KIND, found, places)], bits, [cover])


def take_out(rows: pa.Table, answers: pa.Table, width: int) -> pa.Table:
    """Words, removed words and the text that stays, of each document of a block."""
    block = Block(rows)
    starts, ends = runs(WORD[block.data], block.offsets)
    first = by_text(starts, block.offsets)
    low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row in answers.to_pylist():
        at = np.frombuffer(row["bits"], np.int32).astype(np.int64)
        low.append(at[::2] if row["kind"] == COVER_KIND else at)
        high.append(at[1::2] if row["kind"] == COVER_KIND else at + width)
    gone = inside(len(starts), np.concatenate(low), np.concatenate(high))
    removed = np.concatenate([[0], np.cumsum(gone)])[first]
    body, into = joined(block.data, starts[~gone], ends[~gone], block.offsets)
    kept = pa.LargeStringArray.from_buffers(len(block.keys), pa.py_buffer(into.astype(np.int64)), pa.py_buffer(body)).cast(pa.string())
    return pa.table({"key": block.keys, "n_words": np.diff(first), "n_removed": np.diff(removed), "kept": kept})


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, small: int = SMALL) -> DataFrame:
    """One row per input row: its key, words, removed words, and the words that stay, joined by one space."""
    spark = docs.sparkSession
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    some = rows.where("text <> ''")
    total = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(total // BLOCK) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = int(total * 3 // 10 // SHARD).bit_length()
    dealt = some.withColumn("twin", F.xxhash64("key", "text")).select(F.pmod(F.hash("twin"), F.lit(blocks)).alias("block"), "key", "twin", "text")
    by_block = dealt.groupBy("block")
    arrow_kind = dealt.select("key").limit(0).toArrow().schema.field("key").type

    symbols = by_block.applyInArrow(lambda t: send_symbols(t, small, width, bits), MESSAGE)
    answers = symbols.groupBy("shard").applyInArrow(meet, ANSWER)
    windows = by_block.cogroup(answers.groupBy("block")).applyInArrow(
        lambda t, told: send_windows(t, told, small, width, bits) if t.num_rows else messages(0, [], 0, []), MESSAGE)
    found = windows.groupBy("shard").applyInArrow(meet, ANSWER)
    nothing = {"key": pa.array([], arrow_kind), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())}
    schema = dealt.select("key").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    done = by_block.cogroup(found.groupBy("block")).applyInArrow(
        lambda t, told: take_out(t, told, width) if t.num_rows else pa.table(nothing), schema)
    zero = F.lit(0).cast("long")
    empty = rows.where("text = ''").select("key", zero.alias("n_words"), zero.alias("n_removed"), F.col("text").alias("kept"))
    return done.unionAll(empty).withColumnRenamed("key", key)


@query("op12_recompression")
def op12_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

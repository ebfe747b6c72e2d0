"""Repeated passages by prefix-free parsing.

A byte is removed when it lies in a ``length``-byte string that also starts in a document with a smaller
key. No suffix array is built, neither of the dictionary nor of the parse: equal strings are found by filing
them under a k-gram and comparing hashes, as only equality to the depth of ``length`` bytes is asked for.

1. *Parse.* A rolling hash over ``length`` bytes triggers at some positions; a phrase runs from one trigger
   through the next. Every string of ``length`` bytes starts in exactly one phrase and lies inside it, and
   no phrase begins another. Distinct phrases are the dictionary, each owned by the smallest key that
   has it. A phrase seen in a later document is settled by the dictionary alone: all its strings repeat.
   This is what makes copies and common passages cheap: they are one dictionary word however often.
2. *Filing.* What is left are owned phrases, whose suffixes may still begin alike. Each string
   is filed under the k-gram in it with the least rolling hash (equal strings choose equal k-grams). K-grams
   that only one document has are dropped first: their sorted fingerprints meet in shards, and each block
   gets back one bit per fingerprint. The contexts around the others meet by k-gram, in order of their keys, and
   their strings are compared by 64-bit hashes: the first of equal strings has the smallest key, and all
   later ones of other keys repeat it.
3. *Back.* Settled phrases and settled strings become byte ranges of each document.

K-grams with many contexts (those next to a common line, say) are found where fingerprints meet. Their strings
are filed one by one under themselves, once per block, so no task and no memory spans such a k-gram.

Documents are dealt into blocks once; the rounds exchange fingerprints, bits and short contexts, never text.
A block, a shard and an Arrow batch are bounded in bytes, but for one longer text.

Null and empty texts, and texts shorter than ``length``, keep all bytes. Rows without a key keep all
bytes and are nobody's source. Rows that repeat a key have no smaller key than each other, so they
keep what they share. An empty table gives an empty result. Only key and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.arrays import Hasher, flat, mix, names128, pieces, strong
from webloom.llm.registry import query, table
from webloom.runtime import cut

LENGTH = 50
GRAM = 26
TRIGGER = 256        # one position in so many triggers
BLOCK = 8 << 20      # bytes of text in a block of documents
SHARD = 4 << 20      # fingerprints, in bytes, that meet in a shard
SEGMENT = 1 << 15    # bytes hashed at a time: arrays of so many numbers stay in the cache
HOT = 4096           # a k-gram with more contexts than this is split by string
OFTEN = 3            # up to so many contexts of a k-gram in a block count as one
AT_ONCE = 1 << 15    # contexts of split k-grams held as strings at a time, if no single k-gram has more
CONTEXT = "value long, key long, twin long, block int, begins array<long>, context binary, bits long"
CONTEXT_COLUMNS = [c.split()[0] for c in CONTEXT.split(", ")]


def starts_of(offsets: np.ndarray, length: int) -> np.ndarray:
    """Marks the positions at which a whole string of one text starts."""
    marks = np.ones(int(offsets[-1]), bool)
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        marks[max(low, high - length + 1):high] = False
    return marks


def parse(data: np.ndarray, offsets: np.ndarray, length: int, trigger: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases as (text, begin, end, 128-bit name as two columns); ``end`` takes in the closing trigger."""
    triggers = [np.zeros(0, np.int64)]
    valid = starts_of(offsets, length)
    for low in range(0, len(data), SEGMENT):
        part = data[low:low + SEGMENT + length - 1]
        n = len(part) - length + 1
        if n > 0:
            hit = Hasher(part).every(length) % np.uint64(trigger) == 0
            triggers.append(np.flatnonzero(hit & valid[low:low + n]) + low)
    long_enough = np.diff(offsets) >= length
    begins = np.unique(np.concatenate([*triggers, offsets[:-1][long_enough]]))
    text = np.searchsorted(offsets, begins, "right") - 1
    ends = offsets[1:][text].copy()
    inner = np.flatnonzero(text[:-1] == text[1:])
    ends[inner] = begins[inner + 1] + length
    return text, begins, ends, names128(data, begins, ends)


def spread(values: np.ndarray, width: int, choose) -> np.ndarray:
    """The least or greatest of each ``width`` neighbours, doubling the span."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values = choose(values[:-step], values[step:])
        span += step
    return values


def anchors(data: np.ndarray, wanted: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that the wanted strings (marked at their starts) are filed under."""
    places, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    width = length - gram + 1
    for low in range(0, len(data), SEGMENT):
        part = data[low:low + SEGMENT + length - 1]
        chosen = np.flatnonzero(wanted[low:min(low + SEGMENT, low + len(part) - length + 1)]) if len(part) >= length else []
        if not len(chosen):
            continue
        h = Hasher(part).every(gram)
        least = spread(h, width, np.minimum)
        asked = np.zeros(len(h) + width - 1, np.uint64)  # the least hash of each wanted string, at its start, after a margin
        asked[width - 1 + chosen] = least[chosen]
        q = np.flatnonzero(spread(asked, width, np.maximum) == h)  # all k-grams that are the least of a wanted string
        # runs of one letter: of neighbours with equal k-grams some are enough, if each string still has one
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        if not new.all():
            begin = np.flatnonzero(new)
            final, run = np.append(begin[1:] - 1, len(h) - 1), (np.cumsum(new) - 1)[q]
            q = q[((q - begin[run]) % max(1, 2 * width // 3) == 0) | (q == final[run])]
        places.append(q + low)
        values.append(h[q])
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(values)[first]


def expand(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items that count ``n`` each: the item, and the place within it, of everything counted."""
    item = np.repeat(np.arange(len(n)), n)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)


class Block:
    """The documents of a block in a fixed order, as one byte array."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("key", "ascending"), ("twin", "ascending")])
        keys, twins, texts = (rows.column(c).combine_chunks() for c in ("key", "twin", "text"))
        self.keys, self.twins = keys.to_numpy(zero_copy_only=False), twins.to_numpy(zero_copy_only=False)
        self.data, self.offsets = flat(texts)
        new = np.ones(len(self.keys), bool)
        new[1:] = (self.keys[1:] != self.keys[:-1]) | (self.twins[1:] != self.twins[:-1])
        first = np.flatnonzero(new)
        self.names = {name: i for i, name in enumerate(zip(self.keys[first].tolist(), self.twins[first].tolist()))}
        self.first, self.copies = np.append(first, 0), np.append(np.diff(first, append=len(new)), 0)  # the last is for other blocks' names

    def rows(self, messages: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The documents that messages name: pairs of a message and a document, one for each copy in the block."""
        names = zip(*(messages.column(c).to_numpy().tolist() for c in ("key", "twin")))
        name = np.fromiter((self.names.get(x, -1) for x in names), np.int64, len(messages))
        message, copy = expand(self.copies[name])
        return message, self.first[name][message] + copy

    def ranges(self, settled: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Settled phrases as positions in ``data``."""
        message, row = self.rows(settled)
        begin, end = (settled.column(c).to_numpy()[message] for c in ("begin", "end"))
        return self.offsets[row] + begin, self.offsets[row] + end

    def open_strings(self, settled: pa.Table, length: int) -> np.ndarray:
        """Starts of strings in phrases that their own document owns."""
        wanted = starts_of(self.offsets, length)
        for low, high in zip(*(x.tolist() for x in self.ranges(settled))):
            wanted[low:high - length + 1] = False
        return wanted

    def anchors(self, settled: pa.Table, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, value = anchors(self.data, self.open_strings(settled, length), length, gram)
        return place, value, np.searchsorted(self.offsets, place, "right") - 1


def fingerprints(distinct: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each shard begins among distinct hashes in order, and 48 further bits of each."""
    edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(distinct, edges), [len(distinct)]]), (distinct << np.uint64(bits)) >> np.uint64(16)


def pack48(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(np.uint64)


def block_number(rows: pa.Table) -> int:
    return rows.column("block")[0].as_py()


def send(left: pa.Table, settled: pa.Table, length: int, gram: int, bits: int) -> pa.Table:
    """A block's fingerprints, by shard."""
    block = Block(left)
    _, value, _ = block.anchors(settled, length, gram)
    distinct, n = np.unique(value, return_counts=True)
    edges, prints = fingerprints(distinct, bits)
    often = [np.flatnonzero(n[edges[s]:edges[s + 1]] > OFTEN) for s in range(1 << bits)]
    full = [s for s in range(1 << bits) if edges[s + 1] > edges[s]]
    return pa.table({"shard": pa.array(full, pa.int32()), "block": pa.array([block_number(left)] * len(full), pa.int32()),
                     "prints": pa.array([pack48(prints[edges[s]:edges[s + 1]]) for s in full], pa.binary()),
                     "often": pa.array([np.stack([often[s], n[edges[s]:edges[s + 1]][often[s]]]).astype(np.int64).tobytes() for s in full], pa.binary())})


def meet(rows: pa.Table, hot: int) -> pa.Table:
    """In a shard: one bit per fingerprint, set where another block has it too, and the places of those with too many contexts."""
    lists = [unpack48(x) for x in rows.column("prints").to_pylist()]
    distinct, back, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    total, base = n.astype(np.int64), 0
    for own, often in zip(lists, rows.column("often").to_pylist()):
        at, times = np.frombuffer(often, np.int64).reshape(2, -1)
        total[back[base + at]] += times - 1
        base += len(own)
    shared, many = (n > 1)[back], (total > hot)[back]
    edges = np.cumsum([0] + [len(x) for x in lists])
    answers = [np.packbits(shared[a:b]).tobytes() for a, b in zip(edges, edges[1:])]
    split = [np.flatnonzero(many[a:b]).astype(np.int64).tobytes() for a, b in zip(edges, edges[1:])]
    return pa.table({"shard": rows.column("shard"), "block": rows.column("block"), "bits": pa.array(answers, pa.binary()), "split": pa.array(split, pa.binary())})


def split_strings(block: Block, place: np.ndarray, value: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> list[pa.Table]:
    """Rows for contexts of k-grams that are split: each string of a block once, filed under itself, from its smallest key.

    Strings that a smaller key of the block has are settled here, in one row per context.
    """
    raw, tables = block.data, []
    order = np.lexsort((place, value))
    value, text, low, n = value[order], text[order], low[order], np.maximum(high - low - length + 1, 0)[order]
    begins = np.append(np.flatnonzero(np.append(True, value[1:] != value[:-1])), len(value)) if len(value) else np.zeros(1, np.int64)
    at = 0
    while at < len(value):  # whole k-grams
        end = int(max(begins[np.searchsorted(begins, at + AT_ONCE, "right") - 1], begins[np.searchsorted(begins, at, "right")]))
        v, i, a, m = value[at:end], text[at:end], low[at:end], n[at:end]
        at = end
        row = np.repeat(np.arange(len(m)), m)
        j = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
        begin = a[row] + j
        size = np.where(m > 0, m + length - 1, 0)
        start = np.cumsum(size) - size
        flat_ = raw[np.repeat(a - start, size) + np.arange(int(size.sum()))]
        inside = start[row] + j
        name = mix(strong(flat_, inside, inside + length) ^ mix(v.view(np.uint64)[row])).view(np.int64)
        key = block.keys[i][row]
        distinct, first, back = np.unique(name, return_index=True, return_inverse=True)
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, back, key)
        late = key > least[back]
        bits = np.zeros(len(m), np.int64)
        np.bitwise_or.at(bits, row[late], 1 << j[late])
        done = np.flatnonzero(bits)
        tables.append(pa.table({"value": v.view(np.int64)[done] ^ block.keys[i[done]], "key": block.keys[i[done]], "twin": block.twins[i[done]],
                                "begins": pa.ListArray.from_arrays(np.arange(len(done) + 1, dtype=np.int32), pa.array(a[done] - block.offsets[i[done]])),
                                "context": pa.array([b""] * len(done), pa.binary()), "bits": bits[done]}))
        # the smallest key's places of each string, by text
        mine = np.flatnonzero(~late)
        mine = mine[np.lexsort((begin[mine], i[row[mine]], back[mine]))]
        who, string = i[row[mine]], back[mine]
        new = np.ones(len(mine), bool)
        new[1:] = (who[1:] != who[:-1]) | (string[1:] != string[:-1])
        head = np.flatnonzero(new)
        lead = mine[head]
        tables.append(pa.table({"value": name[lead], "key": key[lead], "twin": block.twins[who[head]],
                                "begins": pa.ListArray.from_arrays(np.append(head, len(mine)).astype(np.int32), pa.array(begin[mine] - block.offsets[who])),
                                "context": pa.array([raw[b:b + length].tobytes() for b in begin[lead].tolist()], pa.binary()),
                                "bits": np.zeros(len(lead), np.int64)}))
    return tables


def contexts(left: pa.Table, messages: pa.Table, length: int, gram: int, bits: int) -> pa.Table:
    """The suffixes around k-grams that more than one document has."""
    block = Block(left)
    settled, answers = messages.filter(pc.is_null(messages.column("bits"))), messages.filter(pc.is_valid(messages.column("bits")))
    place, value, text = block.anchors(settled, length, gram)
    distinct, which = np.unique(value, return_inverse=True)
    edges, _ = fingerprints(distinct, bits)
    shared, many = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
    for s, answer, split in zip(*(answers.column(c).to_pylist() for c in ("shard", "bits", "split"))):
        many[edges[s] + np.frombuffer(split, np.int64)] = True
        n = int(edges[s + 1] - edges[s])
        shared[edges[s]:edges[s + 1]] = np.unpackbits(np.frombuffer(answer, np.uint8))[:n].astype(bool)
    owner = block.keys[text]
    least, most = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(least, which, owner)
    np.maximum.at(most, which, owner)
    shared |= least < most
    keep = shared[which]
    place, value, text = place[keep], value[keep], text[keep]
    low = np.maximum(place - (length - gram), block.offsets[text])
    high = np.minimum(place + length, block.offsets[text + 1])
    hot = many[which[keep]]
    parts = split_strings(block, *(x[hot] for x in (place, value, text, low, high)), length)
    place, value, text, low, high = (x[~hot] for x in (place, value, text, low, high))
    # Equal contexts of a block are compared here: only the smallest key's goes out, the others are settled by it.
    order = np.lexsort((text, strong(block.data, low, high), value))  # stable: a document's places stay in order
    place, value, text, low, high = place[order], value[order].view(np.int64), text[order], low[order], high[order]
    raw = block.data.tobytes()
    context = [raw[a:b] for a, b in zip(low.tolist(), high.tolist())]
    other = np.ones(len(order), bool)  # hashes that collide only keep equal contexts apart
    other[1:] = (value[1:] != value[:-1]) | np.array([x != y for x, y in zip(context, context[1:])], bool)
    new = other.copy()
    new[1:] |= text[1:] != text[:-1]
    head = np.flatnonzero(new)
    key = block.keys[text[head]]  # in order of the keys
    late = key > key[np.flatnonzero(other[head])][np.cumsum(other[head]) - 1]
    found = {"value": np.where(late, value[head] ^ key, value[head]), "key": key, "twin": block.twins[text[head]],
             "begins": pa.ListArray.from_arrays(np.append(head, len(order)).astype(np.int32), pa.array(low - block.offsets[text])),
             "context": pa.array([b"" if x else context[h] for x, h in zip(late.tolist(), head.tolist())], pa.binary()),
             "bits": np.where(late, (1 << np.maximum(high - low - length + 1, 0)[head]) - 1, 0)}
    in_place = pa.table(found).take(np.argsort(place[head]))  # neighbours share bytes, which the exchange packs
    whole = pa.concat_tables([in_place, *parts])
    return whole.append_column("block", pa.array([block_number(left)] * len(whole), pa.int32())).select(CONTEXT_COLUMNS)


def settle(batches, length: int):
    """Contexts in order of (k-gram, key): for each, the strings in it that a smaller key has, as bits."""
    last, seen, seen_key = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        for rows, data, offsets in pieces(batch, "context", 1 << 20):
            value = rows.column("value").to_numpy(zero_copy_only=False)
            key = rows.column("key").to_numpy(zero_copy_only=False)
            n = np.maximum(np.diff(offsets) - length + 1, 0)
            row = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begin = offsets[:-1][row] + j
            name = mix(strong(data, begin, begin + length) ^ mix(value.view(np.uint64)[row]))
            carried = last is not None and value[0] == last
            names, keys = (np.concatenate([seen, name]), np.concatenate([seen_key, key[row]])) if carried else (name, key[row])
            distinct, first, back = np.unique(names, return_index=True, return_inverse=True)
            owner = keys[first]
            late = (keys > owner[back])[len(names) - len(name):]
            bits = np.bincount(row[late], weights=(1 << j[late]).astype(np.float64), minlength=len(n)).astype(np.int64)
            goes_on = value[row] == value[-1]
            if carried:
                goes_on = np.concatenate([np.full(len(seen), value[-1] == last), goes_on])
            live = np.unique(back[goes_on])
            last, seen, seen_key = value[-1], distinct[live], owner[live]
            bits |= rows.column("bits").to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(bits)
            take = rows.take(pa.array(hit))
            yield pa.RecordBatch.from_arrays([take.column("block"), take.column("key"), take.column("twin"), take.column("begins"), pa.array(bits[hit])],
                                             names=["block", "key", "twin", "begins", "bits"])


def finish(left: pa.Table, messages: pa.Table, length: int) -> pa.Table:
    """The bytes of each document that are removed."""
    block = Block(left)
    whole = messages.column("strings").is_null()
    low, high = block.ranges(messages.filter(whole))
    cover = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(cover, low, 1)
    np.add.at(cover, high, -1)
    part = messages.filter(pc.invert(whole))
    message, row = block.rows(part)
    n = pc.list_value_length(part.column("begins")).to_numpy().astype(np.int64)
    pair, place = expand(n[message])
    base = block.offsets[row][pair] + pc.list_flatten(part.column("begins")).to_numpy()[(np.cumsum(n) - n)[message][pair] + place]
    bits = part.column("strings").to_numpy()[message][pair]
    first, last = bits & ~(bits << 1), bits & ~(bits >> 1)  # of each run of strings
    for j in range(int(bits.max(initial=0)).bit_length()):
        np.add.at(cover, base[first >> j & 1 == 1] + j, 1)
        np.add.at(cover, base[last >> j & 1 == 1] + j + length, -1)
    gone = np.cumsum(cover[:-1]) > 0
    out = {"key": block.keys, "n_bytes": np.diff(block.offsets), "n_removed": [], "n_spans": [], "kept_sha256": []}
    for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist()):
        mark = gone[a:b]
        out["n_removed"].append(int(mark.sum()))
        out["n_spans"].append(int(mark[:1].sum() + (mark[1:] & ~mark[:-1]).sum()))
        out["kept_sha256"].append(hashlib.sha256(block.data[a:b][~mark].tobytes()).hexdigest())
    return pa.table({"key": pa.array(out["key"], pa.int64()), "n_bytes": pa.array(out["n_bytes"], pa.int64()),
                     "n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()),
                     "kept_sha256": pa.array(out["kept_sha256"], pa.string())})


def settled_phrases(rows: DataFrame, length: int, trigger: int) -> DataFrame:
    """(block, key, twin, begin, end): phrases that a smaller key owns."""
    def phrases(batches):
        for batch in batches:
            for part, data, offsets in pieces(batch, "text", 2 << 20):
                text, begins, ends, names = parse(data, offsets, length, trigger)
                own = part.select(["block", "key", "twin"]).take(pa.array(text))
                yield pa.RecordBatch.from_arrays(
                    [own.column("block"), own.column("key"), own.column("twin"), pa.array(begins - offsets[text]), pa.array(ends - offsets[text]),
                     pa.array(names[:, 0].view(np.int64)), pa.array(names[:, 1].view(np.int64))],
                    names=["block", "key", "twin", "begin", "end", "p", "q"])

    parsed = cut(rows.mapInArrow(phrases, "block int, key long, twin long, begin long, end long, p long, q long"))
    dictionary = parsed.groupBy("p", "q").agg(F.min("key").alias("owner"), F.max("key").alias("most")).where("owner < most").select("p", "q", "owner")
    return cut(parsed.join(dictionary, ["p", "q"]).where("key > owner").select("block", "key", "twin", "begin", "end"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                   trigger: int = TRIGGER, hot: int = HOT) -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    spark = docs.sparkSession
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].cast("long").alias("key"), body.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(total // BLOCK) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = max(0, int(total * 6 * 2 // (length - gram + 2) // SHARD).bit_length())
    keyed = rows.where("key is not null").select(
        F.pmod(F.hash("key"), F.lit(blocks)).alias("block"), "key", F.xxhash64("text").alias("twin"), "text")
    settled = settled_phrases(keyed, length, trigger)
    by_block = keyed.groupBy("block")

    sent = by_block.cogroup(settled.groupBy("block")).applyInArrow(
        lambda left, right: send(left, right, length, gram, bits) if left.num_rows else _empty("shard int, block int, prints binary, often binary"),
        "shard int, block int, prints binary, often binary")
    answers = sent.groupBy("shard").applyInArrow(lambda rows: meet(rows, hot), "shard int, block int, bits binary, split binary")
    nothing = lambda c, t: F.lit(None).cast(t).alias(c)
    told = settled.select("block", "key", "twin", "begin", "end", nothing("shard", "int"), nothing("bits", "binary"), nothing("split", "binary")).union(
        answers.select("block", *(nothing(c, "long") for c in ("key", "twin", "begin", "end")), "shard", "bits", "split"))
    schema = CONTEXT
    around = by_block.cogroup(told.groupBy("block")).applyInArrow(
        lambda left, right: contexts(left, right, length, gram, bits) if left.num_rows else _empty(schema), schema)
    order = around.repartition("value").sortWithinPartitions("value", "key")
    strings = order.mapInArrow(lambda batches: settle(batches, length), "block int, key long, twin long, begins array<long>, bits long")
    found = settled.select("block", "key", "twin", "begin", "end", nothing("begins", "array<long>"), nothing("strings", "long")).union(
        strings.select("block", "key", "twin", nothing("begin", "long"), nothing("end", "long"), "begins", F.col("bits").alias("strings")))
    schema = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    done = by_block.cogroup(found.groupBy("block")).applyInArrow(
        lambda left, right: finish(left, right, length) if left.num_rows else _empty(schema), schema)
    zero = F.lit(0).cast("long")
    keyless = rows.where("key is null").select("key", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"),
                                               zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return done.union(keyless).withColumnRenamed("key", key)


def _empty(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.table({c.split()[0]: pa.array([], kinds[c.split()[1]]) for c in schema.split(", ")})


@query("op7_prefix_free_parsing")
def op7_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))

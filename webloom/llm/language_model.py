"""Language-model scores from a sharded Elias-Fano n-gram trie.

The model is a bigram model over unigrams with Dirichlet smoothing,

    p(w) = (c(w) + 1) / (N + V + 1)        p(w | v) = (c(v w) + m p(w)) / (c(v) + m)

where counts come from all training texts. Nothing grows in one place: documents are dealt into blocks
once, and blocks and shards exchange sorted lists.

1. Each block sends its distinct words with their training counts to shards of the vocabulary; a shard
   sums them, numbers the words, and answers number and count (and its part of N and V) to each block.
2. Each block sends its distinct pairs, by context, to shards of the model. A shard builds a trie of all
   training pairs sent to it, with the quantised c(v w) / (c(v) + m) of each, and answers every pair sent
   by successor search. A context that holds more than a quarter of a shard's share of all tokens has its
   followers spread over all shards by word, so no shard grows with one common word.
3. Each block puts the answers together and sums log10 p over its texts.

Words are told apart by 64-bit hashes. Null and empty texts are scored as the end token alone; rows
without a key are learned from; rows that repeat a key are texts of their own; keys are cast to 64-bit integers. A very long text is a block of its own. With no training text at all every
count is zero and p(w) = 1. An empty table gives an empty result. Only key and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.arrays import LOWER, WORD, by_text, flat, runs, strong
from webloom.llm.eliasfano import PROBABILITY, Trie, quantised
from webloom.llm.registry import query, table

BLOCK = 4 << 20   # bytes of text in a block
SHARD = 8 << 20   # bytes of text for each shard of the vocabulary and of the model
STRENGTH = 100.0  # best on held-out prose between 50 and 200
END, BEGIN = 0x0123456789ABCDEF, 0xFEDCBA9876543210  # hashes of the two marks; no word is asked to avoid them
ID_BYTES = 6  # of a word's number: its shard, and its place among the at most 2^24 words that a shard of text can have
ID_BITS = 8 * ID_BYTES


def pack(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each value, byte by byte plane, so that equal high bytes lie together."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def unpack(data: bytes, size: int) -> np.ndarray:
    wide = np.zeros((len(data) // size, 8), np.uint8)
    wide[:, :size] = np.frombuffer(data, np.uint8).reshape(size, -1).T
    return wide.reshape(-1).view(np.uint64)


class Block:
    """The tokens of a block: ``token`` and ``before`` are indexes into its sorted distinct hashes."""

    def __init__(self, rows: pa.Table, bits: int):
        rows = rows.sort_by([("key", "ascending"), ("twin", "ascending")])
        self.rows = rows
        data, offsets = flat(rows.column("text").combine_chunks())
        data = LOWER[data]
        starts, ends = runs(WORD[data], offsets)
        first = by_text(starts, offsets)
        n = rows.num_rows
        text = np.repeat(np.arange(n), np.diff(first) + 1)
        hashes = np.full(len(starts) + n, END, np.uint64)
        last = first[1:] + np.arange(n)
        inner = np.ones(len(hashes), bool)
        inner[last] = False
        hashes[inner] = strong(data, starts, ends)
        self.hashes, index = np.unique(np.append(hashes, np.uint64(BEGIN)), return_inverse=True)
        self.token, self.before, self.text = index[:-1], np.empty(len(hashes), index.dtype), text
        self.before[1:] = self.token[:-1]
        self.before[first[:-1] + np.arange(n)] = index[-1]
        held = rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        self.training = ~held[text]
        edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)
        self.edges = np.concatenate([[0], np.searchsorted(self.hashes, edges), [len(self.hashes)]]).astype(np.int64)
        self.shard_of = np.repeat(np.arange(1 << bits), np.diff(self.edges))

    def know(self, answers: pa.Table) -> None:
        """Numbers and counts of the distinct words, N and V, from the vocabulary's answers."""
        self.ids, self.counts = np.zeros(len(self.hashes), np.uint64), np.zeros(len(self.hashes), np.int64)
        self.total = self.vocabulary = 0
        for s, ids, counts, n, v in zip(*(answers.column(c).to_pylist() for c in ("shard", "ids", "counts", "n", "v"))):
            self.ids[self.edges[s]:self.edges[s + 1]] = unpack(ids, ID_BYTES)
            self.counts[self.edges[s]:self.edges[s + 1]] = unpack(counts, 8).astype(np.int64)
            self.total += n
            self.vocabulary += v
        self.context_counts = self.counts.copy()
        if len(self.hashes):
            begin, end = np.searchsorted(self.hashes, np.array([BEGIN, END], np.uint64))
            self.context_counts[begin] = self.counts[end]  # every training text begins and ends once

    def pairs(self, bits: int) -> None:
        """Distinct (context, word) in order of (shard, context, word), and where each token finds its own."""
        key, index = np.unique(self.before * len(self.hashes) + self.token, return_inverse=True)
        seen = np.bincount(index[self.training], minlength=len(key))
        context, word = np.divmod(key, max(1, len(self.hashes)))
        hot = self.context_counts * 4 * (1 << bits) >= max(1, self.total)
        shard = np.where(hot[context], self.shard_of[word], self.shard_of[context])
        order = np.argsort(shard, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.pair_context, self.pair_word, self.pair_seen = context[order], word[order], seen[order]
        self.pair_of = place[index]
        self.pair_edges = np.searchsorted(shard[order], np.arange((1 << bits) + 1))


def block_number(rows: pa.Table) -> int:
    return rows.column("block")[0].as_py()


def send_words(rows: pa.Table, bits: int) -> pa.Table:
    block = Block(rows, bits)
    counts = np.bincount(block.token[block.training], minlength=len(block.hashes))
    cuts = list(zip(block.edges[:-1].tolist(), block.edges[1:].tolist()))
    return pa.table({"shard": pa.array(range(len(cuts)), pa.int32()), "block": pa.array([block_number(rows)] * len(cuts), pa.int32()),
                     "words": pa.array([pack(block.hashes[a:b], 8) for a, b in cuts], pa.binary()),
                     "counts": pa.array([pack(counts[a:b], 4) for a, b in cuts], pa.binary())})


def number_words(rows: pa.Table, bits: int) -> pa.Table:
    """In a shard of the vocabulary: number and training count of each word, to every block that has it."""
    lists = [unpack(x, 8) for x in rows.column("words").to_pylist()]
    words, index = np.unique(np.concatenate(lists), return_inverse=True)
    counts = np.zeros(len(words), np.int64)
    np.add.at(counts, index, np.concatenate([unpack(x, 4) for x in rows.column("counts").to_pylist()]).astype(np.int64))
    shard = rows.column("shard")[0].as_py()
    ids = (np.uint64(shard) << np.uint64(ID_BITS - bits)) + np.arange(len(words), dtype=np.uint64)
    edges = np.cumsum([0, *map(len, lists)])
    parts = [index[a:b] for a, b in zip(edges[:-1], edges[1:])]
    # only training counts make a word known; marks of beginnings are never tokens and count zero
    n, v = int(counts.sum()), int((counts > 0).sum())
    return pa.table({"shard": rows.column("shard"), "block": rows.column("block"), "ids": pa.array([pack(ids[p], ID_BYTES) for p in parts], pa.binary()),
                     "counts": pa.array([pack(counts[p], 8) for p in parts], pa.binary()),
                     "n": pa.array([n] * len(parts), pa.int64()), "v": pa.array([v] * len(parts), pa.int64())})


def send_pairs(rows: pa.Table, answers: pa.Table, bits: int) -> pa.Table:
    block = Block(rows, bits)
    block.know(answers)
    block.pairs(bits)
    out = {c: [] for c in ("shard", "contexts", "totals", "sizes", "words", "seen", "often")}
    for s, (a, b) in enumerate(zip(block.pair_edges[:-1].tolist(), block.pair_edges[1:].tolist())):
        if a == b:
            continue
        context, seen = block.pair_context[a:b], block.pair_seen[a:b]
        head = np.ones(b - a, bool)
        head[1:] = context[1:] != context[:-1]
        at = np.flatnonzero(head)
        often = np.flatnonzero(seen >= 255)
        out["shard"].append(s)
        out["contexts"].append(pack(block.ids[context[at]], ID_BYTES))
        out["totals"].append(pack(block.context_counts[context[at]], 8))
        out["sizes"].append(pack(np.diff(np.append(at, b - a)), 4))
        out["words"].append(pack(block.ids[block.pair_word[a:b]], ID_BYTES))
        out["seen"].append(np.minimum(seen, 255).astype(np.uint8).tobytes())
        out["often"].append(pack(np.concatenate([often, seen[often]]), 8))
    n = len(out["shard"])
    return pa.table({"shard": pa.array(out["shard"], pa.int32()), "block": pa.array([block_number(rows)] * n, pa.int32()),
                     **{c: pa.array(out[c], pa.binary()) for c in list(out)[1:]}})


def score_pairs(rows: pa.Table, strength: float) -> pa.Table:
    """In a shard of the model: build its trie from the training pairs, then look every pair up."""
    messages = []
    for contexts, totals, sizes, words, seen, often in zip(*(rows.column(c).to_pylist() for c in ("contexts", "totals", "sizes", "words", "seen", "often"))):
        size = unpack(sizes, 4).astype(np.int64)
        count = np.frombuffer(seen, np.uint8).astype(np.int64)
        many = unpack(often, 8).astype(np.int64).reshape(2, -1)
        count[many[0]] = many[1]
        messages.append((unpack(contexts, ID_BYTES), unpack(totals, 8), unpack(words, ID_BYTES), count, size))
    seen = [m[3] > 0 for m in messages]
    context, total = (np.concatenate([np.repeat(m[i], m[4])[k] for m, k in zip(messages, seen)]) for i in (0, 1))
    word, count = (np.concatenate([m[i][k] for m, k in zip(messages, seen)]) for i in (2, 3))
    order = np.lexsort((word, context))
    context, total, word, count = context[order], total[order], word[order], count[order]
    head = np.ones(len(context), bool)
    head[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(head)
    sums = np.add.reduceat(count, at) if len(at) else count
    trie = Trie([context[at], word[at]], quantised(sums / (total[at].astype(np.float64) + strength)))
    codes = [trie.lookup([m[0]], m[4], m[2]).tobytes() for m in messages]
    trie.close()
    return pa.table({"shard": rows.column("shard"), "block": rows.column("block"), "codes": pa.array(codes, pa.binary())})


def scores(rows: pa.Table, messages: pa.Table, bits: int, strength: float) -> pa.Table:
    is_code = pc.is_valid(messages.column("codes"))
    block = Block(rows, bits)
    block.know(messages.filter(pc.invert(is_code)))
    block.pairs(bits)
    codes = np.zeros(len(block.pair_word), np.uint8)
    answers = messages.filter(is_code)
    for s, answer in zip(answers.column("shard").to_pylist(), answers.column("codes").to_pylist()):
        codes[block.pair_edges[s]:block.pair_edges[s + 1]] = np.frombuffer(answer, np.uint8)
    unigram = (block.counts + 1) / (block.total + block.vocabulary + 1)
    rest = strength / (block.context_counts + strength)
    pair = np.log10(PROBABILITY[codes] + rest[block.pair_context] * unigram[block.pair_word])
    n = block.rows.num_rows
    add = lambda values: np.bincount(block.text, weights=values, minlength=n)
    return pa.table({"key": block.rows.column("key"), "held_out": block.rows.column("held_out"),
                     "n_tokens": pa.array(np.bincount(block.text, minlength=n).astype(np.int64)),
                     "n_known": pa.array(add(block.counts[block.token] > 0).astype(np.int64)),
                     "train_tokens": pa.array(np.full(n, block.total, np.int64)),
                     "base_score": pa.array(add(np.log10(unigram)[block.token])), "score": pa.array(add(pair[block.pair_of]))})


def language_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2,
                    strength: float = STRENGTH) -> DataFrame:
    """One row per input row; texts of one fold of the keys are scored but not learned from."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(docs[key].cast("string").cast("binary")) % folds == fold, F.lit(False))
    rows = docs.select(docs[key].cast("long").alias("key"), held.alias("held_out"), F.coalesce(docs[text], F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(total // BLOCK) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = int(total // SHARD).bit_length()
    rows = rows.select(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)).cast("int").alias("block"), "key", F.xxhash64("text").alias("twin"), "held_out", "text")
    by_block = rows.groupBy("block")
    words = by_block.applyInArrow(lambda t: send_words(t, bits), "shard int, block int, words binary, counts binary")
    known = words.groupBy("shard").applyInArrow(lambda t: number_words(t, bits), "shard int, block int, ids binary, counts binary, n long, v long")
    pairs = by_block.cogroup(known.groupBy("block")).applyInArrow(
        lambda left, right: send_pairs(left, right, bits),
        "shard int, block int, contexts binary, totals binary, sizes binary, words binary, seen binary, often binary")
    codes = pairs.groupBy("shard").applyInArrow(lambda t: score_pairs(t, strength), "shard int, block int, codes binary")
    messages = known.select("*", F.lit(None).cast("binary").alias("codes")).unionByName(codes, allowMissingColumns=True)
    found = by_block.cogroup(messages.groupBy("block")).applyInArrow(
        lambda left, right: scores(left, right, bits, strength),
        "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return found.withColumnRenamed("key", key)


@query("op3_elias_fano_trie")
def op3_elias_fano_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))

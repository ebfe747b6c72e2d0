"""Ranked lexical search over bit-sliced Bloom signatures.

The score of a document for an item sums, over the item's terms, a weight that falls with the number of documents
that hold the term, times a saturating function of its occurrences and of the document's length. All arithmetic
is on 64-bit integers, so that scores are exact and equal on every machine.

1. *Index.* One pass turns documents into blocks of similar size. A block has a bit matrix with a row (slice) per
   hash value and a column per document: a term sets the bits of a few slices, and sets them again under a further name for
   each step of ``STEPS`` that its occurrences reach. The blocks are written once; the same pass counts, for the
   queries' terms, the documents that hold them.
2. *Upper bounds.* For a block and a term, the bitwise and of its slices names all documents that hold it, and some that
   do not; with the steps it bounds the occurrences from above. Summed with their weights, the slices give an
   upper bound of every score in the block, for one block of items after the other.
3. *Thresholds.* The documents with the highest bounds of each item are scored exactly; the worst of the best
   ``top`` scores is what any other document must reach.
4. *Rescoring.* All documents whose bound reaches the threshold of some item are scored from their texts, and the best are
   kept. No other document can be among them, so the result is exact; the signatures only save work.

Items are dealt into blocks of bounded size, which travel to the tasks in closures; every block of items meets every block of the
index. Candidates travel as 64-bit names; they are broadcast when counted to be few, joined by a shuffle if
not. A task keeps at most ``top`` rows per item, so copies and ties do not multiply rows, and no key gathers.

Null and empty texts have no terms: such documents are not counted and never found, such items have no rows. Equal
scores come in order of the key, null last. Rows that repeat a key are ranked each for itself. Items that repeat both key
and text count once; items with one key and different texts have a ranking each. Empty tables on either side give an empty result. Very
long texts are handled whole, a block of their own. Only key and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.arrays import LOWER, byte_class, by_text, flat, mix, pieces, runs
from webloom.llm.registry import query, table
from webloom.runtime import cut

TOP = 10
SEEDS = 16               # documents per item that set its threshold
STEPS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
HASHES = 4
BITS = 12                # bits of a column for each entry
ROWS = 512               # documents of a block
CELLS = 32 << 20         # bits of a block, if it has more than one document
PIECE = 8 << 20
TERMS_AT_ONCE = 500_000  # (item, term) rows in a block of items: some 20 MB in a closure
CHUNK = 8192             # (item, term) rows summed at a time
FEW = 500_000            # names that may be broadcast: 8 bytes each
WANTED = 1 << 20         # hashes of query terms that may go with the indexing pass: 8 bytes each
TERM = byte_class(*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100))
INDEX = "term string, df long, documents long, total long, names array<long>, sizes array<long>, width int, bits binary"
FIELDS = [c.split()[0] for c in INDEX.split(", ")]
ARROW = {"term": pa.string(), "df": pa.int64(), "documents": pa.int64(), "total": pa.int64(), "names": pa.list_(pa.int64()),
         "sizes": pa.list_(pa.int64()), "width": pa.int32(), "bits": pa.binary()}


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of the terms of all texts: text and number of each, and the distinct terms."""
    data = LOWER[data]
    inside = TERM[data]
    starts, ends = runs(inside, offsets)
    first = by_text(starts, offsets)
    spans = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(spans), pa.py_buffer(data[inside])]).dictionary_encode()
    return np.repeat(np.arange(len(offsets) - 1), np.diff(first)), terms.indices.to_numpy().astype(np.int64), terms.dictionary


def hashed(terms: pa.Array) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, terms.to_pylist()), np.uint64, len(terms))


def occurrences(text: np.ndarray, number: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term number) in order, and how often each occurs."""
    pair, tf = np.unique(text * max(1, n_terms) + number, return_counts=True)
    return pair // max(1, n_terms), pair % max(1, n_terms), tf


def slices(term: np.ndarray, step: np.ndarray | int, width: int) -> np.ndarray:
    """The ``HASHES`` slices of each term at a step."""
    h = mix(term + np.uint64(0x9E3779B97F4A7C15) * np.asarray(step, np.uint64))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (((low[None] + np.arange(HASHES, dtype=np.uint64)[:, None] * high) & np.uint64(0xFFFFFFFF)) % np.uint64(width)).astype(np.int64)


def signatures(data: np.ndarray, offsets: np.ndarray, names: np.ndarray, wanted: np.ndarray | None) -> Iterator[dict]:
    """Index rows of some texts: blocks of documents, and the documents of each wanted term."""
    text, number, terms = terms_of(data, offsets)
    size = np.bincount(text, minlength=len(names))
    text, number, tf = occurrences(text, number, len(terms))
    h = hashed(terms)
    df = np.bincount(number, minlength=len(terms))
    pick = np.arange(len(terms)) if wanted is None else np.flatnonzero(np.isin(h, wanted))
    for at in range(0, len(pick), 1 << 16):
        part = pick[at:at + (1 << 16)]
        yield {"term": terms.take(pa.array(part)).cast(pa.binary()).cast(pa.string()), "df": pa.array(df[part])}
    reach = np.searchsorted(STEPS, tf, "right")  # steps that an entry reaches
    entries = np.bincount(text, weights=reach, minlength=len(names)).astype(np.int64)
    first = np.searchsorted(text, np.arange(len(names) + 1))
    order = np.argsort(entries, kind="stable")
    order = order[entries[order] > 0]
    at = 0
    while at < len(order):
        group = order[at:at + ROWS]
        fits = np.maximum(64, BITS * entries[group]) * np.arange(1, len(group) + 1)
        near = entries[group] <= 2 * entries[group[0]]
        group = group[:max(1, int((near & (fits <= CELLS)).sum()))]
        at += len(group)
        width = int(max(64, BITS * entries[group[-1]]))
        marks = np.zeros((width, (len(group) + 7) // 8 * 8), bool)
        mine = np.concatenate([np.arange(first[i], first[i + 1]) for i in group])
        column = np.repeat(np.arange(len(group)), first[group + 1] - first[group])
        for step in range(len(STEPS)):
            reaching = reach[mine] > step
            mine, column = mine[reaching], column[reaching]
            if not len(mine):
                break
            for s in slices(h[number[mine]], step, width):
                marks[s, column] = True
        yield {"documents": pa.array([len(group)]), "total": pa.array([int(size[group].sum())]), "names": pa.array([names[group]], pa.list_(pa.int64())),
               "sizes": pa.array([size[group]], pa.list_(pa.int64())), "width": pa.array([width], pa.int32()),
               "bits": pa.array([np.packbits(marks, axis=1).tobytes()], pa.binary())}


def build_index(docs: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """Index rows of (name, text): blocks of documents, and (term, df) rows to be summed."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text", PIECE):
                for found in signatures(data, offsets, rows.column(0).to_numpy(), wanted):
                    n = len(next(iter(found.values())))
                    yield pa.RecordBatch.from_arrays([found[c] if c in found else pa.nulls(n, ARROW[c]) for c in FIELDS], names=FIELDS)

    return cut(docs.select("name", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(index, INDEX))


@dataclass
class Items:
    """A block of items: their names in order, their (item, term) rows by item, and the distinct terms."""

    names: np.ndarray
    owner: np.ndarray   # item of each row, ascending
    term: np.ndarray    # term of each row
    weight: np.ndarray  # weight times repeats of each row
    terms: pa.Array
    hashes: np.ndarray
    average: tuple[int, int]  # documents, terms of all documents

    @classmethod
    def of(cls, rows: pa.Table, documents: int, total: int) -> Items:
        names, owner = np.unique(rows.column("item").to_numpy(), return_inverse=True)
        order = np.argsort(owner, kind="stable")
        coded = rows.column("term").combine_chunks().cast(pa.binary()).dictionary_encode()
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in rows.column("df").to_pylist()], np.int64)
        weight *= rows.column("repeats").to_numpy()
        return cls(names, owner[order], coded.indices.to_numpy().astype(np.int64)[order], weight[order], coded.dictionary.cast(pa.large_binary()),
                   hashed(coded.dictionary), (documents, total))

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(items, row begins, weights, distinct terms, their places in the rows) of whole items at a time."""
        begin = np.searchsorted(self.owner, np.arange(len(self.names) + 1))
        at = 0
        while at < len(self.names):
            end = max(at + 1, int(np.searchsorted(begin, begin[at] + CHUNK, "right")) - 1)
            low, high = begin[at], begin[end]
            terms, place = np.unique(self.term[low:high], return_inverse=True)
            yield np.arange(at, end), begin[at:end] - low, self.weight[low:high], terms, place
            at = end

    def factor(self, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What ``tf`` occurrences in a document of ``size`` terms are worth; never falls as ``tf`` grows."""
        documents, total = self.average
        m = 25 + 75 * size * documents // total
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def upper_bounds(items: Items, chunks: list, size: np.ndarray, width: int, bits: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Item numbers, and for each a row with a bound of every document's score."""
    n = len(size)
    matrix = np.frombuffer(bits, np.uint8).reshape(width, -1)
    most = np.append(np.array(STEPS[1:]) - 1, np.iinfo(np.int32).max)
    worth = np.stack([items.factor(np.minimum(top, size), size) for top in most])
    worth = np.diff(worth, axis=0, prepend=0)  # what each further step adds
    reached, left = [], np.arange(len(items.terms))
    for step in range(len(STEPS)):
        held = np.bitwise_and.reduce(matrix[slices(items.hashes[left], step, width)], axis=0)
        some = held.any(axis=1)
        left, held = left[some], held[some]
        if not len(left):
            break
        row = np.full(len(items.terms), -1)
        row[left] = np.arange(len(left))
        reached.append((row, held))
    for numbers, begins, weight, terms, place in chunks:
        value = np.zeros((len(terms), n), np.int64)
        live = np.ones((len(terms), n), np.uint8)
        for (row, held), gain in zip(reached, worth):
            some = np.flatnonzero(row[terms] >= 0)
            if not len(some):
                break
            # a step counts where all lower ones are there
            here = np.unpackbits(held[row[terms[some]]], axis=1, count=n) & live[some]
            value[some] += here * gain
            live[:] = 0
            live[some] = here
        yield numbers, np.add.reduceat(value[place] * weight[:, None], begins, axis=0)


def best_bounds(index: DataFrame, items: Items, seeds: int) -> DataFrame:
    """(item, name, bound) of the documents with the highest bounds, ``seeds`` per item and task."""
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = list(items.chunks())
        bound, name = np.zeros((len(items.names), 0), np.int64), np.zeros((len(items.names), 0), np.int64)
        for names, size, width, bits in blocks(batches):
            more = np.concatenate([b for _, b in upper_bounds(items, chunks, size, width, bits)])
            keep = np.argpartition(-more, min(seeds, more.shape[1]) - 1, axis=1)[:, :seeds]
            bound = np.concatenate([bound, np.take_along_axis(more, keep, 1)], axis=1)
            name = np.concatenate([name, names[keep]], axis=1)
            keep = np.argpartition(-bound, min(seeds, bound.shape[1]) - 1, axis=1)[:, :seeds]
            bound, name = np.take_along_axis(bound, keep, 1), np.take_along_axis(name, keep, 1)
        item, place = np.nonzero(bound > 0)
        yield pa.RecordBatch.from_arrays([pa.array(items.names[item]), pa.array(name[item, place]), pa.array(bound[item, place])], names=["item", "name", "bound"])

    return index.mapInArrow(best, "item long, name long, bound long")


def reaching(index: DataFrame, items: Items, least: np.ndarray) -> DataFrame:
    """Names of all documents whose bound is at least that of some item."""
    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = list(items.chunks())
        for names, size, width, bits in blocks(batches):
            found = np.zeros(len(names), bool)
            for numbers, bounds in upper_bounds(items, chunks, size, width, bits):
                found |= (bounds >= least[numbers][:, None]).any(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(names[found])], names=["name"])

    return index.mapInArrow(reach, "name long")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            names, sizes, width, bits = (batch.column(j)[i] for j in range(4))
            yield names.values.to_numpy(), sizes.values.to_numpy(), width.as_py(), bits.as_buffer()


def exact_scores(docs: DataFrame, names: DataFrame, items: Items, top: int) -> DataFrame:
    """(item, key, score) of the named documents: of each task the best ``top`` of every item, scores above 0."""
    picked = docs.join(F.broadcast(names) if names.limit(FEW + 1).count() <= FEW else names, "name", "left_semi").select("key", "text")
    kind = docs.schema["key"].dataType

    def rank(entry) -> tuple:
        return (-entry[0], entry[1] is None, entry[1] if entry[1] is not None else 0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = np.searchsorted(items.owner, np.arange(len(items.names)))
        best: list[list] = [[] for _ in items.names]
        bar = np.ones(len(items.names), np.int64)
        arrow_kind = None
        for batch in batches:
            arrow_kind = batch.column(0).type
            for rows, data, offsets in pieces(batch, "text", PIECE):
                text, number, terms = terms_of(data, offsets)
                size = np.bincount(text, minlength=rows.num_rows)
                text, number, tf = occurrences(text, number, len(terms))
                known = pc.index_in(terms, value_set=items.terms).fill_null(-1).to_numpy(zero_copy_only=False)[number]
                text, known, tf = (x[known >= 0] for x in (text, known, tf))
                first = np.searchsorted(text, np.arange(rows.num_rows + 1))
                for i, key in enumerate(rows.column(0).to_pylist()):
                    if first[i] == first[i + 1]:
                        continue
                    count = np.zeros(len(items.terms), np.int64)
                    count[known[first[i]:first[i + 1]]] = tf[first[i]:first[i + 1]]
                    count = items.factor(count, size[i])
                    total = np.add.reduceat(items.weight * count[items.term], begins)
                    for j in np.flatnonzero(total >= bar).tolist():
                        best[j].append((int(total[j]), key))
                        if len(best[j]) >= 4 * top:
                            best[j] = sorted(best[j], key=rank)[:top]
                            bar[j] = best[j][-1][0]
        found = [(items.names[j], key, value) for j, entries in enumerate(best) for value, key in sorted(entries, key=rank)[:top]]
        if found:
            name, key, value = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(key, arrow_kind), pa.array(value, pa.int64())], names=["item", "key", "score"])

    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("key", kind), T.StructField("score", T.LongType())])
    return picked.mapInArrow(score, schema)


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, repeats) of (name, text)."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text", PIECE):
                text, number, terms = terms_of(data, offsets)
                text, number, tf = occurrences(text, number, len(terms))
                name = rows.column(0).to_numpy()[text]
                yield pa.RecordBatch.from_arrays([pa.array(name), terms.take(pa.array(number)).cast(pa.binary()).cast(pa.string()), pa.array(tf)],
                                                 names=["item", "term", "repeats"])

    return items.select("name", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(split, "item long, term string, repeats long")


def term_hashes(rows: DataFrame) -> np.ndarray | None:
    """Hashes of the queries' terms, if there are few enough to go with the indexing pass."""
    terms = rows.select("term").distinct().limit(WANTED + 1).toArrow()
    return hashed(terms.column("term").combine_chunks().cast(pa.binary())) if len(terms) <= WANTED else None


def best_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                   item_text: str = "text", top: int = TOP, seeds: int = SEEDS) -> DataFrame:
    """(item_key, rank, key, score): the ``top`` documents of each item."""
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    rows = rows.withColumn("name", F.xxhash64("key", "text"))
    asked = items.select(items[item_key].alias("item_key"), items[item_text].alias("text")).distinct()
    asked = cut(asked.withColumn("name", F.xxhash64("item_key", "text")))
    terms = cut(item_terms(asked))
    index = build_index(rows, term_hashes(terms))
    counts = index.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    terms = cut(terms.join(counts, "term").select("item", "term", "repeats", "df"))
    documents, total = index.agg(F.sum("documents"), F.sum("total")).first()
    n_blocks = terms.count() // TERMS_AT_ONCE + 1 if documents else 0
    signed = index.where("bits is not null").select("names", "sizes", "width", "bits")
    found = None
    for block in range(n_blocks):
        part = Items.of(terms.where(F.pmod("item", F.lit(n_blocks)) == block).toArrow(), documents, total)
        if not len(part.names):
            continue
        by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "name")
        first = best_bounds(signed, part, max(seeds, top)).withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= max(seeds, top))
        by_score = Window.partitionBy("item").orderBy(F.desc("score"))
        bars = exact_scores(rows, cut(first.select("name").distinct()), part, top)
        bars = bars.withColumn("place", F.row_number().over(by_score)).where(F.col("place") == top).select("item", "score").toArrow()
        least = np.ones(len(part.names), np.int64)
        least[np.searchsorted(part.names, bars.column("item").to_numpy())] = bars.column("score").to_numpy()
        some = exact_scores(rows, cut(reaching(signed, part, least).distinct()), part, top)
        found = some if found is None else found.unionAll(some)
    if found is None:
        found = rows.select(F.lit(0).cast("long").alias("item"), "key", F.lit(0).cast("long").alias("score")).where("false")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    best = best.join(asked.select(F.col("name").alias("item"), "item_key"), "item")
    return best.select(F.col("item_key").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")


_TERMS = "list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: w <> ''), " \
         "lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"


@query("op13_bit_sliced_search", f"""
with d as (select doc_id, {_TERMS} as ws from documents),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(ws) as term from d) group by doc_id, term),
df as (select term, count(*) as df from tf group by term),
n as (select count(*) as n, cast(sum(len(ws)) as bigint) as l from d where len(ws) > 0),
w as (select term, cast(floor(1000 * ln((2 * n.n + 2) / (2 * df + 1))) as bigint) as w from df, n),
m as (select doc_id, 25 + (75 * cast(len(ws) as bigint) * n.n) // n.l as m from d, n where len(ws) > 0),
q as (select item_id, term, count(*) as c from (select item_id, unnest({_TERMS}) as term from benchmark) group by item_id, term),
s as (
  select item_id, doc_id, cast(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from q join w using (term) join tf using (term) join m using (doc_id) group by item_id, doc_id
),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= {TOP}
""")
def op13_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

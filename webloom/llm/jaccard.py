"""N-gram Jaccard join with set-relation skipping, for near copies.

A document is the set of its distinct 4-word shingles. Two sets can only reach the threshold if they
share a shingle among the first few of each in one fixed order (frequent shingles last). So each set
enters the index lists of its prefix shingles only, with its size and the shingle's position.

* Equal sets are one class and enter once.
* In each list one set is the pivot, the one with least of its own, and every other set of the list is compared
  with it: one row per entry, not one per pair. A list is stored as blocks in order of position, with the least and
  greatest position and size of each: blocks that cannot reach the threshold are skipped unopened, in the others the entries.
* A set's further answers follow from the pivot's. Sets linked to the same component need no
  comparison. Two sets close to one pivot, one of which misses the threshold with it, can only be linked if
  their differences from the pivot overlap enough, so the (small) differences are joined instead of
  the sets. Only sets that are far from the pivot of a list are compared within it, where their places allow.

Sketches of the sets (shingles counted in buckets) bound what two sets can have in common; only pairs that they
leave open are compared. Comparison is exact, on the shingles of both whole texts. Shingles that many documents share are found
in a first scan; their entries are written without being gathered by shingle. What the first scan finds
decides the order only, never the result.

Null or empty texts, and texts without words, have the empty set and are linked with nothing. Fewer than
four words are one shingle. Rows that repeat a key count as texts of their own and get the component of
their text. Rows without a key get the component of their text's class, or null when no row of it has a
key. Keys are cast to 64-bit integers. An empty table gives an empty result. Very long texts are handled whole, in memory
proportional to them. Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.arrays import LOWER, WORD, by_text, mix, pieces, runs, strong, windows
from webloom.llm.components import connected
from webloom.llm.registry import query, table
from webloom.runtime import cut

WIDTH = 4
PERCENT = 85
PIECE = 1 << 20   # bytes of text hashed at a time
STRETCH = 1 << 20  # shingles among which frequent ones are looked for at a time
HOT_SHARE = 512   # a shingle in this part of a stretch's texts (and three at least) counts as frequent
BROADCAST_ROWS = 1_000_000  # of three numbers at most
HOT_MOST = 65536  # frequent shingles kept, the commonest; they are ordered last


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    starts, ends = runs(WORD[data], offsets)
    first = by_text(starts, offsets)
    words = strong(LOWER[data], starts, ends)
    full = windows(words, width)
    sets = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        if high - low >= width:
            values = np.sort(full[low:high - width + 1])
            keep = np.ones(len(values), bool)
            keep[1:] = values[1:] != values[:-1]
            sets.append(values[keep])
        elif high > low:
            sets.append(mix(windows(words[low:high], high - low) + np.uint64(high - low)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        a = mix(values).sum(dtype=np.uint64) + np.uint64(len(values))
        b = mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(mix(np.array([a]))[0].astype(np.int64)), int(mix(np.array([b]))[0].astype(np.int64))


def sketch(values: np.ndarray) -> bytes:
    """How many shingles fall into each of about as many buckets; at most 255 are told."""
    buckets = 1 << max(4, min(16, int(len(values) - 1).bit_length())) if len(values) else 16
    return np.minimum(np.bincount((values % np.uint64(buckets)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def most_common(x: bytes, y: bytes, least: int) -> int:
    """An upper bound of the shingles that two sets have in common, from their sketches; ``least`` is the smaller set's size."""
    a, b = (np.frombuffer(v, np.uint8) for v in (x, y))
    if min(a.max(), b.max()) == 255:
        return least
    size = min(len(a), len(b))
    a, b = (v.reshape(-1, size).sum(axis=0, dtype=np.int64) for v in (a, b))  # buckets by remainder fold into fewer
    return int(np.minimum(a, b).sum())


def prefix_size(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


class Hot:
    """Frequent shingles, in the order of their frequency."""

    def __init__(self, values: list[tuple[int, int]]):
        rank = {v: r for r, (v, _) in enumerate(sorted(values, key=lambda x: (x[1], x[0])))}
        self.values = np.array(sorted(np.array(list(rank), np.int64).view(np.uint64).tolist()), np.uint64)
        self.ranks = np.array([rank[int(v)] for v in self.values.view(np.int64)], np.int64)

    def order(self, values: np.ndarray) -> tuple[np.ndarray, int]:
        """The set with frequent shingles last, and how many are not frequent."""
        if not len(self.values) or not len(values):
            return values, len(values)
        at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        hot = self.values[at] == values
        ranked = values[hot][np.argsort(self.ranks[at[hot]], kind="stable")]
        return np.concatenate([values[~hot], ranked]), int((~hot).sum())


def _texts(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        for rows, data, offsets in pieces(batch, "text", PIECE):
            yield rows, shingle_sets(data, offsets, width)


def profiles(rows: DataFrame, width: int) -> DataFrame:
    """(key, twin, n, h, g, sketch): hash of each row's text, size, 128-bit name and sketch of its set."""
    def profile(batches):
        for rows, sets in _texts(batches, width):
            names = np.array([digest(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("twin"), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([sketch(s) for s in sets], pa.binary())],
                                             names=["key", "twin", "n", "h", "g", "sketch"])

    return rows.withColumn("twin", F.xxhash64("text")).mapInArrow(profile, "key long, twin long, n long, h long, g long, sketch binary")


def frequent(rows: DataFrame, width: int) -> list[tuple[int, int]]:
    """The commonest of the shingles that stand out within some stretch of the corpus: at most ``HOT_MOST``."""
    def often(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(sets), return_counts=True)
        many = n >= max(3, len(sets) // HOT_SHARE)
        return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(n[many])], names=["value", "n"])

    def count(batches):
        distinct, total = {}, 0
        for _, sets in _texts(batches, width):
            for values in sets:
                if len(values) and (name := digest(values)) not in distinct:
                    distinct[name] = values
                    total += len(values)
            if total >= STRETCH:
                yield often(list(distinct.values()))
                distinct, total = {}, 0
        if distinct:
            yield often(list(distinct.values()))

    found = rows.mapInArrow(count, "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    return [tuple(r) for r in found.orderBy(F.desc("n"), "value").limit(HOT_MOST).collect()]


BLOCK_ENTRIES = 128
ENTRY = "value long, node long, n int, pos int"
ENTRY_COLUMNS = ["value", "node", "n", "pos"]


def _entries(batches, width: int, percent: int, hot: Hot, want_hot: bool):
    """Prefix entries of each distinct set of a piece as arrays (value, node, n, pos), frequent or other ones."""
    for _, sets in _texts(batches, width):
        parts = []
        for (name, _), values in {digest(s): s for s in sets if len(s)}.items():
            n = len(values)
            ordered, common = hot.order(values)
            size = prefix_size(n, percent)
            low, high = (min(common, size), size) if want_hot else (0, min(common, size))
            if high > low:
                parts.append((ordered[low:high].view(np.int64), name, n, low))
        if parts:
            value = np.concatenate([p[0] for p in parts])
            sizes = [len(p[0]) for p in parts]
            pos = np.concatenate([np.arange(p[3], p[3] + len(p[0]), dtype=np.int32) for p in parts])
            yield value, np.repeat(np.array([p[1] for p in parts], np.int64), sizes), np.repeat(np.array([p[2] for p in parts], np.int32), sizes), pos


def in_blocks(entries: DataFrame) -> DataFrame:
    """Entries, in order of value and position within partitions, as blocks of a list.

    A block has its list's value, the least and greatest position and size of its entries, and the entries' columns as arrays.
    """
    columns = [c for c in entries.columns if c != "value"]
    kinds = {c: entries.schema[c].dataType.simpleString() for c in columns}

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            value, n, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("value", "n", "pos"))
            place = np.arange(len(value))
            new = np.append(True, value[1:] != value[:-1])
            at = np.flatnonzero((place - np.maximum.accumulate(np.where(new, place, 0))) % BLOCK_ENTRIES == 0)
            edges = pa.array(np.append(at, len(value)), pa.int32())
            bounds = [f.reduceat(x, at) for x in (pos, n) for f in (np.minimum, np.maximum)]
            yield pa.RecordBatch.from_arrays([pa.array(value[at]), *map(pa.array, bounds), *(pa.ListArray.from_arrays(edges, batch.column(c)) for c in columns)],
                                             names=["value", "low_pos", "high_pos", "low_n", "high_n", *columns])

    schema = "value long, low_pos int, high_pos int, low_n int, high_n int, " + ", ".join(f"{c} array<{kinds[c]}>" for c in columns)
    return entries.sortWithinPartitions("value", "pos").mapInArrow(pack, schema)


def entries_in(blocks: DataFrame, columns: list[str], *keep) -> DataFrame:
    """The entries of blocks, a row each."""
    return blocks.select(*keep, F.inline(F.arrays_zip(*columns)))


def index_lists(rows: DataFrame, width: int, percent: int, hot: Hot) -> DataFrame:
    """Blocks of all lists that have two sets at least, each set once: see ``in_blocks``."""
    def entries(want_hot: bool):
        def write(batches):
            for columns in _entries(batches, width, percent, hot, want_hot):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=ENTRY_COLUMNS)

        return write

    def several(batches):
        held = None  # the last entry so far, and whether it has been passed on
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns[0]):
                continue
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held[0], columns)]
            value, node = columns[:2]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (node[1:] != node[:-1])
            at = np.flatnonzero(new)
            columns = [c[at] for c in columns]
            value = columns[0]
            shared = np.zeros(len(value), bool)
            shared[1:] = value[1:] == value[:-1]
            shared[:-1] |= shared[1:]
            if held is not None and held[1]:
                emit = shared.copy()
                emit[0] = False
                passed = shared[-1] or len(value) == 1
            else:
                emit, passed = shared, shared[-1]
            held = [c[-1:] for c in columns], bool(passed)
            yield pa.RecordBatch.from_arrays([pa.array(c[emit]) for c in columns], names=ENTRY_COLUMNS)

    rare = rows.mapInArrow(entries(False), ENTRY).repartition("value").sortWithinPartitions("value", "node")
    # frequent shingles are in several sets by how they were found; their entries need not meet
    return cut(in_blocks(rare.mapInArrow(several, ENTRY)).union(in_blocks(rows.mapInArrow(entries(True), ENTRY).distinct())))


def sized(small: DataFrame) -> DataFrame:
    """Broadcast a table of a few numbers a row that is counted to be small; otherwise leave the join to Spark."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def with_pivots(lists: DataFrame, percent: int) -> DataFrame:
    """Adds to each block the pivot of its list: the set with most of its prefix in lists.

    Such a set has hardly a shingle of its own: it is the text the others were made from, or close to it.
    """
    size = F.expr(f"n - cast(ceil({percent} * n / 100.0) as int) + 1")
    entries = entries_in(lists, ["node", "n", "pos"], "value")
    shares = entries.groupBy("node").agg(F.count(F.lit(1)).alias("lists"), F.max("n").alias("n")).select("node", (F.col("lists") / size).alias("share"))
    ranked = entries.join(sized(cut(shares)), "node").groupBy("value").agg(F.max(F.struct("share", "node", "n", "pos")).alias("p"))
    return lists.join(ranked.select("value", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.pos").alias("pivot_pos")), "value")


def block_possible(m: str, at: str, percent: int) -> str:
    """SQL: some entry of a block, by its bounds, can reach the threshold with a set of size m whose shingle stands at this place.

    Blocks of which this does not hold are skipped unopened.
    """
    sizes = f"100L * high_n >= {percent}L * {m} and 100L * {m} >= {percent}L * low_n"
    return f"{sizes} and {100 + percent}L * least(high_n - low_pos, {m} - {at}) >= {percent}L * (low_n + {m})"


def possible(n: str, pos: str, m: str, at: str, percent: int) -> str:
    """SQL: two sets whose first common shingle stands at these positions can reach the threshold."""
    sizes = f"100L * least({n}, {m}) >= {percent}L * greatest({n}, {m})"
    return f"{sizes} and {100 + percent}L * least({n} - {pos}, {m} - {at}) >= {percent}L * ({n} + {m})"


def compare(pairs: DataFrame, texts: DataFrame, width: int, differences: bool = False) -> DataFrame:
    """(x, y, both, nx, ny) for pairs of nodes: size of the intersection and of both sets.

    With ``differences`` also the shingles of x that y has not, and of y that x has not (one bit tells which), for
    pairs that have half of their shingles in common.
    """
    both = (pairs.select(F.col("x").alias("kx"), F.col("y").alias("ky"))
            .join(texts.withColumnsRenamed({"node": "kx", "text": "tx"}).hint("merge"), "kx")
            .join(texts.withColumnsRenamed({"node": "ky", "text": "ty"}).hint("merge"), "ky"))

    def difference(x: np.ndarray, y: np.ndarray, shared: np.ndarray) -> np.ndarray | None:
        if not differences or 2 * len(shared) < len(x) + len(y) - len(shared):
            return None
        more, less = (np.setdiff1d(v, shared, assume_unique=True) for v in (x, y))
        return np.concatenate([more | np.uint64(1), less & ~np.uint64(1)]).view(np.int64)

    def intersect(batches):
        for batch in batches:
            sides = {}
            for key, text in (("kx", "tx"), ("ky", "ty")):
                ids = batch.column(key).to_pylist()
                at = {}
                for i, k in enumerate(ids):
                    at.setdefault(k, i)
                only = pa.RecordBatch.from_arrays([batch.column(text).take(pa.array(list(at.values()), pa.int64()))], names=["text"])
                sides[key] = ids, dict(zip(at, (s for _, found in _texts([only], width) for s in found)))
            (xs, left), (ys, right) = sides["kx"], sides["ky"]
            shared = [np.intersect1d(left[x], right[y], assume_unique=True) for x, y in zip(xs, ys)]
            columns = [batch.column("kx"), batch.column("ky"), pa.array([len(v) for v in shared], pa.int64()),
                       pa.array([len(left[x]) for x in xs], pa.int64()), pa.array([len(right[y]) for y in ys], pa.int64()),
                       pa.array([difference(left[x], right[y], v) for x, y, v in zip(xs, ys, shared)], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "both", "nx", "ny", "apart"])

    return cut(both.select("kx", "ky", "tx", "ty").mapInArrow(intersect, "x long, y long, both long, nx long, ny long, apart array<long>"))


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sketches leave a similarity of ``percent`` possible. Only their texts need to be compared."""
    joined = (pairs.join(sketches.withColumnsRenamed({"node": "x", "n": "nx", "sketch": "sx"}).hint("merge"), "x")
              .join(sketches.withColumnsRenamed({"node": "y", "n": "ny", "sketch": "sy"}).hint("merge"), "y"))

    def filtered(batches):
        for batch in batches:
            x, y, nx, sx, ny, sy = (batch.column(c).to_pylist() for c in ("x", "y", "nx", "sx", "ny", "sy"))
            keep = np.zeros(len(x), bool)
            for i in range(len(x)):
                both = most_common(sx[i], sy[i], min(nx[i], ny[i]))
                keep[i] = 100 * both >= percent * (nx[i] + ny[i] - both)
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(pa.array(keep)), batch.column("y").filter(pa.array(keep))], names=["x", "y"])

    return cut(joined.select("x", "y", "nx", "sx", "ny", "sy").mapInArrow(filtered, "x long, y long"))


def derived_pairs(first: DataFrame, part: DataFrame, percent: int) -> DataFrame:
    """(x, y) whose answer follows only from how both differ from their common pivot.

    Let s miss the threshold with the pivot by some shingles. Then s reaches it with another set x of this pivot
    only if their differences from the pivot have enough in common: what s misses, and 85/185 (for 85
    percent) of x's difference. So differences are joined as sets, by their prefixes, rarest shingles first;
    sets whose differences are unrelated, as among independent edits of one text, never meet.
    """
    c = percent / (100 + percent)
    named = part.select(F.col("node").alias("x"), "component")
    close = (first.where("apart is not null").join(named, "x", "left")
             .select("x", F.col("y").alias("pivot"), F.coalesce("component", "x").alias("part"), F.size("apart").alias("size"),
                     (F.lit(c) * (F.col("nx") + F.col("ny")) - F.col("both")).alias("missing"), "apart"))
    # only pivots that some set misses
    open_ = close.where("missing > 0").select("pivot").distinct()
    close = cut(close.join(open_, "pivot", "left_semi").select("x", "pivot", "part", "size", "missing", F.explode("apart").alias("value")))
    counts = close.groupBy("pivot", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    order = F.row_number().over(Window.partitionBy("pivot", "x").orderBy("n", "value"))
    # shingles of one set's difference only come first in any order; they can't be shared, but count as places
    lone = close.join(counts, ["pivot", "value"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    placed = cut(lone.withColumn("place", order).where("n > 1"))
    probe = placed.where(f"missing > 0 and place <= size - ceil(missing / {1 - c} - 1e-9) + 1")
    index = placed.where(f"place <= size - floor({c} * size + 1e-9)").select(
        "pivot", "value", F.col("x").alias("y"), F.col("part").alias("y_part"))
    return probe.join(index, ["pivot", "value"]).where("part <> y_part").select("x", "y").distinct()


def texts_of(rows: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, text): for each set of a pair, one text that has it, with a key or without."""
    asked = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    lead = cut(classes.select(F.col("h").alias("node"), "lead.key", "lead.twin").join(asked, "node", "left_semi"))
    keyed = (rows.where("key is not null").join(lead.where("key is not null").hint("merge"), "key")
             .where(F.col("twin") == F.xxhash64("text")).select("node", "text"))
    # copies without a key collapse before they meet
    keyless = rows.where("key is null").groupBy(F.xxhash64("text").alias("twin")).agg(F.first("text").alias("text"))
    keyless = keyless.join(lead.where("key is null").select("node", "twin"), "twin").select("node", "text")
    texts = cut(keyed.union(keyless))
    if texts.groupBy("node").count().where("count > 1").isEmpty():
        return texts
    return cut(texts.dropDuplicates(["node"]))  # rows that repeat key and text


def components_of(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, twin, n, component_id) for every row (key, text): its text's hash, its set's size and the smallest key reachable over links.

    Nodes are sets, by name, up to the last step: a set counts for its own text, whether a row of it has a key or not.
    """
    own = cut(profiles(rows, width))
    lead = F.min(F.struct(F.col("key").isNull().alias("keyless"), "key", "twin"))
    classes = cut(own.where("n > 0").groupBy("h", "g").agg(lead.alias("lead")))
    filled = frequent(rows, width)
    lists = index_lists(rows, width, percent, Hot(filled))
    pivoted = cut(with_pivots(lists, percent))
    listed = lists.select(F.explode("node").alias("node")).distinct()
    sketches = own.select(F.col("h").alias("node"), "n", "sketch").join(listed, "node", "left_semi")
    sketches = cut(sketches.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    star = entries_in(pivoted.where(block_possible("pivot_n", "pivot_pos", percent)), ["node", "n", "pos"], "pivot", "pivot_n", "pivot_pos")
    star = star.where("node <> pivot").where(possible("n", "pos", "pivot_n", "pivot_pos", percent))
    # pairs below a half are neither linked nor close
    star = plausible(star.select(F.col("node").alias("x"), F.col("pivot").alias("y")).distinct(), sketches, min(50, percent))
    first = compare(star, texts_of(rows, classes, star), width, True)
    linked = f"100 * both >= {percent} * (nx + ny - both)"
    links = first.where(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))
    part = connected(links)

    # Entries whose distance to their pivot is known and not large are settled by it. For the others of a list
    # their places in it decide whether a pair is compared.
    parts = sized(part)
    near = first.where("apart is not null").select(F.col("x").alias("node"), F.col("y").alias("pivot"), F.lit(True).alias("near"))
    known = (entries_in(pivoted, ["node", "n", "pos"], "value", "pivot").join(parts.select("node", F.col("component").alias("node_part")), "node", "left")
             .join(parts.select(F.col("node").alias("pivot"), F.col("component").alias("pivot_part")), "pivot", "left")
             .withColumns({"node_part": F.coalesce("node_part", "node"), "pivot_part": F.coalesce("pivot_part", "pivot")}).join(near, ["node", "pivot"], "left")
             .select("value", F.col("node").alias("x"), "n", "pos", "node_part", (F.col("node_part") != F.col("pivot_part")).alias("outside"),
                     (F.coalesce("near", F.lit(False)) | (F.col("node") == F.col("pivot"))).alias("near")))
    known = cut(known)
    mixed = known.where("outside").select("value").distinct()
    # the positions decide inside the join, so that only pairs to be compared come out of it
    other = known.join(mixed, "value", "left_semi").select("value", *(F.col(c).alias(f"o_{c}") for c in ("x", "n", "pos", "node_part", "outside", "near")))
    rest = (known.where("outside").join(other, "value").where("node_part <> o_node_part and (not o_outside or x < o_x) and not (near and o_near)")
            .where(possible("n", "pos", "o_n", "o_pos", percent)).select("x", F.col("o_x").alias("y")))
    rest = rest.union(derived_pairs(first, part, percent)).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    rest = plausible(rest, sketches, percent)
    second = compare(rest, texts_of(rows, classes, rest), width)
    links = links.union(second.where(linked).select(F.col("x").alias("a"), F.col("y").alias("b")))
    # from sets to the smallest keys of their components
    part = connected(links).withColumnRenamed("node", "h")
    member = cut(classes.select("h", "g", "lead.key").join(part, "h", "left"))
    least = sized(cut(member.where("component is not null").groupBy("component").agg(F.min("key").alias("least"))))
    component = member.join(least, "component", "left").select(
        "h", "g", F.when(F.col("component").isNull(), F.col("key")).otherwise(F.col("least")).alias("component_id"))
    found = own.join(component, ["h", "g"], "left")
    return found.select("key", "twin", "n", F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component_id")).alias("component_id"))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(docs[key].cast("long").alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) for every row: the smallest key reachable over links."""
    found = components_of(_keyed(docs, key, text), width, percent)
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The input with one document of each group of near copies: the one with the smallest key.

    Columns are kept. Of rows that repeat key and text one stays; rows without a key, and texts without words, all stay.
    """
    found = cut(components_of(_keyed(docs, key, text), width, percent).where("key is not null").groupBy(F.col("key").alias("gone"), F.col("twin").alias("gone_twin"))
                .agg(F.max(F.col("key") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("n")))
    gone = sized(found.where("not stays").select("gone", "gone_twin"))
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own, body = f"c{names.index(key)}", F.coalesce(F.col(f"c{names.index(text)}"), F.lit(""))
    kept = rows.join(gone, (F.col(own) == F.col("gone")) & (F.xxhash64(body) == F.col("gone_twin")), "left_anti")
    if found.where("n > 1").isEmpty():
        return kept.toDF(*names)
    first = F.row_number().over(Window.partitionBy(own, "twin").orderBy(F.lit(1)))
    once = kept.where(F.col(own).isNotNull()).withColumn("twin", F.xxhash64(body)).withColumn("nth", first).where("nth = 1").drop("nth", "twin")
    return once.unionByName(kept.where(F.col(own).isNull())).toDF(*names)


@query("op10_jaccard_join")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))

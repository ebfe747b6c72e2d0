"""Tables that grow by micro-batches and are merged into generations.

A batch adds its rows as a delta in a folder of its own. Every so many deltas all that is there is merged
into a new generation, and the name of an empty file, made last, says which generation counts and which batches it
holds. So reading costs one generation and a few deltas, however many batches there were; a merge that breaks off leaves
a folder that nobody names, and is done again; and a batch that is replayed replaces its own delta, since only
batches before the current one are ever merged. Names are listed on the driver, rows never are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from webloom.streaming.run import BATCH, read_table

COMPACT_EVERY = 8


class Folder:
    """A folder of a file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self.path = path
        self.fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        at = self._at(self.path)
        return self.fs.exists(at) and self.fs.getFileStatus(at).isDirectory()

    def names(self, below: str = "") -> list[str]:
        at = self._at(f"{self.path}/{below}".rstrip("/"))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def remove(self, below: str) -> None:
        self.fs.delete(self._at(f"{self.path}/{below}"), True)

    def make(self, below: str = "") -> None:
        self.fs.mkdirs(self._at(f"{self.path}/{below}".rstrip("/")))

    def create_empty(self, below: str) -> None:
        self.make(below.rpartition("/")[0])
        self.fs.createNewFile(self._at(f"{self.path}/{below}"))

    def rename(self, source: str, target: str) -> None:
        if not self.fs.rename(self._at(f"{self.path}/{source}"), self._at(f"{self.path}/{target}")):
            raise OSError(f"{source} could not be renamed to {target} in {self.path}")


class Generations:
    """A merged table under ``path``; ``merge`` turns rows with a batch number into current rows without one."""

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], compact_every: int = COMPACT_EVERY,
                 partition_by: Sequence[str] = ()):
        self.spark, self.path, self.merge = spark, path, merge
        self.compact_every, self.partition_by = compact_every, list(partition_by)
        self.folder = Folder(spark, path)

    def current(self) -> tuple[int, int]:
        """(generation, last batch in it); (0, -1) before the first merge."""
        names = [n.split("-") for n in self.folder.names("manifest") if not n.startswith((".", "_"))]
        return max(((int(g), int(through)) for g, through in names), default=(0, -1))

    def deltas(self, before: int | None = None) -> list[int]:
        """Batches that are not merged yet, of those before the given one."""
        _, through = self.current()
        found = [int(n.split("=")[1]) for n in self.folder.names("delta") if n.startswith(f"{BATCH}=")]
        return sorted(b for b in found if b > through and (before is None or b < before))

    def stored(self, before: int | None = None) -> DataFrame | None:
        """Rows of the generation and the deltas, with their batch; None while there is nothing."""
        generation, through = self.current()
        parts = [(f"base/generation={generation}", through)] if generation else []
        parts += [(f"delta/{BATCH}={b}", b) for b in self.deltas(before)]
        result = None
        for below, batch in parts:
            rows = read_table(self.spark, f"{self.path}/{below}")
            if rows is None:      # nothing was written: an empty batch
                continue
            rows = rows.withColumn(BATCH, F.lit(batch).cast("long"))
            result = rows if result is None else result.unionByName(rows)
        return result

    def read(self, before: int | None = None) -> DataFrame | None:
        """Current rows after all batches, or those before the given one."""
        rows = self.stored(before)
        return None if rows is None else self.merge(rows)

    def append(self, rows: DataFrame, batch_id: int) -> None:
        if len(self.deltas(batch_id)) >= self.compact_every:
            self.compact(batch_id)
        self._write(rows, f"delta/{BATCH}={batch_id}")

    def compact(self, before: int) -> None:
        """Merge all batches before the given one into a new generation; the last but one goes."""
        generation, through = self.current()
        merged = self.deltas(before)
        if not merged:
            return
        current = self.read(before)
        if current is None:
            return
        self._write(current, f"base/generation={generation + 1}")
        self.folder.create_empty(f"manifest/{generation + 1:08d}-{merged[-1]}")
        for name in self.folder.names("base"):
            if int(name.split("=")[1]) < generation:
                self.folder.remove(f"base/{name}")
        for name in self.folder.names("delta"):
            if int(name.split("=")[1]) <= through:
                self.folder.remove(f"delta/{name}")

    def _write(self, rows: DataFrame, below: str) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(f"{self.path}/{below}")


def upsert_table(spark: SparkSession, path: str, keys: Sequence[str], compact_every: int = COMPACT_EVERY) -> Generations:
    """STR-3: a table merged by key. Of a key's rows that of the latest batch counts, of a batch's the greatest in the order of its columns."""
    def latest(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, BATCH)]
        row = F.max(F.struct(F.col(BATCH), *rest)).alias("_row")
        return rows.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])

    return Generations(spark, path, latest, compact_every)


def merged_sink(table: Generations) -> Callable[[DataFrame, int], None]:
    """A ``write(batch, batch_id)`` for ``start_batches`` in update mode."""
    return table.append


class IdStore:
    """DDP-3, STR-8: which ids have been seen, exactly, over any distance in time, without streaming state.

    Ids lie in ``buckets`` folders by their hash. Beside them lie Bloom filters, bitmaps of 32,768 bits in ``blocks`` per
    bucket, each for its part of the ids. A batch reads the bitmaps its ids fall on; ids that miss a bit are new, and
    only for the others are the buckets opened that may hold them. A full filter costs reading, never a
    result. All is DataFrame code; memory does not grow with the ids.
    """

    BITS = 32768

    def __init__(self, spark: SparkSession, path: str, ids: Sequence[str], buckets: int = 64, blocks: int = 64, hashes: int = 4,
                 compact_every: int = COMPACT_EVERY):
        self.ids, self.buckets, self.blocks, self.hashes = list(ids), buckets, blocks, hashes
        self.seen = Generations(spark, f"{path}/ids", lambda rows: rows.drop(BATCH), compact_every, ["bucket"])
        self.blooms = Generations(spark, f"{path}/blooms", lambda rows: rows.groupBy("bucket", "block").agg(F.bitmap_or_agg("bits").alias("bits")), compact_every)

    def _placed(self, rows: DataFrame) -> DataFrame:
        h = F.xxhash64(*self.ids)
        return rows.withColumns({"bucket": F.pmod(h, F.lit(self.buckets)).cast("int"), "block": F.pmod(F.shiftright(h, 20), F.lit(self.blocks)).cast("int")})

    def _places(self) -> Column:
        """The bits of an id in its block's bitmap."""
        return F.array(*[F.pmod(F.xxhash64(F.lit(i), *self.ids), F.lit(self.BITS)) for i in range(self.hashes)])

    def _set(self, place: Column) -> Column:
        """Is the bit set in ``bits``?"""
        byte = F.conv(F.hex(F.substring("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, F.pmod(place, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1

    def unseen(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The rows of a batch whose ids no batch before it had; the ids of a batch are distinct."""
        rows = self._placed(batch)
        blooms = self.blooms.read(batch_id)
        if blooms is None:
            return rows.drop("block")
        told = rows.join(blooms, ["bucket", "block"], "left").withColumn("maybe", F.col("bits").isNotNull() & F.forall(self._places(), self._set))
        told = told.drop("bits", "block")
        new, doubtful = told.filter(~F.col("maybe")).drop("maybe"), told.filter("maybe").drop("maybe")
        opened = [r[0] for r in doubtful.select("bucket").distinct().collect()]  # at most one number per bucket
        if not opened:
            return new
        known = self.seen.stored(batch_id).filter(F.col("bucket").isin(opened))
        same = [F.col(f"d.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("bucket", *self.ids)]
        return new.unionByName(doubtful.alias("d").join(known.select("bucket", *self.ids).alias("k"), same, "left_anti"))

    def remember(self, rows: DataFrame, batch_id: int) -> None:
        """Add the ids of unseen rows."""
        ids = self._placed(rows.select(*self.ids))
        bits = ids.select("bucket", "block", F.explode(self._places()).alias("place"))
        self.blooms.append(bits.groupBy("bucket", "block").agg(F.bitmap_construct_agg("place").alias("bits")), batch_id)
        self.seen.append(ids.select("bucket", *self.ids), batch_id)


def once_sink(store: IdStore, order: Sequence[str], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Pass on the first row of each id that was never seen before; a replayed batch gives the same rows again.

    The rows are written by ``write``; the ids are read back from what was written by ``unseen`` alone, so both agree.
    """
    from webloom.operators.dedup import keep_first
    from webloom.runtime import cut

    def sink(batch: DataFrame, batch_id: int) -> None:
        new = cut(store.unseen(keep_first(batch, store.ids, order), batch_id).drop("bucket"))
        write(new, batch_id)
        store.remember(new, batch_id)

    return sink

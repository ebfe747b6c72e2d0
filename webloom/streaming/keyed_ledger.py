"""STR-7 with keyed state: a ledger whose balances and event ids live in Spark's state store.

Users are dealt into buckets, and a bucket is the key of the state: a call of the state's interface serves all its events
of a batch, where one key per user would take several calls for each event. Each bucket has a value state (the balances of
its users) and a list state (ids applied so far, with their users and times, one element per batch). An id has to be known
only until the watermark passes its event's time, since a replay comes with that time and is late from then on; a timer at
the earliest time takes out what the watermark has passed and is set anew for the rest, so the state holds one balance per
user and the ids within the delay. State lives in RocksDB, on disk, and in the query's checkpoint, which fixes the number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKET, KNOWN, WHOLE = "bucket_of_key", "amount_known", "amount_whole"     # no name that pandas would change
BUCKETS = 1024


class Ledger(StatefulProcessor):
    """Applies one bucket's events of a batch in each user's order; credits always, debits that the balance covers."""

    def __init__(self, key: str, event_id: str, event_time: str, order: Sequence[str], amount: str, kind: T.DataType):
        self.key, self.event_id, self.event_time, self.order, self.amount, self.kind = key, event_id, event_time, list(order), amount, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        users, longs = T.StructField("users", T.ArrayType(self.kind)), T.ArrayType(T.LongType())
        self.balances = handle.getValueState("balances", T.StructType([users, T.StructField("balances", longs)]))
        self.applied = handle.getListState("applied", T.StructType([users, T.StructField("ids", T.ArrayType(T.StringType())), T.StructField("times", longs)]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        balances = dict(zip(*(self.balances.get() or ((), ()))))
        seen = {known for users, ids, _ in self.applied.get() for known in zip(users, ids)}
        millis = (-(-events[self.event_time].astype("int64") // 10 ** _digits(events[self.event_time]))).tolist()   # a part of one counts whole
        entries, applied = [], []
        columns = [events[c].tolist() for c in (self.key, self.event_id, WHOLE, KNOWN)]
        for user, event, amount, known, at in zip(*columns, millis):
            balance = balances.setdefault(user, 0)
            if (user, str(event)) in seen:
                continue
            seen.add((user, str(event)))
            applied.append((user, str(event), at))
            accepted = known and (amount >= 0 or balance + amount >= 0)
            balances[user] = balance = balance + (amount if accepted else 0)
            entries.append((user, event, amount if known else None, accepted, balance))
        if not entries:
            return
        self.balances.update((list(balances), list(balances.values())))
        self.applied.appendValue(tuple(map(list, zip(*applied))))
        self.handle.registerTimer(min(at for _, _, at in applied))
        found = dict(zip((self.key, self.event_id, self.amount, "accepted", "balance"), zip(*entries)))
        yield pd.DataFrame(found | {self.amount: pd.array(found[self.amount], "Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [row for chunk in self.applied.get() for row in zip(*chunk)]
        left = [row for row in held if row[2] > now]
        if len(left) < len(held):
            self.applied.put([tuple(map(list, zip(*left)))]) if left else self.applied.clear()
        if left:
            self.handle.registerTimer(min(at for _, _, at in left))
        return iter(())

    def close(self) -> None:
        pass


def _digits(times: pd.Series) -> int:
    """Decimal places from the unit of a time column down to milliseconds."""
    return {"ms": 0, "us": 3, "ns": 6}[times.dt.unit]


def keyed_ledger(events: DataFrame, key: str, event_id: str, event_time: str, order: Sequence[str], amount: str, delay: str,
                 buckets: int = BUCKETS) -> DataFrame:
    """(key, event id, amount, accepted, balance) for every event once, in the order of the batches and of ``order`` within one.

    ``events`` is a stream; amounts are whole numbers. Events without a key, an id or a time belong to nobody and are left out;
    ``guarded_ledger`` gives them as rejected rows. One bucket's events of one batch meet in one task: the batch bounds them, and
    users in far greater numbers want more ``buckets``; a user's events always meet. A started query keeps its number.
    """
    spark = events.sparkSession
    use_state_store(spark)
    kinds = events.schema
    out = T.StructType([T.StructField(key, kinds[key].dataType), T.StructField(event_id, kinds[event_id].dataType), T.StructField(amount, T.LongType()),
                        T.StructField("accepted", T.BooleanType()), T.StructField("balance", T.LongType())])
    picked = dict.fromkeys((key, event_id, event_time, *order, amount))
    rows = events.select(*picked).withColumn(amount, F.col(amount).cast("long")).dropna(subset=[key, event_id, event_time])
    rows = rows.withColumn(KNOWN, F.col(amount).isNotNull()).withColumn(WHOLE, F.coalesce(amount, F.lit(0)))     # a null would make floats of them
    rows = rows.withWatermark(event_time, delay).withColumn(BUCKET, F.pmod(F.hash(key), F.lit(buckets)))
    return rows.groupBy(BUCKET).transformWithStateInPandas(
        statefulProcessor=Ledger(key, event_id, event_time, order, amount, kinds[key].dataType), outputStructType=out, outputMode="Append", timeMode="EventTime")


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

"""Credits: payments, guarded debits, balances (AGG-6, WIN-3, WIN-4, DDP-3, JON-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from webloom.operators.dedup import keep_first
from webloom.operators.ordered import HOT_ROWS, Ordered, has_hot_key
from webloom.runtime import cut

CHUNK_ROWS = 20_000
RUN_CHUNKS = 256


def judged_payments(sessions: DataFrame, intents: DataFrame, users: DataFrame) -> DataFrame:
    """JON-5: completed payments with ``reject_reason``, null for those that are accepted.

    ``sessions(type, session_id, payment_intent_id, customer_email, ts)`` join
    ``intents(payment_intent_id, metadata)`` for the credit amount and ``users(email)``.
    """
    credits = F.expr("try_cast(metadata['credits'] as int)")
    joined = (sessions.filter(F.col("type") == "checkout.session.completed")
              .join(intents, "payment_intent_id", "left")
              .join(users.select(F.col("email").alias("customer_email"), F.lit(True).alias("_known")).distinct(),
                    "customer_email", "left")
              .withColumn("credits", credits)
              .withColumn("reject_reason",
                          F.when(F.col("metadata").isNull(), "payment intent not found")
                          .when(F.col("credits").isNull() | (F.col("credits") <= 0), "invalid credit amount")
                          .when(F.col("_known").isNull(), "user not found")))
    return joined.select("session_id", "customer_email", "credits", "ts", "reject_reason")


def enrich_payments(sessions: DataFrame, intents: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JON-5: (accepted, rejected) payments; judged once and written, then split."""
    judged = cut(judged_payments(sessions, intents, users))
    accepted = judged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return accepted, judged.filter(F.col("reject_reason").isNotNull())


def distinct_payments(payments: DataFrame, session: str = "session_id", order: str = "ts") -> DataFrame:
    """DDP-3: one payment per session, the earliest; only its time is aggregated, before the shuffle."""
    return keep_first(payments, [session], [order])


def skip_immediate_repeats(payments: DataFrame, user: str, session: str, order: list[str],
                           hot_rows: int = HOT_ROWS) -> DataFrame:
    """WIN-4: drop a payment whose session equals the one just before it for the same user."""
    seen = Ordered(payments, [user], order, hot_rows).changed(session, "_new").result()
    return seen.filter("_new").drop("_new")


def balances(users: DataFrame, payments: DataFrame, email: str = "email", amount: str = "credits") -> DataFrame:
    """AGG-6: base credits plus the sum of the payments of each user."""
    paid = payments.groupBy(email).agg(F.sum(amount).alias("_paid"))
    return users.join(paid, email, "left").withColumn(
        "credits", F.coalesce("credits", F.lit(0)) + F.coalesce("_paid", F.lit(0))).drop("_paid")


def _step(balance: Column, amount: Column) -> Column:
    """Credits always apply; a debit applies only when the balance covers it."""
    return F.when(balance + amount >= 0, balance + amount).when(amount >= 0, balance + amount).otherwise(balance)


def _closing(opening: Column, amounts: Column) -> Column:
    return F.aggregate(amounts, opening, _step)


def guarded_ledger(events: DataFrame, key: str, order: list[str], amount: str, opening: DataFrame | None = None,
                   chunk_rows: int = CHUNK_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """WIN-3: apply signed amounts in order; a debit the balance cannot cover is rejected.

    Adds ``accepted`` and ``balance`` (after the event).  ``opening(key, balance)`` gives start
    balances, 0 otherwise.  Amounts and balances are whole numbers.  An event without a key has no balance: it
    comes out as not accepted, with a null balance, and the others are applied as if it were not there.

    A key's events are cut into chunks of ``chunk_rows``.  Inside a chunk the fold is an
    expression over a bounded array.  Where all keys fit one chunk that is the whole plan; for
    larger keys the opening balance of every chunk is found first (``_chunk_openings``).
    """
    amount_col = F.col(amount).cast("bigint")
    unkeyed = events.filter(F.col(key).isNull()).withColumns({"accepted": F.lit(False), "balance": F.lit(None).cast("bigint")})
    events = events.filter(F.col(key).isNotNull())
    several_chunks = has_hot_key(events, [key], chunk_rows)
    numbered = Ordered(events, [key], order, hot_rows, split=None if several_chunks else False).row_number(
        "_seq").result()
    columns = events.columns
    chunks = (numbered
              .withColumn("_chunk", F.floor((F.col("_seq") - 1) / chunk_rows))
              .groupBy(key, "_chunk")
              .agg(F.array_sort(F.collect_list(F.struct(
                  "_seq", amount_col.alias("_amount"), *[c for c in columns if c != key]))).alias("_rows")))
    if opening is None:
        start = chunks.withColumn("_start", F.lit(0).cast("bigint"))
    else:
        start = (chunks.join(opening.select(key, F.col("balance").cast("bigint").alias("_open")), key, "left")
                 .withColumn("_start", F.coalesce("_open", F.lit(0).cast("bigint"))).drop("_open"))
    if several_chunks:
        start = cut(start)
        found = _chunk_openings(start, key)
        start = start.join(found, [key, "_chunk"], "left").withColumn("_start", F.coalesce("_opening", "_start"))
    return _fold_rows(start, key, columns).unionByName(unkeyed)


def _fold_rows(chunks: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Replay each chunk from its opening balance.

    Accepted flags grow as a byte string, one byte per event, so a chunk costs a memory copy per
    event and not an array rebuild; balances after each event are a running sum within the chunk.
    """
    one, zero = F.lit(b"\x01"), F.lit(b"\x00")
    begin = F.struct(F.col("_start").alias("balance"), F.lit(b"").alias("flags"))

    def apply(state: Column, amount: Column) -> Column:
        after = _step(state["balance"], amount)
        taken = (amount >= 0) | (state["balance"] + amount >= 0)
        return F.struct(after.alias("balance"),
                        F.concat(state["flags"], F.when(taken, one).otherwise(zero)).alias("flags"))

    flags = F.aggregate(F.col("_rows._amount"), begin, apply, lambda state: state["flags"])
    rows = (chunks.select(key, "_chunk", "_start", "_rows", flags.alias("_flags"))
            .select(key, "_chunk", "_start", "_flags", F.posexplode("_rows").alias("_i", "_r"))
            .select(key, "_chunk", "_start", "_r",
                    (F.substring("_flags", F.col("_i") + 1, F.lit(1)) == one).alias("accepted")))
    in_chunk = Window.partitionBy(key, "_chunk").orderBy("_r._seq").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    moved = F.sum(F.when(F.col("accepted"), F.col("_r._amount")).otherwise(0)).over(in_chunk)
    picked = [F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in columns]
    return rows.withColumn("balance", F.col("_start") + moved).select(*picked, "accepted", "balance")


def _chunk_openings(chunks: DataFrame, key: str) -> DataFrame:
    """Opening balance of every chunk of the keys that have several: ``(key, _chunk, _opening)``.

    A chunk that rejects nothing only shifts the balance by its net sum, and whether it rejects
    is known from its lowest prefix sum.  Each round passes all such chunks with one window over
    the chunk summaries, then replays at most ``RUN_CHUNKS`` chunks from the first that may
    reject.  Order decides which debits fit, so rejecting stretches of one key are sequential by
    nature; what each task holds stays bounded.
    """
    several = chunks.filter(F.col("_chunk") == 1).select(key)
    amounts = cut(chunks.join(several, key, "left_semi").select(
        key, "_chunk", "_start", F.col("_rows._amount").alias("_amounts")))
    zero = F.lit(0).cast("bigint")
    prefix = F.aggregate(
        F.col("_amounts"), F.struct(zero.alias("sum"), zero.alias("low")),
        lambda s, a: F.struct((s["sum"] + a).alias("sum"), F.least(s["low"], s["sum"] + a).alias("low")))
    summary = cut(amounts.select(key, "_chunk", "_start", prefix.alias("_p")).select(
        key, "_chunk", "_start", F.col("_p.sum").alias("_net"), (-F.col("_p.low")).alias("_need")))
    last = summary.groupBy(key).agg(F.max("_chunk").alias("_last"))
    at = summary.filter(F.col("_chunk") == 0).select(key, F.col("_chunk").alias("_next"), "_start")
    by_chunk = Window.partitionBy(key).orderBy("_chunk")
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done: list[DataFrame] = []
    while not at.isEmpty():
        ahead = (summary.drop("_start").join(at, key).filter(F.col("_chunk") >= F.col("_next"))
                 .withColumn("_open", F.col("_start") + F.coalesce(F.sum("_net").over(before), F.lit(0)))
                 .withColumn("_ok", F.min((F.col("_open") >= F.col("_need")).cast("int")).over(upto) == 1)
                 .withColumn("_was_ok", F.coalesce(F.lag("_ok").over(by_chunk), F.lit(True))))
        ahead = cut(ahead.select(key, "_chunk", "_open", "_ok", "_was_ok"))
        done.append(ahead.filter("_ok").select(key, "_chunk", F.col("_open").alias("_opening")))
        stuck = ahead.filter(~F.col("_ok") & F.col("_was_ok")).select(
            key, F.col("_chunk").alias("_from"), F.col("_open").alias("_at"))
        run = (amounts.join(stuck, key)
               .filter((F.col("_chunk") >= F.col("_from")) & (F.col("_chunk") < F.col("_from") + RUN_CHUNKS))
               .groupBy(key, "_at")
               .agg(F.array_sort(F.collect_list(F.struct("_chunk", "_amounts"))).alias("_run")))
        replay = F.aggregate(
            F.col("_run"),
            F.struct(F.col("_at").alias("balance"), F.array().cast("array<bigint>").alias("openings")),
            lambda s, c: F.struct(_closing(s["balance"], c["_amounts"]).alias("balance"),
                                  F.array_append(s["openings"], s["balance"]).alias("openings")))
        played = cut(run.select(key, "_run._chunk", replay.alias("_s")))
        done.append(played.select(key, F.explode(F.arrays_zip("_chunk", "_s.openings")).alias("_o")).select(
            key, F.col("_o._chunk").alias("_chunk"), F.col("_o.openings").alias("_opening")))
        at = cut(played.select(key, (F.element_at("_chunk", -1) + 1).alias("_next"),
                               F.col("_s.balance").alias("_start"))
                 .join(last, key).filter(F.col("_next") <= F.col("_last")).drop("_last"))
    result = done[0]
    for part in done[1:]:
        result = result.union(part)
    return result

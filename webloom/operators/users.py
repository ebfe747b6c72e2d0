"""User table operators: sign-up, subscription changes, credit lookup (JON-1, JON-9, PRJ-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def sign_up(users: DataFrame, logins: DataFrame, order: str = "ts") -> DataFrame:
    """JON-1: add users for unseen emails, with the defaults of a new account.

    ``logins(email, google_id, <order>)``; the earliest login of an email supplies its google id, of equal
    times the smallest id.  The first time is a hash aggregate, ids come in by a join on it.
    """
    first = logins.groupBy("email").agg(F.min(order).alias("_first"))
    new = first.join(users, "email", "left_anti").withColumnRenamed("email", "_email")
    ids = logins.join(new, (F.col("email") == F.col("_email")) & (F.col(order) == F.col("_first")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("email", order).orderBy("google_id"))
    new = ids.withColumn("_nth", nth).filter("_nth = 1").select("email", "google_id", F.lit("freemium").alias("subscription"),
                     F.lit(0).alias("uploads"), F.lit(False).alias("is_premium"))
    return users.unionByName(new, allowMissingColumns=True)


def apply_subscriptions(users: DataFrame, changes: DataFrame, order: str = "ts") -> DataFrame:
    """JON-9: the changes of each account applied in order: ``upgrade`` or ``cancel``.

    ``changes(email, action, stripe_id, <order>)``; ``order`` is a number or time without repeats in an
    account.  An upgrade sets the stripe id; a cancel takes effect only while there is one, from the
    account or from an upgrade before it.  So the last upgrade and the last change decide.
    """
    upgraded = F.col("action") == "upgrade"
    last = changes.groupBy("email").agg(F.max(F.when(upgraded, F.col(order))).alias("_up"), F.max(order).alias("_last"))
    ids = changes.filter(upgraded).select(F.col("email").alias("_email"), F.col(order).alias("_at"),
                                          F.coalesce("stripe_id", F.lit("")).alias("_stripe"))
    last = (last.join(ids, (F.col("email") == F.col("_email")) & (F.col("_up") == F.col("_at")), "left")
            .select("email", "_stripe", F.col("_up").isNotNull().alias("_upgraded"),
                    (F.col("_up").isNull() | (F.col("_last") > F.col("_up"))).alias("_cancels")))
    joined = users.join(last, "email", "left")
    upgrade = F.coalesce("_upgraded", F.lit(False))
    stripe = F.when(upgrade, F.col("_stripe")).otherwise(F.col("stripe_id"))
    cancel = F.coalesce("_cancels", F.lit(False)) & (F.coalesce(stripe, F.lit("")) != "")
    new = {
        "subscription": F.when(cancel, "none").when(upgrade, "premium").otherwise(F.col("subscription")),
        "is_premium": F.when(cancel, False).when(upgrade, True).otherwise(F.col("is_premium")),
        "stripe_id": F.when(cancel, "").otherwise(stripe),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in users.columns])


def look_up_credits(users: DataFrame, requests: DataFrame) -> DataFrame:
    """PRJ-14: credits by email; ``found`` tells an unknown email from a user without credits."""
    known = users.select("email", F.coalesce("credits", F.lit(0)).alias("credits"), F.lit(True).alias("_found"))
    return requests.join(known, "email", "left").withColumn(
        "found", F.coalesce("_found", F.lit(False))).drop("_found")

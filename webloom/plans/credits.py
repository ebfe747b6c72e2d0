"""Users, pool, payments and ledger over the given tables (JON, WIN, AGG-6, DDP-3, PRJ-14, ML-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators.classify import evaluate, held_out, predict, split_train_test, train
from webloom.operators.ledger import (
    balances, distinct_payments, guarded_ledger, judged_payments, skip_immediate_repeats,
)
from webloom.operators.pool import add_missing_topics, allot, rank_within_type, release
from webloom.operators.users import apply_subscriptions, look_up_credits, sign_up
from webloom.plans.registry import query, table, wide_table


def _users(spark, sf_dir):
    """Customers as accounts; the email is the customer name."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("email"), F.when(F.col("c_mktsegment") == "MACHINERY", "sub").otherwise("").alias(
            "stripe_id"), F.lit("none").alias("subscription"), F.lit(False).alias("is_premium"),
        F.floor(F.abs("c_acctbal")).cast("bigint").alias("credits"))


ACCOUNTS = """
accounts as (
  select c_name as email, case when c_mktsegment = 'MACHINERY' then 'sub' else '' end as stripe_id,
         'none' as subscription, false as is_premium, floor(abs(c_acctbal))::bigint as credits from customer)
"""


@query("jon1_sign_up", """
with users as (select c_name as email, c_mktsegment as subscription, c_nationkey as uploads, true as is_premium
               from customer),
logins as (select 'Customer#' || lpad(user_id::varchar, 9, '0') || case when event_type = 'signup' then '' else '-new' end
                  as email, event_id::varchar as google_id, ts from events)
select email, subscription, uploads, is_premium, null::varchar as google_id from users
union all
select email, 'freemium', 0, false, arg_min(google_id, (ts, google_id)) from logins
where email not in (select email from users) group by email
""")
def sign_up_query(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("email"), F.col("c_mktsegment").alias("subscription"),
        F.col("c_nationkey").alias("uploads"), F.lit(True).alias("is_premium"))
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"),
                    F.when(F.col("event_type") == "signup", "").otherwise("-new"))
    logins = table(spark, sf_dir, "events").select(
        name.alias("email"), F.col("event_id").cast("string").alias("google_id"), "ts")
    return sign_up(users, logins)


@query("jon2_add_missing_topics", """
with pool as (select distinct 'topic_' || p_type || '_' || p_size as topic from part where p_brand = 'Brand#3'),
topics as (select distinct 'topic_' || p_type || '_' || p_size as topic from part)
select topic, split_part(topic, '_', 2) as task_type, case when topic in (select topic from pool) then 'busy'
       else 'available' end as status, case when topic in (select topic from pool) then 'w1' end as workflow_id
from topics
""")
def add_missing(spark, sf_dir):
    topics = table(spark, sf_dir, "part").select(
        "p_brand", F.concat_ws("_", F.lit("topic"), "p_type", F.col("p_size").cast("string")).alias("topic"))
    pool = topics.filter(F.col("p_brand") == "Brand#3").select("topic").distinct().select(
        "topic", F.split_part("topic", F.lit("_"), F.lit(2)).alias("task_type"), F.lit("busy").alias("status"),
        F.lit("w1").alias("workflow_id"))
    return add_missing_topics(pool, topics)


@query("jon3_pool_allotment", """
with wanted as (select event_id as task_id, event_type as task_type,
                       row_number() over (partition by event_type order by ts, event_id) as slot from events),
pool as (select p_partkey, ['click', 'view', 'purchase', 'signup', 'error'][p_size % 5 + 1] as task_type from part
         where p_brand <> 'Brand#3'),
free as (select 'topic_' || p_partkey as topic_name, task_type,
                row_number() over (partition by task_type order by p_partkey) as slot from pool)
select w.task_type, w.slot::bigint as slot, w.task_id, f.topic_name
from wanted w left join free f on f.task_type = w.task_type and f.slot = w.slot
""")
def allotment(spark, sf_dir):
    """Events ask for a pool row of their type; parts are the pool, those of one brand already taken."""
    requests = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("task_id"), F.col("event_type").alias("task_type"), "ts")
    kinds = F.array(*[F.lit(k) for k in ("click", "view", "purchase", "signup", "error")])
    pool = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("topic_"), F.col("p_partkey").cast("string")).alias("topic_name"),
        F.get(kinds, F.col("p_size") % 5).alias("task_type"), (F.col("p_brand") == "Brand#3").alias("assigned"))
    return allot(requests, pool, ["ts", "task_id"], ["p_partkey"]).drop("ts")


@query("jon4_pool_release", """
select c_custkey as topic_name, c_nationkey::varchar as task_type,
       case when c_mktsegment in (select c_mktsegment from customer where c_acctbal < -990) then false else true end
         as assigned,
       case when c_mktsegment in (select c_mktsegment from customer where c_acctbal < -990) then '' else c_mktsegment
       end as workflow_id
from customer
""")
def pool_release(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    pool = customers.select(F.col("c_custkey").alias("topic_name"), F.col("c_nationkey").cast("string").alias("task_type"),
                            F.lit(True).alias("assigned"), F.col("c_mktsegment").alias("workflow_id"))
    finished = customers.filter(F.col("c_acctbal") < -990).select(F.col("c_mktsegment").alias("workflow_id"))
    return release(pool, finished)


PAYMENTS = """
sessions as (
  select case when event_type = 'error' then 'checkout.session.expired' else 'checkout.session.completed' end as type,
         'cs_' || event_id as session_id, 'pi_' || (event_id + user_id) as payment_intent_id,
         'Customer#' || lpad(user_id::varchar, 9, '0') || case when event_type = 'view' then '-gone' else '' end
           as customer_email, ts from events),
intents as (select 'pi_' || event_id as payment_intent_id,
                   case when event_type = 'signup' then 'none' else props->>'k' end as credits from events),
joined as (
  select s.session_id, s.customer_email, try_cast(i.credits as int) as credits, s.ts,
         case when i.payment_intent_id is null then 'payment intent not found'
              when try_cast(i.credits as int) is null or try_cast(i.credits as int) <= 0 then 'invalid credit amount'
              when c.c_name is null then 'user not found' end as reject_reason
  from sessions s left join intents i using (payment_intent_id) left join customer c on c.c_name = s.customer_email
  where s.type = 'checkout.session.completed')
"""


def _payments(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    email = F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"),
                     F.when(F.col("event_type") == "view", "-gone").otherwise(""))
    sessions = events.select(
        F.when(F.col("event_type") == "error", "checkout.session.expired").otherwise(
            "checkout.session.completed").alias("type"),
        F.concat(F.lit("cs_"), F.col("event_id").cast("string")).alias("session_id"),
        F.concat(F.lit("pi_"), (F.col("event_id") + F.col("user_id")).cast("string")).alias("payment_intent_id"),
        email.alias("customer_email"), "ts")
    credits = F.when(F.col("event_type") == "signup", "none").otherwise(F.get_json_object("props", "$.k"))
    intents = events.select(F.concat(F.lit("pi_"), F.col("event_id").cast("string")).alias("payment_intent_id"),
                            F.create_map(F.lit("credits"), credits).alias("metadata"))
    return judged_payments(sessions, intents, _users(spark, sf_dir))


@query("jon5_accepted_payments", "with " + PAYMENTS + """
select session_id, customer_email, credits, ts from joined where reject_reason is null
""")
def accepted_payments(spark, sf_dir):
    return _payments(spark, sf_dir).filter("reject_reason is null").drop("reject_reason")


@query("jon5_rejected_payments", "with " + PAYMENTS + """
select session_id, customer_email, credits, ts, reject_reason from joined
where reject_reason is not null
""")
def rejected_payments(spark, sf_dir):
    return _payments(spark, sf_dir).filter("reject_reason is not null")


@query("agg6_credit_balances", "with " + ACCOUNTS + "," + PAYMENTS + """
select a.email, (a.credits + coalesce(sum(j.credits), 0))::bigint as credits
from accounts a left join joined j on j.customer_email = a.email and j.reject_reason is null
group by a.email, a.credits
""")
def credit_balances(spark, sf_dir):
    paid = distinct_payments(accepted_payments(spark, sf_dir)).withColumnRenamed("customer_email", "email")
    return balances(_users(spark, sf_dir), paid).select("email", "credits")


@query("ddp3_distinct_payments", """
select session_id, min(ts) as ts, min_by(credits, ts) as credits
from (select user_id::varchar || '-' || (props->>'k') as session_id, ts, (props->>'k')::bigint as credits from events)
group by session_id
""")
def distinct_payments_query(spark, sf_dir):
    return distinct_payments(_replayed(spark, sf_dir).drop("user_id", "event_id")).select("session_id", "ts", "credits")


def _replayed(spark, sf_dir):
    """Payments whose session id repeats: the user and the amount name the session."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", k.cast("bigint").alias("credits"),
        F.concat_ws("-", F.col("user_id").cast("string"), k).alias("session_id"))


@query("win4_immediate_repeats", """
select event_id, event_type from (
  select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)
where before is distinct from event_type
""")
def immediate_repeats(spark, sf_dir):
    payments = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return skip_immediate_repeats(payments, "user_id", "event_type", ["ts", "event_id"]).select(
        "event_id", "event_type")


@query("win2_rank_within_type", """
select l_orderkey, l_linenumber, l_returnflag, l_suppkey, l_partkey,
       row_number() over (partition by l_returnflag order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_partkey,
                          l_extendedprice) as slot
from lineitem
""")
def rank_query(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice")
    ranked = rank_within_type(items, "l_returnflag", ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey",
                                                      "l_partkey", "l_extendedprice"])
    return ranked.drop("l_shipdate", "l_extendedprice")


# The SQL replays each customer's amounts with a list fold that keeps the balance after every event.
LEDGER = """
with moves as (
  select o_custkey, o_orderkey, o_orderdate,
         case when o_orderstatus = 'F' then floor(o_totalprice / 100)::bigint
              else -floor(o_totalprice / 90)::bigint end as amount from orders),
lists as (
  select o_custkey, list(o_orderkey order by o_orderdate, o_orderkey) as ids,
         list(amount order by o_orderdate, o_orderkey) as amounts from moves group by o_custkey),
folded as (
  select o_custkey, ids, amounts, list_reduce([[0::bigint]] || list_transform(amounts, lambda a: [a]),
         lambda b, a: b || [case when b[-1] + a[1] >= 0 then b[-1] + a[1] else b[-1] end])[2:] as balances from lists),
entries as (
  select o_custkey, unnest(ids) as o_orderkey, unnest(amounts) as amount, unnest(balances) as balance,
         unnest([0::bigint] || balances[:-2]) as before from folded)
"""


def _moves(spark, sf_dir):
    amount = F.when(F.col("o_orderstatus") == "F", F.floor(F.col("o_totalprice") / 100)).otherwise(
        -F.floor(F.col("o_totalprice") / 90))
    return table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", amount.cast("bigint").alias("amount"))


@query("win3_guarded_ledger", LEDGER + """
select o_custkey, o_orderkey, amount, balance, (before + amount >= 0) as accepted from entries
""")
def guarded(spark, sf_dir):
    return guarded_ledger(_moves(spark, sf_dir), "o_custkey", ["o_orderdate", "o_orderkey"], "amount").drop(
        "o_orderdate")


@query("prj14_credit_lookup", "with " + ACCOUNTS + """
, wanted as (select event_id, 'Customer#' || lpad((user_id + (props->>'k')::bigint * 20)::varchar, 9, '0') as email
             from events)
select w.event_id, w.email, a.credits, a.email is not null as found from wanted w left join accounts a using (email)
""")
def credit_lookup(spark, sf_dir):
    number = F.col("user_id") + F.get_json_object("props", "$.k").cast("bigint") * 20
    requests = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("Customer#"), F.lpad(number.cast("string"), 9, "0")).alias("email"))
    return look_up_credits(_users(spark, sf_dir), requests)


@query("jon9_subscriptions", "with " + ACCOUNTS + """
, moves as (
  select 'Customer#' || lpad(user_id::varchar, 9, '0') as email, list({'subscription': '', 'is_premium': false,
           'stripe_id': 'sub_' || event_id, 'up': event_type in ('purchase', 'signup')} order by ts) as steps
  from events group by 1),
replayed as (
  select a.email, a.credits, list_reduce(coalesce(steps, []), lambda s, c:
    case when c.up then {'subscription': 'premium', 'is_premium': true, 'stripe_id': c.stripe_id, 'up': true}
         when s.stripe_id <> '' then {'subscription': 'none', 'is_premium': false, 'stripe_id': '', 'up': true} else s end,
    {'subscription': a.subscription, 'is_premium': a.is_premium, 'stripe_id': a.stripe_id, 'up': true}) as r
  from accounts a left join moves using (email))
select email, credits, r.subscription as subscription, r.is_premium as is_premium, r.stripe_id as stripe_id from replayed
""")
def subscriptions(spark, sf_dir):
    changes = table(spark, sf_dir, "events").select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("email"),
        F.when(F.col("event_type").isin("purchase", "signup"), "upgrade").otherwise("cancel").alias("action"),
        F.concat(F.lit("sub_"), F.col("event_id").cast("string")).alias("stripe_id"), "ts")
    return apply_subscriptions(_users(spark, sf_dir), changes)


def _predictions(spark, sf_dir):
    """All documents with their label, where they have one, and the prediction of a model trained on a hashed 80 percent of the labelled."""
    docs, labels = wide_table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labels = labels.select("doc_id", F.col("quality").cast("double").alias("label"), F.lit(True).alias("labelled"))
    examples = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(labels, "doc_id", "left")
    training, _ = split_train_test(examples.where("labelled"), "doc_id")
    return predict(train(training), examples)


@query("ml1_page_predictions")
def page_predictions(spark, sf_dir):
    """The predicted quality of every document, labelled or not; no SQL trains a model."""
    return _predictions(spark, sf_dir).select("doc_id", held_out("doc_id").alias("held_out"), "label", "prediction")


@query("ml1_scored_documents", """
select doc_id, (('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 1000) >= 800 as held_out, quality::double as label, true as scored
from documents left join labels using (doc_id)
""")
def scored_documents(spark, sf_dir):
    """ML-1: every document gets one of the two classes."""
    return page_predictions(spark, sf_dir).select("doc_id", "held_out", "label", F.col("prediction").isin(0, 1).alias("scored"))


@query("ml1_page_classifier", """
with labelled as (
  select quality, (('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 1000) >= 800 as held_out
  from documents join labels using (doc_id))
select held_out, count(*) as n, true as at_least_majority from labelled group by held_out
""")
def page_classifier(spark, sf_dir):
    """Quality of labelled documents, from the predictions for all: trained on a hashed 80 percent, scored on both parts.

    The share of right answers is no less than the share of the commonest label, on seen and on held-out documents.
    """
    return evaluate(_predictions(spark, sf_dir).where("labelled"), "doc_id").select(
        "held_out", "n", (F.col("accuracy") >= F.col("majority")).alias("at_least_majority"))

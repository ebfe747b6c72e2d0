"""Sources, sinks, flattening, users, payments and views on small fixtures."""

import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from webloom.functions import text as X
from webloom.functions.urls import absolute_link, absolute_links_in, origin
from webloom.operators.classify import predict, split_train_test, train
from webloom.operators.dedup import first_content, keep_first
from webloom.operators.ledger import balances, distinct_payments, enrich_payments, skip_immediate_repeats
from webloom.operators.metrics import BUCKETS, bucket_name, duration_histogram
from webloom.operators.pool import add_missing_topics, release
from webloom.operators.records import (
    append_batches, flatten_json, flatten_struct, header, reject_reason, repair_pages, widen, workflow_rules,
    wrap_transformed,
)
from webloom.operators.users import apply_subscriptions, look_up_credits, sign_up
from webloom.operators.sessions import collect_actions
from webloom.operators.views import create_view, list_catalog, run_sql, view_exists, workflow_rows
from webloom.operators.workflow import fan_out, root_tasks, terminal_tasks
from webloom.sinks.messages import record_messages, task_messages
from webloom.sinks.tables import write_action_logs, action_logs, write_csv, append_collection
from webloom.sources.generators import POOL_COUNTS, TOPIC_COUNTS, count_rows, number_rows, page_urls, seed_pool, topic_names
from webloom.sources.kafka import user_of_topic, user_topic
from webloom.sources.tables import apply_schema, declared_schema, explode_forms, read_forms


def one(spark, column):
    return spark.range(1).select(column).first()[0]


# -- expressions -----------------------------------------------------------------
def test_trim_strips_every_white_space(spark):
    assert one(spark, X.unicode_trim(F.lit("    \u0085\t a b 　\n"))) == "a b"
    import sys

    spaces = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace() and not 0x1C <= c <= 0x1F]
    assert sorted(X.WHITE_SPACE) == sorted(spaces)


def test_list_expressions(spark):
    base = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, X.add_selectors(base, F.lit(" b , c,, d ,c"))) == ["a", "b", "c", "d"]
    assert one(spark, X.add_selectors(base, F.lit(None).cast("string"))) == ["a", "b"]
    assert one(spark, X.add_if_absent(base, F.lit("b"))) == ["a", "b"]
    assert one(spark, X.remove_at(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.lit(0))) == ["b", "a"]
    three = F.array(F.lit(".card"), F.lit("h2"), F.lit("p"))
    assert one(spark, X.container_of(three)) == ".card"
    assert one(spark, X.numbered_fields(three)) == {"field1": "h2", "field2": "p"}
    assert one(spark, X.numbered_fields(F.array(F.lit(".card")))) == {}


def test_text_expressions(spark):
    assert one(spark, X.strip_marker(F.lit("div.card.highlight p.highlighted"))) == "div.card p.highlighted"
    assert one(spark, X.site_key(F.lit("https://a.example:8080/x"))) == "a.example_8080_x"
    assert one(spark, X.token(F.lit("topic_scrape"), "_", 2)) == "scrape"
    assert one(spark, X.token(F.lit("topic"), "_", 2)) is None
    assert one(spark, X.token(F.lit("a.b"), ".", 2)) == "b"
    assert one(spark, X.decode_base64(F.lit("eyJhIjoxfQ=="))) == '{"a":1}'
    assert one(spark, X.decode_base64(F.lit("no base64!"))) is None
    assert one(spark, X.fill_actions(F.lit("name, email, resume"))) == "fill(name), fill(email), upload(resume)"
    assert one(spark, X.upper_values(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit(None)))) == {
        "a": "X", "b": None}
    assert one(spark, user_of_topic(F.lit("workflow_u_1"))) == "u_1"
    assert one(spark, user_topic("u1")) == "workflow_u1"


@pytest.mark.parametrize("link,expected", [
    ("/a/b", "https://h:1/a/b"), ("a", "https://h:1/a"), ("./a", "https://h:1/a"), ("../a", "https://h:1/a"),
    ("#x", "https://h:1/#x"), ("?q=1", "https://h:1/?q=1"), ("", "https://h:1/"), ("//cdn/x", "//cdn/x"),
    ("http://o/x", "http://o/x"), ("mailto:a@b", "mailto:a@b"), ("/é x", "https://h:1/%C3%A9%20x"),
    (" /a\n ", "https://h:1/a"), (" mailto:a@b", "mailto:a@b"), ("/../a/./b", "https://h:1/a/./b"), ("httpx", "httpx"),
    ("/%C3%A9", "https://h:1/%C3%A9"), ("/日", "https://h:1/%E6%97%A5"), ("/😀", "https://h:1/%F0%9F%98%80"),
])
def test_absolute_links(spark, link, expected):
    assert one(spark, absolute_link(F.lit(link), F.lit("https://h:1"))) == expected


def test_absolute_links_in_html(spark):
    html = """<img src="a.png"><a href='/single'><a href="/$1\\x"></a><link href="http://o">$"""
    assert one(spark, absolute_links_in(F.lit(html), F.lit("https://h"))) == (
        """<img src="https://h/a.png"><a href='/single'><a href="https://h/$1\\x"></a><link href="http://o">$""")
    assert one(spark, absolute_links_in(F.lit("none"), F.lit("https://h"))) == "none"
    assert one(spark, origin(F.lit("https://h:1/x?y#z"))) == "https://h:1"


# -- flattening -------------------------------------------------------------------
def flattened(spark, text):
    return spark.createDataFrame([(text,)], "j string").select(flatten_json("j")).first()[0]


def test_flatten_golden(spark):
    assert flattened(spark, '{"a":{"b":1,"e":{}},"c":[1,{"x":2}],"d":null}') == '{"a.b":1,"c":[1,{"x":2}],"d":null}'
    assert flattened(spark, "{}") == "{}"
    assert flattened(spark, None) is None


def test_flatten_collision_raises(spark):
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        flattened(spark, '{"a.b":1,"a":{"b":2}}')


@pytest.mark.parametrize("depth", [1, 18, 40, 200])
def test_flatten_to_any_depth(spark, depth):
    deep = "{\"a\":" * depth + "1" + "}" * depth
    assert flattened(spark, deep) == '{"%s":1}' % ".".join("a" * depth)
    assert flattened(spark, '{"x":"{{\\"{","y":[{"z":{"w":1}}],"n":' + deep + "}") == (
        '{"n.%s":1,"x":"{{\\"{","y":[{"z":{"w":1}}]}' % ".".join("a" * depth))


def test_repeated_keys_last_one_counts(spark):
    assert flattened(spark, '{"a":1,"a":{"b":2,"b":3}}') == '{"a.b":3}'


VALUES = st.recursive(
    st.one_of(st.integers(-5, 5), st.text("ab\"é{}", max_size=4), st.none(), st.booleans()),
    lambda inner: st.one_of(st.lists(inner, max_size=2), st.dictionaries(st.sampled_from("pqr"), inner, max_size=2)),
    max_leaves=8)


def flat(value, prefix=""):
    result = {}
    for key, inner in value.items():
        name = f"{prefix}.{key}" if prefix else key
        result.update(flat(inner, name) if isinstance(inner, dict) else {name: inner})
    return result


def test_flatten_against_a_recursive_walk(spark):
    cases = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.dictionaries(st.sampled_from("xyz"), VALUES, max_size=3))
    def gather(value):
        cases.append(value)

    gather()
    frame = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(cases)], "i int, j string")
    for row in frame.select("i", flatten_json("j").alias("f")).collect():
        assert json.loads(row.f) == flat(cases[row.i])
        assert list(json.loads(row.f)) == sorted(json.loads(row.f))


def test_flatten_struct(spark):
    frame = spark.createDataFrame([((1, ("x",)), [1])], "a struct<b:int,c:struct<`d.e`:string>>, f array<int>")
    assert flatten_struct(frame).columns == ["a.b", "a.c.d.e", "f"]
    with pytest.raises(ValueError):
        flatten_struct(spark.createDataFrame([(1, (2,))], "`a.b` int, a struct<b:int>"))


def test_messages(spark, rows):
    records = spark.createDataFrame([("T", None, {"k": "v"})], "title string, price string, more map<string,string>")
    assert rows(record_messages(records)) == [('{"more.k":"v","title":"T"}',)]
    assert rows(record_messages(records.drop("more"))) == [('{"title":"T"}',)]
    tasks = spark.createDataFrame([("store", '{"b":1, "a":[2]}')], "task_type string, payload string")
    assert rows(task_messages(tasks)) == [("store", '{"payload":{"a":[2],"b":1},"task_type":"store"}')]
    assert rows(task_messages(tasks, keyed=False, json_payload=False)) == [
        ('{"payload":"{\\"b\\":1, \\"a\\":[2]}","task_type":"store"}',)]


# -- tables -----------------------------------------------------------------------
def test_header_widen_csv(spark, rows, tmp_path):
    frame = spark.createDataFrame([(1, {"b": "x", "a": "y,\"z"}), (2, {"c": "w"})], "i int, r map<string,string>")
    assert header(frame, "r") == ["a", "b", "c"]
    assert widen(frame, "r").columns == ["i", "a", "b", "c"]
    write_csv(frame, str(tmp_path / "csv"), "r")
    back = spark.read.options(header=True, escape='"').csv(str(tmp_path / "csv"))
    assert rows(back) == [("1", 'y,"z', "x", None), ("2", None, None, "w")]


def test_forms(spark, rows, tmp_path):
    path = tmp_path / "forms.json"
    path.write_text(json.dumps([
        {"website": "one", "form": {"fields": ["name", "resume"], "actions": ["fill", "upload"]}, "html": "<form>"},
        {"website": "two", "form": {"fields": ["email"], "actions": []}, "html": ""}], indent=2))
    forms = read_forms(spark, str(path))
    assert rows(explode_forms(forms, "fields")) == [("one", "name"), ("one", "resume"), ("two", "email")]
    assert rows(explode_forms(forms, "actions")) == [("one", "fill"), ("one", "upload")]


def test_declared_schema(spark, rows):
    schemas = spark.createDataFrame(
        [("tasks", [("_id", "varchar", True), ("workflow_id", "bigint", False), ("name", "varchar", False)]),
         ("odd", [("x", "blob", False)])],
        "table string, fields array<struct<name:string,type:string,hidden:boolean>>")
    schema = declared_schema(schemas, "tasks")
    assert schema.simpleString() == "struct<workflow_id:bigint,name:string>"
    documents = spark.createDataFrame([('{"_id":"q","workflow_id":1,"name":"n"}',)], "d string")
    assert rows(apply_schema(documents, "d", schema)) == [(1, "n")]
    for table in ("none", "odd"):
        with pytest.raises(ValueError):
            declared_schema(schemas, table)


def test_generators(spark, rows):
    counts = spark.createDataFrame([("scrape", 2), ("store", 0), ("odd", -1), ("gone", None)], "task_type string, n int")
    assert rows(topic_names(counts), "topic_name") == [("scrape_1",), ("scrape_2",)]
    assert rows(seed_pool(counts)) == [("scrape_1", "scrape", False, ""), ("scrape_2", "scrape", False, "")]
    assert topic_names(count_rows(spark, TOPIC_COUNTS)).count() == 35
    assert seed_pool(count_rows(spark, POOL_COUNTS)).filter("task_type = 'transform'").count() == 5
    specs = spark.createDataFrame([("http://x", 2), ("http://y", 0)], "url string, page_num int")
    assert rows(page_urls(specs), "page_url") == [("http://x?page=1",), ("http://x?page=2",)]
    big = number_rows(spark.createDataFrame([(200_001,)], "n int"), F.col("n"), "i")
    stats = big.agg(F.count("i"), F.countDistinct("i"), F.min("i"), F.max("i")).first()
    assert tuple(stats) == (200_001, 200_001, 1, 200_001)


def test_validation_and_defaults(spark, rows):
    frame = spark.createDataFrame([("u", "w", ["t"]), ("", "w", ["t"]), ("u", None, ["t"]), ("u", "w", []), ("u", "w", None)],
                                  "user_id string, workflow_id string, tasks array<string>")
    reasons = [r[0] for r in frame.select(reject_reason(workflow_rules())).collect()]
    assert reasons == [None, "missing user_id", "missing workflow_id", "no tasks", "no tasks"]
    pages = spark.createDataFrame([(None,), (0,), (-3,), (4,)], "p int")
    assert [r[0] for r in pages.select(repair_pages(F.col("p"))).collect()] == [1, 1, 1, 4]


def test_workflow_dependencies(spark, rows):
    tasks = spark.createDataFrame([(1, "a", []), (1, "b", ["a"]), (1, "c", ["a"]), (1, "d", None), (2, "a", [])],
                                  "w int, task_id string, depends_on array<string>")
    assert rows(root_tasks(tasks), "w", "task_id") == [(1, "a"), (1, "d"), (2, "a")]
    assert rows(terminal_tasks(tasks, ["w"]), "w", "task_id") == [(1, "b"), (1, "c"), (1, "d"), (2, "a")]
    flows = spark.createDataFrame([(1, '[{"task_id":"a"},"b"]'), (2, "[]")], "w int, tasks string")
    assert rows(fan_out(flows)) == [(1, 0, '{"task_id":"a"}'), (1, 1, "b")]


def test_wrap_and_union(spark, rows):
    assert one(spark, wrap_transformed(F.lit('{"a":1}'))) == '{"transformed":"{\\"a\\":1}"}'
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("q",)], "y string")
    assert rows(append_batches({"a": a, "b": b})) == sorted([("a", 1, None), ("b", None, "q")], key=repr)
    with pytest.raises(ValueError):
        append_batches({})


# -- users and payments -------------------------------------------------------------
USERS = "email string, stripe_id string, subscription string, is_premium boolean, credits int"


def test_sign_up(spark, rows):
    users = spark.createDataFrame([("a", "paid", 3, True)], "email string, subscription string, uploads int, is_premium boolean")
    logins = spark.createDataFrame([("a", "g0", 1), ("b", "g2", 2), ("b", "g1", 1)], "email string, google_id string, ts int")
    assert rows(sign_up(users, logins), "email", "subscription", "uploads", "is_premium", "google_id") == [
        ("a", "paid", 3, True, None), ("b", "freemium", 0, False, "g1")]


def test_subscriptions(spark, rows):
    users = spark.createDataFrame([("a", "", "none", False, 0), ("b", "s", "premium", True, 0), ("c", "", "x", False, 0),
                                   ("d", None, "x", False, 0)], USERS)
    changes = spark.createDataFrame([("a", "upgrade", "s9", 2), ("a", "cancel", None, 1), ("b", "cancel", None, 1),
                                     ("c", "cancel", None, 1)], "email string, action string, stripe_id string, ts int")
    assert rows(apply_subscriptions(users, changes), "email", "subscription", "is_premium", "stripe_id") == [
        ("a", "premium", True, "s9"), ("b", "none", False, ""), ("c", "x", False, ""), ("d", "x", False, None)]


def test_upgrade_then_cancel(spark, rows):
    users = spark.createDataFrame([(e, s, "freemium", False, 0) for e, s in [("a", ""), ("b", None), ("c", "s"), ("d", ""), ("e", "s")]], USERS)
    steps = {"a": ["u1", "c"], "b": ["c", "u2"], "c": ["c", "c"], "d": ["u", "c"], "e": ["c", "u3", "u4", "c", "c"]}
    changes = spark.createDataFrame([(e, "upgrade" if x[0] == "u" else "cancel", x[1:] or None, i) for e, xs in steps.items() for i, x in enumerate(xs)],
                                    "email string, action string, stripe_id string, ts int")
    assert rows(apply_subscriptions(users, changes), "email", "subscription", "is_premium", "stripe_id") == [
        ("a", "none", False, ""), ("b", "premium", True, "2"), ("c", "none", False, ""), ("d", "premium", True, ""), ("e", "none", False, "")]


def test_credit_lookup(spark, rows):
    users = spark.createDataFrame([("a", None), ("b", 5)], "email string, credits int")
    asked = spark.createDataFrame([("a",), ("b",), ("z",)], "email string")
    assert rows(look_up_credits(users, asked)) == [("a", 0, True), ("b", 5, True), ("z", None, False)]


def test_payments(spark, rows):
    sessions = spark.createDataFrame(
        [("checkout.session.completed", s, p, e, t) for s, p, e, t in [
            ("s1", "p1", "a", 1), ("s1", "p1", "a", 2), ("s2", "p2", "a", 3), ("s3", "p3", "zz", 4), ("s4", "none", "a", 5)]]
        + [("other", "s9", "p1", "a", 9)],
        "type string, session_id string, payment_intent_id string, customer_email string, ts int")
    intents = spark.createDataFrame([("p1", {"credits": "10"}), ("p2", {"credits": "x"}), ("p3", {"credits": "5"})],
                                    "payment_intent_id string, metadata map<string,string>")
    users = spark.createDataFrame([("a", 1)], "email string, credits int")
    accepted, rejected = enrich_payments(sessions, intents, users)
    assert rows(accepted, "session_id", "credits") == [("s1", 10), ("s1", 10)]
    assert rows(rejected, "session_id", "reject_reason") == [
        ("s2", "invalid credit amount"), ("s3", "user not found"), ("s4", "payment intent not found")]
    paid = distinct_payments(accepted).withColumnRenamed("customer_email", "email")
    assert rows(paid, "session_id", "ts") == [("s1", 1)]
    assert rows(balances(users, paid), "email", "credits") == [("a", 11)]


def test_immediate_repeat_against_session_idempotence(spark, rows):
    replay = spark.createDataFrame([("u", "s1", 1), ("u", "s1", 2), ("u", "s2", 3), ("u", "s1", 4)],
                                   "user string, session_id string, ts int")
    assert rows(skip_immediate_repeats(replay, "user", "session_id", ["ts"]), "ts") == [(1,), (3,), (4,)]
    assert rows(distinct_payments(replay), "ts") == [(1,), (3,)]


def test_pool_tables(spark, rows):
    pool = spark.createDataFrame([("topic_scrape", "scrape", "busy", "w")],
                                 "topic string, task_type string, status string, workflow_id string")
    topics = spark.createDataFrame([("topic_scrape",), ("topic_store",), ("topic_store",)], "topic string")
    assert rows(add_missing_topics(pool, topics)) == [
        ("topic_scrape", "scrape", "busy", "w"), ("topic_store", "store", "available", None)]
    held = spark.createDataFrame([("t1", True, "w1"), ("t2", True, "w2"), ("t3", False, "")],
                                 "topic_name string, assigned boolean, workflow_id string")
    done = spark.createDataFrame([("w1",), ("w1",), ("",), (None,)], "workflow_id string")
    assert rows(release(held, done)) == [("t1", False, ""), ("t2", True, "w2"), ("t3", False, "")]
    nobody = spark.createDataFrame([("t4", False, None)], held.schema)
    assert rows(release(held.union(nobody), done))[-1] == ("t4", False, None)


def test_dedup(spark, rows):
    frame = spark.createDataFrame([("u", 2, "new"), ("u", 1, "old"), ("v", 1, None)], "url string, fetched_at int, html string")
    assert rows(first_content(frame)) == sorted([("u", "old"), ("v", None)], key=repr)

    assert rows(keep_first(frame, ["url"], ["fetched_at"])) == sorted([("u", 1, "old"), ("v", 1, None)], key=repr)


def test_histogram(spark):
    frame = spark.createDataFrame([("a", 0.003), ("a", 0.25), ("a", 99.0), ("a", None)], "task_type string, d double")
    row = duration_histogram(frame, "d").first()
    assert [row[bucket_name(b)] for b in BUCKETS] == [1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2]
    assert (row.le_inf, row.duration_count, round(row.duration_sum, 3)) == (3, 3, 99.253)


# -- views -----------------------------------------------------------------------
def test_views(spark, rows):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "workflow_id bigint, v string")
    assert rows(workflow_rows(frame, "1")) == [(1, "a")]
    assert rows(workflow_rows(frame, "abc' or '1'='1")) == []
    name = create_view(frame, "acme", 2)
    assert view_exists(spark, name) and rows(spark.table(name)) == [(2, "b")]
    with pytest.raises(ValueError):
        create_view(frame, "x; drop table y", 1)
    assert rows(run_sql(spark, "select v from wl_t where workflow_id = :w", {"wl_t": frame}, {"w": 1})) == [("a",)]
    listed = rows(list_catalog(spark))
    assert ("catalog", "spark_catalog") in listed and ("schema", "default") in listed and ("table", name) in listed


def test_sinks(spark, rows, tmp_path):
    actions = spark.createDataFrame([("https://a:1", 1, "click"), ("https://a:1", 2, "navigate"), ("http://b", 1, "click")],
                                    "origin string, ts int, type string")
    write_action_logs(action_logs(actions, "origin", ["ts"], ["type", "ts"], F.lit("all")), str(tmp_path / "logs"))
    back = spark.read.json(str(tmp_path / "logs"))
    assert rows(back, "site_key", "website", F.col("actions.type")) == [
        ("a_1", "https://a:1", ["click", "navigate"]), ("b", "http://b", ["click"])]
    pieces = collect_actions(spark.range(25).select((F.col("id") % 2).alias("site"), F.col("id").alias("at")), ["site"], ["at"], ["at"], F.lit("d"), most=5)
    assert rows(pieces, "site", "piece", F.col("actions.at")) == sorted(
        (s, p, list(range(s, 25, 2))[p * 5:p * 5 + 5]) for s in (0, 1) for p in range(3) if list(range(s, 25, 2))[p * 5:])
    for _ in range(2):
        append_collection(actions, str(tmp_path / "coll"))
    assert spark.read.parquet(str(tmp_path / "coll")).count() == 6


def test_classifier_learns(spark):
    data = [(i, "good clean page" if i % 2 else "spam junk offer", float(i % 2)) for i in range(60)]
    frame = spark.createDataFrame(data, "id int, text string, label double")
    training, rest = split_train_test(frame, "id")
    assert training.count() + rest.count() == 60 and training.join(rest, "id").count() == 0
    scored = predict(train(training, features=1024), rest)
    assert scored.filter("label <> prediction").count() == 0


def test_classifier_scores_every_document(spark):
    from webloom.plans import load

    folder = "/root/testdata/sf0.001"
    found = load()[0]["ml1_page_predictions"](spark, folder).collect()
    keys = sorted(r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect())
    labelled = spark.read.parquet(f"{folder}/labels.parquet").count()
    assert sorted(r["doc_id"] for r in found) == keys and all(r["prediction"] in (0.0, 1.0) for r in found)
    assert 0 < sum(r["label"] is not None for r in found) <= labelled and any(r["label"] is None for r in found)


@pytest.mark.parametrize("kind,keys", [
    ("timestamp", ["2024-01-01 00:00:00.000100", "2024-01-01 00:00:00.000900", None]), ("decimal(38,20)", ["0.00000000000000000001", "0.00000000000000000002", None]),
    ("double", ["0.1", "0.10000000000000002", None]), ("string", ["a", "a ", None]), ("binary", ["x", "y", None]),
    ("struct<a:timestamp_ntz>", None)])
def test_first_of_each_key_as_it_is(spark, kind, keys):
    """Keys differ wherever their values do; null is a key; nulls come last in the order; of equal rows any one."""
    if keys is None:
        made = [F.struct(F.lit(f"2024-01-01 00:00:00.00{i}").cast("timestamp_ntz").alias("a")) for i in ("0001", "0002")] + [F.lit(None).cast(kind)]
    else:
        made = [F.lit(k).cast(kind) for k in keys]
    one = spark.range(4).crossJoin(spark.range(3).withColumnRenamed("id", "which"))
    pick = F.when(F.col("which") == 0, made[0]).when(F.col("which") == 1, made[1]).otherwise(made[2])
    frame = one.select(pick.alias("k"), "which", F.when(F.col("id") > 0, F.col("id")).alias("at"), F.col("id").alias("n"), F.concat(F.lit("h"), "id").alias("html"))
    found = keep_first(frame, ["k"], ["at"])
    assert found.columns == frame.columns
    assert sorted((r.which, r["at"], r.n, r.html) for r in found.collect()) == [(i, 1, 1, "h1") for i in range(3)]
    slim = keep_first(frame.drop("html"), ["k"], ["at"])
    assert sorted((r.which, r["at"], r.n) for r in slim.collect()) == [(i, 1, 1) for i in range(3)]
    never = keep_first(frame.withColumn("at", F.lit(None).cast("int")), ["k"], ["at"])
    assert sorted(r.which for r in never.collect()) == [0, 1, 2]


def test_first_of_each_key_takes_whole_rows(spark):
    frame = spark.range(3000).select((F.col("id") % 7).alias("k"), (F.col("id") % 3).alias("at"), F.col("id").alias("a"), (-F.col("id")).alias("b"),
                                     F.col("id").cast("string").alias("c"))
    for columns in (["k", "at", "a", "b"], ["k", "at", "a", "b", "c"]):
        for order in (["at"], ["at", "a"]):
            got = keep_first(frame.select(columns), ["k"], order).collect()
            assert len(got) == 7 and all(r["at"] == 0 and r["a"] == -r["b"] and (len(r) == 4 or r["c"] == str(r["a"])) for r in got)

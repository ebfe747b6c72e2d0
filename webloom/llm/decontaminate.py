"""Benchmark decontamination over a distributed positional inverted index.

The index holds (term, document, position) for the terms that matter: the rarest few of every test
window. It is built in two scans of the documents. The first counts the test terms in the corpus, so
that each window knows its rarest terms (a window with a term that never occurs is dropped at once);
the second stores the postings of those terms only. Each posting then names where its window would
have to start (position less the term's offset); windows whose lists agree on a start are candidates,
and the words of the document decide. Postings whose implied starts lie within ``slop`` words of each
other are proximity matches.

All steps are joins and aggregates on (document, window, start), so a passage that a third of the
documents hold, or a term in each of them, is spread by document. The test side is broadcast only when
its counted rows stay under ``BROADCAST_ROWS``; beyond that the same joins run as shuffled joins.

Null and empty texts have no words, are never contaminated, and hash the empty list. A null key is a key
like others. Rows that repeat a key are matched each on its own text. An item of fewer words than a
window is one window; an item without words has none. Empty tables on either side give no hits.
Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.registry import query, table
from webloom.runtime import cut

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 500_000  # of at most a window's text each: some 100 MB
WIDTH = 13
RAREST = 3
SLOP = 8


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; ASCII-only values take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def raw_words(text: Column) -> Column:
    """Words in their own case; only the last may be empty."""
    words = F.split(F.coalesce(text, F.lit("")), SEPARATOR, -1)
    return F.when((F.size(words) > 1) & (F.element_at(words, 1) == ""), F.slice(words, 2, F.size(words))).otherwise(words)


def word_count(words: Column) -> Column:
    return (F.size(words) - F.when(F.element_at(words, -1) == "", 1).otherwise(0)).cast("long")


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, term) of every word of every text."""
    rows = docs.select(docs[key].alias("key"), F.posexplode(raw_words(docs[text])).alias("pos", "word"))
    return rows.where("word <> ''").select("key", "pos", lower_ascii(F.col("word")).alias("term"))


def sized(small: DataFrame) -> DataFrame:
    """Broadcast what is counted to be small; otherwise leave the join to Spark."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def test_windows(items: DataFrame, key: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Distinct windows: phrase, its words, and the keys (as text) of the items that hold it."""
    words = F.filter(raw_words(items[text]), lambda w: w != "")
    rows = items.select(items[key].cast("string").alias("item"), F.transform(words, lower_ascii).alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (width - 1)))
    rows = rows.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), width).alias("words"))
    return (rows.select("item", F.array_join("words", " ").alias("phrase")).groupBy("phrase")
            .agg(F.sort_array(F.collect_set("item")).alias("items"))
            .select("phrase", F.split("phrase", " ", -1).alias("words"), "items"))


def rarest_terms(windows: DataFrame, docs: DataFrame, key: str, text: str, rarest: int) -> DataFrame:
    """(term, window, offset, rank, full) for the rarest terms of each window that can occur at all."""
    places = windows.select("window", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term"))
    vocabulary = places.select("term").distinct()
    counts = tokens(docs, key, text).join(sized(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    by_window = Window.partitionBy("window")
    ranked = (places.join(counts, "term").withColumn("present", F.count(F.lit(1)).over(by_window)).where("present = size")
              .withColumn("rank", F.row_number().over(by_window.orderBy("n", "offset")) - 1).where(F.col("rank") < rarest))
    return ranked.select("term", "window", "offset", "rank", F.expr(f"shiftleft(1, least(size, {rarest})) - 1").alias("full"))


def postings(docs: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """The positional index of the given terms, stored in the shared folder."""
    return cut(tokens(docs, key, text).join(sized(terms.select("term").distinct()), "term").select("term", "key", "pos"))


def phrase_candidates(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, window, start) on which the lists of all chosen terms agree."""
    found = index.join(sized(terms), "term").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0")
    return (found.groupBy("key", "window", "start").agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("bits"), F.max("full").alias("full"))
            .where("bits = full").select("key", "window", "start"))


def proximity_matches(index: DataFrame, terms: DataFrame, slop: int = SLOP) -> DataFrame:
    """(key, window) where all chosen terms imply starts in one stretch of 2 * slop words.

    Stretches begin at every multiple of ``slop``, so terms whose starts differ by at most ``slop`` always share one.
    """
    found = index.join(sized(terms), "term").withColumn("at", F.floor((F.col("pos") - F.col("offset")) / F.lit(slop)))
    found = found.withColumn("stretch", F.explode(F.array(F.col("at"), F.col("at") - 1)))
    return (found.groupBy("key", "window", "stretch").agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("bits"), F.max("full").alias("full"))
            .where("bits = full").select("key", "window").distinct())


def covered(hits: Column) -> Column:
    """Positions inside the union of (start, size) intervals."""
    step = lambda a, h: F.struct(
        F.greatest(a["stop"], h["start"] + h["size"]).alias("stop"),
        (a["n"] + F.greatest(F.lit(0), h["start"] + h["size"] - F.greatest(h["start"], a["stop"]))).alias("n"))
    zero = F.struct(F.lit(0).alias("stop"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.sort_array(hits), zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", width: int = WIDTH, rarest: int = RAREST, slop: int = SLOP) -> DataFrame:
    """One row per document: its key, a hash of its text, words, words hit, items found, near items and the list of items."""
    windows = cut(test_windows(items, item_key, item_text, width).select(F.xxhash64("phrase").alias("window"), "phrase", "words", "items"))
    terms = cut(rarest_terms(windows, docs, key, text, rarest))
    index = postings(docs, terms, key, text)
    phrases = windows.select("window", "phrase", "items", F.size("words").alias("size"))
    found = phrase_candidates(index, terms).join(sized(phrases), "window")
    found = found.groupBy("key").agg(F.collect_list(F.struct("start", "size", "phrase", "items")).alias("found"))
    near = proximity_matches(index, terms, slop).join(sized(windows.select("window", "items")), "window")
    near = near.select("key", F.explode("items").alias("item")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_near_items"))

    # the text goes through the join, not its words: an array of words is several times larger
    rows = docs.select(docs[key].alias("doc_key"), docs[text].alias("text"))
    rows = rows.join(found, F.col("doc_key").eqNullSafe(F.col("key")), "left")
    rows = rows.select("doc_key", F.xxhash64("text").alias("twin"), raw_words(F.col("text")).alias("words"), "found")
    here = lambda h: F.array_join(F.transform(F.slice("words", h["start"] + 1, h["size"]), lower_ascii), " ")
    rows = rows.select("doc_key", "twin", word_count(F.col("words")).alias("n_words"), F.filter("found", lambda h: here(h) == h["phrase"]).alias("hits"))
    rows = rows.join(near, F.col("doc_key").eqNullSafe(F.col("key")), "left").drop("key")
    listed = F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    rows = rows.select("doc_key", "twin", "n_words", F.coalesce(covered(F.col("hits")), F.lit(0)).cast("long").alias("n_hit"),
                       F.coalesce(listed, F.array().cast("array<string>")).alias("items"), F.coalesce("n_near_items", F.lit(0)).alias("n_near_items"))
    return rows.withColumnRenamed("doc_key", key)


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def keep_uncontaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                        item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    found = contamination(docs, items, key, text, item_key, item_text, width)
    bad = cut(found.where(is_contaminated()).select(F.col(key).alias("bad_key"), F.col("twin").alias("bad_twin")).distinct())
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    same = F.col(f"c{names.index(key)}").eqNullSafe(F.col("bad_key")) & (F.xxhash64(f"c{names.index(text)}") == F.col("bad_twin"))
    return rows.join(bad, same, "left_anti").toDF(*names)


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"


@query("op8_positional_index", f"""
with d as (select doc_id, {_WORDS} as ws from documents),
b as (select item_id, {_WORDS} as ws from benchmark),
bw as (
  select item_id, array_to_string(ws[s : s + 12], ' ') as phrase, least(len(ws), 13) as size
  from (select item_id, ws, unnest(range(1, greatest(2, len(ws) - 11))) as s from b where len(ws) > 0)
),
sizes as (select distinct size from bw),
dw as (
  select doc_id, s, size, array_to_string(ws[s : s + size - 1], ' ') as phrase
  from (select doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) as s from d, sizes where len(ws) >= size)
),
hit as (select distinct doc_id, s, dw.size, item_id from dw join bw on dw.phrase = bw.phrase and dw.size = bw.size),
places as (select phrase, size, unnest(string_split(phrase, ' ')) as term, unnest(range(0, size)) as "offset" from (select distinct phrase, size from bw)),
dt as (select doc_id, unnest(ws) as term, unnest(range(0, len(ws))) as p from d),
counts as (select term, count(*) as n from dt where term in (select term from places) group by term),
ranked as (
  select *, row_number() over (partition by phrase order by n, "offset") as r from (
    select places.*, n, count(n) over (partition by phrase) as present from places left join counts using (term)) where present = size
),
chosen as (select * from ranked where r <= {RAREST}),
near as (
  select doc_id, phrase from (
    select doc_id, phrase, size, r, unnest([cell, cell - 1]) as stretch from (
      select doc_id, phrase, size, r, cast(floor((p - "offset") / {SLOP}.0) as bigint) as cell from dt join chosen using (term)))
  group by doc_id, phrase, stretch having count(distinct r) = least(any_value(size), {RAREST})
),
nears as (select doc_id, count(distinct item_id) as n_near from near join bw using (phrase) group by doc_id),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + size)) as p from hit) group by doc_id),
its as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id
)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated,
  coalesce(n_near, 0) as n_near_items
from d left join pos using (doc_id) left join its using (doc_id) left join nears using (doc_id)
""")
def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"), "n_near_items")

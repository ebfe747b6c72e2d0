"""Ranked search against the scores of all documents."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402
from webloom.llm import ranked  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def corpus(rng, n):
    words = [f"{a}{b}" for a in ("", "Ä", "x9") for b in "abcdefghij"] + ["the"] * 20 + ["日本"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40, 300]))) for _ in range(n)]
    return texts + texts[:5] * 6 + [None, "", " ?! ", "\x00\x01", "THE-the_The", "é" * 3000, " ".join(texts[:40])]


def expected(docs, items):
    return Counter((item, i + 1, key, score) for (item, _), best in brute.ranking(docs, items).items() for i, (key, score) in enumerate(best))


def got(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("terms", [7, 500_000])
def test_ranking(spark, monkeypatch, terms):
    monkeypatch.setattr(ranked, "TERMS_AT_ONCE", terms)
    rng = random.Random(3)
    docs = list(enumerate(corpus(rng, 120)))
    items = [(i, " ".join(t.split()[:30]) if t else t) for i, t in enumerate(rng.sample([t for _, t in docs], 25))]
    items += [(0, "a b c"), (0, "a b c"), (None, "the the j"), (98, None), (99, "nowhere")]
    clash = {c: F.lit("mine") for c in ("key", "name", "item", "term", "rank", "score", "bits")}
    result = ranked.best_documents(spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash),
                                   spark.createDataFrame(items, "item_id long, text string").withColumns(clash))
    assert got(result) == expected(docs, items)


def test_table(spark):
    docs, items = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [[(r[0], r[1]) for r in t.select(k, "text").collect()] for t, k in ((docs, "doc_id"), (items, "item_id"))]
    assert got(ranked.best_documents(docs, items)) == expected(*rows)


def test_text_keys_nulls_and_ties(spark):
    docs = [("b", "x y"), ("a", "x y"), (None, "x y"), ("ä", "x y"), ("a", "x y z z"), ("a", "x y")] + [(f"k{i:03d}", "x") for i in range(40)]
    items = [("q", "X"), ("r", "y z")]
    result = ranked.best_documents(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert got(result) == expected(docs, items)


def test_empty_tables(spark):
    none, some = (spark.createDataFrame(r, "doc_id long, item_id long, text string") for r in ([], [(1, 1, "a b")]))
    assert ranked.best_documents(none, some).collect() == ranked.best_documents(some, none).collect() == []
    assert ranked.best_documents(some.withColumn("text", F.lit(None).cast("string")), some).collect() == []


def test_bounds_are_above_scores_and_exclude_most():
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(60_000)]
    texts = [" ".join(rng.choices(words, k=rng.choice([20, 80, 700]))) for _ in range(600)]
    asked = [" ".join(t.split()[:25]) for t in texts[::60]]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    names = np.arange(len(texts))
    found = list(ranked.signatures(np.frombuffer(b"".join(raw), np.uint8), offsets, names, None))
    counted = [Counter(t.split()) for t in texts]
    df = Counter(t for c in counted for t in c)
    assert df == {t: n for f in found if "term" in f for t, n in zip(f["term"].to_pylist(), f["df"].to_pylist())}
    rows = [(i, t, r, df[t]) for i, a in enumerate(asked) for t, r in Counter(a.split()).items()]
    total = sum(sum(c.values()) for c in counted)
    items = ranked.Items.of(pa.table(dict(zip(("item", "term", "repeats", "df"), map(list, zip(*rows))))), len(texts), total)
    best = brute.ranking(list(enumerate(texts)), list(enumerate(asked)), top=len(texts))
    left = 0
    for f in found:
        if "bits" not in f:
            continue
        here, size = np.array(f["names"][0].as_py()), np.array(f["sizes"][0].as_py())
        for numbers, bounds in ranked.upper_bounds(items, list(items.chunks()), size, f["width"][0].as_py(), f["bits"][0].as_py()):
            for i, row in zip(numbers.tolist(), bounds):
                scores = dict(best[i, asked[i]])
                assert all(b >= scores.get(d, 0) for d, b in zip(here.tolist(), row.tolist()))
                left += int((row >= best[i, asked[i]][9][1]).sum())
    assert left < 30 * len(asked)

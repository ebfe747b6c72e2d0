"""Substring removal by recompression against counting all windows."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402
from webloom.llm import recompression  # noqa: E402
from webloom.llm.arrays import by_text  # noqa: E402
from webloom.llm.queries import QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def corpus(rng, letters, n):
    """Texts that share passages of many lengths, inside, at the edges and within one text."""
    fresh = lambda m: [rng.choice(letters) for _ in range(m)]
    shared = [fresh(rng.choice([20, 34, 35, 36, 50, 90, 400])) for _ in range(12)]
    texts = [None, "", " \n ", "one", " ".join(shared[0])]
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += rng.choice(shared) if rng.random() < 0.5 else fresh(rng.choice([3, 30, 120]))
            if rng.random() < 0.1:
                words += [rng.choice(letters)] * rng.choice([10, 40, 80])
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    return texts + texts[5:8]


@pytest.mark.parametrize("letters", ["ab", [f"w{i}" for i in range(3000)]])
def test_removal_equals_counting_windows(spark, monkeypatch, letters):
    monkeypatch.setattr(recompression, "BLOCK", 1 << 14)
    texts = corpus(random.Random(len(letters)), letters, 60)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[9]), (3, texts[10]), (5, texts[5]), (None, None)]
    clash = {c: F.lit("mine") for c in ("key", "block", "twin", "shard", "kind", "kept", "n_words")}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)
    expected = brute.unrepeated(rows)
    assert sorted_rows(recompression.without_repeats(df).collect()) == sorted_rows(expected)
    assert 0 < sum(e[2] for e in expected) < sum(e[1] for e in expected)


@pytest.mark.parametrize("width,small", [(2, 2), (7, 3), (35, 9)])
def test_other_widths(spark, width, small):
    texts = corpus(random.Random(width), [f"w{i}" for i in range(40)], 25)
    rows = [(f"k{i}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, body string")
    assert sorted_rows(recompression.without_repeats(df, "id", "body", width, small).collect()) == sorted_rows(brute.unrepeated(rows, width))


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    expected = [(k, n, m, hashlib.sha256(t.encode()).hexdigest()) for k, n, m, t in brute.unrepeated(rows)]
    assert sorted_rows(QUERIES["op12_recompression"](spark, SF_DIR).collect()) == sorted_rows(expected)
    assert sum(e[2] > 0 for e in expected) > 5


def test_empty_table(spark):
    assert recompression.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_words_share_symbols_where_their_support_stands():
    """Around each copy of a passage, every symbol whose support lies in the passage is there at the same place."""
    rng = random.Random(5)
    passage = [rng.choice("abcd") for _ in range(150)]
    texts = [[rng.choice("abcd") for _ in range(rng.randrange(60))] + passage + [rng.choice("abcd") for _ in range(rng.randrange(60))] for _ in range(20)]
    raw = [" ".join(t).encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    starts, _, names = recompression.word_names(np.frombuffer(b"".join(raw), np.uint8), offsets)
    first = by_text(starts, offsets)
    (name, low, high), (large, begin, end) = recompression.recompress(names, first, 4, 35)
    found = []
    for t, at in zip(texts, first.tolist()):
        p = at + next(i for i in range(len(t)) if t[i:i + 150] == passage)
        found.append({(int(x), a - p, b - p) for x, a, b in zip(name[0], low.tolist(), high.tolist()) if p <= a and b <= p + 150})
    assert len(found[0]) > 10 and all(f == found[0] for f in found)
    words = [w for t in texts for w in t]
    spelled = {}
    for i in range(len(begin)):  # equal names, equal words
        assert spelled.setdefault(tuple(large[:, i].tolist()), words[begin[i]:end[i]]) == words[begin[i]:end[i]]
    assert len(spelled) > 20


def test_structured_words_have_different_names():
    """Words on which polynomial hashes modulo 2^64 agree."""
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    raw = f"{thue} {thue.translate(str.maketrans('ab', 'ba'))}".encode()
    _, _, names = recompression.word_names(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert (names[:, 0] != names[:, 1]).all()


def test_very_long_text():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 50_000, 400_000).astype(str).tolist()
    words[300_000:300_100] = words[1000:1100]
    raw = " ".join(words).encode()
    starts, _, names = recompression.word_names(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    (_, low, high), (_, begin, end) = recompression.recompress(names, np.array([0, len(words)]), 4, 35)
    assert (high - low <= 35).all() and (end - begin).max() >= len(words) // 2

"""Periodic runs against a scan of every lag."""

import hashlib
import random
import sys
import time
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402
from webloom.llm import periodic  # noqa: E402
from webloom.llm.queries import QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def repetitive(rng, letters):
    """Words with planted repetitions of many periods, some inside others."""
    words = []
    while len(words) < 300:
        unit = [rng.choice(letters) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 9, 16, 17, 30]))]
        words += unit * rng.choice([1, 2, 3, 4, 9, 30])
        words = words[:rng.randrange(len(words) // 2, len(words)) + 1] if rng.random() < 0.3 else words
    return words


def edge_texts():
    rng = random.Random(11)
    texts = [None, "", " \n\t ", "one", "a " * 23, "a " * 24, "a " * 25 + "b", "x\u00a0y " * 30, "\tab\x0bcd\r\n" * 12, "ab cd " * 12, ("p q r s t u v w " * 3).strip(),
             " ".join(f"w{i % 100}" for i in range(299)), " ".join(f"w{i % 100}" for i in range(300)), "é ü " * 40 + "é é " * 40]
    texts += [" ".join(repetitive(rng, letters)) for letters in ("ab", "abc", "abcdefgh", [f"w{i}" for i in range(60)]) for _ in range(12)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    return [*texts, " ".join(fib[-1]), texts[20], texts[20]]


def test_runs_equal_a_scan_of_every_lag(spark):
    rows = list(enumerate(edge_texts())) + [(3, "a " * 30), (None, "a " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "runs", "collapsed", "n_words")})
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["strongest"] and tuple(r["strongest"]), r["collapsed"])
           for r in periodic.run_report(df).collect()]
    expected = []
    for key, text in rows:
        words = brute.SPACED.findall(text or "")
        runs, kept = brute.periodic(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        expected.append((key, len(words), runs, best, " ".join(kept)))
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert sum(len(e[2]) for e in expected) > 150


@pytest.mark.parametrize("least,times", [(1, 3), (6, 4), (10, 5)])
def test_other_limits(least, times):
    for text in edge_texts():
        raw = (text or "").encode()
        _, (_, *run), _ = periodic.periodic(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), least, times)
        assert list(zip(*(x.tolist() for x in run))) == brute.periodic(brute.SPACED.findall(text or ""), least, times)[0]


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF_DIR).collect())
    expected, sha = [], lambda s: hashlib.sha256(s.encode()).hexdigest()
    for key, text in docs:
        runs, kept = brute.periodic(brute.planted(key, text))
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        expected.append((key, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept))))
    assert got == sorted(expected)
    assert sum(e[1] > 0 for e in expected) > 10


def test_planted_texts(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(300)] + [(0, None), (None, "a b"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [brute.SPACED.findall(r[0] or "") for r in df.select(periodic.planted(F.col("doc_id"), F.col("text"))).collect()]
    assert got == [brute.planted(*r) for r in rows]


def test_empty_table(spark):
    with pytest.raises(ValueError):
        periodic.run_report(spark.createDataFrame([], "doc_id string, text string"), times=2)
    assert periodic.run_report(spark.createDataFrame([], "doc_id string, text string")).collect() == []


def test_long_texts_take_time_in_proportion():
    rng = random.Random(2)
    took = []
    for n in (100_000, 400_000):
        words = [str(rng.randrange(300)) for _ in range(n)]
        words[n // 2:n // 2 + n // 4] = [f"u{i % (n // 16)}" for i in range(n // 4)]
        raw = " ".join(words).encode()
        begin = time.perf_counter()
        _, (_, *run), _ = periodic.periodic(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 24, 3)
        took.append(time.perf_counter() - begin)
        assert [x.tolist() for x in run] == [[n // 2], [n // 4], [n // 16]]
    assert took[1] < 10 * took[0] + 1

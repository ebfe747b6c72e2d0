"""The pipeline, stage by stage, against plain Python on the rows that each stage is given."""

import hashlib
import re
import sys
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from webloom.llm import mixing  # noqa: E402
from webloom.runtime import cut  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(text, windows, width=13):
    words = WORD.findall((text or "").translate(brute.LOWER))
    hit = set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in windows:
                hit.update(range(i, i + size))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_windows(items, width=13):
    found = set()
    for text in items:
        words = WORD.findall((text or "").translate(brute.LOWER))
        found |= {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    return found


test_windows.__test__ = False


def drawn(rows):
    """Keys that the mix draws: raking of (source, lang, topic) cells in plain Python."""
    def topic(text, tokens):
        share = lambda marks: sum(text.count(c) for c in marks) * 100 > len(text) * 2
        return ("empty" if tokens == 0 else "table" if share("|") else "markup" if share("#*$%&<>") else "figures" if share("0123456789")
                else "long prose" if tokens >= 1000 else "prose")

    described = []
    for r in rows:
        text = r["text"] or ""
        tokens = len(brute.SPACED.findall(text))
        described.append((r["doc_id"], tokens, (r["source"] or "(none)", r["lang"] or "(none)", topic(text, tokens))))
    cells = defaultdict(int)
    for _, tokens, cell in described:
        cells[cell] += tokens
    cells = {c: n for c, n in cells.items() if n}
    shares = []
    for d in range(3):
        sums = defaultdict(int)
        for c, n in cells.items():
            sums[c[d]] += n
        raw = {v: n ** mixing.TEMPER for v, n in sums.items()}
        shares.append({v: x / sum(raw.values()) for v, x in raw.items()})
    weight = dict(cells)
    for _ in range(mixing.SWEEPS):
        for d in range(3):
            sums = defaultdict(float)
            for c, w in weight.items():
                sums[c[d]] += w
            weight = {c: w * shares[d][c[d]] / sums[c[d]] for c, w in weight.items()}
    factor = {c: w / cells[c] for c, w in weight.items()}
    scale = min(sum(cells.values()), 1 / max(factor.values()))
    uniform = lambda key: int(hashlib.md5(f"{mixing.SEED}:{key}".encode()).hexdigest()[:12], 16) / 2 ** 48
    return {key for key, tokens, cell in described if tokens and uniform(key) < min(1.0, factor[cell] * scale)}


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage is given, and what it returns, by key."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        found = cut(stage(spark, docs, SF_DIR))
        assert found.columns == docs.columns
        out[name] = [{r["doc_id"]: r.asDict() for r in df.collect()} for df in (docs, found)]
        docs = found
    return out


def test_quality(stages):
    given, kept = stages["quality"]
    assert kept == {k: r for k, r in given.items() if brute.sound(r["text"])} and 0 < len(kept) < len(given)


def test_near_copies(stages):
    given, kept = stages["near_copies"]
    least = {component for _, component in brute.groups([(k, r["text"]) for k, r in given.items()]).values()}
    assert kept == {k: r for k, r in given.items() if k in least} and len(kept) < len(given)


def test_decontamination(spark, stages):
    given, kept = stages["decontamination"]
    windows = test_windows([r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()])
    assert kept == {k: r for k, r in given.items() if not contaminated(r["text"], windows)}


def test_personal_data(stages):
    """All rows stay, and all but text and its length; addresses and mail are gone, texts without digits or names are as they were."""
    given, safe = stages["personal_data"]
    assert given.keys() == safe.keys()
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}")
    for k, r in given.items():
        assert {c: v for c, v in r.items() if c not in ("text", "n_chars")} == {c: v for c, v in safe[k].items() if c not in ("text", "n_chars")}
        assert safe[k]["n_chars"] == len(safe[k]["text"])
        assert not set(mail.findall(r["text"])) & set(mail.findall(safe[k]["text"]))
    assert any(r["text"] != safe[k]["text"] for k, r in given.items()) and any(r["text"] == safe[k]["text"] for k, r in given.items())


def test_mixing(stages):
    given, sample = stages["mixing"]
    assert sample == {k: r for k, r in given.items() if k in drawn(given.values())} and 0 < len(sample) < len(given)


def test_run_gives_what_the_last_stage_gives(spark, stages):
    assert {r["doc_id"]: r.asDict() for r in corpus_pipeline.run(spark, SF_DIR).collect()} == stages["mixing"][1]

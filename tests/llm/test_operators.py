"""Operators against plain versions, and the edge cases each states."""

import gzip
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402
from webloom.llm import arrays, compression, decontaminate, jaccard, language_model, lengths, mixing, parsing, secrets, surrogates, warc  # noqa: E402
from webloom.llm.components import connected  # noqa: E402
from webloom.llm.eliasfano import PROBABILITY, Sequence, Trie, quantised  # noqa: E402
from webloom.llm.queries import QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
WORDS = "the of and lorem ipsum dolor sit amet straße über naïve zebra quick brown fox 日本 слово".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "b", "c", "dd"]) for _ in range(n))


def edge_rows():
    """Null, empty, blank, tiny, repeated, long and near-copied texts."""
    rng = random.Random(7)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    long = " ".join(sentence(rng, 400) for _ in range(30))
    texts = [None, "", " \n\t ", "one", "One", "one two three", base, base, " ".join(near), base.upper(), long, long + " tail", "x" * 5000, "ab " * 700,
             "spam line\n" * 80, sentence(rng, 60), base[:200] + sentence(rng, 50) + base[100:]]
    return list(enumerate(texts))


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ("kept", "key", "spans", "block", "value", "c0", "w", "tokens", "twin", "n")
    return df.withColumns({c: F.lit("mine") for c in clash}) if extra else df


def documents(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ---- compression bands

@pytest.mark.parametrize("source", ["edge", "table"])
def test_compression(spark, source):
    df, rows = documents(spark) if source == "table" else (frame(spark, edge_rows(), True), edge_rows())
    got = {r["doc_id"]: r for r in compression.compression_report(df).collect()}
    assert len(got) == len(rows)
    for key, text in rows:
        r = got[key]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.word_rules(text)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == brute.sound(text)


def test_compression_rejects_noise_and_loops(spark):
    rng = random.Random(1)
    noise = " ".join("".join(rng.choice([chr(c) for c in range(33, 127)]) for _ in range(20)) for _ in range(200))
    loop = " ".join(f"{w}{i % 11}" for i, w in enumerate(["alpha", "beta", "gamma", "delta"] * 800))
    prose = sentence(rng, 300)
    got = dict(compression.compression_report(frame(spark, [(1, noise), (2, loop), (3, prose)])).select("doc_id", "kept").collect())
    assert got == {1: False, 2: False, 3: True}


def test_keep_sound_keeps_columns(spark):
    df = frame(spark, edge_rows(), True)
    kept = compression.keep_sound(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [k for k, t in edge_rows() if brute.sound(t)]


# ---- secret scan

def secret_rows():
    rng = random.Random(5)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    mixed = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60))
    texts = [None, "", f'é token = "{hexes[0]}" end', "password:token:abcdefgh", "API_KEY='ab.cd'", "apikey: abcdef secret=abc", "AKIA" + "Q7" * 9, "xAKIA123",
             "0" * 40 + " " + "0123456789abcdef" * 4, f"key {mixed}== and {mixed}", "a1" * 30, "under_score_name_with_2_words_and_More", "AKIA" * 10]
    return list(enumerate(texts + hexes[1:])) + [(2, f'é token = "{hexes[0]}" end')]


@pytest.mark.parametrize("source", ["edge", "table"])
def test_secrets(spark, source):
    df, rows = documents(spark) if source == "table" else (frame(spark, secret_rows(), True), secret_rows())
    got = Counter((r["doc_id"], tuple(map(tuple, r["spans"]))) for r in secrets.secret_spans(df).collect())
    assert got == Counter((k, tuple(s)) for k, s in brute.secrets(rows))
    if source == "edge":
        kinds = Counter(s[3] for _, spans in got for s in spans)
        assert kinds["random_hex"] >= 25 and kinds["random_base64"] == 2 and not any(s[3] == "random_base36" for _, spans in got for s in spans)


def test_running_sums(spark):
    values = [list(range(n)) for n in (0, 1, 2, 255, 256, 257, 1500)]
    df = spark.createDataFrame([(v,) for v in values], "v array<int>")
    for r in df.select("v", secrets.running(F.col("v")).alias("s")).collect():
        assert r["s"] == np.cumsum(r["v"]).tolist()


# ---- language model

@pytest.mark.parametrize("source", ["edge", "table"])
def test_language_scores(spark, source):
    df, rows = documents(spark) if source == "table" else (frame(spark, edge_rows() + [(3, "one"), (None, "two three")], True), edge_rows() + [(3, "one"), (None, "two three")])
    got = sorted((tuple(r) for r in language_model.language_scores(df).collect()), key=repr)
    expected = sorted(brute.language(rows, language_model.STRENGTH), key=repr)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    for g, e in zip(got, expected):
        assert abs(g[5] - e[5]) < 1e-6 * max(1, abs(e[5]))
        assert abs(g[6] - e[6]) <= 0.024 * e[2] + 1e-6  # half a quantisation step a token


def test_language_model_predicts_held_out_text(spark):
    df, _ = documents(spark)
    r = language_model.language_scores(df).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert r[0] > r[1] + 0.1 * r[2]


def test_elias_fano_and_trie():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (1, 1 << 40), (1000, 1200), (5000, 1 << 45)):
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        n_, width, low, high = Sequence.coded(values, top)
        s = Sequence(n_, width, low, high)
        assert (s.get(np.arange(n)) == values).all()
        asked = np.concatenate([values, rng.integers(0, top, 500).astype(np.uint64)])
        assert (s.successor(asked) == np.searchsorted(values, asked)).all()
    pairs = np.unique(rng.integers(0, 1 << 40, (400, 1)).repeat(2, 1) % np.array([97, 89]), axis=0).astype(np.uint64)
    p = np.maximum(rng.random(len(pairs)) ** 8, 1e-11)
    trie = Trie([pairs[:, 0], pairs[:, 1]], quantised(p))
    everything = np.array([(a, b) for a in range(100) for b in range(95)], np.uint64)
    found = trie.lookup([everything[:, 0]], np.ones(len(everything), int), everything[:, 1])
    known = {tuple(x): c for x, c in zip(pairs.tolist(), quantised(p).tolist())}
    assert found.tolist() == [known.get(tuple(x), 0) for x in everything.tolist()]
    assert np.all(np.abs(np.log10(PROBABILITY[quantised(p)]) - np.log10(p)) < 0.024)
    trie.close()


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_trie_of_any_order(order):
    """Tries of two to six words against a dictionary; the bits are read where they are."""
    rng = np.random.default_rng(order)
    grams = np.unique(rng.integers(0, 9, (3000, order + 1)).astype(np.uint64) * np.uint64(1 << 33), axis=0)
    codes = rng.integers(1, 256, len(grams)).astype(np.uint8)
    trie = Trie(list(grams.T), codes)
    asked = np.concatenate([grams, rng.integers(0, 11, (4000, order + 1)).astype(np.uint64) * np.uint64(1 << 33)])
    known = {tuple(g): c for g, c in zip(grams.tolist(), codes.tolist())}
    sizes = np.ones(len(asked), int)
    assert trie.lookup(list(asked.T[:-1]), sizes, asked[:, -1]).tolist() == [known.get(tuple(a), 0) for a in asked.tolist()]
    plain = grams.size * 8 + len(codes)
    assert trie.bytes < plain / 3 + 500 and sum(len(s.ones) * 8 for s in (trie.first, trie.words, *sum(trie.levels, ()))) < plain / 3 + 500  # and the least size of a sequence
    trie.close()


# ---- surrogates

PRIVATE = [
    "Mail anna.keller@mail.com or ANNA.KELLER@MAIL.COM. Call +1 (743) 555-3824 or 743-555-3824; card 4111 1111 1111 1111, 4111111111111111. 10.2.3.4 70.23.22.57",
    "Mr. John Smith met Mrs. Mary Smith; Smith said 078-05-1120. Господин Иванов и Госпожа Иванова. Иванов ушел. token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"",
    None, "", "clean text 12345 1.2.3 foo@bar 4111111111111112 and 2024-05-01", "again anna.keller@mail.com and 70.23.22.57", "Dr. Smith",
    "von password=c1f6c02f845bf3028d de api_key: 'Zq9-x_12' but secret: nothing"]


def test_surrogates(spark):
    df = frame(spark, list(enumerate(PRIVATE)) + [(5, PRIVATE[5])], True)
    protected = surrogates.protect(df, "k")
    assert protected.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in protected.collect()}
    assert protected.count() == len(PRIVATE) + 1 and [got[2], got[3], got[4]] == PRIVATE[2:5]
    for secret in ("anna", "mail.com", "743", "4111", "70.23", "John", "Smith", "078", "Иванов", "24be64439e3e49cf"):
        assert all(secret.lower() not in (got[i] or "").lower() for i in (0, 1, 5, 6)), secret
    words = got[0].split()
    assert words[1].lower() == words[3].rstrip(".").lower() and words[3].isupper() and words[1] == got[5].split()[1]
    assert got[0].split("555")[0].startswith("Mail") and got[0].split()[-2].startswith("10.") and got[0].split()[-1] == got[5].split()[-1]
    digits = lambda s: [c for c in s if c.isdigit()]
    card = digits(got[0][got[0].index("card"):got[0].index(",")])
    assert len(card) == 16 and card[0] == "4" and (sum(map(int, card[1::2])) + sum(int(d) * 2 - 9 * (int(d) > 4) for d in card[0::2])) % 10 == 0
    men, women = sum((surrogates.GIVEN["latin", g] for g in "m"), []), surrogates.GIVEN["latin", "f"]
    first = got[1].split()
    assert first[0] == "Mr." and first[1] in men and first[4] == "Mrs." if first[3] == "met" else True
    name = first[2]
    assert got[1].count(name) == 3 and got[6] == f"Dr. {name}" and any(w in women for w in first)
    assert got[7].startswith("von password=") and len(got[7]) == len(PRIVATE[7]) and "c1f6" not in got[7] and "Zq9" not in got[7] and got[7].endswith("but secret: nothing")
    assert "Господин" in got[1] and any(w.endswith(("ова", "ина")) for w in got[1].replace(".", "").split())


def test_surrogates_stay_distinct(spark):
    """Many entities in a small space: all surrogates differ, and none is an entity."""
    entities = spark.createDataFrame([("email", f"{a}{b}@m.com") for a in "abcdefghijklmnop" for b in range(10)]
                                     + [("person_m", f"n{i} smith") for i in range(60)], "kind string, norm string")
    again = surrogates.drawn_again(entities, "k")
    attempts = {(r["kind"], r["norm"]): r["attempt"] for r in again.collect()}
    needs = F.array(F.struct("kind", "norm", F.coalesce("attempt", F.lit(0)).alias("attempt")))
    made = entities.join(again, ["kind", "norm"], "left").select("kind", "norm", F.get(surrogates.surrogates(needs, "k"), F.lit(0))["made"].alias("made")).collect()
    assert attempts and len({(r["kind"], r["made"].lower()) for r in made}) == len(made) == 220
    assert not {r["made"].lower() for r in made} & {r["norm"] for r in made}


def made_for(spark, entities):
    """{(kind, norm): surrogate} after all draws."""
    again = surrogates.drawn_again(entities, "k")
    needs = F.array(F.struct("kind", "norm", F.coalesce("attempt", F.lit(0)).alias("attempt")))
    made = entities.join(again, ["kind", "norm"], "left").select("kind", "norm", F.get(surrogates.surrogates(needs, "k"), F.lit(0))["made"].alias("made"))
    return {(r["kind"], r["norm"]): r["made"] for r in made.collect()}


def test_surrogates_never_run_out(spark, monkeypatch):
    """More surnames than plain forms, a full private range, and credentials, numbers with hardly a free character."""
    monkeypatch.setattr(surrogates, "SYLLABLES", {k: v[:2] for k, v in surrogates.SYLLABLES.items()})
    rows = ([("surname", f"{c}{i}") for i in range(50) for c in ("x", "ж", "ω")] + [("ip", f"192.168.{i // 256}.{i % 256}") for i in range(65536)]
            + [("credential", f"-----{i}") for i in range(10)] + [("person_m", f"a{i} stone") for i in range(60)])
    entities = spark.createDataFrame(rows, "kind string, norm string")
    made = made_for(spark, entities)
    assert len(made) == len(rows) == len({(k, m.lower()) for (k, _), m in made.items()})
    assert not {(k, m.lower()) for (k, _), m in made.items()} & set(rows)
    assert all(m.startswith("10.") for (k, _), m in made.items() if k == "ip")
    numbers = spark.createDataFrame([("1-2 3", "45678"), ("12", "34"), ("+1 23", "45")], "raw string, number string")
    assert [r[0] for r in numbers.select(surrogates.filled(F.col("raw"), F.col("number"))).collect()] == ["456-7 8", "34", "+1 45"]


def test_surrogates_of_persons_with_any_title(spark, monkeypatch):
    """A person is one entity with every title, of the gender that any mention tells; all persons differ."""
    monkeypatch.setattr(surrogates, "GIVEN", {k: v[:3] for k, v in surrogates.GIVEN.items()})
    letters = "abcdefgh"
    texts = ["met Mr Xaver Klein.", "met Dr Xaver Klein.", "met Dr Xaver Klein and Mr Xaver Klein.", "met Dr Quirin Klein."]
    texts += [f"met {t} {t.lower().title()}o{c} Klein." for t in ("Mr", "Dr", "Mrs") for c in letters]
    got = [r["text"] for r in surrogates.protect(frame(spark, list(enumerate(texts))), "k").orderBy("doc_id").collect()]
    name = got[0].removeprefix("met Mr ").rstrip(".")
    assert got[1] == f"met Dr {name}." and got[2] == f"met Dr {name} and Mr {name}."
    whole = [g.rstrip(".").split(" ", 2)[2] for g in got[:1] + got[3:]]
    assert len(set(whole)) == len(whole) == 2 + 3 * len(letters)
    women, men = surrogates.GIVEN["latin", "f"], surrogates.GIVEN["latin", "m"]
    assert name.split()[0] not in women and not any(g.split()[2] in women for g in got if g.startswith("met Mr "))
    assert not any(g.split()[2] in men for g in got if g.startswith("met Mrs "))


def test_surrogates_drawn_again_reach_the_texts(spark, monkeypatch):
    rows = [(i, f"see Mr. N{chr(97 + i % 26)}{chr(97 + i // 26)} Smith and {chr(97 + i % 26)}{i // 26}@mail.com") for i in range(120)]
    monkeypatch.setattr(surrogates, "GIVEN", {k: v[:2] for k, v in surrogates.GIVEN.items()})
    got = [r["text"] for r in surrogates.protect(frame(spark, rows), "k").collect()]
    assert len(set(g.split(" and ")[0] for g in got)) == 120 and len({g.split()[-1] for g in got}) == 120


# ---- WARC

def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def page_rows():
    big = "<p>" + "lorem ipsum " * 40
    return [(1, "http://a/1", big), (2, "http://a/2", big), (0, None, big + "x"), (3, "http://a b/ü\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""),
            (None, "u", big), (9, "u", "é" * 60_000), (8, "u", "é" * 60_000), (2, "http://a/2", big)]


@pytest.mark.parametrize("range_bytes", [37, 1000, 1 << 20])
def test_warc_round_trip(spark, tmp_path, range_bytes):
    rows = page_rows() + [(100 + i, f"u{i}", random.Random(i).randbytes(400).hex()) for i in range(40)]
    planned = warc.plan_records(pages(spark, rows)).repartition(3)
    manifest = warc.write_archives(planned, str(tmp_path / "w"), file_bytes=5000)
    read = warc.read_archives(manifest, range_bytes)
    got = Counter((r["warc_type"], r["page_id"], r["refers_to"], r["payload_length"], bytes(r["payload"]) if r["payload"] is not None else None) for r in read.collect())
    first = {}
    for k, _, h in rows:
        if h and len(h.encode()) >= 100 and k is not None:
            first[h] = min(k, first.get(h, k))
    expected = Counter()
    for k, _, h in rows:
        raw = (h or "").encode()
        again = first.get(h) if h in first and first[h] != k else None
        expected["response" if again is None else "revisit", k, again, len(raw), raw if again is None else None] += 1
    assert got == expected
    for r in manifest.collect():
        data = gzip.open(r["path"].removeprefix("file:")).read()
        assert data.startswith(b"WARC/1.1") and data.endswith(b"\r\n\r\n")


def test_warc_ignores_false_magic(tmp_path):
    record = warc.member(1, "u", "d", 3, None, b"abc", 6)
    junk = warc.MAGIC + b"junk" + gzip.compress(b"no record") + warc.MAGIC
    path = tmp_path / "x.warc.gz"
    path.write_bytes(junk + record + junk + record[:-9])
    from pyarrow import fs
    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        found = list(warc.records_in(warc.Source(f), 0, path.stat().st_size))
    assert [r[6] for r in found] == [b"abc"]


# ---- prefix-free parsing

@pytest.mark.parametrize("source", ["edge", "table"])
def test_repeats(spark, source):
    df, rows = documents(spark) if source == "table" else (frame(spark, edge_rows(), True), edge_rows())
    got = {r["doc_id"]: tuple(r)[1:] for r in parsing.remove_repeats(df).collect()}
    assert got == brute.repeats(rows)


def test_repeats_random(spark):
    """Small alphabets, periodic runs and shared pieces at every offset; short strings make many borders."""
    rng = random.Random(11)
    pool = ["".join(rng.choice("ab") for _ in range(60)) for _ in range(4)] + ["a" * 90, "xy" * 40, "é" * 30]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            p = rng.choice(pool)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            parts += [p[a:b], "".join(rng.choice("abcdef") for _ in range(rng.randrange(4)))]
        rows.append((k, "".join(parts)))
    got = {r["doc_id"]: tuple(r)[1:] for r in parsing.remove_repeats(frame(spark, rows), length=12, gram=6, trigger=8).collect()}
    assert got == brute.repeats(rows, 12)


def test_repeats_around_a_common_line(spark):
    """A line in all texts, with other bytes around it each time: its k-grams are split by string, and no task reads them all."""
    rng = random.Random(4)
    line = "all rights reserved, see the license for details of use. "
    rows = [(k, "".join(rng.choice("abcd") for _ in range(rng.randrange(3, 60))) + line + "".join(rng.choice("abcd") for _ in range(rng.randrange(3, 60)))) for k in range(300)]
    expected = brute.repeats(rows, 24)
    rows += [(None, rows[0][1]), (7, rows[7][1])]
    twice = Counter({(k, *v): 1 for k, v in expected.items()}) + Counter([(7, *expected[7])])
    most = []
    for hot in (4, 10 ** 9):
        got = Counter(tuple(r) for r in parsing.remove_repeats(frame(spark, rows), length=24, gram=10, trigger=16, hot=hot).where("doc_id is not null").collect())
        assert got == twice
    # most contexts of one k-gram that go to one task
    block = parsing.pa.table({"block": parsing.pa.array([0] * 300, parsing.pa.int32()), "key": [k for k, _ in rows[:300]], "twin": [0] * 300, "text": [t for _, t in rows[:300]]})
    settled = parsing._empty("block int, key long, twin long, begin long, end long, shard int, bits binary, split binary")
    for hot in (4, 10 ** 9):
        answer = parsing.meet(parsing.send(block, settled, 24, 10, 0), hot)
        told = parsing.pa.concat_tables([settled, parsing.pa.table({c: answer.column(c) if c in answer.column_names else parsing.pa.nulls(1, settled.schema.field(c).type) for c in settled.column_names})])
        values = parsing.contexts(block, told, 24, 10, 0).column("value").to_pylist()
        most.append(max(Counter(values).values()))
    assert most[0] <= 4 < 100 < most[1]


@pytest.mark.parametrize("collide", [False, True])
def test_repeats_take_no_loop_over_contexts(monkeypatch, collide):
    """Contexts are compared, and settled strings become byte ranges, column by column: a few calls for each, not a dozen.

    Hashes of contexts that collide change no result.
    """
    rng = random.Random(6)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(90)) for _ in range(40)]
    rows = [(k, "".join(rng.choice(pool) + "".join(rng.choice("ijkl") for _ in range(20)) for _ in range(12))) for k in range(200)]
    pa = parsing.pa
    block = pa.table({"block": pa.array([0] * 200, pa.int32()), "key": [k for k, _ in rows], "twin": list(range(200)), "text": [t for _, t in rows]})
    empty = parsing._empty("block int, key long, twin long, begin long, end long, shard int, bits binary, split binary")
    answer = parsing.meet(parsing.send(block, empty, 50, 26, 0), 10 ** 9)
    told = pa.concat_tables([empty, pa.table({c: answer.column(c) if c in answer.column_names else pa.nulls(1, empty.schema.field(c).type) for c in empty.column_names})])

    def counted(function, *args):
        calls = [0]

        def count(frame, event, arg):
            calls[0] += event in ("call", "c_call")

        sys.setprofile(count)
        try:
            return function(*args), calls[0]
        finally:
            sys.setprofile(None)

    with monkeypatch.context() as patch:
        if collide:
            patch.setattr(parsing, "strong", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
        around, calls = counted(parsing.contexts, block, told, 50, 26, 0)
    assert len(around) > 5000 and calls < len(around)
    order = around.sort_by([("value", "ascending"), ("key", "ascending")]).combine_chunks()
    strings = pa.Table.from_batches(list(parsing.settle(order.to_batches(), 50)))
    found = pa.table({c: strings.column("bits" if c == "strings" else c) if c not in ("begin", "end") else pa.nulls(len(strings), pa.int64())
                      for c in ("block", "key", "twin", "begin", "end", "begins", "strings")})
    done, calls = counted(parsing.finish, block, found, 50)
    assert len(strings) > 5000 and calls < 4 * len(strings)
    assert {r["key"]: tuple(r.values())[1:] for r in done.to_pylist()} == brute.repeats(rows)


def test_hashes_of_one_width():
    for data in (np.zeros(0, np.uint8), np.arange(60, dtype=np.uint8)):
        at = np.arange(max(len(data) - 25, 0))
        hasher = arrays.Hasher(data)
        assert (hasher.every(26) == hasher.of(at, at + 26)).all() and len(hasher.every(26)) == len(at)


def test_repeats_without_or_with_equal_keys(spark):
    text = sentence(random.Random(2), 80)
    rows = [(5, text), (5, text), (None, text), (7, text), (5, "other " + text)]
    got = Counter((r["doc_id"], r["n_removed"]) for r in parsing.remove_repeats(frame(spark, rows)).collect())
    assert got == Counter([(5, 0), (5, 0), (None, 0), (7, len(text.encode())), (5, 0)])


def test_parse_covers_every_string_once():
    rng = np.random.default_rng(1)
    data, offsets = rng.integers(97, 100, 5000).astype(np.uint8), np.array([0, 10, 10, 2500, 5000])
    text, begins, ends, names = parsing.parse(data, offsets, 50, 16)
    starts = np.zeros(len(data), int)
    for t, b, e in zip(text, begins, ends):
        assert offsets[t] <= b and e <= offsets[t + 1]
        starts[b:e - 50 + 1] += 1
    triggers = begins[1:][text[1:] == text[:-1]]
    expected = parsing.starts_of(offsets, 50).astype(int)
    expected[triggers] += 1  # the closing trigger of one phrase opens the next
    assert (starts == expected).all() and len(np.unique(names, axis=0)) == len({bytes(data[b:e]) for b, e in zip(begins, ends)})


# ---- lengths

@pytest.mark.parametrize("source", ["edge", "table"])
def test_lengths(spark, source, monkeypatch):
    monkeypatch.setattr(lengths, "BLOCK", 100)
    df, rows = documents(spark) if source == "table" else (frame(spark, edge_rows(), True), edge_rows())
    with open(lengths.VOCABULARY, "rb") as f:
        encode = lengths.encoder(f.read(), lengths.PATTERN).encode_ordinary
    sizes = [len(encode(t or "")) for _, t in rows]
    sums = lengths.with_suffix_sums(lengths.length_histogram(df)).cache()
    expected = sorted((n, c, sum(s >= n for s in sizes), sum(s for s in sizes if s >= n), sum(min(s, n) for s in sizes)) for n, c in Counter(sizes).items())
    assert sorted(map(tuple, sums.collect())) == expected
    limits = [0, 1, 7, 128, 10_000_000]
    assert sorted(map(tuple, lengths.at_limits(sums, limits).collect())) == [(n, sum(s > n for s in sizes), sum(min(s, n) for s in sizes)) for n in limits]
    ordered = sorted(sizes)
    got = dict(lengths.quantiles(sums, [0.01, 0.5, 0.9, 1.0]).collect())
    assert got == {q: ordered[max(0, -(-int(q * 1000) * len(ordered) // 1000) - 1)] for q in (0.01, 0.5, 0.9, 1.0)}


# ---- decontamination

def test_contamination(spark):
    rng = random.Random(3)
    passage = [sentence(rng, 30) for _ in range(4)]
    items = [(1, passage[0]), (2, passage[1].translate({v: k for k, v in brute.LOWER.items()})), (3, "tiny item"), (4, None), (5, ""), (10, passage[0])]
    filler = sentence(rng, 100)
    texts = [filler + " " + passage[0] + " " + filler, passage[1].replace(" ", ", "), "a tiny, Item b", None, "", filler, " ".join(passage[2].split()[:12]),
             " ".join(passage[0].split()[:13]) + " " + " ".join([filler] * 40), " ".join(w + (" extra" if i == 15 else "") for i, w in enumerate(passage[0].split()))]
    df = frame(spark, list(enumerate(texts)), True)
    got = {r["doc_id"]: r for r in decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [got[i]["n_hit"] for i in range(9)] == [30, 30, 2, 0, 0, 0, 0, 13, 30]
    assert got[0]["items"] == ["1", "10"] and got[1]["items"] == ["2"] and got[2]["items"] == ["3"] and got[5]["items"] == []
    assert got[8]["n_near_items"] == 2 and got[3]["n_words"] == 0
    kept = decontaminate.keep_uncontaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 7]
    none = decontaminate.contamination(df, spark.createDataFrame([], "item_id long, text string")).agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(none) == (0, 9)


def test_contamination_same_without_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    one = sorted(map(repr, decontaminate.contamination(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert one == sorted(map(repr, decontaminate.contamination(docs, items).collect()))


# ---- mixing

def test_mixing_meets_the_margins(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    targets = {"lang": {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}}
    rows = mixing.probabilities(mixing.described(df, "doc_id", "text", "source", "lang", F.lit("all")), targets, sweeps=60).cache()
    total = rows.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0]
    got = {r["lang"]: r["t"] / total for r in rows.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("probability")).alias("t")).collect()}
    assert all(abs(got[k] - v) < 1e-6 for k, v in targets["lang"].items())
    shares = {r["source"]: r["t"] ** mixing.TEMPER for r in rows.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    got = {r["source"]: r["t"] / total for r in rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("probability")).alias("t")).collect()}
    assert all(abs(got[k] - v / sum(shares.values())) < 1e-6 for k, v in shares.items())
    assert rows.agg(F.max("probability")).first()[0] == pytest.approx(1.0)


def test_mixing_edges(spark):
    rows = [(None, "a b", None, "x"), (1, None, "s", "x"), (2, "", "s", None), (3, "c d e", "s", "x"), (3, "c d e", "s", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({c: F.lit(1) for c in ("w", "c0", "tokens", "factor", "topic", "id")})
    got = mixing.sample(df)
    assert got.columns == df.columns and all(r["text"] for r in got.collect())
    assert mixing.sample(df.limit(0)).count() == 0
    spread = sorted(r["u"] for r in spark.range(2000).select(mixing.uniform(F.col("id"), "s").alias("u")).collect())
    assert max(abs(u - (i + 0.5) / 2000) for i, u in enumerate(spread)) < 0.04


# ---- near copies

@pytest.mark.parametrize("source", ["edge", "table"])
def test_near_copies(spark, source):
    df, rows = documents(spark) if source == "table" else (frame(spark, edge_rows(), True), edge_rows())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(df).collect()}
    assert got == brute.groups(rows)
    if source == "edge":
        kept = jaccard.one_of_each(df)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, (n, c) in got.items() if k == c)


def test_near_copies_chains_and_hot_shingles(spark):
    """Drifting chains (linked only step by step), a star of near copies, and a line that most texts share."""
    rng = random.Random(4)
    line = sentence(rng, 12)
    texts, words = [], [f"w{i}" for i in range(80)]
    for step in range(25):
        words[(step * 7) % 80] = f"new{step}"
        texts.append(" ".join(words))
    star = [f"s{i}" for i in range(100)]
    texts += [" ".join(w if i != k else f"edit{k}" for i, w in enumerate(star)) for k in range(0, 100, 3)]
    texts += [line + " " + sentence(rng, rng.randrange(0, 6)) for _ in range(40)] + [line + " " + " ".join(f"u{k}x{i}" for i in range(60)) for k in range(30)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(frame(spark, rows)).collect()}
    assert got == brute.groups(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_of_edited_families(spark, seed):
    """Independent and inherited edits at rates around the threshold, so that many sets just miss their pivot."""
    rng = random.Random(seed)
    texts = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(rng.choice([30, 80, 150]))]
        versions = [base]
        for k in range(28):
            words = list(rng.choice(versions) if rng.random() < 0.5 else base)
            for _ in range(max(1, int(len(words) * rng.choice([0.005, 0.01, 0.02, 0.03, 0.05])))):
                at = rng.randrange(len(words))
                words[at:at + rng.choice([0, 1, 1])] = [rng.choice([f"e{family}x{k}", f"common{rng.randrange(9)}"])]
            versions.append(words)
        texts += [" ".join(v) for v in versions]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(frame(spark, rows)).collect()}
    expected = brute.groups(rows)
    assert got == expected and 6 < len({c for _, c in expected.values()}) < len(rows)


def test_near_copies_repeated_and_missing_keys(spark):
    text = sentence(random.Random(9), 40)
    rows = [(4, text), (4, text), (None, text), (None, "alone in the world of words"), (2, "two other words here"), (2, "  two other WORDS here")]
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard.near_copies(frame(spark, rows)).collect())
    assert got == Counter([(4, 4), (4, 4), (None, 4), (None, None), (2, 2), (2, 2)])
    assert Counter(r["doc_id"] for r in jaccard.one_of_each(frame(spark, rows)).collect()) == Counter([4, None, None, 2, 2])


def test_near_copies_without_a_key_link_others(spark):
    """An original without a key leads the lists of two edits and is the one link between them."""
    words = [f"w{i}" for i in range(100)]
    edit = lambda *places: " ".join("x" if i in places else w for i, w in enumerate(words))
    for apart in ((30, 31), (30, 70)):  # edits close to each other, and edits that only the original links
        rows = [(None, " ".join(words)), (7, edit(apart[0])), (5, edit(apart[1])), (9, "some words of another kind"), (None, "words that nobody else has")]
        got = Counter((r["doc_id"], r["component_id"]) for r in jaccard.near_copies(frame(spark, rows)).collect())
        assert got == Counter([(None, 5), (7, 5), (5, 5), (9, 9), (None, None)])
    chain = [(1, edit(10, 12)), (None, edit(10, 12, 50)), (2, edit(10, 12, 50, 80)), (None, edit(10, 12, 50, 80, 30))]
    assert {r["component_id"] for r in jaccard.near_copies(frame(spark, chain)).collect()} == {1}


def test_near_copies_of_a_key_with_two_texts(spark):
    """Each text of a key counts for itself, also where rows repeat it."""
    a, b = ([f"{c}{i}" for i in range(100)] for c in "ab")
    edit = lambda words, at: " ".join("x" if i == at else w for i, w in enumerate(words))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (3, edit(a, 50)), (8, edit(b, 50)), (8, edit(b, 20)), (8, edit(b, 20))]
    df = frame(spark, rows)
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard.near_copies(df).collect())
    assert got == Counter([(5, 3), (5, 5), (3, 3), (8, 5), (8, 5), (8, 5)])
    assert {(r["doc_id"], r["text"][0]) for r in jaccard.one_of_each(df).collect()} == {(3, "a"), (5, "b")}


def test_connected(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 90)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(120)]
    name = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(name[a], name[b])
            changed |= name[a] != low or name[b] != low
            name[a] = name[b] = low
    got = dict(connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: v for k, v in name.items() if k in {x for a, b in edges if a != b for x in (a, b)}}


# ---- empty tables and registration

def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    for found in (compression.compression_report(df), compression.keep_sound(df), secrets.secret_spans(df), lengths.with_suffix_sums(lengths.length_histogram(df)), language_model.language_scores(df), surrogates.protect(df, "k"),
                  parsing.remove_repeats(df), decontaminate.contamination(df, items), decontaminate.keep_uncontaminated(df, items), mixing.sample(df),
                  jaccard.near_copies(df), jaccard.one_of_each(df)):
        assert found.count() == 0
    planned = warc.plan_records(pages(spark, []))
    from webloom.runtime import working_path
    assert warc.read_archives(warc.write_archives(planned, working_path(spark, "none"))).count() == 0


def test_every_operator_is_registered():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))

"""Secret scan: fixed patterns, and a battery of randomness tests with control of false discoveries.

Fixed patterns give the base spans (assignments, access keys, long hexadecimal runs). The battery looks at
every run of 20 or more token characters. Its encoding is inferred from the characters it uses; under the
hypothesis that its symbols are drawn uniformly from that alphabet, three tests are made:

* chi-squared uniformity over the alphabet, with the exact mean and variance for the run's length;
* runs above and below the middle of the alphabet;
* serial correlation of neighbouring symbols.

Their p-values are combined (Cauchy combination, which stands dependence). Whether randomness is rejected is decided
within bands of length by Benjamini-Hochberg over all runs of the corpus, on a fixed grid of p-values, so
that short runs, of which there are many and which carry little evidence, do not set the bar for long
ones. A run is reported if randomness is not rejected and its length makes a secret of 80 bits possible. The null
hypothesis is randomness: what is controlled is the share of real secrets among the runs that are let go, not the
share of false alarms. ``tests/llm`` holds what is reported against planted secrets, identifiers and image data.

The corpus-wide step handles a table of at most 6 bands x 301 grid points. All else happens within a row.
Positions are code points, ends exclusive.

Null and empty texts have no spans. Rows are judged one by one, repeated rows alike (each counts in the
control of false discoveries); a null key is kept. Spans that start alike are in order of kind. Very long texts and runs are handled
whole; the work grows in proportion to the text. An empty table gives an empty result. Only key and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.registry import query, table
from webloom.llm.surrogates import let
from webloom.runtime import cut

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex")
BITS = 80
RATE = 0.05
GRID = 20
BANDS = (24, 32, 48, 64, 128)  # upper ends of the bands of length; the last band is open
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: name, pattern of the whole run, alphabet; the first that fits is taken. A run must mix letters and digits, where
#: its alphabet has both cases also both cases: names, words and numbers are no candidates.
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    ("hexupper", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", DIGITS + LOWER),
    ("base36upper", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", DIGITS + UPPER),
    ("base62", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
STEP = 256


def running(values: Column) -> Column:
    """Sums up to and including each element, in blocks, each list computed once, so that long lists stay cheap."""
    add = lambda a, x: F.concat(a, F.array(F.coalesce(F.element_at(a, -1), F.lit(0)) + x))
    empty = F.array().cast("array<int>")
    sums = lambda xs: F.aggregate(xs, empty, lambda a, x: F.when(F.size(a) == 0, F.array(x)).otherwise(add(a, x)))
    starts = lambda n: F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int"))).otherwise(empty)
    blocks = lambda v: F.transform(starts(F.size(v)), lambda i: F.slice(v, i * STEP + 1, STEP))
    # totals of blocks of blocks bring the work down to n, not n squared over STEP
    totals = lambda bs: F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    shifted = lambda bs, before: F.transform(bs, lambda b, i: F.transform(sums(b), lambda x: x + F.when(i == 0, 0).otherwise(F.get(before, i - 1))))
    two = lambda v, then: let(blocks(v), lambda bs: let(then(totals(bs)), lambda before: F.flatten(shifted(bs, before))))
    return let(values, lambda v: two(v, lambda t: two(t, sums)))


def spans_of(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as (start, end, found)."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), F.char_length)
    sizes = F.transform(matches, F.char_length)
    ends = running(F.zip_with(gaps, sizes, lambda g, s: g + s))
    whole = F.transform(F.arrays_zip(matches.alias("found"), ends.alias("stop")),
                        lambda m: F.struct((m["stop"] - F.char_length(m["found"])).alias("start"), m["stop"].alias("end"), m["found"].alias("found")))
    return F.when(F.size(matches) > 0, whole).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution, to a relative error of 2e-7 (rational form of erfc)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    inner = F.lit(terms[-1])
    for c in terms[-2::-1]:
        inner = F.lit(c) + t * inner
    upper = 0.5 * t * F.exp(-x * x + inner)
    return F.when(z >= 0, upper).otherwise(1 - upper)


TINY = 1e-15


def bounded(p: Column) -> Column:
    return F.greatest(F.lit(TINY), F.least(F.lit(1 - TINY), p))


def chi_squared_p(squares: Column, n: Column, k: Column) -> Column:
    """Upper tail, by the Wilson-Hilferty form of a gamma variable with the exact mean and variance at length n."""
    n = n.cast("double")
    x = squares * k / n - n
    mean = (k - 1).cast("double")
    variance = 2.0 * (k - 1) * (n - 1) / n
    spread = variance / (9 * mean * mean)  # 2 / (9 x degrees of freedom)
    return bounded(normal_tail((F.cbrt(F.greatest(F.lit(0.0), x) / mean) - (1 - spread)) / F.sqrt(spread)))


def runs_p(above: Column, runs: Column, n: Column) -> Column:
    """Two-sided, of the number of runs above and below the middle of the alphabet."""
    n = n.cast("double")
    product = 2.0 * above * (n - above)
    variance = product * (product - n) / (n * n * (n - 1.0))
    z = (runs - (product / n + 1)) / F.sqrt(variance)
    return F.when(variance > 0, bounded(2 * normal_tail(F.abs(z)))).otherwise(F.lit(TINY))


def serial_p(total: Column, squares: Column, products: Column, n: Column) -> Column:
    """Two-sided, of the circular correlation of neighbours."""
    n, total = n.cast("double"), total.cast("double")
    spread = n * squares - total * total
    r = (n * products - total * total) / spread
    z = (r + 1 / (n - 1)) / F.sqrt(n * n / ((n - 1) * (n - 1) * (n - 2.0)))
    return F.when(spread > 0, bounded(2 * normal_tail(F.abs(z)))).otherwise(F.lit(TINY))


def combined_p(ps: list[Column]) -> Column:
    return bounded(0.5 - F.atan(sum((F.tan((0.5 - p) * math.pi) for p in ps), F.lit(0.0)) / len(ps)) / math.pi)


def first_fit(text: Column, choose) -> Column:
    rule = F
    for name, pattern, alphabet in ENCODINGS:
        rule = rule.when(text.rlike(pattern), choose(name, alphabet))
    return rule


def battery(runs: Column) -> Column:
    """Runs with encoding, bits, band of length and grid point of the combined p-value (log10 p in 1/GRID steps, rounded up).

    Each step is a transform of its own, so that what it computes is computed once. Runs without an encoding drop out.
    """
    named = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.rtrim(r["found"], F.lit("=")).alias("body")))
    named = F.transform(named, lambda r: F.struct(
        r["start"].alias("start"), r["end"].alias("end"), r["body"].alias("body"), F.char_length(r["body"]).alias("n"),
        first_fit(r["body"], lambda e, a: F.struct(F.lit(e).alias("encoding"), F.lit(a).alias("alphabet"), F.lit(len(a)).alias("k"))).alias("code")))
    named = F.filter(named, lambda r: r["code"].isNotNull() & (r["n"] >= 20))
    keep = ("start", "end", "n")
    valued = F.transform(named, lambda r: F.struct(
        *(r[c].alias(c) for c in keep), r["code"]["encoding"].alias("encoding"), r["code"]["k"].alias("k"),
        F.transform(F.split(r["body"], ""), lambda c: (F.instr(r["code"]["alphabet"], c) - 1).cast("long")).alias("values")))
    sided = F.transform(valued, lambda r: F.struct(
        *(r[c].alias(c) for c in (*keep, "encoding", "k", "values")), F.transform(r["values"], lambda v: (2 * v >= r["k"]).cast("int")).alias("side"),
        F.concat(F.slice(r["values"], F.lit(2), r["n"]), F.slice(r["values"], 1, 1)).alias("following")))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    counted = F.transform(sided, lambda r: F.struct(
        *(r[c].alias(c) for c in (*keep, "encoding", "k")), total(r["values"]).alias("total"),
        total(F.transform(r["values"], lambda v: v * v)).alias("squares"),
        total(F.zip_with(r["values"], r["following"], lambda a, b: a * b)).alias("products"),
        total(F.transform(F.sequence(F.lit(0).cast("long"), r["k"] - F.lit(1).cast("long")),
                          lambda v: F.pow(F.size(F.filter(r["values"], lambda x: x == v)), F.lit(2)).cast("long"))).alias("same"),
        total(r["side"].cast("array<long>")).alias("above"),
        total(F.zip_with(F.slice(r["side"], F.lit(2), r["n"] - 1), F.slice(r["side"], F.lit(1), r["n"] - 1), lambda a, b: (a != b).cast("long"))).alias("changes")))
    tested = F.transform(counted, lambda r: F.struct(*(r[c].alias(c) for c in (*keep, "encoding", "k")), F.array(
        chi_squared_p(r["same"], r["n"], r["k"]), runs_p(r["above"], r["changes"] + 1, r["n"]),
        serial_p(r["total"], r["squares"], r["products"], r["n"])).alias("p")))
    band = lambda n: sum((F.when(n >= b, 1).otherwise(0) for b in BANDS), F.lit(0))
    return F.transform(tested, lambda r: F.struct(
        r["start"].alias("start"), r["end"].alias("end"), r["encoding"].alias("encoding"), (r["n"] * F.log2(r["k"])).alias("bits"),
        band(r["n"]).alias("band"), F.ceil(F.log10(combined_p([F.get(r["p"], F.lit(i)) for i in range(3)])) * GRID).cast("int").alias("point")))


def rejections(runs: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each band the greatest grid point at which randomness is rejected: Benjamini-Hochberg over (band, point) counts."""
    counts = runs.groupBy("band", "point").agg(F.count(F.lit(1)).alias("n"))
    band = Window.partitionBy("band")
    ranked = counts.withColumns({"rank": F.sum("n").over(band.orderBy("point")), "all": F.sum("n").over(band)})
    passed = ranked.where(F.pow(F.lit(10.0), F.col("point") / GRID) * F.col("all") <= rate * F.col("rank"))
    return {r["band"]: r["point"] for r in passed.groupBy("band").agg(F.max("point").alias("point")).collect()}


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """(key, spans): all spans of a row as (start, rank of kind, end, kind), in order."""
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    value = lambda found: F.regexp_extract(found, ASSIGN, 1)
    rows = rows.select(
        "key", F.filter(spans_of(F.col("text"), ASSIGN), lambda s: F.char_length(value(s["found"])) >= 6).alias("assign"),
        spans_of(F.col("text"), ACCESS).alias("access"), spans_of(F.col("text"), HEX).alias("hex"),
        spans_of(F.col("text"), RUN).alias("runs"))
    found = cut(rows.withColumn("runs", battery(F.col("runs"))))
    rejected = rejections(found.select(F.explode("runs").alias("r")).select("r.band", "r.point"), rate)
    bar = F.array(*[F.lit(rejected.get(b)).cast("int") for b in range(len(BANDS) + 1)])
    random = F.filter("runs", lambda r: (r["bits"] >= BITS) & F.coalesce(r["point"] > F.get(bar, r["band"]), F.lit(True)))
    one = lambda s, rank, kind: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), kind.alias("kind"))
    base = lambda rank, kind: F.transform(kind, lambda s: one(s, rank, F.lit(kind)))
    listed = [base(rank, kind) for rank, kind in enumerate(KINDS)]
    listed.append(F.transform(random, lambda r: one(r, len(KINDS), F.concat(F.lit("random_"), r["encoding"]))))
    return found.select(F.col("key").alias(key), F.sort_array(F.concat(*listed)).alias("spans"))


def digest_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op1_randomness_battery")
def op1_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    return rows.select("doc_id", *(count(k) for k in KINDS), F.sha2(digest_text(base), 256).alias("base_sha256"),
                       digest_text(F.col("spans")).alias("spans"))

"""Mixing to target weights by iterative proportional fitting.

The corpus is summed once into cells (source x language x topic) with their tokens. The cells' weights are
raked: scaled in turn so that the sums over each dimension meet that dimension's target shares. A
document is then kept with a probability in proportion to the factor by which its cell was scaled, so the
expected tokens of the sample meet all margins; no probability exceeds 1, and none is clipped. The draw is a
hash of the key and a seed: the same in every run, on every engine.

Targets are given per dimension, or else are the observed shares raised to ``temper`` and renormalised, which
takes from the common values and gives to the rare. Given values that do not occur are left out; values
without a target get weight 0. Raking handles cells, not documents: up to ``ONE_TASK`` cells it is done in
one task without a shuffle, beyond that by shuffles on the dimension. A hot source costs nothing more,
since it is summed before the shuffle and the cells are broadcast (or, above the same bound, joined).

Null source, language or topic is the value ``(none)``. Texts without tokens have weight 0 and are not
sampled. Rows that repeat a key are drawn together. A null key is drawn like the key ``(none)``. An empty table
gives an empty result. A very long text is counted whole, in its row. ``sample`` returns the columns of the input unchanged, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.registry import query, table
from webloom.runtime import cut

DIMENSIONS = ("source", "lang", "topic")
TEMPER = 0.85
SWEEPS = 20
AT_ONCE = 4
ONE_TASK = 100_000
SEED = "mix"
NONE = "(none)"


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shape_topic(text: Column, tokens: Column) -> Column:
    """A topic from the form of the text: tables, markup, figures, long and short prose."""
    size = F.char_length(text)
    share = lambda marks: (size - F.char_length(F.translate(text, marks, ""))) * 100 > size * 2
    return (F.when(tokens == 0, "empty").when(share("|"), "table").when(share("#*$%&<>"), "markup").when(share("0123456789"), "figures")
            .when(tokens >= 1000, "long prose").otherwise("prose"))


def cells_of(rows: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens) of rows with those columns."""
    return rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")


def with_targets(cells: DataFrame, targets: dict[str, dict[str, float]] | None, temper: float) -> DataFrame:
    """Adds the target share of each cell's value in each dimension; values are summed once, however many cells they have."""
    for d in DIMENSIONS:
        raw = F.pow(F.sum("tokens").cast("double"), F.lit(float(temper)))
        if targets and d in targets:
            given = F.create_map(*[F.lit(x) for v, s in targets[d].items() for x in (v, float(s))]) if targets[d] else F.create_map()
            raw = F.coalesce(F.element_at(given, F.col(d)), F.lit(0.0))
        values = cut(cells.groupBy(d).agg(raw.alias("raw")))
        total = values.agg(F.sum("raw")).first()[0] or 1.0
        cells = cells.join(values.select(d, (F.col("raw") / F.lit(total)).alias(f"share_{d}")), d)
    return cells


def raked(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, sweeps: int = SWEEPS) -> DataFrame:
    """Cells with ``factor``, the raked weight over the tokens; the weights sum to 1."""
    cells = cut(cells)
    one = (lambda df: df.coalesce(1)) if cells.limit(ONE_TASK + 1).count() <= ONE_TASK else (lambda df: df)
    state = cut(with_targets(cells, targets, temper).withColumn("w", F.col("tokens").cast("double")))
    for done in range(0, sweeps, AT_ONCE):
        state = one(state)
        for _ in range(min(AT_ONCE, sweeps - done)):
            for d in DIMENSIONS:
                total = F.sum("w").over(Window.partitionBy(d))
                state = state.withColumn("w", F.when(total > 0, F.col("w") * F.col(f"share_{d}") / total).otherwise(F.lit(0.0)))
        state = cut(state)
    return state.select(*DIMENSIONS, "tokens", (F.col("w") / F.col("tokens")).alias("factor"))


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 48 bits of a hash."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(NONE)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / math.pow(2, 48)


def described(docs: DataFrame, key: str, text: str, source: str, lang: str, topic: Column | None) -> DataFrame:
    """The input under neutral names, with its dimensions and tokens."""
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = lambda name: F.col(f"c{names.index(name)}")
    rows = rows.withColumns({"id": at(key), "tokens": tokens_of(at(text))})
    topic = shape_topic(F.coalesce(at(text), F.lit("")), F.col("tokens")) if topic is None else topic
    filled = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    return rows.withColumns({"source": filled(at(source)), "lang": filled(at(lang)), "topic": filled(topic)})


def probabilities(rows: DataFrame, targets=None, temper: float = TEMPER, sweeps: int = SWEEPS, keep: float = 1.0) -> DataFrame:
    """Described rows with ``probability``; ``keep`` bounds the expected share of all tokens.

    The rows are written once with their tokens and topics, as both the cells and the draw need them.
    """
    rows = cut(rows)
    weighted = raked(cells_of(rows.select(*DIMENSIONS, "tokens")), targets, temper, sweeps)
    bound = weighted.agg(F.max("factor").alias("most"), F.sum("tokens").alias("all")).first()  # one row
    scale = min(float(keep) * bound["all"], 1.0 / bound["most"]) if bound["most"] else 0.0
    cells = weighted.select(*DIMENSIONS, "factor")
    cells = F.broadcast(cells) if cells.limit(ONE_TASK + 1).count() <= ONE_TASK else cells
    joined = rows.join(cells, list(DIMENSIONS), "left")
    factor = F.when(F.col("tokens") > 0, F.coalesce("factor", F.lit(0.0))).otherwise(0.0)
    return joined.withColumn("probability", F.least(F.lit(1.0), factor * F.lit(scale)))


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None,
           targets=None, temper: float = TEMPER, sweeps: int = SWEEPS, keep: float = 1.0, seed: str = SEED) -> DataFrame:
    """The rows drawn, with the columns of the input."""
    rows = probabilities(described(docs, key, text, source, lang, topic), targets, temper, sweeps, keep)
    drawn = rows.where(uniform(F.col("id"), seed) < F.col("probability"))
    return drawn.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def _sweeps_sql() -> str:
    steps, last = [], "s0"
    for i in range(SWEEPS * len(DIMENSIONS)):
        d = DIMENSIONS[i % len(DIMENSIONS)]
        steps.append(f"s{i + 1} as (select * replace (w * share_{d} / sum(w) over (partition by {d}) as w) from {last})")
        last = f"s{i + 1}"
    return ",\n".join(steps) + f",\nfitted as (select source, lang, topic, w / tokens as factor from {last})"


@query("op9_proportional_fitting", f"""
with t as (
  select doc_id, coalesce(source, '{NONE}') as source, coalesce(lang, '{NONE}') as lang, coalesce(text, '') as text,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as tokens from documents
),
d as (
  select doc_id, source, lang, tokens, case when tokens = 0 then 'empty'
    when (length(text) - length(replace(text, '|', ''))) * 100 > length(text) * 2 then 'table'
    when (length(text) - length(regexp_replace(text, '[#*$%&<>]', '', 'g'))) * 100 > length(text) * 2 then 'markup'
    when (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) * 100 > length(text) * 2 then 'figures'
    when tokens >= 1000 then 'long prose' else 'prose' end as topic from t
),
cells as (select source, lang, topic, cast(sum(tokens) as double) as tokens from d group by all having sum(tokens) > 0),
margins as (
  select 'source' as dim, source as v, pow(sum(tokens), {TEMPER}) as raw from cells group by source
  union all select 'lang', lang, pow(sum(tokens), {TEMPER}) from cells group by lang
  union all select 'topic', topic, pow(sum(tokens), {TEMPER}) from cells group by topic
),
shares as (select dim, v, raw / sum(raw) over (partition by dim) as share from margins),
s0 as (
  select c.*, c.tokens as w, a.share as share_source, b.share as share_lang, e.share as share_topic from cells c
  join shares a on a.dim = 'source' and a.v = c.source join shares b on b.dim = 'lang' and b.v = c.lang join shares e on e.dim = 'topic' and e.v = c.topic
),
{_sweeps_sql()}
select doc_id, d.source, d.lang, d.topic, d.tokens, round(coalesce(p, 0.0), 6) as probability,
  ('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), '{NONE}')), 1, 12))::bigint / pow(2, 48) < coalesce(p, 0.0) as sampled
from d left join (select *, factor / max(factor) over () as p from fitted) f
  on d.source = f.source and d.lang = f.lang and d.topic = f.topic and d.tokens > 0
""")
def op9_proportional_fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    rows = probabilities(described(docs, "doc_id", "text", "source", "lang", None).select("id", *DIMENSIONS, "tokens"))
    return rows.select(F.col("id").alias("doc_id"), "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"),
                       (uniform(F.col("id"), SEED) < F.col("probability")).alias("sampled"))

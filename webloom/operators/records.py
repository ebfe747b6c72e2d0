"""Record plumbing: defaults, mapping, headers, wrapping, unions, flattening, validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from webloom.functions.binding import let


def repair_pages(pages: Column) -> Column:
    """PRJ-9: a missing or non-positive page count means one page."""
    return F.when(pages.isNull() | (pages <= 0), F.lit(1)).otherwise(pages)


def map_fields(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PRJ-10: source to target names, in the order given."""
    return df.select(*[F.col(source).alias(target) for source, target in mapping.items()])


def header(df: DataFrame, record: str) -> list[str]:
    """PRJ-11: every key that occurs in a map column, sorted.

    Spark merges the keys into one schema, task by task; that schema is all that comes to the driver.
    """
    keyed = F.transform_values(record, lambda k, v: F.lit(True))
    merged = df.filter(F.col(record).isNotNull()).agg(F.schema_of_variant_agg(F.to_variant_object(keyed)).alias("s")).first().s
    kind = T._parse_datatype_string(merged.replace("OBJECT<", "struct<", 1)) if merged and merged.startswith("OBJECT<") else T.StructType()
    return sorted(kind.names)


def long_layout(df: DataFrame, record: str, row: str) -> DataFrame:
    """PRJ-11 for very many keys: ``(row, key, value)``, one row per entry, instead of a column per key."""
    return df.select(F.col(row), F.explode(record).alias("key", "value"))


def widen(df: DataFrame, record: str, fields: Sequence[str] | None = None) -> DataFrame:
    """PRJ-11: a map column to one column per key; absent keys are null."""
    fields = header(df, record) if fields is None else fields
    rest = [c for c in df.columns if c != record]
    return df.select(*rest, *[F.try_element_at(F.col(record), F.lit(f)).alias(f) for f in fields])


def wrap_transformed(raw: Column) -> Column:
    """PRJ-12: ``{"transformed": <raw>}``."""
    return F.to_json(F.struct(raw.alias("transformed")))


def append_batches(batches: Mapping[str, DataFrame], label: str = "batch") -> DataFrame:
    """SET-1: bag union of record batches, the batch name as a column, missing fields null."""
    result = None
    for name, batch in batches.items():
        part = batch.select(F.lit(name).alias(label), "*")
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    if result is None:
        raise ValueError("no batches given")
    return result


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def flatten_struct(df: DataFrame) -> DataFrame:
    """SCL-7 for a known schema: nested structs to dotted columns; other values stay as they are.

    Names that collide raise.
    """
    columns: list[Column] = []
    names: list[str] = []

    def walk(schema: T.StructType, path: str, prefix: str) -> None:
        for field in schema:
            at = f"{path}.{quoted_name(field.name)}" if path else quoted_name(field.name)
            name = f"{prefix}.{field.name}" if prefix else field.name
            if isinstance(field.dataType, T.StructType):
                walk(field.dataType, at, name)
            else:
                names.append(name)
                columns.append(F.col(at).alias(name))

    walk(df.schema, "", "")
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"flattened names collide: {repeated}")
    return df.select(*columns)


MEMBERS = "try_variant_get(e.value, '$', 'map<string,variant>')"     # null for all but objects
OPEN_LEVEL = f"""flatten(transform({{entries}}, e -> get(transform(array({MEMBERS}), m -> if(m is null,
    array(struct(e.key as key, e.value as value)),
    transform(map_entries(m), x -> struct(
        concat(if(e.key = '', '', concat(e.key, '.')), x.key) as key, x.value as value)))), 0)))"""


def nesting(json: str) -> str:
    """SQL: how deep the objects of a JSON text nest, strings left out."""
    bare = f"regexp_replace(regexp_replace({json}, r'\\\\.', ''), r'\"[^\"]*\"', '')"
    braces = f"split(regexp_replace({bare}, '[^{{}}]+', ''), '')"
    return f"""aggregate({braces}, named_struct('now', 0, 'most', 0), (s, c) -> named_struct(
        'now', s.now + if(c = '{{', 1, if(c = '}}', -1, 0)), 'most', greatest(s.most, s.now + if(c = '{{', 1, 0))), s -> s.most)"""


def flat_entries(json: str) -> Column:
    """SCL-7 for an unknown schema: a column of JSON object text to ``(key, value)`` entries.

    Values are variants: arrays and nulls stay values, empty objects vanish.  Each step opens the objects
    of the one before, as many steps as the record itself is deep.
    """
    column = quoted_name(json)
    begin = f"array(named_struct('key', '', 'value', parse_json({column})))"
    return F.expr(f"aggregate(sequence(1, greatest(1, {nesting(column)})), {begin}, (entries, i) -> {OPEN_LEVEL.format(entries='entries')})")


def flatten_json(json: str) -> Column:
    """SCL-7: a column of JSON object text to one-level JSON text with dotted, sorted keys.

    Keys that collide raise (the duplicate-key policy of map construction); of a key that one object
    repeats the last one counts (``webloom.runtime.configure``).
    """
    def assemble(entries: Column) -> Column:
        places = F.sort_array(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"))))
        return F.to_json(F.map_from_entries(F.transform(places, lambda p: F.get(entries, p["i"]))))

    return F.when(F.col(quoted_name(json)).isNotNull(), let(flat_entries(json), assemble))


def reject_reason(rules: Sequence[tuple[Column, str]]) -> Column:
    """PRJ-8: the reason of the first rule that fails, or null.  A null test counts as failed."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for ok, reason in rules])


def workflow_rules(tasks: str = "tasks") -> list[tuple[Column, str]]:
    """PRJ-8: the checks on a submitted workflow."""
    return [
        (F.col("user_id") != "", "missing user_id"),
        (F.col("workflow_id") != "", "missing workflow_id"),
        (F.size(tasks) >= 1, "no tasks"),
    ]


def credit_rules(credits: str = "credits") -> list[tuple[Column, str]]:
    """PRJ-8: bought credits must be a positive whole number."""
    return [(F.expr(f"try_cast({quoted_name(credits)} as int) > 0"), "invalid credit amount")]

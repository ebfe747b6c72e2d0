"""Run registered queries and their SQL side by side.  ``python tests/check_oracle.py [sf] [name part ...]``"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if value is None or value != value:
        return "NULL"
    if hasattr(value, "tolist"):
        value = value.tolist()
    return repr(value)


def rows_of(arrow):
    names = sorted(arrow.column_names)
    columns = [arrow.column(n).to_pylist() for n in names]
    return names, sorted(tuple(normal(v) for v in row) for row in zip(*columns)) if columns else []


def types_of(arrow):
    return {f.name: str(f.type).replace("large_", "").replace(", tz=UTC", "") for f in arrow.schema}


def compare(spark_arrow, duck_arrow):
    a_names, a = rows_of(spark_arrow)
    b_names, b = rows_of(duck_arrow)
    if a_names != b_names:
        return f"columns {a_names} <> {b_names}"
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"rows {len(a)} vs {len(b)}; only spark {only_a}; only sql {only_b}"[:1500]
    ta, tb = types_of(spark_arrow), types_of(duck_arrow)
    return f"types {[(n, ta[n], tb[n]) for n in ta if ta[n] != tb[n]]}" if ta != tb else None


def main():
    from pyspark.sql import SparkSession
    import __spark_entry__ as entry
    from webloom.runtime import configure

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    configure(spark)
    con = connection(sf_dir)
    oracle, bad = entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        begin = time.time()
        try:
            got = run(spark, sf_dir).toArrow()
            took = time.time() - begin
            if name not in oracle:
                problem = None if got.num_rows else "no rows"
                mark = "rows-only"
            else:
                begin = time.time()
                problem = compare(got, con.sql(oracle[name]).to_arrow_table())
                mark = f"sql {time.time() - begin:.2f}s"
            rows = got.num_rows
        except Exception as error:  # report and go on
            problem, rows, mark, took = f"{type(error).__name__}: {str(error)[:900]}", 0, "", time.time() - begin
        print(f"{'ok ' if problem is None else 'BAD'} {name:40s} rows={rows:<7d} {took:.2f}s {mark} {problem or ''}",
              flush=True)
        if problem:
            bad.append(name)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

"""Run a check query on Spark and its SQL on DuckDB and compare the rows.

`python -m tests.compare [sf_dir] [key ...]` compares the named keys, or all.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

TESTDATA = "/root/testdata"


def local_session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("exprlake")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(value)
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _bag(rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


# The type each DuckDB type has in Spark.
SAME_TYPE = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
}


def duck_bag(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[dict[str, str], Counter]:
    cur = con.execute(sql)
    types = {d[0]: SAME_TYPE.get(str(d[1]), str(d[1])) for d in cur.description}
    return types, _bag(cur.fetchall(), list(types))


def mismatch(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None."""
    got = _bag([tuple(r) for r in df.collect()], df.columns)
    types, want = duck_bag(con, sql)
    if sorted(df.columns) != sorted(types):
        return f"columns {sorted(df.columns)[:8]} != {sorted(types)[:8]}"
    if got != want:
        return (
            f"rows {sum(got.values())} / {sum(want.values())}; only Spark {list((got - want).items())[:2]}; "
            f"only DuckDB {list((want - got).items())[:2]}"
        )
    if not got:
        return "both sides are empty"
    differ = {c: (t, types[c]) for c, t in df.dtypes if t != types[c]}
    return f"types {differ}" if differ else None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else f"{TESTDATA}/sf0.01"
    spark, con = local_session(), duck(sf_dir)
    oracles, runs = oracle_sql(), queries()
    bad = 0
    for key in sys.argv[2:] or runs:
        start = time.time()
        try:
            df = runs[key](spark, sf_dir)
            problem = mismatch(df, con, oracles[key]) if key in oracles else f"no oracle, {df.count()} rows"
        except Exception as exc:  # keep going: the list of failures is the result
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {key} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} of {len(sys.argv[2:] or runs)} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())

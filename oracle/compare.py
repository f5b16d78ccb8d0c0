"""Run queries in Spark and their SQL in DuckDB and compare names, types and values."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
# Spark type to DuckDB type of the same values.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
         "boolean": "BOOLEAN"}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan") if math.isnan(value) else (1, repr(value))
    return (1, repr(value))


def _rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in records)


def differences(df, con, sql: str) -> list[str]:
    """What differs; empty if the results agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {n: t for n, t, *_ in con.execute(f"DESCRIBE {sql}").fetchall()}
    expected = con.execute(sql).fetchall()
    actual = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} instead of {sorted(names)}"]
    problems = [f"type of {n}: {t} against {kinds[n]}" for n, t in df.dtypes if TYPES.get(t, t) != kinds[n]]
    if len(actual) != len(expected):
        problems.append(f"{len(actual)} rows instead of {len(expected)}")
    got, want = _rows(actual, df.columns), _rows(expected, names)
    if got != want:
        odd = [(g, w) for g, w in zip(got, want) if g != w]
        problems.append(f"{len(odd)} rows differ, first: {odd[:1]}")
    return problems


def run(spark, folder: str, queries: dict, oracle: dict, names=None, show=print) -> dict[str, list[str]]:
    con = connect(folder)
    failures = {}
    for name in names or queries:
        start = time.perf_counter()
        try:
            df = queries[name](spark, folder)
            problems = differences(df, con, oracle[name]) if name in oracle else (df.collect() and [])
        except Exception as error:  # noqa: BLE001 - every failure is reported
            problems = [f"{type(error).__name__}: {str(error)[:400]}"]
        if problems:
            failures[name] = problems
        show(f"{name}: {'ok' if not problems else problems} ({time.perf_counter() - start:.2f}s)")
    return failures

"""Compare every query with its SQL: ``python -m workloads.check [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from tabprep.session import build_session
from workloads.oracles import all_oracles
from workloads.queries import all_queries

DATA = Path("/root/testdata")


def connect(sf_dir: str):
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return None if value is None else f"{type(value).__name__}:{value}"


def _normal(names: list[str], rows) -> list[tuple]:
    places = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([_cell(row[i]) for i in places] for row in rows), key=repr)


def differences(found: DataFrame, connection, sql: str) -> list[str]:
    """What differs between a query result and its SQL; empty when they agree."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    if sorted(names) != sorted(found.columns):
        return [f"columns {sorted(found.columns)} against {sorted(names)}"]
    ours, theirs = _normal(found.columns, found.collect()), _normal(names, result.fetchall())
    problems = [] if len(ours) == len(theirs) else [f"{len(ours)} rows against {len(theirs)}"]
    unequal = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if unequal:
        problems.append(f"{len(unequal)} rows differ, first: {unequal[0]}")
    return problems


def check(spark: SparkSession, sf_dir: str, names: list[str]) -> int:
    queries, oracles, connection, failed = all_queries(), all_oracles(), connect(sf_dir), 0
    for name in names or queries:
        start = time.time()
        try:
            problems = differences(queries[name](spark, sf_dir), connection, oracles[name])
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok':4} {name} {time.time() - start:.2f}s", *problems, flush=True)
    return failed


if __name__ == "__main__":
    scale = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    session = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                            spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    sys.exit(1 if check(session, str(DATA / scale), sys.argv[2:]) else 0)

"""Column profiles: row, non-null and exact distinct counts, and the whole-number test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.dates import EPOCH
from tabprep.functions.numbers import FLOATING, INTEGRAL
from tabprep.operators.columns import quoted, sql_text

NUMERIC, STRING, TIME = "numeric", "string", "time"
_MERGERS = 1_024
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def family(kind: T.DataType) -> str:
    """Type family of a column; nested and binary columns have none and are rejected."""
    if isinstance(kind, (*INTEGRAL, *FLOATING, T.DecimalType, T.BooleanType)):
        return NUMERIC
    if isinstance(kind, T.StringType):
        return STRING
    if isinstance(kind, _TIMES):
        return TIME
    raise TypeError(f"columns of type {kind.simpleString()} have no role; flatten or drop them first")


def _filled(df: DataFrame, name: str) -> str:
    """SQL for a column with NaN counted as missing."""
    cell = quoted(name)
    return f"if(isnan({cell}), NULL, {cell})" if isinstance(df.schema[name].dataType, FLOATING) else cell


def _whole_test(df: DataFrame, name: str) -> str:
    """SQL aggregate: are all non-null values whole? NULL for columns that are not numeric."""
    kind = df.schema[name].dataType
    if isinstance(kind, (*INTEGRAL, T.BooleanType)):
        return f"if(count({quoted(name)}) > 0, true, NULL)"
    if family(kind) == NUMERIC:
        return f"bool_and({_filled(df, name)} % 1 = 0)"
    return "CAST(NULL AS boolean)"


def _comparable(df: DataFrame, name: str) -> tuple[str, str]:
    """SQL for a column in one of three carrier types, so that like columns can be stacked."""
    kind, value = df.schema[name].dataType, _filled(df, name)
    if isinstance(kind, FLOATING):
        return "double", f"CAST({value} AS double)"
    if isinstance(kind, (*INTEGRAL, T.BooleanType)):
        return "bigint", f"CAST({value} AS bigint)"
    if isinstance(kind, T.DateType):
        return "bigint", f"CAST(unix_date({value}) AS bigint)"
    if isinstance(kind, _TIMES):
        return "bigint", f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{EPOCH}', CAST({value} AS timestamp_ntz))"
    return "string", f"CAST({value} AS string)"


def sketch_sql(df: DataFrame, name: str, size: int) -> str:
    """SQL aggregate: a sketch of ``2**size`` buckets of the distinct values; NULL for times.

    Of floating columns only whole values are counted: with any other value a column is continuous anyway.
    """
    carrier, value = _comparable(df, name)
    if family(df.schema[name].dataType) == TIME:
        return "CAST(NULL AS binary)"
    if carrier == "double":
        value = f"if({value} % 1 = 0, xxhash64({value}), NULL)"
    return f"hll_sketch_agg({value}, {size})"


def distinct_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """Exact distinct non-null values as ``(column, n_unique)``, for all ``names`` at once.

    Columns of like type are stacked and counted together: one scan and one shuffle per type,
    instead of one copy of every row per column as ``count(distinct ...)`` of several columns takes.
    """
    groups: dict[str, list[str]] = {}
    for name in names:
        carrier, value = _comparable(df, name)
        groups.setdefault(carrier, []).append(f"{sql_text(name)}, {value}")
    counts = []
    for cells in groups.values():
        stacked = df.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) AS (column, value)").where("value IS NOT NULL")
        counts.append(stacked.distinct().groupBy("column").agg(F.count("value").alias("n_unique")))
    return reduce(DataFrame.unionAll, counts)


def summarise(df: DataFrame, sketch_size: int | None = None) -> DataFrame:
    """One row per column from one scan: ``position, column, family, n_rows, n_filled, all_whole``.

    ``sketch_size`` adds ``estimate``, the distinct values from sketches of that size. Tasks' results
    are merged in up to ``_MERGERS`` groups before the last merge, which keeps that one small.
    """
    partial, merged, cells = ["count(*) AS n"], ["sum(n) AS n"], []
    for i, name in enumerate(df.columns):
        partial += [f"count({_filled(df, name)}) AS f{i}", f"{_whole_test(df, name)} AS w{i}"]
        merged += [f"sum(f{i}) AS f{i}", f"bool_and(w{i}) AS w{i}"]
        cell = [str(i), sql_text(name), sql_text(family(df.schema[name].dataType)), "n", f"f{i}", f"w{i}"]
        if sketch_size:
            sketch = sketch_sql(df, name, sketch_size)
            partial.append(f"{sketch} AS e{i}")
            union = "NULL" if sketch.startswith("CAST(NULL") else f"hll_sketch_estimate(hll_union_agg(e{i}))"
            merged.append(f"CAST({union} AS bigint) AS e{i}")
            cell.append(f"e{i}")
        cells.append(", ".join(cell))
    fields = "position, column, family, n_rows, n_filled, all_whole" + (", estimate" if sketch_size else "")
    groups = df.groupBy((F.spark_partition_id() % _MERGERS).alias("_merger")).agg(*[F.expr(sql) for sql in partial])
    row = groups.agg(*[F.expr(sql) for sql in merged]).na.fill(0)
    return row.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) AS ({fields})")


def profile(df: DataFrame) -> DataFrame:
    """``position, column, family, n_rows, n_filled, all_whole, n_unique`` with exact counts."""
    joined = summarise(df).join(distinct_counts(df, df.columns), "column", "left")
    return joined.selectExpr("position", "column", "family", "n_rows", "n_filled", "all_whole",
                             "coalesce(n_unique, 0) AS n_unique")

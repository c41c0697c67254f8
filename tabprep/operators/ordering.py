"""Total orders and dense row numbers.

An order is a list of column names, ascending with nulls last, that together are unique.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.draws import SHUFFLE_END, shuffle_number
from tabprep.functions.numbers import FLOATING, missing_if_nan
from tabprep.operators.columns import col, require_columns
from tabprep.workspace import pin

#: Metadata key of a column of whole numbers that are uniform from 0 up to the given end.
UNIFORM = "uniform_below"
_OFFSET_BITS = 33  # monotonically_increasing_id keeps the in-partition offset in its low 33 bits


def filled(df: DataFrame, name: str) -> Column:
    """A column in which NaN counts as missing."""
    return missing_if_nan(col(name)) if isinstance(df.schema[name].dataType, FLOATING) else col(name)


def sort_keys(df: DataFrame, order: list[str]) -> list[Column]:
    return [filled(df, name).asc_nulls_last() for name in order]


def chronological(df: DataFrame, order: list[str]) -> DataFrame:
    """Globally sorted rows."""
    require_columns(df, order)
    return df.orderBy(*sort_keys(df, order))


def with_shuffle_key(df: DataFrame, key: str, seed: int = 42, name: str = "_shuffle") -> DataFrame:
    """Add the number that puts rows in a seeded random order; order by ``[name, key]``. Its metadata tell that it is uniform."""
    return df.withColumn(name, shuffle_number(seed, col(key)).alias(name, metadata={UNIFORM: SHUFFLE_END}))


def with_source_order(df: DataFrame, stage: bool = True) -> tuple[DataFrame, list[str]]:
    """A file-based table with columns that record the order of its rows in the files.

    The table is pinned, since the columns are numbers of one reading. Without ``stage`` that is left to
    the caller, who must not read the result twice before.
    """
    tagged = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return pin(tagged, "source") if stage else tagged, ["_file", "_block", "_line"]


def with_row_number(df: DataFrame, order: list[str], name: str = "_row") -> DataFrame:
    """Add the dense 0-based position of every row in ``order``.

    Rows are range-partitioned and sorted, then written once together with their partition and
    offset. Positions are offset plus the rows of the partitions before; no task ever holds more
    than one partition, and a hot leading key is split by the columns after it. Pass only the
    columns that are needed: everything in ``df`` is shuffled and written.
    """
    require_columns(df, order)
    ranged = df.repartitionByRange(*sort_keys(df, order)).sortWithinPartitions(*sort_keys(df, order))
    offset = F.monotonically_increasing_id().bitwiseAND((1 << _OFFSET_BITS) - 1)
    stored = pin(ranged.select("*", F.spark_partition_id().alias("_part"), offset.alias("_offset")), "ordered")
    # One row per partition: bounded by the number of shuffle partitions, not by the data.
    counts = sorted((r["_part"], r["count"]) for r in stored.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, rows in counts:
        starts.append((part, total))
        total += rows
    starts = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    numbered = stored.join(F.broadcast(starts), "_part")
    return numbered.select(*[col(c) for c in df.columns], (F.col("_offset") + F.col("_start")).alias(name))


def precedes(df: DataFrame, order: list[str], key: dict, equal: bool = False) -> Column:
    """True for rows that come before ``key`` in ``order``, or ``equal`` it; NULL or false for the others.

    Written with plain comparisons, so that as a filter it reaches the scan.
    """

    def step(later: Column, name: str) -> Column:
        column, wanted = _compared(df, name, key[name])
        # A NULL column comes last: neither comparison is true for it.
        if wanted is None:
            return column.isNotNull() | later
        return (column < wanted) | ((column == wanted) & later)

    return reduce(step, reversed(order), F.lit(equal))


def reaches(df: DataFrame, order: list[str], key: dict, equal: bool = True) -> Column:
    """True for ``key`` itself, if ``equal``, and the rows after it: the complement of ``precedes``."""

    def step(later: Column, name: str) -> Column:
        column, wanted = _compared(df, name, key[name])
        if wanted is None:
            return column.isNull() & later
        return (column > wanted) | column.isNull() | ((column == wanted) & later)

    return reduce(step, reversed(order), F.lit(equal))


def comparable(value: Column, kind: T.DataType) -> Column:
    """A column as the kind of value that keys hold: timestamps with a zone as microseconds, so that no session zone matters."""
    return F.unix_micros(value) if isinstance(kind, T.TimestampType) else value


def _compared(df: DataFrame, name: str, value) -> tuple[Column, Column | None]:
    return filled(df, name), None if value is None else typed_literal(value, df.schema[name].dataType)


def typed_literal(value, kind: T.DataType) -> Column:
    """A literal that keeps zone-less timestamps zone-less, so that it can reach the scan."""
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(str(value)).cast(kind)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(value)) if isinstance(value, int) else F.lit(value)
    return F.lit(value).cast(kind)

"""Dropping rows: nulls and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.numbers import FLOATING, missing_if_nan
from tabprep.operators.columns import col, require_columns


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN in floating columns becomes NULL."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, FLOATING)}
    return df.select(*[missing_if_nan(col(c)).alias(c) if c in floats else col(c) for c in df.columns])


def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL or NaN in ``subset`` (default: in any column)."""
    names = df.columns if subset is None else subset
    require_columns(df, names)
    return df.na.drop("any", subset=names)


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row per ``key`` in ``order``, missing order values last; all missing keys count as one key.

    An aggregation rather than a window: each task reduces its rows to one per key before
    anything is shuffled, so a key that fills a third of the table costs one row per task.
    """
    require_columns(df, [key, *order])
    df = df.withColumn(key, missing_if_nan(col(key))) if isinstance(df.schema[key].dataType, FLOATING) else df
    kinds = {c: df.schema[c].dataType for c in order}
    values = {c: missing_if_nan(col(c)) if isinstance(kind, FLOATING) else col(c) for c, kind in kinds.items()}
    places = [part for value in values.values() for part in (value.isNull(), value)]
    kept = F.min_by(F.struct(*[col(c) for c in df.columns if c != key]), F.struct(*places))
    first = df.groupBy(col(key).alias(key)).agg(kept.alias("_kept"))
    return first.select(*[col(c) if c == key else F.col("_kept").getField(c).alias(c) for c in df.columns])


def keep_first_chain(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``keep_first`` on each key in turn, each over the survivors of the one before."""
    for key in keys:
        df = keep_first(df, key, order)
    return df


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]

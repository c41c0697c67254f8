"""Equi-joins that flatten a relational set, with hot keys dealt out over several groups.

Broadcasting is left to Spark, which decides by the measured size of a side; nothing here forces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.operators.columns import col, require_columns
from tabprep.operators.ordering import typed_literal

_SAMPLE = 1_000_000  # rows looked at when searching hot keys
_COPIES = 64


def hot_keys(df: DataFrame, key: str, share: float = 0.01, sample: int = _SAMPLE) -> list:
    """Keys (NULL included) that hold at least about ``share`` of the rows: at most ``1 / share``.

    Counted on a sample, because the list only steers how rows are spread over tasks. A key
    seen once is not hot.
    """
    rows = df.count()
    if not rows:
        return []
    fraction = min(1.0, sample / rows)
    keys = df.select(col(key).alias("key"))
    counts = (keys if fraction == 1.0 else keys.sample(fraction, seed=42)).groupBy("key").count()
    return [row["key"] for row in counts.where(F.col("count") >= max(2.0, share * fraction * rows)).collect()]


def _is_hot(df: DataFrame, key: str, hot: list) -> Column:
    kind = df.schema[key].dataType
    listed = col(key).isin([typed_literal(value, kind) for value in hot if value is not None])
    return F.coalesce(listed, F.lit(None in hot))


def deal_out(df: DataFrame, key: str, hot: list, copies: int = _COPIES, name: str = "_deal") -> DataFrame:
    """Number the rows of hot keys 0 to ``copies - 1``; all others get 0.

    The number follows from the content of a row, so a retried task repeats it. Select the columns
    that are needed first: all of them, and at best one that tells rows apart, go into it.
    """
    spread = F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(copies)).cast("int")
    return df.withColumn(name, F.when(_is_hot(df, key, hot), spread).otherwise(0))


def repeat_hot(df: DataFrame, key: str, hot: list, copies: int = _COPIES, name: str = "_deal") -> DataFrame:
    """Repeat the rows of hot keys once per number that ``deal_out`` gives."""
    every = F.sequence(F.lit(0), F.lit(copies - 1))
    return df.withColumn(name, F.explode(F.when(_is_hot(df, key, hot), every).otherwise(F.array(F.lit(0)))))


def equi_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", null_safe: bool = False, hot: list | None = None,
    copies: int = _COPIES,
) -> DataFrame:
    """Join on the column ``key`` both sides have; ``how`` is ``inner`` or ``left``.

    ``null_safe`` lets NULL match NULL. Rows of ``left`` whose key is in ``hot`` (see ``hot_keys``) are
    dealt out over ``copies`` groups and the matching rows of ``right`` repeated once per group, so no
    single task gets all of a hot key. The result is the same either way. A ``left`` that was
    dealt out before (column ``_deal``) is used as it is and keeps the column: joins on the same
    key then share one shuffle of it.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    require_columns(left, [key])
    require_columns(right, [key])
    taken = set(left.columns) & set(right.columns) - {key}
    if taken:
        raise ValueError(f"both sides have columns {sorted(taken)}")
    kept = [c for c in [*left.columns, *right.columns] if c != key]
    dealt = "_deal" in left.columns
    if hot and not dealt:
        left = deal_out(left, key, hot, copies)
    if hot:
        right = repeat_hot(right, key, hot, copies, "_right_deal")
    right = right.withColumnRenamed(key, "_right_key")
    same = col(key).eqNullSafe(F.col("_right_key")) if null_safe else col(key) == F.col("_right_key")
    if hot:
        same = same & (F.col("_deal") == F.col("_right_deal"))
    return left.join(right, same, how).select(col(key), *[col(c) for c in kept])

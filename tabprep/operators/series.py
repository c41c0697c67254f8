"""Looking ahead in one long ordered series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprep.functions.numbers import relative_change
from tabprep.operators.columns import col
from tabprep.operators.ordering import with_row_number


def look_ahead(
    df: DataFrame, order: list[str], value: str, steps: int, name: str, series: str | None = None,
    block_rows: int = 500_000,
) -> DataFrame:
    """``order`` columns plus ``value`` and the ``value`` found ``steps`` rows later, as ``name``.

    The series is cut into blocks of ``block_rows`` consecutive rows; the first rows of each block
    are also handed to the block before, so that a window per block sees everything it needs and
    no block depends on how values or series are distributed. With ``series``, the later row must
    belong to the same series.
    """
    if not 0 < steps <= block_rows:
        raise ValueError("steps must be between 1 and block_rows")
    full_order = ([series] if series else []) + [c for c in order if c != series]
    needed = list(dict.fromkeys([*full_order, value]))
    numbered = with_row_number(df.select(*[col(c) for c in needed]), full_order)
    block = F.floor(F.col("_row") / block_rows)
    is_head = F.pmod("_row", F.lit(block_rows)) < steps
    copies = F.when(is_head, F.array(block, block - 1)).otherwise(F.array(block))
    placed = numbered.select("*", F.explode(copies).alias("_stretch"))
    ahead = Window.partitionBy("_stretch").orderBy("_row")
    later = F.lead(col(value), steps).over(ahead)
    if series:
        later = F.when(F.lead(col(series), steps).over(ahead).eqNullSafe(col(series)), later)
    looked = placed.select(*needed, "_row", "_stretch", later.alias(name))
    return looked.where(F.col("_stretch") == block).drop("_row", "_stretch")


def with_future_change(
    df: DataFrame, order: list[str], value: str, steps: int, name: str = "future_return", series: str | None = None,
    block_rows: int = 500_000,
) -> DataFrame:
    """Add the relative change of ``value`` over the next ``steps`` rows.

    Only the order columns and ``value`` are sorted; the other columns take part in a single
    join on the unique order.
    """
    ahead = look_ahead(df, order, value, steps, "_later", series, block_rows)
    changed = ahead.withColumn(name, relative_change(F.col("_later"), col(value))).drop("_later")
    keys = [c for c in changed.columns if c not in (value, name)]
    rest = [c for c in df.columns if c not in changed.columns]
    if not rest:
        return changed.select(*[col(c) for c in df.columns], col(name))
    right = changed.select(*[col(c).alias(f"_k{i}") for i, c in enumerate(keys)], col(name))
    matched = reduce(lambda a, b: a & b, [col(key).eqNullSafe(F.col(f"_k{i}")) for i, key in enumerate(keys)])
    return df.join(right, matched, "inner").select(*[col(c) for c in df.columns], col(name))

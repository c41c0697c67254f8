"""Choosing, dropping and renaming columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.text import NULL_TOKENS, join_lines, null_if_token


def quoted(name: str) -> str:
    """A column name safe to resolve even when it holds dots."""
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def col(name: str):
    return F.col(quoted(name))


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def keep(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly ``names`` in that order; a missing one is an error."""
    require_columns(df, names)
    return df.select(*[col(name) for name in names])


def drop_required(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop ``names``; a missing one is an error."""
    require_columns(df, names)
    return df.drop(*names)


def drop_if_present(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def suffix_names(df: DataFrame, suffix: str = "_", skip: Iterable[str] = ()) -> DataFrame:
    """Strip every column name and append ``suffix``."""
    skipped = set(skip)
    return df.toDF(*[name if name in skipped else name.strip() + suffix for name in df.columns])


def copy_columns(df: DataFrame, copies: Mapping[str, str]) -> DataFrame:
    """Add each column ``new`` as a copy of ``old`` (``{new: old}``)."""
    require_columns(df, copies.values())
    return df.withColumns({new: col(old) for new, old in copies.items()})


def depth_columns(families: list[str], depth: int) -> list[str]:
    """Names of a layered table: every family at level 0, then at level 1, and so on."""
    return [f"{family}_{level}" for level in range(depth) for family in families]


def _map_strings(df: DataFrame, change) -> DataFrame:
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.select(*[change(col(c)).alias(c) if c in strings else col(c) for c in df.columns])


def join_text_lines(df: DataFrame) -> DataFrame:
    """Replace line breaks in every text column."""
    return _map_strings(df, join_lines)


def clear_null_tokens(df: DataFrame, tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """Turn whole-cell null tokens of every text column into NULL."""
    return _map_strings(df, lambda text: null_if_token(text, tokens))

"""Turning text completions back into rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.text import strip_whitespace
from tabprep.operators.columns import col

# The shortest brace-delimited passage is taken, across line breaks.
OBJECT_PATTERN = r"(?s)\{.*?\}"

# JSON numbers that have no JSON spelling come back quoted.
_UNQUOTED = r'^"(NaN|-?Infinity)"$'


def reopened(text: Column) -> Column:
    """The completion without surrounding white space, after the brace that ended the prompt."""
    return F.concat(F.lit("{"), strip_whitespace(text))


def parse_completions(df: DataFrame, text: str, columns: list[str], carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns plus one text column per name in ``columns``.

    A completion without a readable object gives a row of NULLs; unknown keys are ignored.
    """
    wanted = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    found = F.regexp_extract(reopened(col(text)), OBJECT_PATTERN, 0)
    parsed = F.from_json(found, wanted, {"allowSingleQuotes": "false"})
    opened = df.select(*[col(c) for c in carry or []], parsed.alias("_row"))
    cells = [F.regexp_replace(F.col("_row").getField(c), _UNQUOTED, "$1").alias(c) for c in columns]
    return opened.select(*[col(c) for c in carry or []], *cells)


def complete(
    prompts: DataFrame, generate: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], key: str = "prompt_id"
) -> DataFrame:
    """Completions from a caller's batch function over ``key, prompt``: ``key, generated_text``."""
    kind = prompts.schema[key].dataType.simpleString()
    batches = prompts.select(col(key), "prompt")
    return batches.mapInPandas(generate, f"`{key}` {kind}, generated_text string")

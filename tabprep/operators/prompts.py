"""Few-shot prompt tables: draw example rows, print them as JSON lines, assemble the text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.functions.draws import uniform
from tabprep.functions.text import json_string, render
from tabprep.operators.columns import col
from tabprep.operators.ordering import with_row_number
from tabprep.workspace import pin

# The text around the examples.
PROMPT_HEADER = (
    "You are a tabular data synthesizer. Generate a single, realistic, and unique new data record "
    "that follows the exact JSON format and statistical distributions of the examples below.\n"
    "Output ONLY a single valid JSON object. Do not output any other text or formatting.\n\n"
)
PROMPT_TRAILER = "\nNow generate exactly one new record in the exact same JSON format:\n{"

# What a missing cell prints as.
MISSING_TIME, MISSING_VALUE = "NaT", "nan"


def with_json_line(df: DataFrame, columns: list[str], name: str, keep: list[str]) -> DataFrame:
    """``keep`` columns plus each row as a JSON object whose values are all strings."""
    cells = []
    for i, column in enumerate(columns):
        kind = df.schema[column].dataType
        missing = MISSING_TIME if kind.typeName().startswith(("timestamp", "date")) else MISSING_VALUE
        cells.append(F.coalesce(render(col(column), kind), F.lit(missing)).alias(f"_c{i}"))
    # Cells are rendered in a projection of their own, which keeps the generated code small.
    rendered = df.select(*[col(c) for c in keep], *cells)
    parts = [F.concat(json_string(F.lit(c)), F.lit(": "), json_string(F.col(f"_c{i}"))) for i, c in enumerate(columns)]
    line = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    return rendered.select(*[col(c) for c in keep], line.alias(name))


def draw_positions(prompts: DataFrame, rows: int, shots: int, seed: int = 42, key: str = "prompt_id") -> DataFrame:
    """``key, shot, _row``: ``shots`` different positions below ``rows`` for every prompt.

    Floyd's subset draw: the i-th draw is uniform below ``rows - shots + i``; a position that was
    drawn before is replaced by the largest allowed one.
    """
    if not 0 < shots <= rows:
        raise ValueError(f"cannot draw {shots} different rows out of {rows}")
    drawn = F.array().cast("array<bigint>")
    for i in range(1, shots + 1):
        top = rows - shots + i
        pick = F.floor(uniform(f"{seed}|{i}", col(key)) * top).cast("bigint")
        unseen = F.when(F.array_contains("_drawn", pick), F.lit(top - 1).cast("bigint")).otherwise(pick)
        prompts = prompts.withColumn("_drawn", drawn if i == 1 else F.col("_drawn"))
        prompts = prompts.withColumn("_drawn", F.array_append("_drawn", unseen))
    return prompts.select(col(key), F.posexplode("_drawn").alias("shot", "_row"))


def few_shot_prompts(
    train: DataFrame, order: list[str], columns: list[str], prompts: DataFrame, shots: int = 5, seed: int = 42,
    key: str = "prompt_id",
) -> DataFrame:
    """``key, prompt``: one prompt per row of ``prompts``, each with ``shots`` rows of ``train``.

    Only the order columns of ``train`` are numbered. The drawn positions pick order keys, and the
    picked keys are written before they meet ``train``: Spark then knows their size and broadcasts
    them while they are small. Only drawn rows are turned into text.
    """
    numbered = with_row_number(train.select(*[col(c) for c in order]), order)
    draws = draw_positions(prompts.select(col(key)), numbered.count(), shots, seed, key)
    names = [f"_k{i}" for i in range(len(order))]
    picked = draws.join(numbered, "_row").select(col(key).alias("_prompt"), F.col("shot").alias("_shot"),
                                                 *[col(c).alias(n) for c, n in zip(order, names)])
    matched = reduce(lambda a, b: a & b, [col(c).eqNullSafe(F.col(n)) for c, n in zip(order, names)])
    examples = train.join(pin(picked, "draws"), matched)
    lines = with_json_line(examples, columns, "_line", ["_prompt", "_shot"])
    # A group holds the ``shots`` lines of one prompt, never more.
    body = F.transform(F.array_sort(F.collect_list(F.struct("_shot", "_line"))), lambda x: x["_line"])
    text = F.concat(F.lit(PROMPT_HEADER), F.array_join(body, "\n"), F.lit("\n"), F.lit(PROMPT_TRAILER))
    return lines.groupBy(F.col("_prompt").alias(key)).agg(text.alias("prompt"))

"""Recipes: chains of operators that turn raw tables into one labelled table.

Each returns its output columns plus ``split``; with ``keep_order`` the columns that define the row
order stay as well. Orders must be unique within the rows that remain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.dates import format_minute, parse_timestamp, parse_timestamp_strict
from tabprep.functions.numbers import parse_number
from tabprep.functions.text import element_or
from tabprep.operators.columns import (
    clear_null_tokens,
    col,
    copy_columns,
    drop_if_present,
    drop_required,
    join_text_lines,
    keep,
    suffix_names,
)
from tabprep.operators.completions import parse_completions
from tabprep.operators.joins import deal_out, equi_join, hot_keys
from tabprep.operators.ordering import with_shuffle_key
from tabprep.operators.payloads import flatten_payload
from tabprep.operators.prompts import few_shot_prompts
from tabprep.operators.roles import leading_format
from tabprep.operators.rows import drop_missing, keep_first_chain, nan_to_null
from tabprep.operators.series import with_future_change
from tabprep.operators.splits import split_contiguous, split_purged
from tabprep.workspace import pin


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def _time(df: DataFrame, name: str, order: list[str], strict: bool, source: DataFrame | None = None) -> Column:
    """Column ``name`` as a timestamp. Texts are read by the format that the first of them in ``order`` has; ``strict`` makes
    any other text an error instead of NULL. ``source`` is a smaller table with the same texts to learn the format from."""
    if not _is_text(df, name):
        return col(name).cast("timestamp_ntz")
    found = leading_format(df if source is None else source, name, order)
    return (parse_timestamp_strict if strict else parse_timestamp)(col(name), found)


def payload_events(
    raw: DataFrame, payload: str, time: str, target: str, columns: list[str], tiebreak: list[str],
    payload_schema: T.StructType | str | None = None, elements: dict[str, tuple[str, int]] | None = None,
    drop: list[str] | None = None, filling: list[str] | None = None, keep_order: bool = False,
) -> DataFrame:
    """Events with a JSON payload, split chronologically.

    ``elements`` adds ``{name: (array column, index)}``; columns in ``drop`` go if present, before
    payload keys of the same name arrive, and columns in ``filling`` stand in for missing keys. Events
    without ``target`` are left out; events without a readable time come last. Times in text are read by the format of the
    first of them in the order of ``tiebreak``. The flat table is written
    once, so that payloads are parsed once. Order: ``_at`` and ``tiebreak``.
    """
    flat = flatten_payload(raw, payload, payload_schema, replacing=drop, filling=filling)
    flat = clear_null_tokens(flat)
    for name, (array, index) in (elements or {}).items():
        flat = flat.withColumn(name, element_or(col(array), index))
    flat = flat.withColumn("_at", _time(flat, time, tiebreak, strict=False))
    flat = drop_if_present(flat, [c for c in drop or [] if c not in [*columns, *tiebreak]])
    flat = drop_missing(flat, [target])
    helpers = [c for c in ["_at", *tiebreak] if c not in columns]
    flat = pin(keep(flat, [*columns, *helpers]), "events")
    return drop_if_present(split_contiguous(flat, ["_at", *tiebreak]), [] if keep_order else helpers)


def shuffled_table(
    raw: DataFrame, key: str, drop: list[str] | None = None, numeric: list[str] | None = None,
    required: list[str] | None = None, complete: bool = False, suffix: str = "", seed: int = 42,
    keep_order: bool = False,
) -> DataFrame:
    """A static table in a seeded random order.

    ``numeric`` texts are parsed (others become NULL), rows without the ``required`` columns, or
    with ``complete`` any incomplete row, are left out, and ``suffix`` is put on all names. ``key``
    identifies rows; list it in ``drop`` to keep it out of the result. Order: ``_shuffle`` and ``key``.
    """
    table = drop_if_present(nan_to_null(raw), [c for c in drop or [] if c != key])
    numbers = {c: parse_number(col(c)) for c in numeric or [] if _is_text(table, c)}
    table = table.withColumns(numbers) if numbers else table
    checked = [c for c in table.columns if c != key or key not in (drop or [])]
    table = drop_missing(table, checked if complete else required) if complete or required else table
    if suffix:
        table = suffix_names(table, suffix, skip=[key])
    split = split_contiguous(with_shuffle_key(table, key, seed), ["_shuffle", key])
    if keep_order:
        return split
    if key in (drop or []):
        return split.drop("_shuffle", key)
    return split.drop("_shuffle").withColumnRenamed(key, key.strip() + suffix if suffix else key)


def purged_series(
    raw: DataFrame, time: str, value: str, columns: list[str], steps: int = 5, gap: int = 120,
    tiebreak: list[str] | None = None, target: str = "future_return", keep_time: bool = False, keep_order: bool = False,
) -> DataFrame:
    """One long series with the relative change of ``value`` over the next ``steps`` rows as target.

    Split chronologically with ``gap`` rows left out between the splits (their ``split`` is NULL).
    ``time`` and ``value`` are dropped at the end; ``keep_time`` keeps the time, to the minute.
    Order: ``_at`` and ``tiebreak``.
    """
    tiebreak = tiebreak or []
    at = _time(raw, time, tiebreak or [time], strict=True)
    series = keep(raw, list(dict.fromkeys([time, value, *columns, *tiebreak]))).withColumn("_at", at)
    changed = with_future_change(series, ["_at", *tiebreak], value, steps, target)
    changed = pin(drop_missing(changed, [target]), "changes")
    split = split_purged(changed, ["_at", *tiebreak], gap)
    output = [*columns, col(target), "split"]
    if keep_time:
        output = [format_minute(F.col("_at")).alias(time), *output]
    if keep_order:
        output += [c for c in ["_at", *tiebreak] if c not in columns]
    return split.select(*output)


def distinct_texts(
    raw: DataFrame, keys: list[str], order: list[str], drop: list[str] | None = None, seed: int = 42,
    keep_order: bool = False,
) -> DataFrame:
    """A text table with first-wins duplicates removed on each of ``keys`` in turn, line breaks
    replaced, in a seeded random order. ``order`` is the source order. Order: ``_shuffle`` and ``order``."""
    survivors = keep_first_chain(raw, keys, order)
    dropped = [c for c in drop or [] if c not in order]
    table = pin(join_text_lines(drop_required(survivors, dropped)), "survivors")
    mixed = F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in order])
    table = with_shuffle_key(table.withColumn("_key", mixed), "_key", seed)
    split = split_contiguous(table, ["_shuffle", *order])
    return split.drop("_key") if keep_order else split.drop("_shuffle", "_key", *[c for c in drop or [] if c in order])


def flat_orders(
    orders: DataFrame, items: DataFrame, products: DataFrame, reviews: DataFrame, order_key: str, product_key: str,
    time: str, target: str, columns: list[str], tiebreak: list[str], copies: dict[str, str] | None = None,
    keep_order: bool = False, null_safe: bool = False,
) -> DataFrame:
    """Orders with their items, the product of each item and every review of the order, in one
    table that is split chronologically. Order: ``time`` and ``tiebreak``. ``null_safe`` lets missing keys meet.

    Products come first, so that orders and reviews, which share a key, meet items in one shuffle of
    them. The joined table is written once; cut points are then found on its order columns alone.
    """
    used = {*columns, *tiebreak, time, target, order_key, product_key, *(copies or {}).values()}
    orders, items, products, reviews = (
        table.select(*[col(c) for c in table.columns if c in used]) for table in (orders, items, products, reviews)
    )
    hot_products, hot_orders = hot_keys(items, product_key), hot_keys(items, order_key)
    described = equi_join(items, products, product_key, "left", null_safe=null_safe, hot=hot_products)
    if hot_orders:
        described = deal_out(described, order_key, hot_orders)
    sold = equi_join(described, orders, order_key, "inner", null_safe=null_safe, hot=hot_orders)
    flat = equi_join(sold, reviews, order_key, "left", null_safe=null_safe, hot=hot_orders)
    flat = copy_columns(flat, copies or {})
    flat = flat.withColumn(time, _time(flat, time, [order_key], strict=True, source=orders))
    helpers = [c for c in tiebreak if c not in columns]
    flat = pin(drop_missing(keep(flat, [*columns, *helpers]), [target]), "flat")
    return split_contiguous(flat, [time, *tiebreak]).drop(*([] if keep_order else helpers))


def synthetic_rows(
    train: DataFrame, order: list[str], columns: list[str], prompts: DataFrame,
    completions: Callable[[DataFrame], DataFrame], shots: int = 5, seed: int = 42, key: str = "prompt_id",
) -> DataFrame:
    """``key`` and one text column per name in ``columns``: a row read from each prompt's completion.

    ``completions`` turns the prompt table (``key, prompt``) into ``key, generated_text``: a join with
    stored completions, or ``operators.completions.complete`` with a batch function. Completions
    that hold no readable row stay as rows of NULLs.
    """
    asked = few_shot_prompts(train, order, columns, prompts, shots, seed, key)
    return parse_completions(completions(asked), "generated_text", columns, carry=[key])

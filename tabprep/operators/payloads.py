"""Flattening a text column of JSON objects."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.operators.columns import col


def payload_schema(df: DataFrame, column: str) -> T.StructType:
    """Keys and types found in a JSON text column, in one aggregation over all rows.

    Texts that are not JSON objects count as empty objects. Of a key that an object repeats the last value counts; keys
    that differ only in case are different keys.
    """
    wrapped = F.when(_looks_like_object(col(column)), F.try_parse_json(_wrapped(col(column))))
    alone = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    parsed = F.when(alone, F.try_variant_get(wrapped, "$[0]", "variant"))
    with _repeated_keys(df.sparkSession):
        found = df.agg(F.schema_of_variant_agg(parsed).alias("found")).first()["found"]
    # The shape comes back as text such as OBJECT<a: BIGINT, b: OBJECT<c: STRING>>; only types are renamed, not keys.
    text = _TYPE_WORD.sub(lambda m: m[1] + ("STRUCT<" if m[2] == "OBJECT<" else "STRING"), found)
    kind = T._parse_datatype_string(text) if text.startswith("STRUCT<") else T.StructType()
    return _with_doubles(kind) if isinstance(kind, T.StructType) else T.StructType()


@contextmanager
def _repeated_keys(spark: SparkSession) -> Iterator[None]:
    """Objects that repeat a key are read, not refused, by what is planned inside."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    spark.conf.set(name, True)
    try:
        yield
    finally:
        spark.conf.set(name, before)


_TYPE_WORD = re.compile(r"(^|: |\bARRAY<)(OBJECT<|VARIANT\b|VOID\b)")


def _with_doubles(kind: T.DataType) -> T.DataType:
    """Fractions are found as decimals of the seen digits; they are read as doubles."""
    if isinstance(kind, T.DecimalType):
        return T.DoubleType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_with_doubles(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _with_doubles(f.dataType)) for f in kind])
    return kind


def _wrapped(text: Column) -> Column:
    """As an array of one element, so that text behind the object makes it invalid."""
    return F.concat(F.lit("["), text, F.lit("]"))


def _looks_like_object(text: Column) -> Column:
    return F.ltrim(text).startswith("{")


def _leaves(kind: T.StructType, path: tuple[str, ...] = (), places: tuple[int, ...] = ()) -> list[tuple]:
    """``(names on the way, positions on the way)`` of every leaf."""
    found = []
    for i, field in enumerate(kind):
        if isinstance(field.dataType, T.StructType):
            found += _leaves(field.dataType, (*path, field.name), (*places, i))
        else:
            found.append(((*path, field.name), (*places, i)))
    return found


def _numbered(kind: T.DataType) -> T.DataType:
    """The same objects with their keys replaced by positions, which no two keys share."""
    if not isinstance(kind, T.StructType):
        return kind
    return T.StructType([T.StructField(f"f{i}", _numbered(field.dataType)) for i, field in enumerate(kind)])


def _told_apart(names: list[str], taken: list[str], case_sensitive: bool) -> list[str]:
    """``names`` with ``_2``, ``_3`` ... behind those that the session cannot tell from an earlier one or from ``taken``."""
    fold = str if case_sensitive else str.lower
    used, reserved, out = {fold(name) for name in taken}, {fold(name) for name in names}, []
    for name in names:
        number, given = 1, name
        while fold(given) in used or (number > 1 and fold(given) in reserved):
            number += 1
            given = f"{name}_{number}"
        used.add(fold(given))
        out.append(given)
    return out


def flatten_payload(
    df: DataFrame, column: str, schema: T.StructType | str | None = None, replacing: list[str] | None = None,
    filling: list[str] | None = None,
) -> DataFrame:
    """Add one column per leaf of the JSON objects in ``column``, named by its dotted path.

    Arrays stay one cell. Texts that are not JSON objects give empty cells. ``schema`` names the
    wanted keys; without it they are discovered with ``payload_schema``. A leaf that has the name of
    a column of ``df`` is an error unless that column is in ``replacing``, where the leaf wins, or in
    ``filling``, where the column fills in for a missing leaf. Names that the session cannot tell apart (keys that differ in
    case, a dotted key beside a nested one) get ``_2``, ``_3`` ... behind the first. The last value of a repeated key counts.
    """
    if schema is None:
        schema = payload_schema(df, column)
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    leaves = _leaves(schema)
    names = [".".join(path) for path, _ in leaves]
    case_sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    clash = set(names) & (set(df.columns) - {*(replacing or []), *(filling or [])})
    if clash:
        raise ValueError(f"payload keys {sorted(clash)} are already columns")
    if not leaves:
        return df
    listed = F.from_json(
        F.when(_looks_like_object(col(column)), _wrapped(col(column))), T.ArrayType(schema), {"allowSingleQuotes": "false"}
    )
    parsed = F.when(F.size(listed) == 1, F.get(listed, 0)).cast(_numbered(schema))
    kept = [c for c in df.columns if c not in names]
    spare = {c: f"_spare{i}" for i, c in enumerate(filling or []) if c in df.columns}
    opened = df.select(*[col(c) for c in kept], *[col(c).alias(n) for c, n in spare.items()], parsed.alias("_payload"))
    cells = []
    for (_, places), name, given in zip(leaves, names, _told_apart(names, kept, case_sensitive)):
        cell = F.col("_payload")
        for place in places:
            cell = cell.getField(f"f{place}")
        cells.append((F.coalesce(cell, F.col(spare[name])) if name in spare else cell).alias(given))
    return opened.select(*[col(c) for c in kept], *cells)

"""Reading raw tables: JSON lines, CSV with its usual null spellings, and prepared splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.numbers import is_number_text
from tabprep.functions.text import CSV_NULL_TOKENS, null_if_token
from tabprep.operators.columns import col, drop_if_present

# Fixed value: the name a nameless index column gets when a CSV file is read.
INDEX_COLUMN = "Unnamed: 0"

_TRUTH = ["True", "TRUE", "true", "False", "FALSE", "false"]


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per line."""
    return spark.read.schema(schema).json(path)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header; null spellings become NULL.

    Without ``schema`` the column types are inferred from all rows. ``multi_line`` allows line
    breaks inside cells, which makes Spark read each file in one task; without it files are split.
    """
    options = {"header": True, "multiLine": multi_line, "escape": '"'}
    raw = spark.read.options(**options, inferSchema=False).csv(path)
    named = raw.toDF(*[INDEX_COLUMN if name in ("", "_c0") and i == 0 else name for i, name in enumerate(raw.columns)])
    cleared = named.select(*[null_if_token(col(c), CSV_NULL_TOKENS).alias(c) for c in named.columns])
    if schema is None:
        return infer_types(cleared)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    return cleared.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def drop_index(df: DataFrame) -> DataFrame:
    return drop_if_present(df, [INDEX_COLUMN])


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns to bigint, double or boolean where every value allows it.

    One aggregation over all rows decides. Whole numbers with gaps become doubles and truth values
    with gaps stay text, like an all-missing column becomes a double column without values.
    """
    checks = []
    for i, name in enumerate(df.columns):
        text = col(name)
        checks += [
            F.count(text).alias(f"filled{i}"),
            F.bool_and(text.rlike(r"^\s*[+-]?\d+\s*$") & text.try_cast("bigint").isNotNull()).alias(f"whole{i}"),
            F.bool_and(is_number_text(text)).alias(f"number{i}"),
            F.bool_and(text.isin(_TRUTH)).alias(f"truth{i}"),
        ]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *checks).first()

    def typed(i: int, name: str) -> Column:
        complete = row[f"filled{i}"] == row["rows"]
        if row[f"filled{i}"] == 0 or row[f"number{i}"]:
            return col(name).cast("bigint" if row[f"whole{i}"] and complete else "double")
        if row[f"truth{i}"] and complete:
            return col(name).cast("boolean")
        return col(name)

    return df.select(*[typed(i, name).alias(name) for i, name in enumerate(df.columns)])


def read_split(spark: SparkSession, path: str, split: str = "all") -> DataFrame:
    """One split of a table written by ``write_splits``; only its files are read."""
    table = spark.read.parquet(path)
    return table if split == "all" else table.where(F.col("split") == split)

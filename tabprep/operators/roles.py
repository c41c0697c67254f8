"""Role inference and role-driven coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.dates import LONGEST_DATE, common_format
from tabprep.functions.numbers import FLOATING, missing_if_nan, parse_number
from tabprep.functions.text import MISSING, render
from tabprep.meta import (
    CATEGORICAL,
    CATEGORY_LIMIT,
    CATEGORY_SHARE,
    CONTINUOUS,
    DATETIME,
    INTEGER,
    SNIFFED_VALUES,
    TEXT,
    TableMeta,
)
from tabprep.operators.columns import col
from tabprep.operators.profiles import NUMERIC, STRING, TIME, distinct_counts, profile, summarise
from tabprep.operators.rows import text_columns

# A sketch of this size has a standard error of 1.6%; estimates within a factor of two of the limit
# are settled by an exact count, so a wrong role would take an error of thirty standard deviations.
_SKETCH_SIZE, _DOUBT = 12, 2.0
_HEAD_ROWS, _HEAD_CELLS = 1_000, 20_000  # rows and cells read to find the first values of all columns


def sniff_dates(df: DataFrame, order: list[str], values: int = SNIFFED_VALUES) -> DataFrame:
    """``(column, is_datetime, date_format)`` for every text column that has values.

    A column holds dates when one date format fits its first ``values`` non-null texts in ``order``; ``date_format`` names
    it. One scan takes the first rows for all columns together; only columns with fewer values there get a scan of their own.
    A text too long for a date is replaced by a mark as it is read, so few and short cells reach the driver.
    """
    names, spark = text_columns(df), df.sparkSession
    schema = "column string, is_datetime boolean, date_format string"
    if not names:
        return spark.createDataFrame([], schema)
    rows = min(_HEAD_ROWS, max(2 * values, _HEAD_CELLS // len(names)))
    cells = {name: F.when(F.length(col(name)) <= LONGEST_DATE, col(name)).when(col(name).isNotNull(), "-") for name in names}
    keys = [col(key).asc_nulls_last() for key in order]
    head = df.orderBy(*keys).limit(rows).select(*[cell.alias(f"c{i}") for i, cell in enumerate(cells.values())]).collect()
    first = {name: [row[i] for row in head if row[i] is not None][:values] for i, name in enumerate(names)}
    for name in [name for name in names if len(head) == rows and len(first[name]) < values]:
        found = df.where(col(name).isNotNull()).orderBy(*keys).limit(values).select(cells[name].alias("cell"))
        first[name] = [row["cell"] for row in found.collect()]
    found = [(name, common_format(texts)) for name, texts in first.items() if texts]
    return spark.createDataFrame([(name, form is not None, form) for name, form in found], schema)


def leading_format(df: DataFrame, column: str, order: list[str], values: int = SNIFFED_VALUES) -> str | None:
    """The date format of the first text in ``order`` that is a date, among the first ``values``; None if none is.

    Where a text fits several formats the month stands before the day.
    """
    cell = F.when(F.length(col(column)) <= LONGEST_DATE, col(column)).otherwise("-")
    first = df.where(col(column).isNotNull()).orderBy(*[col(key).asc_nulls_last() for key in order]).limit(values)
    return next((found for row in first.select(cell.alias("cell")).collect() if (found := common_format([row["cell"]]))), None)


def _decide(profiled: DataFrame) -> DataFrame:
    """The role decision over a profile; NULL when a column is empty."""
    return profiled.selectExpr(
        "position",
        "column",
        f"""CASE WHEN n_filled = 0 THEN NULL
                 WHEN family = '{TIME}' OR is_datetime THEN '{DATETIME}'
                 WHEN family = '{NUMERIC}' AND NOT all_whole THEN '{CONTINUOUS}'
                 WHEN n_unique <= {CATEGORY_LIMIT} OR n_unique / n_rows < {CATEGORY_SHARE}D THEN '{CATEGORICAL}'
                 WHEN family = '{NUMERIC}' THEN '{INTEGER}'
                 ELSE '{TEXT}' END AS role""",
        "n_unique",
        "n_rows",
        "date_format",
    )


def _with_dates(profiled: DataFrame, df: DataFrame, order: list[str]) -> DataFrame:
    joined = profiled.join(sniff_dates(df, order), "column", "left")
    return joined.withColumn("is_datetime", F.coalesce("is_datetime", F.lit(False)))


def infer_roles(df: DataFrame, order: list[str], ignore: list[str] | None = None) -> DataFrame:
    """``position, column, role, n_unique, n_rows, date_format`` of a (train) table with exact distinct counts.

    ``order`` gives the source order used for date sniffing; ``ignore`` lists helper columns
    that get no role.
    """
    profiled = _with_dates(profile(df.drop(*(ignore or []))), df.drop(*set(ignore or []) - set(order)), order)
    return _decide(profiled)


def learn_meta(
    train: DataFrame, order: list[str], ignore: list[str] | None = None, exact: bool = False, **meta
) -> TableMeta:
    """Roles of ``train`` as a ``TableMeta``.

    Only whole-number and text columns need a distinct count, and only against a limit. They are
    estimated in the one profiling scan; an exact count follows for those near the limit.
    ``exact`` counts all of them exactly.
    """
    table = train.drop(*(ignore or []))
    found = _with_dates(summarise(table, _SKETCH_SIZE), train.drop(*set(ignore or []) - set(order)), order)
    rows = [r.asDict() for r in found.collect()]  # one row per column

    def counted(row: dict) -> bool:
        return bool(row["n_filled"]) and not row["is_datetime"] and (
            row["family"] == STRING or (row["family"] == NUMERIC and row["all_whole"])
        )

    def doubtful(row: dict) -> bool:
        limit = max(CATEGORY_LIMIT, CATEGORY_SHARE * row["n_rows"])
        return exact or limit / _DOUBT <= row["estimate"] <= limit * _DOUBT

    recount = [r["column"] for r in rows if counted(r) and doubtful(r)]
    if recount:
        exact_counts = {r["column"]: r["n_unique"] for r in distinct_counts(table, recount).collect()}
        for row in rows:
            row["estimate"] = exact_counts.get(row["column"], row["estimate"])

    settled = [(r["position"], r["column"], r["family"], r["n_rows"], r["n_filled"], r["all_whole"], r["is_datetime"],
                r["estimate"], r["date_format"]) for r in rows]
    schema = ("position int, column string, family string, n_rows bigint, n_filled bigint, all_whole boolean, "
              "is_datetime boolean, n_unique bigint, date_format string")  # fmt: skip
    return meta_from_roles(_decide(train.sparkSession.createDataFrame(settled, schema)), **meta)


def meta_from_roles(roles: DataFrame, **meta) -> TableMeta:
    """``TableMeta`` of an ``infer_roles`` table (one row per column)."""
    rows = sorted(roles.select("position", "column", "role", "date_format").collect(), key=lambda r: r["position"])
    formats = tuple((r["column"], r["date_format"]) for r in rows if r["date_format"])
    return TableMeta.of([r["column"] for r in rows], {r["column"]: r["role"] for r in rows}, formats=formats, **meta)


def coerce(df: DataFrame, meta: TableMeta) -> DataFrame:
    """Apply roles to any split: categories and text become strings with missing spelt out,
    numbers are parsed and missing ones become 0. Other columns stay as they are."""

    def change(field: T.StructField) -> Column:
        column, role = col(field.name), meta.role(field.name)
        if isinstance(field.dataType, FLOATING):
            column = missing_if_nan(column)
        if role in (CATEGORICAL, TEXT):
            return F.coalesce(render(column, field.dataType), F.lit(MISSING))
        if role in (CONTINUOUS, INTEGER):
            number = parse_number(column) if isinstance(field.dataType, T.StringType) else column
            return F.coalesce(number, F.lit(0).cast(number_type(field.dataType)))
        return column

    return df.select(*[change(f).alias(f.name) for f in df.schema])


def number_type(kind: T.DataType) -> T.DataType:
    return T.DoubleType() if isinstance(kind, T.StringType) else kind

"""Model-ready column layouts of a coerced table, and the manifest that describes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.functions.dates import as_timestamp, epoch_seconds
from tabprep.meta import CATEGORICAL, CONTINUOUS, DATETIME, INTEGER, TEXT, TableMeta
from tabprep.operators.columns import col, keep

ROLE_SUBSET, ROLE_GROUPED, ALL_COLUMNS, EPOCH = "role_subset", "role_grouped", "all_columns", "epoch"

# Per layout: (role, group, kind). Columns are ordered by group, then by source position; roles that
# are not listed are left out. None stands for a column without a role.
LAYOUTS: dict[str, list[tuple[str | None, int, str]]] = {
    ROLE_SUBSET: [(CATEGORICAL, 0, "categorical"), (INTEGER, 0, "numeric"), (CONTINUOUS, 0, "numeric")],
    ROLE_GROUPED: [(CONTINUOUS, 0, "numeric"), (INTEGER, 1, "numeric"), (CATEGORICAL, 2, "categorical"),
                   (TEXT, 3, "text")],
    ALL_COLUMNS: [(CATEGORICAL, 0, "categorical"), (INTEGER, 0, "numeric"), (CONTINUOUS, 0, "numeric"),
                  (TEXT, 0, "other"), (DATETIME, 0, "other"), (None, 0, "other")],
    EPOCH: [(CATEGORICAL, 0, "categorical"), (CONTINUOUS, 1, "continuous"), (INTEGER, 2, "integer"),
            (DATETIME, 3, "continuous")],
}

# This layout always holds the target, whatever its role.
KEEPS_TARGET = {ROLE_SUBSET}


def layout_columns(meta: TableMeta, layout: str) -> list[str]:
    """The columns of ``layout`` in order."""
    groups = {role: group for role, group, _ in LAYOUTS[layout]}
    chosen = []
    for position, column in enumerate(meta.columns):
        role = meta.role(column)
        if role in groups:
            chosen.append((groups[role], position, column))
        elif layout in KEEPS_TARGET and column == meta.target:
            chosen.append((0, position, column))
    return [column for _, _, column in sorted(chosen)]


def apply_layout(df: DataFrame, meta: TableMeta, layout: str, also: list[str] | None = None) -> DataFrame:
    """Select the columns of ``layout``; ``also`` names columns to carry along, such as the split."""
    names = layout_columns(meta, layout)
    if layout != EPOCH:
        return keep(df, [*names, *(also or [])])

    def change(name: str) -> Column:
        if meta.role(name) == DATETIME:
            return epoch_seconds(as_timestamp(col(name), df.schema[name].dataType, meta.date_format(name))).alias(name)
        return col(name)

    return df.select(*[change(name) for name in names], *[col(name) for name in also or []])


def dropped_columns(meta: TableMeta, layout: str) -> list[str]:
    kept = set(layout_columns(meta, layout))
    return [column for column in meta.columns if column not in kept]


def manifest(roles: DataFrame, target: str | None = None) -> DataFrame:
    """``layout, column, position, kind, is_target`` for every layout, from an ``infer_roles`` table.

    ``position`` is the 0-based place of the column in the layout. The epoch layout files dates
    under continuous.
    """
    rules = [(layout, role or "", group, kind) for layout, rows in LAYOUTS.items() for role, group, kind in rows]
    spark = roles.sparkSession
    # Fixed size: one row per layout and role.
    table = F.broadcast(spark.createDataFrame(rules, "layout string, role string, group int, kind string"))
    columns = roles.select(F.col("position").alias("source"), "column", F.coalesce("role", F.lit("")).alias("role"))
    is_target = F.coalesce(F.col("column") == F.lit(target).cast("string"), F.lit(False))
    placed = columns.join(table, "role").select("layout", "column", "source", "group", "kind")
    for layout in sorted(KEEPS_TARGET):
        known = [role for role, _, _ in LAYOUTS[layout]]
        extra = columns.where(is_target & ~F.col("role").isin(known))
        placed = placed.unionByName(extra.select(F.lit(layout).alias("layout"), "column", "source",
                                                 F.lit(0).alias("group"), F.lit("other").alias("kind")))
    place = F.row_number().over(Window.partitionBy("layout").orderBy("group", "source")) - 1
    kind = F.when(is_target & (F.col("layout") != EPOCH), "target").otherwise(F.col("kind"))
    return placed.select("layout", "column", place.alias("position"), kind.alias("kind"), is_target.alias("is_target"))


def count_classes(train: DataFrame, meta: TableMeta) -> int | None:
    """How many values the target has in the train rows; None where the task is not classification."""
    if meta.target is None or meta.task == "regression":
        return None
    return train.agg(F.count_distinct(col(meta.target)).alias("n")).first()["n"]


def layout_info(meta: TableMeta, layout: str, n_classes: int | None = None) -> dict:
    """Header information of one layout: column names, 0-based positions by kind, task."""
    kinds = {role: kind for role, _, kind in LAYOUTS[layout]}
    names = layout_columns(meta, layout)

    def positions(*wanted: str) -> list[int]:
        return [i for i, c in enumerate(names) if c != meta.target and kinds.get(meta.role(c)) in wanted]

    # The key names and the two task names.
    return {
        "name": meta.name,
        "task_type": "regression" if meta.task == "regression" else "binclass",
        "n_classes": n_classes,
        "column_names": names,
        "num_col_idx": positions("numeric", "continuous", "integer"),
        "cat_col_idx": positions("categorical"),
        "target_col_idx": [i for i, c in enumerate(names) if c == meta.target],
        "dropped": dropped_columns(meta, layout),
    }

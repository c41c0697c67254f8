"""Writing prepared splits, CSV layouts and manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from tabprep.functions.text import render
from tabprep.meta import TableMeta
from tabprep.operators.columns import keep
from tabprep.operators.layouts import LAYOUTS, apply_layout, count_classes, layout_info
from tabprep.operators.ordering import chronological, filled
from tabprep.operators.splits import only


def write_splits(df: DataFrame, path: str, compact: bool = False) -> None:
    """All splits as one parquet table, one folder per split; keeps column types.

    Every task writes one file per split it meets. ``compact`` shuffles rows into evenly sized
    files instead, which pays off when a seeded order leaves all splits in every task.
    """
    rows = df.hint("rebalance", "split") if compact else df
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV with a header and cells in Python's spelling; missing cells and empty texts are empty fields.

    ``order`` sorts the rows across the part files.
    """
    rows = chronological(df, order) if order else df
    texts = rows.select(*[render(filled(rows, f.name), f.dataType).alias(f.name) for f in rows.schema])
    options = {"header": True, "emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    texts.write.mode("overwrite").options(**options).csv(path)


def write_layout(df: DataFrame, meta: TableMeta, layout: str, path: str, splits: list[str] | None = None) -> list[str]:
    """Each split of a coerced table in ``layout`` as ``<path>/<split>.csv``; returns the paths."""
    written = []
    for split in splits or ["train", "val", "test", "all"]:
        target = f"{path}/{split}.csv"
        write_csv(apply_layout(only(df, split), meta, layout), target)
        written.append(target)
    return written


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The layout manifest (a row per layout and column) as JSON lines."""
    manifest.coalesce(1).write.mode("overwrite").json(path)


def write_headers(train: DataFrame, meta: TableMeta, path: str, layouts: list[str] | None = None) -> None:
    """``layout_info`` of every layout as one JSON line, with the number of classes that ``train`` has in the target."""
    classes = count_classes(train, meta)
    found = [{"layout": layout, **layout_info(meta, layout, classes)} for layout in layouts or LAYOUTS]
    lines = [(json.dumps(header),) for header in found]  # one line per layout
    train.sparkSession.createDataFrame(lines, "line string").coalesce(1).write.mode("overwrite").text(path)


def write_rows(parsed: DataFrame, columns: list[str], path: str) -> None:
    """Parsed completions as CSV."""
    write_csv(keep(parsed, columns), path)

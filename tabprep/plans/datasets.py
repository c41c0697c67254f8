"""The seven benchmark tables as recipes over files, and one call from raw files to layouts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.meta import TableMeta
from tabprep.operators.columns import col, depth_columns, drop_required
from tabprep.operators.layouts import apply_layout
from tabprep.operators.ordering import with_source_order
from tabprep.operators.roles import coerce, learn_meta
from tabprep.operators.splits import contiguous_zones, find_cuts, only
from tabprep.plans import recipes
from tabprep.sources.readers import INDEX_COLUMN, read_csv, read_json_lines
from tabprep.sources.structural import ROWS, structural_ids, structural_table
from tabprep.workspace import pin

# The columns the tables consist of, need and drop.
ATTACK_LOG_COLUMNS = ["pattern", "source_ip", "source_port", "request_raw", "request_url", "attackerPort", "victimPort", "md5"]
ATTACK_LOG_DROPPED = ["_id", "ident", "normalized", "channel", "payload", "source", "timestamp", "time", "filename"]
COLLISION_IDS = ["Run", "Event"]
BOOK_FAMILIES = ["bids_distance", "asks_distance", "bids_notional", "asks_notional"]
BOOK_DEPTH = 5
ARTWORK_KEYS = ["Title", "Artist"]
ARTWORK_DROPPED = ["URL", "ImageURL", "Classification", "Artist", "Seat Height (cm)"]
SHOP_ORDER_COLUMNS = [
    "review_score", "price", "freight_value", "product_category_name", "product_name_length",
    "product_description_length", "product_photos_qty", "order_status", "order_purchase_timestamp",
    "order_delivered_customer_date",
]
SHOP_ORDER_COPIES = {
    "product_name_length": "product_name_lenght",
    "product_description_length": "product_description_lenght",
}

Ordered = tuple[DataFrame, list[str]]


def _attack_log(spark: SparkSession, path: str) -> Ordered:
    """JSON lines: the payload is a JSON object in a text, the source an array of address and port."""
    in_payload = [c for c in ATTACK_LOG_COLUMNS if c not in ("source_ip", "source_port")]
    plain = [c for c in ATTACK_LOG_DROPPED if c != "source"] + in_payload
    schema = ", ".join(f"{c} string" for c in plain) + ", source array<string>"
    raw, order = with_source_order(read_json_lines(spark, path, schema), stage=False)
    # A time given as an object with one text field is read from that field.
    inner = F.get(F.map_values(F.from_json("time", "map<string, string>")), 0)
    raw = raw.withColumn("time", F.when(F.col("time").startswith("{"), inner).otherwise(F.col("time")))
    table = recipes.payload_events(
        raw, "payload", "time", "pattern", ATTACK_LOG_COLUMNS, order,
        payload_schema=", ".join(f"{c} string" for c in in_payload), filling=in_payload,
        elements={"source_ip": ("source", 0), "source_port": ("source", 1)}, drop=ATTACK_LOG_DROPPED, keep_order=True,
    )
    return table, ["_at", *order]


def _health_records(spark: SparkSession, path: str) -> Ordered:
    raw = pin(read_csv(spark, path), "records")
    table = recipes.shuffled_table(raw, "id", drop=["id"], numeric=["bmi"], required=["stroke"], keep_order=True)
    return table, ["_shuffle", "id"]


def _collisions(spark: SparkSession, path: str) -> Ordered:
    raw, order = with_source_order(read_csv(spark, path))
    keyed = raw.withColumn("_key", F.concat_ws("|", *order)).drop(*order)
    table = recipes.shuffled_table(keyed, "_key", drop=[*COLLISION_IDS, "_key"], complete=True, suffix="_", keep_order=True)
    return table, ["_shuffle", "_key"]


def _order_book(spark: SparkSession, path: str) -> Ordered:
    raw, order = with_source_order(drop_required(read_csv(spark, path), [INDEX_COLUMN]))
    levels = depth_columns(BOOK_FAMILIES, BOOK_DEPTH)
    table = recipes.purged_series(raw, "system_time", "midpoint", levels, tiebreak=order, keep_order=True)
    return table, ["_at", *order]


def _artworks(spark: SparkSession, path: str) -> Ordered:
    raw, order = with_source_order(read_csv(spark, path, multi_line=True))  # titles hold line breaks
    table = recipes.distinct_texts(raw, ARTWORK_KEYS, order, drop=[*ARTWORK_DROPPED, *order], keep_order=True)
    return table, ["_shuffle", *order]


def _shop_orders(spark: SparkSession, orders: str, items: str, products: str, reviews: str) -> Ordered:
    tables = [pin(read_csv(spark, path), "shop") for path in (orders, items, products)]
    tables.append(pin(read_csv(spark, reviews, multi_line=True), "shop"))  # reviews hold line breaks
    tiebreak = ["order_id", "order_item_id", "review_id"]
    table = recipes.flat_orders(
        *tables, "order_id", "product_id", "order_purchase_timestamp", "freight_value", SHOP_ORDER_COLUMNS, tiebreak,
        copies=SHOP_ORDER_COPIES, keep_order=True,
    )
    return table, ["order_purchase_timestamp", *tiebreak]


def _structural(spark: SparkSession, rows: int = ROWS) -> Ordered:
    table = structural_table(structural_ids(spark, rows))
    # The ids are the positions: the cut points need no data.
    return find_cuts(structural_ids(spark, rows), ["id"], contiguous_zones(rows)).label(table), ["id"]


@dataclass(frozen=True)
class Dataset:
    build: Callable[..., Ordered]
    target: str
    task: str


# What each table is to predict.
DATASETS = {
    "attack_log": Dataset(_attack_log, "pattern", "classification"),
    "health_records": Dataset(_health_records, "stroke", "classification"),
    "collisions": Dataset(_collisions, "M_", "regression"),
    "order_book": Dataset(_order_book, "future_return", "regression"),
    "artworks": Dataset(_artworks, "Department", "classification"),
    "shop_orders": Dataset(_shop_orders, "freight_value", "regression"),
    "structural": Dataset(_structural, "target_class", "classification"),
}

# Columns that belong to the table although they order it.
_BOTH = {"order_purchase_timestamp"}


def load(spark: SparkSession, name: str, **sources) -> DataFrame:
    """The cleaned table with its ``split`` column."""
    table, order = DATASETS[name].build(spark, **sources)
    return _table_first(table.drop(*[c for c in order if c not in _BOTH]))


def _table_first(table: DataFrame) -> DataFrame:
    return table.select(*[col(c) for c in table.columns if c != "split"], "split")


@dataclass(frozen=True)
class Prepared:
    """A labelled and coerced table with the roles learned from its train split."""

    table: DataFrame
    meta: TableMeta

    def data(self, split: str, layout: str | None = None) -> DataFrame:
        """``train``, ``val``, ``test`` or ``all`` rows, in a layout or as they are."""
        rows = only(self.table, split)
        return apply_layout(rows, self.meta, layout) if layout else rows


def prepare_table(table: DataFrame, order: list[str], target: str, task: str, name: str = "") -> Prepared:
    """Learn roles from the train rows of a labelled table and coerce all rows to them.

    ``order`` is the row order for date sniffing; those of its columns that start with ``_`` are
    dropped. ``table`` is read again for learning and for every later use: pin one that is dear to make.
    """
    helpers = [c for c in order if c.startswith("_")]
    meta = learn_meta(only(table, "train"), order, ignore=helpers, target=target, task=task, name=name)
    return Prepared(_table_first(coerce(table.drop(*helpers), meta)), meta)


def prepare(spark: SparkSession, name: str, **sources) -> Prepared:
    """From the raw files of one benchmark table to its coerced splits and roles."""
    dataset = DATASETS[name]
    table, order = dataset.build(spark, **sources)
    renamed = {c: f"_order_{c}" for c in order if c not in _BOTH and not c.startswith("_")}
    table = table.withColumnsRenamed(renamed)
    return prepare_table(table, [renamed.get(c, c) for c in order], dataset.target, dataset.task, name)

"""One query per operator and recipe, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.functions import dates, numbers, text
from tabprep.operators import columns, layouts, ordering, payloads, profiles, prompts, roles, rows, series, splits
from tabprep.operators.completions import complete, parse_completions
from tabprep.operators.joins import equi_join, hot_keys
from tabprep.plans import recipes
from tabprep.sources.readers import read_csv, read_json_lines, read_split
from tabprep.sources.structural import structural_table
from tabprep.sources.writers import write_csv, write_headers, write_layout, write_manifest, write_rows, write_splits
from tabprep.workspace import new_path

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}


def query(function: Query) -> Query:
    _registry[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_registry)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unmatched(part: DataFrame, rule: str) -> DataFrame:
    """All parts; those of the rule get a key that no item has."""
    return part.withColumn("p_partkey", F.when(F.expr(rule), -F.col("p_partkey")).otherwise(F.col("p_partkey")))


# --- ordering and splits -------------------------------------------------------------------------


@query
def split_chrono(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return splits.split_contiguous(events, ["ts", "event_id"]).select("event_id", "split")


@query
def split_train_rows(spark, sf_dir):
    """The train rows alone, as a range filter on the order columns."""
    events = table(spark, sf_dir, "events")
    cuts = splits.find_cuts(events, ["ts", "event_id"], splits.contiguous_zones(events.count()))
    return cuts.rows(events, "train").select("event_id", "value")


@query
def split_by_text(spark, sf_dir):
    """An order that starts with a text of few values, found with a search several passes deep."""
    orders = table(spark, sf_dir, "orders")
    order = ["o_orderpriority", "o_orderdate", "o_orderkey"]
    split = splits.split_contiguous(orders, order, sort_limit=2_000)
    return split.select("o_orderkey", "split")


@query
def split_shuffled(spark, sf_dir):
    customer = ordering.with_shuffle_key(table(spark, sf_dir, "customer"), "c_custkey", seed=42)
    return splits.split_contiguous(customer, ["_shuffle", "c_custkey"]).select("c_custkey", "split")


@query
def split_purged(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return splits.split_purged(events, ["ts", "event_id"], gap=120).select("event_id", "split")


@query
def global_ordinal(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return ordering.with_row_number(orders, ["o_orderdate", "o_orderkey"], "row_no").select("o_orderkey", "row_no")


@query
def lead_return(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("ts", "event_id", "value")
    changed = series.with_future_change(events, ["ts", "event_id"], "value", 5)
    return rows.drop_missing(changed, ["future_return"]).select("event_id", "future_return")


@query
def lead_return_by_series(spark, sf_dir):
    """Like ``lead_return`` within each user's own series, with all other columns kept."""
    events = table(spark, sf_dir, "events")
    changed = series.with_future_change(events, ["ts", "event_id"], "value", 5, series="user_id", block_rows=1_000)
    return changed.select("event_id", "event_type", "future_return")


# --- rows and columns ----------------------------------------------------------------------------


@query
def dedup_first(spark, sf_dir):
    return rows.keep_first(table(spark, sf_dir, "part"), "p_name", ["p_partkey"])


@query
def dedup_chain(spark, sf_dir):
    return rows.keep_first_chain(table(spark, sf_dir, "part"), ["p_name", "p_brand"], ["p_partkey"])


@query
def dedup_text(spark, sf_dir):
    return rows.keep_first(table(spark, sf_dir, "documents"), "text", ["doc_id"]).select("doc_id", "lang", "text")


@query
def normalize_newlines(spark, sf_dir):
    return columns.join_text_lines(table(spark, sf_dir, "documents")).select("doc_id", "text")


@query
def json_flatten(spark, sf_dir):
    """Keys discovered from the data."""
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return payloads.flatten_payload(events, "props").select("event_id", "k")


@query
def json_flatten_nested(spark, sf_dir):
    """Nested objects become dotted columns; anything that is not an object becomes empty cells."""
    events = table(spark, sf_dir, "events")
    nested = F.concat(F.lit('{"a": {"b": '), F.col("user_id"), F.lit(', "c": "'), F.col("event_type"),
                      F.lit('"}, "list": [1, '), F.col("event_id"), F.lit("]}"))
    kind = F.col("event_id") % 5
    payload = F.when(kind == 0, F.concat(F.lit("["), nested, F.lit("]"))).when(kind == 1, F.col("event_type"))
    raw = events.select("event_id", payload.otherwise(nested).alias("payload"))
    flat = payloads.flatten_payload(raw, "payload", "a struct<b: bigint, c: string>, list string")
    return flat.select("event_id", F.col("`a.b`").alias("a_b"), F.col("`a.c`").alias("a_c"), "list")


@query
def json_flatten_keys(spark, sf_dir):
    """Discovered keys, some of them repeated in an object, some different only in case."""
    events = table(spark, sf_dir, "events")
    user, number = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    full = F.concat(F.lit('{"k": "old", "k": '), user, F.lit(', "K": "'), F.col("event_type"), F.lit('", "in": {"x": '),
                    number, F.lit(', "X": 1}}'))
    kind = F.col("event_id") % 4
    payload = F.when(kind == 0, '{"K": "alone"}').when(kind == 1, F.concat(full, F.lit(" tail"))).otherwise(full)
    flat = payloads.flatten_payload(events.select("event_id", payload.alias("payload")), "payload")
    return flat.select("event_id", "K", F.col("k_2"), F.col("`in.X`").alias("in_upper"), F.col("`in.x_2`").alias("in_lower"))


@query
def array_element_default(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    parts = F.split("c_name", "#")
    short = F.when(F.col("c_custkey") % 3 == 0, F.slice(parts, 1, 1)).when(F.col("c_custkey") % 3 == 1, parts)
    picked = customer.select("c_custkey", short.alias("parts"))
    return picked.select("c_custkey", text.element_or(F.col("parts"), 0).alias("first"),
                         text.element_or(F.col("parts"), 1).alias("second"))


@query
def null_tokens(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    kind = F.col("o_orderkey") % 8
    token = (
        F.when(kind == 0, "NaN").when(kind == 1, "nan").when(kind == 2, "None").when(kind == 3, "null")
        .when(kind == 4, "").when(kind == 5, " ").when(kind == 6, " null").otherwise(F.col("o_orderstatus"))
    )
    cleared = columns.clear_null_tokens(orders.select("o_orderkey", token.alias("status"), "o_orderpriority"))
    return cleared


@query
def parse_timestamps(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    written = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    kind = F.col("event_id") % 5
    raw = F.when(kind == 0, F.substring(written, 1, 10)).when(kind == 1, F.concat(F.lit("x"), written))
    raw = raw.when(kind == 2, F.concat(F.substring(written, 1, 5), F.lit("13-41"))).otherwise(written)
    return events.select("event_id", dates.parse_timestamp(raw).alias("parsed"))


@query
def parse_timestamps_strict(spark, sf_dir):
    """Times in another form than ISO: the form is learned from the first of them, and every other text would be an error."""
    events = table(spark, sf_dir, "events")
    written = events.select("event_id", F.date_format("ts", "M/d/yyyy HH:mm:ss").alias("written"))
    found = roles.leading_format(written, "written", ["event_id"])
    return written.select("event_id", dates.parse_timestamp_strict(F.col("written"), found).alias("parsed"))


@query
def format_minute(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.format_minute(F.col("ts")).alias("minute"))


@query
def coerce_numeric(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 9
    shaped = (
        F.when(kind == 0, F.concat(F.lit(" "), size, F.lit(" "))).when(kind == 1, F.concat(size, F.lit("e3")))
        .when(kind == 2, F.concat(F.lit("+"), size)).when(kind == 3, F.concat(F.lit("."), size))
        .when(kind == 4, F.concat(size, F.lit("."))).when(kind == 5, F.concat(size, F.lit("d")))
        .when(kind == 6, F.concat(F.lit("0x"), size)).when(kind == 7, F.col("p_name")).otherwise(size)
    )
    brand = numbers.parse_number(F.substring("p_brand", 7, 10))
    return part.select("p_partkey", brand.alias("brand_no"), numbers.parse_number(shaped).alias("shaped"))


def _labelled(spark, sf_dir) -> DataFrame:
    return equi_join(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "left")


@query
def dropna_subset(spark, sf_dir):
    return rows.drop_missing(_labelled(spark, sf_dir), ["quality"]).select("doc_id", "quality", "toxic")


@query
def dropna_any(spark, sf_dir):
    gaps = _labelled(spark, sf_dir).select(
        "doc_id", F.nullif("lang", F.lit("fr")).alias("lang"), "quality",
        F.when(F.col("n_chars") % 7 == 0, float("nan")).otherwise(F.col("n_chars").cast("double")).alias("size"),
    )
    return rows.drop_missing(gaps)


@query
def rename_strip_suffix(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return columns.suffix_names(nation.toDF(*[f" {name} " for name in nation.columns]))


@query
def join_inner(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    orders = table(spark, sf_dir, "orders")
    joined = equi_join(orders, items, "o_orderkey", hot=hot_keys(items, "o_orderkey"))
    return joined.select("o_orderkey", "o_orderstatus", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query
def join_left_dim(spark, sf_dir):
    """A dimension join with the hottest keys dealt out over several groups."""
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    part = unmatched(table(spark, sf_dir, "part"), "p_size <= 10")
    hot = hot_keys(items, "p_partkey", share=0.0007)
    joined = equi_join(items, part, "p_partkey", "left", hot=hot, copies=8)
    return joined.select("l_orderkey", "l_linenumber", "p_partkey", "l_suppkey", "p_name", "p_retailprice")


@query
def join_left_fanout(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumn("o_custkey", F.col("c_custkey") * 2)
    joined = equi_join(customer, table(spark, sf_dir, "orders"), "o_custkey", "left")
    return joined.select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query
def join_left_unmatched(spark, sf_dir):
    return _labelled(spark, sf_dir).select("doc_id", "source", "quality", "toxic")


@query
def join_null_safe(spark, sf_dir):
    """NULL keys match NULL keys."""
    nation = table(spark, sf_dir, "nation").withColumn("key", F.nullif("n_regionkey", F.lit(0)))
    region = table(spark, sf_dir, "region").withColumn("key", F.nullif("r_regionkey", F.lit(0)))
    customers = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = equi_join(customers, region, "key", "inner", null_safe=True)
    return joined.select("c_custkey", "key", "r_name")


# --- profiles, roles, coercion, layouts ----------------------------------------------------------

# Source order of every table that is profiled.
_ORDERS = {
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
    "orders": ["o_orderkey"],
    "customer": ["c_custkey"],
    "documents": ["doc_id"],
    "part": ["p_partkey"],
    "events": ["event_id"],
    "benchmark": ["item_id"],
    "pages": ["page_id"],
}


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("table_name", F.lit(name))


@query
def profile_columns(spark, sf_dir):
    both = [_named(profiles.profile(table(spark, sf_dir, name)), name) for name in ("lineitem", "customer")]
    return both[0].unionByName(both[1]).select("table_name", "column", "n_rows", "n_filled", "n_unique", "all_whole")


@query
def sniff_datetime(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    even = F.col("o_orderkey") % 2 == 0
    written = orders.select(
        "o_orderkey", "o_orderstatus",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso_date"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("iso_second"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("slashed"),
        F.date_format("o_orderdate", "yyyy").alias("year"),
        F.date_format("o_orderdate", "HH:mm").alias("clock"),
        F.when(~even, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("gaps"),
        F.when(even, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).alias("mixed"),
        F.col("o_totalprice").cast("string").alias("price"),
    )
    return roles.sniff_dates(written, ["o_orderkey"]).select("column", "is_datetime")


@query
def layout_epoch_text(spark, sf_dir):
    """Dates written as text in several forms, sniffed, and read by the form that was found."""
    orders = table(spark, sf_dir, "orders")
    forms = {"slashed": "MM/dd/yyyy", "year": "yyyy", "clocked": "dd/MM/yyyy HH:mm", "digits": "yyyyMMdd", "named": "d MMMM yyyy",
             "dotted": "yyyy.MM.dd", "month": "yyyy-MM"}
    written = orders.select("o_orderkey", *[F.date_format("o_orderdate", form).alias(name) for name, form in forms.items()])
    meta = roles.learn_meta(written, ["o_orderkey"])
    return layouts.apply_layout(written, meta, layouts.EPOCH)


@query
def infer_roles(spark, sf_dir):
    found = [_named(roles.infer_roles(table(spark, sf_dir, name), order), name) for name, order in _ORDERS.items()]
    merged = found[0]
    for one in found[1:]:
        merged = merged.unionByName(one)
    return merged.select("table_name", "column", "role", "n_unique", "n_rows")


@query
def infer_roles_screened(spark, sf_dir):
    """Roles with estimated counts where those are far from the limits."""
    found = []
    for name, order in _ORDERS.items():
        meta = roles.learn_meta(table(spark, sf_dir, name), order)
        found += [(name, column, role) for column, role in meta.roles]
    return spark.createDataFrame(found, "table_name string, column string, role string")


@query
def infer_roles_train(spark, sf_dir):
    """Roles from the train split only."""
    orders = splits.split_contiguous(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"])
    found = roles.infer_roles(splits.only(orders, "train"), ["o_orderdate", "o_orderkey"])
    return found.select("column", "role", "n_unique", "n_rows")


@query
def coerce_roles(spark, sf_dir):
    labelled = _labelled(spark, sf_dir)
    return roles.coerce(labelled, roles.learn_meta(labelled, ["doc_id"]))


def _lineitem(spark, sf_dir, target: str):
    items = table(spark, sf_dir, "lineitem")
    meta = roles.learn_meta(items, _ORDERS["lineitem"]).with_target(target, "regression")
    return roles.coerce(items, meta), meta


@query
def layout_role_subset(spark, sf_dir):
    items, meta = _lineitem(spark, sf_dir, "l_shipdate")
    return layouts.apply_layout(items, meta, layouts.ROLE_SUBSET)


@query
def layout_role_grouped(spark, sf_dir):
    labelled = _labelled(spark, sf_dir)
    meta = roles.learn_meta(labelled, ["doc_id"])
    return layouts.apply_layout(roles.coerce(labelled, meta), meta, layouts.ROLE_GROUPED)


@query
def layout_all_columns(spark, sf_dir):
    items, meta = _lineitem(spark, sf_dir, "l_tax")
    return layouts.apply_layout(items, meta, layouts.ALL_COLUMNS)


@query
def layout_epoch(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    gaps = events.withColumn("ts", F.when(F.col("event_id") % 9 != 0, F.col("ts")))
    meta = roles.learn_meta(gaps, ["event_id"])
    return layouts.apply_layout(roles.coerce(gaps, meta), meta, layouts.EPOCH)


@query
def layout_manifest(spark, sf_dir):
    found = roles.infer_roles(table(spark, sf_dir, "lineitem"), _ORDERS["lineitem"])
    placed = layouts.manifest(found, target="l_shipdate")
    return placed.withColumn("position", F.col("position").cast("bigint"))


# --- prompts, completions, generated rows, sinks -------------------------------------------------


@query
def serialize_rows(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return prompts.with_json_line(customer, customer.columns, "line", ["c_custkey"])


@query
def fewshot_prompts(spark, sf_dir):
    """One prompt per supplier with five customers each."""
    customer = table(spark, sf_dir, "customer")
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("prompt_id"))
    return prompts.few_shot_prompts(customer, ["c_custkey"], customer.columns, ids, shots=5, seed=42)


@query
def parse_completions_rows(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    role, turn, body = F.col("role"), F.col("turn").cast("string"), F.col("text")
    quoted = F.expr("substring(to_json(named_struct('v', text)), 6, length(to_json(named_struct('v', text))) - 6)")
    kind = (F.col("conv_id") + F.col("turn")) % 6
    generated = (
        F.when(kind == 0, F.concat(F.lit('"g_role": "'), role, F.lit('", "g_turn": '), turn, F.lit("} tail "), body))
        .when(kind == 1, body)
        .when(kind == 2, F.concat(F.lit('"g_role": {"x": "'), role, F.lit('"}, "g_turn": 1}')))
        .when(kind == 3, F.concat(F.lit(' \n "g_role": "'), role, F.lit('", "zz": 3, "g_turn": null}\t ')))
        .when(kind == 4, F.concat(F.lit('"g_role": "'), role, F.lit('", "g_text": '), quoted, F.lit("}")))
        .otherwise(F.concat(F.lit('"g_role": "'), role, F.lit('", "g_turn": tru}')))
    )
    completions = talk.select("conv_id", "turn", generated.alias("generated_text"))
    return parse_completions(completions, "generated_text", ["g_role", "g_turn", "g_text"], carry=["conv_id", "turn"])


@query
def gen_structural(spark, sf_dir):
    """One generated row per order."""
    ids = table(spark, sf_dir, "orders").select("o_orderkey")
    made = structural_table(ids, "o_orderkey")
    reals = ["root_1", "root_2", "collider", "proxy_sin"]
    return made.select("o_orderkey", *[F.round(c, 6).alias(c) for c in reals], "distractor_cat", "target_class")


@query
def cached_split(spark, sf_dir):
    """Written as one folder per split and read back."""
    events = table(spark, sf_dir, "events")
    path = new_path(spark, "splits")
    write_splits(splits.split_contiguous(events, ["ts", "event_id"]), path)
    return read_split(spark, path).select("event_id", "event_type", "split")


# --- files -----------------------------------------------------------------------------------------


@query
def csv_scan(spark, sf_dir):
    """Orders as CSV with null spellings, read back with inferred types."""
    orders = table(spark, sf_dir, "orders")
    kind = F.col("o_orderkey") % 5
    status = F.when(kind == 0, "NA").when(kind == 1, "n/a").when(kind == 2, " NA").otherwise(F.col("o_orderstatus"))
    gaps = F.when(kind != 3, F.col("o_custkey"))
    path = new_path(spark, "orders-csv")
    write_csv(orders.withColumns({"o_orderstatus": status, "o_custkey": gaps}), path)
    return read_csv(spark, path)


@query
def csv_line_breaks(spark, sf_dir):
    """Whole documents as CSV cells with line breaks and quotes, read back unchanged."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(' "a",'), "text", F.lit('\n"b" ')).alias("text"))
    path = new_path(spark, "documents-csv")
    write_csv(documents, path)
    return read_csv(spark, path, "doc_id bigint, text string", multi_line=True)


@query
def json_lines_scan(spark, sf_dir):
    """Events as JSON lines, read back by the wanted fields only."""
    events = table(spark, sf_dir, "events")
    source = F.when(F.col("event_id") % 4 != 0, F.array(F.col("event_type"), F.col("user_id").cast("string")))
    path = new_path(spark, "events-json")
    events.withColumn("source", source).write.json(path)
    read = read_json_lines(spark, path, "event_id bigint, value double, props string, source array<string>, absent string")
    return read.select("event_id", "value", "props", text.element_or(F.col("source"), 1).alias("user"), "absent")


def _split_customers(spark, sf_dir, target: str, task: str):
    customer = splits.split_contiguous(table(spark, sf_dir, "customer"), ["c_custkey"])
    train = splits.only(customer, "train")
    meta = roles.learn_meta(train, ["c_custkey"], target=target, task=task, name="customers")
    return roles.coerce(customer, meta), train, meta


@query
def layout_csv(spark, sf_dir):
    """Every layout of every split as CSV, read back: one row per cell. Some layouts leave columns out."""
    customer, _, meta = _split_customers(spark, sf_dir, "c_acctbal", "regression")
    path, found = new_path(spark, "layouts"), None
    for layout in layouts.LAYOUTS:
        for split, written in zip(("train", "val", "test"), write_layout(customer, meta, layout, f"{path}/{layout}", ["train", "val", "test"])):
            read = spark.read.option("header", True).csv(written)
            cells = read.unpivot("c_custkey", [c for c in read.columns if c != "c_custkey"], "column", "cell")
            cells = cells.select(F.lit(layout).alias("layout"), F.lit(split).alias("split"), "c_custkey", "column", "cell")
            found = cells if found is None else found.unionByName(cells)
    return found


@query
def layout_headers(spark, sf_dir):
    """The header file of every layout, read back, lists as texts."""
    _, train, meta = _split_customers(spark, sf_dir, "c_mktsegment", "classification")
    path = new_path(spark, "headers")
    write_headers(train, meta, path)
    lists = ["column_names", "num_col_idx", "cat_col_idx", "target_col_idx", "dropped"]
    fields = ", ".join(f"{name} array<string>" for name in lists)
    read = read_json_lines(spark, path, f"layout string, name string, task_type string, n_classes bigint, {fields}")
    return read.select("layout", "name", "task_type", "n_classes", *[F.concat_ws(",", name).alias(name) for name in lists])


@query
def manifest_file(spark, sf_dir):
    path = new_path(spark, "manifest")
    write_manifest(layout_manifest(spark, sf_dir), path)
    return read_json_lines(spark, path, "layout string, column string, position bigint, kind string, is_target boolean")


@query
def completions_csv(spark, sf_dir):
    """Parsed completions as CSV, read back."""
    path = new_path(spark, "completions")
    write_rows(parse_completions_rows(spark, sf_dir), ["conv_id", "turn", "g_role", "g_turn"], path)
    return read_csv(spark, path, "conv_id bigint, turn bigint, g_role string, g_turn string")


@query
def gen_structural_split(spark, sf_dir):
    """Generated rows with their split, by the ids alone."""
    orders = table(spark, sf_dir, "orders")
    cuts = splits.find_cuts(orders.select("o_orderkey"), ["o_orderkey"], splits.contiguous_zones(orders.count()))
    return cuts.label(gen_structural(spark, sf_dir))


# --- recipes -------------------------------------------------------------------------------------


@query
def recipe_events_json(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 10
    raw = events.select(
        "event_id", "ts", F.col("props").alias("payload"), F.lit("x").alias("channel"),
        F.when(kind == 0, "null").otherwise(F.col("event_type")).alias("pattern"),
        F.when(kind == 1, F.array(F.col("user_id").cast("string")))
        .when(kind != 2, F.array(F.col("user_id").cast("string"), F.lit("80"))).alias("source"),
    )
    return recipes.payload_events(
        raw, "payload", "ts", "pattern", ["event_id", "pattern", "source_ip", "source_port", "k"], ["event_id"],
        payload_schema="k bigint", elements={"source_ip": ("source", 0), "source_port": ("source", 1)},
        drop=["payload", "source", "channel", "not_there"],
    )


@query
def recipe_events_text_time(spark, sf_dir):
    """Times in text, month first; what is no time comes last."""
    events = table(spark, sf_dir, "events")
    written = F.when(F.col("event_id") % 10 == 3, "soon").otherwise(F.date_format("ts", "MM/dd/yyyy HH:mm:ss"))
    raw = events.select("event_id", written.alias("time"), F.col("props").alias("payload"), "event_type")
    return recipes.payload_events(
        raw, "payload", "time", "event_type", ["event_id", "event_type", "k"], ["event_id"], payload_schema="k bigint", drop=["payload"]
    )


@query
def recipe_shuffled(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    raw = customer.select(
        "c_custkey", "c_name", "c_mktsegment",
        F.when(key % 10 == 0, "N/A").otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
        F.nullif("c_nationkey", F.lit(3)).alias("nation"),
    )
    return recipes.shuffled_table(raw, "c_custkey", drop=["c_name"], numeric=["balance"], required=["nation"])


@query
def recipe_complete(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    raw = customer.withColumn("c_acctbal", F.when(F.col("c_custkey") % 4 == 0, float("nan")).otherwise(F.col("c_acctbal")))
    return recipes.shuffled_table(raw, "c_custkey", drop=["c_name", "not_there"], complete=True, suffix="_", seed=42)


@query
def recipe_few_shot(spark, sf_dir):
    """From train rows to prompts, completions and parsed rows; one prompt per supplier.

    Each prompt is completed with its own last example.
    """

    def repeat_last_example(batches):
        for batch in batches:
            last = batch["prompt"].str.split("\n").str[-4]
            yield batch[["prompt_id"]].assign(generated_text=" " + last.str[1:] + " {}")

    customer = table(spark, sf_dir, "customer")
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("prompt_id"))
    return recipes.synthetic_rows(customer, ["c_custkey"], ["c_name", "c_acctbal"], ids,
                                  lambda asked: complete(asked, repeat_last_example))


@query
def recipe_purged_series(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return recipes.purged_series(events, "ts", "value", ["event_id", "event_type"], tiebreak=["event_id"])


@query
def recipe_dedup_text(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return recipes.distinct_texts(documents, ["text", "n_chars"], ["doc_id"], drop=["source"])


_FLAT_COLUMNS = ["review_score", "l_extendedprice", "freight", "p_type", "p_name_length", "p_size", "o_orderstatus",
                 "o_orderdate", "l_shipdate"]
_FLAT_TIEBREAK = ["o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "review_id"]


def _flat_orders(spark, sf_dir, columns: list[str]) -> DataFrame:
    """Orders, their items, the part of each item, and events standing in for reviews."""
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    items = items.withColumn("freight", F.when(F.col("l_suppkey") % 10 != 0, F.col("l_tax")))
    part = unmatched(table(spark, sf_dir, "part"), "p_size <= 5")
    parts = part.select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size",
                        F.length("p_name").alias("p_name_lenght"))
    reviews = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("o_orderkey"), F.col("event_id").alias("review_id"),
        (F.col("event_id") % 5 + 1).alias("review_score"),
    )
    return recipes.flat_orders(
        table(spark, sf_dir, "orders"), items, parts, reviews, "o_orderkey", "l_partkey", "o_orderdate", "freight",
        columns, _FLAT_TIEBREAK, copies={"p_name_length": "p_name_lenght"},
    )


@query
def recipe_flat_orders(spark, sf_dir):
    return _flat_orders(spark, sf_dir, ["o_orderkey", *_FLAT_COLUMNS])


@query
def flagship(spark, sf_dir):
    """Flatten, split, learn roles from train, coerce every split, lay out."""
    flat = _flat_orders(spark, sf_dir, ["o_orderkey", "review_id", "l_partkey", "l_linenumber", *_FLAT_COLUMNS])
    keys = ["o_orderkey", "review_id", "l_linenumber"]
    order = ["o_orderdate", "o_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "review_id"]
    meta = roles.learn_meta(splits.only(flat, "train"), order, ignore=keys, target="freight", task="regression")
    return layouts.apply_layout(roles.coerce(flat, meta), meta, layouts.EPOCH, also=[*keys, "split"])

"""Dropping, deduplicating, joining, flattening and typing tables."""

import datetime
import json
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep import workspace
from tabprep.meta import TableMeta
from tabprep.operators import columns, joins, layouts, payloads, profiles, roles, rows
from tabprep.operators.completions import complete, parse_completions
from tabprep.operators.prompts import PROMPT_HEADER, PROMPT_TRAILER, draw_positions, few_shot_prompts
from tabprep.plans import recipes


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_keep_first_counts_null_as_one_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "k string, n int").repartition(3)
    assert _rows(rows.keep_first(df, "k", ["n"])) == _rows(spark.createDataFrame([(None, 1), ("a", 3)], "k string, n int"))


def test_keep_first_chain_looks_at_survivors(spark):
    data = [("t1", "x", 1), ("t1", "y", 2), ("t2", "x", 3), ("t3", "y", 4)]
    df = spark.createDataFrame(data, "title string, artist string, n int")
    frame = pd.DataFrame(data).drop_duplicates(subset=[0]).drop_duplicates(subset=[1])
    assert [r[2] for r in _rows(rows.keep_first_chain(df, ["title", "artist"], ["n"]))] == sorted(frame[2])


def test_drop_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "v double, s string")
    assert rows.drop_missing(df, ["v"]).count() == 2
    assert rows.drop_missing(df).count() == 1
    assert [r["v"] for r in rows.nan_to_null(df).collect()] == [1.0, None, None, 2.0]


def test_columns(spark):
    df = spark.createDataFrame([(1, "a")], "` x ` int, y string")
    assert columns.suffix_names(df).columns == ["x_", "y_"]
    assert columns.drop_if_present(df, ["y", "zzz"]).columns == [" x "]
    assert columns.copy_columns(df, {"z": "y"}).columns == [" x ", "y", "z"]
    assert columns.depth_columns(["b", "a"], 2) == ["b_0", "a_0", "b_1", "a_1"]
    for strict in (columns.drop_required, columns.keep):
        with pytest.raises(ValueError, match="zzz"):
            strict(df, ["zzz"])


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_dealt_out_join_equals_plain_join(spark, how, null_safe):
    rng = random.Random(4)
    left = [(rng.choice([1, 1, 1, 2, 3, 9, None]), i) for i in range(300)]
    right = [(k, f"r{j}") for j, k in enumerate([1, 1, 2, 3, 3, 4, None, None])]
    a = spark.createDataFrame(left, "k int, n int")
    b = spark.createDataFrame(right, "k int, r string")
    expected = []
    for k, n in left:
        matches = [r for q, r in right if (k == q and k is not None) or (null_safe and k is None and q is None)]
        expected += [(k, n, r) for r in matches] or ([(k, n, None)] if how == "left" else [])
    hot = joins.hot_keys(a, "k", share=0.1)
    assert set(hot) >= {1, None}
    dealt = joins.deal_out(a, "k", hot, copies=5)
    assert dealt.where("k = 1").select("_deal").distinct().count() == 5
    plain = joins.equi_join(a, b, "k", how, null_safe)
    once = joins.equi_join(a, b, "k", how, null_safe, hot, copies=5)
    before = joins.equi_join(dealt, b, "k", how, null_safe, hot, copies=5).drop("_deal")
    for found in (plain, once, before):
        assert _rows(found) == sorted(expected, key=repr)


def test_null_keys(spark):
    a = spark.createDataFrame([("a",), (None,)], "k string")
    b = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, n int")
    assert joins.equi_join(a, b, "k").count() == 1
    assert joins.equi_join(a, b, "k", null_safe=True).count() == 3
    with pytest.raises(ValueError, match="both sides"):
        joins.equi_join(b, b, "k")


def test_hot_keys_of_empty_table(spark):
    assert joins.hot_keys(spark.createDataFrame([], "k string"), "k") == []
    assert joins.hot_keys(spark.range(50), "id") == []


def test_hot_keys_from_a_sample(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, -1, id) AS k")
    assert joins.hot_keys(df, "k", share=0.1, sample=2_000) == [-1]


PAYLOADS = ['{"a": {"b": 1, "c": "x"}, "l": [1, 2]}', '{"a": {"b": 2}, "z": null}', "[1, 2]", "7", "{bad", None, '{"a": 5}']


def test_flatten_discovers_keys(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PAYLOADS[:6])], "i int, p string")
    flat = payloads.flatten_payload(df, "p")
    assert flat.columns == ["i", "p", "a.b", "a.c", "l", "z"]
    found = {r["i"]: (r["a.b"], r["a.c"], r["l"]) for r in flat.collect()}
    assert found == {0: (1, "x", [1, 2]), 1: (2, None, None), **{i: (None, None, None) for i in (2, 3, 4, 5)}}


def test_flatten_refuses_name_clash(spark):
    df = spark.createDataFrame([(1, '{"i": 5, "v": 2}')], "i int, p string")
    with pytest.raises(ValueError, match="already columns"):
        payloads.flatten_payload(df, "p", "i int, v int")
    assert payloads.flatten_payload(df, "p", "i int, v int", replacing=["i"]).select("i", "v").collect() == [(5, 2)]
    assert payloads.flatten_payload(df.withColumn("p", F.lit("[]")), "p").columns == ["i", "p"]


def test_flatten_tells_keys_apart(spark):
    rows = ['{"k": "x", "k": 1, "K": "a", "N": {"y": 1, "Y": 2}, "N.y": 7}', '{"k": 5, "I": 9}', '{"k": 5} tail']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(rows)], "i int, p string")
    flat = payloads.flatten_payload(df, "p")
    assert flat.columns == ["i", "p", "I_2", "K", "N.Y", "N.y_2", "N.y_3", "k_2"]
    found = [tuple(r)[2:] for r in flat.orderBy("i").collect()]
    assert found == [(None, "a", 2, 1, 7, 1), (9, None, None, None, None, 5), (None,) * 6]
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


@pytest.mark.parametrize("form, kind", [("%m/%d/%Y %H:%M:%S", "coerce"), ("%Y%m%d", "coerce"), ("%b %d, %Y", "strict"),
                                        ("%d-%b-%Y", "strict"), ("%m/%d/%Y %I:%M %p", "strict")])
def test_recipes_read_times_by_their_form(spark, form, kind):
    days = [datetime.datetime(2020, 1, 1) + datetime.timedelta(days=37 * i % 101, minutes=i) for i in range(60)]
    written = [day.strftime(form) for day in days]
    parsed = [datetime.datetime.strptime(text, form) for text in written]
    frame = [(i, text, float(i + 1), "{}", "t") for i, text in enumerate(written)]
    df = spark.createDataFrame(frame, "i int, time string, v double, payload string, target string")
    by_time = sorted(range(60), key=lambda i: (parsed[i], i))
    if kind == "coerce":
        late = df.withColumn("time", F.when(F.col("i") == 30, "later").otherwise(F.col("time")))
        found = recipes.payload_events(late, "payload", "time", "target", ["i"], ["i"], payload_schema="q int")
        expected = [i for i in by_time if i != 30] + [30]
        assert {r["i"] for r in found.where("split = 'train'").collect()} == set(expected[:45])
        assert 30 in {r["i"] for r in found.where("split = 'test'").collect()}
        return
    found = recipes.purged_series(df, "time", "v", ["i"], steps=1, gap=0, tiebreak=["i"], keep_time=True).collect()
    change = {a: ((b + 1) - (a + 1)) / (a + 1) for a, b in zip(by_time, by_time[1:])}
    assert {r["i"]: r["future_return"] for r in found} == change
    assert {r["i"]: r["time"] for r in found} == {i: parsed[i].strftime("%Y-%m-%d %H:%M") for i in change}
    with pytest.raises(Exception, match="not a timestamp"):
        bad = df.withColumn("time", F.when(F.col("i") == 30, "later").otherwise(F.col("time")))
        recipes.purged_series(bad, "time", "v", ["i"], tiebreak=["i"]).collect()


# --- roles ---------------------------------------------------------------------------------------


def _brute_role(values, numeric):
    """The role rule on plain values, dates aside."""
    filled = [v for v in values if v is not None and not (isinstance(v, float) and math.isnan(v))]
    if not filled:
        return None
    if numeric and not all(float(v).is_integer() for v in filled):
        return "continuous"
    unique = len(set(filled))
    if unique <= 200 or unique / len(values) < 0.1:
        return "categorical"
    return "integer" if numeric else "text"


def test_role_edges(spark):
    n = 2_010
    table = {
        "i": ("int", list(range(n))),
        "at200": ("int", [i % 200 for i in range(n)]),
        "at201": ("int", [i % 201 for i in range(n)]),
        "at202": ("int", [i % 202 for i in range(n)]),
        "whole": ("double", [float(i) for i in range(n)]),
        "few": ("double", [float(i % 3) for i in range(n)]),
        "infinite": ("double", [1.0] * (n - 1) + [float("inf")]),
        "gaps": ("double", [float("nan") if i % 2 else 1.5 for i in range(n)]),
        "empty": ("string", [None] * n),
        "flag": ("boolean", [i % 2 == 0 for i in range(n)]),
        "words": ("string", [f"w{i}" for i in range(n)]),
        "codes": ("string", [f"c{i % 150}" for i in range(n)]),
        "halves": ("double", [i / 2 for i in range(n)]),
    }
    schema = ", ".join(f"{name} {kind}" for name, (kind, _) in table.items())
    df = spark.createDataFrame(list(zip(*[values for _, values in table.values()])), schema).repartition(3)
    expected = {name: _brute_role(values, kind != "string") for name, (kind, values) in table.items()}
    assert expected["at201"] == "integer" and expected["at200"] == "categorical"  # 201 / 2010 is not below 0.1
    found = {r["column"]: r["role"] for r in roles.infer_roles(df, ["i"]).collect()}
    assert found == expected
    for exact in (False, True):
        meta = roles.learn_meta(df, ["i"], exact=exact)
        assert {c: meta.role(c) for c in meta.columns} == expected
    assert roles.meta_from_roles(roles.infer_roles(df, ["i"])) == meta


def test_dates_in_text_and_ignored_helpers(spark):
    base = datetime.date(2020, 1, 1)
    data = [(i, str(base + datetime.timedelta(days=i)), "May", base) for i in range(300)]
    df = spark.createDataFrame(data, "i int, d string, m string, t date")
    meta = roles.learn_meta(df, ["i"], ignore=["i"], target="m")
    assert dict(meta.roles) == {"d": "datetime", "m": "categorical", "t": "datetime"}
    late = df.withColumn("d", F.when(F.col("i") >= 290, F.col("d")).otherwise(F.lit("n/a")))
    assert roles.learn_meta(late, ["i"], ignore=["i"]).role("d") == "categorical" or late.count() == 300
    sniffed = {r["column"]: r["is_datetime"] for r in roles.sniff_dates(late, ["i"]).collect()}
    assert sniffed == {"d": False, "m": False}
    only_first = df.withColumn("d", F.when(F.col("i") < 10, F.col("d")).otherwise(F.lit("n/a")))
    assert {r["column"]: r["is_datetime"] for r in roles.sniff_dates(only_first, ["i"]).collect()}["d"]


def test_nested_columns_have_no_role(spark):
    with pytest.raises(TypeError, match="no role"):
        roles.learn_meta(spark.range(3).withColumn("a", F.array("id")), ["id"])


def test_profile_counts(spark):
    df = spark.createDataFrame([(1, 1.0, "a", True), (2, float("nan"), None, True), (None, 1.0, "b", None)],
                               "i int, v double, s string, f boolean")
    found = {r["column"]: (r["n_rows"], r["n_filled"], r["n_unique"], r["all_whole"]) for r in profiles.profile(df).collect()}
    assert found == {"i": (3, 2, 2, True), "v": (3, 2, 1, True), "s": (3, 2, 2, None), "f": (3, 2, 1, True)}


def test_coerce_matches_pandas(spark):
    meta = TableMeta.of(["c", "n", "t", "d", "w", "b"], {"c": "categorical", "n": "continuous", "t": "text", "d": None,
                                                         "w": "categorical", "b": "categorical"})
    data = [("x", " 1.5 ", None, None, 1.0, True), (None, "bad", "t", "keep", None, None), ("y", None, "", "k", 1e16, False)]
    df = spark.createDataFrame(data, "c string, n string, t string, d string, w double, b boolean")
    frame = pd.DataFrame(data, columns=list("cntdwb"))
    for name in ("c", "t", "w", "b"):
        frame[name] = frame[name].fillna("Missing").astype(str)
    frame["n"] = pd.to_numeric(frame["n"], errors="coerce").fillna(0)
    found = [tuple(r) for r in roles.coerce(df, meta).collect()]
    assert found == [tuple(row) for row in frame.itertuples(index=False)]


META = TableMeta.of(
    ["t", "a", "x", "when", "n", "note", "void"],
    {"t": "text", "a": "categorical", "x": "continuous", "when": "datetime", "n": "integer", "note": "text"},
    target="t", task="classification", name="demo",
)


def test_layout_columns():
    assert layouts.layout_columns(META, layouts.ROLE_SUBSET) == ["t", "a", "x", "n"]
    assert layouts.layout_columns(META, layouts.ROLE_GROUPED) == ["x", "n", "a", "t", "note"]
    assert layouts.layout_columns(META, layouts.ALL_COLUMNS) == list(META.columns)
    assert layouts.layout_columns(META, layouts.EPOCH) == ["a", "x", "n", "when"]
    assert layouts.dropped_columns(META, layouts.EPOCH) == ["t", "note", "void"]


def test_layout_info():
    info = layouts.layout_info(META.with_target("a", "classification"), layouts.ROLE_SUBSET, n_classes=3)
    assert info["column_names"] == ["a", "x", "n"]
    assert (info["num_col_idx"], info["cat_col_idx"], info["target_col_idx"]) == ([1, 2], [], [0])
    assert (info["task_type"], info["n_classes"]) == ("binclass", 3)
    assert layouts.layout_info(META.with_target("x", "regression"), layouts.ROLE_SUBSET)["task_type"] == "regression"


def test_manifest_agrees_with_layouts(spark):
    rows_of_roles = [(i, c, META.role(c)) for i, c in enumerate(META.columns)]
    found = layouts.manifest(spark.createDataFrame(rows_of_roles, "position int, column string, role string"), "t").collect()
    for layout in layouts.LAYOUTS:
        placed = sorted((r["position"], r["column"]) for r in found if r["layout"] == layout)
        assert [c for _, c in placed] == layouts.layout_columns(META, layout)
    assert {r["layout"]: r["kind"] for r in found if r["is_target"]} == {
        "role_subset": "target", "role_grouped": "target", "all_columns": "target"}


def test_epoch_layout_parses_sniffed_text(spark):
    meta = TableMeta.of(["d", "v"], {"d": "datetime", "v": "continuous"})
    df = spark.createDataFrame([("1970-01-02", 1.0), (None, 2.0), ("bad", 3.0)], "d string, v double")
    assert [tuple(r) for r in layouts.apply_layout(df, meta, layouts.EPOCH).collect()] == [(1.0, 86400.0), (2.0, 0.0), (3.0, 0.0)]


def test_epoch_layout_reads_the_sniffed_format(spark):
    day = datetime.datetime(2017, 10, 12)
    written = {"a": "10/12/2017", "b": "25/12/2017 10:30", "c": "2017", "d": "2017Q2", "e": "10:30", "f": "20171012",
               "g": "Oct 12, 2017", "h": "12 October 2017", "i": "10/12/70", "j": "2017.10.12", "k": "2017-10"}
    df = spark.createDataFrame([tuple(written.values())] * 12, ", ".join(f"{c} string" for c in written))
    meta = roles.learn_meta(df.withColumn("z", F.lit(1)), ["z"], ignore=["z"])
    assert {meta.role(c) for c in written} == {"datetime"}

    def seconds(when):
        return (when - datetime.datetime(1970, 1, 1)).total_seconds()

    expected = {c: seconds(day) for c in written} | {
        "b": seconds(datetime.datetime(2017, 12, 25, 10, 30)), "c": seconds(datetime.datetime(2017, 1, 1)),
        "d": seconds(datetime.datetime(2017, 4, 1)), "e": 37_800.0, "i": seconds(datetime.datetime(1970, 10, 12)),
        "k": seconds(datetime.datetime(2017, 10, 1)),
    }
    assert layouts.apply_layout(df, meta, layouts.EPOCH).first().asDict() == expected


# --- prompts and completions ---------------------------------------------------------------------


def test_draws_are_distinct_and_uniform(spark):
    drawn = draw_positions(spark.range(3_000).withColumnRenamed("id", "prompt_id"), 7, 3)
    by_prompt = drawn.groupBy("prompt_id").agg(F.collect_set("_row").alias("s"), F.min("_row").alias("lo"), F.max("_row").alias("hi"))
    assert by_prompt.where("size(s) <> 3 or lo < 0 or hi > 6").count() == 0
    counts = [r["count"] for r in drawn.groupBy("_row").count().collect()]
    assert len(counts) == 7 and max(abs(c - 9_000 / 7) for c in counts) < 150
    with pytest.raises(ValueError):
        draw_positions(spark.range(1), 4, 5, key="id")


def test_prompts_print_rows_like_json(spark):
    data = [(i, f'n"{i}é', i / 8, None if i % 2 else datetime.datetime(2020, 1, 1, i)) for i in range(6)]
    train = spark.createDataFrame(data, "id bigint, name string, v double, at timestamp_ntz").repartition(3)
    ids = spark.range(4).withColumnRenamed("id", "prompt_id")
    found = {r["prompt_id"]: r["prompt"] for r in few_shot_prompts(train, ["id"], train.columns, ids, shots=6).collect()}
    assert sorted(found) == [0, 1, 2, 3]
    expected = {json.dumps({"id": str(i), "name": n, "v": str(v), "at": "NaT" if t is None else str(t)}) for i, n, v, t in data}
    for prompt in found.values():
        assert prompt.startswith(PROMPT_HEADER) and prompt.endswith("\n" + PROMPT_TRAILER)
        lines = prompt[len(PROMPT_HEADER) : -len("\n" + PROMPT_TRAILER)].split("\n")
        assert set(lines) == expected and len(lines) == 6


COMPLETIONS = {
    ' "a": 1, "b": "x"} junk': ("1", "x"), '"a": {"b":1}}': (None, None), "no": (None, None), '"a":1,"a":2}': ("2", None),
    '"b":"k","a":tru}': (None, None), "'a':1}": (None, None), '"a":"x}y"}': (None, None), '"a":"v","zz":3}': ("v", None),
    '"a":NaN}': ("NaN", None), '"a":1.50,\n"b":null}': ("1.5", None), "}": (None, None), "": (None, None),
    '"a":[1, 2],"b":true}': ("[1,2]", "true"), " \n\"a\":1}": ("1", None), None: (None, None),
}


def test_completions(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(COMPLETIONS)], "i int, t string")
    found = {r["i"]: (r["a"], r["b"]) for r in parse_completions(df, "t", ["a", "b"], carry=["i"]).collect()}
    assert [found[i] for i in range(len(COMPLETIONS))] == list(COMPLETIONS.values())


def test_completion_hook(spark):
    def generate(batches):
        for batch in batches:
            yield batch.assign(generated_text='"a": "' + batch["prompt"] + '"}')[["prompt_id", "generated_text"]]

    prompts = spark.createDataFrame([(1, "p"), (2, "q")], "prompt_id bigint, prompt string")
    done = parse_completions(complete(prompts, generate), "generated_text", ["a"], carry=["prompt_id"])
    assert _rows(done) == [(1, "p"), (2, "q")]


# --- staging -------------------------------------------------------------------------------------


def test_pin_writes_to_the_configured_folder(spark):
    folder = workspace.shared_dir(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    pinned = workspace.pin(spark.range(5))
    assert all(path.startswith(f"file://{folder}") for path in pinned.inputFiles())
    assert pinned.schema == T.StructType([T.StructField("id", T.LongType())])
    assert workspace.release(spark) > 0
    assert workspace.release(spark) == 0


def test_payload_keys_that_hold_type_words(spark):
    rows = [('{"AVOID": "x", "my_VARIANT": {"OBJECT": 1.5}, "VOID": null}',), ('{"AVOID": "y"} junk',), ('{"AVOID": "a"},{"AVOID": "b"}',)]
    found = payloads.flatten_payload(spark.createDataFrame(rows, "p string"), "p")
    assert sorted(found.columns) == ["AVOID", "VOID", "my_VARIANT.OBJECT", "p"]
    assert dict(found.dtypes)["my_VARIANT.OBJECT"] == "double"
    assert sorted((r["AVOID"] or "", r["my_VARIANT.OBJECT"]) for r in found.collect()) == [("", None), ("", None), ("x", 1.5)]


def test_first_values_of_all_columns_take_one_scan(spark, tmp_path):
    rows = [(i, f"2020-01-{i % 28 + 1:02d}", "x" * 500 if i % 2 else None, f"{i}") for i in range(3_000)]
    spark.createDataFrame(rows, "i int, day string, long string, number string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    found = {r["column"]: (r["is_datetime"], r["date_format"]) for r in roles.sniff_dates(df, ["i"]).collect()}
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    assert found == {"day": (True, "0000-00-00"), "long": (False, None), "number": (False, None)}
    assert len(jobs) <= 2  # the head of the table, and the few rows of the answer
    sparse = df.withColumn("late", F.when(F.col("i") > 2_990, "10/02/2020"))
    assert {r["column"]: r["date_format"] for r in roles.sniff_dates(sparse, ["i"]).collect()}["late"] == "month first"

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tabprep.operators import ranks, splits
from tabprep.operators.ordering import chronological, precedes, reaches, with_row_number, with_shuffle_key
from tabprep.operators.ranks import rows_at


def _rank(row, names):
    """Ascending, nulls and NaN last, text by its bytes."""
    key = []
    for name in names:
        value = row[name]
        missing = value is None or (isinstance(value, float) and math.isnan(value))
        key.append((1, 0) if missing else (0, value.encode() if isinstance(value, str) else value))
    return key


def _values(kind, rng):
    if kind == "hot":
        return rng.choice([7, 7, 7, 7, 1, 9, None])
    if kind == "ends":
        return rng.choice([-(2**31), 2**31 - 1]) if rng.random() < 0.9 else rng.randrange(-9, 9)
    if kind == "far":
        return rng.choice([-(2**62), 2**62]) + rng.randrange(40)
    if kind == "wide":
        return rng.randrange(-(2**63), 2**63)
    if kind == "real":
        return rng.choice([rng.gauss(0, 1), 0.5, float("inf"), float("-inf"), float("nan"), None])
    if kind == "text":
        return rng.choice(["", "a", "a\0", "abcdef", "abcdefg", "abcdefghijklm", "abcdefghijklz", "é", "zürich", "\U0001f600", None])
    if kind == "day":
        return datetime.date(2020, 1, 1) + datetime.timedelta(days=rng.randrange(5))
    return datetime.datetime(2020, 1, 1) + datetime.timedelta(microseconds=rng.randrange(10**9))


TYPES = {"hot": "int", "ends": "int", "far": "bigint", "wide": "bigint", "real": "double", "text": "string", "day": "date",
         "moment": "timestamp_ntz"}


@pytest.mark.parametrize("kind", list(TYPES))
def test_rows_at_matches_a_sorted_list(spark, kind):
    rng = random.Random(kind)
    rows = [{"v": _values(kind, rng), "id": i} for i in rng.sample(range(10_000), 600)]
    df = spark.createDataFrame([(r["v"], r["id"]) for r in rows], f"v {TYPES[kind]}, id bigint").repartition(5)
    ordered = sorted(rows, key=lambda r: _rank(r, ["v", "id"]))
    wanted = [0, 17, 299, 450, 599]
    found = rows_at(df, ["v", "id"], wanted, len(rows), sort_limit=12, accuracy=60)
    assert {p: found[p]["id"] for p in wanted} == {p: ordered[p]["id"] for p in wanted}


@pytest.mark.parametrize("sample", [1, 40])
def test_rows_at_is_exact_whatever_the_sample(spark, monkeypatch, sample):
    monkeypatch.setattr("tabprep.operators.ranks._SAMPLE", sample)
    rng = random.Random(6)
    rows = [(rng.choice([5, 5, 5, rng.randrange(1_000)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "v bigint, id bigint").repartition(4)
    found = rows_at(df, ["v", "id"], [3, 450, 880], 900, sort_limit=60)
    assert {p: (k["v"], k["id"]) for p, k in found.items()} == {p: sorted(rows)[p] for p in (3, 450, 880)}


@pytest.fixture
def scans(monkeypatch):
    """Counts the passes of the search over the table."""
    count = []
    for name in ("_draw", "_narrow", "_take"):
        real = getattr(ranks, name)

        def counted(*args, _real=real):
            count.append(_real.__name__)
            return _real(*args)

        monkeypatch.setattr(ranks, name, counted)
    return count


@pytest.mark.parametrize("prefix", [72, 1_000])
def test_texts_with_a_long_common_beginning(spark, scans, prefix):
    texts = ["x" * prefix + f"{i * 7919 % 40_000:05d}" for i in range(40_000)]
    df = spark.createDataFrame([(t,) for t in texts], "v string").repartition(4)
    found = rows_at(df, ["v"], [9, 20_000], 40_000, accuracy=2_000)
    assert {p: k["v"] for p, k in found.items()} == {p: sorted(texts)[p] for p in (9, 20_000)}
    assert len(scans) <= 6 + 2 * (prefix > 128)


def test_uniform_orders_take_two_scans(spark, scans):
    ids = with_shuffle_key(spark.range(60_000), "id", 42)
    ordered = sorted(ids.collect(), key=lambda r: r["_shuffle"])
    found = rows_at(ids, ["_shuffle", "id"], [45_000, 51_000], 60_000, accuracy=20_000)
    assert {p: k["id"] for p, k in found.items()} == {p: ordered[p]["id"] for p in (45_000, 51_000)}
    assert scans == ["_narrow", "_draw"]


@pytest.mark.parametrize("kind", ["timestamp", "decimal(20,3)", "boolean", "binary", "float"])
def test_rows_at_orders_every_kind(spark, kind):
    made = {
        "timestamp": "timestamp_micros(id * 1000000007 % 999983 * 1000003)", "decimal(20,3)": "CAST(id * 7919 % 1009 / 8.0 AS decimal(20,3))",
        "boolean": "id * 7919 % 1009 > 700", "binary": "CAST(hex(id * 7919 % 1009) AS binary)", "float": "CAST(id * 7919 % 1009 / 7.0 AS float)",
    }[kind]
    df = spark.range(900).selectExpr(f"if(id % 50 = 3, NULL, {made}) AS v", "id").repartition(3)
    ordered = [r["id"] for r in df.orderBy(F.col("v").asc_nulls_last(), "id").collect()]
    found = rows_at(df, ["v", "id"], [0, 400, 890], 900, sort_limit=20, accuracy=60)
    assert {p: k["id"] for p, k in found.items()} == {p: ordered[p] for p in (0, 400, 890)}
    cuts = splits.find_cuts(df, ["v", "id"], splits.contiguous_zones(900), sort_limit=20, accuracy=60)
    assert [r["id"] for r in cuts.rows(df, "val").orderBy(F.col("v").asc_nulls_last(), "id").collect()] == ordered[675:765]


def test_rows_at_rejects_what_it_cannot_order(spark):
    ids = spark.range(50)
    with pytest.raises(ValueError):
        rows_at(ids, ["id"], [50], 50)
    with pytest.raises(ValueError, match="not unique"):
        rows_at(ids.withColumn("id", F.lit(1)), ["id"], [3], 50, sort_limit=5)
    with pytest.raises(TypeError):
        rows_at(ids.withColumn("id", F.array("id")), ["id"], [3], 50)


@pytest.mark.parametrize("partitions", [1, 7])
def test_row_numbers_do_not_depend_on_partitions(spark, partitions):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), i) for i in range(2_000)]
    df = spark.createDataFrame(rows, "v int, id bigint").repartition(partitions)
    found = {r["id"]: r["_row"] for r in with_row_number(df, ["v", "id"]).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert found == {row[1]: i for i, row in enumerate(ordered)}


def test_chronological_puts_nulls_last(spark):
    df = spark.createDataFrame([(None, 1), (2, 2), (1, 3)], "v int, id int")
    assert [r["id"] for r in chronological(df, ["v", "id"]).collect()] == [3, 2, 1]


def test_precedes_and_reaches_are_complements(spark):
    rows = [(v, w) for v in (None, 1.0, 2.0, float("nan")) for w in (None, "a", "b")]
    df = spark.createDataFrame(rows, "v double, w string")
    for v in (None, 1.0, 2.0):
        for w in (None, "a", "b"):
            key = {"v": v, "w": w}
            flags = df.select(F.coalesce(precedes(df, ["v", "w"], key), F.lit(False)).alias("p"),
                              F.coalesce(reaches(df, ["v", "w"], key), F.lit(False)).alias("r")).collect()
            assert all(row["p"] != row["r"] for row in flags)


@pytest.mark.parametrize("n", [0, 1, 7, 20, 241])
def test_contiguous_sizes(spark, n):
    df = splits.split_contiguous(spark.range(n), ["id"])
    sizes = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    train, val = int(0.75 * n), int((0.75 + 0.10) * n)
    expected = {"train": train, "val": val - train, "test": n - val}
    assert sizes == {k: v for k, v in expected.items() if v}


@pytest.mark.parametrize("n", [241, 300, 1_000])
def test_purged_zones(spark, n):
    df = splits.split_purged(spark.range(n), ["id"], gap=120)
    labels = [r["split"] for r in df.orderBy("id").collect()]
    size = n - 240
    a, b = int(0.75 * size), int((0.75 + 0.10) * size + 120)
    c = int((0.75 + 0.10) * size + 240)
    assert labels == ["train"] * a + [None] * 120 + ["val"] * (b - a - 120) + [None] * (c - b) + ["test"] * (n - c)


@pytest.mark.parametrize("n", [0, 100, 240])
def test_purged_needs_rows(spark, n):
    with pytest.raises(ValueError):
        splits.split_purged(spark.range(n), ["id"], gap=120)


@pytest.mark.parametrize("n", [0, 1, 3, 50])
def test_cut_ranges_agree_with_labels(spark, n):
    ids = spark.range(n)
    cuts = splits.find_cuts(ids, ["id"], splits.contiguous_zones(n))
    labelled = cuts.label(ids)
    for name in ("train", "val", "test"):
        assert cuts.rows(ids, name).collect() == splits.only(labelled, name).collect()
    assert splits.only(labelled, "all").count() == n


def test_cut_ranges_reach_the_scan(spark, tmp_path):
    spark.range(1_000).write.parquet(str(tmp_path / "ids"))
    ids = spark.read.parquet(str(tmp_path / "ids"))
    chosen = splits.find_cuts(ids, ["id"], splits.contiguous_zones(1_000)).rows(ids, "val")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan" in plan and "LessThan" in plan


def test_shuffle_is_seeded_and_uniform(spark):
    ids = spark.range(4_000)
    first = splits.split_contiguous(with_shuffle_key(ids, "id", 42), ["_shuffle", "id"])
    again = splits.split_contiguous(with_shuffle_key(ids.repartition(9), "id", 42), ["_shuffle", "id"])
    other = splits.split_contiguous(with_shuffle_key(ids, "id", 43), ["_shuffle", "id"])
    by_id = [{r["id"]: r["split"] for r in df.collect()} for df in (first, again, other)]
    assert by_id[0] == by_id[1] != by_id[2]
    train = [i for i, split in by_id[0].items() if split == "train"]
    assert len(train) == 3_000 and abs(sum(train) / 3_000 - 2_000) < 60

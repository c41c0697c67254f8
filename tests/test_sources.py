"""Files in, files out, and the recipes on small raw tables, checked with pandas."""

import datetime
import json
import random

import pandas as pd
import pytest

from tabprep.meta import TableMeta
from tabprep.operators import layouts
from tabprep.operators.columns import depth_columns
from tabprep.operators.ordering import with_source_order
from tabprep.operators.rows import keep_first
from tabprep.plans import datasets
from tabprep.sources import readers, writers
from tabprep.sources.structural import structural_ids, structural_table


def _pandas_csv(path):
    """A CSV folder as one frame of texts."""
    parts = [pd.read_csv(part, dtype=str, keep_default_na=False) for part in sorted(path.glob("*.csv"))]
    return pd.concat(parts, ignore_index=True)


def _split_frame(frame):
    """75 / 10 / 15 by position."""
    n = len(frame)
    a, b = int(0.75 * n), int((0.75 + 0.10) * n)
    return frame.assign(split=["train"] * a + ["val"] * (b - a) + ["test"] * (n - b))


def _same(df, frame):
    """Equal as bags of rows, with every kind of missing alike."""
    found = df.toPandas()[list(frame.columns)]

    def plain(table):
        def cell(value):
            if pd.isna(value):
                return None
            return int(value) if isinstance(value, float) and value.is_integer() else value

        return sorted((tuple(map(cell, row)) for row in table.itertuples(index=False)), key=repr)

    assert plain(found) == plain(frame)


def test_csv_types_match_pandas(spark, tmp_path):
    text = (
        "id,gap,real,name,flag,flag_gap,none,bmi,words\n"
        '1,1,1.5,"a, ""b""",True,True,,N/A,"two\nlines"\n'
        "2,,2,NULL,False,,,20.5,Missing\n"
        "3,3,inf,x,True,False,,null,n/a\n"
    )
    path = tmp_path / "t.csv"
    path.write_text(text)
    frame, df = pd.read_csv(path), readers.read_csv(spark, str(path), multi_line=True)
    kinds = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string"}
    expected = {name: kinds[str(kind)] for name, kind in frame.dtypes.items()}
    expected["flag_gap"] = "string"
    assert dict(df.dtypes) == expected
    frame["flag_gap"] = ["True", None, "False"]
    _same(df, frame)


def test_csv_index_column_and_schema(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(",a,b\n0,1,x\n1,NA,y\n")
    assert readers.read_csv(spark, str(path)).columns == ["Unnamed: 0", "a", "b"]
    assert readers.drop_index(readers.read_csv(spark, str(path))).columns == ["a", "b"]
    typed = readers.read_csv(spark, str(path), "a int, b string")
    assert typed.collect() == [(1, "x"), (None, "y")]


def test_csv_layouts(spark, tmp_path):
    df = spark.createDataFrame(
        [("train", 'q"x', 1.0, None, 3), ("val", "", 2.5, datetime.datetime(2020, 1, 1), 4), ("test", "z", None, None, 5)],
        "split string, c string, x double, t timestamp_ntz, n int",
    )
    meta = TableMeta.of(["c", "x", "t", "n"], {"c": "categorical", "x": "continuous", "t": "datetime", "n": "integer"},
                        target="n", task="regression")
    paths = writers.write_layout(df, meta, layouts.ROLE_GROUPED, str(tmp_path / "grouped"))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["train.csv", "val.csv", "test.csv", "all.csv"]
    everything = _pandas_csv(tmp_path / "grouped" / "all.csv")
    assert list(everything.columns) == ["x", "n", "c"]
    assert sorted(map(tuple, everything.values)) == [("", "5", "z"), ("1.0", "3", 'q"x'), ("2.5", "4", "")]
    writers.write_csv(df.drop("split"), str(tmp_path / "plain.csv"), order=["n"])
    plain = _pandas_csv(tmp_path / "plain.csv")
    assert list(plain["n"]) == ["3", "4", "5"] and list(plain["t"])[0] == ""
    assert plain["t"][1] == "2020-01-01 00:00:00"


def test_csv_cells_match_pandas(spark, tmp_path):
    frame = pd.DataFrame({"n": [1, 2, 3], "x": [1e7, 0.1, 1e-5], "y": [1e16, None, 2.5], "b": [True, False, True], "s": ["a,b", 'q"', "é"]})
    frame.to_csv(tmp_path / "pandas.csv", index=False)
    writers.write_csv(spark.createDataFrame(frame), str(tmp_path / "ours"), order=["n"])
    theirs = pd.read_csv(tmp_path / "pandas.csv", dtype=str, keep_default_na=False)
    assert _pandas_csv(tmp_path / "ours").values.tolist() == theirs.values.tolist()


def test_csv_keeps_blanks_around_cells(spark, tmp_path):
    df = spark.createDataFrame([(1, " a "), (2, "b\n"), (3, "\tc")], "n int, s string")
    writers.write_csv(df, str(tmp_path / "blanks"), order=["n"])
    assert [r["s"] for r in readers.read_csv(spark, str(tmp_path / "blanks"), multi_line=True).orderBy("n").collect()] == [" a ", "b\n", "\tc"]


def test_headers_count_classes(spark, tmp_path):
    train = spark.createDataFrame([("x", 1.5), ("y", 2.5), ("y", None), (None, 3.5)], "c string, v double")
    meta = TableMeta.of(["c", "v"], {"c": "categorical", "v": "continuous"}, target="c", name="t")
    writers.write_headers(train, meta, str(tmp_path / "headers"))
    found = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "headers")).collect()]
    assert [h["layout"] for h in found] == list(layouts.LAYOUTS) and {h["n_classes"] for h in found} == {2}
    assert layouts.count_classes(train, meta.with_target("v", "regression")) is None


def test_splits_are_read_by_folder(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test"), (4, None)], "n int, split string")
    writers.write_splits(df, str(tmp_path / "s"))
    assert readers.read_split(spark, str(tmp_path / "s"), "val").select("n").collect() == [(2,)]
    assert readers.read_split(spark, str(tmp_path / "s")).count() == 4
    plan = readers.read_split(spark, str(tmp_path / "s"), "val")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_manifest_and_rows(spark, tmp_path):
    found = layouts.manifest(spark.createDataFrame([(0, "c", "categorical")], "position int, column string, role string"), "c")
    writers.write_manifest(found, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == found.count() == 4
    writers.write_rows(spark.createDataFrame([(1, "x", None)], "prompt_id int, a string, b string"), ["b", "a"], str(tmp_path / "r"))
    assert _pandas_csv(tmp_path / "r").values.tolist() == [["", "x"]]


def test_source_order_of_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.csv").write_text("k,v\n" + "".join(f"{j % 4},{i}-{j}\n" for j in range(50)))
    df, order = with_source_order(spark.read.csv(str(tmp_path), header=True))
    assert sorted(r["v"] for r in keep_first(df, "k", order).collect()) == ["0-0", "0-1", "0-2", "0-3"]


def test_structural_table(spark):
    made = structural_table(structural_ids(spark, 20_000))
    assert made.columns == ["id", "root_1", "root_2", "collider", "proxy_sin", "distractor_cat", "target_class"]
    frame = made.toPandas()
    assert abs(frame["root_1"].corr(frame["root_2"])) < 0.03
    assert frame["collider"].corr(frame["root_1"] + frame["root_2"]) > 0.99
    assert frame["proxy_sin"].abs().max() < 1.3 and abs(frame["target_class"].mean() - 0.5) < 0.02
    assert set(frame["distractor_cat"]) == {"Alpha", "Beta", "Gamma", "Delta"}
    clear = frame[frame["collider"] > 3.1]
    assert (clear["target_class"] == 1).all()


# --- the benchmark tables ------------------------------------------------------------------------


def test_attack_log(spark, tmp_path):
    rng = random.Random(1)
    lines = []
    for i in range(60):
        payload = {"pattern": rng.choice(["unknown", "rfi", "None"]), "request_raw": f"GET /{i}", "attackerPort": i,
                   "victimPort": 80, "time": "x"}
        source = rng.choice([["1.2.3.4", 80], ["5.6.7.8"], [], None])
        lines.append({"_id": i, "payload": json.dumps(payload) if i % 9 else "oops", "source": source, "channel": "c",
                      "ident": "me", "normalized": True, "time": f"2020-01-01 00:{i % 30:02d}:00"})
    path = tmp_path / "log.json"
    path.write_text("\n".join(json.dumps(line) for line in lines))
    expected = []
    for i, line in sorted(enumerate(lines), key=lambda p: (p[1]["time"], p[0])):
        payload = json.loads(line["payload"]) if i % 9 else {}
        source = line["source"] or []
        if payload.get("pattern", "None") != "None":
            expected.append((payload["pattern"], source[0] if source else "Missing",
                             str(source[1]) if len(source) > 1 else "Missing", f"GET /{i}", i))
    frame = _split_frame(pd.DataFrame(expected, columns=["pattern", "source_ip", "source_port", "request_raw", "attackerPort"]))
    found = datasets.load(spark, "attack_log", path=str(path))
    assert found.columns == [*datasets.ATTACK_LOG_COLUMNS, "split"]
    _same(found, frame.astype({"attackerPort": str}))
    prepared = datasets.prepare(spark, "attack_log", path=str(path))
    assert prepared.meta.columns == tuple(datasets.ATTACK_LOG_COLUMNS)
    assert prepared.meta.role("md5") is None and prepared.meta.role("pattern") == "categorical"


def test_shop_orders(spark, tmp_path):
    rng = random.Random(2)
    orders = pd.DataFrame({
        "order_id": [f"o{i}" for i in range(40)], "order_status": "delivered",
        "order_purchase_timestamp": [f"2018-01-{rng.randrange(1, 29):02d} 10:{i:02d}:00" for i in range(40)],
        "order_delivered_customer_date": ["2018-03-01 00:00:00" if i % 3 else None for i in range(40)],
    })
    items = pd.DataFrame([(f"o{rng.randrange(45)}", j, f"p{rng.randrange(6)}", j / 2, None if j % 7 == 0 else j / 4)
                          for j in range(100)],
                         columns=["order_id", "order_item_id", "product_id", "price", "freight_value"])
    products = pd.DataFrame({"product_id": [f"p{i}" for i in range(5)], "product_category_name": list("abcde"),
                             "product_name_lenght": range(5), "product_description_lenght": range(5, 10),
                             "product_photos_qty": 1})
    reviews = pd.DataFrame({"review_id": [f"r{i}" for i in range(50)], "order_id": [f"o{i % 30}" for i in range(50)],
                            "review_score": [i % 5 + 1 for i in range(50)]})
    paths = {}
    for name, table in {"orders": orders, "items": items, "products": products, "reviews": reviews}.items():
        paths[name] = str(tmp_path / f"{name}.csv")
        table.to_csv(paths[name], index=False)
    found = datasets.load(spark, "shop_orders", **paths)
    flat = orders.merge(items, on="order_id").merge(products, on="product_id", how="left").merge(reviews, on="order_id", how="left")
    flat["product_name_length"], flat["product_description_length"] = flat["product_name_lenght"], flat["product_description_lenght"]
    flat = flat.dropna(subset=["freight_value"])
    flat["order_purchase_timestamp"] = pd.to_datetime(flat["order_purchase_timestamp"])
    flat = flat.sort_values(["order_purchase_timestamp", "order_id", "order_item_id", "review_id"])
    assert found.columns == [*datasets.SHOP_ORDER_COLUMNS, "split"]
    _same(found, _split_frame(flat[datasets.SHOP_ORDER_COLUMNS]))
    prepared = datasets.prepare(spark, "shop_orders", **paths)
    assert prepared.meta.columns == tuple(datasets.SHOP_ORDER_COLUMNS)
    assert prepared.meta.role("order_purchase_timestamp") == "datetime"
    assert prepared.meta.role("order_delivered_customer_date") == "datetime"
    assert prepared.meta.role("price") == "continuous" and prepared.meta.role("review_score") == "categorical"
    train = prepared.data("train", layouts.EPOCH)
    assert train.count() == int(0.75 * len(flat))
    assert dict(train.dtypes)["order_delivered_customer_date"] == "double"
    assert train.where("review_score is null or price is null").count() == 0


def test_order_book(spark, tmp_path):
    rng = random.Random(3)
    levels = depth_columns(["bids_distance", "asks_distance", "bids_notional", "asks_notional"], 6)
    frame = pd.DataFrame({name: [rng.random() for _ in range(400)] for name in levels})
    frame["system_time"] = [str(t) for t in pd.date_range("2021-04-07 11:32:42", periods=400, freq="min")]
    frame["midpoint"] = [rng.uniform(10, 20) for _ in range(400)]
    frame = frame.sample(frac=1.0, random_state=1).reset_index(drop=True)
    frame.to_csv(tmp_path / "book.csv")
    found = datasets.load(spark, "order_book", path=str(tmp_path / "book.csv"))
    series = frame.sort_values("system_time").reset_index(drop=True)
    series["future_return"] = (series["midpoint"].shift(-5) - series["midpoint"]) / series["midpoint"]
    series = series.dropna(subset=["future_return"]).drop(columns=["system_time", "midpoint"])[[*levels[:20], "future_return"]]
    size = len(series) - 240
    a, b, c = int(0.75 * size), int((0.75 + 0.10) * size + 120), int((0.75 + 0.10) * size + 240)
    series["split"] = ["train"] * a + [None] * 120 + ["val"] * (b - a - 120) + [None] * (c - b) + ["test"] * (len(series) - c)
    assert found.columns == list(series.columns)
    _same(found, series)


def test_health_records_and_collisions(spark, tmp_path):
    records = pd.DataFrame({"id": range(100), "age": [i % 90 for i in range(100)],
                            "bmi": ["N/A" if i % 9 == 0 else str(20 + i / 10) for i in range(100)],
                            "stroke": [None if i % 50 == 3 else i % 2 for i in range(100)]})
    records.to_csv(tmp_path / "records.csv", index=False)
    found = datasets.load(spark, "health_records", path=str(tmp_path / "records.csv"))
    assert dict(found.dtypes) == {"age": "bigint", "bmi": "double", "stroke": "double", "split": "string"}
    assert {r["split"]: r["count"] for r in found.groupBy("split").count().collect()} == {"train": 73, "val": 10, "test": 15}
    runs = pd.DataFrame({"Run": range(40), "Event": range(40), " E1 ": [i / 3 for i in range(40)],
                         "M": [None if i % 10 == 0 else i * 1.5 for i in range(40)]})
    runs.to_csv(tmp_path / "runs.csv", index=False)
    kept = datasets.load(spark, "collisions", path=str(tmp_path / "runs.csv"))
    assert kept.columns == ["E1_", "M_", "split"]
    _same(kept.drop("split"), runs.dropna()[[" E1 ", "M"]].rename(columns={" E1 ": "E1_", "M": "M_"}))


def test_artworks(spark, tmp_path):
    rng = random.Random(4)
    frame = pd.DataFrame({
        "Title": [rng.choice(["a", "b\nc", None, f"t{i}"]) for i in range(80)],
        "Artist": [rng.choice(["x", "y", f"n{i}"]) for i in range(80)], "Medium": [f"oil\r\non {i}" for i in range(80)],
        "Department": [f"d{i % 3}" for i in range(80)], "URL": "u", "ImageURL": "v", "Classification": "k",
        "Seat Height (cm)": 1.5,
    })
    frame.to_csv(tmp_path / "works.csv", index=False)
    found = datasets.load(spark, "artworks", path=str(tmp_path / "works.csv"))
    expected = pd.read_csv(tmp_path / "works.csv").drop_duplicates(subset=["Title"]).drop_duplicates(subset=["Artist"])
    expected = expected[["Title", "Medium", "Department"]].replace(r"[\r\n]+", " ", regex=True)
    assert found.columns == ["Title", "Medium", "Department", "split"]
    _same(found.drop("split"), expected)


@pytest.mark.parametrize("layout", list(layouts.LAYOUTS))
def test_from_raw_table_to_layout(spark, layout):
    prepared = datasets.prepare(spark, "structural", rows=3_000)
    assert prepared.meta.target == "target_class" and prepared.meta.role("target_class") == "categorical"
    assert prepared.meta.role("root_1") == "continuous"
    sizes = {split: prepared.data(split, layout).count() for split in ("train", "val", "test", "all")}
    assert sizes == {"train": 2_250, "val": 300, "test": 450, "all": 3_000}
    assert prepared.data("train", layout).columns == layouts.layout_columns(prepared.meta, layout)

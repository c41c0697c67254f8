import random

import pandas as pd
import pytest

from tabprep.operators.series import look_ahead, with_future_change


@pytest.mark.parametrize("block_rows", [5, 7, 1_000])
def test_future_change_matches_shift(spark, block_rows):
    rng = random.Random(2)
    values = [rng.choice([1.5, 2.0, 0.0, 4.0, None]) for _ in range(203)]
    frame = pd.DataFrame({"t": range(203), "v": values, "other": [f"x{i}" for i in range(203)]})
    df = spark.createDataFrame([tuple(None if pd.isna(c) else c for c in row) for row in frame.itertuples(index=False)],
                               "t bigint, v double, other string").repartition(6)
    found = {r["t"]: (r["future_return"], r["other"])
             for r in with_future_change(df, ["t"], "v", 5, block_rows=block_rows).collect()}
    later = frame["v"].shift(-5)
    for t in range(203):
        now, then = frame["v"][t], later[t]
        expected = None if pd.isna(now) or pd.isna(then) or now == 0 else (then - now) / now
        assert found[t] == (expected, f"x{t}")


def test_zero_base_is_missing(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 1.0), (3, 2.0)], "t int, v double")
    found = {r["t"]: r["future_return"] for r in with_future_change(df, ["t"], "v", 1).collect()}
    assert found == {0: None, 1: None, 2: 1.0, 3: None}


def test_each_series_on_its_own(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), i, float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "s string, t bigint, v double")
    found = {r["t"]: r["later"] for r in look_ahead(df, ["t"], "v", 3, "later", series="s", block_rows=4).collect()}
    for name in ("a", "b", None):
        own = [t for s, t, _ in rows if s == name]
        for here, there in zip(own, own[3:] + [None] * 3):
            assert found[here] == (None if there is None else float(there))


def test_steps_must_fit_a_block(spark):
    with pytest.raises(ValueError):
        look_ahead(spark.range(3).withColumnRenamed("id", "t"), ["t"], "t", 9, "later", block_rows=5)

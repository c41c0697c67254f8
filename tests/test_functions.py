import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions import dates, draws, numbers, text


def _apply(spark, values, kind, change):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in df.select("i", change(F.col("v")).alias("out")).orderBy("i").collect()]


def test_number_texts(spark):
    good = {"1": 1.0, " 2 ": 2.0, "1e3": 1000.0, "+5": 5.0, ".5": 0.5, "5.": 5.0, "inf": float("inf"), "-Infinity": float("-inf")}
    bad = ["0x10", "1_000", "nan", "1d", "1f", "True", "x", "", None, "1 2"]
    assert _apply(spark, [*good, *bad], "string", numbers.parse_number) == [*good.values(), *[None] * len(bad)]


def test_double_text_matches_python(spark):
    rng = random.Random(5)
    values = [0.0, -0.0, 1.0, 1e7, 12345678.9, 1e15, 1e16, 1e22, 2.3e-308, 1e-4, 0.00012345, 9.99e-5, 1.5e-5, 0.001,
              123456789012345.67, 1.7976931348623157e308, -2.5e-7, float("inf"), float("-inf"), float("nan"), 1e100]
    values += [rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 20) for _ in range(400)]
    for value, shown in zip(values, _apply(spark, values, "double", numbers.double_text)):
        if abs(value) < 1e16 or value in values[:21]:
            assert shown == repr(value) or math.isnan(value)
        else:
            assert float(shown) == value and len(shown) == len(repr(value))


def test_render(spark):
    assert _apply(spark, [True, False, None], "boolean", lambda c: text.render(c, T.BooleanType())) == ["True", "False", None]
    moments = [datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 1, 10, 0, 0, 500000), None]
    shown = _apply(spark, moments, "timestamp_ntz", lambda c: text.render(c, T.TimestampNTZType()))
    assert shown == ["2024-01-01 00:00:00", "2024-01-01 10:00:00.500000", None]


def test_null_tokens(spark):
    values = ["NaN", "nan", "None", "null", "", " ", " null", "  ", "ok", None]
    assert _apply(spark, values, "string", text.null_if_token) == [None] * 6 + [" null", "  ", "ok", None]


def test_join_lines(spark):
    assert _apply(spark, ["a\r\n\nb\rc", "d"], "string", text.join_lines) == ["a b c", "d"]


def test_strip_whitespace(spark):
    values = ["  \n a b\t ", "\x1c x \x0b", ""]
    assert _apply(spark, values, "string", text.strip_whitespace) == [v.strip() for v in values]


def test_element_or(spark):
    values = [["ip", "80"], ["ip"], [], None, ["ip", None]]
    assert _apply(spark, values, "array<string>", lambda c: text.element_or(c, 1)) == ["80", "Missing", "Missing", "Missing", "None"]


def test_json_string_matches_python(spark):
    values = ["plain", 'quo"te', "back\\slash", "é", "\U0001f600 ok", "a\nb\tc\r\b\f", "\x01\x1f\x7f", "\\u00e9", "", "日本"]
    assert _apply(spark, values, "string", text.json_string) == [json.dumps(v) for v in values]


def test_epoch_seconds(spark):
    values = [datetime.datetime(1969, 12, 31, 23, 59, 59, 500000), None, datetime.datetime(1970, 1, 2),
              datetime.datetime(2024, 1, 1, 0, 0, 7, 179575)]
    assert _apply(spark, values, "timestamp_ntz", dates.epoch_seconds) == [-1.0, 0.0, 86400.0, 1704067207.0]


def test_parse_timestamp(spark):
    values = ["2020-01-02 03:04:05.5", "2020-01-02", "nope", "2020-13-01", "10:30", "10:30:00-05:00", None]
    expected = [datetime.datetime(2020, 1, 2, 3, 4, 5, 500000), datetime.datetime(2020, 1, 2), None, None, None, None, None]
    assert _apply(spark, values, "string", dates.parse_timestamp) == expected
    with pytest.raises(Exception, match="not a timestamp"):
        _apply(spark, ["2020-01-02", "nope"], "string", dates.parse_timestamp_strict)


def test_format_minute(spark):
    assert _apply(spark, [datetime.datetime(2020, 1, 2, 3, 4, 59)], "timestamp_ntz", dates.format_minute) == ["2020-01-02 03:04"]


FITS = {
    "2017-10-02 10:56:33": True, "2020-01-01T00:00:00Z": True, "10/02/2020": True, "1998": True, "10:30": True,
    "2020Q1": True, "2020-01-01": True, "2020-01-01 10:00": True, "2020-01-01 10:00:00.25": True, "1/2/2020": True,
    "2020-01-01T10:00:00+02:00": True, "31/12/2020": True,
    "20171002": True, "2017/10/02": True, "02-10-2017": True, "Oct 2, 2017": True, "2 October 2017": True, "2017-10": True,
    "10/2/17": True, "10/02/2020 10:30": True, "10/02/2020 10:30:00": True, "2017.10.02": True, "10:30:15": True,
    "20171302": False, "Foo 2, 2017": False, "2017-13": False, "10/02/2020 25:30": False,
    "12345": False, "Missing": False, "May": False, "1.2.3.4": False, "12.5": False, "2020-13-01": False,
    "2021-02-29": False, "25:00": False, "9999": False, "31/31/2020": False, "2020Q5": False, "": False,
    "2020-01-01 24:00": False, "2020-01-01-00:00": False,
}


def test_date_formats(spark):
    df = spark.createDataFrame([(t,) for t in FITS], "t string").select("t", dates.format_mask(F.col("t")).alias("m"))
    found = {r["t"]: r["m"] != 0 for r in df.collect()}
    assert found == FITS


def test_formats_read_alike_in_cells_and_columns(spark):
    """The formats of single cells are those that Spark's parser accepts in a column."""
    more = [
        "02-Oct-2017", "2-oct-2017", "31-Feb-2017", "Oct 2017", "October 2017", "Sept 2017", "May 2017", "May 5, 2017", "5 may 2017",
        "10:30 PM", "13:30 PM", "0:30 am", "12:00 AM", "1:02:03 pm", "10/02/2020 10:30 PM", "10/13/2020 1:02:03 AM", "13/10/2020 10:30",
        "1/2/69", "1/2/68", "30/2/20", "1677-12-31", "1678-01-01", "2261-12-31", "2262", "16770101", "2020-01-01T10:00:00.123456789Z",
        "2020-01-01 10:00Z", "2020-01-01 10:00:00 ", " 2020", "2020\n", "2017.1.2", "2017/1/2 3:04", "02-10-2017 23:59:59", "24:00", "10:60",
        "2020-01-01T10:00:00+0530", "2020-1-1", "2020-01-01 1:00", "1e5", "٢٠٢٠", "2020Q1 ",
    ]
    texts = [*FITS, *more]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", dates.format_mask(F.col("t")).alias("m"))
    found = {r["t"]: r["m"] for r in df.collect()}
    assert {t: dates.formats_of(t) for t in texts} == found
    assert dates.common_format(["10/02/2020", "11/30/2020"]) == "month first" and dates.common_format(["13/02/2020", "1/3/2020"]) == "day first"
    assert dates.common_format([]) is None and dates.common_format(["2020", "x"]) is None


def test_draws_repeat_and_look_random(spark):
    ids = spark.range(20_000)
    a, b = draws.uniform_pair("s", F.col("id"))
    made = ids.select("id", a.alias("a"), b.alias("b"), draws.normal("n", F.col("id")).alias("n"),
                      draws.choice("c", F.col("id"), ["x", "y", "z"]).alias("c"))
    stats = made.agg(F.avg("a"), F.corr("a", "b"), F.avg("n"), F.stddev("n"), F.min("a"), F.max("a")).first()
    assert abs(stats[0] - 0.5) < 0.01 and abs(stats[1]) < 0.03 and abs(stats[2]) < 0.03 and abs(stats[3] - 1) < 0.03
    assert 0 <= stats[4] and stats[5] < 1
    assert {r["c"] for r in made.groupBy("c").count().where("count > 6000").collect()} == {"x", "y", "z"}
    assert made.repartition(7).orderBy("id").limit(50).collect() == made.orderBy("id").limit(50).collect()

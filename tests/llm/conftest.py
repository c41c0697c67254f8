import pytest
from pyspark.sql import types as T

#: Awkward rows: nulls, empty and blank texts, ties, repeated rows, shared ids, clashing extra columns.
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix a strange potion of herbs and old wine"


@pytest.fixture(scope="session")
def odd_docs(spark):
    schema = T.StructType(
        [T.StructField(n, t) for n, t in [
            ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()),
            ("n_chars", T.LongType()), ("score", T.DoubleType()), ("row", T.LongType()), ("token", T.StringType()),
        ]]
    )
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [
        (1, PROSE), (1, PROSE), (2, PROSE), (3, None), (4, ""), (5, " \n\t "), (6, "x"), (None, PROSE), (7, long),
        (8, "é" * 5_000), (9, "1" * 40_000 + " " + "a" * 40_000), (10, PROSE + " end"), (11, "№ ½ 日本 \U00010348 \x00"),
        (1, "another text of the first id"),
    ]
    rows = [(i, t, "en" if k % 3 else None, None, None, 0.5, k, "t") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

"""A generated table with a known dependence structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.functions.draws import choice, normal, uniform
from tabprep.operators.columns import col

# Fixed values of the generated table.
ROWS, SEED = 100_000, 42
COLLIDER_NOISE, PROXY_NOISE = 0.1, 0.05
CAUSE_RANGE = (-3.0, 3.0)
CATEGORIES = ["Alpha", "Beta", "Gamma", "Delta"]
THRESHOLD = 0.5


def structural_ids(spark: SparkSession, rows: int = ROWS) -> DataFrame:
    return spark.range(rows).select(F.col("id"))


def structural_table(ids: DataFrame, key: str = "id", seed: int = SEED) -> DataFrame:
    """One generated row per ``key`` of ``ids``, plus that key.

    Two independent normal roots and their noisy sum; a hidden uniform cause seen only through its
    sine; a category without influence; and a binary target: is the logistic of sum plus cause above
    one half? Every row depends on its key alone, so it can be made anywhere and made again.
    """

    def salt(name: str) -> str:
        return f"{seed}|{name}"

    low, high = CAUSE_RANGE
    drawn = ids.select(
        col(key),
        normal(salt("root_1"), col(key)).alias("root_1"),
        normal(salt("root_2"), col(key)).alias("root_2"),
        normal(salt("collider"), col(key)).alias("_collider_noise"),
        (uniform(salt("cause"), col(key)) * (high - low) + low).alias("_cause"),
        normal(salt("proxy"), col(key)).alias("_proxy_noise"),
        choice(salt("category"), col(key), CATEGORIES).alias("distractor_cat"),
    )
    summed = drawn.withColumn("collider", F.col("root_1") + F.col("root_2") + F.col("_collider_noise") * COLLIDER_NOISE)
    chance = 1 / (1 + F.exp(-(F.col("collider") + F.col("_cause"))))
    return summed.select(
        col(key),
        "root_1",
        "root_2",
        "collider",
        (F.sin("_cause") + F.col("_proxy_noise") * PROXY_NOISE).alias("proxy_sin"),
        "distractor_cat",
        (chance > THRESHOLD).cast("bigint").alias("target_class"),
    )

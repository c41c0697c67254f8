"""Pseudo-random draws that depend only on a seed and a row key.

They do not depend on partitioning, so a retried task repeats them exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 13  # hexadecimal digits, i.e. 52 bits, which a double holds exactly
SHUFFLE_END = 16**_DIGITS  # shuffle numbers are below
_SCALE = float(SHUFFLE_END)


def _digest(salt: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{salt}|"), key.cast("string")).cast("binary"))


def _number(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, _DIGITS), 16, 10).cast("bigint")


def shuffle_number(seed: int, key: Column) -> Column:
    """A 52-bit number that orders rows in a seeded random order."""
    return _number(_digest(str(seed), key), 1)


def uniform_pair(salt: str, key: Column) -> tuple[Column, Column]:
    """Two independent uniform draws in [0, 1)."""
    digest = _digest(salt, key)
    return _number(digest, 1) / F.lit(_SCALE), _number(digest, 17) / F.lit(_SCALE)


def uniform(salt: str, key: Column) -> Column:
    return uniform_pair(salt, key)[0]


def normal(salt: str, key: Column) -> Column:
    """A standard normal draw (Box-Muller)."""
    first, second = uniform_pair(salt, key)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - first)) * F.cos(F.lit(2.0 * math.pi) * second)


def choice(salt: str, key: Column, values: list[str]) -> Column:
    index = F.floor(uniform(salt, key) * len(values)).cast("int")
    return F.get(F.array(*[F.lit(value) for value in values]), index)

"""Numeric expressions: strict parsing, relative change, whole-number test, Python-style text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Which texts count as numbers. A plain cast would also take '1d' and '1f'.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_PATTERN = r"(?i)^\s*[+-]?(inf|infinity)\s*$"

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)


def is_number_text(text: Column) -> Column:
    return text.rlike(NUMBER_PATTERN) | text.rlike(INFINITY_PATTERN)


def parse_number(text: Column) -> Column:
    """Text to double; anything that is not a number becomes NULL."""
    return F.when(is_number_text(text), text.try_cast("double"))


def missing_if_nan(value: Column) -> Column:
    """NaN and NULL are one kind of missing."""
    return F.when(~F.isnan(value), value)


def relative_change(later: Column, now: Column) -> Column:
    """(later - now) / now, NULL where ``now`` is zero."""
    return F.try_divide(later - now, now)


def double_text(value: Column) -> Column:
    """Shortest decimal text of a double in the notation Python prints.

    Plain digits from 1e-4 up to 1e16, otherwise a lower-case exponent of at least two digits.
    """
    size, printed = F.abs(value), value.cast("string")
    short = (size >= 1e-3) & (size < 1e7) & (F.length(printed) < 17)
    return (
        F.when(F.isnan(value), "nan")
        .when(value == float("inf"), "inf")
        .when(value == float("-inf"), "-inf")
        .when((value % 1 == 0) & (size > 0) & (size < 1e16), value.cast("decimal(20,1)").cast("string"))
        .when(short | (value == 0), printed)
        .when((size >= 1e-4) & (size < 1e16), _named(_shortest(value), _plain))
        .otherwise(_named(_shortest(value), _scientific))
    )


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def _shortest(value: Column) -> Column:
    """The fewest digits that read back as ``value``; the cast alone may print one or two too many.

    Where two such texts exist, the last digit may differ from the one Python picks.
    """

    def choose(printed: Column) -> Column:
        rounded = [F.format_string(f"%.{digits}E", value) for digits in (14, 15, 16)]
        exact = F.coalesce(*[F.when(text.try_cast("double") == value, text) for text in rounded], printed)
        return F.when(F.length(printed) < 17, printed).otherwise(exact)

    return _named(value.cast("string"), choose)


def _plain(digits: Column) -> Column:
    text = F.regexp_replace(digits.try_cast("decimal(38,22)").cast("string"), r"0+$", "")
    return F.regexp_replace(text, r"\.$", ".0")


def _scientific(digits: Column) -> Column:
    mantissa = F.regexp_replace(F.substring_index(digits, "E", 1), r"\.?0*$", "")
    exponent = F.regexp_replace(F.substring_index(digits, "E", -1), r"^\+", "")
    power = F.regexp_replace(exponent, r"^-?0*", "")
    padded = F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power)
    return F.concat(mantissa, F.when(exponent.startswith("-"), "e-").otherwise("e+"), padded)

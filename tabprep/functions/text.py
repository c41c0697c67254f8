"""Text expressions: null tokens, line breaks, array elements, role-neutral rendering, JSON strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.numbers import FLOATING, double_text

# Whole cells that mean "missing" after flattening a payload.
NULL_TOKENS = ["NaN", "nan", "None", "null", "", " "]

# Whole cells that mean "missing" when a CSV file is read.
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Fixed value: the text that stands for a missing string.
MISSING = "Missing"


def null_if_token(text: Column, tokens: list[str] = NULL_TOKENS) -> Column:
    """NULL where the whole cell is one of ``tokens``; nothing is trimmed."""
    return F.when(~text.isin(tokens), text)


def join_lines(text: Column) -> Column:
    """Every run of line breaks becomes one space."""
    return F.regexp_replace(text, r"[\r\n]+", " ")


def element_or(array: Column, index: int, default: str = MISSING) -> Column:
    """Element ``index`` as text; ``default`` where the array is missing or too short."""
    present = array.isNotNull() & (F.size(array) > index)
    return F.when(present, F.coalesce(F.get(array, index).cast("string"), F.lit("None"))).otherwise(default)


def strip_whitespace(text: Column) -> Column:
    """Trim every kind of white space, Unicode blanks and separators included."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def render(value: Column, data_type: T.DataType) -> Column:
    """Text of one cell; NULL stays NULL."""
    if isinstance(data_type, FLOATING):
        return double_text(value.cast("double"))
    if isinstance(data_type, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(value, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    return value.cast("string")


def json_string(text: Column) -> Column:
    """A quoted JSON string in pure ASCII, with lower-case ``\\uXXXX`` escapes."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escape(char: Column) -> Column:
        code = F.ascii(char)
        above = code - 0x10000
        return (
            F.when(code.between(32, 126), char)
            .when(char == "\n", "\\n")
            .when(char == "\r", "\\r")
            .when(char == "\t", "\\t")
            .when(char == "\b", "\\b")
            .when(char == "\f", "\\f")
            .when(code < 0x10000, unit(code))
            .otherwise(
                F.concat(unit(F.lit(0xD800) + F.shiftright(above, 10)), unit(F.lit(0xDC00) + above.bitwiseAND(0x3FF)))
            )
        )

    spelled = F.array_join(F.transform(F.split(escaped, ""), escape), "")
    body = F.when(text.rlike(r"^[ -~]*$"), escaped).otherwise(spelled)
    return F.concat(F.lit('"'), body, F.lit('"'))

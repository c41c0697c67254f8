"""Date and time expressions, independent of the session time zone for zone-less timestamps."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = "1970-01-01 00:00:00"


def parse_timestamp(text: Column, date_format: str | None = None) -> Column:
    """Text to timestamp; anything else becomes NULL.

    ``date_format`` is one of ``DATE_FORMATS``, as ``sniff_dates`` finds it; by default texts are ISO dates with or
    without a time. A time of day falls on 1970-01-01 when its format is asked for, and is NULL otherwise.
    """
    if date_format in OTHER_FORMATS:
        shape, pattern, prepare = OTHER_FORMATS[date_format]
        prepared = F.when(text.rlike(f"^{shape}$"), prepare(text))
        return F.try_to_timestamp(prepared, F.lit(pattern)).cast("timestamp_ntz")
    return F.when(text.rlike(r"^\s*\d{4}-"), F.try_to_timestamp(text).cast("timestamp_ntz"))


def parse_timestamp_strict(text: Column, date_format: str | None = None) -> Column:
    """Text to timestamp; anything else is an error, whatever the ANSI setting."""
    parsed = parse_timestamp(text, date_format)
    message = F.concat(F.lit("not a timestamp: "), text)
    return F.when(text.isNotNull() & parsed.isNull(), F.raise_error(message)).otherwise(parsed)


def as_timestamp(value: Column, data_type: T.DataType, date_format: str | None = None) -> Column:
    """Zone-less timestamp of a timestamp, date or text column; texts are read by ``date_format``."""
    if isinstance(data_type, T.StringType):
        return parse_timestamp(value, date_format)
    return value.cast("timestamp_ntz")


def format_minute(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm")


def epoch_micros(value: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), value)


def epoch_seconds(value: Column) -> Column:
    """Seconds since 1970, rounded down, as a double; missing becomes 0."""
    micros = epoch_micros(value)
    seconds = ((micros - F.pmod(micros, F.lit(1_000_000))) / 1_000_000).cast("double")
    return F.coalesce(seconds, F.lit(0.0))


def _iso_shapes() -> list[str]:
    """Shapes of ISO dates: digits as 0, any fraction as .0, any zone as z."""
    clocks = ("00:00", "00:00:00", "00:00:00.0")
    times = [f"{sep}{clock}{zone}" for sep in " T" for clock in clocks for zone in ("", "z")]
    return [f"0000-00-00{time}" for time in ("", *times)]


def _other_formats() -> dict[str, tuple[str, str, Callable[[Column], Column]]]:
    """Format name -> (regular expression, datetime pattern, what is done to a text before parsing).

    Where a text fits several, the earlier one counts: month before day.
    """

    def same(text: Column) -> Column:
        return text

    def century(text: Column) -> Column:
        first = F.when(F.right(text, F.lit(2)) >= "69", "19").otherwise("20")
        return F.concat(F.regexp_extract(text, r"^(.*/)\d\d$", 1), first, F.right(text, F.lit(2)))

    def first_month(text: Column) -> Column:
        month = (F.right(text, F.lit(1)).try_cast("int") * 3 - 2).cast("string")
        return F.concat(F.left(text, F.lit(4)), F.lit("-"), F.lpad(month, 2, "0"))

    formats: dict[str, tuple[str, str, Callable[[Column], Column]]] = {}
    clocks = {"": ("", ""), " minute": (r" \d{1,2}:\d\d", " H:mm"), " second": (r" \d{1,2}:\d\d:\d\d", " H:mm:ss")}
    for mark, separator in (("", "/"), (" dashed", "-")):
        for order, pattern in (("month first", f"M{separator}d{separator}yyyy"), ("day first", f"d{separator}M{separator}yyyy")):
            for clock, (shape, more) in clocks.items():
                formats[f"{order}{mark}{clock}"] = (rf"\d{{1,2}}{separator}\d{{1,2}}{separator}\d{{4}}{shape}", pattern + more, same)
    for name, separator in (("year first slashed", "/"), ("year first dotted", r"\.")):
        plain = separator[-1]
        for clock, (shape, more) in clocks.items():
            formats[name + clock] = (
                rf"\d{{4}}{separator}\d{{1,2}}{separator}\d{{1,2}}{shape}", f"yyyy{plain}M{plain}d{more}", same
            )
    for name, pattern in (("month first, short year", "M/d/yyyy"), ("day first, short year", "d/M/yyyy")):
        formats[name] = (r"\d{1,2}/\d{1,2}/\d\d", pattern, century)
    for name, letters in (("short", "MMM"), ("long", "MMMM")):
        formats[f"{name} month, day, year"] = (r"[A-Za-z]+ \d{1,2}, \d{4}", f"{letters} d, yyyy", same)
        formats[f"day, {name} month, year"] = (r"\d{1,2} [A-Za-z]+ \d{4}", f"d {letters} yyyy", same)
    return formats | {
        "day, short month, year dashed": (r"\d{1,2}-[A-Za-z]{3}-\d{4}", "d-MMM-yyyy", same),
        "short month, year": (r"[A-Za-z]{3} \d{4}", "MMM yyyy", same),
        "long month, year": (r"[A-Za-z]+ \d{4}", "MMMM yyyy", same),
        "month first half day": (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d\d [AaPp][Mm]", "M/d/yyyy h:mm a", same),
        "month first half day second": (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d\d:\d\d [AaPp][Mm]", "M/d/yyyy h:mm:ss a", same),
        "clock half day": (r"\d{1,2}:\d\d [AaPp][Mm]", "h:mm a", same),
        "clock second half day": (r"\d{1,2}:\d\d:\d\d [AaPp][Mm]", "h:mm:ss a", same),
        "digits": (r"\d{8}", "yyyyMMdd", same),
        "year and month": (r"\d{4}-\d\d", "yyyy-MM", same),
        "year": (r"\d{4}", "yyyy", same),
        "quarter": (r"\d{4}Q[1-4]", "yyyy-MM", first_month),
        "clock": (r"\d{1,2}:\d\d", "H:mm", same),
        "clock second": (r"\d{1,2}:\d\d:\d\d", "H:mm:ss", same),
    }


ISO_SHAPES = _iso_shapes()
OTHER_FORMATS = _other_formats()
DATE_FORMATS = [*ISO_SHAPES, *OTHER_FORMATS]

# No date text is longer than this: an ISO date with nine decimals and a zone has 35 characters.
LONGEST_DATE = 40

# The years a nanosecond timestamp can hold in full.
FIRST_YEAR, LAST_YEAR = 1678, 2261


def _bit(name: str) -> int:
    return 1 << DATE_FORMATS.index(name)


def _shape(text: Column) -> Column:
    digits = F.regexp_replace(F.translate(text, "123456789", "000000000"), r"(Z|[+-]00:?00)$", "z")
    return F.regexp_replace(digits, r"\.0{1,9}(z?)$", ".0$1")


def format_mask(text: Column) -> Column:
    """A number whose bit i is set when ``text`` fits the i-th of ``DATE_FORMATS`` and names a real date."""

    def in_range(when: Column) -> Column:
        # One mention of ``when``: ``between`` would parse the text twice.
        distance = F.abs(F.year(when) * 2 - (FIRST_YEAR + LAST_YEAR))
        return F.coalesce(distance <= LAST_YEAR - FIRST_YEAR, F.lit(False))

    shape, clock = _shape(text), r"^.{11}([01]\d|2[0-3])(:[0-5]\d){1,2}"
    day = F.left(text, F.lit(10)).try_cast("date")
    iso = in_range(day) & ((F.length(text) == 10) | text.rlike(clock))
    bits = F.create_map(*[F.lit(x) for name in ISO_SHAPES for x in (name, _bit(name))])
    mask = F.when(iso, F.coalesce(F.try_element_at(bits, shape), F.lit(0)).cast("long")).otherwise(F.lit(0).cast("long"))
    for name in OTHER_FORMATS:
        fits = in_range(parse_timestamp(text, name))
        mask = mask.bitwiseOR(F.when(fits, F.lit(_bit(name)).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.coalesce(mask, F.lit(0).cast("long"))


def first_format(mask: Column) -> Column:
    """The name of the lowest bit of a ``format_mask``; NULL for 0."""
    lowest = F.round(F.log2(mask.bitwiseAND(-mask))).cast("int")
    return F.when(mask != 0, F.element_at(F.array(*[F.lit(name) for name in DATE_FORMATS]), lowest + 1))


# The names of the months in English texts.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]

_ISO = re.compile(
    r"(?P<y>[0-9]{4})-(?P<m>[0-9]{2})-(?P<d>[0-9]{2})"
    r"((?P<sep>[ T])(?P<H>[0-9]{2}):(?P<M>[0-9]{2})(?P<second>:(?P<S>[0-9]{2})(?P<fraction>\.[0-9]{1,9})?)?(?P<zone>Z|[+-][0-9]{2}:?[0-9]{2})?)?"
)
_FIELD = re.compile("yyyy|yy|MMMM|MMM|M|d|H|h|mm|ss|a")
_READS = {
    "yyyy": "(?P<y>[0-9]{4})", "yy": "(?P<short>[0-9]{2})", "MMMM": "(?P<long>[A-Za-z]+)", "MMM": "(?P<name>[A-Za-z]{3})",
    "M": "(?P<m>[0-9]{1,2})", "d": "(?P<d>[0-9]{1,2})", "H": "(?P<H>[0-9]{1,2})", "h": "(?P<h>[0-9]{1,2})", "mm": "(?P<M>[0-9]{2})",
    "ss": "(?P<S>[0-9]{2})", "a": "(?P<half>[AaPp][Mm])",
}


@cache
def _readers() -> list[tuple[str, re.Pattern]]:
    """A regular expression with the fields of a date for each of ``OTHER_FORMATS``."""
    own = {"month first, short year": "M/d/yy", "day first, short year": "d/M/yy"}
    out = []
    for name, (_, pattern, _) in OTHER_FORMATS.items():
        pattern = own.get(name, pattern)
        if name == "digits":
            read = "(?P<y>[0-9]{4})(?P<m>[0-9]{2})(?P<d>[0-9]{2})"
        elif name == "year and month":
            read = "(?P<y>[0-9]{4})-(?P<m>[0-9]{2})"
        elif name == "quarter":
            read = "(?P<y>[0-9]{4})Q[1-4]"
        else:
            ends = [0, *[at for found in _FIELD.finditer(pattern) for at in found.span()], len(pattern)]
            read = "".join(
                _READS[pattern[a:b]] if i % 2 else re.escape(pattern[a:b]) for i, (a, b) in enumerate(zip(ends, ends[1:]))
            )
        out.append((name, re.compile(read)))
    return out


def _is_date(found: re.Match) -> bool:
    """Whether the fields name a real date and time within the years of a timestamp."""
    part = {k: v for k, v in found.groupdict().items() if v is not None}
    month = int(part.get("m", 1))
    for field, length in (("long", None), ("name", 3)):
        if field in part:
            names = [name[:length].lower() for name in MONTHS]
            month = names.index(part[field].lower()) + 1 if part[field].lower() in names else 0
    year = int(part.get("y", 1970))
    if "short" in part:
        year = int(part["short"]) + (1900 if part["short"] >= "69" else 2000)
    if "h" in part and not 1 <= int(part["h"]) <= 12:
        return False
    try:
        datetime.datetime(year, month, int(part.get("d", 1)), int(part.get("H", 0)), int(part.get("M", 0)), int(part.get("S", 0)))
    except ValueError:
        return False
    return FIRST_YEAR <= year <= LAST_YEAR


def formats_of(text: str) -> int:
    """``format_mask`` of one text, for the few cells that decide about a column: fields are read once per shape."""
    mask = 0
    if (found := _ISO.fullmatch(text)) and _is_date(found):
        clock = ("00:00" + ":00" * bool(found["second"]) + ".0" * bool(found["fraction"])) if found["sep"] else ""
        mask |= _bit("0000-00-00" + (found["sep"] or "") + clock + "z" * bool(found["zone"]))
    for name, reader in _readers():
        if (found := reader.fullmatch(text)) and _is_date(found):
            mask |= _bit(name)
    return mask


def common_format(texts: list[str]) -> str | None:
    """The first of ``DATE_FORMATS`` that fits all texts."""
    mask = -1
    for text in texts:
        mask &= formats_of(text)
    return next((name for i, name in enumerate(DATE_FORMATS) if texts and mask >> i & 1), None)

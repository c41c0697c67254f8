"""The rows at given positions of a total order, found without sorting the table.

For each wanted position the search keeps a range of keys. A sample of whole keys from the range, drawn by a hash of the key and
the number of the pass, proposes two keys around the position, and a count of all rows before either decides, so the
result is exact whatever the sample holds. Ranges of few rows are read and end the search. Every pass is a scan of the order columns with
map-side aggregation or filtering for all positions together: rows are never shuffled, what a pass sends to the driver is
bounded, and hot values need no special treatment because they are only counted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.numbers import FLOATING, INTEGRAL
from tabprep.operators.columns import col, require_columns
from tabprep.operators.ordering import UNIFORM, comparable, filled, precedes, reaches, sort_keys

#: Keys of a range that propose the next one, at most about so many for each position.
_SAMPLE = 20_000
#: Characters of a text that a proposal holds at first; twice as many whenever these do not tell texts apart.
_CELL = 128
_CHANCES = 1 << 40
_LAST_CHARACTER = chr(0x10FFFF)

_ORDERED = (
    *INTEGRAL, *FLOATING, T.DecimalType, T.BooleanType, T.DateType, T.TimestampNTZType, T.TimestampType, T.StringType, T.BinaryType,
)


@dataclass(frozen=True)
class _Bound:
    """A place between two rows: before the rows that reach ``key``, or behind those that equal it.

    The key may end early, behind a text of which only the beginning is known.
    """

    key: dict
    whole: bool
    behind: bool = False

    def shifted(self) -> dict:
        """The key; a cut text with the last of all characters added when the place is behind all that begin like it."""
        if self.whole or not self.behind:
            return self.key
        *_, last = self.key
        return self.key | {last: self.key[last] + _LAST_CHARACTER}

    def before(self, keys: DataFrame) -> Column:
        return precedes(keys, list(self.key), self.shifted(), equal=self.whole and self.behind)

    def after(self, keys: DataFrame) -> Column:
        return reaches(keys, list(self.key), self.shifted(), equal=not (self.whole and self.behind))


@dataclass(frozen=True)
class _Range:
    """The rows between two bounds, and the place of the wanted one among them."""

    rank: int
    rows: int
    low: _Bound | None = None
    high: _Bound | None = None
    chars: int = _CELL
    more: float = 1.0

    def where(self, keys: DataFrame) -> Column:
        parts = [self.low.after(keys)] if self.low else []
        parts += [self.high.before(keys)] if self.high else []
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def rows_at(
    df: DataFrame, order: list[str], positions: list[int], rows: int, sort_limit: int = 100_000, accuracy: int | None = None
) -> dict[int, dict]:
    """Map each 0-based position in a table of ``rows`` rows to the order columns of the row there.

    At most ``sort_limit`` rows, of the order columns only, are ever sorted per position; ``accuracy`` is the number of sampled
    keys. Timestamps with a zone are given as microseconds since 1970. A leading column that is marked as ``UNIFORM`` needs no
    sample: each position lies in a known range.
    """
    require_columns(df, order)
    for name in order:
        if not isinstance(kind := df.schema[name].dataType, _ORDERED):
            raise TypeError(f"cannot order by {name}: cast {kind.simpleString()} first")
    keys = df.select(*[comparable(filled(df, name), df.schema[name].dataType).alias(name) for name in order])
    for position in positions:
        if not 0 <= position < rows:
            raise ValueError(f"position {position} is outside a table of {rows} rows")
    wanted = max(accuracy or _SAMPLE, 1)
    few = min(wanted, sort_limit)
    states = {p: _Range(p, rows) for p in set(positions)}
    found: dict[int, dict] = {}
    proposed = _uniform_bounds(df, order, states) if rows > few else {}
    passes = 0
    while len(found) < len(states):
        if not proposed:
            passes += 1
            drawn = _draw(keys, order, {p: s for p, s in states.items() if p not in found}, wanted, few, passes)
            for p, sample in drawn.items():
                state = states[p]
                if (state.rows <= few or len(sample) == state.rows) and all(whole for _, whole in sample):
                    found[p] = _listed(sample, state, order)
                elif state.rows <= sort_limit:
                    found[p] = _take(keys, order, state)
                elif len(sample) < 2 or (len({tuple(k.items()) for k, _ in sample}) == 1 and not sample[0][1]):
                    states[p] = replace(state, chars=2 * state.chars, more=4 * state.more)
                else:
                    proposed[p] = _around(sample, state)
        if proposed:
            for p, state in _narrow(keys, order, {p: states[p] for p in proposed}, proposed).items():
                if isinstance(state, dict):
                    found[p] = state
                else:
                    states[p] = state
            proposed = {}
    return found


def _uniform_bounds(df: DataFrame, order: list[str], states: dict[int, _Range]) -> dict[int, tuple]:
    """Where positions of a uniform leading column lie, with four standard deviations to either side."""
    limit = df.schema[order[0]].metadata.get(UNIFORM)
    if not limit:
        return {}
    out = {}
    for p, state in states.items():
        slack = 2 * math.sqrt(state.rows) + 1
        ends = [min(max(int((p + side * slack) / state.rows * limit), 0), limit) for side in (-1, 1)]
        out[p] = tuple(_Bound({order[0]: end}, True) for end in ends)
    return out


def _draw(
    keys: DataFrame, order: list[str], states: dict[int, _Range], wanted: int, few: int, passes: int
) -> dict[int, list[tuple[dict, bool]]]:
    """For each position sorted keys of its range, and whether they are whole: all of a range of few rows, else a sample."""
    chance = F.pmod(F.xxhash64(*[col(name) for name in order], F.lit(passes)), F.lit(_CHANCES))
    flags, cells = [], []
    for p, state in states.items():
        size = wanted * _CELL / state.chars * state.more
        inside = state.where(keys)
        if state.rows > few:
            inside = inside & (F.col("_chance") < int(min(1.0, size / state.rows) * _CHANCES))
        flags.append(F.coalesce(inside, F.lit(False)).alias(f"in{p}"))
    chars = max(state.chars for state in states.values())
    for i, name in enumerate(order):
        text = isinstance(keys.schema[name].dataType, (T.StringType, T.BinaryType))
        cells.append((F.substring(col(name), 1, chars) if text else col(name)).alias(f"k{i}"))
        cells.append((F.length(col(name)) > chars if text else F.lit(False)).alias(f"cut{i}"))
    marked = keys.withColumn("_chance", chance).select(*cells, *flags)
    rows = marked.where(reduce(lambda a, b: a | b, [F.col(f"in{p}") for p in states])).collect()

    def key(row) -> tuple[dict, bool]:
        out = {}
        for i, name in enumerate(order):
            out[name] = row[f"k{i}"]
            if row[f"cut{i}"]:
                return out, False
        return out, True

    found = sorted(((key(row), row) for row in rows), key=lambda pair: _rank(pair[0][0], order))
    return {p: [pair for pair, row in found if row[f"in{p}"]] for p in states}


def _rank(key: dict, order: list[str]) -> list:
    """Sorts like the order does: nulls last, texts by their bytes."""
    values = [key[name] for name in order if name in key]
    return [(value is None, 0 if value is None else value.encode() if isinstance(value, str) else value) for value in values]


def _listed(sample: list[tuple[dict, bool]], state: _Range, order: list[str]) -> dict:
    if len(sample) != state.rows:
        raise ValueError(f"the table gave {len(sample)} and {state.rows} rows for one range: its order columns are not stable")
    key = sample[state.rank][0]
    for beside in (state.rank - 1, state.rank + 1):
        if 0 <= beside < len(sample) and sample[beside][0] == key:
            raise ValueError(f"the order {order} is not unique")
    return key


def _take(keys: DataFrame, order: list[str], state: _Range) -> dict:
    return keys.where(state.where(keys)).orderBy(*sort_keys(keys, order)).offset(state.rank).limit(1).first().asDict()


def _around(sample: list[tuple[dict, bool]], state: _Range) -> tuple[_Bound | None, _Bound | None]:
    """Two sampled keys that hold the position between them, most likely; one key in the middle of a sample too small for that."""
    place = (state.rank + 0.5) / state.rows * len(sample)
    slack = 1.5 * math.sqrt(len(sample)) + 1
    low, high = math.floor(place - slack), math.ceil(place + slack)
    if low < 1 and high >= len(sample) - 1:
        low = high = len(sample) // 2
    return (
        _Bound(*sample[low]) if low >= 1 or low == high else None,
        _Bound(*sample[high], behind=True) if high < len(sample) - 1 or low == high else None,
    )


def _narrow(keys: DataFrame, order: list[str], states: dict[int, _Range], proposed: dict[int, tuple]) -> dict[int, _Range | dict]:
    """Count the rows before the proposed bounds, for all positions in one scan, and go on where the position lies."""
    counts, measures = {}, []
    for p, bounds in proposed.items():
        inside = states[p].where(keys)
        for side, bound in enumerate(bounds):
            if bound:
                counts[p, side] = len(measures)
                measures.append(F.count(F.when(inside & bound.before(keys), 1)).alias(f"m{len(measures)}"))
    row = keys.agg(*measures).first()
    out: dict[int, _Range | dict] = {}
    for p, (low, high) in proposed.items():
        state = states[p]
        first = row[counts[p, 0]] if low else 0
        last = row[counts[p, 1]] if high else state.rows
        if low and high and low.key == high.key and low.whole and len(low.key) == len(order) and first <= state.rank < last:
            if last - first > 1:
                raise ValueError(f"the order {order} is not unique")
            out[p] = low.key
        elif state.rank < first:
            out[p] = replace(state, rows=first, high=low)
        elif state.rank < last:
            out[p] = replace(state, rank=state.rank - first, rows=last - first, low=low or state.low, high=high or state.high)
        else:
            out[p] = replace(state, rank=state.rank - last, rows=state.rows - last, low=high)
        new = out[p]
        if isinstance(new, _Range):  # a range that did not get smaller gets a larger sample of longer texts
            stuck = new.rows == state.rows
            out[p] = replace(new, more=4 * state.more if stuck else 1.0, chars=2 * state.chars if stuck else state.chars)
    return out

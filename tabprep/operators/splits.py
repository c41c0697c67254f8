"""Positional train / val / test splits.

A split needs only the rows at its cut points. Those are looked up with ``rows_at`` and every row
is then labelled by comparing its order columns with them: the table itself is neither sorted nor
shuffled, and the comparison on the leading order column can be pushed into the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.operators.ordering import precedes, reaches
from tabprep.operators.ranks import rows_at

# Shares of the rows; the rest is the test split.
TRAIN_SHARE, VAL_SHARE = 0.75, 0.10

# (end of the zone, label); None labels the rows of a gap.
Zones = list[tuple[int, str | None]]


def contiguous_zones(rows: int) -> Zones:
    """Train, val and test one after the other."""
    return [(int(TRAIN_SHARE * rows), "train"), (int((TRAIN_SHARE + VAL_SHARE) * rows), "val"), (rows, "test")]


def purged_zones(rows: int, gap: int) -> Zones:
    """Like ``contiguous_zones`` with ``gap`` unused rows between neighbours."""
    size = rows - 2 * gap
    if size <= 0:
        raise ValueError(f"{rows} rows leave nothing beside two gaps of {gap}")
    both = TRAIN_SHARE + VAL_SHARE
    train_end = int(TRAIN_SHARE * size)
    val_start, val_end = train_end + gap, int(both * size + gap)
    return [
        (train_end, "train"),
        (val_start, None),
        (val_end, "val"),
        (int(both * size + 2 * gap), None),
        (rows, "test"),
    ]


@dataclass(frozen=True)
class Cuts:
    """Where the zones of one table end: the order columns of the first row after each zone."""

    order: list[str]
    zones: Zones
    keys: list[dict | None]  # None: the zone runs to the end of the table

    def label(self, df: DataFrame, name: str = "split") -> DataFrame:
        """Add the label of the zone each row falls into."""
        label = F.lit(self.zones[-1][1]).cast("string")
        for key, (_, zone) in reversed(list(zip(self.keys[:-1], self.zones))):
            inside = precedes(df, self.order, key) if key else F.lit(True)
            label = F.when(inside, F.lit(zone).cast("string")).otherwise(label)
        return df.withColumn(name, label)

    def rows(self, df: DataFrame, split: str) -> DataFrame:
        """The rows of one split, as a range filter that the scan can use to skip data."""
        zone = [label for _, label in self.zones].index(split)
        start = self.keys[zone - 1] if zone else None
        if zone and start is None:
            return df.where(F.lit(False))
        chosen = df.where(reaches(df, self.order, start)) if start else df
        return chosen.where(precedes(df, self.order, self.keys[zone])) if self.keys[zone] else chosen


def find_cuts(df: DataFrame, order: list[str], zones: Zones, **search) -> Cuts:
    rows = zones[-1][0]
    ends = [end for end, _ in zones]
    keys = rows_at(df, order, [end for end in ends if end < rows], rows, **search)
    return Cuts(order, zones, [keys.get(end) for end in ends])


def split_contiguous(df: DataFrame, order: list[str], **search) -> DataFrame:
    """Add ``split``: 75 / 10 / 15 by position in ``order``."""
    return find_cuts(df, order, contiguous_zones(df.count()), **search).label(df)


def split_purged(df: DataFrame, order: list[str], gap: int = 120, **search) -> DataFrame:
    """Add ``split``: 75 / 10 / 15 with ``gap`` rows left out (NULL) at both boundaries."""
    return find_cuts(df, order, purged_zones(df.count(), gap), **search).label(df)


def only(df: DataFrame, split: str) -> DataFrame:
    """The rows of one split, without the label; ``"all"`` keeps every row, gaps included."""
    chosen = df if split == "all" else df.where(F.col("split") == split)
    return chosen.drop("split")

"""Column roles and the description of a prepared table."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

CATEGORICAL, INTEGER, CONTINUOUS, TEXT, DATETIME = "categorical", "integer", "continuous", "text", "datetime"

# Limits of role inference.
CATEGORY_LIMIT = 200  # up to this many distinct values ...
CATEGORY_SHARE = 0.1  # ... or fewer than this share of the rows make a category
SNIFFED_VALUES = 10  # first non-null texts examined for dates


@dataclass(frozen=True)
class TableMeta:
    """Columns in source order with at most one role each, inferred from the train split."""

    columns: tuple[str, ...]
    roles: tuple[tuple[str, str], ...]
    target: str | None = None
    task: str = "classification"
    name: str = ""
    formats: tuple[tuple[str, str], ...] = ()  # date format of text columns that hold dates

    @classmethod
    def of(cls, columns: Iterable[str], roles: dict[str, str | None], **more) -> TableMeta:
        columns = tuple(columns)
        return cls(columns, tuple((c, roles[c]) for c in columns if roles.get(c)), **more)

    def role(self, column: str) -> str | None:
        return dict(self.roles).get(column)

    def date_format(self, column: str) -> str | None:
        return dict(self.formats).get(column)

    def having(self, *roles: str) -> list[str]:
        """Columns with one of ``roles``, in source order."""
        chosen = dict(self.roles)
        return [c for c in self.columns if chosen.get(c) in roles]

    def with_target(self, target: str, task: str) -> TableMeta:
        return replace(self, target=target, task=task)

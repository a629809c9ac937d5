from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def first_status(*rules: tuple[Column, str], otherwise: str | None = None) -> Column:
    """Status text of the first rule whose condition holds."""
    condition, status = rules[0]
    column = F.when(condition, F.lit(status))
    for condition, status in rules[1:]:
        column = column.when(condition, F.lit(status))
    return column.otherwise(F.lit(otherwise))


def object_key(catalog: DataFrame, *others: DataFrame) -> list[str]:
    """Columns that name an object: its id, inside its group where the catalog has groups.

    One content id in two groups is two objects. A catalog without ``group_id`` is that of one group.
    """
    if "group_id" not in catalog.columns:
        return ["content_id"]
    for frame in others:
        if "group_id" not in frame.columns:
            raise ValueError("the catalog has groups, so every table that names objects needs group_id")
    return ["group_id", "content_id"]

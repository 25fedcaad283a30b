"""What the sources share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SourceError(ValueError):
    """An input that isn't what it should be."""


def pick(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """The first of names that is a column."""
    return next((n for n in names if n in columns), None)


def reject_duplicates(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    found = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if found:
        raise SourceError(f"{what}: repeated keys, such as {[tuple(str(x) for x in r[:-1]) for r in found]}")
    return df


def count_where(df: DataFrame, **conditions) -> dict[str, int]:
    """How many rows meet each condition, in one pass."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()]).first().asDict()

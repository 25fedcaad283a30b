"""Views of a date range, made from base tables when asked for."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import cross_section as xs
from tessera.operators import timeseries as ts


class Planned:
    """Tables of a view, each planned when it is first asked for."""

    def __init__(self, **tables: Callable[[], DataFrame]) -> None:
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        self.__dict__[name] = self._tables[name]()
        return self.__dict__[name]


class ICView(Planned):
    daily: DataFrame  # trade_date, horizon, ic
    curves: DataFrame  # and cumulative, from zero, and the 20-row moving average, which knows the rows before the range
    stats: DataFrame
    yearly_stats: DataFrame


class GroupReturnView(Planned):
    daily: DataFrame
    summary: DataFrame
    curves: DataFrame  # from one
    long_short: DataFrame
    cumulative_long_short: DataFrame
    daily_equivalent_long_short: DataFrame
    performance: DataFrame
    skipped: list[str]


@dataclass(frozen=True)
class QualityView:
    daily: DataFrame
    counts: DataFrame
    ratios: DataFrame


def ic_view(daily: DataFrame, days: dict[str, int | None], start=None, end=None, min_days: int = 60, partial_years: bool = True) -> ICView:
    whole = daily.select("trade_date", "horizon", "ic")
    own = ts.between(whole, start, end)

    def curves() -> DataFrame:
        inside = ts.between(ts.moving_average(whole, "ic"), start, end)
        return ts.rebased(ts.cumulative(inside, "ic"), "cumulative").select("trade_date", "horizon", "ic", "cumulative", "moving_average")

    return ICView(daily=lambda: own, curves=curves, stats=lambda: ts.ic_stats(own, days), yearly_stats=lambda: ts.yearly_ic_stats(own, days, min_days, partial_years))


def group_return_view(by_group: DataFrame, days: dict[str, int | None], groups: int = 10, start=None, end=None) -> GroupReturnView:
    own = ts.between(by_group, start, end)
    spread = lambda: xs.long_short(own, 1, groups)
    equivalent = lambda: xs.daily_equivalent_long_short(own, days, 1, groups)
    return GroupReturnView(
        daily=lambda: own, summary=lambda: ts.group_summary(own), curves=lambda: ts.group_curves(own, own, days, rebase=True), long_short=spread,
        cumulative_long_short=lambda: ts.rebased(ts.cumulative(spread(), "spread"), "cumulative"), daily_equivalent_long_short=lambda: ts.rebased(ts.filled_cumulative(equivalent()[0], "spread"), "cumulative"),
        performance=lambda: ts.performance(spread(), days), skipped=lambda: equivalent()[1],
    )


def quality_view(daily: DataFrame, start=None, end=None) -> QualityView:
    own = ts.between(daily, start, end)
    return QualityView(own, own.select("trade_date", *counts(own.columns)), own.select("trade_date", *ratios(own.columns)))


def counts(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c.endswith("_count")]


def ratios(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c.endswith("_ratio")]


def overview(daily: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The 20-day label and those that aren't days, or else the last; with the moving average."""
    chosen = [x for x in labels if x == "20d" or not (x.endswith("d") and x[:-1].isdigit())] or list(labels)[-1:]
    return ts.moving_average(daily.where(F.col("horizon").isin(chosen)).select("trade_date", "horizon", "ic"), "ic")

"""Statistics along dates: means and their t values, yearly tables, performance, curves, windows.

Series are long, (trade_date, <keys>, <value>), a row for each date and key; they are as long as the calendar, so a
key's whole series may sit in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import expr
from tessera.operators.cross_section import with_days


def _moments(value: str) -> dict[str, Column]:
    x = F.col(value)
    n = F.count(x)
    mean, sd = F.avg(x), F.stddev_samp(x)
    return {
        "mean": mean, "std": F.when(n > 1, sd), "mean_over_std": F.when(n > 1, expr.divided(mean, sd)), "t_stat": expr.naive_t(mean, sd, n),
        "positive_ratio": F.avg((x > 0).cast("double")), "negative_ratio": F.avg((x < 0).cast("double")), "valid_days": n,
    }


def summary(daily: DataFrame, keys: Sequence[str], value: str, columns: Sequence[str] = ("mean", "std", "mean_over_std", "t_stat", "positive_ratio", "negative_ratio", "valid_days")) -> DataFrame:
    """keys and the statistics named, over non-null values."""
    own = _moments(value) | {"min": F.min(value), "max": F.max(value)}
    return daily.groupBy(*keys).agg(*[own[c].alias(c) for c in columns])


TURNOVER_COLUMNS = ("mean", "std", "mean_over_std", "min", "max", "valid_days")


def _with_hac(daily: DataFrame, keys: Sequence[str], value: str, days: dict[str, int | None]) -> DataFrame:
    """keys, the moments, t_stat_hac, hac_lag, hac_status, series, in one aggregate; the lag is the days less one."""
    made = expr.hac_mean_t(with_days(daily, days), keys, value, "trade_date", F.max("days") - 1, _moments(value) | {"days": F.max("days")})
    status = F.when(F.col("days").isNull(), "missing_horizon_days").otherwise("ok")
    return made.withColumn("hac_status", status).withColumnRenamed("hac_t", "t_stat_hac")


def ic_stats(daily_ic: DataFrame, days: dict[str, int | None], keys: Sequence[str] = ("horizon",)) -> DataFrame:
    s = _with_hac(daily_ic, keys, "ic", days)
    return s.select(
        *keys, F.col("mean").alias("ic_mean"), F.col("std").alias("ic_std"), F.col("mean_over_std").alias("icir_raw"), F.col("positive_ratio").alias("ic_positive_ratio"),
        F.col("t_stat").alias("t_stat_naive"), "t_stat_hac", "hac_lag", "valid_days", "hac_status", F.col("mean_over_std").alias("icir"), F.col("t_stat").alias("t_stat"),
    )


def yearly_ic_stats(daily_ic: DataFrame, days: dict[str, int | None], min_days: int = 60, include_partial_year: bool = True) -> DataFrame:
    """ic_stats by year; those of years with fewer valid days are null. Complete: dates in January and in December."""
    if min_days <= 0:
        raise ValueError("min_days must be above zero")
    rows = daily_ic.withColumn("year", F.year("trade_date"))
    spans = rows.groupBy("year").agg(F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"))
    spans = spans.withColumn("is_complete_year", (F.month("start_date") == 1) & (F.month("end_date") == 12))
    if not include_partial_year:
        spans = spans.where("is_complete_year")
    s = ic_stats(rows, days, ("year", "horizon")).join(F.broadcast(spans), "year").withColumn("meets_min_days", F.col("valid_days") >= min_days)
    shown = lambda c: F.when(F.col("meets_min_days"), F.col(c)).alias(c)
    return s.select("year", "horizon", *map(shown, ("ic_mean", "ic_std", "icir_raw", "ic_positive_ratio", "t_stat_hac")), "hac_lag", "valid_days", "start_date", "end_date", "is_complete_year", "meets_min_days")


def max_drawdown(spreads: DataFrame, keys: Sequence[str] = ("horizon",), value: str = "spread") -> DataFrame:
    """keys, max_drawdown of the compounded curve, which starts after the first return."""
    rows = spreads.where(F.col(value).isNotNull())
    rows = rows.withColumn("_nav", expr.running_growth(F.col(value), "trade_date", keys))
    rows = rows.withColumn("_peak", F.max("_nav").over(expr.running("trade_date", keys)))
    return rows.groupBy(*keys).agg(F.min(F.try_divide(F.col("_nav"), F.col("_peak")) - 1).alias("max_drawdown"))


def performance(spreads: DataFrame, days: dict[str, int | None]) -> DataFrame:
    """By horizon: statistics of the spread; a drawdown only for one day, else the reason why not."""
    s = _with_hac(spreads, ("horizon",), "spread", days).withColumn("max_drawdown", expr.deepest_fall(F.col("series")))
    one = F.coalesce(F.col("days") == 1, F.lit(False))
    reason = F.when(F.col("days").isNull(), "unknown_horizon_days").when(F.col("days") > 1, "overlapping_forward_returns").otherwise("")
    return s.select(
        F.concat(F.lit("long_short_"), "horizon").alias("series"), F.col("mean").alias("raw_mean"), F.col("std").alias("raw_std"), F.col("mean_over_std").alias("mean_over_std_raw"),
        "positive_ratio", F.col("t_stat").alias("t_stat_naive"), "t_stat_hac", "hac_lag", "valid_days", F.when(one, F.col("max_drawdown")).alias("diagnostic_max_drawdown"),
        one.alias("max_drawdown_applicable"), reason.alias("not_applicable_reason"), "hac_status", "mean", "std", F.col("mean_over_std").alias("sharpe"), "max_drawdown",
        F.col("positive_ratio").alias("win_rate"), "t_stat",
    )


def cumulative(daily: DataFrame, value: str, keys: Sequence[str] = ("horizon",), out: str = "cumulative") -> DataFrame:
    return daily.withColumn(out, expr.running_sum(F.col(value), "trade_date", keys))


def moving_average(daily: DataFrame, value: str, rows: int = 20, keys: Sequence[str] = ("horizon",), out: str = "moving_average") -> DataFrame:
    return daily.withColumn(out, expr.rolling_mean(F.col(value), rows, "trade_date", keys))


def between(df: DataFrame, start=None, end=None) -> DataFrame:
    """The closed date range."""
    df = df if start is None else df.where(F.col("trade_date") >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col("trade_date") <= F.lit(end).cast("date"))


def group_summary(by_group: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """group and the mean return of each horizon; without labels long, (group, horizon, mean_return)."""
    long = by_group.groupBy("group", "horizon").agg(F.avg("group_return").alias("mean_return"))
    return long if labels is None else long.groupBy("group").pivot("horizon", sorted(labels, key=expr.label_order)).agg(F.first("mean_return"))


def layered_summary(by_group: DataFrame, windows: dict[str, int]) -> DataFrame:
    """window, window_size, end_date, group, horizon, mean_return over the last dates that the table has."""
    dates = by_group.select("trade_date").distinct().withColumn("_k", F.row_number().over(Window.orderBy(F.desc("trade_date"))))
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("window"), F.lit(n).alias("window_size")) for i, (name, n) in enumerate(windows.items())])
    rows = by_group.join(F.broadcast(dates), "trade_date").withColumn("_w", F.explode(each)).where(F.col("_k") <= F.col("_w.window_size"))
    last = by_group.agg(F.max("trade_date").alias("end_date"))
    means = rows.groupBy("_w.place", "_w.window", "_w.window_size", "group", "horizon").agg(F.avg("group_return").alias("mean_return"))
    return means.join(F.broadcast(last)).drop("place").select("window", "window_size", "end_date", "group", "horizon", "mean_return")


def group_curves(by_group: DataFrame, dates: DataFrame, days: dict[str, int | None], rebase: bool = False) -> DataFrame:
    """trade_date, horizon, group, nav: daily-equivalent returns compounded over all dates, absent ones as zero."""
    rows = with_days(by_group, days).where("days is not null").withColumn("r", expr.daily_equivalent(F.col("group_return"), F.col("days")))
    keys = rows.select("horizon", "group").distinct()
    every = dates.select("trade_date").distinct().agg(F.collect_set("trade_date").alias("_d"))
    cells = keys.join(F.broadcast(every)).select("horizon", "group", F.explode("_d").alias("trade_date"))
    cells = cells.join(rows.select("trade_date", "horizon", "group", "r"), ["trade_date", "horizon", "group"], "left")
    cells = cells.withColumn("nav", expr.running_growth(F.coalesce("r", F.lit(0.0)), "trade_date", ["horizon", "group"]))
    if rebase:
        cells = cells.withColumn("nav", expr.divided(F.col("nav"), expr.first_valid(F.col("nav"), "trade_date", ["horizon", "group"])))
    return cells.select("trade_date", "horizon", "group", "nav")


def rebased(daily: DataFrame, value: str, keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """daily with value less its first."""
    return daily.withColumn(value, F.col(value) - expr.first_valid(F.col(value), "trade_date", keys))


def filled_cumulative(daily: DataFrame, value: str, keys: Sequence[str] = ("horizon",), out: str = "cumulative") -> DataFrame:
    """Cumulative sum with absent values as zero."""
    return daily.withColumn(out, F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(expr.running("trade_date", keys)))


def yearly_means(stats: DataFrame, labels: Sequence[str]) -> DataFrame:
    """year and, of each label, the year's mean IC."""
    return stats.groupBy("year").pivot("horizon", list(labels)).agg(F.first("ic_mean"))

"""Statistics across symbols on each date.

Inputs are long: factor (trade_date, symbol, value), returns (trade_date, symbol, horizon, ret), risk (trade_date,
symbol, one column for each style, industries array<string>). Everything of one call is keyed by (trade_date,
horizon), so ranks, buckets and aggregates share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import expr
from tessera.operators.panel import KEYS

IC_METHODS = ("spearman", "pearson")
EDGE_LEGS = ("pool", "low", "high")


def ic_methods(methods=None) -> list[str]:
    """The methods named, in lower case and once each."""
    given = ["spearman"] if methods is None else [methods] if isinstance(methods, str) else list(methods)
    found = list(dict.fromkeys(str(m).lower() for m in given))
    if not found or set(found) - set(IC_METHODS):
        raise ValueError(f"IC methods are {', '.join(IC_METHODS)}; given: {given}")
    return found


def paired(factor: DataFrame, returns: DataFrame) -> DataFrame:
    """trade_date, symbol, horizon, value, ret where both are finite."""
    left = factor.select(*KEYS, expr.finite(F.col("value")).alias("value")).where("value is not null")
    right = returns.select(*KEYS, "horizon", expr.finite(F.col("ret")).alias("ret")).where("ret is not null")
    return left.join(right, KEYS)


def daily_corr(pairs: DataFrame, axis: str, x: str, y: str, method: str, least: int, out: str = "ic") -> DataFrame:
    """trade_date, axis, out, n: correlation on each date; null below `least` pairs. Dates without pairs are absent."""
    parts = ["trade_date", axis]
    if method == "spearman":
        pairs = pairs.select(*parts, expr.average_rank(F.col(x), parts).alias(x), expr.average_rank(F.col(y), parts).alias(y))
    found = pairs.groupBy(*parts).agg(expr.safe_corr(F.col(x), F.col(y)).alias(out), F.count("*").alias("n"))
    return found.withColumn(out, F.when(F.col("n") >= least, F.col(out)))


def on_dates(daily: DataFrame, dates: DataFrame, axis: str, labels: Sequence[str]) -> DataFrame:
    """daily with a row for every date and label; those it lacks are null."""
    each = dates.select("trade_date").distinct().withColumn(axis, F.explode(F.array(*map(F.lit, labels))))
    return each.join(daily, ["trade_date", axis], "left")


def daily_ic(factor: DataFrame, returns: DataFrame, labels: Sequence[str], method: str = "spearman", min_stocks: int = 30) -> DataFrame:
    """trade_date, horizon, ic, n: a row for every factor date and label."""
    (method,) = ic_methods(method)
    found = daily_corr(paired(factor, returns), "horizon", "value", "ret", method, min_stocks)
    return on_dates(found, factor, "horizon", labels).withColumn("n", F.coalesce("n", F.lit(0)))


def bucketed(df: DataFrame, parts: Sequence[str], groups: int, least: int, value: str = "value") -> DataFrame:
    """df's rows in parts of `least` (and `groups`) rows or more, with their bucket; equal values go by symbol."""
    n = F.count("*").over(Window.partitionBy(*parts))
    rows = df.withColumns({"_n": n, "_r": expr.ordinal_rank(F.col(value), parts)}).where(F.col("_n") >= max(least, groups))
    return rows.withColumn("group", expr.quantile_bucket(F.col("_r"), F.col("_n"), groups)).drop("_n", "_r")


def group_returns(factor: DataFrame, returns: DataFrame, groups: int = 10, min_stocks: int = 10) -> DataFrame:
    """trade_date, horizon, group, group_return: the mean return of each factor bucket; small dates are absent."""
    rows = bucketed(paired(factor, returns), ["trade_date", "horizon"], groups, min_stocks)
    return rows.groupBy("trade_date", "horizon", "group").agg(F.avg("ret").alias("group_return"))


def within_industry_group_returns(factor: DataFrame, returns: DataFrame, risk: DataFrame, groups: int = 10, min_industry_stocks: int = 10) -> DataFrame:
    """As group_returns, but buckets are made within each industry and then pooled; a stock counts in each of its own."""
    rows = paired(factor, returns).join(risk.select(*KEYS, F.explode("industries").alias("industry")), KEYS)
    rows = bucketed(rows, ["trade_date", "horizon", "industry"], groups, min_industry_stocks)
    return rows.groupBy("trade_date", "horizon", "group").agg(F.avg("ret").alias("group_return"))


def long_short(by_group: DataFrame, low: int = 1, high: int = 10) -> DataFrame:
    """trade_date, horizon, spread: the high group's return less the low one's; labels without both never appear."""
    leg = lambda g: F.max(F.when(F.col("group") == g, F.col("group_return")))
    found = by_group.groupBy("trade_date", "horizon").agg(leg(low).alias("_l"), leg(high).alias("_h"))
    both = Window.partitionBy("horizon")
    found = found.withColumn("_ok", F.count("_l").over(both) * F.count("_h").over(both) > 0)
    return found.where("_ok").select("trade_date", "horizon", (F.col("_h") - F.col("_l")).alias("spread"))


def with_days(df: DataFrame, days: dict[str, int | None]) -> DataFrame:
    """df with the days of its horizon; labels are few and come as a column of cases."""
    column = F.lit(None).cast("int")
    for label, n in days.items():
        column = F.when(F.col("horizon") == label, F.lit(n).cast("int")).otherwise(column)
    return df.withColumn("days", column)


def daily_equivalent_long_short(by_group: DataFrame, days: dict[str, int | None], low: int = 1, high: int = 10) -> tuple[DataFrame, list[str]]:
    """The spread of daily-equivalent legs, and the labels left out for want of days."""
    rows = with_days(by_group, days).where("days is not null")
    rows = rows.withColumn("group_return", expr.daily_equivalent(F.col("group_return"), F.col("days")))
    return long_short(rows, low, high), [label for label, n in days.items() if n is None]


def factor_groups(factor: DataFrame, groups: int, min_stocks: int) -> DataFrame:
    """trade_date, symbol, group by the factor alone."""
    rows = factor.select(*KEYS, expr.finite(F.col("value")).alias("value")).where("value is not null")
    return bucketed(rows, ["trade_date"], groups, min_stocks).select(*KEYS, "group")


def turnover(factor: DataFrame, groups: int = 10, min_stocks: int = 10, dates: DataFrame | None = None) -> DataFrame:
    """trade_date, group, turnover: the share of a group's members who weren't in it on the date before.

    Null on the first date, after a date that couldn't be grouped, and on such a date. dates: the factor's, if they are at hand.
    """
    dates = (factor if dates is None else dates).select("trade_date").distinct().withColumn("t", F.row_number().over(Window.orderBy("trade_date")))
    now = factor_groups(factor, groups, min_stocks).join(F.broadcast(dates), "trade_date").select("symbol", "t", "group")
    own = Window.partitionBy("symbol").orderBy("t")
    stayed = (F.lag("group").over(own) == F.col("group")) & (F.lag("t").over(own) == F.col("t") - 1)
    counted = now.withColumn("stayed", F.coalesce(stayed, F.lit(False))).groupBy("t", "group").agg(F.count_if("stayed").alias("kept"), F.count("*").alias("n"))
    grouped = counted.select((F.col("t") + 1).alias("t")).distinct().withColumn("before", F.lit(True))
    every = dates.withColumn("group", F.explode(F.sequence(F.lit(1), F.lit(groups))))
    found = every.join(counted, ["t", "group"], "left").join(grouped, "t", "left")
    return found.select("trade_date", "group", F.when(F.col("before"), 1 - F.col("kept") / F.col("n")).alias("turnover"))


def turnover_edges(daily: DataFrame, groups: int = 10) -> DataFrame:
    """trade_date, group 'edge_avg', turnover: the mean of the first and the last group."""
    ends = daily.where(F.col("group").isin(1, groups)).groupBy("trade_date").agg(F.avg("turnover").alias("turnover"))
    return ends.select("trade_date", F.lit("edge_avg").alias("group"), "turnover")


def style_corr(factor: DataFrame, risk: DataFrame, styles: Sequence[str], method: str = "spearman", min_stocks: int = 30) -> DataFrame:
    """trade_date, style, corr: the factor against each style, on the symbols that have both."""
    left = factor.select(*KEYS, expr.finite(F.col("value")).alias("value")).where("value is not null")
    long = risk.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(s).alias("style"), expr.finite(F.col(s).cast("double")).alias("x")) for s in styles])).alias("_s"))
    pairs = left.join(long.select(*KEYS, "_s.style", "_s.x").where("x is not null"), KEYS)
    found = daily_corr(pairs, "style", "value", "x", method, min_stocks, "corr")
    return on_dates(found, factor, "style", styles).select("trade_date", "style", "corr")


def _legs(factor: DataFrame, groups: int, min_stocks: int, low: int, high: int) -> DataFrame:
    """trade_date, symbol, leg: all grouped symbols as the pool, and the two end groups."""
    rows = factor_groups(factor, groups, min_stocks)
    leg = F.array(F.lit("pool"), F.when(F.col("group") == low, F.lit(f"G{low}")).when(F.col("group") == high, F.lit(f"G{high}")))
    return rows.select(*KEYS, F.explode(F.array_compact(leg)).alias("leg"))


def _with_differences(daily: DataFrame, axis: str, low: int, high: int) -> DataFrame:
    """daily with the differences of legs as legs of their own."""
    lo, hi = f"G{low}", f"G{high}"
    wide = daily.groupBy("trade_date", axis).agg(*[F.max(F.when(F.col("leg") == x, F.col("value"))).alias(x) for x in ("pool", lo, hi)])
    made = F.array(*[F.struct(F.lit(name).alias("leg"), v.alias("value")) for name, v in (
        ("pool", F.col("pool")), (lo, F.col(lo)), (hi, F.col(hi)), (f"{hi}-{lo}", F.col(hi) - F.col(lo)), (f"{lo}-pool", F.col(lo) - F.col("pool")), (f"{hi}-pool", F.col(hi) - F.col("pool")),
    )])
    return wide.select("trade_date", axis, F.explode(made).alias("_m")).select("trade_date", "_m.leg", axis, "_m.value")


def group_style_exposure(factor: DataFrame, risk: DataFrame, styles: Sequence[str], groups: int = 10, min_stocks: int = 10, low: int = 1, high: int = 10) -> DataFrame:
    """trade_date, leg, exposure, value: mean style of the pool, the end groups, and their differences."""
    rows = _legs(factor, groups, min_stocks, low, high).join(risk.select(*KEYS, *styles), KEYS, "left")
    means = rows.groupBy("trade_date", "leg").agg(*[F.avg(expr.finite(F.col(s).cast("double"))).alias(s) for s in styles])
    long = means.select("trade_date", "leg", F.explode(F.array(*[F.struct(F.lit(s).alias("exposure"), F.col(s).alias("value")) for s in styles])).alias("_e"))
    return _with_differences(long.select("trade_date", "leg", "_e.exposure", "_e.value"), "exposure", low, high)


def group_industry_exposure(factor: DataFrame, risk: DataFrame, industries: Sequence[str], groups: int = 10, min_stocks: int = 10, low: int = 1, high: int = 10) -> DataFrame:
    """trade_date, leg, industry, value: shares of each industry among members with any, and their differences."""
    rows = _legs(factor, groups, min_stocks, low, high).join(risk.select(*KEYS, "industries").where(F.size("industries") > 0), KEYS)
    share = F.array(*[F.struct(F.lit(i).alias("industry"), F.avg(F.array_contains("industries", i).cast("double")).alias("value")) for i in industries])
    long = rows.groupBy("trade_date", "leg").agg(share.alias("_s")).select("trade_date", "leg", F.explode("_s").alias("_e"))
    return _with_differences(long.select("trade_date", "leg", "_e.industry", "_e.value"), "industry", low, high)


def membership_warnings(risk: DataFrame) -> list[str]:
    """How many rows have no industry, or several."""
    return membership_texts(*risk.agg(F.count_if(F.size("industries") <= 0), F.count_if(F.size("industries") > 1)).first())


def membership_texts(none: int, many: int) -> list[str]:
    found = [f"{none} rows have no industry"] if none else []
    return found + ([f"{many} rows have several industries"] if many else [])

"""The panel: calendar, dense grid, forward returns, tradability, universe membership.

A panel is long: (trade_date date, symbol string, ...). Dates are few, so what is made of them alone may sit in one
partition; everything with symbols is spread by symbol or by date.
"""

from __future__ import annotations

from collections.abc import Sequence


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import expr

KEYS = ["trade_date", "symbol"]
TRADABILITY_FIELDS = ("open_price", "high_price", "low_price", "limit_up_price", "limit_down_price", "is_st", "is_suspended", "listed_days")


def calendar(df: DataFrame) -> DataFrame:
    """trade_date, t: the sessions in order, from 0."""
    return df.select("trade_date").where("trade_date is not null").distinct().withColumn("t", F.row_number().over(Window.orderBy("trade_date")) - 1)


def shift_sessions(dates: DataFrame, sessions: DataFrame, n: int, date: str = "date") -> DataFrame:
    """dates with shifted: n sessions after the first session on or after each date; null beyond the calendar."""
    at = dates.join(F.broadcast(sessions), F.col("trade_date") >= F.col(date), "left").groupBy(*dates.columns).agg(F.min("t").alias("_t"))
    to = sessions.select((F.col("t") - n).alias("_t"), F.col("trade_date").alias("shifted"))
    return at.join(F.broadcast(to), "_t", "left").drop("_t")


def window_ending(sessions: DataFrame, end, n: int) -> DataFrame:
    """The last n sessions up to end, in order; fewer are an error."""
    found = sessions.where(F.col("trade_date") <= F.lit(end)).orderBy(F.desc("trade_date")).limit(n)
    if found.count() < n:
        raise IndexError(f"fewer than {n} sessions up to {end}")
    return found.orderBy("trade_date")


def grid(dates: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every symbol on every date. The dates, one array, go along with each symbol."""
    every = dates.agg(F.array_sort(F.collect_set("trade_date")).alias("_dates"))
    return symbols.select("symbol").distinct().join(F.broadcast(every)).select(F.explode("_dates").alias("trade_date"), "symbol")


def densified(df: DataFrame, dates: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """df on the full grid of its dates and symbols (or those given); absent cells are null."""
    cells = grid(df if dates is None else dates, df if symbols is None else symbols)
    return cells.join(df, KEYS, "left")


def listed_days(prices: DataFrame) -> DataFrame:
    """prices with listed_days: the symbol's opens up to each date; null where the open is."""
    return prices.withColumn("listed_days", F.when(F.col("open_price").isNotNull(), F.count("open_price").over(expr.running("trade_date", ["symbol"]))))


def forward_returns(prices: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """trade_date, symbol, horizon, ret: from the open of the next session to the open h sessions later.

    Sessions are those of the whole table, not of a symbol; a return needs two opens above zero, and without them
    there is no row. Every open goes to the dates whose returns it begins or ends, where one aggregate by date and
    symbol brings them together: no grid, and a result already dealt as a join to a factor needs it.
    """
    horizons = list(dict.fromkeys(int(h) for h in horizons))
    days = calendar(prices)
    ends = F.array(*[F.struct(F.lit(i).alias("role"), F.lit(back).alias("back")) for i, back in enumerate([1, *[h + 1 for h in horizons]])])
    opens = prices.select(*KEYS, "open_price").where("open_price > 0").join(F.broadcast(days), "trade_date")
    sent = opens.select("symbol", "open_price", "t", F.explode(ends).alias("_r")).select("symbol", "open_price", "_r.role", (F.col("t") - F.col("_r.back")).alias("t"))
    sent = sent.join(F.broadcast(days), "t")
    own = lambda i: F.max(F.when(F.col("role") == i, F.col("open_price")))
    met = sent.groupBy(*KEYS).agg(own(0).alias("_b"), *[own(i).alias(f"_e{h}") for i, h in enumerate(horizons, 1)]).where("_b is not null")
    each = F.array(*[F.struct(F.lit(f"{h}d").alias("horizon"), (F.col(f"_e{h}") / F.col("_b") - 1).alias("ret")) for h in horizons])
    return met.select(*KEYS, F.explode(each).alias("_x")).select(*KEYS, "_x.horizon", "_x.ret").where("ret is not null")


def returns_beside(prices: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """trade_date, symbol and a column ret_<h>d of each horizon: forward_returns side by side, of one shuffle by symbol."""
    horizons = list(dict.fromkeys(int(h) for h in horizons))
    days = calendar(prices)
    days = days.withColumn("_before", F.lag("trade_date").over(Window.orderBy("t")))
    opens = prices.select(*KEYS, "open_price").where("open_price > 0").join(F.broadcast(days), "trade_date")
    own = Window.partitionBy("symbol").orderBy("t")
    at = lambda n: F.max("open_price").over(own.rangeBetween(n, n))
    met = opens.select("symbol", "open_price", "t", "_before").select("symbol", "_before", "t", F.lag("t").over(own).alias("_last"), at(0).alias("_b"), *[at(h).alias(f"_e{h}") for h in horizons])
    met = met.where("_before is not null and (_last is null or _last < t)")  # a repeated key counts once, as its largest open
    return met.select(F.col("_before").alias("trade_date"), "symbol", *[(F.col(f"_e{h}") / F.col("_b") - 1).alias(f"ret_{h}d") for h in horizons])


def tradability(cells: DataFrame, min_listed_days: int = 120) -> DataFrame:
    """cells with the six reasons and valid: may be traded at this date's open. A missing flag counts as set; a missing
    number excludes nothing but a missing open."""
    missing = [c for c in TRADABILITY_FIELDS if c not in cells.columns]
    if missing:
        raise ValueError(f"tradability needs {', '.join(missing)}")
    no = F.lit(False)
    flags = {
        "open_invalid": ~F.coalesce(F.col("open_price") > 0, no),
        "limit_up_touch": F.coalesce(F.col("high_price") >= F.col("limit_up_price"), no),
        "limit_down_touch": F.coalesce(F.col("low_price") <= F.col("limit_down_price"), no),
        "st": F.coalesce(F.col("is_st"), F.lit(1.0)) == 1,
        "suspended": F.coalesce(F.col("is_suspended"), F.lit(1.0)) == 1,
        "new_stock": F.coalesce(F.col("listed_days") < min_listed_days, no),
    }
    valid = F.lit(True)
    for c in flags.values():
        valid = valid & ~c
    return cells.withColumns({**flags, "valid": valid})


def tradability_summary(flagged: DataFrame) -> DataFrame:
    """trade_date and the count of each reason and of valid cells."""
    counts = {"open_invalid": "open_invalid_count", "limit_up_touch": "limit_up_touch_count", "limit_down_touch": "limit_down_touch_count", "st": "st_count", "suspended": "suspended_count", "new_stock": "new_stock_filtered_count", "valid": "after_filter_count"}
    return flagged.groupBy("trade_date").agg(*[F.count_if(F.col(c)).alias(name) for c, name in counts.items()])


def at_next_date(source: DataFrame, dates: DataFrame) -> DataFrame:
    """source's rows of each next date of dates, under the date before it; the last date has none."""
    steps = dates.select("trade_date").distinct().withColumn("_next", F.lead("trade_date").over(Window.orderBy("trade_date")))
    steps = steps.where("_next is not null").select(F.col("trade_date").alias("_own"), F.col("_next").alias("trade_date"))
    return source.join(F.broadcast(steps), "trade_date").drop("trade_date").withColumnRenamed("_own", "trade_date")


def in_pool(factor: DataFrame, market: DataFrame, members: DataFrame | None) -> DataFrame:
    """trade_date, symbol, value, member on the grid of dates and of symbols that factor and market share.

    members None is the pool of all. A value outside the pool is null.
    """
    dates = factor.select("trade_date").distinct().join(market.select("trade_date").distinct(), "trade_date", "left_semi")
    symbols = factor.select("symbol").distinct().join(market.select("symbol").distinct(), "symbol", "left_semi")
    cells = grid(dates, symbols).join(factor.select(*KEYS, "value"), KEYS, "left")
    if members is None:
        return cells.withColumn("member", F.lit(True))
    held = members.select(*KEYS).distinct().withColumn("member", F.lit(True))
    cells = cells.join(held, KEYS, "left").withColumn("member", F.coalesce("member", F.lit(False)))
    return cells.withColumn("value", F.when(F.col("member"), F.col("value")))


def pool_range_warnings(name: str, factor: DataFrame, members: DataFrame | None) -> list[str]:
    if members is None:
        return []
    ends = [df.agg(F.min("trade_date"), F.max("trade_date")).first() for df in (factor, members)]
    (f0, f1), (p0, p1) = ends
    found = []
    if f0 and p0 and f0 < p0:
        found.append(f"pool {name} starts at {p0}, after the factor's first date {f0}")
    if f1 and p1 and f1 > p1:
        found.append(f"pool {name} ends at {p1}, before the factor's last date {f1}")
    return found


def quality(cells: DataFrame) -> DataFrame:
    """By date, over members: counts and the shares of covered, zero, missing and infinite values.

    cells: value, member, and valid where tradability was applied."""
    x, member = F.col("value"), F.col("member")
    usable = member & F.coalesce(expr.finite(x).isNotNull(), F.lit(False))
    if "valid" in cells.columns:
        usable = usable & F.coalesce(F.col("valid"), F.lit(False))
    n = F.count_if(member)
    share = lambda c: expr.divided(F.count_if(member & F.coalesce(c, F.lit(False))), n)
    return cells.groupBy("trade_date").agg(
        n.alias("pool_stock_count"), F.count_if(usable).alias("valid_factor_count"), expr.divided(F.count_if(usable), n).alias("coverage_ratio"),
        share(x == 0).alias("zero_ratio"), share(x.isNull() | F.isnan(x)).alias("nan_ratio"), share(F.abs(x) == expr.INF).alias("inf_ratio"),
    )


def wide_view(df: DataFrame, axis: str, value: str, labels: Sequence[str], keys: Sequence[str] = ("trade_date",)) -> DataFrame:
    """One column for each label; only for short axes known beforehand."""
    return df.groupBy(*keys).pivot(axis, list(labels)).agg(F.first(value))



"""Column expressions that the panel operators are built from. All stay inside generated JVM code.

Missing is NULL throughout: sources turn NaN into NULL, infinities stay and are left out of statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")


def finite(x: Column) -> Column:
    """x, or null where it is null, NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < INF), x)


def clean(x: Column) -> Column:
    """x with NaN as null; infinities stay."""
    return F.when(~F.isnan(x), x)


def divided(a: Column, b: Column) -> Column:
    """a / b; null where b is zero or null."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def average_rank(value: Column, parts: Sequence[str]) -> Column:
    """Rank within the parts, ties sharing the mean of their places."""
    first = F.rank().over(Window.partitionBy(*parts).orderBy(value))
    return first + (F.count("*").over(Window.partitionBy(*parts, value)) - 1) / F.lit(2.0)


def ordinal_rank(value: Column, parts: Sequence[str], tie: str = "symbol") -> Column:
    return F.row_number().over(Window.partitionBy(*parts).orderBy(value, tie))


def quantile_points(groups: int) -> list[float]:
    """The inner cut points as interpolation between 0 and 1 gives them."""
    step = 1.0 / groups
    return [k * step * 100 / 100 for k in range(1, groups)]


def quantile_bucket(rank: Column, n: Column, groups: int) -> Column:
    """Bucket 1..groups of a rank 1..n: one more than the right-closed, linearly interpolated edges below the rank."""
    bucket = F.lit(1)
    for q in quantile_points(groups):
        v = F.lit(q) * (n - 1).cast("double")
        p = F.floor(v).cast("double")
        f = v - p
        edge = F.when(f >= 0.5, (p + 2) - (1 - f)).otherwise((p + 1) + f)
        bucket = bucket + (edge < rank.cast("double")).cast("int")
    return bucket


def safe_corr(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation in [-1, 1]; null unless both sides vary."""
    value = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varied, F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0)))


def naive_t(mean: Column, sd: Column, n: Column) -> Column:
    return F.when(n > 1, divided(mean, sd / F.sqrt(n.cast("double"))))


def daily_equivalent(r: Column, days: Column) -> Column:
    """The daily return that compounds to r over days; r itself up to one day, null at a total loss."""
    return F.when(r.isNull(), None).when(days <= 1, r).when(r > -1, F.pow(1 + r, F.lit(1.0) / days) - 1)


def running(order: str, parts: Sequence[str] = ()):
    return Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def running_sum(x: Column, order: str, parts: Sequence[str] = ()) -> Column:
    """Cumulative sum that is null where x is."""
    return F.when(x.isNotNull(), F.sum(x).over(running(order, parts)))


def running_growth(x: Column, order: str, parts: Sequence[str] = ()) -> Column:
    """Cumulative product of 1 + x."""
    return F.product(1 + x).over(running(order, parts))


def rolling_mean(x: Column, rows: int, order: str, parts: Sequence[str] = ()) -> Column:
    return F.avg(x).over(Window.partitionBy(*parts).orderBy(order).rowsBetween(1 - rows, 0))


def first_valid(x: Column, order: str, parts: Sequence[str] = ()) -> Column:
    frame = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.first(x, ignorenulls=True).over(frame)


def hac_mean_t(df: DataFrame, keys: Sequence[str], value: str, date: str, lag: Column, more: dict[str, Column] | None = None) -> DataFrame:
    """keys, the further aggregates, hac_t, hac_lag, and series, the non-null values by date.

    hac_t is the t of the mean with Bartlett-weighted autocovariances. A group is one number for each date. lag is an
    aggregate; beyond n - 1 it is cut, and null gives null.
    """
    more = more or {}
    series = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(date), F.col(value).alias("x")))))
    made = df.groupBy(*keys).agg(series.alias("_s"), F.avg(value).alias("_m"), F.count(value).alias("_n"), lag.cast("int").alias("_lag"), *[c.alias(k) for k, c in more.items()])
    cut = F.when(F.col("_lag").isNotNull(), F.least(F.col("_lag"), F.greatest(F.col("_n") - 1, F.lit(0)))).cast("int")
    made = made.select(*keys, *more, "_m", "_n", cut.alias("_l"), F.transform("_s", lambda s: s["x"]).alias("series"), F.transform("_s", lambda s: s["x"] - F.col("_m")).alias("_d"))

    def product(k: Column) -> Column:
        pairs = F.zip_with(F.slice("_d", k + 1, F.col("_n").cast("int") - k), F.slice("_d", F.lit(1), F.col("_n").cast("int") - k), lambda a, b: a * b)
        return F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b)

    tail = F.when(F.col("_l") >= 1, F.aggregate(F.sequence(F.lit(1), F.col("_l")), F.lit(0.0), lambda a, k: a + 2 * (1 - k / (F.col("_l") + 1).cast("double")) * product(k))).otherwise(0.0)
    variance = F.try_divide(product(F.lit(0)) + tail, F.col("_n").cast("double"))
    t = F.when((F.col("_n") >= 2) & F.col("_l").isNotNull(), F.when(variance > 0, F.col("_m") / F.sqrt(variance / F.col("_n"))))
    lag_used = F.when(F.col("_n") >= 2, F.col("_l")).when(F.col("_l").isNotNull(), 0)
    return made.select(*keys, *more, t.alias("hac_t"), lag_used.alias("hac_lag"), "series")


def deepest_fall(series: Column) -> Column:
    """The smallest of nav / highest nav so far - 1, where nav compounds the series and starts after its first value."""
    start = F.struct(F.lit(1.0).alias("nav"), F.lit(-INF).alias("top"), F.lit(None).cast("double").alias("fall"))

    def step(a: Column, x: Column) -> Column:
        nav = a["nav"] * (1 + x)
        top = F.greatest(a["top"], nav)
        return F.struct(nav.alias("nav"), top.alias("top"), F.least(a["fall"], F.try_divide(nav, top) - 1).alias("fall"))

    return F.aggregate(series, start, step, lambda a: a["fall"])


def label_order(label: str) -> tuple[int, int, str]:
    """Labels such as 5d by their days, before all others by text."""
    number = label[:-1]
    return (0, int(number), "") if label.endswith("d") and number.isdigit() else (1, 0, label)


def horizon_days(label: str, given: dict[str, int | None] | None = None) -> int | None:
    """Days of a return label: as given, where it is (None counts), else from a label such as 5d."""
    if given is not None and label in given:
        return given[label]
    kind, days, _ = label_order(label)
    return days if kind == 0 else None


def horizon_days_anywhere(label: str, given: dict[str, int | None] | None = None) -> int | None:
    """As horizon_days, but a number before 'd' at the end of any word will do, even over a given None."""
    import re

    if given and given.get(label):
        return given[label]
    found = re.search(r"(\d+)d\b", label)
    return int(found[1]) if found else None


def slug(label: str) -> str:
    import re

    return re.sub(r"[^0-9A-Za-z_.-]+", "_", label).strip("_")

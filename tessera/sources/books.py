"""Factor libraries and market regimes; both optional, so what can't be read is a warning."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import expr
from tessera.sources.common import SourceError, pick

#: Fixed spellings of flags.
TRUE_TEXTS, FALSE_TEXTS = ("true", "t", "1", "yes", "y"), ("false", "f", "0", "no", "n", "")


def read_frame(spark: SparkSession, path: str) -> DataFrame:
    if path.lower().endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    if path.lower().endswith((".parquet", ".pq")) or "." not in path.rpartition("/")[2]:
        return spark.read.parquet(path)
    raise SourceError(f"neither CSV nor Parquet: {path}")


def normalize_book(raw: DataFrame) -> DataFrame:
    """trade_date, symbol, factor_id, value; equal keys are averaged."""
    names = [pick(raw.columns, x) for x in (("date", "trade_date"), ("symbol", "stock_id", "asset"), ("factor_id",), ("value", "factor_value", "factor"))]
    if None in names:
        raise SourceError(f"a factor library needs date, symbol, factor_id and value; has {raw.columns}")
    date, symbol, factor, value = names
    rows = raw.select(F.to_date(date).alias("trade_date"), F.col(symbol).cast("string").alias("symbol"), F.col(factor).cast("string").alias("factor_id"), expr.clean(F.col(value).try_cast("double")).alias("value"))
    return rows.groupBy("trade_date", "symbol", "factor_id").agg(F.avg("value").alias("value"))


def flag(column: str, kind: str) -> Column:
    """A flag as boolean: text by its spelling, a number unless zero; missing is false."""
    if kind == "boolean":
        return F.coalesce(F.col(column), F.lit(False))
    if kind == "string":
        text = F.lower(F.trim(F.coalesce(column, F.lit(""))))
        return F.when(text.isin(*TRUE_TEXTS), True).when(text.isin(*FALSE_TEXTS), False)
    return F.coalesce(F.col(column).cast("double") != 0, F.lit(False))


def normalize_regimes(raw: DataFrame, labels: Sequence[str]) -> DataFrame:
    """trade_date and a boolean for each label."""
    date = pick(raw.columns, ("date", "trade_date"))
    missing = [x for x in labels if x not in raw.columns]
    if date is None or missing:
        raise SourceError(f"regimes need a date and {', '.join(labels)}; missing: {missing or 'date'}")
    kinds = dict(raw.dtypes)
    rows = raw.select(F.to_date(date).alias("trade_date"), *[flag(x, kinds[x]).alias(x) for x in labels])
    bad = rows.agg(*[F.count_if(F.col(x).isNull()).alias(x) for x in labels]).first().asDict()
    if any(bad.values()):
        raise SourceError(f"not a flag, in {[x for x, n in bad.items() if n]}")
    return rows


def optional(what: str, load: Callable[[], DataFrame], warnings: list[str]) -> DataFrame | None:
    """What load returns, or None and a warning."""
    try:
        return load()
    except Exception as e:
        warnings.append(f"{what} left out: {e}")
        return None

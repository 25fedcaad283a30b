"""Market data: a server's tables joined to one row for each symbol and date, then checked."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import expr
from tessera.operators.panel import listed_days
from tessera.sources.common import SourceError, pick
from tessera.sources.risk import latest_versions

#: Fixed default table names.
TABLES = {"ohlcv": "stock_daily", "shares": "stock_shares", "st": "stock_st", "suspended": "stock_suspended"}
#: Fixed names of universes; each is a CSV file of its name, 'all' is virtual.
POOLS = ("all", "hs300_pool", "zz500_pool", "zz1000_pool", "zz2000_pool", "gz1000_pool", "gz2000_pool", "gzMidsmallcap_pool", "miMicrocap_pool")
PRICES = ("open_price", "close_price", "high_price", "low_price", "volume", "amount", "market_cap", "limit_up_price", "limit_down_price", "is_st", "is_suspended")
#: Fixed other names of the columns.
ALIASES = {
    "date": "trade_date", "stock_id": "symbol", "open": "open_price", "close": "close_price", "high": "high_price", "low": "low_price", "turnover": "amount",
    "circulation_a": "market_cap", "limit_up": "limit_up_price", "limit_down": "limit_down_price",
}


def market_query(start: str, end: str, tables: Mapping[str, str] | None = None) -> str:
    """The half-open range of prices with shares, special treatment and suspensions, as a server's SQL."""
    t = TABLES | dict(tables or {})
    return (
        "SELECT o.symbol, o.date AS trade_date, o.open AS open_price, o.close AS close_price, o.high AS high_price, o.low AS low_price, o.volume, o.turnover AS amount, "
        "s.circulation_a AS market_cap, o.limit_up, o.limit_down, st.is_st, su.is_suspended "
        f"FROM {t['ohlcv']} o LEFT JOIN {t['shares']} s ON o.symbol = s.symbol AND o.date = s.date LEFT JOIN {t['st']} st ON o.symbol = st.symbol AND o.date = st.date "
        f"LEFT JOIN {t['suspended']} su ON o.symbol = su.symbol AND o.date = su.date WHERE o.date >= '{start}' AND o.date < '{end}'"
    )


def joined(table: Callable[[str], DataFrame], start: str, end: str, tables: Mapping[str, str] | None = None) -> DataFrame:
    """What market_query says, over tables that Spark reads; the range reaches every scan."""
    t = TABLES | dict(tables or {})
    own = lambda name: table(t[name]).where((F.col("date") >= start) & (F.col("date") < end))
    keys = ["symbol", "date"]
    shares, st, off = own("shares").select(*keys, "circulation_a"), own("st").select(*keys, "is_st"), own("suspended").select(*keys, "is_suspended")
    return own("ohlcv").join(shares, keys, "left").join(st, keys, "left").join(off, keys, "left")


def by_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query run by the server; user, password, driver, and how to split the read are options."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def normalize(raw: DataFrame, version: str | None = None) -> DataFrame:
    """trade_date, symbol, the prices and flags as double, listed_days.

    Repeated keys need a version column, whose largest stays; without one they are an error.
    """
    names = {c: ALIASES[c] for c in raw.columns if c in ALIASES and ALIASES[c] not in raw.columns}
    rows = raw.withColumnsRenamed(names)
    missing = [c for c in ("trade_date", "symbol", *PRICES) if c not in rows.columns]
    if missing:
        raise SourceError(f"market data lack {', '.join(missing)}")
    if version:
        rows = latest_versions(rows, ["trade_date", "symbol"], version)
    more = [c for c in ("is_delisted",) if c in rows.columns]
    rows = rows.select(F.to_date("trade_date").alias("trade_date"), F.col("symbol").cast("string").alias("symbol"), *[expr.clean(F.col(c).try_cast("double")).alias(c) for c in (*PRICES, *more)])
    if not version and rows.groupBy("trade_date", "symbol").count().where("count > 1").head(1):
        raise SourceError("market data: repeated keys and no version to choose by")
    return listed_days(rows)


def load(read: Callable[[str], DataFrame], start: str, end: str, tables: Mapping[str, str] | None = None, version: str | None = None) -> DataFrame:
    """read(query) run for the range; nothing found is an error."""
    raw = read(market_query(start, end, tables))
    if not raw.head(1):
        raise RuntimeError(f"no market data from {start} to {end}")
    return normalize(raw, version)


def pool(spark: SparkSession, path: str) -> DataFrame:
    """trade_date, symbol of a universe, from CSV or Parquet."""
    return members(spark.read.option("header", True).csv(path) if path.lower().endswith(".csv") else spark.read.parquet(path))


def members(raw: DataFrame) -> DataFrame:
    """trade_date, symbol of a universe, each once."""
    date, symbol = pick(raw.columns, ("trade_date", "date")), pick(raw.columns, ("symbol", "asset"))
    if date is None or symbol is None:
        raise SourceError(f"a pool needs trade_date and symbol; has {raw.columns}")
    return raw.select(F.to_date(date).alias("trade_date"), F.col(symbol).cast("string").alias("symbol")).distinct()


def registry(folder: str) -> dict[str, str | None]:
    """The named universes, with their files in a folder."""
    return {name: None if name == "all" else f"{folder.rstrip('/')}/{name}.csv" for name in POOLS}


def pools(spark: SparkSession, selected, registry: Mapping[str, str | DataFrame | None]) -> dict[str, DataFrame | None]:
    """The pools selected; None is the pool of all."""
    unknown = [p for p in selected if p not in registry]
    if unknown:
        raise KeyError(f"unknown pools: {', '.join(unknown)}")
    return {p: pool(spark, registry[p]) if isinstance(registry[p], str) else registry[p] for p in selected}

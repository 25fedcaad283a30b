"""Returns: made from opens, or given from outside, by label."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import expr
from tessera.operators.panel import KEYS, forward_returns, returns_beside
from tessera.sources import factors
from tessera.sources.common import SourceError, reject_duplicates

VALUES = ("return", "ret", "future_return", "factor_value", "factor", "value")


@dataclass(frozen=True)
class ReturnSet:
    """returns (trade_date, symbol, horizon, ret), its labels in order, the days of each (None: unknown), and the same
    returns beside one another: trade_date, symbol and a column _r<i> for each label, finite or null."""

    returns: DataFrame
    labels: list[str]
    days: dict[str, int | None]
    beside: DataFrame


def normalize(raw: DataFrame, value_column: str | None = None) -> DataFrame:
    """trade_date, symbol, ret; what isn't a number is missing."""
    rows = factors.to_long(raw, value_column, VALUES, "ret")
    rows = rows.select(F.to_date(F.col("trade_date").try_cast("timestamp")).alias("trade_date"), "symbol", expr.clean(F.col("ret").try_cast("double")).alias("ret")).where("trade_date is not null")
    return reject_duplicates(rows, ["trade_date", "symbol"], "returns")


def load(spark: SparkSession, path: str, value_column: str | None = None, h5_key: str | None = None) -> DataFrame:
    if path.lower().endswith(".csv"):
        return normalize(spark.read.option("header", True).csv(path), value_column)
    if path.lower().endswith((".h5", ".hdf5")):
        return normalize(factors.read_hdf(spark, path, h5_key), value_column)
    if path.lower().rstrip("/").endswith(".parquet"):
        return normalize(spark.read.parquet(path), value_column)
    raise SourceError(f"neither CSV, Parquet nor HDF5: {path}")


def external(spark: SparkSession, given: Mapping[str, Any] | None) -> dict[str, tuple[DataFrame, int | None]]:
    """Of each label its returns and days. A value is a table, a path, or a dict of data and options."""
    found = {}
    for label, value in (given or {}).items():
        options = dict(value) if isinstance(value, Mapping) else {"data": value}
        if options.get("data") is None:
            raise ValueError(f"{label}: no data")
        days = options.get("horizon_days")
        if days is not None and int(days) <= 0:
            raise ValueError(f"{label}: horizon_days must be above zero")
        data, column = options["data"], options.get("value_column")
        if isinstance(data, str):
            frame = load(spark, data, column, options.get("h5_key"))
        else:
            frame = normalize(data if isinstance(data, DataFrame) else factors.from_pandas(spark, data), column)
        found[str(label)] = (frame, None if days is None else int(days))
    return found


def build(spark: SparkSession, prices: DataFrame, horizons: Sequence[int], given: Mapping[str, Any] | None = None) -> ReturnSet:
    """Forward returns of the horizons, and those given; a label may come once."""
    horizons = list(dict.fromkeys(int(h) for h in horizons))
    others = external(spark, given)
    days: dict[str, int | None] = {f"{h}d": h for h in horizons}
    if twice := sorted(set(days) & set(others)):
        raise ValueError(f"return labels come twice: {', '.join(twice)}")
    parts = [forward_returns(prices, horizons)] if horizons else []
    parts += [frame.select("trade_date", "symbol", F.lit(label).alias("horizon"), "ret") for label, (frame, _) in others.items()]
    days |= {label: n for label, (_, n) in others.items()}
    labels = sorted(days, key=expr.label_order)
    wide = [returns_beside(prices, horizons)] if horizons else []
    named = {f"{h}d": f"ret_{h}d" for h in horizons} | {label: f"_x{i}" for i, label in enumerate(others)}
    wide += [frame.select(*KEYS, F.col("ret").alias(named[label])) for label, (frame, _) in others.items()]
    beside = reduce(lambda a, b: a.join(b, KEYS, "full"), wide).select(*KEYS, *[expr.finite(F.col(named[x])).alias(f"_r{i}") for i, x in enumerate(labels)])
    return ReturnSet(reduce(lambda a, b: a.unionByName(b), parts), labels, days, beside)


def slug(label: str) -> str:
    return re.sub(r"_+", "_", expr.slug(label))

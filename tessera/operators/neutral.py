"""Least squares on each date: what of a factor its exposures don't explain.

Several regressors need linear algebra, so a date's cross-section, some thousand rows by some forty columns, goes to
numpy as one Arrow group. Nothing else leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import expr
from tessera.functions.ship import ship
from tessera.operators.cross_section import daily_ic
from tessera.operators.panel import KEYS

RESIDUALS = "trade_date date, symbol string, value double"


def fitted(design: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least-squares fit with an intercept; of many solutions that of least norm."""
    full = np.column_stack([np.ones(len(y)), design])
    return full @ np.linalg.lstsq(full, y, rcond=None)[0]


def r_squared(design: np.ndarray, y: np.ndarray) -> float:
    total = float(((y - y.mean()) ** 2).sum())
    return 1.0 - float(((y - fitted(design, y)) ** 2).sum()) / total if total > 0 else float("nan")


def _columns(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names]) if names else np.zeros((table.num_rows, 0))


def neutralized(factor: DataFrame, risk: DataFrame, styles: Sequence[str] = (), industries: Sequence[str] = (), min_stocks: int = 30) -> DataFrame:
    """trade_date, symbol, value: residuals; null where a regressor or the industry is missing, or stocks are few."""
    if not styles and not industries:
        return factor.select(*KEYS, "value")
    dummies = [f"_i{i}" for i in range(len(industries) - (len(industries) > 1))]  # the last is left out
    named = dict(zip(dummies, industries, strict=False))
    own = risk.select(*KEYS, *[F.col(s).cast("double").alias(s) for s in styles], *[F.array_contains("industries", i).cast("double").alias(d) for d, i in named.items()], (F.size("industries") > 0).alias("_has"))
    rows = factor.select(*KEYS, "value").join(own, KEYS, "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    regressors, need_industry = [*styles, *dummies], bool(industries)

    def residuals(table):
        x, y = _columns(table, regressors), _columns(table, ["value"])[:, 0]
        good = np.isfinite(y) & np.isfinite(x).all(axis=1)
        if need_industry:
            good &= table.column("_has").to_numpy(zero_copy_only=False).astype(bool)
        out = np.full(len(y), np.nan)
        if good.sum() >= min_stocks:
            out[good] = y[good] - fitted(x[good], y[good])
        return pa.table({"trade_date": table.column("trade_date"), "symbol": table.column("symbol"), "value": pa.array(out, from_pandas=True)})

    ship(rows.sparkSession)
    return rows.groupBy("trade_date").applyInArrow(residuals, RESIDUALS)


def missing_industry_warning(factor: DataFrame, risk: DataFrame) -> list[str]:
    return left_out(factor.select(*KEYS).join(risk.where(F.size("industries") > 0).select(*KEYS), KEYS, "left_anti").count())


def left_out(n: int) -> list[str]:
    return [f"{n} rows have no industry and were left out"] if n else []


def neutralized_ic(factor: DataFrame, returns: DataFrame, risk: DataFrame, labels: Sequence[str], styles: Sequence[str] = (), industries: Sequence[str] = (), method: str = "spearman", min_stocks: int = 30) -> DataFrame:
    """daily_ic of the residuals, which are never stored."""
    return daily_ic(neutralized(factor, risk, styles, industries, min_stocks), returns, labels, method, min_stocks)


def residual_of_peers(candidate: DataFrame, book: DataFrame, peers: Sequence[str], min_stocks: int = 30) -> DataFrame:
    """The candidate less its fit on the peers of each date; a date without peers, or with few rows, is kept as it is."""
    rows = candidate.select(*KEYS, "value").join(peer_columns(book, peers), KEYS, "left")
    names = [f"_p{i}" for i in range(len(peers))]

    def residuals(table):
        x, y = _columns(table, names), _columns(table, ["value"])[:, 0]
        out, there = y.copy(), np.isfinite(x).any(axis=0)
        x = x[:, there]
        good = np.isfinite(y) & np.isfinite(x).all(axis=1)
        if there.any() and good.sum() >= max(min_stocks, x.shape[1] + 2):
            out = np.full(len(y), np.nan)
            out[good] = y[good] - fitted(x[good], y[good])
        return pa.table({"trade_date": table.column("trade_date"), "symbol": table.column("symbol"), "value": pa.array(out, from_pandas=True)})

    ship(rows.sparkSession)
    return rows.groupBy("trade_date").applyInArrow(residuals, RESIDUALS)


def peer_columns(book: DataFrame, peers: Sequence[str]) -> DataFrame:
    """trade_date, symbol and a column _p<i> for each peer."""
    return book.where(F.col("factor_id").isin(list(peers))).groupBy(*KEYS).agg(*[F.max(F.when(F.col("factor_id") == p, F.col("value"))).alias(f"_p{i}") for i, p in enumerate(peers)])


def incremental_r2(candidate: DataFrame, book: DataFrame, returns: DataFrame, peers: Sequence[str], min_stocks: int = 30) -> DataFrame:
    """trade_date, horizon, r2: what the candidate adds to the peers in explaining returns; a row for each usable date."""
    rows = candidate.select(*KEYS, expr.finite(F.col("value")).alias("value")).join(peer_columns(book, peers), KEYS, "left").join(returns, KEYS)
    names = [f"_p{i}" for i in range(len(peers))]

    def gain(table):
        x, y, c = _columns(table, names), _columns(table, ["ret"])[:, 0], _columns(table, ["value"])
        x = x[:, np.isfinite(x).any(axis=0)]
        good = np.isfinite(y) & np.isfinite(c[:, 0]) & np.isfinite(x).all(axis=1)
        found = []
        if good.sum() >= max(min_stocks, x.shape[1] + 3):
            y, x, c = y[good], x[good], c[good]
            value = r_squared(np.hstack([x, c]), y) - (r_squared(x, y) if x.shape[1] else 0.0)
            found = [value] if np.isfinite(value) else []
        return pa.table({"trade_date": table.column("trade_date")[: len(found)], "horizon": table.column("horizon")[: len(found)], "r2": pa.array(found, pa.float64())})

    ship(rows.sparkSession)
    return rows.groupBy("trade_date", "horizon").applyInArrow(gain, "trade_date date, horizon string, r2 double")

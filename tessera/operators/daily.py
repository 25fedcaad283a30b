"""All that a run measures of a date's cross-section, in one pass over a pool's joined rows.

Rows are a full grid: trade_date, symbol, value (null where unusable), a column _r<i> for each return label, and with
risk a column _s<i> for each style and _i<i>, a flag, for each industry; numbers are finite or null. A date, some
thousand rows to some hundred thousand, goes to numpy as one Arrow group, since residuals need linear algebra; it is
sorted once, and ranks, buckets, means and correlations of every statistic are made of that order. The operators of
cross_section and neutral say the same one statistic at a time, and the tests hold this against them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import quantile_points
from tessera.functions.ship import ship
from tessera.operators.neutral import fitted

SCHEMA = "trade_date date, kind string, axis string, leg string, group int, x double, n bigint"
#: Families that are measured, and whether they need risk; one that fails doesn't fail the others.
FAMILIES = {"ic": False, "group": False, "corr": True, "style_ic": True, "style_industry_ic": True, "style_leg": True, "industry_leg": True, "within": True, "unplaced": True}


@dataclass(frozen=True)
class Asked:
    """What is measured; labels, styles and industries name the columns in their order."""

    labels: Sequence[str]
    methods: Sequence[str]
    groups: int
    min_ic: int
    min_group: int
    min_industry: int
    styles: Sequence[str] = ()
    industries: Sequence[str] = ()
    families: Sequence[str] = tuple(FAMILIES)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal values begin, and how many there are."""
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, int)
    return first, np.diff(np.append(first, len(sorted_values)))


def sorted_ranks(values: np.ndarray) -> np.ndarray:
    """Average ranks of values in order."""
    first, counts = runs(values)
    return np.repeat(first + (counts + 1) / 2, counts)


def average_ranks(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values, kind="stable")
    out = np.empty(len(values))
    out[order] = sorted_ranks(values[order])
    return out


def correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    """Pearson correlation in [-1, 1]; None unless both sides vary."""
    if len(x) < 2 or x.min() == x.max() or y.min() == y.max():
        return None
    x, y = x - x.mean(), y - y.mean()
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(min(max((x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)), -1.0), 1.0))


def edges(n: int, groups: int) -> np.ndarray:
    """The inner bucket edges of ranks 1..n, as expr.quantile_bucket has them."""
    found = []
    for q in quantile_points(groups):
        v = q * float(n - 1)
        p = float(np.floor(v))
        f = v - p
        found.append((p + 2) - (1 - f) if f >= 0.5 else (p + 1) + f)
    return np.array(found)


def buckets(n: int, groups: int) -> np.ndarray:
    """The bucket, from 0, of each of n ordered rows."""
    return np.searchsorted(edges(n, groups), np.arange(1, n + 1, dtype=float), side="left")


def _correlations(put: Callable, kind: str, axis: str, methods: Sequence[str], x: np.ndarray, y: np.ndarray, least: int, in_order: bool) -> None:
    for method in methods:
        found = None
        if len(x) >= least:
            found = correlation(x, y) if method == "pearson" else correlation(sorted_ranks(x) if in_order else average_ranks(x), average_ranks(y))
        put(kind, axis, method, None, found, len(x))


def _means(put: Callable, kind: str, axis: str, groups: int, bucket: np.ndarray, x: np.ndarray) -> None:
    n, total = np.bincount(bucket, minlength=groups), np.bincount(bucket, x, groups)
    for g in np.flatnonzero(n):
        put(kind, axis, None, int(g) + 1, float(total[g] / n[g]), int(n[g]))


def _differences(put: Callable, kind: str, axis: str, lo: str, hi: str, pool, low, high) -> None:
    less = lambda a, b: None if a is None or b is None else a - b
    for leg, x in (("pool", pool), (lo, low), (hi, high), (f"{hi}-{lo}", less(high, low)), (f"{lo}-pool", less(low, pool)), (f"{hi}-pool", less(high, pool))):
        put(kind, axis, leg, None, x, None)


def _mean(x: np.ndarray) -> float | None:
    x = x[np.isfinite(x)]
    return float(x.mean()) if len(x) else None


def measure(table: pa.Table, asked: Asked) -> pa.Table:
    """The statistics of one date."""
    date, rows = table.column("trade_date")[0], []
    table = table.filter(pc.is_valid(table.column("value"))).combine_chunks()
    if table.num_rows:
        table = table.take(pc.sort_indices(table.select(["value", "symbol"]), sort_keys=[("value", "ascending"), ("symbol", "ascending")]))
    column = lambda name: table.column(name).to_numpy(zero_copy_only=False).astype(float)
    value = column("value")
    rets = [column(f"_r{i}") for i in range(len(asked.labels))]
    there = [np.isfinite(r) for r in rets]
    risky = any(FAMILIES[f] for f in asked.families)
    styles = [column(f"_s{i}") for i in range(len(asked.styles))] if risky else []
    flags = [column(f"_i{i}") == 1 for i in range(len(asked.industries))] if risky else []
    has = np.logical_or.reduce(flags) if flags else np.zeros(len(value), bool)
    least = max(asked.min_group, asked.groups)

    def put(kind, axis, leg, group, x, n) -> None:
        rows.append((kind, axis, leg, group, x, n))

    def ic(kind: str) -> None:
        for label, r, ok in zip(asked.labels, rets, there, strict=True):
            _correlations(put, kind, label, asked.methods, value[ok], r[ok], asked.min_ic, True)

    def group(kind: str) -> None:
        for label, r, ok in zip(asked.labels, rets, there, strict=True):
            if (n := int(ok.sum())) >= least:
                _means(put, kind, label, asked.groups, buckets(n, asked.groups), r[ok])

    def corr(kind: str) -> None:
        for style, s in zip(asked.styles, styles, strict=True):
            ok = np.isfinite(s)
            _correlations(put, kind, style, asked.methods, value[ok], s[ok], asked.min_ic, True)

    def residual_ic(kind: str, dummies: Sequence[np.ndarray], need: np.ndarray | None) -> None:
        x = np.column_stack([*styles, *dummies]) if len(styles) + len(dummies) else np.zeros((len(value), 0))
        good = np.isfinite(x).all(axis=1)
        if need is not None:
            good &= need
        plain = not x.shape[1]
        if not plain and good.sum() < asked.min_ic:
            good[:] = False
        e = value[good] if plain or not good.any() else value[good] - fitted(x[good], value[good])
        for label, r, ok in zip(asked.labels, rets, there, strict=True):
            both = ok[good]
            _correlations(put, kind, label, asked.methods, e[both], r[good][both], asked.min_ic, False)

    def legs() -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if len(value) < least:
            return None
        b = buckets(len(value), asked.groups)
        return np.ones(len(value), bool), b == 0, b == asked.groups - 1

    lo, hi = "G1", f"G{asked.groups}"

    def style_leg(kind: str) -> None:
        if three := legs():
            for style, s in zip(asked.styles, styles, strict=True):
                _differences(put, kind, style, lo, hi, *(_mean(s[m]) for m in three))

    def industry_leg(kind: str) -> None:
        if (three := legs()) and has.any():
            for industry, f in zip(asked.industries, flags, strict=True):
                _differences(put, kind, industry, lo, hi, *(_mean(f[m & has].astype(float)) for m in three))

    def within(kind: str) -> None:
        most = max(asked.min_industry, asked.groups)
        for label, r, ok in zip(asked.labels, rets, there, strict=True):
            own = [r[m] for f in flags if (m := f & ok).sum() >= most]
            if own:
                _means(put, kind, label, asked.groups, np.concatenate([buckets(len(x), asked.groups) for x in own]), np.concatenate(own))

    dummies = [f.astype(float) for f in (flags[:-1] if len(flags) > 1 else flags)]  # the last is left out
    how = {
        "ic": ic, "group": group, "corr": corr, "style_ic": lambda kind: residual_ic(kind, [], None), "style_industry_ic": lambda kind: residual_ic(kind, dummies, has if flags else None),
        "style_leg": style_leg, "industry_leg": industry_leg, "within": within,
        "unplaced": lambda kind: put(kind, None, None, None, None, int((~has).sum())),  # values without an industry
    }
    for family in asked.families:
        kept = len(rows)
        try:
            how[family](family)
        except Exception as e:
            del rows[kept:]
            put("failed", family, f"{type(e).__name__}: {e}", None, None, None)
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int64())
    made = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
    return pa.table([pa.array([date.as_py()] * len(rows), pa.date32()), *made], names=["trade_date", "kind", "axis", "leg", "group", "x", "n"])


def measured(rows: DataFrame, asked: Asked) -> DataFrame:
    """SCHEMA: every family's statistics of every date."""
    risky = any(FAMILIES[f] for f in asked.families)
    names = [*(f"_r{i}" for i in range(len(asked.labels))), *(f"_s{i}" for i in range(len(asked.styles) * risky)), *(f"_i{i}" for i in range(len(asked.industries) * risky))]
    ship(rows.sparkSession)
    return rows.select("trade_date", "symbol", "value", *names).groupBy("trade_date").applyInArrow(lambda table: measure(table, asked), SCHEMA)


@dataclass
class Measured:
    """A pool's written measurements, and of each family that failed the error."""

    table: DataFrame
    failed: dict[str, str] = field(default_factory=dict)

    def of(self, family: str) -> DataFrame:
        if family in self.failed:
            raise RuntimeError(self.failed[family])
        return self.table.where(F.col("kind") == family)

    def ic(self, method: str, family: str = "ic") -> DataFrame:
        """trade_date, horizon, ic, n."""
        return self.of(family).where(F.col("leg") == method).select("trade_date", F.col("axis").alias("horizon"), F.col("x").alias("ic"), "n")

    def corr(self, method: str) -> DataFrame:
        """trade_date, style, corr."""
        return self.of("corr").where(F.col("leg") == method).select("trade_date", F.col("axis").alias("style"), F.col("x").alias("corr"))

    def groups(self, family: str = "group") -> DataFrame:
        """trade_date, horizon, group, group_return."""
        return self.of(family).select("trade_date", F.col("axis").alias("horizon"), "group", F.col("x").alias("group_return"))

    def legs(self, family: str, axis: str) -> DataFrame:
        """trade_date, leg, axis, value."""
        return self.of(family).select("trade_date", "leg", F.col("axis").alias(axis), F.col("x").alias("value"))

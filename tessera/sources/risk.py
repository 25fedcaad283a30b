"""Risk exposures: styles and industry membership by date and symbol."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import expr
from tessera.operators.cross_section import membership_texts
from tessera.sources.common import SourceError, pick, reject_duplicates

#: Fixed style names.
STYLES = ("size", "non_linear_size", "momentum", "liquidity", "book_to_price", "leverage", "growth", "earnings_yield", "beta", "residual_volatility")
IGNORED = ("comovement",)
TABLE_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$")


def latest_versions(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Of each key the row with the largest version; one aggregate, without a sort."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), version).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in others])


def risk_query(start: str, end: str, table: str, industries: Sequence[str], styles: Sequence[str] = STYLES) -> str:
    """The scan of a versioned exposure table, over a closed range, as a server's SQL."""
    if not TABLE_NAME.match(table):
        raise ValueError(f"not a table name: {table}")
    if start > end:
        raise ValueError(f"{start} is after {end}")
    names = [*styles, *industries]
    if any("`" in n for n in names):
        raise ValueError("a column name has a backtick")
    listed = ", ".join(f"`{n}`" for n in ["date", "symbol", *names])
    return f"SELECT {listed} FROM {table} FINAL WHERE date >= '{start}' AND date <= '{end}'"


def normalize_risk(raw: DataFrame, styles: Sequence[str] = STYLES, ignored: Sequence[str] = IGNORED) -> DataFrame:
    """trade_date, symbol, the styles as double, industries array<string>.

    Industries come from one column `industry` (a label, or a number), or else from every other column that isn't
    ignored, where it is above zero. A missing style or a repeated key is an error.
    """
    date, symbol = pick(raw.columns, ("trade_date", "date")), pick(raw.columns, ("symbol", "asset"))
    missing = [s for s in styles if s not in raw.columns]
    if date is None or symbol is None or missing:
        raise SourceError(f"risk exposures need a date, a symbol and the styles; missing: {missing or 'date or symbol'}")
    if "industry" in raw.columns:
        industries = F.array_compact(F.array(industry_label("industry", dict(raw.dtypes)["industry"])))
    else:
        names = [c for c in raw.columns if c not in {date, symbol, *styles, *ignored}]
        industries = F.array_compact(F.array(*[F.when(F.col(c).try_cast("double") > 0, F.lit(c)) for c in names])) if names else F.array().cast("array<string>")
    rows = raw.select(F.to_date(date).alias("trade_date"), F.col(symbol).cast("string").alias("symbol"), *[expr.clean(F.col(s).try_cast("double")).alias(s) for s in styles], industries.alias("industries"))
    return reject_duplicates(rows, ["trade_date", "symbol"], "risk exposures")


def industry_label(column: str, kind: str):
    """A label as text; a whole number without its fraction; null for missing or blank."""
    if kind in ("double", "float"):
        x = expr.finite(F.col(column).cast("double"))
        return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    text = F.trim(F.col(column).cast("string"))
    return F.when(text != "", text)


def industry_names(risk: DataFrame) -> list[str]:
    """All labels: numbers by their value, others as text."""
    return _in_order([r[0] for r in risk.select(F.explode("industries")).distinct().collect()])


def _in_order(found: Sequence[str]) -> list[str]:
    numeric = all(re.fullmatch(r"-?\d+", x) for x in found)
    return sorted(found, key=int if numeric else None)


def memberships(risk: DataFrame) -> tuple[list[str], list[str]]:
    """industry_names and cross_section.membership_warnings, of one scan."""
    none, many, found = risk.agg(F.count_if(F.size("industries") <= 0), F.count_if(F.size("industries") > 1), F.array_distinct(F.flatten(F.collect_set("industries")))).first()
    return _in_order(found or []), membership_texts(none, many)


def latest_risk(raw: DataFrame, version: str, **how) -> DataFrame:
    """normalize_risk of the latest version of each key."""
    keys = [pick(raw.columns, ("trade_date", "date")), pick(raw.columns, ("symbol", "asset"))]
    return normalize_risk(latest_versions(raw, keys, version).drop(version), **how)




def load(read, start: str, end: str, table: str, industries: Sequence[str] = (), styles: Sequence[str] = STYLES) -> DataFrame:
    """read(query) of a closed range, checked; nothing found is an error."""
    raw = read(risk_query(start, end, table, industries, styles))
    if not raw.head(1):
        raise RuntimeError(f"no risk exposures from {start} to {end}")
    return normalize_risk(raw, styles)


def resolve(source: str, read=None, start: str | None = None, end: str | None = None, **how) -> DataFrame | None:
    """Risk exposures as a configuration names their source: 'none', or 'server' with a reader and a range."""
    if source == "none":
        return None
    if source != "server":
        raise ValueError(f"unknown source of risk exposures: {source}")
    if read is None or start is None or end is None:
        raise ValueError("a server's risk exposures need a reader and a range of dates")
    return load(read, start, end, **how)

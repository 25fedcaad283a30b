"""The analyses of a run: pure functions from a context to named tables. One that fails doesn't fail the others."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import expr
from tessera.operators import cross_section as xs
from tessera.operators import neutral
from tessera.operators import timeseries as ts
from tessera.operators.daily import Measured
from tessera.plans import views
from tessera.plans.config import BacktestConfig
from tessera.sources.returns import slug


@dataclass
class Context:
    """What sections read of one pool; all lazy, the shared steps written by the run."""

    config: BacktestConfig
    pool: str
    factor: DataFrame  # filtered: trade_date, symbol, value on the full grid
    returns: DataFrame
    labels: list[str]
    days: dict[str, int | None]
    quality: DataFrame
    ic: dict[str, DataFrame]  # by method
    groups: DataFrame
    measured: Measured  # what is measured of every date's symbols, in one pass
    risk: DataFrame | None = None
    styles: Sequence[str] = ()
    industries: Sequence[str] = ()
    #: what a section makes others of; a run writes it there and then, and gives back the written table
    keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df

    #: a base table that takes columns of a written one; a run doesn't write it again before it stores it
    settled: Callable[[str, DataFrame], DataFrame] = lambda name, df: df

    @property
    def spread(self) -> DataFrame:
        return xs.long_short(self.groups, 1, self.config.n_groups)


@dataclass
class SectionResult:
    name: str
    status: str = "ok"
    tables: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    error: str | None = None


#: What a section returns: its tables, or those and warnings.
Section = Callable[[Context], dict[str, DataFrame] | tuple[dict[str, DataFrame], list[str]]]
DEFAULT_SECTIONS: dict[str, Section] = {}
NEED_RISK: set[str] = set()


def section(name: str, needs_risk: bool = False):
    """Registers a section; a caller's own may be passed to a run instead."""

    def keep(function: Section) -> Section:
        DEFAULT_SECTIONS[name] = function
        if needs_risk:
            NEED_RISK.add(name)
        return function

    return keep


def _by_method(c: Context, make: Callable[[str, DataFrame], dict[str, DataFrame]], aliases: Sequence[str]) -> dict[str, DataFrame]:
    """Tables for each method, and names without one for the first of spearman or whatever there is."""
    out: dict[str, DataFrame] = {}
    for method, ic in c.ic.items():
        out |= make(method, ic)
    method = "spearman" if "spearman" in c.ic else next(iter(c.ic))
    return out | {a: out[f"{a}_{method}"] for a in aliases}


@section("data_quality")
def data_quality(c: Context):
    v = views.quality_view(c.settled("data_quality", c.quality))
    return {"data_quality": v.daily, "data_quality_counts": v.counts, "data_quality_ratios": v.ratios}


@section("ic_overview")
def ic_overview(c: Context):
    return _by_method(c, lambda m, ic: {f"ic_overview_{m}": views.overview(ic, c.labels)}, ["ic_overview"])


@section("cumulative_ic")
def cumulative_ic(c: Context):
    def make(m: str, ic: DataFrame):
        daily = c.settled(f"daily_ic_{m}", ic.select("trade_date", "horizon", "ic"))
        return {f"daily_ic_{m}": daily, f"cumulative_ic_{m}": ts.cumulative(daily, "ic"), f"ic_stats_{m}": ts.ic_stats(daily, c.days)}

    return _by_method(c, make, ["daily_ic", "cumulative_ic", "ic_stats"])


@section("yearly_ic")
def yearly_ic(c: Context):
    def make(m: str, ic: DataFrame):
        stats = ts.yearly_ic_stats(ic, c.days, c.config.yearly_ic_min_days, c.config.yearly_ic_include_partial_year)
        return {f"yearly_ic_stats_{m}": stats, f"yearly_mean_ic_{m}": ts.yearly_means(stats, c.labels)}

    return _by_method(c, make, ["yearly_ic_stats", "yearly_mean_ic"])


@section("factor_style_exposure", needs_risk=True)
def factor_style_exposure(c: Context):
    out = {}
    for m in c.ic:
        corr = c.settled(f"factor_style_exposure_corr_{m}", c.measured.corr(m))
        out |= {f"factor_style_exposure_corr_{m}": corr, f"factor_style_exposure_summary_{m}": ts.summary(corr, ["style"], "corr")}
    return out


def _neutralized(c: Context, name: str, industries: Sequence[str]):
    out = {}
    for m in c.ic:
        daily = c.settled(f"{name}_ic_{m}", c.measured.ic(m, f"{name.removesuffix('_neutralized')}_ic").select("trade_date", "horizon", "ic"))
        out |= {f"{name}_ic_{m}": daily, f"cumulative_{name}_ic_{m}": ts.cumulative(daily, "ic"), f"{name}_ic_stats_{m}": ts.ic_stats(daily, c.days)}
    return out | ({f"{name}_factor": neutral.neutralized(c.factor, c.risk, c.styles, industries, c.config.min_ic_stocks)} if c.config.write_neutralized_factors else {})


@section("style_neutralized_ic", needs_risk=True)
def style_neutralized_ic(c: Context):
    return _neutralized(c, "style_neutralized", ())


@section("style_industry_neutralized_ic", needs_risk=True)
def style_industry_neutralized_ic(c: Context):
    return _neutralized(c, "style_industry_neutralized", c.industries), neutral.left_out(c.measured.of("unplaced").agg(F.sum("n")).first()[0] or 0)


@section("group_exposure_diagnostics", needs_risk=True)
def group_exposure(c: Context):
    style = c.settled("group_style_exposure_daily", c.measured.legs("style_leg", "exposure"))
    industry = c.settled("group_industry_exposure_daily", c.measured.legs("industry_leg", "industry"))
    return {
        "group_style_exposure_daily": style, "group_style_exposure_summary": ts.summary(style, ["leg", "exposure"], "value"),
        "group_industry_exposure_daily": industry, "group_industry_exposure_summary": ts.summary(industry, ["leg", "industry"], "value"),
    }


def curve_names(days: dict[str, int | None], name: str) -> dict[str, str]:
    """The tables of curves_of, and the label of each."""
    return {f"{name}_{slug(x)}": x for x in days if expr.horizon_days_anywhere(x, days) is not None}


def curves_of(groups: DataFrame, dates: DataFrame, days: dict[str, int | None], name: str) -> tuple[dict[str, DataFrame], list[str]]:
    """A curve of each label that names its days anywhere, and a warning for each other."""
    own = {x: expr.horizon_days_anywhere(x, days) for x in days}
    curves = ts.group_curves(groups, dates, own)
    tables = {table: curves.where(F.col("horizon") == x).drop("horizon") for table, x in curve_names(days, name).items()}
    return tables, [f"{x} has no days; it has no cumulative curve" for x, n in own.items() if n is None]


@section("group_return")
def group_return(c: Context):
    curves, warnings = curves_of(c.groups, c.quality, c.days, "group_cumulative_returns")
    return {"daily_group_returns": c.settled("daily_group_returns", c.groups), "group_return_summary": ts.group_summary(c.groups)} | curves, warnings


@section("within_industry_group_return", needs_risk=True)
def within_industry(c: Context):
    g = c.settled("within_industry_daily_group_returns", c.measured.groups("within"))
    curves, warnings = curves_of(g, c.quality, c.days, "within_industry_group_cumulative_returns")
    return {"within_industry_daily_group_returns": g, "within_industry_group_return_summary": ts.group_summary(g)} | curves, warnings


@section("layered_group_return")
def layered(c: Context):
    return {"layered_group_return_summary": ts.layered_summary(c.groups, dict(c.config.group_return_windows))}


@section("long_short")
def long_short(c: Context):
    equivalent, _ = xs.daily_equivalent_long_short(c.groups, c.days, 1, c.config.n_groups)
    return {
        "daily_long_short_returns": c.spread, "cumulative_long_short_returns": ts.cumulative(c.spread, "spread"),
        "daily_equivalent_long_short_returns": equivalent, "cumulative_daily_equivalent_long_short_returns": ts.filled_cumulative(equivalent, "spread"),
    }


@section("group_turnover")
def group_turnover(c: Context):
    daily = c.keep("daily_group_membership_change", xs.turnover(c.factor, c.config.n_groups, c.config.min_group_stocks, c.quality))
    edges = xs.turnover_edges(daily, c.config.n_groups)
    own = daily.where(F.col("group").isin(1, c.config.n_groups)).withColumn("group", F.concat(F.lit("G"), "group"))
    return {
        "daily_group_turnover": daily, "daily_group_membership_change": daily, "group_turnover_summary": ts.summary(daily, ["group"], "turnover", ts.TURNOVER_COLUMNS),
        "group_turnover_edge_summary": ts.summary(own.unionByName(edges.select(*own.columns)), ["group"], "turnover", ts.TURNOVER_COLUMNS),
    }


@section("performance_metrics")
def performance_metrics(c: Context):
    p = ts.performance(c.spread, c.days)
    diagnostic = ["series", "diagnostic_max_drawdown", "max_drawdown_applicable", "not_applicable_reason", "hac_status"]
    return {"performance_metrics": p, "performance_diagnostics": p.select(*diagnostic)}


def selected(enabled, sections: dict[str, Section] | None, has_risk: bool) -> dict[str, Section]:
    """The sections to run: 'all' leaves out those that need absent risk data; an unknown name is an error."""
    known = DEFAULT_SECTIONS if sections is None else sections
    if enabled == "all":
        return {n: s for n, s in known.items() if has_risk or n not in NEED_RISK}
    names = [enabled] if isinstance(enabled, str) else list(enabled)
    if unknown := [n for n in names if n not in known]:
        raise KeyError(f"unknown sections: {', '.join(unknown)}")
    return {n: known[n] for n in names}


def run_section(name: str, function: Section, context: Context) -> SectionResult:
    """Plans a section; what goes wrong is kept, not raised."""
    try:
        if name in NEED_RISK and context.risk is None:
            raise ValueError("needs risk exposures")
        made = function(context)
        tables, warnings = made if isinstance(made, tuple) else (made, [])
        return SectionResult(name, tables=tables, warnings=list(warnings))
    except Exception as e:
        return SectionResult(name, "failed", error=f"{type(e).__name__}: {e}")

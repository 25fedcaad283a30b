"""What a run is asked for. Every field has a default; wrong values are refused when the object is made."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from tessera.operators.cross_section import ic_methods

COMPRESSIONS = ("zstd", "snappy", "gzip", "none")
CORE_SECTIONS = ("data_quality", "cumulative_ic", "group_return")


@dataclass(frozen=True)
class PoolDefinition:
    """A universe; without a table it is all symbols."""

    name: str
    path: str | None = None


@dataclass(frozen=True)
class DiagnosticsConfig:
    """Comparison with a library of factors; off unless a book or regimes are given."""

    enabled: bool = False
    production_book_path: str | None = None
    peer_book_path: str | None = None
    regime_path: str | None = None
    production_book_source: str = "file"
    peer_book_source: str = "file"
    regime_source: str = "file"
    baseline_suite_id: str | None = None
    baseline_book_version: str | None = None
    peer_book_version: str | None = None
    peer_pool_id: str = "research+promoted"
    hypothesis_direction: str = "unknown"  # or high_is_long, high_is_short
    idea_id: str | None = None
    version: int = 1
    regime_labels: tuple[str, ...] = ("bull", "bear", "high_vol", "low_vol")
    neutralization_layers: tuple[str, ...] = ("production_book",)
    spanning_topk: int = 20
    spanning_rounds: int = 3
    top_spanning_factors: int = 5
    topk_overlap_k: int = 50
    min_similarity_stocks: int = 30

    def __post_init__(self) -> None:
        for name in ("spanning_topk", "spanning_rounds", "top_spanning_factors", "topk_overlap_k"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be above zero")
        if self.min_similarity_stocks <= 1:
            raise ValueError("min_similarity_stocks must be above one")


@dataclass(frozen=True)
class HandoffConfig:
    """The acceptance package of one pool."""

    enabled: bool = False
    output_dir: str | None = None
    pool: str = "all"
    factor_direction: str = "high_is_long"
    entry: str = "next_open"
    data_asof: str | None = None


@dataclass(frozen=True)
class BacktestConfig:
    factor_name: str = "factor"
    output_root: str = "backtest_results"
    framework_version: str = "v2"
    selected_pools: Sequence[str] = ("all",)
    horizons: Sequence[int] = (1, 5, 10, 20)
    min_listed_days: int = 120
    tradability_filter: bool = True
    ic_methods: Sequence[str] = ("spearman",)
    min_ic_stocks: int = 30
    min_group_stocks: int = 10
    min_industry_ic_stocks: int = 10
    n_groups: int = 10
    yearly_ic_min_days: int = 60
    yearly_ic_include_partial_year: bool = True
    group_return_windows: Mapping[str, int] = field(default_factory=lambda: {"6m": 120, "1y": 250, "3y": 750, "5y": 1250})
    enabled_sections: str | Sequence[str] = "all"
    artifact_level: str = "none"
    output_layout: str = "latest_runs"
    render_plots: bool = False
    export_static_report: bool = False
    parquet_compression: str = "zstd"
    write_neutralized_factors: bool = False
    verbose: bool = True
    styles: Sequence[str] = ()
    diagnostics: DiagnosticsConfig = field(default_factory=DiagnosticsConfig)
    handoff: HandoffConfig = field(default_factory=HandoffConfig)
    # accepted for compatibility, without effect
    listed_days_source: str = "derived"
    analysis_windows: Sequence[str] = ()
    winsorize_factor: bool = False
    standardize_factor: bool = False

    def __post_init__(self) -> None:
        ic_methods(self.ic_methods)
        for name, allowed in (("artifact_level", ("none", "full")), ("output_layout", ("latest_runs", "timestamp")), ("parquet_compression", COMPRESSIONS)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}; given: {getattr(self, name)}")
        if self.yearly_ic_min_days <= 0:
            raise ValueError("yearly_ic_min_days must be above zero")
        if not self.horizons or any(int(h) <= 0 for h in self.horizons):
            raise ValueError("horizons are whole days above zero")
        if any(n <= 0 for n in self.group_return_windows.values()):
            raise ValueError("group_return_windows are numbers of dates above zero")

"""Tessera: Spark-native evaluation of cross-sectional signals on long panels."""

from importlib import import_module

__version__ = "0.1.0"

_PLACES = {
    "run_factor_backtest": "tessera.plans.api", "run_factor_backtest_data": "tessera.plans.api", "run_factor_backtest_minimal": "tessera.plans.api",
    "render_factor_backtest_report": "tessera.plans.api", "load_backtest_result": "tessera.plans.api", "LoadedBacktestResult": "tessera.plans.api", "RunResult": "tessera.plans.api",
    "ICView": "tessera.plans.views", "GroupReturnView": "tessera.plans.views", "QualityView": "tessera.plans.views",
    "BacktestConfig": "tessera.plans.config", "DiagnosticsConfig": "tessera.plans.config", "HandoffConfig": "tessera.plans.config", "PoolDefinition": "tessera.plans.config",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(name)
    return getattr(import_module(_PLACES[name]), name)

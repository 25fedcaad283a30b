"""Exports for a factor library: diagnostics against its books, and the acceptance package.

Only what can be computed is written; what can't be read is a warning.
"""

from __future__ import annotations

import csv
import io
import math
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import diagnostics
from tessera.plans.config import BacktestConfig
from tessera.plans.files import Files
from tessera.sources import books

#: Fixed pools and horizons of the exchange format.
POOLS, HORIZONS = ("all", "hs300_pool", "zz1000_pool", "zz2000_pool"), (1, 5, 10, 20)


def plain(x: Any) -> Any:
    """x as JSON can hold it: what isn't finite is null."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def horizon_keys(days: dict[str, int | None]) -> dict[str, str]:
    """Of each contract horizon the first label with its days."""
    out: dict[str, str] = {}
    for label, n in days.items():
        if n in HORIZONS and str(n) not in out:
            out[str(n)] = label
    return {str(h): out[str(h)] for h in HORIZONS if str(h) in out}


def without_missing(value: Any, keep: tuple[str, ...] = ()) -> Any:
    """value without the keys, at any depth, that are null and not to be kept."""
    if isinstance(value, dict):
        return {k: without_missing(v, keep) for k, v in value.items() if v is not None or k in keep}
    return [without_missing(v, keep) for v in value] if isinstance(value, list) else value


def in_order(keys, order) -> list[str]:
    return [str(x) for x in order if str(x) in set(map(str, keys))]


def base_meta(contexts: dict, version: str) -> dict:
    days = diagnostics.trading_days([c.factor for c in contexts.values()]).first()
    return {"as_of_start": days["start"] and str(days["start"]), "as_of_end": days["end"] and str(days["end"]), "framework_version": version, "n_trading_days": days["n"]}


def with_meta(base: dict, pools, horizons=None, **versions: str | None) -> dict:
    covered = {"pools": in_order(pools, POOLS)} | ({"horizons": in_order(horizons, HORIZONS)} if horizons is not None else {})
    return without_missing(base | versions) | {"coverage": covered}


def crowding(context, book, config: BacktestConfig) -> dict | None:
    """One pool's cell: how like the most similar peer is."""
    d = config.diagnostics
    similar = diagnostics.similarity(context.factor, book, d.min_similarity_stocks).collect()
    if not similar:
        return None
    first = similar[0]
    own = diagnostics.top_overlap(context.factor, book.where(F.col("factor_id") == first["factor_id"]), d.topk_overlap_k, d.min_similarity_stocks).first()
    cell = {
        "n_peers": book.select("factor_id").distinct().count(), "max_abs_rankcorr": first["mean_abs"], "peak_abs_rankcorr": first["max_abs"], "max_corr_peer": first["factor_id"],
        "n_peers_above_0.7": sum(r["mean_abs"] > diagnostics.CROWDED_ABOVE for r in similar), "topk_overlap": own["overlap"] if own else None, "topk_k": d.topk_overlap_k, "n_obs": first["n_obs"],
        "operator_graph_similarity": None, "operator_graph_similarity_status": "pending(dsl)",
    }
    return without_missing(plain(cell), ("operator_graph_similarity",))


def diversity(context, book, config: BacktestConfig) -> dict | None:
    d = config.diagnostics
    similar = diagnostics.similarity(context.factor, book, d.min_similarity_stocks).first()
    if similar is None:
        return None
    found = {"version": d.version, "max_similarity_to_book": similar["mean_abs"], "novelty": 1 - similar["mean_abs"], "max_similarity_peer": similar["factor_id"], "similarity_type": "mean_abs_rankcorr", "n_obs": similar["n_obs"]}
    return found | ({"idea_id": d.idea_id} if d.idea_id else {})


def spanning(context, book, config: BacktestConfig, keep=None) -> dict | None:
    """One pool's cell: what is left of the factor once the most similar factors of the book are taken out."""
    d = config.diagnostics
    rounds, left = diagnostics.spanning(context.factor, book, context.returns, d.spanning_topk, d.spanning_rounds, d.min_similarity_stocks, keep, d.top_spanning_factors)
    if not rounds:
        return None
    peers = [p for r in rounds for p in r["peers"]]
    gain = {r["horizon"]: r for r in diagnostics.spanned_r2(left, book, context.returns, peers, d.min_similarity_stocks).collect()}
    horizons = {}
    for key, label in horizon_keys(context.days).items():
        ic, r2 = rounds[-1]["ic"].get(label), gain.get(label)
        if ic or r2:
            each = [(r, r["ic"].get(label) or {}) for r in rounds]
            horizons[key] = without_missing(plain({
                "incremental_ic": ic and ic["mean"], "incremental_ic_t": ic and ic["t_stat"], "incremental_r2": r2 and r2["mean"], "n_obs": max(x["n_obs"] for x in (ic, r2) if x),
                "residualization_rounds": [{"round": r["round"], "n_factors_removed": len(r["peers"]), "factor_ids": r["peers"], "residual_ic": x.get("mean"), "residual_ic_t": x.get("t_stat"), "n_obs": x.get("n_obs", 0)} for r, x in each],
            }))
    top = [{"factor_id": name, "contribution": value, "contribution_type": "abs_rankcorr"} for name, value in rounds[0]["most_like"]]
    return {"top_spanning_factors": top, "horizons": horizons}


def mechanism(context, regimes, config: BacktestConfig) -> dict:
    """One pool's cell by horizon: whether groups are in order, and the rank IC has the expected sign in each regime."""
    d = config.diagnostics
    ic = diagnostics.observed_ic(context.factor, context.returns, d.min_similarity_stocks)
    mono = {r["horizon"]: r["monotonicity"] for r in diagnostics.monotonicity(context.groups).collect()}
    counts = {r["horizon"]: r["n"] for r in ic.groupBy("horizon").agg(F.count("ic").alias("n")).collect()}
    by = {(r["horizon"], r["regime"]): r for r in diagnostics.regime_ic(ic, regimes, d.regime_labels).collect()} if regimes is not None else {}
    out = {}
    for key, label in horizon_keys(context.days).items():
        if mono.get(label) is None and not counts.get(label):
            continue
        cell = {"group_monotonicity": mono.get(label), "n_obs": counts.get(label, 0)}
        if regimes is not None:
            own = {x: by[label, x] for x in d.regime_labels if (label, x) in by}
            detail = {x: {"ic": r["ic_mean"], "sign_matches_hypothesis": diagnostics.sign_matches(r["ic_mean"], d.hypothesis_direction), "n_obs": r["n_obs"]} for x, r in own.items()}
            told = [x["sign_matches_hypothesis"] for x in detail.values() if x["sign_matches_hypothesis"] is not None]
            cell |= ({"regime_detail": detail} if detail else {}) | {"regime_sign_consistency": sum(told) / len(told) if told else None}
        out[key] = without_missing(plain(cell), ("regime_sign_consistency", "sign_matches_hypothesis"))
    return out


def _merged(pools: dict) -> list[str]:
    return in_order({h for cell in pools.values() for h in cell["horizons"]}, HORIZONS)


def export(spark: SparkSession, files: Files, run_dir: str, config: BacktestConfig, contexts: dict) -> list[str]:
    """Writes diagnostics/*.json under the run; returns warnings."""
    d, warnings = config.diagnostics, []

    def load(path: str | None, source: str, what: str, make):
        if path is None:
            return None
        if source != "file":
            warnings.append(f"{what}: source {source} is reserved; left out")
            return None
        return books.optional(what, lambda: make(books.read_frame(spark, path)), warnings)

    production = load(d.production_book_path, d.production_book_source, "production book", books.normalize_book)
    peers = load(d.peer_book_path, d.peer_book_source, "peer book", books.normalize_book)
    regimes = load(d.regime_path, d.regime_source, "regimes", lambda raw: books.normalize_regimes(raw, d.regime_labels))
    own = {p: contexts[p] for p in POOLS if p in contexts}
    if not own:
        return warnings
    base, parts = base_meta(own, config.framework_version), {}
    steps = iter(range(1 << 30))

    def keep(df):
        path = f"{run_dir}/.rounds/{next(steps)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def cells(make, *how) -> dict:
        found = {p: make(c, *how) for p, c in own.items()}
        return {p: x for p, x in found.items() if x}

    if production is not None:
        found = {p: x for p, x in cells(spanning, production, config, keep).items() if x["horizons"]}
        if found:
            suite = d.baseline_suite_id or d.baseline_book_version or "production_book"
            parts["spanning"] = {
                "status": "computed", "meta": with_meta(base, found, _merged(found), baseline_book_version=d.baseline_book_version or suite), "baseline_suite_id": suite, "neutralization_layers": list(d.neutralization_layers),
                "spanning_method": {"type": "iterative_topk_residualization", "topk": d.spanning_topk, "rounds": d.spanning_rounds}, "top_spanning_factors": found.get("all", next(iter(found.values())))["top_spanning_factors"], "pools": found,
            }
    if peers is not None:
        if found := cells(crowding, peers, config):
            parts["crowding"] = {"status": "computed", "meta": with_meta(base, found, peer_book_version=d.peer_book_version), "pool_id": d.peer_pool_id, "pools": found}
        if "all" in own and (value := diversity(own["all"], peers, config)):
            parts["diversity"] = {"status": "computed", "meta": with_meta(base, ["all"], peer_book_version=d.peer_book_version)} | value
    found = {p: {"horizons": x} for p, x in cells(mechanism, regimes, config).items()}
    if found:
        parts["mechanism_consistency"] = {"status": "computed", "meta": with_meta(base, found, _merged(found)), "hypothesis_direction": d.hypothesis_direction, "pools": found}
        if regimes is not None:
            parts["mechanism_consistency"]["regimes"] = list(d.regime_labels)
    for name, value in parts.items():
        files.write_json(f"{run_dir}/diagnostics/{name}.json", plain(value))
    files.remove(f"{run_dir}/.rounds") if files.exists(f"{run_dir}/.rounds") else None
    return warnings


def notes(meta: dict, pool: str, tables) -> str:
    """What the package holds, for whoever receives it."""
    return "\n".join([
        f"# {meta['factor_name']}, run {meta['run_id']}", "",
        f"Dates {meta['start_date']} to {meta['end_date']}; pool {pool}; returns {', '.join(meta['labels'])}.", "",
        "| file | columns |", "|-|-|", *[f"| {name}.csv | {', '.join(df.columns)} |" for name, df in tables.items()], "",
        "A value of a date is known after its close; returns run from the next session's open. Empty is missing.", "",
    ])


def as_csv(df, columns=None) -> str:
    """The table with a header, quoted where a value needs it."""
    from tessera.plans.report import number

    out = io.StringIO()
    write = csv.writer(out, lineterminator="\n").writerow
    write(columns or df.columns)
    for row in df.select(*(columns or df.columns)).collect():
        write([number(v) for v in row])
    return out.getvalue()


#: Fixed names of the package's tables, and of the sections that make them.
PACKAGE = {"ic_stats_spearman": "cumulative_ic", "group_return_summary": "group_return", "performance_metrics": "performance_metrics", "group_turnover_edge_summary": "group_turnover", "data_quality": "data_quality"}
PENDING = ("spanning", "crowding", "mechanism_consistency", "diversity")


def handoff(files: Files, run_dir: str, config: BacktestConfig, meta: dict, log: dict, results: dict, commit: str = "unknown") -> str:
    """The acceptance package of one pool: five small tables as CSV, the run's facts, and a note of what is pending."""
    h = config.handoff
    root, own = h.output_dir or f"{run_dir}/handoff", results.get(h.pool)
    if own is None:
        raise ValueError(f"the package needs pool {h.pool}")
    tables = {name: own[section].tables[name] for name, section in PACKAGE.items() if section in own and own[section].status == "ok" and name in own[section].tables}
    if missing := [x for x in PACKAGE if x not in tables]:
        raise ValueError(f"the package lacks {', '.join(missing)}")
    there = {r["horizon"] for r in tables["ic_stats_spearman"].select("horizon").collect()}
    if absent := [h_ for h_ in config.horizons if f"{h_}d" not in there]:
        raise ValueError(f"horizons without returns: {absent}")
    sample = f"{root}/sample_latest"
    files.remove(sample) if files.exists(sample) else None
    for name, df in tables.items():
        text = as_csv(df.orderBy(*[c for c in ("trade_date", "group", "horizon", "series") if c in df.columns]))
        if text.count("\n") < 2:
            raise ValueError(f"{h.pool}: {name} is empty")
        files.write(f"{sample}/pools/{h.pool}/tables/{name}.csv", text)
    facts = {"factor_direction": h.factor_direction, "entry": h.entry, "data_asof": h.data_asof or meta["end_date"], "pool": h.pool, "commit": commit}
    files.write_json(f"{sample}/run_meta.json", meta | facts)
    files.write_json(f"{sample}/run_log.json", {"sections": {h.pool: log["sections"].get(h.pool, {})}, "warnings": log["warnings"]})
    for name in PENDING:
        files.write_json(f"{sample}/diagnostics/{name}.json", {"status": "pending(company)"})
    files.write(f"{root}/commit.txt", f"{commit}\n")
    files.write(f"{root}/README.md", notes(meta, h.pool, tables))
    files.write(f"{root}/schema_notes.md", "\n".join(["# Tables", "", *[f"* {name}.csv: {', '.join(f'{c} {kind}' for c, kind in df.dtypes)}" for name, df in tables.items()], ""]))
    return root

"""Whole runs: publication, reading back, views, failure isolation; and the sources' checks."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.plans import api, library, store
from tessera.plans.config import BacktestConfig, DiagnosticsConfig, HandoffConfig
from tessera.plans.files import Files
from tessera.plans.sections import DEFAULT_SECTIONS
from tessera.sources import books, factors, market, returns, risk
from tessera.sources.common import SourceError

DAYS = list(pd.bdate_range("2024-01-01", periods=35).date)
SYMBOLS = [f"S{i:03d}" for i in range(40)]


@pytest.fixture(scope="module")
def inputs(spark):
    factor = spark.createDataFrame([(d, s, float((i + t) % 40)) for t, d in enumerate(DAYS) for i, s in enumerate(SYMBOLS)], "trade_date date, symbol string, value double")
    rows = [(d, s, 10.0 + ((i * 37 + t * 11) % 23) / 10 + t * 0.01 * (i % 5)) for t, d in enumerate(DAYS) for i, s in enumerate(SYMBOLS)]
    px = spark.createDataFrame(rows, "trade_date date, symbol string, open_price double").withColumns(
        {"high_price": F.col("open_price") + 1, "low_price": F.col("open_price") - 1, "limit_up_price": F.col("open_price") * 2, "limit_down_price": F.lit(0.1), "is_st": F.lit(0.0), "is_suspended": F.lit(0.0), "listed_days": F.lit(500)}
    )
    exposures = factor.select("trade_date", "symbol", (F.hash("symbol", "trade_date") % 100).cast("double").alias("size"), F.array(F.when(F.col("symbol") < "S020", "bank").otherwise("tech")).alias("industries"))
    return factor, px, exposures


def test_run_load_views_report(spark, inputs, tmp_path):
    factor, px, exposures = inputs
    book = factor.withColumn("factor_id", F.lit("p1")).withColumn("value", F.col("value") + (F.hash("symbol") % 5))
    book.select(F.col("trade_date").alias("date"), "symbol", "factor_id", "value").write.parquet(f"{tmp_path}/book.parquet")
    config = BacktestConfig(factor_name="f", output_root=str(tmp_path / "out"), horizons=(1, 5), ic_methods=("spearman", "pearson"), min_ic_stocks=10, selected_pools=("all", "half"), verbose=False, export_static_report=True, render_plots=True,
                            artifact_level="full", write_neutralized_factors=True, diagnostics=DiagnosticsConfig(True, f"{tmp_path}/book.parquet", f"{tmp_path}/book.parquet", f"{tmp_path}/none.csv", spanning_topk=1, spanning_rounds=1, min_similarity_stocks=10), handoff=HandoffConfig(True))
    members = factor.where("symbol < 'S030'").select("trade_date", "symbol")
    done = api.run_factor_backtest(spark, factor, px, config, pools={"half": members}, risk=exposures, run_id="r1")
    assert {r.status for own in done.results.values() for r in own.values()} == {"ok"}
    assert set(done.results["all"]) == set(DEFAULT_SECTIONS) and any("regimes left out" in w for w in done.warnings)
    run = api.load_backtest_result(spark, factor_name="f", output_root=config.output_root)
    assert run.run_dir == done.run_dir and run.available_pools == ["all", "half"]
    ic = run.read_table("daily_ic", "half")
    assert ic.count() == 2 * 35 and ic.columns == ["trade_date", "horizon", "ic"]
    # the last date has no next one to trade on
    assert run.read_table("data_quality").where("valid_factor_count = 0").count() == 1
    assert set(r.horizon for r in run.read_table("ic_stats").collect()) == {"1d", "5d"}
    view = run.ic_view("all", "pearson", "style_industry", DAYS[10], DAYS[20])
    assert view.curves.count() == 22 and view.curves.where("trade_date = date'%s'" % DAYS[10]).first().cumulative == 0
    groups = run.group_return_view("all", False, DAYS[5], DAYS[25])
    assert {round(r.nav, 12) for r in groups.curves.where("trade_date = date'%s'" % DAYS[5]).collect()} == {1.0}
    assert run.group_return_view("all", True).daily.count() > 0 and run.quality_view("all", DAYS[1], DAYS[2]).counts.count() == 2
    assert run.read_artifact("aligned_factor").count() == 35 * 40
    path = api.render_factor_backtest_report(spark, done.run_dir)
    files = Files(spark)
    assert "<svg" in files.read(path)
    assert files.names(f"{done.run_dir}/diagnostics") == ["crowding.json", "diversity.json", "mechanism_consistency.json", "spanning.json"]
    assert files.names(f"{done.run_dir}/handoff/sample_latest/pools/all/tables") == ["data_quality.csv", "group_return_summary.csv", "group_turnover_edge_summary.csv", "ic_stats_spearman.csv", "performance_metrics.csv"]
    assert {"README.md", "commit.txt", "schema_notes.md", "sample_latest"} <= set(files.names(f"{done.run_dir}/handoff"))
    assert files.read_json(f"{done.run_dir}/handoff/sample_latest/diagnostics/spanning.json") == {"status": "pending(company)"}
    assert run.read_artifact("style_neutralized_factor").count() == 35 * 40 and run.read_artifact("daily_ic_pearson", "half").count() == 70
    assert files.read(run.plot_path("cumulative_ic")).startswith("<svg xmlns")
    with pytest.raises(FileExistsError):
        api.run_factor_backtest(spark, factor, px, config, pools={"half": members}, run_id="r1")
    with pytest.raises(KeyError):
        run.read_table("nothing")
    with pytest.raises(KeyError):
        run.read_table("data_quality", "none")


def test_diagnostics_of_a_library(spark, tmp_path):
    """A candidate with two peers and a production book of two: one of either is the candidate itself, scaled."""
    days, symbols = DAYS[:18], [f"S{i:02d}" for i in range(30)]
    value = lambda i, t: float((i * 7 + t * 3) % 30)
    factor = spark.createDataFrame([(d, s, value(i, t)) for t, d in enumerate(days[:10]) for i, s in enumerate(symbols)], "trade_date date, symbol string, value double")
    px = spark.createDataFrame([(d, s, 10.0 + value(i, t) / 10 + t) for t, d in enumerate(days) for i, s in enumerate(symbols)], "trade_date date, symbol string, open_price double")

    def book(name, **made):
        rows = [(d, s, f, g(i, t)) for f, g in made.items() for t, d in enumerate(days) for i, s in enumerate(symbols)]
        spark.createDataFrame(rows, "date date, symbol string, factor_id string, value double").write.parquet(f"{tmp_path}/{name}.parquet")

    book("production", scaled=lambda i, t: 0.85 * value(i, t), minus=lambda i, t: -float(i))
    book("peers", rank=lambda i, t: value(i, t), cycle=lambda i, t: float(i % 7))
    spark.createDataFrame([(d, t % 2 == 0, False) for t, d in enumerate(days)], "date date, bull boolean, bear boolean").write.parquet(f"{tmp_path}/regimes.parquet")
    asked = DiagnosticsConfig(True, *(f"{tmp_path}/{x}.parquet" for x in ("production", "peers", "regimes")), regime_labels=("bull", "bear"), min_similarity_stocks=10, topk_overlap_k=5, spanning_topk=1, spanning_rounds=2, hypothesis_direction="high_is_short", peer_book_version="p7", idea_id="i")
    config = BacktestConfig(factor_name="d", output_root=str(tmp_path / "out"), horizons=(1, 5), min_ic_stocks=10, tradability_filter=False, n_groups=5, verbose=False, diagnostics=asked)
    done = api.run_factor_backtest(spark, factor, px, config, sections={x: DEFAULT_SECTIONS[x] for x in ("data_quality", "cumulative_ic", "group_return")})
    read = lambda x: Files(spark).read_json(f"{done.run_dir}/diagnostics/{x}.json")
    crowding, diversity, spanning, mechanism = map(read, ("crowding", "diversity", "spanning", "mechanism_consistency"))
    cell = crowding["pools"]["all"]
    assert crowding["status"] == "computed" and crowding["pool_id"] == "research+promoted" and crowding["meta"]["coverage"] == {"pools": ["all"]} and crowding["meta"]["peer_book_version"] == "p7"
    assert crowding["meta"]["n_trading_days"] == 10 and crowding["meta"]["as_of_start"] == str(days[0]) and crowding["meta"]["as_of_end"] == str(days[9])
    assert cell["n_peers"] == 2 and cell["max_corr_peer"] == "rank" and cell["max_abs_rankcorr"] == pytest.approx(1) and cell["n_peers_above_0.7"] == 1
    assert cell["topk_overlap"] == 1 and cell["topk_k"] == 5 and cell["n_obs"] == 10 and cell["operator_graph_similarity"] is None and cell["operator_graph_similarity_status"] == "pending(dsl)"
    assert diversity["max_similarity_peer"] == "rank" and diversity["novelty"] == pytest.approx(0) and diversity["idea_id"] == "i" and diversity["version"] == 1
    own = spanning["pools"]["all"]
    assert own["top_spanning_factors"][0]["factor_id"] == "scaled" and spanning["baseline_suite_id"] == "production_book" and spanning["spanning_method"] == {"type": "iterative_topk_residualization", "topk": 1, "rounds": 2}
    assert set(own["horizons"]) <= {"1", "5"} and [r["factor_ids"] for r in own["horizons"]["1"]["residualization_rounds"]][0] == ["scaled"]
    one = mechanism["pools"]["all"]["horizons"]["1"]
    ic = api.load_backtest_result(spark, factor_name="d", output_root=config.output_root).read_table("daily_ic").where("horizon = '1d' and ic is not null").toPandas()
    bull = ic[[days.index(x) % 2 == 0 for x in ic.trade_date]].ic
    assert one["regime_detail"]["bull"]["ic"] == pytest.approx(bull.mean()) and one["regime_detail"]["bull"]["n_obs"] == len(bull) and "bear" not in one["regime_detail"]
    assert one["regime_detail"]["bull"]["sign_matches_hypothesis"] == (bull.mean() < 0) and one["regime_sign_consistency"] == float(bull.mean() < 0) and mechanism["regimes"] == ["bull", "bear"]


def test_files_replace_whole(spark, tmp_path):
    files = Files(spark)
    for text in ("one", "two, and more"):
        files.write(f"{tmp_path}/x/latest.json", text)
        assert files.read(f"{tmp_path}/x/latest.json") == text
    assert [n for n in files.names(f"{tmp_path}/x") if not n.startswith(".")] == ["latest.json"]
    table = spark.createDataFrame([('a,"b"', 1.5), ("c", None)], "name string, x double")
    assert library.as_csv(table.orderBy("name")) == 'name,x\n"a,""b""",1.5\nc,\n'


def test_a_failing_derived_table_fails_its_section(spark, inputs, tmp_path):
    factor, px, _ = inputs
    config = BacktestConfig(factor_name="h", output_root=str(tmp_path), horizons=(1,), min_ic_stocks=10, verbose=False)
    late = lambda c: {"mine_summary": c.factor.select(F.raise_error(F.lit("late")).alias("x"))}
    done = api.run_factor_backtest(spark, factor, px, config, sections={"data_quality": DEFAULT_SECTIONS["data_quality"], "mine": late})
    assert done.results["all"]["mine"].status == "failed" and done.results["all"]["data_quality"].status == "ok"


def test_failures(spark, inputs, tmp_path):
    factor, px, _ = inputs
    config = BacktestConfig(factor_name="g", output_root=str(tmp_path), horizons=(1,), min_ic_stocks=10, verbose=False)

    def broken(context):
        raise RuntimeError("no")

    done = api.run_factor_backtest(spark, factor, px, config, sections={"data_quality": DEFAULT_SECTIONS["data_quality"], "mine": broken}, run_id="a")
    assert done.results["all"]["mine"].status == "failed" and "no" in done.results["all"]["mine"].error
    with pytest.raises(RuntimeError):
        api.run_factor_backtest(spark, factor, px, config, sections={"data_quality": broken}, run_id="b")
    assert api.load_backtest_result(spark, factor_name="g", output_root=str(tmp_path)).run_dir.endswith("/a")
    for wrong in ({"enabled_sections": ["nothing"]}, {"selected_pools": ("nowhere",)}):
        with pytest.raises(KeyError):
            api.run_factor_backtest(spark, factor, px, BacktestConfig(output_root=str(tmp_path), verbose=False, **wrong))
    with pytest.raises(ValueError):
        api.run_factor_backtest(spark, factor, px.drop("is_st"), config, run_id="c")


def test_minimal(spark, inputs):
    factor, px, _ = inputs
    config = BacktestConfig(factor_name="m", horizons=(1, 5), min_ic_stocks=10, verbose=False)
    row = api.run_factor_backtest_minimal(spark, factor, px, config).first()
    assert row.factor_name == "m" and row.pool == "all" and row.coverage_mean == pytest.approx(34 / 35) and row.ic_mean_5d is not None and row.long_short_t_stat_hac_1d is not None


def test_config_and_store_guards(spark, tmp_path):
    for wrong in ({"artifact_level": "some"}, {"output_layout": "x"}, {"parquet_compression": "lz"}, {"yearly_ic_min_days": 0}, {"ic_methods": ()}, {"horizons": (0,)}):
        with pytest.raises(ValueError):
            BacktestConfig(**wrong)
    files = Files(spark)
    files.write_json(f"{tmp_path}/f/latest.json", {"schema_version": "1.0", "path": "../x"})
    with pytest.raises(ValueError):
        store.resolve(files, str(tmp_path), "f")
    with pytest.raises(ValueError):
        store.resolve(files, str(tmp_path), "f", "../x")
    with files.lock(f"{tmp_path}/lock"), pytest.raises(TimeoutError), files.lock(f"{tmp_path}/lock", timeout=0.2):
        pass
    assert store.is_base("daily_ic_spearman") and not store.is_base("style_neutralized_ic_stats_spearman") and not store.is_base("group_return_summary")


def test_factor_layouts_and_checks(spark, tmp_path):
    wide = pd.DataFrame([[1.0, None], [float("inf"), 4.0]], index=pd.to_datetime(["2025-01-02", "2025-01-03"]), columns=["A", "B"])
    got = {(str(r.trade_date), r.symbol): r.value for r in factors.normalize(factors.from_pandas(spark, wide)).collect()}
    assert got == {("2025-01-02", "A"): 1.0, ("2025-01-02", "B"): None, ("2025-01-03", "A"): float("inf"), ("2025-01-03", "B"): 4.0}
    for bad in ([("2025-01-02 09:30:00", "A", "1")], [("2025-01-02", "A", "x")], [("never", "A", "1")], [("2025-01-02", "A", "1"), ("2025-01-02", "A", "2")]):
        with pytest.raises(SourceError):
            factors.normalize(spark.createDataFrame(bad, "date string, symbol string, factor_value string"))
    with pytest.raises(SourceError):
        factors.from_pandas(spark, pd.DataFrame([[1.0]], index=[3], columns=["A"]))
    with pytest.raises(SourceError):
        factors.from_pandas(spark, pd.DataFrame([[1.0, 2.0]], index=pd.to_datetime(["2025-01-02"]), columns=[1, "1"]))
    folder = tmp_path / "factor_x" / "factor_x.parquet"
    folder.mkdir(parents=True)
    wide.iloc[:1].rename_axis("trade_date").reset_index().to_parquet(folder / "a.parquet")
    wide.iloc[1:].rename(columns={"B": "C"}).rename_axis("trade_date").reset_index().to_parquet(folder / "b.parquet")
    path = factors.resolve_path(spark, str(tmp_path), "x")
    assert factors.load(spark, path).count() == 4
    wide.iloc[:1].rename_axis("trade_date").reset_index().to_parquet(folder / "c.parquet")
    with pytest.raises(SourceError):
        factors.load(spark, path)
    with pytest.raises(FileNotFoundError):
        factors.resolve_path(spark, str(tmp_path), "y")


def test_other_sources(spark):
    r = returns.normalize(spark.createDataFrame([("2025-01-02", "A", "0.1"), ("2025-01-02", "B", "bad")], "date string, asset string, ret string"))
    assert {x.symbol: x.ret for x in r.collect()} == {"A": 0.1, "B": None}
    px = spark.createDataFrame([(dt.date(2025, 1, 2), "A", 1.0)], "trade_date date, symbol string, open_price double")
    made = returns.build(spark, px, [5, 1], {"ext": {"data": r.withColumnRenamed("ret", "return"), "horizon_days": 3}})
    assert made.labels == ["1d", "5d", "ext"] and made.days == {"5d": 5, "1d": 1, "ext": 3}
    for bad in ({"1d": r}, {"e": {"data": r, "horizon_days": 0}}, {"e": {}}):
        with pytest.raises(ValueError):
            returns.build(spark, px, [1], bad)
    raw = spark.createDataFrame([("2025-01-02", "A", 1.0, 0.0, 1.0, 2), ("2025-01-02", "A", 9.0, 0.0, 1.0, 1)], "date string, symbol string, size double, bank double, tech double, v int")
    got = risk.latest_risk(raw, "v", styles=("size",)).first()
    assert got["size"] == 1.0 and got.industries == ["tech"]
    with pytest.raises(SourceError):
        risk.normalize_risk(raw.drop("v"), ("size",))
    assert "FINAL" in risk.risk_query("2025-01-01", "2025-01-02", "db.t", ["bank"])
    for args in (("2025-01-03", "2025-01-02", "t", []), ("2025-01-01", "2025-01-02", "t;x", []), ("2025-01-01", "2025-01-02", "t", ["a`b"])):
        with pytest.raises(ValueError):
            risk.risk_query(*args)
    with pytest.raises(SourceError):
        market.normalize(raw)
    with pytest.raises(RuntimeError):
        market.load(lambda q: raw.limit(0), "2025-01-01", "2025-01-02")
    assert "LEFT JOIN stock_st" in market.market_query("a", "b")
    flags = spark.createDataFrame([("2025-01-02", " Yes ", 2, None), ("2025-01-03", "", 0, True)], "date string, bull string, bear int, x boolean")
    assert [tuple(r)[1:] for r in books.normalize_regimes(flags, ["bull", "bear", "x"]).collect()] == [(True, True, False), (False, False, True)]
    with pytest.raises(SourceError):
        books.normalize_regimes(flags.withColumn("bull", F.lit("perhaps")), ["bull"])
    with pytest.raises(KeyError):
        market.pools(spark, ["x"], {"all": None})


def test_stream_refresh(spark, tmp_path):
    from tessera.streaming import refresh_on_arrival

    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = [(DAYS[0], "A", 1.0), (DAYS[0], "B", 3.0), (DAYS[1], "A", 5.0)]
    spark.createDataFrame(rows, "trade_date date, symbol string, value double").write.parquet(source)
    held = spark.read.parquet(source)
    stream = spark.readStream.schema(held.schema).parquet(source)
    compute = lambda dates: spark.read.parquet(source).join(dates, "trade_date", "left_semi").groupBy("trade_date").agg(F.avg("value").alias("mean"))
    refresh_on_arrival(stream, compute, out, f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([(DAYS[1], "B", 7.0)], "trade_date date, symbol string, value double").write.mode("append").parquet(source)
    refresh_on_arrival(stream, compute, out, f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["mean"] for r in spark.read.parquet(out).collect()) == [2.0, 6.0]


def test_legacy_layout(spark, tmp_path):
    from tessera.plans.legacy import LegacyResult

    root = tmp_path / "run" / "all" / "tables"
    root.mkdir(parents=True)
    (root / "daily_ic.csv").write_text("trade_date,ic_1d,ic_ext\n2025-01-02,0.1,\n2025-01-03,-0.2,0.5\n")
    (root / "daily_group_returns.csv").write_text("trade_date,horizon,group,group_return\n2025-01-02,1d,10,0.01\n")
    run = LegacyResult(spark, str(tmp_path / "run"))
    assert run.available_pools == ["all"] and run.available_tables() == ["daily_group_returns", "daily_ic"]
    assert {(str(r.trade_date), r.horizon): r.ic for r in run.read_table("daily_ic").collect()} == {("2025-01-02", "1d"): 0.1, ("2025-01-02", "ext"): None, ("2025-01-03", "1d"): -0.2, ("2025-01-03", "ext"): 0.5}
    assert run.read_table("daily_group_returns").first()["group"] == 10
    with pytest.raises(ValueError):
        run.read_table("../x")


def test_resolving_risk(spark):
    assert risk.resolve("none") is None
    for args in (("server",), ("elsewhere",)):
        with pytest.raises(ValueError):
            risk.resolve(*args)
    raw = spark.createDataFrame([("2025-01-02", "A", 1.0, 7.0)], "date string, symbol string, size double, industry double")
    got = risk.resolve("server", lambda q: raw, "2025-01-01", "2025-01-02", table="db.t", styles=("size",))
    assert got.first().industries == ["7"] and risk.industry_names(got) == ["7"]
    with pytest.raises(RuntimeError):
        risk.load(lambda q: raw.limit(0), "2025-01-01", "2025-01-02", "t", styles=("size",))
    assert market.registry("/pools")["hs300_pool"] == "/pools/hs300_pool.csv" and market.registry("/pools")["all"] is None

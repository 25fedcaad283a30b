"""The one pass of a run over its joined rows, against the operators that say the same one statistic at a time."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import cross_section as xs
from tessera.operators import daily, neutral, panel
from tessera.plans import api
from tessera.plans.config import BacktestConfig
from tessera.plans.sections import DEFAULT_SECTIONS
from tessera.sources import returns

LABELS, STYLES, INDUSTRIES, METHODS = ["1d", "3d", "ext"], ("a", "b"), ("x", "y", "z"), ("spearman", "pearson")


@pytest.fixture(scope="module")
def odd(spark):
    """Ties, signed zeros, infinities, gaps, symbols without risk or industry, in two industries, a date of few rows and one without values."""
    rnd, days, symbols = random.Random(3), [dt.date(2024, 1, d) for d in range(1, 13)], [f"é{i}" if i % 5 else f"Z{i}" for i in range(60)]
    cells = [(d, s) for t, d in enumerate(days) for s in symbols if rnd.random() < (0.05 if t == 4 else 0.9)]
    pick = lambda: rnd.choice([None, float("inf"), float("-inf"), -0.0, 0.0, 1.0, 2.0, 2.0, rnd.random(), rnd.random() * 9, rnd.gauss(0, 1)])
    factor = spark.createDataFrame([(d, s, None if d == days[7] else pick()) for d, s in cells], "trade_date date, symbol string, value double")
    px = spark.createDataFrame([(d, s, rnd.choice([None, 0.0, 3.0, 5.0] + [1 + rnd.random()] * 12)) for d, s in cells if rnd.random() < 0.95], "trade_date date, symbol string, open_price double")
    ext = spark.createDataFrame([(d, s, pick()) for d, s in cells[::2]], "trade_date date, symbol string, ret double")
    kinds = [["x"], ["x"], ["y"], ["y"], ["z"], ["x", "z"], [], None]
    risk = spark.createDataFrame([(d, s, pick(), rnd.gauss(0, 1), rnd.choice(kinds)) for d, s in cells if rnd.random() < 0.95], "trade_date date, symbol string, a double, b double, industries array<string>")
    members = spark.createDataFrame([c for c in cells if c[1] > "Z3" and rnd.random() < 0.9], "trade_date date, symbol string")
    return factor, px, {"ext": {"data": ext, "horizon_days": 2}}, risk, members


def same(a, b, keys):
    """Equal rows by key, numbers to 1e-9."""
    a, b = ({tuple(r[k] for k in keys): r.asDict() for r in df.collect()} for df in (a, b.select(*a.columns)))
    assert set(a) == set(b) and a
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9, nan_ok=False), k


@pytest.mark.parametrize("place", [0, 1])
def test_one_pass_says_what_the_operators_say(spark, odd, place):
    factor, px, external, risk, members = odd
    made = returns.build(spark, px, [1, 3], external)
    config = BacktestConfig(tradability_filter=False)
    rows, _ = api._joined(factor, px, [None, members], made.beside, risk, STYLES, INDUSTRIES, config)
    own = api._of_pool(rows, place).persist()
    asked = daily.Asked(made.labels, METHODS, 5, 8, 7, 6, STYLES, INDUSTRIES)
    table = daily.measured(own.drop("value").withColumnRenamed("used", "value"), asked).persist()
    assert made.labels == LABELS and table.where("kind = 'failed'").count() == 0
    m = daily.Measured(table)
    f, quality, _ = api.prepared(factor, px, [None, members][place], config)
    f = f.persist()
    same(panel.quality(own), quality, ["trade_date"])
    for method in METHODS:
        same(m.ic(method), xs.daily_ic(f, made.returns, LABELS, method, 8), ["trade_date", "horizon"])
        same(m.corr(method), xs.style_corr(f, risk, STYLES, method, 8), ["trade_date", "style"])
        same(m.ic(method, "style_ic"), neutral.neutralized_ic(f, made.returns, risk, LABELS, STYLES, (), method, 8), ["trade_date", "horizon"])
        same(m.ic(method, "style_industry_ic"), neutral.neutralized_ic(f, made.returns, risk, LABELS, STYLES, INDUSTRIES, method, 8), ["trade_date", "horizon"])
    same(m.groups(), xs.group_returns(f, made.returns, 5, 7), ["trade_date", "horizon", "group"])
    same(m.groups("within"), xs.within_industry_group_returns(f, made.returns, risk, 5, 6), ["trade_date", "horizon", "group"])
    same(m.legs("style_leg", "exposure"), xs.group_style_exposure(f, risk, STYLES, 5, 7, 1, 5), ["trade_date", "leg", "exposure"])
    same(m.legs("industry_leg", "industry"), xs.group_industry_exposure(f, risk, INDUSTRIES, 5, 7, 1, 5), ["trade_date", "leg", "industry"])
    assert neutral.left_out(m.of("unplaced").agg(F.sum("n")).first()[0]) == neutral.missing_industry_warning(f.where("value is not null"), risk)


def test_returns_beside_one_another(spark, odd):
    """Also where a key comes twice."""
    px = odd[1].unionByName(odd[1].limit(9).withColumn("open_price", F.col("open_price") * 2))
    wide = panel.returns_beside(px, [3, 1])
    long = wide.select("trade_date", "symbol", F.expr("stack(2, '3d', ret_3d, '1d', ret_1d) as (horizon, ret)")).where("ret is not null")
    same(long, panel.forward_returns(px, [3, 1]), ["trade_date", "symbol", "horizon"])


def test_a_run_is_a_few_hundred_jobs_and_risk_fails_alone(spark, odd, tmp_path):
    """A stored run at sf0.1 was 654 jobs (this one was not counted then): every section joined, shuffled and ranked the pool's cells anew."""
    factor, px, _, risk, members = odd
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    how = dict(horizons=(1, 3), n_groups=5, min_ic_stocks=8, min_group_stocks=7, min_industry_ic_stocks=6, ic_methods=METHODS, selected_pools=("all", "some"), tradability_filter=False, verbose=False, output_root=str(tmp_path))
    before = jobs()
    done = api.run_factor_backtest_data(spark, factor, px, BacktestConfig(factor_name="n", styles=STYLES, **how), pools={"some": members}, risk=risk)
    assert {r.status for own in done.results.values() for r in own.values()} == {"ok"} and jobs() - before < 300
    # a style that isn't there, and exposures that can't be read: only what needs them fails
    for name, styles, given in (("lacks", ("a", "nothing"), risk), ("broken", STYLES, risk.withColumn("a", F.when(F.col("symbol") > "", F.raise_error(F.lit("torn"))).cast("double")))):
        done = api.run_factor_backtest_data(spark, factor, px, BacktestConfig(factor_name=name, styles=styles, **how), pools={"some": members}, risk=given)
        failed = {n for n, r in done.results["some"].items() if r.status == "failed"}
        assert {"factor_style_exposure", "style_neutralized_ic"} <= failed <= {"factor_style_exposure", "style_neutralized_ic", "style_industry_neutralized_ic", "group_exposure_diagnostics", "within_industry_group_return"}
        assert set(done.results["all"]) == set(DEFAULT_SECTIONS) and all("torn" in r.error or "nothing" in r.error for r in done.results["all"].values() if r.status == "failed")

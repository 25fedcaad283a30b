"""Panel operators on small inputs with values worked out by hand, and against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import expr
from tessera.operators import cross_section as xs
from tessera.operators import diagnostics, neutral, panel
from tessera.operators import timeseries as ts

DAYS = [dt.date(2026, 5, x) for x in (15, 18, 19, 20)]


def long(spark, rows, names="value"):
    return spark.createDataFrame(rows, f"trade_date date, symbol string, {names} double")


def matrix(spark, values, name="value", days=None):
    """values: dates by symbols."""
    days = days or [dt.date(2025, 1, 1) + dt.timedelta(i) for i in range(len(values))]
    return long(spark, [(d, f"S{j:03d}", None if v is None else float(v)) for d, row in zip(days, values) for j, v in enumerate(row)], name)


def test_forward_returns(spark):
    opens = {"A": [10, 11, 12, 15], "B": [20, 18, 22, 24]}
    px = long(spark, [(d, s, float(v)) for s, vs in opens.items() for d, v in zip(DAYS, vs)], "open_price")
    got = {(r.trade_date, r.symbol, r.horizon): r.ret for r in panel.forward_returns(px, [1, 2]).collect()}
    assert got[DAYS[0], "A", "1d"] == pytest.approx(12 / 11 - 1) and got[DAYS[0], "A", "2d"] == pytest.approx(15 / 11 - 1)
    assert (DAYS[2], "A", "1d") not in got and len(got) == 6


def test_returns_count_sessions_of_the_table(spark):
    px = long(spark, [(DAYS[0], "A", 10.0), (DAYS[3], "A", 15.0), *[(d, "B", 1.0) for d in DAYS]], "open_price")
    got = {(r.trade_date, r.symbol): r.ret for r in panel.forward_returns(px, [1]).collect()}
    assert (DAYS[0], "A") not in got and got[DAYS[0], "B"] == 0


def test_calendar(spark):
    days = panel.calendar(spark.createDataFrame([(d,) for d in DAYS], "trade_date date"))
    asked = spark.createDataFrame([(DAYS[0],), (dt.date(2026, 5, 16),), (DAYS[3],)], "date date")
    got = {r.date: r.shifted for r in panel.shift_sessions(asked, days, 1).collect()}
    assert got == {DAYS[0]: DAYS[1], dt.date(2026, 5, 16): DAYS[2], DAYS[3]: None}
    assert [r.trade_date for r in panel.window_ending(days, dt.date(2026, 5, 21), 2).collect()] == DAYS[2:]
    with pytest.raises(IndexError):
        panel.window_ending(days, DAYS[1], 3)


def test_tradability(spark):
    rows = [("A", 10, 11, 9, 12, 8, 0, 0), ("B", 10, 12, 9, 12, 8, 0, 0), ("C", 10, 11, 8, 12, 8, 0, 0), ("D", 10, 11, 9, 12, 8, 1, 0), ("E", 10, 11, 9, 12, 8, 0, None)]
    cells = spark.createDataFrame([(DAYS[0], s, *[None if v is None else float(v) for v in x], 200.0) for s, *x in rows], "trade_date date, symbol string, " + ", ".join(f"{c} double" for c in panel.TRADABILITY_FIELDS))
    flagged = panel.tradability(cells)
    assert {r.symbol: r.valid for r in flagged.collect()} == {"A": True, "B": False, "C": False, "D": False, "E": False}
    s = panel.tradability_summary(flagged).first()
    assert (s.limit_up_touch_count, s.limit_down_touch_count, s.st_count, s.suspended_count, s.new_stock_filtered_count, s.open_invalid_count, s.after_filter_count) == (1, 1, 1, 1, 0, 0, 1)
    with pytest.raises(ValueError):
        panel.tradability(cells.drop("is_st"))


def test_quality_counts_missing_and_infinite(spark):
    f = long(spark, [(DAYS[0], "A", 0.0), (DAYS[0], "B", float("inf")), (DAYS[0], "C", 3.0), (DAYS[1], "B", 2.0), (DAYS[1], "C", 0.0)])
    got = {r.trade_date: r for r in panel.quality(panel.in_pool(f, f.withColumnRenamed("value", "open_price"), None)).collect()}
    assert got[DAYS[0]].zero_ratio == pytest.approx(1 / 3) and got[DAYS[0]].inf_ratio == pytest.approx(1 / 3) and got[DAYS[0]].valid_factor_count == 2
    assert got[DAYS[1]].nan_ratio == pytest.approx(1 / 3) and got[DAYS[1]].pool_stock_count == 3


@pytest.mark.parametrize("groups", [3, 5, 10])
def test_buckets_are_those_of_pandas(spark, groups):
    sizes = [*range(groups, 60), 91, 171, 181, 362]
    rows = [(n, r) for n in sizes for r in range(1, n + 1)]
    df = spark.createDataFrame(rows, "n int, r int").withColumn("g", expr.quantile_bucket(F.col("r"), F.col("n"), groups)).toPandas()
    for n, part in df.groupby("n"):
        want = pd.qcut(part.sort_values("r").r, groups, labels=False) + 1
        assert (part.sort_values("r").g.to_numpy() == want.to_numpy()).all(), n


def test_ic_and_groups(spark):
    f = matrix(spark, [range(40)] * 2)
    r = f.select("trade_date", "symbol", F.lit("1d").alias("horizon"), F.col("value").alias("ret"))
    assert [x.ic for x in xs.daily_ic(f, r, ["1d"]).collect()] == [1.0, 1.0]
    g = xs.group_returns(f, r)
    got = {x["group"]: x.group_return for x in g.where(F.col("trade_date") == dt.date(2025, 1, 1)).collect()}
    assert got[1] < got[10] and all(x.spread > 0 for x in xs.long_short(g).collect())


def test_spearman_and_pearson_and_few_stocks(spark):
    f = matrix(spark, [[1, 2, 3, 100], [5, 5, 5, 5]])
    r = matrix(spark, [[1, 4, 9, 16], [1, 2, 3, 4]], "ret").withColumn("horizon", F.lit("x"))
    ic = lambda m, n: [x.ic for x in xs.daily_ic(f, r, ["x"], m, n).orderBy("trade_date").collect()]
    assert ic("spearman", 3) == [1.0, None] and ic("pearson", 3)[0] < 1 and ic("spearman", 5) == [None, None]
    for bad in ([], ["kendall"]):
        with pytest.raises(ValueError):
            xs.ic_methods(bad)


def test_turnover(spark):
    base = list(range(20))
    f = matrix(spark, [base, base, base[2:] + base[:2], [None] * 20, base])
    got = [x.turnover for x in xs.turnover(f).where("`group` = 1").orderBy("trade_date").collect()]
    assert got[0] is None and got[1] == 0.0 and got[2] == 1.0 and got[3:] == [None, None]


def test_stats_match_pandas(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=70)
    x[[3, 30]] = np.nan
    days = list(pd.bdate_range("2024-01-02", periods=70).date)
    ic = spark.createDataFrame([(d, h, None if np.isnan(v) else float(v)) for d, v in zip(days, x) for h in ("1d", "5d", "ext")], "trade_date date, horizon string, ic double")
    got = {r.horizon: r for r in ts.ic_stats(ic, {"1d": 1, "5d": 5, "ext": None}).collect()}
    v = x[~np.isnan(x)]
    for h, lag in (("1d", 0), ("5d", 4)):
        e = v - v.mean()
        lrv = e @ e / len(v) + sum(2 * (1 - k / (lag + 1)) * (e[k:] @ e[:-k]) / len(v) for k in range(1, lag + 1))
        assert got[h].t_stat_hac == pytest.approx(v.mean() / np.sqrt(lrv / len(v))) and got[h].hac_lag == lag and got[h].hac_status == "ok"
    assert got["ext"].t_stat_hac is None and got["ext"].hac_status == "missing_horizon_days" and got["1d"].valid_days == 68
    assert got["1d"].ic_std == pytest.approx(v.std(ddof=1))


def test_lag_is_cut_and_single_values_have_no_t(spark):
    ic = spark.createDataFrame([(d, "20d", float(i * i)) for i, d in enumerate(DAYS[:3])] + [(DAYS[0], "5d", 1.0)], "trade_date date, horizon string, ic double")
    got = {r.horizon: r for r in ts.ic_stats(ic, {"20d": 20, "5d": 5}).collect()}
    assert got["20d"].hac_lag == 2 and got["5d"].t_stat_hac is None and got["5d"].hac_lag == 0


def test_yearly(spark):
    days = [dt.date(2024, 1, 2), dt.date(2024, 6, 3), dt.date(2024, 12, 30), dt.date(2025, 3, 3)]
    ic = spark.createDataFrame([(d, "3d", float(i)) for i, d in enumerate(days)], "trade_date date, horizon string, ic double")
    got = {r.year: r for r in ts.yearly_ic_stats(ic, {"3d": 3}, 2).collect()}
    assert got[2024].is_complete_year and got[2024].valid_days == 3 and got[2024].hac_lag == 2 and got[2024].ic_mean == 1
    assert not got[2025].meets_min_days and got[2025].ic_mean is None
    assert ts.yearly_ic_stats(ic, {"3d": 3}, 2, include_partial_year=False).count() == 1
    with pytest.raises(ValueError):
        ts.yearly_ic_stats(ic, {}, 0)


def test_performance_and_daily_equivalent(spark):
    rows = [(d, h, v) for h, vs in (("1d", [0.01, -0.02, 0.03]), ("5d", [0.05, -0.04, 0.02])) for d, v in zip(DAYS, vs)]
    got = {r.series: r for r in ts.performance(spark.createDataFrame(rows, "trade_date date, horizon string, spread double"), {"1d": 1, "5d": 5}).collect()}
    assert got["long_short_1d"].diagnostic_max_drawdown == pytest.approx(-0.02) and got["long_short_5d"].diagnostic_max_drawdown is None
    assert got["long_short_5d"].not_applicable_reason == "overlapping_forward_returns" and got["long_short_5d"].hac_lag == 2
    g = spark.createDataFrame([(DAYS[0], "5d", 1, 0.05), (DAYS[0], "5d", 10, 0.10), (DAYS[0], "e", 1, 0.0)], "trade_date date, horizon string, group int, group_return double")
    df, skipped = xs.daily_equivalent_long_short(g, {"5d": 5, "e": None})
    assert df.first().spread == pytest.approx(1.1**0.2 - 1.05**0.2) and skipped == ["e"]


def test_layered_windows(spark):
    g = spark.createDataFrame([(DAYS[i], "1d", k, float(i + 1 + k)) for i in range(3) for k in (1, 2)], "trade_date date, horizon string, group int, group_return double")
    got = {(r.window, r["group"]): r.mean_return for r in ts.layered_summary(g, {"last2": 2, "all": 9}).collect()}
    assert got["last2", 1] == 3.5 and got["last2", 2] == 4.5 and got["all", 1] == 3.0


def risk_table(spark, n=24, dates=2):
    rows = [(dt.date(2025, 1, 1) + dt.timedelta(d), f"S{i:03d}", float(i + d), float((i * 7) % 11), ["bank"] if i < n // 2 else ["tech"]) for d in range(dates) for i in range(n)]
    return spark.createDataFrame(rows, "trade_date date, symbol string, size double, value2 double, industries array<string>")


def test_exposures(spark):
    f = matrix(spark, [range(20)] * 2)
    risk = risk_table(spark, 20)
    style = {(r.leg, r.exposure): r.value for r in xs.group_style_exposure(f, risk, ["size"], 10, 10).where(F.col("trade_date") == dt.date(2025, 1, 1)).collect()}
    assert style["G1", "size"] == 0.5 and style["G10", "size"] == 18.5 and style["G10-G1", "size"] == 18.0
    ind = {(r.leg, r.industry): r.value for r in xs.group_industry_exposure(f, risk, ["bank", "tech"], 10, 10).where(F.col("trade_date") == dt.date(2025, 1, 1)).collect()}
    assert ind["G1", "bank"] == 1.0 and ind["G10", "tech"] == 1.0 and ind["pool", "bank"] == 0.5
    corr = {r.style: r.corr for r in xs.style_corr(f, risk, ["size", "value2"], "spearman", 10).where(F.col("trade_date") == dt.date(2025, 1, 1)).collect()}
    assert corr["size"] == 1.0 and abs(corr["value2"]) < 1


def test_neutralized(spark):
    risk = risk_table(spark).withColumn("industries", F.when(F.col("symbol") == "S002", F.array().cast("array<string>")).otherwise(F.col("industries")))
    f = risk.select("trade_date", "symbol", (2 * F.col("size") + 5 + F.when((F.col("symbol") == "S005") & (F.col("trade_date") == dt.date(2025, 1, 2)), 3.0).otherwise(0.0)).alias("value"))
    got = {(r.trade_date, r.symbol): r.value for r in neutral.neutralized(f, risk, ["size", "value2"], ["bank", "tech"], 10).collect()}
    assert got[dt.date(2025, 1, 1), "S002"] is None
    assert max(abs(v) for (d, s), v in got.items() if d == dt.date(2025, 1, 1) and v is not None) < 1e-10
    assert got[dt.date(2025, 1, 2), "S005"] > 1
    assert neutral.missing_industry_warning(f, risk) == ["2 rows have no industry and were left out"]
    assert all(r.value is None for r in neutral.neutralized(f, risk, ["size"], [], 100).collect())


def test_library(spark):
    f = matrix(spark, [[(i * 7 + d) % 31 + i * 0.1 for i in range(30)] for d in range(8)])
    near = f.withColumn("value", F.col("value") * 0.85).withColumn("factor_id", F.lit("near"))
    other = f.withColumn("value", F.pmod(F.hash("symbol"), F.lit(7)).cast("double")).withColumn("factor_id", F.lit("other"))
    book = near.unionByName(other)
    got = diagnostics.similarity(f, book, 10).collect()
    assert got[0].factor_id == "near" and got[0].mean_abs == 1.0 and got[0].n_obs == 8
    assert {r.factor_id: r.overlap for r in diagnostics.top_overlap(f, book, 5, 10).collect()}["near"] == 1.0
    left = neutral.residual_of_peers(f, book, ["near"], 10).agg(F.max(F.abs("value"))).first()[0]
    assert left < 1e-9
    ret = f.select("trade_date", "symbol", F.lit("1d").alias("horizon"), F.col("value").alias("ret"))
    gain = diagnostics.spanned_r2(f, book, ret, ["other"], 10).first()
    assert 0 < gain["mean"] <= 1
    rounds, left = diagnostics.spanning(f, book, ret, 1, 3, 10, keep=lambda df: df.persist())
    assert left.columns == ["trade_date", "symbol", "value"] and rounds[0]["most_like"][0][0] == rounds[0]["peers"][0]
    assert [r["peers"] for r in rounds] == [["near"], ["other"]]
    assert diagnostics.sign_matches(0.1, "high_is_long") and diagnostics.sign_matches(-0.1, "high_is_short") and not diagnostics.sign_matches(0.0, "high_is_short")
    assert diagnostics.sign_matches(None, "high_is_long") is None and diagnostics.sign_matches(0.1, "unknown") is None


def test_labels():
    assert sorted(["10d", "ext", "1d", "abc"], key=expr.label_order) == ["1d", "10d", "abc", "ext"]
    assert expr.horizon_days("30d") == 30 and expr.horizon_days("30d", {"30d": None}) is None and expr.horizon_days("external_5d") is None
    assert expr.horizon_days_anywhere("external_5d", {"external_5d": None}) == 5 and expr.slug("a b/c") == "a_b_c"

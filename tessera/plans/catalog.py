"""Registered queries over the panel operators and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cross_section as xs
from tessera.operators import diagnostics, neutral, panel
from tessera.operators import timeseries as ts
from tessera.plans import sql
from tessera.sources import factors, market, tables

HORIZONS, LABELS, DAYS, GROUPS, LEAST = (1, 3), ("1d", "3d"), {"1d": 1, "3d": 3}, 5, 10
STYLES, REGIONS = ("size", "weight", "balance"), ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
START, END = "1996-01-01", "1998-12-31"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(function):
        _QUERIES[name] = function
        if oracle:
            _ORACLE[name] = oracle
        return function

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


class Bound:
    """The operators' inputs and shared steps over one set of tables; all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.cells = tables.cells(spark, sf_dir)
        self.who = tables.suppliers(spark, sf_dir)
        self.factor = tables.factor(self.cells)
        self.risk = tables.risk(self.cells, self.who)
        self.book = tables.book(self.cells)

    @property
    def returns(self) -> DataFrame:
        return panel.forward_returns(self.cells, HORIZONS)

    def ic(self, method: str = "spearman") -> DataFrame:
        return xs.daily_ic(self.factor, self.returns, LABELS, method, LEAST)

    @property
    def groups(self) -> DataFrame:
        return xs.group_returns(self.factor, self.returns, GROUPS, LEAST)

    @property
    def spread(self) -> DataFrame:
        return xs.long_short(self.groups, 1, GROUPS)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(xs.group_returns(tables.factor(tables.cells(spark, sf_dir)), panel.forward_returns(tables.cells(spark, sf_dir), HORIZONS), GROUPS, 5))


# ---- sources ---------------------------------------------------------------------------------------------------


@query("market_left_join", sql.query("""SELECT c.symbol, CAST(c.trade_date AS VARCHAR) AS date, c.open_price, s.weight AS circulation_a, t.is_st, u.is_suspended FROM cells c LEFT JOIN (SELECT symbol, trade_date, weight FROM cells WHERE f3 > 100) s USING (symbol, trade_date)
  LEFT JOIN (SELECT symbol, trade_date, is_st FROM cells WHERE is_st = 1) t USING (symbol, trade_date) LEFT JOIN (SELECT symbol, trade_date, is_suspended FROM cells WHERE is_suspended = 1) u USING (symbol, trade_date) WHERE c.trade_date >= DATE '1995-01-01' AND c.trade_date < DATE '1997-01-01'""", "cells"))  # fmt: skip
def _(spark, d):
    rows = tables.cells(spark, d).withColumnRenamed("trade_date", "date")
    four = {"ohlcv": rows.select("symbol", "date", "open_price"), "shares": rows.where("f3 > 100").withColumnRenamed("weight", "circulation_a"), "st": rows.where("is_st = 1"), "suspended": rows.where("is_suspended = 1")}
    return market.joined(four.__getitem__, "1995-01-01", "1997-01-01", {x: x for x in four}).select("symbol", F.col("date").cast("string").alias("date"), "open_price", "circulation_a", "is_st", "is_suspended")


@query("latest_version_scan", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def _(spark, d):
    from tessera.sources.risk import latest_versions

    return latest_versions(tables.read(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("wide_to_long", sql.query("""SELECT trade_date, r_name AS symbol, round(v, 9) AS value FROM (SELECT DISTINCT trade_date FROM cells) CROSS JOIN (SELECT r_name FROM region) LEFT JOIN (SELECT trade_date, region AS r_name, avg(f1) AS v FROM cells JOIN who USING (symbol) GROUP BY 1, 2) USING (trade_date, r_name)""", "cells", "who"))
def _(spark, d):
    b = Bound(spark, d)
    return rounded(factors.normalize(b.cells.join(b.who, "symbol").groupBy("trade_date").pivot("region", list(REGIONS)).agg(F.avg("f1"))))


@query("book_mean_dedupe", "SELECT CAST(ts AS DATE) AS trade_date, CAST(user_id AS VARCHAR) AS symbol, event_type AS factor_id, round(avg(value), 9) AS value FROM events GROUP BY 1, 2, 3")
def _(spark, d):
    from tessera.sources.books import normalize_book

    e = tables.read(spark, d, "events").select(F.to_date("ts").alias("date"), F.col("user_id").alias("stock_id"), F.col("event_type").alias("factor_id"), "value")
    return rounded(normalize_book(e))


@query("user_day_panel", "SELECT CAST(ts AS DATE) AS trade_date, CAST(user_id AS VARCHAR) AS symbol, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def _(spark, d):
    return tables.user_days(spark, d)


# ---- panel -----------------------------------------------------------------------------------------------------


@query("calendar_shift", sql.query("SELECT a.trade_date AS date, CAST(b.trade_date AS VARCHAR) AS shifted FROM cal a LEFT JOIN cal b ON b.t = a.t + 2", "cal"))
def _(spark, d):
    days = panel.calendar(tables.cells(spark, d))
    return panel.shift_sessions(days.select(F.col("trade_date").alias("date")), days, 2).withColumn("shifted", F.col("shifted").cast("string"))


@query("window_ending", sql.query("SELECT trade_date, t FROM cal WHERE trade_date <= DATE '1998-06-15' ORDER BY trade_date DESC LIMIT 12", "cal"))
def _(spark, d):
    return panel.window_ending(panel.calendar(tables.cells(spark, d)), "1998-06-15", 12)


@query("next_session_lookup", sql.query("SELECT c.trade_date, n.symbol, n.f1 AS value FROM px n JOIN cal c ON c.t = n.t - 1", "px"))
def _(spark, d):
    rows = tables.factor(tables.cells(spark, d))
    return panel.at_next_date(rows, rows)


@query("forward_returns", sql.query("SELECT trade_date, symbol, horizon, round(ret, 9) AS ret FROM returns WHERE ret IS NOT NULL", "returns"))
def _(spark, d):
    return rounded(Bound(spark, d).returns)


@query("listed_days", sql.query("SELECT trade_date, symbol, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS listed_days FROM cells", "cells"))
def _(spark, d):
    return panel.listed_days(tables.cells(spark, d)).select("trade_date", "symbol", "listed_days")


_FLAGGED = """listed AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS listed_days FROM cells),
flagged AS (SELECT trade_date, symbol, NOT coalesce(open_price > 0, false) AS open_invalid, coalesce(high_price >= limit_up_price, false) AS limit_up_touch, coalesce(low_price <= limit_down_price, false) AS limit_down_touch,
  coalesce(is_st, 1) = 1 AS st, coalesce(is_suspended, 1) = 1 AS suspended, coalesce(listed_days < 12, false) AS new_stock FROM listed)"""
_VALID = "NOT open_invalid AND NOT limit_up_touch AND NOT limit_down_touch AND NOT st AND NOT suspended AND NOT new_stock"


def _flagged(spark, d):
    return panel.tradability(panel.listed_days(tables.cells(spark, d)), 12)


@query("tradability_mask", sql.query("SELECT 1", "cells").replace("\nSELECT 1", f",\n{_FLAGGED} SELECT trade_date, symbol, {_VALID} AS valid FROM flagged"))
def _(spark, d):
    return _flagged(spark, d).select("trade_date", "symbol", "valid")


@query("tradability_counts", sql.query("SELECT 1", "cells").replace("\nSELECT 1", f""",\n{_FLAGGED} SELECT trade_date, count(*) FILTER (limit_up_touch) AS limit_up_touch_count, count(*) FILTER (limit_down_touch) AS limit_down_touch_count,
  count(*) FILTER (st) AS st_count, count(*) FILTER (suspended) AS suspended_count, count(*) FILTER (new_stock) AS new_stock_filtered_count, count(*) FILTER (open_invalid) AS open_invalid_count, count(*) FILTER ({_VALID}) AS after_filter_count FROM flagged GROUP BY 1"""))  # fmt: skip
def _(spark, d):
    return panel.tradability_summary(_flagged(spark, d))


@query("pool_semi_join", sql.query("SELECT trade_date, symbol, f1 AS value FROM cells SEMI JOIN (SELECT symbol FROM who WHERE balance > 0) USING (symbol)", "cells", "who"))
def _(spark, d):
    b = Bound(spark, d)
    return panel.in_pool(b.factor, b.cells, tables.pool(b.cells, b.who)).where("member").select("trade_date", "symbol", "value")


@query("dense_grid_quality", sql.query("""SELECT trade_date, count(*) AS pool_stock_count, count(f1) AS valid_factor_count, round(count(f1) / count(*), 9) AS coverage_ratio, round(count(*) FILTER (f1 = 0) / count(*), 9) AS zero_ratio,
  round(1 - count(f1) / count(*), 9) AS nan_ratio, 0.0::DOUBLE AS inf_ratio FROM grid LEFT JOIN cells USING (trade_date, symbol) GROUP BY 1""", "grid"))  # fmt: skip
def _(spark, d):
    b = Bound(spark, d)
    return rounded(panel.quality(panel.in_pool(b.factor, b.cells, None)))


# ---- information coefficients ------------------------------------------------------------------------------------


@query("ic_spearman", sql.query("SELECT trade_date, horizon, round(ic, 9) AS ic, k AS n FROM ic", "ic"))
def _(spark, d):
    return rounded(Bound(spark, d).ic())


@query("ic_pearson", sql.query("""SELECT l.trade_date, l.horizon, round(c.ic, 9) AS ic, coalesce(c.k, 0) AS n FROM labels l LEFT JOIN (SELECT trade_date, horizon, count(*) AS k,
  CASE WHEN count(*) >= 10 AND min(value) < max(value) AND min(ret) < max(ret) THEN corr(value, ret) END AS ic FROM pairs GROUP BY 1, 2) c USING (trade_date, horizon)""", "labels", "pairs"))  # fmt: skip
def _(spark, d):
    return rounded(Bound(spark, d).ic("pearson"))


def _with_hac(body: str, block: str, keys: str, value: str, days: str, *more: str) -> str:
    return sql.query("SELECT 1", block, *more).replace("\nSELECT 1", f",\n{sql.hac(block, keys, value, days)}\n{body}")


_IC_STATS = """SELECT i.horizon, round(avg(ic), 9) AS ic_mean, round(stddev_samp(ic), 9) AS ic_std, round(avg(ic) / stddev_samp(ic), 9) AS icir_raw, round(avg((ic > 0)::INT), 9) AS ic_positive_ratio,
  round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 9) AS t_stat_naive, round(max(t_hac), 9) AS t_stat_hac, max(lag)::INT AS hac_lag, count(ic) AS valid_days, 'ok' AS hac_status,
  round(avg(ic) / stddev_samp(ic), 9) AS icir, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 9) AS t_stat FROM ic i JOIN hac USING (horizon) GROUP BY 1"""  # fmt: skip


@query("ic_stats_hac", _with_hac(_IC_STATS, "ic", "horizon", "ic", "days"))
def _(spark, d):
    return rounded(ts.ic_stats(Bound(spark, d).ic(), DAYS))


@query("ic_yearly", sql.query("SELECT 1", "ic").replace("\nSELECT 1", f""",
yearly AS (SELECT *, year(trade_date) AS y FROM ic), {sql.hac("yearly", "y, horizon", "ic", "days").strip()},
spans AS (SELECT y, min(trade_date) AS s, max(trade_date) AS e FROM yearly GROUP BY 1),
g AS (SELECT y, horizon, avg(ic) AS a, stddev_samp(ic) AS b, avg((ic > 0)::INT) AS p, count(ic) AS n FROM yearly GROUP BY 1, 2)
SELECT y::INT AS year, horizon, CASE WHEN n >= 10 THEN round(a, 9) END AS ic_mean, CASE WHEN n >= 10 THEN round(b, 9) END AS ic_std, CASE WHEN n >= 10 THEN round(a / b, 9) END AS icir_raw, CASE WHEN n >= 10 THEN round(p, 9) END AS ic_positive_ratio,
  CASE WHEN n >= 10 THEN round(t_hac, 9) END AS t_stat_hac, coalesce(lag, 0)::INT AS hac_lag, n AS valid_days, s AS start_date, e AS end_date, month(s) = 1 AND month(e) = 12 AS is_complete_year, n >= 10 AS meets_min_days
FROM g LEFT JOIN hac USING (y, horizon) JOIN spans USING (y)"""))  # fmt: skip
def _(spark, d):
    return rounded(ts.yearly_ic_stats(Bound(spark, d).ic(), DAYS, 10))


@query("ic_rolling20", sql.query("SELECT trade_date, horizon, round(ic, 9) AS ic, round(avg(ic) OVER (PARTITION BY horizon ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 9) AS moving_average FROM ic", "ic"))
def _(spark, d):
    return rounded(ts.moving_average(Bound(spark, d).ic().drop("n"), "ic"))


@query("ic_cumulative", sql.query("SELECT trade_date, horizon, round(ic, 9) AS ic, CASE WHEN ic IS NOT NULL THEN round(sum(ic) OVER (PARTITION BY horizon ORDER BY trade_date ROWS UNBOUNDED PRECEDING), 9) END AS cumulative FROM ic", "ic"))
def _(spark, d):
    return rounded(ts.cumulative(Bound(spark, d).ic().drop("n"), "ic"))


@query("ic_view_range", sql.query(f"""SELECT trade_date, horizon, round(ic, 9) AS ic, round(c - first_value(c IGNORE NULLS) OVER (PARTITION BY horizon ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 9) AS cumulative, round(ma, 9) AS moving_average
  FROM (SELECT *, CASE WHEN ic IS NOT NULL THEN sum(ic) OVER (PARTITION BY horizon ORDER BY trade_date ROWS UNBOUNDED PRECEDING) END AS c, avg(ic) OVER (PARTITION BY horizon ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma FROM ic)
  WHERE trade_date BETWEEN DATE '{START}' AND DATE '{END}'""", "ic"))  # fmt: skip
def _(spark, d):
    from tessera.plans.views import ic_view

    return rounded(ic_view(Bound(spark, d).ic(), DAYS, START, END).curves)


# ---- groups ------------------------------------------------------------------------------------------------------


@query("group_returns", sql.query('SELECT trade_date, horizon, grp AS "group", round(group_return, 9) AS group_return FROM groups', "groups"))
def _(spark, d):
    return rounded(Bound(spark, d).groups)


@query("group_summary", sql.query("""SELECT grp AS "group", round(avg(group_return) FILTER (horizon = '1d'), 9) AS "1d", round(avg(group_return) FILTER (horizon = '3d'), 9) AS "3d" FROM groups GROUP BY 1""", "groups"))
def _(spark, d):
    return rounded(ts.group_summary(Bound(spark, d).groups, LABELS))


@query("group_layered", sql.query("""SELECT w AS "window", size AS window_size, (SELECT max(trade_date) FROM groups) AS end_date, grp AS "group", horizon, round(avg(group_return), 9) AS mean_return
  FROM groups JOIN (SELECT trade_date, row_number() OVER (ORDER BY trade_date DESC) AS k FROM (SELECT DISTINCT trade_date FROM groups)) USING (trade_date) JOIN (VALUES ('1y', 12), ('3y', 36)) v(w, size) ON k <= size GROUP BY 1, 2, 4, 5""", "groups"))  # fmt: skip
def _(spark, d):
    return rounded(ts.layered_summary(Bound(spark, d).groups, {"1y": 12, "3y": 36}))


@query("long_short", sql.query("SELECT trade_date, horizon, round(spread, 9) AS spread FROM spread", "spread"))
def _(spark, d):
    return rounded(Bound(spark, d).spread)


_DAILY = "CASE WHEN horizon = '1d' THEN {0} WHEN {0} > -1 THEN pow(1 + {0}, 1.0::DOUBLE / 3) - 1 END"


@query("long_short_daily_equiv", sql.query(f"""SELECT trade_date, horizon, round(max(CASE WHEN grp = 5 THEN {_DAILY.format("group_return")} END) - max(CASE WHEN grp = 1 THEN {_DAILY.format("group_return")} END), 9) AS spread FROM groups GROUP BY 1, 2""", "groups"))
def _(spark, d):
    return rounded(xs.daily_equivalent_long_short(Bound(spark, d).groups, DAYS, 1, GROUPS)[0])


@query("long_short_cumulative", sql.query("SELECT trade_date, horizon, round(spread, 9) AS spread, round(sum(coalesce(spread, 0)) OVER (PARTITION BY horizon ORDER BY trade_date ROWS UNBOUNDED PRECEDING), 9) AS cumulative FROM spread", "spread"))
def _(spark, d):
    return rounded(ts.filled_cumulative(Bound(spark, d).spread, "spread"))


@query("group_cumulative", sql.query(f"""SELECT k.trade_date, k.horizon, k.grp AS "group", round(exp(sum(ln(1 + coalesce({_DAILY.format("g.group_return")}, 0))) OVER (PARTITION BY k.horizon, k.grp ORDER BY k.trade_date ROWS UNBOUNDED PRECEDING)), 9) AS nav
  FROM (SELECT trade_date, horizon, grp FROM cal CROSS JOIN (SELECT DISTINCT horizon, grp FROM groups)) k LEFT JOIN groups g ON g.trade_date = k.trade_date AND g.horizon = k.horizon AND g.grp = k.grp""".replace("WHEN horizon", "WHEN k.horizon"), "groups", "cal"))  # fmt: skip
def _(spark, d):
    b = Bound(spark, d)
    return rounded(ts.group_curves(b.groups, b.factor, DAYS))


_NAV = """nav AS (SELECT horizon, trade_date, product(1 + spread) OVER (PARTITION BY horizon ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS v FROM spread WHERE spread IS NOT NULL),
dd AS (SELECT horizon, min(v / p - 1) AS max_drawdown FROM (SELECT *, max(v) OVER (PARTITION BY horizon ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS p FROM nav) GROUP BY 1)"""


@query("drawdown", sql.query("SELECT 1", "spread").replace("\nSELECT 1", f",\n{_NAV} SELECT horizon, round(max_drawdown, 9) AS max_drawdown FROM dd"))
def _(spark, d):
    return rounded(ts.max_drawdown(Bound(spark, d).spread))


@query("performance", sql.query("SELECT 1", "spread").replace("\nSELECT 1", f""",
{_NAV}, timed AS (SELECT *, CASE horizon WHEN '1d' THEN 1 ELSE 3 END AS days FROM spread), {sql.hac("timed", "horizon", "spread", "days").strip()},
g AS (SELECT horizon, max(days) AS days, round(avg(spread), 9) AS a, round(stddev_samp(spread), 9) AS b, round(avg(spread) / stddev_samp(spread), 9) AS s, round(avg((spread > 0)::INT), 9) AS p,
  round(avg(spread) / (stddev_samp(spread) / sqrt(count(spread))), 9) AS t, count(spread) AS n FROM timed GROUP BY 1)
SELECT 'long_short_' || horizon AS series, a AS raw_mean, b AS raw_std, s AS mean_over_std_raw, p AS positive_ratio, t AS t_stat_naive, round(t_hac, 9) AS t_stat_hac, lag::INT AS hac_lag, n AS valid_days,
  CASE WHEN days = 1 THEN round(max_drawdown, 9) END AS diagnostic_max_drawdown, days = 1 AS max_drawdown_applicable, CASE WHEN days > 1 THEN 'overlapping_forward_returns' ELSE '' END AS not_applicable_reason, 'ok' AS hac_status,
  a AS mean, b AS std, s AS sharpe, round(max_drawdown, 9) AS max_drawdown, p AS win_rate, t AS t_stat FROM g JOIN hac USING (horizon) JOIN dd USING (horizon)"""))  # fmt: skip
def _(spark, d):
    return rounded(ts.performance(Bound(spark, d).spread, DAYS))


_TURNOVER = """numbered AS (SELECT o.*, t FROM own o JOIN cal USING (trade_date)),
turned AS (SELECT c.trade_date, k.grp, CASE WHEN c.t - 1 IN (SELECT t FROM numbered) THEN 1 - count(p.symbol) / nullif(count(n.symbol), 0) END AS turnover FROM cal c CROSS JOIN range(1, 6) k(grp)
  LEFT JOIN numbered n ON n.t = c.t AND n.grp = k.grp LEFT JOIN numbered p ON p.t = n.t - 1 AND p.grp = n.grp AND p.symbol = n.symbol GROUP BY c.trade_date, c.t, k.grp)"""


@query("turnover", sql.query("SELECT 1", "own", "cal").replace("\nSELECT 1", f""",\n{_TURNOVER} SELECT trade_date, grp::INT AS "group", round(turnover, 9) AS turnover FROM turned"""))
def _(spark, d):
    return rounded(xs.turnover(tables.factor(tables.cells(spark, d)), GROUPS, LEAST))


@query("turnover_summary", sql.query("SELECT 1", "own", "cal").replace("\nSELECT 1", f""",\n{_TURNOVER} SELECT grp::INT AS "group", round(avg(turnover), 9) AS mean, round(stddev_samp(turnover), 9) AS std, round(avg(turnover) / nullif(stddev_samp(turnover), 0), 9) AS mean_over_std,
  round(min(turnover), 9) AS min, round(max(turnover), 9) AS max, count(turnover) AS valid_days FROM turned GROUP BY 1"""))  # fmt: skip
def _(spark, d):
    return rounded(ts.summary(xs.turnover(tables.factor(tables.cells(spark, d)), GROUPS, LEAST), ["group"], "turnover", ts.TURNOVER_COLUMNS))


# ---- exposures ---------------------------------------------------------------------------------------------------

_STYLE = """styled AS (SELECT c.trade_date, c.f1 AS value, u.style, u.x FROM cells c JOIN (SELECT trade_date, symbol, style, x FROM risk UNPIVOT (x FOR style IN (size, weight, balance))) u USING (trade_date, symbol)),
sranked AS (SELECT trade_date, style, rank() OVER (PARTITION BY trade_date, style ORDER BY value) + (count(*) OVER (PARTITION BY trade_date, style, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY trade_date, style ORDER BY x) + (count(*) OVER (PARTITION BY trade_date, style, x) - 1) / 2.0 AS b FROM styled),
scorr AS (SELECT trade_date, style, c.corr FROM (SELECT trade_date, style FROM cal CROSS JOIN (VALUES ('size'), ('weight'), ('balance')) v(style)) LEFT JOIN (SELECT trade_date, style, CASE WHEN count(*) >= 10 AND min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS corr FROM sranked GROUP BY 1, 2) c USING (trade_date, style))"""  # fmt: skip


@query("style_exposure_corr", sql.query("SELECT 1", "risk", "cal").replace("\nSELECT 1", f",\n{_STYLE} SELECT trade_date, style, round(corr, 9) AS corr FROM scorr"))
def _(spark, d):
    b = Bound(spark, d)
    return rounded(xs.style_corr(b.factor, b.risk, STYLES, "spearman", LEAST))


@query("style_corr_summary", sql.query("SELECT 1", "risk", "cal").replace("\nSELECT 1", f""",\n{_STYLE} SELECT style, round(avg(corr), 9) AS mean, round(stddev_samp(corr), 9) AS std, round(avg(corr) / stddev_samp(corr), 9) AS mean_over_std, round(avg(corr) / (stddev_samp(corr) / sqrt(count(corr))), 9) AS t_stat,
  round(avg((corr > 0)::INT), 9) AS positive_ratio, round(avg((corr < 0)::INT), 9) AS negative_ratio, count(corr) AS valid_days FROM scorr GROUP BY 1"""))  # fmt: skip
def _(spark, d):
    b = Bound(spark, d)
    return rounded(ts.summary(xs.style_corr(b.factor, b.risk, STYLES, "spearman", LEAST), ["style"], "corr"))


def _differences(axis: str) -> str:
    return f"""three AS (SELECT trade_date, {axis}, max(value) FILTER (leg = 'pool') AS p, max(value) FILTER (leg = 'G1') AS l, max(value) FILTER (leg = 'G5') AS h FROM means GROUP BY 1, 2),
six AS (SELECT trade_date, {axis}, unnest([{{'leg': 'pool', 'v': p}}, {{'leg': 'G1', 'v': l}}, {{'leg': 'G5', 'v': h}}, {{'leg': 'G5-G1', 'v': h - l}}, {{'leg': 'G1-pool', 'v': l - p}}, {{'leg': 'G5-pool', 'v': h - p}}]) AS m FROM three)"""


_STYLE_LEGS = """means AS (SELECT trade_date, leg, exposure, avg(x) AS value FROM legs JOIN (SELECT trade_date, symbol, exposure, x FROM risk UNPIVOT (x FOR exposure IN (size, weight, balance))) USING (trade_date, symbol) GROUP BY 1, 2, 3), """ + _differences("exposure")


@query("group_exposure_style", sql.query("SELECT 1", "legs", "risk").replace("\nSELECT 1", f",\n{_STYLE_LEGS} SELECT trade_date, m.leg AS leg, exposure, round(m.v, 9) AS value FROM six"))
def _(spark, d):
    b = Bound(spark, d)
    return rounded(xs.group_style_exposure(b.factor, b.risk, STYLES, GROUPS, LEAST, 1, GROUPS))


@query("exposure_summary", sql.query("SELECT 1", "legs", "risk").replace("\nSELECT 1", f""",\n{_STYLE_LEGS} SELECT m.leg AS leg, exposure, round(avg(m.v), 9) AS mean, round(stddev_samp(m.v), 9) AS std, round(avg(m.v) / nullif(stddev_samp(m.v), 0), 9) AS mean_over_std,
  round(avg(m.v) / (nullif(stddev_samp(m.v), 0) / sqrt(count(m.v))), 9) AS t_stat, round(avg((m.v > 0)::INT), 9) AS positive_ratio, round(avg((m.v < 0)::INT), 9) AS negative_ratio, count(m.v) AS valid_days FROM six GROUP BY 1, 2"""))  # fmt: skip
def _(spark, d):
    b = Bound(spark, d)
    return rounded(ts.summary(xs.group_style_exposure(b.factor, b.risk, STYLES, GROUPS, LEAST, 1, GROUPS), ["leg", "exposure"], "value"))


@query("group_exposure_industry", sql.query("SELECT 1", "legs", "risk").replace("\nSELECT 1", f""",
means AS (SELECT l.trade_date, l.leg, r_name AS industry, avg((region = r_name)::INT) AS value FROM legs l JOIN risk USING (trade_date, symbol) CROSS JOIN (SELECT r_name FROM region) GROUP BY 1, 2, 3), {_differences("industry")}
SELECT trade_date, m.leg AS leg, industry, round(m.v, 9) AS value FROM six"""))  # fmt: skip
def _(spark, d):
    b = Bound(spark, d)
    return rounded(xs.group_industry_exposure(b.factor, b.risk, REGIONS, GROUPS, LEAST, 1, GROUPS))


@query("within_industry_groups", sql.query("SELECT 1", "pairs", "risk").replace("\nSELECT 1", f""",
w AS (SELECT *, {sql.bucket()} AS grp FROM (SELECT p.*, region, count(*) OVER (PARTITION BY trade_date, horizon, region) AS n, row_number() OVER (PARTITION BY trade_date, horizon, region ORDER BY value, symbol) AS r FROM pairs p JOIN risk USING (trade_date, symbol)) WHERE n >= 10)
SELECT trade_date, horizon, grp AS "group", round(avg(ret), 9) AS group_return FROM w GROUP BY 1, 2, 3"""))  # fmt: skip
def _(spark, d):
    b = Bound(spark, d)
    return rounded(xs.within_industry_group_returns(b.factor, b.returns, b.risk, GROUPS, LEAST))


# one style and industry dummies: demean by industry, then one slope (Frisch, Waugh and Lovell)
_FWL = """dm AS (SELECT trade_date, symbol, f1 - avg(f1) OVER i AS y, size - avg(size) OVER i AS x, count(*) OVER (PARTITION BY trade_date) AS n FROM cells JOIN who USING (symbol) WINDOW i AS (PARTITION BY trade_date, region)),
resid AS (SELECT trade_date, symbol, CASE WHEN n >= 10 THEN y - x * sum(x * y) OVER d / sum(x * x) OVER d END AS value FROM dm WINDOW d AS (PARTITION BY trade_date))"""


@query("neutralize_style1_industry", sql.query("SELECT 1", "cells", "who").replace("\nSELECT 1", f",\n{_FWL} SELECT trade_date, symbol, round(value, 8) AS value FROM resid"))
def _(spark, d):
    b = Bound(spark, d)
    return rounded(neutral.neutralized(b.factor, b.risk, ("size",), REGIONS, LEAST), 8)


@query("neutralized_ic_style1_industry", sql.query("SELECT 1", "returns", "who", "labels").replace("\nSELECT 1", f""",
{_FWL}, np AS (SELECT r.trade_date, r.horizon, e.value, r.ret FROM resid e JOIN returns r USING (trade_date, symbol) WHERE e.value IS NOT NULL AND r.ret IS NOT NULL)
SELECT l.trade_date, l.horizon, round(c.ic, 8) AS ic, coalesce(c.k, 0) AS n FROM labels l LEFT JOIN (SELECT trade_date, horizon, count(*) AS k, CASE WHEN count(*) >= 10 THEN corr(value, ret) END AS ic FROM np GROUP BY 1, 2) c USING (trade_date, horizon)"""))  # fmt: skip
def _(spark, d):
    b = Bound(spark, d)
    return rounded(neutral.neutralized_ic(b.factor, b.returns, b.risk, LABELS, ("size",), REGIONS, "pearson", LEAST), 8)


# three styles and industry dummies: demean by industry, then the normal equations by Cramer's rule
_THREE = """dm AS (SELECT trade_date, symbol, f1 - avg(f1) OVER i AS y, size - avg(size) OVER i AS a, weight - avg(weight) OVER i AS b, balance - avg(balance) OVER i AS c, count(*) OVER (PARTITION BY trade_date) AS n FROM cells JOIN who USING (symbol) WINDOW i AS (PARTITION BY trade_date, region)),
sm AS (SELECT *, sum(a * a) OVER d AS aa, sum(a * b) OVER d AS ab, sum(a * c) OVER d AS ac, sum(b * b) OVER d AS bb, sum(b * c) OVER d AS bc, sum(c * c) OVER d AS cc, sum(a * y) OVER d AS ay, sum(b * y) OVER d AS "by", sum(c * y) OVER d AS cy FROM dm WINDOW d AS (PARTITION BY trade_date)),
dt AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM sm),
resid AS (SELECT trade_date, symbol, CASE WHEN n >= 10 THEN y - a * (ay * (bb * cc - bc * bc) - ab * ("by" * cc - bc * cy) + ac * ("by" * bc - bb * cy)) / det - b * (aa * ("by" * cc - cy * bc) - ay * (ab * cc - bc * ac) + ac * (ab * cy - "by" * ac)) / det
  - c * (aa * (bb * cy - "by" * bc) - ab * (ab * cy - "by" * ac) + ay * (ab * bc - bb * ac)) / det END AS value FROM dt)"""  # fmt: skip
_RESIDUAL_IC = f"""{_THREE}, np AS (SELECT trade_date, r.horizon, e.value, r.ret FROM resid e JOIN returns r USING (trade_date, symbol) WHERE e.value IS NOT NULL AND r.ret IS NOT NULL),
nr AS (SELECT trade_date, horizon, rank() OVER (PARTITION BY trade_date, horizon ORDER BY value)::DOUBLE AS x, rank() OVER (PARTITION BY trade_date, horizon ORDER BY ret) + (count(*) OVER (PARTITION BY trade_date, horizon, ret) - 1) / 2.0 AS z FROM np),
nic AS (SELECT l.trade_date, l.horizon, round(c.ic, 9) AS ic, coalesce(c.k, 0) AS n FROM labels l LEFT JOIN (SELECT trade_date, horizon, count(*) AS k, CASE WHEN count(*) >= 10 THEN corr(x, z) END AS ic FROM nr GROUP BY 1, 2) c USING (trade_date, horizon))"""


@query("neutralize_styles_industry", sql.query("SELECT 1", "cells", "who").replace("\nSELECT 1", f",\n{_THREE} SELECT trade_date, symbol, round(value, 8) AS value FROM resid"))
def _(spark, d):
    b = Bound(spark, d)
    return rounded(neutral.neutralized(b.factor, b.risk, STYLES, REGIONS, LEAST), 8)


@query("neutralized_ic", sql.query("SELECT 1", "returns", "who", "labels").replace("\nSELECT 1", f",\n{_RESIDUAL_IC} SELECT * FROM nic"))
def _(spark, d):
    b = Bound(spark, d)
    return rounded(neutral.neutralized_ic(b.factor, b.returns, b.risk, LABELS, STYLES, REGIONS, "spearman", LEAST))


# ---- with the product's own groups and horizons --------------------------------------------------------------------

OWN_HORIZONS, OWN_LABELS, OWN_GROUPS = (1, 5, 10, 20), ("1d", "5d", "10d", "20d"), 10


def _own(spark, d) -> tuple[DataFrame, DataFrame]:
    """Factor and returns."""
    return tables.factor(tables.cells(spark, d)), panel.forward_returns(tables.cells(spark, d), OWN_HORIZONS)


@query("product_forward_returns", sql.product("SELECT trade_date, symbol, horizon, round(ret, 9) AS ret FROM returns WHERE ret IS NOT NULL", "returns"))
def _(spark, d):
    return rounded(_own(spark, d)[1])


@query("product_ic", sql.product("SELECT trade_date, horizon, round(ic, 9) AS ic, k AS n FROM ic", "ic"))
def _(spark, d):
    return rounded(xs.daily_ic(*_own(spark, d), OWN_LABELS, "spearman", LEAST))


@query("product_groups", sql.product('SELECT trade_date, horizon, grp AS "group", round(group_return, 9) AS group_return FROM groups', "groups"))
def _(spark, d):
    return rounded(xs.group_returns(*_own(spark, d), OWN_GROUPS, LEAST))


@query("product_long_short", sql.product("SELECT trade_date, horizon, round(spread, 9) AS spread FROM spread", "spread"))
def _(spark, d):
    return rounded(xs.long_short(xs.group_returns(*_own(spark, d), OWN_GROUPS, LEAST), 1, OWN_GROUPS))


@query("product_turnover", sql.product("SELECT 1", "own", "cal").replace("\nSELECT 1", f""",\n{_TURNOVER.replace("range(1, 6)", "range(1, 11)")} SELECT trade_date, grp::INT AS "group", round(turnover, 9) AS turnover FROM turned"""))
def _(spark, d):
    return rounded(xs.turnover(tables.factor(tables.cells(spark, d)), OWN_GROUPS, LEAST))


# ---- library -----------------------------------------------------------------------------------------------------


@query("peer_similarity", sql.query("""SELECT factor_id, round(avg(abs(rho)), 9) AS mean_abs, round(max(abs(rho)), 9) AS max_abs, count(*) AS n_obs FROM (SELECT trade_date, factor_id, CASE WHEN count(*) >= 10 AND min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS rho FROM (
  SELECT trade_date, factor_id, rank() OVER (PARTITION BY trade_date, factor_id ORDER BY value) + (count(*) OVER (PARTITION BY trade_date, factor_id, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY trade_date, factor_id ORDER BY peer) + (count(*) OVER (PARTITION BY trade_date, factor_id, peer) - 1) / 2.0 AS b FROM peers) GROUP BY 1, 2) WHERE rho IS NOT NULL GROUP BY 1""", "peers"))  # fmt: skip
def _(spark, d):
    b = Bound(spark, d)
    return rounded(diagnostics.similarity(b.factor, b.book, LEAST))


@query("topk_overlap", sql.query("""SELECT factor_id, round(avg(o), 9) AS overlap, count(*) AS n_obs FROM (SELECT trade_date, factor_id, (count(*) FILTER (vt <= k AND pt <= k) + count(*) FILTER (vb <= k AND pb <= k)) / (2.0 * max(k)) AS o FROM (
  SELECT *, least(10, greatest(1, n // 2)) AS k FROM (SELECT *, count(*) OVER q AS n, row_number() OVER (q ORDER BY value DESC, symbol) AS vt, row_number() OVER (q ORDER BY value, symbol) AS vb, row_number() OVER (q ORDER BY peer DESC, symbol) AS pt, row_number() OVER (q ORDER BY peer, symbol) AS pb FROM peers WINDOW q AS (PARTITION BY trade_date, factor_id)) WHERE n >= 10) GROUP BY 1, 2) GROUP BY 1""", "peers"))  # fmt: skip
def _(spark, d):
    b = Bound(spark, d)
    return rounded(diagnostics.top_overlap(b.factor, b.book, 10, LEAST))


@query("spanning_round1", sql.query("SELECT 1", "cells").replace("\nSELECT 1", """,
m AS (SELECT trade_date, symbol, f1 - avg(f1) OVER w AS y, f3 - avg(f3) OVER w AS x, f1, count(*) OVER w AS n FROM cells WINDOW w AS (PARTITION BY trade_date))
SELECT trade_date, symbol, round(CASE WHEN n >= 10 THEN y - x * sum(x * y) OVER w / sum(x * x) OVER w ELSE f1 END, 8) AS value FROM m WINDOW w AS (PARTITION BY trade_date)"""))  # fmt: skip
def _(spark, d):
    b = Bound(spark, d)
    return rounded(neutral.residual_of_peers(b.factor, b.book, ["f3"], LEAST), 8)


@query("incremental_r2", sql.query("""SELECT trade_date, horizon, round((ry * ry + rc * rc - 2 * ry * rc * pc) / (1 - pc * pc) - ry * ry, 8) AS r2 FROM (SELECT trade_date, horizon, corr(ret, f3) AS ry, corr(ret, value) AS rc, corr(f3, value) AS pc, count(*) AS n FROM pairs JOIN (SELECT trade_date, symbol, f3 FROM cells) USING (trade_date, symbol) GROUP BY 1, 2) WHERE n >= 10""", "pairs"))
def _(spark, d):
    b = Bound(spark, d)
    return rounded(neutral.incremental_r2(b.factor, b.book, b.returns.where("ret is not null"), ["f3"], LEAST), 8)


@query("monotonicity", sql.query("SELECT horizon, round(corr(a, b), 9) AS monotonicity FROM (SELECT horizon, grp::DOUBLE AS a, rank() OVER (PARTITION BY horizon ORDER BY r)::DOUBLE AS b FROM (SELECT horizon, grp, avg(group_return) AS r FROM groups GROUP BY 1, 2)) GROUP BY 1", "groups"))
def _(spark, d):
    return rounded(diagnostics.monotonicity(Bound(spark, d).groups))


@query("regime_ic", sql.query("""SELECT regime, horizon, round(avg(ic), 9) AS ic_mean, count(ic) AS n_obs FROM ic JOIN (SELECT trade_date, 'first_half' AS regime FROM cal WHERE month(trade_date) <= 6 UNION ALL SELECT trade_date, 'odd_year' FROM cal WHERE year(trade_date) % 2 = 1) USING (trade_date) GROUP BY 1, 2""", "ic", "cal"))
def _(spark, d):
    b = Bound(spark, d)
    days = b.cells.select("trade_date").distinct().withColumns({"first_half": F.month("trade_date") <= 6, "odd_year": F.year("trade_date") % 2 == 1})
    return rounded(diagnostics.regime_ic(b.ic(), days, ("first_half", "odd_year")))


@query("observed_ic_t", sql.query("SELECT horizon, round(avg(ic), 9) AS mean, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 9) AS t_stat, count(ic) AS n_obs FROM ic WHERE ic IS NOT NULL GROUP BY 1", "ic"))
def _(spark, d):
    b = Bound(spark, d)
    return rounded(diagnostics.mean_t(diagnostics.observed_ic(b.factor, b.returns, LEAST), ["horizon"], "ic"))


@query("trading_days", sql.query("SELECT min(trade_date) AS start, max(trade_date) AS end, count(DISTINCT trade_date) AS n FROM (SELECT trade_date FROM cells UNION ALL SELECT CAST(ts AS DATE) FROM events)", "cells"))
def _(spark, d):
    return diagnostics.trading_days([tables.cells(spark, d), tables.user_days(spark, d)])


_SPANNED = """m AS (SELECT trade_date, symbol, f1 - avg(f1) OVER w AS y, {0} - avg({0}) OVER w AS x, f1, count(*) OVER w AS n FROM cells WINDOW w AS (PARTITION BY trade_date)),
left_over AS (SELECT trade_date, symbol, CASE WHEN n >= 10 THEN y - x * sum(x * y) OVER w / sum(x * x) OVER w ELSE f1 END AS value FROM m WINDOW w AS (PARTITION BY trade_date))"""
_NAMES = ("f2", "f3", "f4")


@query("spanning_top_factors", sql.query("""SELECT 1 AS round, factor_id, round(avg(abs(rho)), 9) AS contribution, row_number() OVER (ORDER BY avg(abs(rho)) DESC, factor_id)::INT AS place FROM (SELECT trade_date, factor_id, CASE WHEN count(*) >= 10 AND min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS rho FROM (
  SELECT trade_date, factor_id, rank() OVER (PARTITION BY trade_date, factor_id ORDER BY value) + (count(*) OVER (PARTITION BY trade_date, factor_id, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY trade_date, factor_id ORDER BY peer) + (count(*) OVER (PARTITION BY trade_date, factor_id, peer) - 1) / 2.0 AS b FROM peers) GROUP BY 1, 2) WHERE rho IS NOT NULL GROUP BY 2""", "peers"))  # fmt: skip
def _(spark, d):
    b = Bound(spark, d)
    rounds, _ = diagnostics.spanning(b.factor, b.book, b.returns, 1, 1, LEAST, keep=lambda df: df)
    rows = [(1, name, value, i) for i, (name, value) in enumerate(rounds[0]["most_like"], 1)]
    return rounded(spark.createDataFrame(rows, "round int, factor_id string, contribution double, place int"))


# ---- sources and views again, as a user meets them -----------------------------------------------------------------


@query("membership_distinct", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date, CAST(l_suppkey AS VARCHAR) AS symbol FROM lineitem")
def _(spark, d):
    return market.members(tables.read(spark, d, "lineitem").select(F.col("l_shipdate").alias("date"), F.col("l_suppkey").alias("asset")))


@query("risk_one_hot", """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS trade_date, CAST(o_custkey AS VARCHAR) AS symbol, round(avg(o_totalprice), 4) AS size, max((o_orderstatus = 'F')::INT)::BIGINT + max((o_orderstatus = 'O')::INT) + max((o_orderstatus = 'P')::INT) AS memberships FROM orders GROUP BY 1, 2""")
def _(spark, d):
    from tessera.sources.risk import normalize_risk

    o = tables.read(spark, d, "orders").withColumn("date", F.trunc("o_orderdate", "month"))
    raw = o.groupBy("date", F.col("o_custkey").alias("symbol")).agg(F.avg("o_totalprice").alias("size"), *[F.max((F.col("o_orderstatus") == s).cast("double")).alias(s) for s in "FOP"])
    return normalize_risk(raw, ("size",)).select("trade_date", "symbol", F.round("size", 4).alias("size"), F.size("industries").cast("long").alias("memberships"))


@query("regime_flags", """SELECT DISTINCT CAST(o_orderdate AS DATE) AS trade_date, o_orderkey % 3 = 0 AS bull, o_orderkey % 2 = 1 AS bear FROM orders""")
def _(spark, d):
    from tessera.sources.books import normalize_regimes

    o = tables.read(spark, d, "orders")
    raw = o.select(F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderkey") % 3 == 0, " Yes").otherwise("").alias("bull"), (F.col("o_orderkey") % 2).alias("bear"))
    return normalize_regimes(raw, ["bull", "bear"]).distinct()


@query("user_day_ic", """WITH cells AS (SELECT CAST(ts AS DATE) AS trade_date, CAST(user_id AS VARCHAR) AS symbol, round(avg(value), 6) AS value, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2),
cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS t FROM (SELECT DISTINCT trade_date FROM cells)), px AS (SELECT * FROM cells JOIN cal USING (trade_date)),
pairs AS (SELECT a.trade_date, a.n AS v, c.value / b.value - 1 AS ret FROM px a JOIN px b ON b.symbol = a.symbol AND b.t = a.t + 1 JOIN px c ON c.symbol = a.symbol AND c.t = a.t + 2 WHERE b.value > 0 AND c.value > 0)
SELECT trade_date, '1d' AS horizon, CASE WHEN count(v) >= 20 THEN round(corr(v, ret), 9) END AS ic, count(v) AS n FROM cal LEFT JOIN pairs USING (trade_date) GROUP BY 1""")  # fmt: skip
def _(spark, d):
    e = tables.read(spark, d, "events").groupBy(F.to_date("ts").alias("trade_date"), F.col("user_id").cast("string").alias("symbol")).agg(F.round(F.avg("value"), 6).alias("open_price"), F.count("*").cast("double").alias("value"))
    return rounded(xs.daily_ic(e, panel.forward_returns(e, [1]), ["1d"], "pearson", 20))


@query("group_view_curves", sql.query(f"""SELECT horizon, grp AS "group", trade_date, round(exp(sum(CASE WHEN k = 1 THEN 0 ELSE ln(1 + coalesce(r, 0)) END) OVER (PARTITION BY horizon, grp ORDER BY trade_date ROWS UNBOUNDED PRECEDING)), 9) AS nav FROM (
  SELECT k.trade_date, k.horizon, k.grp, {_DAILY.format("g.group_return").replace("WHEN horizon", "WHEN k.horizon")} AS r, row_number() OVER (PARTITION BY k.horizon, k.grp ORDER BY k.trade_date) AS k FROM (SELECT * FROM (SELECT DISTINCT trade_date FROM groups WHERE trade_date BETWEEN DATE '{START}' AND DATE '{END}') CROSS JOIN (SELECT DISTINCT horizon, grp FROM groups)) k
  LEFT JOIN groups g ON g.trade_date = k.trade_date AND g.horizon = k.horizon AND g.grp = k.grp)""", "groups"))  # fmt: skip
def _(spark, d):
    from tessera.plans.views import group_return_view

    return rounded(group_return_view(Bound(spark, d).groups, DAYS, GROUPS, START, END).curves)


@query("turnover_edges", sql.query("SELECT 1", "own", "cal").replace("\nSELECT 1", f""",\n{_TURNOVER} SELECT trade_date, 'edge_avg' AS "group", round(avg(turnover), 9) AS turnover FROM turned WHERE grp IN (1, 5) GROUP BY 1"""))
def _(spark, d):
    return rounded(xs.turnover_edges(xs.turnover(tables.factor(tables.cells(spark, d)), GROUPS, LEAST), GROUPS))


@query("entry_day_filter", sql.query("SELECT 1", "grid", "cells").replace("\nSELECT 1", f""",\n{_FLAGGED}, entry AS (SELECT g.trade_date, g.symbol, f.symbol IS NOT NULL AND {_VALID} AS valid FROM grid g LEFT JOIN cal n ON n.t = g.t + 1 LEFT JOIN flagged f ON f.trade_date = n.trade_date AND f.symbol = g.symbol)
SELECT trade_date, count(*) AS pool_stock_count, count(*) FILTER (valid AND f1 IS NOT NULL) AS valid_factor_count, round(count(*) FILTER (valid AND f1 IS NOT NULL) / count(*), 9) AS coverage_ratio FROM entry LEFT JOIN cells USING (trade_date, symbol) GROUP BY 1"""))  # fmt: skip
def _(spark, d):
    from tessera.plans.api import prepared
    from tessera.plans.config import BacktestConfig

    b = Bound(spark, d)
    _, quality, _ = prepared(b.factor, panel.listed_days(b.cells), None, BacktestConfig(min_listed_days=12))
    return rounded(quality.select("trade_date", "pool_stock_count", "valid_factor_count", "coverage_ratio"))


# ---- stored runs: everything below is read back from a published run ------------------------------------------------

_RUNS: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str):
    """A published run over the panel, made once an application, below the warehouse."""
    from tessera.plans import api
    from tessera.plans.config import BacktestConfig

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        b = Bound(spark, sf_dir)
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera-runs/{key[0]}"
        config = BacktestConfig(
            factor_name=f"panel-{len(_RUNS)}", output_root=root, horizons=HORIZONS, n_groups=GROUPS, min_ic_stocks=LEAST, min_group_stocks=LEAST, min_industry_ic_stocks=LEAST, tradability_filter=False, ic_methods=("spearman", "pearson"),
            selected_pools=("all", "rich"), yearly_ic_min_days=10, group_return_windows={"1y": 12, "3y": 36}, styles=STYLES, verbose=False,
        )
        _RUNS[key] = api.run_factor_backtest_data(spark, b.factor, b.cells, config, pools={"rich": tables.pool(b.cells, b.who)}, risk=b.risk).run_dir
    return api.LoadedBacktestResult(spark, _RUNS[key])


def _stored_as(name: str, table: str, like: str, columns: str = "*", where: str = "true") -> None:
    """A stored or derived table of the run, held against the SQL of a query that makes it from the panel."""

    def read(spark, d):
        found = stored(spark, d).read_table(table)
        return rounded(found.where(where)) if columns == "*" else rounded(found.where(where).select(*columns.split(", ")))

    shown = columns if columns == "*" else ", ".join(f'"{c}"' for c in columns.split(", "))
    query(name, f"SELECT {shown} FROM ({_ORACLE[like]}) WHERE {where}")(read)


_stored_as("run_data_quality", "data_quality", "dense_grid_quality")
_stored_as("run_daily_ic", "daily_ic", "ic_spearman", "trade_date, horizon, ic")
_stored_as("run_daily_ic_pearson", "daily_ic_pearson", "ic_pearson", "trade_date, horizon, ic")
_stored_as("run_cumulative_ic", "cumulative_ic", "ic_cumulative")
_stored_as("run_ic_stats", "ic_stats", "ic_stats_hac")
_stored_as("run_ic_overview", "ic_overview", "ic_rolling20", where="horizon = '3d'")
_stored_as("run_yearly_ic", "yearly_ic_stats", "ic_yearly")
_stored_as("run_style_exposure", "factor_style_exposure_corr_spearman", "style_exposure_corr")
_stored_as("run_style_exposure_summary", "factor_style_exposure_summary_spearman", "style_corr_summary")
_stored_as("run_group_style_exposure", "group_style_exposure_daily", "group_exposure_style")
_stored_as("run_group_industry_exposure", "group_industry_exposure_daily", "group_exposure_industry")
_stored_as("run_group_exposure_summary", "group_style_exposure_summary", "exposure_summary")
_stored_as("run_industry_neutralized_ic", "style_industry_neutralized_ic_spearman", "neutralized_ic", "trade_date, horizon, ic")
_stored_as("run_group_returns", "daily_group_returns", "group_returns")
_ORACLE["run_group_summary"] = sql.query('SELECT grp AS "group", horizon, round(avg(group_return), 9) AS mean_return FROM groups GROUP BY 1, 2', "groups")
_stored_as("run_group_summary", "group_return_summary", "run_group_summary")
_stored_as("run_group_curves", "group_cumulative_returns_3d", "group_cumulative", "trade_date, group, nav")
_ORACLE["run_group_curves"] = _ORACLE["run_group_curves"].replace("WHERE true", "WHERE horizon = '3d'")
_stored_as("run_within_industry", "within_industry_daily_group_returns", "within_industry_groups")
_stored_as("run_layered", "layered_group_return_summary", "group_layered")
_stored_as("run_long_short", "daily_long_short_returns", "long_short")
_stored_as("run_daily_equivalent", "cumulative_daily_equivalent_long_short_returns", "long_short_daily_equiv", "trade_date, horizon, spread")
_stored_as("run_turnover", "daily_group_turnover", "turnover")
_stored_as("run_turnover_summary", "group_turnover_summary", "turnover_summary")
_stored_as("run_performance", "performance_metrics", "performance")


@query("yearly_mean_ic", sql.query("""SELECT year(trade_date)::INT AS year, CASE WHEN count(ic) FILTER (horizon = '1d') >= 10 THEN round(avg(ic) FILTER (horizon = '1d'), 9) END AS "1d", CASE WHEN count(ic) FILTER (horizon = '3d') >= 10 THEN round(avg(ic) FILTER (horizon = '3d'), 9) END AS "3d" FROM ic GROUP BY 1""", "ic"))
def _(spark, d):
    return rounded(stored(spark, d).read_table("yearly_mean_ic"))


_RICH_IC = sql.query("SELECT 'rich' AS pool, trade_date, horizon, round(ic, 9) AS ic FROM ic", "who", "ic").replace("FROM cells c JOIN returns r", "FROM (SELECT * FROM cells SEMI JOIN (SELECT symbol FROM who WHERE balance > 0) USING (symbol)) c JOIN returns r")


@query("pool_union_scan", f"""SELECT * FROM ({sql.query("SELECT 'all' AS pool, trade_date, horizon, round(ic, 9) AS ic FROM ic", "ic")}) UNION ALL SELECT * FROM ({_RICH_IC})""")
def _(spark, d):
    run = stored(spark, d)
    parts = [run.read_table("daily_ic", p).select(F.lit(p).alias("pool"), "trade_date", "horizon", "ic") for p in run.available_pools]
    return rounded(parts[0].unionByName(parts[1]))


@query("run_ic_view", _ORACLE["ic_view_range"])
def _(spark, d):
    return rounded(stored(spark, d).ic_view("all", start=START, end=END).curves)


@query("run_group_view", _ORACLE["group_view_curves"])
def _(spark, d):
    return rounded(stored(spark, d).group_return_view("all", start=START, end=END).curves)


@query("run_quality_view", f"SELECT trade_date, coverage_ratio, zero_ratio, nan_ratio, inf_ratio FROM ({_ORACLE['dense_grid_quality']}) WHERE trade_date BETWEEN DATE '{START}' AND DATE '{END}'")
def _(spark, d):
    return rounded(stored(spark, d).quality_view("all", START, END).ratios)


_MINIMAL = ("ic_mean", "icir", "icir_raw"), {"ic_t_stat": "t_stat", "ic_t_stat_hac": "t_stat_hac"}, {"long_short_mean": "mean", "long_short_sharpe": "sharpe", "long_short_t_stat": "t_stat", "long_short_mean_over_std_raw": "mean_over_std_raw", "long_short_t_stat_hac": "t_stat_hac"}
@query("minimal_summary")
def _(spark, d):
    from tessera.plans.api import minimal_row

    b = Bound(spark, d)
    return rounded(minimal_row(b.factor, b.cells, None, HORIZONS, "f1", "all", LEAST, LEAST, 5))


def _minimal_sql() -> str:
    parts = []
    for x in LABELS:
        ic = {**{n: n for n in _MINIMAL[0]}, **_MINIMAL[1]}
        parts.append(f"""(SELECT {", ".join(f'{c} AS "{n}_{x}"' for n, c in ic.items())} FROM ({_ORACLE["ic_stats_hac"]}) WHERE horizon = '{x}')""")
        parts.append(f"""(SELECT {", ".join(f'{c} AS "{n}_{x}"' for n, c in _MINIMAL[2].items())} FROM ({_ORACLE["performance"]}) WHERE series = 'long_short_{x}')""")
    head = f"(SELECT min(trade_date) AS start_date, max(trade_date) AS end_date, round(avg(coverage_ratio), 9) AS coverage_mean, round(avg(valid_factor_count), 9) AS valid_factor_count_mean FROM ({_ORACLE['dense_grid_quality']}))"
    return f"SELECT 'f1' AS factor_name, 'all' AS pool, * FROM {', '.join([head, *parts])}"


_ORACLE["minimal_summary"] = _minimal_sql()

"""SQL building blocks that say what the panel operators say, for an independent engine to check them."""

from __future__ import annotations

from tessera.functions.expr import quantile_points

CTES = {
    "cells": ((), """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date, CAST(l_suppkey AS VARCHAR) AS symbol,
        round(sum(l_extendedprice) / sum(l_quantity), 6) AS open_price, round(max(l_extendedprice / l_quantity), 6) AS high_price, round(min(l_extendedprice / l_quantity), 6) AS low_price,
        round(sum(l_extendedprice) / sum(l_quantity) * 1.3::DOUBLE, 6) AS limit_up_price, round(sum(l_extendedprice) / sum(l_quantity) * 0.7::DOUBLE, 6) AS limit_down_price,
        CASE WHEN max(l_discount) < 0.06 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_st, CASE WHEN sum(l_quantity) < 60 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_suspended,
        round(avg(l_discount), 6) AS f1, round(avg(l_tax), 6) AS f2, sum(l_quantity) AS f3, count(*)::DOUBLE AS f4,
        round(ln(sum(l_extendedprice)), 6) AS size, round(avg(l_quantity), 6) AS weight FROM lineitem GROUP BY 1, 2"""),
    "who": ((), "SELECT CAST(s_suppkey AS VARCHAR) AS symbol, r_name AS region, s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "cal": (("cells",), "SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS t FROM (SELECT DISTINCT trade_date FROM cells)"),
    "grid": (("cells", "cal"), "SELECT trade_date, t, symbol FROM cal CROSS JOIN (SELECT DISTINCT symbol FROM cells)"),
    "px": (("cells", "cal"), "SELECT cells.*, t FROM cells JOIN cal USING (trade_date)"),
    "returns": (("grid", "px"), """SELECT g.trade_date, g.symbol, h.horizon, CASE WHEN b.open_price > 0 AND e.open_price > 0 THEN e.open_price / b.open_price - 1 END AS ret
        FROM grid g CROSS JOIN (VALUES ('1d', 1), ('3d', 3)) h(horizon, n) LEFT JOIN px b ON b.symbol = g.symbol AND b.t = g.t + 1 LEFT JOIN px e ON e.symbol = g.symbol AND e.t = g.t + h.n + 1"""),
    "pairs": (("returns",), "SELECT r.trade_date, r.symbol, r.horizon, c.f1 AS value, r.ret FROM cells c JOIN returns r USING (trade_date, symbol) WHERE c.f1 IS NOT NULL AND r.ret IS NOT NULL"),
    "ranked": (("pairs",), """SELECT trade_date, horizon, rank() OVER (PARTITION BY trade_date, horizon ORDER BY value) + (count(*) OVER (PARTITION BY trade_date, horizon, value) - 1) / 2.0 AS a,
        rank() OVER (PARTITION BY trade_date, horizon ORDER BY ret) + (count(*) OVER (PARTITION BY trade_date, horizon, ret) - 1) / 2.0 AS b FROM pairs"""),
    "labels": (("cal",), "SELECT trade_date, horizon, n FROM cal CROSS JOIN (VALUES ('1d', 1), ('3d', 3)) h(horizon, n)"),
    "ic": (("ranked", "labels"), """SELECT l.trade_date, l.horizon, l.n AS days, coalesce(c.k, 0) AS k, c.ic FROM labels l LEFT JOIN (
        SELECT trade_date, horizon, count(*) AS k, CASE WHEN count(*) >= 10 AND min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS ic FROM ranked GROUP BY 1, 2) c USING (trade_date, horizon)"""),
    "bucketed": (("pairs",), "SELECT * EXCLUDE (n, r), {bucket} AS grp FROM (SELECT *, count(*) OVER (PARTITION BY trade_date, horizon) AS n, row_number() OVER (PARTITION BY trade_date, horizon ORDER BY value, symbol) AS r FROM pairs) WHERE n >= 10"),
    "groups": (("bucketed",), "SELECT trade_date, horizon, grp, avg(ret) AS group_return FROM bucketed GROUP BY 1, 2, 3"),
    "spread": (("groups",), """SELECT trade_date, horizon, max(CASE WHEN grp = 5 THEN group_return END) - max(CASE WHEN grp = 1 THEN group_return END) AS spread FROM groups GROUP BY 1, 2"""),
    "own": (("cells",), "SELECT * EXCLUDE (n, r), {bucket} AS grp FROM (SELECT trade_date, symbol, f1 AS value, count(*) OVER (PARTITION BY trade_date) AS n, row_number() OVER (PARTITION BY trade_date ORDER BY f1, symbol) AS r FROM cells WHERE f1 IS NOT NULL) WHERE n >= 10"),
    "risk": (("cells", "who"), "SELECT trade_date, symbol, size, weight, balance, region FROM cells JOIN who USING (symbol)"),
    "legs": (("own",), "SELECT trade_date, symbol, 'pool' AS leg FROM own UNION ALL SELECT trade_date, symbol, 'G1' FROM own WHERE grp = 1 UNION ALL SELECT trade_date, symbol, 'G5' FROM own WHERE grp = 5"),
    "book": (("cells",), "SELECT trade_date, symbol, 'f2' AS factor_id, f2 AS value FROM cells UNION ALL SELECT trade_date, symbol, 'f3', f3 FROM cells UNION ALL SELECT trade_date, symbol, 'f4', f4 FROM cells"),
    "peers": (("book",), "SELECT c.trade_date, c.symbol, b.factor_id, c.f1 AS value, b.value AS peer FROM cells c JOIN book b USING (trade_date, symbol)"),
}


def bucket(groups: int = 5) -> str:
    """The bucket of rank r among n."""
    edge = lambda q: f"CASE WHEN {q}*(n-1) - floor({q}*(n-1)) >= 0.5::DOUBLE THEN (floor({q}*(n-1)) + 2) - (1 - ({q}*(n-1) - floor({q}*(n-1)))) ELSE (floor({q}*(n-1)) + 1) + ({q}*(n-1) - floor({q}*(n-1))) END"
    return "(1 + " + " + ".join(f"CASE WHEN ({edge(f'{q!r}::DOUBLE')}) < r THEN 1 ELSE 0 END" for q in quantile_points(groups)) + ")"


def query(body: str, *names: str, groups: int = 5) -> str:
    """body with the named blocks, and those that they need, before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    text = ",\n".join(f"{n} AS ({CTES[n][1].replace('{bucket}', bucket(groups))})" for n in order)
    return f"WITH {text}\n{body}"


def product(body: str, *names: str) -> str:
    """As query(), with the product's own ten groups and horizons of 1, 5, 10 and 20."""
    text = query(body, *names, groups=10)
    return text.replace("('1d', 1), ('3d', 3)", "('1d', 1), ('5d', 5), ('10d', 10), ('20d', 20)").replace("grp = 5 THEN", "grp = 10 THEN")


def hac(series: str, keys: str, value: str, days: str) -> str:
    """Blocks of a t of the mean with autocovariances, from a block `series` with trade_date: hac(keys, t_hac, lag)."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    mine = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
x0 AS (SELECT {keys}, trade_date, {value} AS v, {days} - 1 AS want FROM {series} WHERE {value} IS NOT NULL),
x1 AS (SELECT *, v - avg(v) OVER (PARTITION BY {keys}) AS d, row_number() OVER (PARTITION BY {keys} ORDER BY trade_date) AS i, count(*) OVER (PARTITION BY {keys}) AS n, avg(v) OVER (PARTITION BY {keys}) AS m FROM x0),
x2 AS (SELECT *, least(want, n - 1) AS lag FROM x1),
x3 AS (SELECT {mine}, max(a.n) AS n, max(a.m) AS m, max(a.lag) AS lag,
  sum(CASE WHEN a.i = b.i THEN 1.0 WHEN a.i > b.i AND a.i - b.i <= a.lag THEN 2.0 * (1.0 - (a.i - b.i) / (a.lag + 1.0)) ELSE 0.0 END * a.d * b.d) / max(a.n) AS lrv
  FROM x2 a JOIN x2 b ON {on} AND a.i >= b.i AND a.i - b.i <= a.lag GROUP BY ALL),
hac AS (SELECT {keys}, CASE WHEN n >= 2 AND lrv > 0 THEN m / sqrt(lrv / n) END AS t_hac, CASE WHEN n >= 2 THEN lag ELSE 0 END AS lag FROM x3)"""

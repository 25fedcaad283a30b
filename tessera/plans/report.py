"""One self-contained HTML page of a run, from its small tables; lines are drawn as inline SVG."""

from __future__ import annotations

import html
from collections.abc import Mapping

from pyspark.sql import DataFrame

COLOURS = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf")


def number(x) -> str:
    """Four decimals at most, and no negative zero."""
    if isinstance(x, float):
        text = f"{x:.4f}".rstrip("0").rstrip(".")
        return "0" if text in ("-0", "") else text
    return "" if x is None else str(x)


def table(df: DataFrame) -> str:
    """A whole table, in order of its keys."""
    rows = df.orderBy(*[c for c in ("trade_date", "year", "horizon", "group", "series") if c in df.columns]).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(number(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def lines(df: DataFrame, key: str, value: str, width: int = 760, height: int = 260) -> str:
    """A line for each key over trade_date."""
    series: dict[str, list[tuple]] = {}
    for r in df.select("trade_date", key, value).where(f"`{value}` is not null").orderBy("trade_date").collect():
        series.setdefault(str(r[1]), []).append((r[0].toordinal(), r[2]))
    points = [p for s in series.values() for p in s]
    if not points:
        return "<p>no data</p>"
    x0, x1, y0, y1 = min(p[0] for p in points), max(p[0] for p in points), min(p[1] for p in points), max(p[1] for p in points)
    at = lambda x, y: f"{40 + (x - x0) / max(x1 - x0, 1) * (width - 60):.1f},{height - 20 - (y - y0) / ((y1 - y0) or 1) * (height - 40):.1f}"
    drawn, legend = [], []
    for i, (name, s) in enumerate(sorted(series.items())):
        colour = COLOURS[i % len(COLOURS)]
        drawn.append(f'<polyline fill="none" stroke="{colour}" points="{" ".join(at(*p) for p in s)}"/>')
        legend.append(f'<span style="color:{colour}">{html.escape(name)}</span>')
    return f'<svg width="{width}" height="{height}"><text x="2" y="14">{number(float(y1))}</text><text x="2" y="{height - 8}">{number(float(y0))}</text>{"".join(drawn)}</svg><p>{" ".join(legend)}</p>'


def page(title: str, meta: Mapping, pools: Mapping[str, Mapping], log: Mapping) -> str:
    parts = [f"<h1>{html.escape(title)}</h1>", "<ul>" + "".join(f"<li>{html.escape(str(k))}: {html.escape(str(v))}</li>" for k, v in meta.items()) + "</ul>"]
    for pool, tables in pools.items():
        parts.append(f"<h2>{html.escape(pool)}</h2>")
        for name in ("ic_stats", "group_return_summary", "performance_metrics", "data_quality"):
            if name in tables:
                parts.append(f"<h3>{name}</h3>{table(tables[name])}")
        if "cumulative_ic" in tables:
            parts.append(f"<h3>cumulative IC</h3>{lines(tables['cumulative_ic'], 'horizon', 'cumulative')}")
        for name in sorted(n for n in tables if n.startswith("group_cumulative_returns_")):
            parts.append(f"<h3>{html.escape(name)}</h3>{lines(tables[name], 'group', 'nav')}")
    status = "".join(f"<tr><td>{html.escape(p)}</td><td>{html.escape(s)}</td><td>{html.escape(str(x.get('status')))}</td><td>{html.escape(str(x.get('error') or ''))}</td></tr>" for p, own in log.get("sections", {}).items() for s, x in own.items())
    parts.append(f"<h2>status</h2><table>{status}</table>")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>body{{font-family:sans-serif}}td,th{{border:1px solid #ccc;padding:2px 6px}}table{{border-collapse:collapse}}</style></head><body>{''.join(parts)}</body></html>"

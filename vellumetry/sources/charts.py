"""Charts as inline SVG, from aggregated rows."""

from __future__ import annotations

import base64
from dataclasses import dataclass
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame

from vellumetry.operators import frequency
from vellumetry.operators.correlation import CorrelationAnalyzer

WIDTH, HEIGHT, PAD = 640, 360, 48


@dataclass
class Chart:
    """A chart and the numbers it shows."""

    kind: str
    title: str
    column: str | None
    svg: str
    stats: dict

    @property
    def image_base64(self) -> str:
        return base64.b64encode(self.svg.encode()).decode()

    @property
    def data_uri(self) -> str:
        return "data:image/svg+xml;base64," + self.image_base64

    def save(self, path: str | Path) -> Path:
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(self.svg, encoding="utf-8")
        return path


def _frame(title: str, body: str, height: int = HEIGHT) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {height}" font-family="sans-serif" font-size="12"><title>{escape(title)}</title><text x="{WIDTH / 2}" y="20" text-anchor="middle">{escape(title)}</text>{body}</svg>'


def _bars(heights: list[float], labels: list[str]) -> str:
    top, step = max(heights, default=0) or 1, (WIDTH - 2 * PAD) / max(1, len(heights))
    out = []
    for i, (h, text) in enumerate(zip(heights, labels)):
        tall = (HEIGHT - 2 * PAD) * h / top
        out.append(f'<rect x="{PAD + i * step:.1f}" y="{HEIGHT - PAD - tall:.1f}" width="{step * 0.92:.1f}" height="{tall:.1f}" fill="#4878a8"><title>{escape(text)}</title></rect>')
    return "".join(out)


def _line(points: list[tuple[float, float]]) -> str:
    lo, hi = points[0][0], points[-1][0]
    top = max(y for _, y in points) or 1
    at = " ".join(f"{PAD + (WIDTH - 2 * PAD) * (x - lo) / (hi - lo):.1f},{HEIGHT - PAD - (HEIGHT - 2 * PAD) * y / top:.1f}" for x, y in points)
    return f'<polyline points="{at}" fill="none" stroke="#b04848" stroke-width="2"/>'


class DistributionPlotter:
    def _stats(self, df: DataFrame, column: str) -> dict:
        s = frequency.distribution_stats(df, column).first().asDict()
        if not s["count"]:
            raise ValueError(f"Column '{column}' has no numeric values to plot.")
        return s

    def histogram(self, df: DataFrame, column: str, bins: int = 30) -> Chart:
        stats = self._stats(df, column)
        rows = sorted(frequency.histogram(df, column, bins=bins).collect(), key=lambda r: r.bin)
        body = _bars([r["count"] for r in rows], [f"{r.lower:g} to {r.upper:g}: {r['count']}" for r in rows])
        return Chart("histogram", f"Histogram of {column}", column, _frame(f"Histogram of {column}", body), stats)

    def density(self, df: DataFrame, column: str) -> Chart:
        stats = self._stats(df, column)
        points = sorted((r.x, r.density) for r in frequency.density_curve(df, column).collect())
        return Chart("density", f"Density of {column}", column, _frame(f"Density of {column}", _line(points)), stats)

    def combined(self, df: DataFrame, column: str, bins: int = 30) -> Chart:
        stats = self._stats(df, column)
        rows = sorted(frequency.histogram(df, column, bins=bins).collect(), key=lambda r: r.bin)
        body = _bars([r.density for r in rows], [f"{r.lower:g} to {r.upper:g}" for r in rows])
        if stats["std"]:
            body += _line(sorted((r.x, r.density) for r in frequency.density_curve(df, column).collect()))
        return Chart("combined", f"Distribution of {column}", column, _frame(f"Distribution of {column}", body), stats)


def category_chart(df: DataFrame, column: str, top_n: int = 10) -> Chart:
    rows = sorted(frequency.category_counts(df, [column], top_n).collect(), key=lambda r: r.rank)
    if not rows:
        raise ValueError(f"Column '{column}' has no values to plot.")
    body = _bars([r["count"] for r in rows], [f"{r.category}: {r['count']}" for r in rows])
    return Chart("categorical", f"Category Distribution of {column}", column, _frame(f"Category Distribution of {column}", body), {r.category: r["count"] for r in rows})


def correlation_heatmap(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> Chart:
    report = CorrelationAnalyzer().analyze(df, method, columns)
    side = (WIDTH - 2 * PAD) / len(report.columns)
    cells = []
    for i, a in enumerate(report.columns):
        for j, b in enumerate(report.columns):
            r = report.matrix[a][b]
            fill = "#eee" if r is None else f"rgba({'176,72,72' if r > 0 else '72,120,168'},{abs(r):.2f})"
            cells.append(f'<rect x="{PAD + j * side:.1f}" y="{PAD + i * side:.1f}" width="{side:.1f}" height="{side:.1f}" fill="{fill}"><title>{escape(f"{a} / {b}: {r}")}</title></rect>')
    return Chart("correlation", "Correlation Heatmap", None, _frame("Correlation Heatmap", "".join(cells), WIDTH), {})

"""The exploratory report: summary, columns, charts and sentences, as JSON or HTML."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame

from vellumetry.functions.jsonable import to_jsonable
from vellumetry.operators.correlation import CorrelationAnalyzer
from vellumetry.operators.outliers import outliers
from vellumetry.operators.profile import TableProfile
from vellumetry.operators.scores import DataQualityScorer
from vellumetry.sources import charts as G

NOTABLE_OUTLIERS = 5.0


@dataclass
class EDAReport:
    source_file: str
    summary: dict
    columns: list[dict]
    charts: list[dict] = field(default_factory=list)
    insights: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return to_jsonable({"source_file": self.source_file, "summary": self.summary, "columns": self.columns, "charts": self.charts, "insights": self.insights})

    def to_json(self, path: str | Path) -> Path:
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(self.to_dict(), indent=2, allow_nan=False), encoding="utf-8")
        return path

    def to_html(self, path: str | Path) -> Path:
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        keys = list(self.columns[0]) if self.columns else []
        table = "".join("<tr>" + "".join(f"<td>{escape(str(c[k]))}</td>" for k in keys) + "</tr>" for c in self.columns)
        head = "".join(f"<th>{escape(k)}</th>" for k in keys)
        figures = "".join(f'<figure><img alt="{escape(c["title"])}" src="data:image/svg+xml;base64,{c["image_base64"]}"><figcaption>{escape(c["title"])}</figcaption></figure>' for c in self.charts)
        says = "".join(f"<li>{escape(i)}</li>" for i in self.insights)
        facts = "".join(f"<li>{escape(k)}: {escape(str(v))}</li>" for k, v in self.summary.items())
        page = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>EDA Report: {escape(self.source_file)}</title></head><body><h1>EDA Report: {escape(self.source_file)}</h1><h2>Summary</h2><ul>{facts}</ul><h2>Insights</h2><ul>{says}</ul><h2>Columns</h2><table><tr>{head}</tr>{table}</table><h2>Charts</h2>{figures}</body></html>"
        path.write_text(page, encoding="utf-8")
        return path


class EDAReportGenerator:
    def __init__(self, quality_scorer: DataQualityScorer | None = None, max_distribution_charts: int = 8, max_categorical_charts: int = 8):
        self.quality = quality_scorer or DataQualityScorer()
        self.max_distribution, self.max_categorical = max_distribution_charts, max_categorical_charts

    def generate(self, df: DataFrame, source_file: str = "unknown") -> EDAReport:
        p = TableProfile(df)
        if not p.n_rows or not p.n_columns:
            raise ValueError("Cannot generate an EDA report for an empty DataFrame.")
        score = self.quality.score(df, source_file, profile=p)
        columns = [
            {
                "name": c,
                "category": p.categories[c].category,
                "dtype": p.columns[c].dtype,
                "missing_count": p.severities[c].null_count,
                "missing_percentage": p.severities[c].null_percentage,
                "missing_severity": p.severities[c].severity,
                "unique_count": p.columns[c].unique_count,
            }
            for c in df.columns
        ]
        summary = {"row_count": p.n_rows, "column_count": p.n_columns, "quality_score": score.overall_score, "quality_grade": score.grade, "duplicate_row_count": p.duplicate_rows, "total_missing_cells": p.missing_cells}
        of = lambda category: [c["name"] for c in columns if c["category"] == category]
        return EDAReport(source_file, summary, columns, self._charts(df, of("numerical"), of("categorical")), self._insights(df, summary, columns, of("numerical")))

    def _charts(self, df: DataFrame, numeric: list[str], categorical: list[str]) -> list[dict]:
        plans = [("distribution", c, lambda c=c: G.DistributionPlotter().combined(df, c)) for c in numeric[: self.max_distribution]]
        plans += [("categorical", c, lambda c=c: G.category_chart(df, c)) for c in categorical[: self.max_categorical]]
        if len(numeric) >= 2:
            plans.append(("correlation", None, lambda: G.correlation_heatmap(df, numeric)))
        out = []
        for kind, column, draw in plans:
            try:
                chart = draw()
            except (KeyError, ValueError):  # nothing to draw
                continue
            out.append({"title": chart.title, "kind": kind, "column": column, "image_base64": chart.image_base64})
        return out

    def _insights(self, df: DataFrame, s: dict, columns: list[dict], numeric: list[str]) -> list[str]:
        out = [f"Dataset has {s['row_count']} rows and {s['column_count']} columns, with an overall quality score of {s['quality_score']}/100 (grade {s['quality_grade']})."]
        if n := s["duplicate_row_count"]:
            out.append(f"{n} duplicate row(s) found ({round(n / s['row_count'] * 100, 1)}% of the dataset).")
        for c in sorted(columns, key=lambda c: -c["missing_percentage"]):
            if c["missing_severity"] in ("high", "critical"):
                out.append(f"Column '{c['name']}' has {c['missing_percentage']}% missing values ({c['missing_severity']} severity) - consider imputing or dropping it.")
        if numeric:
            for r in sorted(outliers(df, numeric).collect(), key=lambda r: r.ordinal):
                if r.outlier_percentage >= NOTABLE_OUTLIERS:
                    out.append(f"Column '{r.name}' has {r.outlier_count} outlier value(s) ({r.outlier_percentage}%) per the IQR method.")
        try:
            pairs = CorrelationAnalyzer().analyze(df, columns=numeric).notable_pairs[:5] if len(numeric) >= 2 else []
        except ValueError:  # fewer than two that hold numbers
            pairs = []
        for x in pairs:
            way = "positively" if x["correlation"] > 0 else "negatively"
            out.append(f"'{x['column_a']}' and '{x['column_b']}' are {x['strength']}ly {way} correlated (r = {x['correlation']}).")
        out += [f"Column '{c['name']}' has all-unique values - likely an identifier column." for c in columns if c["unique_count"] == s["row_count"] > 1]
        if constant := [c["name"] for c in columns if (c["unique_count"] or 0) <= 1]:
            out.append(f"Column(s) {constant} have a single constant value and carry no information.")
        return out

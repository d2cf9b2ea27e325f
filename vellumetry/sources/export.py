"""Writing reports as JSON, CSV and HTML."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable
from html import escape
from pathlib import Path

from vellumetry.functions.jsonable import to_jsonable
from vellumetry.plans.report import SECTIONS, ProfileReport, StructuredReport

FORMATS = ("html", "json", "csv")


def _path(path: str | Path) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    return path


class ReportGenerator:
    """A profile as JSON or as a CSV of a summary block and a row a column."""

    def to_json(self, report: ProfileReport, path: str | Path) -> Path:
        path = _path(path)
        path.write_text(json.dumps(to_jsonable(report.to_dict()), indent=2), encoding="utf-8")
        return path

    def to_csv(self, report: ProfileReport, path: str | Path) -> Path:
        facts = [("Source File", report.source_file), ("Generated At", report.generated_at), ("Row Count", report.row_count), ("Column Count", report.column_count), ("Duplicate Row Count", report.duplicate_row_count)]
        path = _path(path)
        with path.open("w", encoding="utf-8", newline="") as f:
            out = csv.writer(f)
            out.writerows([["Dataset Summary"], *facts, [], ["Column Name", "Data Type", "Missing Count", "Missing Percentage"]])
            out.writerows([c.name, c.dtype, c.missing_count, c.missing_percentage] for c in report.columns)
        return path


def _yes(v: bool) -> str:
    return "yes" if v else "no"


#: Tables of a section: title, headers (fixed values), and how its data gives rows.
TABLES = {
    "profiling": [
        ("Profiling: Columns", ["Column Name", "Data Type", "Inferred Type", "Missing Count", "Missing Percentage"], lambda d: [[c[k] for k in ("name", "dtype", "inferred_type", "missing_count", "missing_percentage")] for c in d["columns"]]),
        ("Profiling: Duplicates", ["Duplicate Row Count", "Row Indices (first 100)"], lambda d: [[d["duplicate_row_count"], " ".join(map(str, d["duplicate_row_indices"]))]]),
    ],
    "quality": [
        ("Quality: Dimensions", ["Dimension", "Percentage"], lambda d: [[k.title(), v] for k, v in d["dimensions"].items()]),
        ("Quality: Issues", ["Severity", "Column", "Type", "Count", "Message"], lambda d: [[i["severity"], i["column"] or "(dataset)", i["type"], i["count"], i["message"]] for i in d["issues"]]),
    ],
    "eda": [
        ("EDA: Numeric Columns", ["Column", "Count", "Missing", "Mean", "Std", "Min", "Q1", "Median", "Q3", "Max", "Skew", "Outliers", "Outlier %"], lambda d: [[c[k] for k in ("name", "count", "missing", "mean", "std", "min", "q1", "median", "q3", "max", "skew", "outlier_count", "outlier_percentage")] for c in d["numeric_summary"]]),
        ("EDA: Categorical Columns", ["Column", "Kind", "Count", "Missing", "Unique", "Top Values (value: count)"], lambda d: [[*(c[k] for k in ("name", "kind", "count", "missing", "unique")), "; ".join(f"{t['value']}: {t['count']}" for t in c["top_values"])] for c in d["categorical_summary"]]),
        ("EDA: Datetime Columns", ["Column", "Count", "Missing", "Min", "Max", "Span (days)"], lambda d: [[c[k] for k in ("name", "count", "missing", "min", "max", "span_days")] for c in d["datetime_summary"]]),
        ("EDA: Strong Correlations", ["Feature A", "Feature B", "Pearson r"], lambda d: [[c[k] for k in ("feature_a", "feature_b", "correlation")] for c in d["correlations"]["strong_pairs"]]),
    ],
    "feature_insights": [
        ("Features: Recommendations", ["Feature", "Kind", "Role", "Missing %", "Unique", "Exclude", "Recommendations"], lambda d: [[*(f[k] for k in ("name", "kind", "role", "missing_percentage", "unique_count")), _yes(f["exclude_from_modeling"]), " | ".join(f["recommendations"])] for f in d["features"]]),
        ("Features: Redundant Pairs", ["Feature A", "Feature B", "Pearson r", "Suggestion"], lambda d: [[r[k] for k in ("feature_a", "feature_b", "correlation", "suggestion")] for r in d["redundant_pairs"]]),
    ],
}
TARGET_HEADERS = ["Feature", "Association", "Method", "Strength", "Possible Leakage"]


def section_tables(key: str, data: dict) -> list[tuple[str, list[str], list[list]]]:
    out = [(title, headers, rows(data)) for title, headers, rows in TABLES[key]]
    if key == "feature_insights" and (t := data.get("target_analysis")):
        rows = [[r["feature"], r["association"], r["method"], r["strength"], _yes(r["possible_leakage"])] for r in t["rankings"]]
        out.append((f"Features: Association with Target '{t['target']}'", TARGET_HEADERS, rows))
    return out


def _html_table(headers: list[str], rows: list[list]) -> str:
    if not rows:
        return "<p>Nothing to report.</p>"
    cell = lambda v: "<td>" + ("—" if v is None else escape(f"{v:.6g}" if isinstance(v, float) else str(v))) + "</td>"
    return "<table><tr>" + "".join(f"<th>{escape(h)}</th>" for h in headers) + "</tr>" + "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows) + "</table>"


def _sparkline(counts: list[int]) -> str:
    top = max(counts, default=0) or 1
    bars = "".join(f'<rect x="{6 * i}" y="{20 - 20 * n / top:.1f}" width="5" height="{20 * n / top:.1f}"/>' for i, n in enumerate(counts))
    return f'<svg width="{6 * len(counts)}" height="20" fill="#4878a8">{bars}</svg>'


def _matrix(m: dict | None) -> str:
    if not m:
        return ""
    shade = lambda r: "#eee" if r is None else f"rgba({'176,72,72' if r > 0 else '72,120,168'},{abs(r):.2f})"
    head = "".join(f"<th>{escape(c)}</th>" for c in ["", *m["columns"]])
    body = "".join(f"<tr><th>{escape(c)}</th>" + "".join(f'<td style="background:{shade(r)}">{"—" if r is None else f"{r:.2f}"}</td>' for r in row) + "</tr>" for c, row in zip(m["columns"], m["values"]))
    return f"<h3>Correlation Matrix</h3><table><tr>{head}</tr>{body}</table>"


STYLE = "body{font:15px sans-serif;max-width:70em;margin:2em auto;padding:0 1em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:left}.cards{display:flex;gap:1em;flex-wrap:wrap}.cards div{border:1px solid #ccc;border-radius:6px;padding:.6em 1em}.error{color:#a00}"


class ReportExporter:
    def to_json(self, report: StructuredReport, path: str | Path) -> Path:
        path = _path(path)
        path.write_text(json.dumps(report.to_dict(), indent=2, ensure_ascii=False, allow_nan=False), encoding="utf-8")
        return path

    def to_csv(self, report: StructuredReport, path: str | Path) -> Path:
        d, path = report.to_dict(), _path(path)
        m, s = d["metadata"], d["summary"]
        with path.open("w", encoding="utf-8-sig", newline="") as f:  # the mark makes spreadsheets read UTF-8
            out = csv.writer(f)
            out.writerow([m["report_title"]])
            out.writerows([("Source File", m["source_file"]), ("Generated At", m["generated_at"]), ("Row Count", m["row_count"]), ("Column Count", m["column_count"]), ("Target", m["target"]), ("Quality Score", s["quality_score"]), ("Quality Grade", s["quality_grade"])])
            tables = [("Key Findings", ["#", "Finding"], list(enumerate(s["key_findings"], 1))), ("Section Status", ["Section", "Status", "Error"], [(k, x["status"], x["error"]) for k, x in d["sections"].items()])]
            for k, x in d["sections"].items():
                tables += section_tables(k, x["data"]) if x["status"] == "ok" else []
            for title, headers, rows in tables:
                out.writerows([[], [title], headers, *rows])
        return path

    def to_html(self, report: StructuredReport, path: str | Path) -> Path:
        d, path = report.to_dict(), _path(path)
        m, s = d["metadata"], d["summary"]
        facts = [("Rows", s["rows"]), ("Columns", s["columns"]), ("Quality", f"{s['quality_score']} ({s['quality_grade']})"), ("Duplicate rows", s["duplicate_rows"]), ("Missing cells", f"{s['missing_cells_percentage']} %")]
        cards = "".join(f"<div><b>{escape(str(v))}</b><br>{escape(k)}</div>" for k, v in facts)
        parts = ["<h2>Key Findings</h2><ol>" + "".join(f"<li>{escape(x)}</li>" for x in s["key_findings"]) + "</ol>"]
        for k, x in d["sections"].items():
            parts.append(f"<h2>{escape(x['title'])}</h2>")
            if x["status"] != "ok":
                parts.append(f'<p class="error">{escape(str(x["error"]))}</p>')
                continue
            for title, headers, rows in section_tables(k, x["data"]):
                parts.append(f"<h3>{escape(title)}</h3>" + _html_table(headers, rows))
            if k == "eda":
                shapes = [(c["name"], _sparkline(c["histogram"]["counts"])) for c in x["data"]["numeric_summary"]]
                parts.append("<h3>Histograms</h3><table>" + "".join(f"<tr><th>{escape(n)}</th><td>{svg}</td></tr>" for n, svg in shapes) + "</table>" + _matrix(x["data"]["correlations"]["matrix"]))
        title = escape(m["report_title"])
        path.write_text(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>{STYLE}</style></head><body><h1>{title}</h1><p>{escape(m["source_file"])}, {escape(m["generated_at"])}</p><div class="cards">{cards}</div>{"".join(parts)}</body></html>', encoding="utf-8")
        return path

    def export_all(self, report: StructuredReport, folder: str | Path, formats: Iterable[str] = FORMATS, basename: str | None = None) -> dict[str, Path]:
        wanted = [f.lower() for f in formats]
        if unknown := [f for f in wanted if f not in FORMATS]:
            raise ValueError(f"Unsupported export format(s): {unknown}. Supported: {list(FORMATS)}")
        stem = basename or f"{Path(report.metadata['source_file']).stem}_report"
        return {f: getattr(self, f"to_{f}")(report, Path(folder) / f"{stem}.{f}") for f in wanted}


__all__ = ["FORMATS", "SECTIONS", "ReportExporter", "ReportGenerator", "section_tables"]

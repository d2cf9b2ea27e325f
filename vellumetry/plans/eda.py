"""Exploratory summaries of a table, by kind of column."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vellumetry.operators import columns as C
from vellumetry.operators import frequency
from vellumetry.operators.correlation import correlations
from vellumetry.operators.profile import TableProfile


def strong_pairs(df: DataFrame, names: list[str], least: float) -> tuple[list[dict], dict]:
    """Pairs of at least that absolute correlation, strongest first, and all correlations."""
    rows = sorted(correlations(df, names).collect(), key=lambda r: (r.i, r.j))
    every = {(r.column_a, r.column_b): r.r for r in rows}
    found = [{"feature_a": a, "feature_b": b, "correlation": round(r, 4)} for (a, b), r in every.items() if r is not None and abs(r) >= least]
    return sorted(found, key=lambda x: -abs(x["correlation"])), every


class EDAAnalyzer:
    def __init__(self, top_n: int = 10, histogram_bins: int = 10, min_correlation: float = 0.5, max_pairs: int = 20, max_matrix_columns: int = 15):
        self.top_n, self.bins, self.least = top_n, histogram_bins, min_correlation
        self.max_pairs, self.max_matrix = max_pairs, max_matrix_columns

    def analyze(self, df: DataFrame, kinds: dict[str, str] | None = None, profile: TableProfile | None = None) -> dict:
        p = profile or TableProfile(df)
        kinds = kinds or p.kinds
        of = lambda *wanted: [c for c in df.columns if kinds[c] in wanted]
        pairs, matrix = self._correlations(df, p, of("numeric"))
        return {
            "kind_counts": {k: len(of(k)) for k in ("numeric", "categorical", "boolean", "datetime", "text")},
            "numeric_summary": [self._numeric(df, p, c) for c in of("numeric") if p.numeric[c]["count"]],
            "categorical_summary": self._categorical(df, p, kinds, of("categorical", "boolean", "text")),
            "datetime_summary": self._datetime(df, of("datetime")),
            "correlations": {"min_abs_correlation": self.least, "strong_pairs": pairs, "matrix": matrix},
        }

    def _numeric(self, df: DataFrame, p: TableProfile, c: str) -> dict:
        s = p.numeric[c]
        bins = max(1, min(self.bins, s["distinct"]))
        rows = sorted(frequency.histogram(df, c, bins=bins).collect(), key=lambda r: r.bin)
        out = {"name": c} | {k: s[k] for k in ("count", "missing", "mean", "std", "min", "q1", "median", "q3", "max", "skew", "zeros")}
        out |= {"outlier_count": s["outliers"], "outlier_percentage": round(s["outliers"] / s["count"] * 100, 2)}
        return out | {"histogram": {"counts": [r["count"] for r in rows], "bin_edges": [r.lower for r in rows] + [rows[-1].upper]}}

    def _categorical(self, df: DataFrame, p: TableProfile, kinds: dict, names: list[str]) -> list[dict]:
        if not names:
            return []
        top: dict[str, list] = {}
        for r in frequency.top_values(df, names, self.top_n).collect():
            top.setdefault(r.name, []).append(r)
        texts = [c for c in names if kinds[c] == "text"]
        lengths = {r.name: r.avg_length for r in C.text_lengths(df, texts).collect()} if texts else {}
        out = []
        for c in names:
            rows = sorted(top.get(c, []), key=lambda r: r.rank)
            if not rows:
                continue
            present = p.n_rows - p.columns[c].missing_count
            entry = {"name": c, "kind": kinds[c], "count": present, "missing": p.columns[c].missing_count, "unique": p.columns[c].unique_count, "mode": rows[0].value}
            entry["top_values"] = [{"value": r.value, "count": r["count"], "percentage": r.percentage} for r in rows]
            out.append(entry | ({"avg_length": lengths[c]} if c in lengths else {}))
        return out

    def _datetime(self, df: DataFrame, names: list[str]) -> list[dict]:
        rows = sorted(C.datetime_summary(df, names).collect(), key=lambda r: r.ordinal) if names else []
        return [{k: r[k] for k in ("name", "count", "missing", "min", "max", "span_days")} for r in rows if r["count"]]

    def _correlations(self, df: DataFrame, p: TableProfile, names: list[str]) -> tuple[list, dict | None]:
        names = [c for c in names if p.numeric[c]["distinct"] > 1]
        names = C.numeric_columns(df, names, of_all_rows=False) if names else []
        if len(names) < 2:
            return [], None
        pairs, every = strong_pairs(df, names, self.least)
        r = lambda a, b: 1.0 if a == b else every.get((a, b), every.get((b, a)))
        matrix = None
        if len(names) <= self.max_matrix:
            matrix = {"columns": names, "values": [[None if r(a, b) is None else round(r(a, b), 4) for b in names] for a in names]}
        return pairs[: self.max_pairs], matrix

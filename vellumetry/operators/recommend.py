"""What to drop, encode and scale, and which features matter."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from vellumetry.operators import association as A
from vellumetry.operators import columns as C
from vellumetry.operators import outliers
from vellumetry.operators.duplicates import duplicate_columns
from vellumetry.operators.profile import TableProfile

#: Names of identifiers, of the recommender and of the insights.
ID_NAME = re.compile(r"(^|_)(id|uuid|guid|key)$", re.IGNORECASE)
ID_LIKE_NAME = re.compile(r"(^|[_\s-])id$|^id($|[_\s-])|uuid|guid", re.IGNORECASE)
EXCLUDED_ROLES = ("empty", "constant", "identifier")


@dataclass
class Recommendations:
    source_file: str
    drop_columns: list[dict] = field(default_factory=list)
    encode_columns: list[dict] = field(default_factory=list)
    scale_columns: list[dict] = field(default_factory=list)
    important_features: list[dict] = field(default_factory=list)
    importance_is_heuristic: bool = False


@dataclass(frozen=True)
class Case:
    """A rule on a column's facts: the first that holds names the action and the text."""

    holds: Callable[[dict], bool]
    action: str
    text: str


def first_case(cases: tuple[Case, ...], facts: dict) -> tuple[str, str] | None:
    for case in cases:
        if case.holds(facts):
            return case.action, case.text.format_map(facts)
    return None


#: Texts of the recommendations, in the order of precedence.
DROP = (
    Case(lambda f: f["missing"] / 100 > f["high_missing"], "drop", "{missing}% missing values."),
    Case(lambda f: f["distinct"] <= 1, "drop", "Constant column (no variance)."),
    Case(lambda f: 1 < f["rows"] == f["distinct"] and (f["category"] != "numerical" or f["named_id"]), "drop", "All values unique - looks like an identifier column."),
    Case(lambda f: f["category"] == "text" and f["distinct"] > f["text_ratio"] * f["rows"], "drop", "High-cardinality free text - not directly usable as a feature."),
)
ENCODE = (
    Case(lambda f: f["distinct"] <= 2, "binary", "Only 2 distinct values - map to 0/1."),
    Case(lambda f: f["distinct"] <= f["one_hot_max"], "one_hot", "{distinct} distinct values - low cardinality, safe for one-hot encoding."),
    Case(lambda f: f["target"], "target_encode", "{distinct} distinct values - one-hot would add too many columns; target/mean encoding recommended."),
    Case(lambda f: True, "ordinal", "{distinct} distinct values - one-hot would add too many columns; ordinal encoding recommended (no target available for target encoding)."),
)
SCALE = (
    Case(lambda f: f["outliers"] >= f["notable_outliers"], "robust", "{outliers}% outlier values (IQR method) - robust scaling (median/IQR) is less sensitive to them than standardization."),
    Case(lambda f: abs(f["skew"]) >= f["notable_skew"], "min_max", "Skewed distribution (skew = {round_skew}) - min-max scaling preserves shape."),
    Case(lambda f: True, "standard", "Roughly symmetric, low-outlier distribution - standard (z-score) scaling."),
)
PARTS = ("drop", "encode", "scale", "importance")


class FeatureRecommender:
    def __init__(self, high_missing: float = 0.5, text_ratio: float = 0.9, one_hot_max: int = 10, notable_outliers: float = 5.0, notable_skew: float = 1.0):
        self.limits = {"high_missing": high_missing, "text_ratio": text_ratio, "one_hot_max": one_hot_max, "notable_outliers": notable_outliers, "notable_skew": notable_skew}

    def recommend(self, df: DataFrame, target_column: str | None = None, source_file: str = "unknown", profile: TableProfile | None = None, parts: tuple[str, ...] = PARTS) -> Recommendations:
        """``parts``: which of the four lists to compute; what is dropped is always known."""
        p = profile or TableProfile(df)
        if not p.n_rows or not p.n_columns:
            raise ValueError("Cannot generate recommendations for an empty DataFrame.")
        if target_column is not None and target_column not in df.columns:
            raise KeyError(f"target_column '{target_column}' not found in DataFrame.")
        facts = {c: self._facts(p, c, target_column) for c in df.columns}
        out = Recommendations(source_file, self._drops(p, facts, target_column))
        for d in out.drop_columns:
            facts.pop(d["column"], None)
        of = lambda category: [c for c, f in facts.items() if f["category"] == category]
        if "encode" in parts:
            cases = [(c, first_case(ENCODE, facts[c])) for c in of("categorical") if c != target_column]
            out.encode_columns = [{"column": c, "strategy": strategy, "unique_count": facts[c]["distinct"], "reason": reason} for c, (strategy, reason) in cases]
        if "scale" in parts:
            out.scale_columns = self._scaling(df, of("numerical"))
        if "importance" in parts:
            out.important_features, out.importance_is_heuristic = self._importance(df, p, [c for c in of("numerical") if c != target_column], target_column)
        return out

    def _facts(self, p: TableProfile, c: str, target: str | None) -> dict:
        row = p.columns[c]
        return self.limits | {"rows": p.n_rows, "missing": row.missing_percentage, "distinct": row.unique_count or 0, "category": p.categories[c].category, "named_id": bool(ID_NAME.search(c)), "target": target}

    def _drops(self, p: TableProfile, facts: dict[str, dict], target: str | None) -> list[dict]:
        named = [(c, first_case(DROP, f)) for c, f in facts.items() if c != target]
        out = [{"column": c, "reason": case[1]} for c, case in named if case]
        pairs = p.duplicate_columns
        if any(target in pair for pair in pairs):  # the target's copies are copies of each other
            pairs = duplicate_columns(p.df, [c for c in p.columns if c != target])
        return out + [{"column": b, "reason": f"Duplicate of column '{a}'."} for a, b in pairs]

    def _scaling(self, df: DataFrame, numeric: list[str]) -> list[dict]:
        if not numeric:
            return []
        share = {r.name: r.outlier_percentage for r in outliers.outliers(df, numeric).collect()}
        out = []
        for r in C.numeric_summary(df, numeric).collect():
            if r["count"]:
                skew = r.skew or 0.0
                strategy, reason = first_case(SCALE, self.limits | {"outliers": share.get(r.name, 0.0), "skew": skew, "round_skew": round(skew, 2)})
                out.append({"column": r.name, "strategy": strategy, "reason": reason})
        return sorted(out, key=lambda x: numeric.index(x["column"]))

    def _importance(self, df: DataFrame, p: TableProfile, numeric: list[str], target: str | None) -> tuple[list[dict], bool]:
        if not numeric:
            return [], True
        if target is None:
            rows = A.coefficients_of_variation(df, numeric).collect()
            reason = "No target column provided - ranked by relative variance as a rough proxy for information content, not true feature importance."
            found = [(r, "coefficient_of_variation", reason) for r in rows]
        elif p.categories[target].category == "numerical":
            found = [(r, "abs_pearson_correlation_with_target", f"Correlation with '{target}': {r.r}.") for r in A.abs_correlation_with(df, target, numeric).collect()]
        else:
            found = [(r, "between_group_variance_ratio", f"Group means across '{target}' vary {round(r.score, 2)}x relative to overall variance.") for r in A.between_group_variance(df, target, numeric).collect()]
        found.sort(key=lambda x: (-x[0].score, x[0].ordinal))
        return [{"column": r.name, "score": r.score, "method": method, "reason": reason} for r, method, reason in found], target is None


#: Advice by role; of a column of several pieces of advice all that hold, else the last.
ADVICE = {
    "empty": (Case(lambda f: True, "", "Drop: the column is entirely missing."),),
    "constant": (Case(lambda f: True, "", "Drop: a constant carries no information."),),
    "identifier": (Case(lambda f: True, "", "Exclude from model inputs; keep only as a key / row label."),),
    "boolean": (Case(lambda f: True, "", "Encode as 0/1."),),
    "datetime": (Case(lambda f: True, "", "Derive year, month, day-of-week and elapsed-time features."),),
    "text": (Case(lambda f: True, "", "Free text: use TF-IDF or embeddings, or drop."),),
    "categorical": (
        Case(lambda f: f["distinct"] <= 10, "", "Low cardinality: one-hot encode."),
        Case(lambda f: f["distinct"] > 10, "", "{distinct} levels: group rare levels, then target/frequency encode."),
    ),
    "numeric": (
        Case(lambda f: abs(f["skew"]) >= 1 and f["min"] >= 0, "", "Skewed (skew={skew:.2f}): consider a log1p transform."),
        Case(lambda f: abs(f["skew"]) >= 1 and f["min"] < 0, "", "Skewed (skew={skew:.2f}): consider a Yeo-Johnson transform."),
        Case(lambda f: f["outlier_share"] > 0.05, "", "Many outliers: prefer robust scaling or winsorizing."),
        Case(lambda f: f["whole"] and f["distinct"] <= 10, "", "Only {distinct} distinct integers: may work better as categorical."),
    ),
}
PLAIN_NUMBERS = "Standardize for linear / distance-based models."
MISSING_ADVICE = (
    Case(lambda f: f["role"] == "empty" or f["missing"] <= 0, "", ""),
    Case(lambda f: f["missing"] >= 50, "", "{missing:.0f}% missing: consider dropping or adding a missing-indicator."),
    Case(lambda f: f["role"] not in EXCLUDED_ROLES, "", "{missing:.1f}% missing: impute (median for numeric, mode for categorical)."),
)
#: Roles that a column has whatever its kind; the first that holds.
ROLES = (
    Case(lambda f: f["values"] == 0, "empty", ""),
    Case(lambda f: f["distinct"] <= 1, "constant", ""),
    Case(lambda f: f["countable"] and f["named_id"] and f["distinct"] >= 0.9 * f["values"], "identifier", ""),
    Case(lambda f: f["countable"] and f["values"] >= f["min_rows"] and f["distinct"] >= 0.95 * f["values"], "identifier", ""),
)


class FeatureInsightAnalyzer:
    def __init__(self, redundancy_threshold: float = 0.9, min_rows_for_id: int = 20, max_levels: int = 50, top_n: int = 15):
        self.redundancy, self.min_rows, self.max_levels, self.top_n = redundancy_threshold, min_rows_for_id, max_levels, top_n

    def analyze(self, df: DataFrame, kinds: dict[str, str] | None = None, target: str | None = None, profile: TableProfile | None = None) -> dict:
        p = profile or TableProfile(df)
        kinds = kinds or p.kinds
        features = [self._feature(self._facts(p, c, kinds[c])) for c in df.columns if c != target]
        excluded = sorted(f["name"] for f in features if f["exclude_from_modeling"])
        return {
            "features": features,
            "role_counts": dict(Counter(f["role"] for f in features)),
            "exclude_candidates": excluded,
            "redundant_pairs": self._redundant(df, p, kinds, {*excluded, target}),
            "target_analysis": A.target_association(df, target, kinds, excluded, max_levels=self.max_levels, top_n=self.top_n) if target else None,
        }

    def _facts(self, p: TableProfile, c: str, kind: str) -> dict:
        """``values``: cells that can be used as the kind they are; an infinite number is a value."""
        row, lex, num = p.columns[c], p.lexical[c], p.numeric.get(c) if kind == "numeric" else None
        if num:
            values, distinct = num["count"] + lex.infinite, num["distinct"] + min(lex.infinite, 1)
        else:
            values, distinct = p.n_rows - row.missing_count, row.unique_count or 0
            if kind == "datetime" and row.dtype == "string":
                values -= lex.unparseable_dates
        s = num or {}
        return {
            "name": c, "kind": kind, "values": values, "distinct": distinct, "missing": round(100 * (1 - values / p.n_rows), 2),
            "min_rows": self.min_rows, "named_id": bool(ID_LIKE_NAME.search(c)), "countable": kind in ("text", "categorical") or bool(s.get("whole")),
            "skew": s.get("skew") or 0.0, "min": s.get("min") or 0.0, "whole": s.get("whole"), "outlier_share": s["outliers"] / s["count"] if s.get("count") else 0.0,
        }

    @staticmethod
    def _feature(f: dict) -> dict:
        found = first_case(ROLES, f)
        f = f | {"role": found[0] if found else f["kind"]}
        advice = [case.text.format_map(f) for case in ADVICE[f["role"]] if case.holds(f)] or [PLAIN_NUMBERS]
        gaps = first_case(MISSING_ADVICE, f)
        if gaps and gaps[1]:
            advice.append(gaps[1])
        return {"name": f["name"], "kind": f["kind"], "role": f["role"], "missing_percentage": f["missing"], "unique_count": f["distinct"], "exclude_from_modeling": f["role"] in EXCLUDED_ROLES, "recommendations": advice}

    def _redundant(self, df: DataFrame, p: TableProfile, kinds: dict, skip: set) -> list[dict]:
        names = [c for c in df.columns if kinds[c] == "numeric" and c not in skip and p.numeric[c]["distinct"] > 1]
        if len(names) < 2:
            return []
        from vellumetry.plans.eda import strong_pairs

        say = "Nearly redundant: consider dropping one of '{feature_a}' / '{feature_b}'."
        return [r | {"suggestion": say.format(**r)} for r in strong_pairs(df, names, self.redundancy)[0]]

"""TableProfile: what the composite reports share, computed once in a few passes."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumetry.functions import expressions as X
from vellumetry.operators import columns as C
from vellumetry.operators import duplicates, outliers


@dataclass
class TableProfile:
    """Lazily computed facts of a table; each is one Spark job, kept afterwards.

    Pass a cached or file-backed DataFrame: the passes read it again.
    """

    df: DataFrame
    inferred: dict[str, str] = field(default_factory=dict)

    @cached_property
    def columns(self) -> dict:
        """Row of column_profile() by name."""
        return {r.name: r for r in C.column_profile(self.df).collect()}

    @cached_property
    def n_rows(self) -> int:
        return self.df.count()

    @property
    def n_columns(self) -> int:
        return len(self.df.columns)

    @cached_property
    def kinds(self) -> dict[str, str]:
        return C.resolve_kinds(self.df, self.inferred)

    @cached_property
    def categories(self) -> dict:
        return {r.name: r for r in C.classify_columns(self.df).collect()}

    @cached_property
    def severities(self) -> dict:
        return {r.name: r for r in C.missing_values(self.df).collect()}

    @cached_property
    def duplicate_rows(self) -> int:
        return duplicates.duplicate_count(self.df).first()[0]

    @cached_property
    def duplicate_columns(self) -> list[tuple[str, str]]:
        return duplicates.duplicate_columns(self.df)

    @cached_property
    def missing_cells(self) -> int:
        return sum(r.missing_count for r in self.columns.values())

    @cached_property
    def numeric(self) -> dict:
        """numeric_summary() with the guarded fences' outlier counts, for columns of numeric kind."""
        names = [c for c, k in self.kinds.items() if k == "numeric"]
        if not names:
            return {}
        rows = {r.name: r.asDict() for r in C.numeric_summary(self.df, names).collect()}
        for r in rows.values():
            spread = (r["q3"] or 0) - (r["q1"] or 0)
            r["bounds"] = (r["q1"] - 1.5 * spread, r["q3"] + 1.5 * spread) if r["count"] >= 4 and spread else (None, None)

        def counts(c):
            v, raw = X.finite(X.number(self.df, c)), X.number(self.df, c)
            whole = F.bool_and(F.when(raw.isNotNull(), F.coalesce(v % 1 == 0, F.lit(False))))
            return {"n": F.count_if(outliers.outside(self.df, c, rows[c]["bounds"]) & v.isNotNull()), "u": F.count_distinct(v), "whole": F.coalesce(whole, F.lit(False))}

        for r in C.per_column(self.df, names, counts).collect():
            rows[r.name] |= {"outliers": r.n, "distinct": r.u, "whole": r.whole}
        return rows

    @cached_property
    def lexical(self) -> dict:
        return {r.name: r for r in C.lexical_issues(self.df, self.df.columns).collect()}

    @cached_property
    def consistency(self) -> dict[str, float]:
        return {r.name: r.consistency for r in C.consistency(self.df).collect()}

    @cached_property
    def outlier_rows(self) -> int:
        return outliers.outlier_rows(self.df).first()[0]

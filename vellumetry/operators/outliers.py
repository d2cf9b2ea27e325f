"""Outliers by the interquartile range and by z-scores."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumetry.functions import expressions as X
from vellumetry.operators import columns as C
from vellumetry.operators.duplicates import ROW_ID, with_row_id
from vellumetry.operators.ranks import quantile_values

METHODS = ("iqr", "zscore")


def fences(df: DataFrame, columns: Iterable[str], method: str = "iqr", *, k: float = 1.5, threshold: float = 3.0, guarded: bool = False) -> DataFrame:
    """name, count, lower and upper of each column; a value is an outlier strictly outside.

    ``guarded`` is the variant that finds no outliers among fewer than 4 values
    or where the quartiles are equal. A constant has none by z-score.
    """
    if method not in METHODS:
        raise ValueError(f"Unknown outlier method '{method}'.")
    wide = lambda: F.lit(None).cast("double")
    names = list(columns)
    number = lambda c: X.finite(X.number(df, c)) if guarded else X.number(df, c)
    quartiles = quantile_values(df.select(*(number(c).alias(c) for c in dict.fromkeys(names))), (0.25, 0.75)) if method == "iqr" else {}

    def stats(c: str) -> dict[str, Column]:
        v = number(c)
        n = F.count(v)
        if method == "iqr":
            q1, q3 = (F.lit(quartiles.get((c, at))).cast("double") for at in (0.25, 0.75))
            reach = k * (q3 - q1)
            lower, upper = q1 - reach, q3 + reach
            ok = (n >= 4) & (q3 != q1) if guarded else F.lit(True)
        else:
            reach = threshold * F.stddev_samp(v)
            lower, upper = F.avg(v) - reach, F.avg(v) + reach
            ok = F.coalesce(F.stddev_samp(v) > 0, F.lit(False))
        return {"count": n, "lower": F.when(ok, lower).otherwise(wide()), "upper": F.when(ok, upper).otherwise(wide())}

    return C.per_column(df, names, stats)


def _bounds(table: DataFrame) -> dict[str, tuple]:
    """Of fences(): a row a column reaches the driver and returns as literals."""
    return {r.name: (r["lower"], r["upper"]) for r in table.collect()}


def outside(df: DataFrame, name: str, bounds: tuple) -> Column:
    lo, hi = bounds
    if lo is None:
        return F.lit(False)
    v = X.number(df, name)
    return F.coalesce((v < F.lit(lo)) | (v > F.lit(hi)), F.lit(False))


def outliers(df: DataFrame, columns: Iterable[str] | None = None, method: str = "iqr", **options) -> DataFrame:
    """name, outlier_count, outlier_percentage (of non-null values), lower_bound and upper_bound, in one pass after the fences'."""
    names = C.numeric_columns(df) if columns is None else C.existing(df, columns)
    if method not in METHODS:
        raise ValueError(f"Unknown outlier method '{method}'.")
    schema = "name string, ordinal int, outlier_count long, outlier_percentage double, lower_bound double, upper_bound double"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    table = fences(df, names, method, **options)
    bounds = _bounds(table)

    def stats(c: str) -> dict[str, Column]:
        n, lo_hi = F.count_if(outside(df, c, bounds[c])), bounds[c]
        return {"present": F.count(X.number(df, c)), "outlier_count": n, "outlier_percentage": X.percent(n, F.count(X.number(df, c))), "lower_bound": F.round(F.lit(lo_hi[0]).cast("double"), 4), "upper_bound": F.round(F.lit(lo_hi[1]).cast("double"), 4)}

    return C.per_column(df, names, stats).where("present > 0").drop("present")


def outlier_rows(df: DataFrame, columns: Iterable[str] | None = None, method: str = "iqr", **options) -> DataFrame:
    """outlier_rows: rows with an outlier in any column; row_count."""
    names = C.numeric_columns(df) if columns is None else C.existing(df, columns)
    bounds = _bounds(fences(df, names, method, **options)) if names else {}
    hit = F.lit(False)
    for c in names:
        hit = hit | outside(df, c, bounds[c])
    return df.agg(F.count_if(hit).alias("outlier_rows"), F.count(F.lit(1)).alias("row_count"))


@dataclass
class ColumnOutliers:
    name: str
    method: str
    outlier_count: int
    outlier_percentage: float
    lower_bound: float | None
    upper_bound: float | None
    threshold: float
    outlier_indices: list[int] = field(default_factory=list)


@dataclass
class OutlierReport:
    source_file: str
    method: str
    row_count: int
    total_outlier_rows: int
    columns: list[ColumnOutliers] = field(default_factory=list)


class OutlierDetector:
    def __init__(self, iqr_multiplier: float = 1.5, zscore_threshold: float = 3.0):
        self.iqr_multiplier, self.zscore_threshold = iqr_multiplier, zscore_threshold

    def detect(self, df: DataFrame, method: str = "iqr", columns: Iterable[str] | None = None, source_file: str = "unknown", indices: bool = False) -> OutlierReport:
        options = {"k": self.iqr_multiplier, "threshold": self.zscore_threshold}
        names = C.numeric_columns(df) if columns is None else C.existing(df, columns)
        rows = sorted(outliers(df, names, method, **options).collect(), key=lambda r: r.ordinal)
        total = outlier_rows(df, names, method, **options).first()
        limit = self.iqr_multiplier if method == "iqr" else self.zscore_threshold
        out = OutlierReport(source_file, method, total.row_count, total.outlier_rows)
        placed = with_row_id(df) if indices else None
        bounds = _bounds(fences(df, names, method, **options)) if indices and names else {}
        for r in rows:
            at = sorted(x[0] for x in placed.where(outside(placed, r.name, bounds[r.name])).select(ROW_ID).collect()) if indices else []
            out.columns.append(ColumnOutliers(r.name, method, r.outlier_count, r.outlier_percentage, r.lower_bound, r.upper_bound, limit, at))
        return out

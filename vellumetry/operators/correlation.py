"""Correlations of numeric columns, notable pairs and redundant features."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumetry.functions import expressions as X
from vellumetry.operators import columns as C
from vellumetry.operators.duplicates import duplicate_columns
from vellumetry.operators.ranks import STEP, average_ranks, range_of

METHODS = ("pearson", "spearman", "kendall")
#: Pairs of an aggregation; more columns take more passes, not a wider plan.
PAIRS_A_PASS = 400
#: Kendall: distinct pairs of a block, and blocks of a column (a power of two; their cells are counted in one task).
BLOCK_PAIRS, MOST_BLOCKS = 100_000, 512


def _pair_table(df: DataFrame, names: list[str]) -> DataFrame:
    """Pearson of every pair, in passes of bounded width; each pass is one aggregation."""
    pairs = list(combinations(range(len(names)), 2))
    out = None
    for lo in range(0, len(pairs), PAIRS_A_PASS):
        rows = [F.struct(F.lit(names[i]).alias("column_a"), F.lit(names[j]).alias("column_b"), F.lit(i).alias("i"), F.lit(j).alias("j"), X.pearson(F.col(f"x{i}"), F.col(f"x{j}")).alias("r")) for i, j in pairs[lo : lo + PAIRS_A_PASS]]
        part = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
        out = part if out is None else out.unionAll(part)
    return out


def _average_ranks(df: DataFrame, i: int, j: int) -> DataFrame:
    """Distinct complete pairs of two columns with counts and average ranks."""
    both = df.select(F.col(f"x{i}").alias("x"), F.col(f"x{j}").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return average_ranks(both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))


def _weighted_pearson(df: DataFrame, x: str, y: str):
    """Of rows with weight n, centred first."""
    m = df.agg(F.sum("n").alias("w"), (F.sum(F.col("n") * F.col(x)) / F.sum("n")).alias("mx"), (F.sum(F.col("n") * F.col(y)) / F.sum("n")).alias("my"))
    d = df.join(F.broadcast(m))
    a, b = F.col(x) - F.col("mx"), F.col(y) - F.col("my")
    return d.agg(F.try_divide(F.sum(F.col("n") * a * b), F.sqrt(F.sum(F.col("n") * a * a) * F.sum(F.col("n") * b * b))).alias("r"))


def _score(t: pd.DataFrame) -> float:
    """Sum of sign(dx) * sign(dy) * n * n' over the pairs of a group's rows, by a merge count.

    Two ranks of x differ first at one bit. A level takes a bit: rows that
    share the higher bits meet, those with the bit unset against those with it
    set, and prefix sums in the order of y count who is below and above.
    """
    x, y = (np.unique(t[c].to_numpy(), return_inverse=True)[1].astype("i8") for c in ("x", "y"))
    n = t["n"].to_numpy("f8")
    total = 0.0
    for bit in range(int(x.max()).bit_length()):
        key = (x >> (bit + 1)) * (int(y.max()) + 1) + y
        order = np.argsort(key, kind="stable")
        key, high = key[order], ((x[order] >> bit) & 1).astype(bool)
        low = np.concatenate(([0.0], np.cumsum(np.where(high, 0.0, n[order]))))
        group = key // (int(y.max()) + 1)
        first, last = np.searchsorted(group, group[high], "left"), np.searchsorted(group, group[high], "right")
        tie, past = np.searchsorted(key, key[high], "left"), np.searchsorted(key, key[high], "right")
        below, above = low[tie] - low[first], low[last] - low[past]
        total += float(((below - above) * n[order][high]).sum())
    return total


def _block(bounds: list[float], v) -> Column:
    """Number of the value's block, ascending with it.

    Where a value is a bound more than once, it is too common for a block and
    has an even one of its own; odd blocks hold few rows.
    """
    if not bounds:
        return F.lit(1)
    heavy = sorted({b for b, c in zip(bounds, bounds[1:]) if b == c})
    own = v.isin(heavy) if heavy else F.lit(False)
    number = lambda xs: F.array(*map(F.lit, xs)).cast("array<double>")
    return 2 * range_of(number(bounds), number(bounds[STEP - 1 :: STEP]), v) + F.when(own, 0).otherwise(1)


def _kendall(df: DataFrame, i: int, j: int) -> DataFrame:
    """tau-b from the table of distinct pairs, in n log(n) steps and without a join.

    x and y are cut into blocks of at most some BLOCK_PAIRS pairs. Rows of the
    same block of x are counted against each other, then those of the same
    block of y in different blocks of x, and what is left is decided by the
    numbers of the blocks, of which there are MOST_BLOCKS a side at most. One
    pair of columns with 10^9 distinct pairs has blocks of 2 million.
    """
    both = df.select(F.col(f"x{i}").alias("x"), F.col(f"x{j}").alias("y")).where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    at = [k / MOST_BLOCKS for k in range(1, MOST_BLOCKS)]
    size = both.agg(F.count(F.lit(1)).alias("pairs"), F.percentile_approx("x", at, 10_000).alias("x"), F.percentile_approx("y", at, 10_000).alias("y")).first()
    step = MOST_BLOCKS // min(MOST_BLOCKS, 1 << (size.pairs // BLOCK_PAIRS).bit_length())
    blocks = {c: _block((size[c] or [])[step - 1 :: step], F.col(c)) for c in ("x", "y")}
    placed = both.select("x", "y", "n", blocks["x"].alias("bx"), blocks["y"].alias("by"))
    within_x = placed.where("bx % 2 = 1").select(F.lit(0).alias("side"), F.col("bx").alias("block"), "x", "y", "n")
    within_y = placed.where("by % 2 = 1").groupBy("by", "bx", "y").agg(F.sum("n").alias("n")).select(F.lit(1), "by", F.col("bx").cast("double"), "y", "n")
    between = placed.groupBy("bx", "by").agg(F.sum("n").alias("n")).select(F.lit(2), F.lit(0), F.col("bx").cast("double"), F.col("by").cast("double"), "n")
    # the second part takes pairs of one block of y and the first those of one block of x: equal numbers score nothing
    groups = within_x.unionAll(within_y).unionAll(between).groupBy("side", "block")
    score = groups.applyInPandas(lambda t: pd.DataFrame({"s": [_score(t)]}), "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
    cells = F.array(*(F.struct(F.lit(k).alias("k"), v.cast("double").alias("v")) for k, v in (("x", F.col("x")), ("y", F.col("y")), ("t", F.lit(0)))))
    sums = both.select("n", F.inline(cells)).groupBy("k", "v").agg(F.sum("n").alias("m"))
    tied = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("m") * (F.col("m") - 1) / 2)), F.lit(0.0)).alias(f"t{k}")
    one = score.join(F.broadcast(sums.agg(tied("x"), tied("y"), tied("t"))))  # one row
    return one.select(F.try_divide(F.col("s"), F.sqrt((F.col("tt") - F.col("tx")) * (F.col("tt") - F.col("ty")))).alias("r"))


def correlations(df: DataFrame, columns: Iterable[str] | None = None, method: str = "pearson") -> DataFrame:
    """column_a, column_b, i, j, r of every pair of numeric columns (null for constants), pairwise complete."""
    if method not in METHODS:
        raise ValueError(f"Unknown correlation method '{method}'.")
    names = C.numeric_columns(df, columns)
    if len(names) < 2:
        raise ValueError("Need at least 2 numeric columns to compute correlations.")
    table = df.select(*(X.finite(X.number(df, c)).alias(f"x{i}") for i, c in enumerate(names)))
    if method == "pearson":
        return _pair_table(table, names)
    out = None
    for i, j in combinations(range(len(names)), 2):
        one = _weighted_pearson(_average_ranks(table, i, j), "rank_x", "rank_y") if method == "spearman" else _kendall(table, i, j)
        part = one.select(F.lit(names[i]).alias("column_a"), F.lit(names[j]).alias("column_b"), F.lit(i).alias("i"), F.lit(j).alias("j"), "r")
        out = part if out is None else out.unionAll(part)
    return out


def notable_pairs(pairs: DataFrame, moderate: float = 0.4, strong: float = 0.7) -> DataFrame:
    """Rounded r of pairs from ``moderate`` on, with their strength; strongest first."""
    r = F.round("r", 4)
    found = pairs.where(F.col("r").isNotNull()).withColumn("correlation", r).where(F.abs("correlation") >= moderate)
    out = found.select("column_a", "column_b", "correlation", F.when(F.abs("correlation") >= strong, "strong").otherwise("moderate").alias("strength"), "i", "j")
    return out.orderBy(F.desc(F.abs("correlation")), "i", "j")


@dataclass
class CorrelationReport:
    source_file: str
    method: str
    columns: list[str]
    matrix: dict[str, dict[str, float | None]]
    notable_pairs: list[dict] = field(default_factory=list)


class CorrelationAnalyzer:
    def __init__(self, moderate: float = 0.4, strong: float = 0.7):
        self.moderate, self.strong = moderate, strong

    def analyze(self, df: DataFrame, method: str = "pearson", columns: Iterable[str] | None = None, source_file: str = "unknown") -> CorrelationReport:
        rows = sorted(correlations(df, columns, method).collect(), key=lambda r: (r.i, r.j))
        names = list(dict.fromkeys(x for r in rows for x in (r.column_a, r.column_b)))
        own = {x: any(r.r is not None for r in rows if x in (r.column_a, r.column_b)) for x in names}
        matrix: dict = {a: {b: (1.0 if own[a] else None) if a == b else None for b in names} for a in names}
        found = []
        for r in rows:
            v = None if r.r is None else round(r.r, 4)
            matrix[r.column_a][r.column_b] = matrix[r.column_b][r.column_a] = v
            if v is not None and abs(v) >= self.moderate:
                found.append({"column_a": r.column_a, "column_b": r.column_b, "correlation": v, "strength": "strong" if abs(v) >= self.strong else "moderate"})
        found.sort(key=lambda p: -abs(p["correlation"]))
        return CorrelationReport(source_file, method, names, matrix, found)


@dataclass
class RedundancyReport:
    source_file: str
    method: str
    high_correlation_threshold: float
    redundant_correlation_threshold: float
    highly_correlated_pairs: list[dict] = field(default_factory=list)
    redundant_columns: list[dict] = field(default_factory=list)

    @property
    def recommended_drops(self) -> list[str]:
        return sorted({r["dropped_column"] for r in self.redundant_columns})


class FeatureCorrelationAnalyzer:
    """Exact copies of columns first; then the later of each pair that correlates nearly perfectly."""

    def __init__(self, high: float = 0.8, redundant: float = 0.95):
        if not 0 < high <= 1 or not 0 < redundant <= 1 or redundant < high:
            raise ValueError("Thresholds must satisfy 0 < high <= redundant <= 1.")
        self.high, self.redundant = high, redundant

    def analyze(self, df: DataFrame, method: str = "pearson", columns: Iterable[str] | None = None, source_file: str = "unknown") -> RedundancyReport:
        report = CorrelationAnalyzer(self.high, self.redundant).analyze(df, method, columns)
        out = RedundancyReport(source_file, method, self.high, self.redundant)
        for kept, dropped in duplicate_columns(df, C.existing(df, columns)):
            out.redundant_columns.append({"kept_column": kept, "dropped_column": dropped, "reason": "exact_duplicate", "correlation": None})
        gone = {r["dropped_column"] for r in out.redundant_columns}
        for a, b in combinations(report.columns, 2):
            r = report.matrix[a][b]
            if r is None or abs(r) < self.high:
                continue
            out.highly_correlated_pairs.append({"column_a": a, "column_b": b, "correlation": r})
            if abs(r) >= self.redundant and b not in gone:
                out.redundant_columns.append({"kept_column": a, "dropped_column": b, "reason": "near_duplicate_correlation", "correlation": r})
                gone.add(b)
        out.highly_correlated_pairs.sort(key=lambda p: -abs(p["correlation"]))
        return out

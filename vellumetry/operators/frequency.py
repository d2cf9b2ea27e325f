"""Value counts, top categories, histograms and density curves."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumetry.functions import expressions as X
from vellumetry.operators import columns as C

OTHER = "Other"


def value_frequencies(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(name, value, n) of all the columns' values as strings: one unpivot, one shuffle."""
    names = list(columns)
    cells = F.array(*(F.struct(F.lit(c).alias("name"), X.value(df, c).cast("string").alias("value")) for c in names))
    return df.select(F.explode(cells).alias("c")).where("c.value IS NOT NULL").groupBy("c.name", "c.value").agg(F.count(F.lit(1)).alias("n"))


def _ranked(freq: DataFrame) -> DataFrame:
    """Most frequent first, ties by value. Rows are distinct values; a window limit keeps only the first per task."""
    return freq.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value")))


def top_values(df: DataFrame, columns: Iterable[str], top_n: int = 10) -> DataFrame:
    """name, rank, value, count and percentage of non-null values of each column's most frequent values."""
    freq = value_frequencies(df, columns)
    total = freq.groupBy(F.col("name").alias("of")).agg(F.sum("n").alias("total"))
    top = _ranked(freq).where(F.col("rank") <= top_n)
    return top.join(F.broadcast(total), F.col("name") == F.col("of")).select("name", "rank", "value", F.col("n").alias("count"), X.percent(F.col("n"), F.col("total")).alias("percentage"))


def category_counts(df: DataFrame, columns: Iterable[str], top_n: int = 10) -> DataFrame:
    """name, rank, category, count, percentage: the top values and one row for the rest.

    Percentages are of all rows, null ones included. One pass over the table
    for all columns; totals are a row a column.
    """
    names = list(columns)
    for c in names:
        C.require(df, c)
    freq = value_frequencies(df, names)
    top = _ranked(freq).where(F.col("rank") <= top_n)
    total = freq.groupBy(F.col("name").alias("of")).agg(F.sum("n").alias("total"))
    kept = top.groupBy(F.col("name").alias("k")).agg(F.sum("n").alias("kept"))
    rest = total.join(kept, F.col("of") == F.col("k")).where("total > kept").select(F.col("of").alias("name"), F.lit(OTHER).alias("value"), (F.col("total") - F.col("kept")).alias("n"), F.lit(top_n + 1).alias("rank"))
    every = df.agg(F.count(F.lit(1)).alias("every"))
    both = top.select("name", "value", "n", "rank").unionByName(rest)
    return both.join(F.broadcast(every)).select("name", "rank", F.col("value").alias("category"), F.col("n").alias("count"), X.percent(F.col("n"), F.col("every")).alias("percentage"))


def categorical_columns(df: DataFrame, columns: Iterable[str] | None = None, max_unique_ratio: float = 0.5, max_unique: int = 50) -> list[str]:
    """Columns with few distinct values that aren't numbers."""
    wanted = C.existing(df, columns)
    if not wanted:
        return []
    rows = C.type_evidence(df, wanted).collect()
    ok = {r.name for r in rows if r.present and r.unique_count is not None and r.numbers / r.present < 0.95 and r.unique_count <= max_unique and r.unique_count / r.present <= max_unique_ratio}
    return [c for c in wanted if c in ok]


def histogram(df: DataFrame, column: str, bins: int | None = None, most: int = 10) -> DataFrame:
    """bin, lower, upper, count and density of equal-width bins; the last is closed.

    Without ``bins`` there are as many as distinct values, ``most`` at most. A
    constant column has edges half a unit about its value. Bounds are one
    aggregate row, counts one more; empty bins are filled in.
    """
    C.require(df, column)
    v = df.select(X.finite(X.number(df, column)).alias("v")).where("v IS NOT NULL")
    b = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), (F.lit(bins) if bins else F.greatest(F.lit(1), F.least(F.lit(most), F.count_distinct("v")))).cast("int").alias("bins"), F.count("v").alias("total"))
    b = b.where("total > 0").select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "bins", "total")
    b = b.withColumn("w", (F.col("hi") - F.col("lo")) / F.col("bins"))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")), F.col("bins") - 1).cast("int")
    counts = v.join(F.broadcast(b)).groupBy(at.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    spine = b.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    joined = spine.join(counts, F.col("bin") == F.col("k"), "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("upper"), n.alias("count"), (n / (F.col("total") * F.col("w"))).alias("density"))


def distribution_stats(df: DataFrame, column: str) -> DataFrame:
    """count, mean, median, std, min and max of a column that holds numbers."""
    C.require(df, column)
    return C.numeric_summary(df, [column]).select("count", "mean", "median", F.coalesce("std", F.lit(0.0)).alias("std"), "min", "max")


def density_curve(df: DataFrame, column: str, points: int = 200, bins_per_bandwidth: int = 8) -> DataFrame:
    """x and density of a Gaussian kernel estimate with Scott's bandwidth.

    Values are binned in one aggregation, in bins that are a fraction of the
    bandwidth wide; only occupied bins are rows, and each acts as the mean of
    its values. A bin goes to those points where its kernel isn't 0 in double
    precision: the wider the range in bandwidths, the more bins there may be,
    but the fewer points each reaches.
    """
    s = distribution_stats(df, column).first()
    if not s or not s["count"] or not s["std"]:
        raise ValueError(f"Column '{column}' has no spread to estimate a density from.")
    width = s["std"] * s["count"] ** -0.2
    reach = (s["max"] - s["min"]) / 2
    v = df.select(X.finite(X.number(df, column)).alias("v")).where("v IS NOT NULL")
    bins = v.groupBy(F.floor((F.col("v") - s["min"]) / (width / bins_per_bandwidth)).alias("k")).agg(F.avg("v").alias("c"), F.count(F.lit(1)).alias("n"))
    lo, step = s["min"] - reach, (s["max"] - s["min"] + 2 * reach) / (points - 1)
    far = 39 * width  # exp(-39 ** 2 / 2) is 0
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("c") - far - lo) / step))
    last = F.least(F.lit(points - 1).cast("long"), F.floor((F.col("c") + far - lo) / step))
    near = bins.select("c", "n", first.alias("first"), last.alias("last")).where("first <= last").select("c", "n", F.explode(F.sequence("first", "last")).alias("at"))
    z = (F.lit(lo) + F.col("at") * step - F.col("c")) / width
    kernel: Column = F.exp(-z * z / 2) * F.col("n")
    sums = near.groupBy("at").agg(F.sum(kernel).alias("total"))
    # a row a point
    xs = df.sparkSession.range(points).join(F.broadcast(sums), F.col("id") == F.col("at"), "left")
    return xs.select((F.lit(lo) + F.col("id") * step).alias("x"), (F.coalesce("total", F.lit(0.0)) / (s["count"] * width * (2 * 3.141592653589793) ** 0.5)).alias("density"))

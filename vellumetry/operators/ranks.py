"""Ranks and exact quantiles of columns of any size, by prefix sums over distinct values.

A column's distinct values are dealt to ranges whose bounds are approximate
quantiles, so no task holds a column. Ranges are an expression of the value:
a plan that is computed twice, or anew after a lost executor, deals alike.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from math import ceil, floor
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumetry.functions import expressions as X

RANGES = 200
#: Coarse steps of the search for a range; about the root of RANGES.
STEP = 15
#: Sketched ranks err by 1 / ACCURACY of the rows; a bracket reaches twice as far.
ACCURACY = 50_000


def range_of(bounds: Column, coarse: Column, v: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``v``; ``coarse`` holds every STEP-th of them."""
    whole = F.size(F.filter(coarse, lambda b: b <= v)) * STEP
    return whole + F.size(F.filter(F.slice(bounds, whole + 1, F.lit(STEP)), lambda b: b <= v))


def prefix_counts(freq: DataFrame, ranges: int = RANGES) -> DataFrame:
    """(name, v, m) of distinct values and counts -> with ``before``: rows of the name with a smaller value."""
    bounds = freq.groupBy(F.col("name").alias("__of")).agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10_000).alias("__bounds"))
    coarse = F.array(*(F.col("__bounds")[i] for i in range(STEP - 1, ranges - 1, STEP))).cast("array<double>")
    # a row a column
    dealt = freq.join(F.broadcast(bounds.withColumn("__coarse", coarse)), F.col("name") == F.col("__of"))
    dealt = dealt.withColumn("__part", range_of(F.col("__bounds"), F.col("__coarse"), F.col("v"))).drop("__of", "__bounds", "__coarse")
    totals = dealt.groupBy(F.col("name").alias("__n"), F.col("__part").alias("__p")).agg(F.sum("m").alias("__t"))
    start = F.coalesce(F.sum("__t").over(Window.partitionBy("__n").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("m").over(Window.partitionBy("name", "__part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("__within", within).join(totals.withColumn("__start", start), (F.col("name") == F.col("__n")) & (F.col("__part") == F.col("__p")))
    return placed.withColumn("before", F.col("__start") + F.col("__within")).drop("__n", "__p", "__t", "__part", "__within", "__start")


def quantile_values(values: DataFrame, at: Iterable[float] = (0.25, 0.5, 0.75)) -> dict[tuple[str, float], float]:
    """(column, q) -> exact quantile with linear interpolation of the non-null values of double columns.

    Three passes that shuffle hardly anything: sketches bracket each quantile,
    the values below each bracket are counted, and only the values inside one
    (some 1 / 10,000 of a column, and ties) are grouped. A bracket that its
    sketch misplaced takes in the whole column. A row a pass and two values a
    quantile reach the driver. Columns without values have no entry.
    """
    names, at = values.columns, [float(q) for q in at]
    reach = 2 / ACCURACY
    ends = [min(max(q + d, 0.0), 1.0) for q in at for d in (-reach, reach)]
    if not names or not at:
        return {}
    v = [X.col(c) for c in names]
    sketch = values.agg(*(F.struct(F.count(x).alias("n"), F.percentile_approx(x, ends, ACCURACY).alias("e")).alias(f"c{i}") for i, x in enumerate(v))).first()
    asked = [(i, q, sketch[i].n, *sketch[i].e[2 * k : 2 * k + 2]) for i in range(len(names)) if sketch[i].n for k, q in enumerate(at)]
    if not asked:
        return {}
    counts = values.agg(*(F.struct(F.count_if(v[i] < lo).alias("below"), F.count_if(v[i] <= hi).alias("upto")).alias(f"a{k}") for k, (i, _, _, lo, hi) in enumerate(asked))).first()
    out, open_ = {}, []
    for (i, q, n, lo, hi), c in zip(asked, counts):
        pos, below = q * (n - 1), c.below
        if not (below <= floor(pos) and ceil(pos) < c.upto):
            lo, hi, below = -X.INF, X.INF, 0
        if lo == hi:
            out[names[i], q] = lo
        else:
            open_.append((i, q, pos, lo, hi, below))
    if not open_:
        return out
    inside = [v[i].between(lo, hi) for i, _, _, lo, hi, _ in open_]
    cells = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(pos).alias("pos"), F.lit(below).alias("below"), F.when(inside[k], v[i]).alias("v")) for k, (i, _, pos, _, _, below) in enumerate(open_)))
    freq = values.where(reduce(or_, inside)).select(F.inline(cells)).where("v IS NOT NULL").groupBy("k", "pos", "below", "v").agg(F.count(F.lit(1)).alias("m"))
    upto = F.col("below") + F.sum("m").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    holds = lambda at: (F.col("upto") - F.col("m") <= at) & (at < F.col("upto"))
    found = freq.withColumn("upto", upto).groupBy("k").agg(F.max(F.when(holds(F.floor("pos")), F.col("v"))).alias("a"), F.max(F.when(holds(F.ceil("pos")), F.col("v"))).alias("b"))
    for r in found.collect():
        i, q, pos = open_[r.k][:3]
        out[names[i], q] = r.a if r.a == r.b or r.a == -X.INF else r.a + (r.b - r.a) * (pos - floor(pos))
    return out


def exact_quantiles(df: DataFrame, columns: Iterable[str], at: Iterable[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """name, q, value: quantiles with linear interpolation of finite numbers; columns without any give no rows."""
    found = quantile_values(df.select(*(X.finite(X.number(df, c)).alias(c) for c in dict.fromkeys(columns))), at)
    return df.sparkSession.createDataFrame([(c, q, x) for (c, q), x in found.items()], "name string, q double, value double")


def average_ranks(pairs: DataFrame) -> DataFrame:
    """(x, y, n) of distinct pairs and counts -> with rank_x and rank_y, ties sharing the mean rank."""
    one = lambda c: pairs.groupBy(F.col(c).alias("v")).agg(F.sum("n").alias("m")).select(F.lit(c).alias("name"), "v", "m")
    ranks = prefix_counts(one("x").unionAll(one("y"))).select("name", "v", (F.col("before") + (F.col("m") + 1) / 2).alias("rank"))
    for c in ("x", "y"):
        own = ranks.where(F.col("name") == c).select(F.col("v").alias("__v"), F.col("rank").alias(f"rank_{c}"))
        pairs = pairs.join(own, F.col(c) == F.col("__v")).drop("__v")
    return pairs

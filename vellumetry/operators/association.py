"""Association of features with each other and with a target."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumetry.functions import expressions as X
from vellumetry.operators import columns as C

STRENGTHS = ((0.1, "negligible"), (0.3, "weak"), (0.5, "moderate"))
TARGET_KINDS = ("numeric", "boolean", "categorical")
LEAKAGE = 0.95


def strength(v: float) -> str:
    return next((name for limit, name in STRENGTHS if v < limit), "strong")


def correlation_ratio(df: DataFrame, number: str, category: str) -> DataFrame:
    """association: square root of the share of a number's variation that lies between categories."""
    v = df.select(X.finite(X.number(df, number)).alias("v"), X.value(df, category).cast("string").alias("g")).where("v IS NOT NULL AND g IS NOT NULL")
    groups = v.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("w"))
    every = groups.agg(F.sum("n").alias("t"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("w")).alias("inside"))
    between = groups.join(F.broadcast(every)).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("b"), F.first("inside").alias("w"))
    return between.select(F.coalesce(F.sqrt(F.try_divide("b", F.col("b") + F.col("w"))), F.lit(0.0)).alias("association"))


def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, y and n of the pairs that occur."""
    pairs = df.select(X.value(df, x).cast("string").alias("x"), X.value(df, y).cast("string").alias("y"))
    return pairs.where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    """association: Cramér's V without correction, through the cells that occur; 0 if a side has one level."""
    cells = contingency(df, x, y)
    w = lambda c: F.sum("n").over(Window.partitionBy(c)).cast("double")
    s = cells.select("x", "y", "n", w("x").alias("r"), w("y").alias("c"))
    n = F.sum("n").cast("double")
    least = F.least(F.count_distinct("x"), F.count_distinct("y"))
    chi = n * (F.sum(F.col("n").cast("double") * F.col("n") / (F.col("r") * F.col("c"))) - 1)
    return s.agg(F.when(least < 2, 0.0).otherwise(F.sqrt(F.try_divide(F.greatest(chi, F.lit(0.0)), n * (least - 1)))).alias("association")).select(F.coalesce("association", F.lit(0.0)).alias("association"))


def abs_correlation_with(df: DataFrame, target: str, columns: Iterable[str]) -> DataFrame:
    """name, r and score = abs(r) of each column against a numeric target, in one aggregation."""
    y = X.number(df, C.require(df, target))
    out = C.per_column(df, list(columns), lambda c: {"r": X.pearson(X.number(df, c), y)})
    return out.where("r IS NOT NULL").select("name", "ordinal", F.round("r", 4).alias("r"), F.round(F.abs("r"), 4).alias("score"))


def between_group_variance(df: DataFrame, target: str, columns: Iterable[str]) -> DataFrame:
    """name and score: variance of the groups' means over the variance of all values, where both make sense."""
    names = list(columns)
    g = X.value(df, C.require(df, target))
    rows = df.where(g.isNotNull())
    sums = rows.groupBy(g.alias("g")).agg(*(f(X.number(df, c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("n", F.count), ("v", F.var_pop))))

    def stats(i: int) -> list[Column]:
        n, m, v = F.col(f"n{i}"), F.col(f"m{i}"), F.col(f"v{i}")
        total = F.sum(n)
        mean = F.sum(n * m) / F.nullif(total, F.lit(0))
        squares = F.sum(n * (v + m * m)) - total * mean * mean
        return [F.var_samp(m), F.try_divide(squares, total - 1), F.count(m)]

    parts = [F.struct(F.lit(c).alias("name"), F.lit(i).alias("ordinal"), stats(i)[0].alias("between"), stats(i)[1].alias("all"), stats(i)[2].alias("groups")) for i, c in enumerate(names)]
    out = sums.agg(F.array(*parts).alias("p")).select(F.inline("p"))
    return out.where("groups >= 2 AND `all` > 0").select("name", "ordinal", F.round(F.coalesce(F.col("between"), F.lit(0.0)) / F.col("all"), 4).alias("score"))


def coefficients_of_variation(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """name and score: standard deviation over the absolute mean; without columns whose mean is 0."""
    out = C.per_column(df, list(columns), lambda c: {"score": F.round(F.try_divide(F.stddev_samp(X.number(df, c)), F.abs(F.avg(X.number(df, c)))), 4)})
    return out.where("score IS NOT NULL")


def target_association(df: DataFrame, target: str, kinds: dict[str, str], exclude: Iterable[str] = (), *, max_levels: int = 50, top_n: int = 15) -> dict:
    """Features ranked by association with the target, with notes where it can't be trusted or computed."""
    kind = kinds[C.require(df, target)]
    out: dict = {"target": target, "target_kind": kind, "rankings": []}
    if kind not in TARGET_KINDS:
        return out | {"note": f"Target kind '{kind}' is not supported for association analysis."}
    names = [c for c in df.columns if c == target or (c not in set(exclude) and kinds[c] in TARGET_KINDS)]
    facts = {r.name: r for r in C.per_column(df, names, lambda c: {"u": C.distinct_count(df, c), "n": F.count(X.value(df, c)), "rows": F.count(F.lit(1)), "both": F.count_if(X.value(df, c).isNotNull() & X.value(df, target).isNotNull())}).collect()}
    if kind == "categorical" and facts[target].u > max_levels:
        return out | {"note": "Target has too many levels for association analysis."}
    if facts[target].rows < 30:
        out["note"] = "Small sample (<30 rows): treat these associations as unreliable."
    found = None
    numeric = []
    for c in names:
        f, k = facts[c], kinds[c]
        if c == target or f.both < 3 or (k != "numeric" and (f.u > max_levels or f.u > 0.5 * f.n)):
            continue
        if k == kind == "numeric":
            numeric.append(c)
            continue
        if k == "numeric" or kind == "numeric":
            one, method = correlation_ratio(df, *((c, target) if k == "numeric" else (target, c))), "correlation ratio"
        else:
            one, method = cramers_v(df, c, target), "Cramér's V"
        part = one.select(F.lit(c).alias("feature"), "association", F.lit(method).alias("method"))
        found = part if found is None else found.unionAll(part)
    if numeric:
        y = X.number(df, target)
        part = C.per_column(df, numeric, lambda c: {"association": F.coalesce(F.abs(X.pearson(X.number(df, c), y)), F.lit(0.0))}).select(F.col("name").alias("feature"), "association", F.lit("|Pearson r|").alias("method"))
        found = part if found is None else found.unionAll(part)
    rows = found.collect() if found is not None else []
    place = {c: i for i, c in enumerate(df.columns)}
    for r in sorted(rows, key=lambda r: (-round(r.association, 4), place[r.feature]))[:top_n]:
        out["rankings"].append({"feature": r.feature, "association": round(r.association, 4), "method": r.method, "strength": strength(r.association), "possible_leakage": r.association >= LEAKAGE})
    return out

"""Per-column operators. Each is one aggregation over the table, whatever its number of columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumetry.functions import expressions as X
from vellumetry.operators.ranks import quantile_values

CATEGORICAL_MAX_UNIQUE = 50
CATEGORICAL_UNIQUE_RATIO = 0.20
SAMPLE_VALUES = 5
SEVERITIES = ((0, "none"), (5, "low"), (20, "moderate"), (50, "high"))


def existing(df: DataFrame, columns: Iterable[str] | None) -> list[str]:
    """Those of the wanted columns that exist; all if none are named."""
    return df.columns if columns is None else [c for c in columns if c in df.columns]


def require(df: DataFrame, column: str) -> str:
    if column not in df.columns:
        raise KeyError(f"Column '{column}' not found in DataFrame.")
    return column


def per_column(df: DataFrame, columns: list[str], stats: Callable[[str], dict[str, Column]]) -> DataFrame:
    """A row a column: its name, its place and the aggregates that ``stats`` gives."""
    if not columns:
        raise ValueError("no columns")
    rows = [F.struct(F.lit(c).alias("name"), F.lit(i).alias("ordinal"), *(v.alias(k) for k, v in stats(c).items())) for i, c in enumerate(columns)]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def severity(percentage: Column) -> Column:
    out = F.lit("critical")
    for limit, name in reversed(SEVERITIES):
        out = F.when(percentage <= limit, F.lit(name)).otherwise(out)
    return out


def missing_values(df: DataFrame) -> DataFrame:
    """name, ordinal, null_count, null_percentage, severity."""
    n = F.count(F.lit(1))
    out = per_column(df, df.columns, lambda c: {"null_count": n - F.count(X.value(df, c)), "null_percentage": X.percent(n - F.count(X.value(df, c)), n)})
    return out.withColumn("severity", severity(F.col("null_percentage")))


def worst_columns(missing: DataFrame) -> DataFrame:
    """Columns of high or critical severity, critical ones first."""
    return missing.where(F.col("severity").isin("high", "critical")).orderBy(F.col("severity") != "critical", "ordinal")


def dataset_summary(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    missing = sum((n - F.count(X.value(df, c)) for c in df.columns), F.lit(0))
    return df.agg(n.alias("row_count"), F.lit(len(df.columns)).alias("column_count"), missing.cast("long").alias("missing_cells")).withColumn(
        "missing_percentage", X.percent(F.col("missing_cells"), F.col("row_count") * F.col("column_count"))
    )


def distinct_count(df: DataFrame, name: str, approximate: bool = False) -> Column:
    """Distinct values without nulls; null for columns whose values can't be compared."""
    if isinstance(X.type_of(df, name), T.MapType):
        return F.lit(None).cast("long")
    c = X.value(df, name)
    return F.approx_count_distinct(c) if approximate else F.count_distinct(c)


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """name, ordinal, dtype, missing_count, missing_percentage, unique_count."""
    n, types = F.count(F.lit(1)), dict(df.dtypes)
    return per_column(
        df,
        df.columns,
        lambda c: {
            "dtype": F.lit(types[c]),
            "missing_count": n - F.count(X.value(df, c)),
            "missing_percentage": X.percent(n - F.count(X.value(df, c)), n),
            "unique_count": distinct_count(df, c, approximate),
        },
    )


def type_evidence(df: DataFrame, columns: list[str]) -> DataFrame:
    """What the type rules need to know of each column."""

    def stats(c: str) -> dict[str, Column]:
        v = X.value(df, c)
        present = F.count(v)
        text = X.is_string(X.type_of(df, c))
        num, when = X.number(df, c), X.timestamp(df, c)
        plain = num
        if text:  # "1,200" counts
            stripped = F.replace(X.col(c), F.lit(","), F.lit(""))
            plain = F.when(stripped.rlike(X.NUMBER) | stripped.rlike(X.INFINITY), F.lit(1.0))
        return {
            "rows": F.count(F.lit(1)),
            "present": present,
            "numbers": F.count(num),
            "plain_numbers": F.count(plain),
            "integers": F.count_if(num % 1 == 0),
            "booleans": F.count_if(X.boolean_like(df, c)) if not X.is_complex(X.type_of(df, c)) else F.lit(0).cast("long"),
            "dates": F.count(when),
            "unique_count": distinct_count(df, c),
        }

    return per_column(df, columns, stats)


def _share(part: str) -> Column:
    return F.try_divide(F.col(part).cast("double"), F.col("present").cast("double"))


def infer_column_types(df: DataFrame) -> DataFrame:
    """name, ordinal, inferred_type as the loader sees text columns; dates are judged on all values."""
    typed = {f.name: f.dataType for f in df.schema.fields}
    dates = [c for c in df.columns if X.is_datetime(typed[c])]
    e = type_evidence(df, df.columns)
    categorical = ((F.col("unique_count") <= CATEGORICAL_MAX_UNIQUE) & (_share("unique_count") <= 0.05 + CATEGORICAL_UNIQUE_RATIO)) | (F.col("unique_count") <= 10)
    kind = (
        F.when(F.col("present") == 0, "unknown")
        .when(_share("booleans") >= 0.98, "boolean")
        .when((_share("numbers") >= 0.95) & ~F.col("name").isin(dates), F.when(F.col("integers") == F.col("numbers"), "integer").otherwise("float"))
        .when(F.col("name").isin(dates) | (_share("dates") >= 0.90), "datetime")
        .when(categorical, "categorical")
        .otherwise("text")
    )
    return e.select("name", "ordinal", kind.alias("inferred_type"))


def classify_columns(df: DataFrame) -> DataFrame:
    """name, ordinal, category (numerical, categorical, text, datetime) and the reason."""
    typed = {f.name: f.dataType for f in df.schema.fields}
    names = lambda test: [c for c, t in typed.items() if test(t)]
    ratio = _share("unique_count")
    few = (F.col("unique_count") <= CATEGORICAL_MAX_UNIQUE) & (ratio <= CATEGORICAL_UNIQUE_RATIO)
    label = F.concat(F.lit("Only "), F.col("unique_count").cast("string"), F.lit(" distinct values ("), F.format_string("%.1f", ratio * 100), F.lit("% of rows) - a repeating label set."))
    name = F.col("name")
    case = lambda category, reason: F.struct(F.lit(category).alias("category"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    found = (
        F.when(F.col("present") == 0, case("text", "Column is entirely empty."))
        .when(name.isin(names(lambda t: isinstance(t, T.BooleanType))), case("categorical", "Boolean values form a fixed 2-value category."))
        .when(name.isin(names(X.is_datetime)), case("datetime", "Already a datetime dtype."))
        .when(name.isin(names(X.is_numeric)), case("numerical", "Numeric dtype (int/float)."))
        .when(name.isin(names(X.is_complex)), case("text", "Complex values."))
        .when(_share("dates") >= 0.90, case("datetime", "Over 90% of sampled values parse as dates."))
        .when(_share("plain_numbers") >= 0.95, case("numerical", "Over 95% of values parse as numbers."))
        .when(few, case("categorical", label))
        .otherwise(case("text", "High-cardinality free-form string values."))
    )
    return type_evidence(df, df.columns).select("name", "ordinal", found.alias("f")).select("name", "ordinal", "f.category", "f.reason")


#: The loader's types as analysis kinds.
KIND_OF_TYPE = {"integer": "numeric", "float": "numeric", "boolean": "boolean", "datetime": "datetime", "categorical": "categorical", "text": "text"}


def resolve_kinds(df: DataFrame, inferred: dict[str, str] | None = None) -> dict[str, str]:
    """Analysis kind of each column; one aggregation if text columns are left to judge."""
    out, open_ = {}, []
    for f in df.schema.fields:
        known = KIND_OF_TYPE.get((inferred or {}).get(f.name, ""))
        t = f.dataType
        out[f.name] = known or ("boolean" if isinstance(t, T.BooleanType) else "numeric" if X.is_numeric(t) else "datetime" if X.is_datetime(t) else "text")
        if not known and X.is_string(t):
            open_.append(f.name)
    if open_:
        for r in per_column(df, open_, lambda c: {"u": distinct_count(df, c)}).collect():
            out[r.name] = "categorical" if r.u <= CATEGORICAL_MAX_UNIQUE else "text"
    return out


def column_kinds(df: DataFrame) -> DataFrame:
    """resolve_kinds as a table, for queries."""
    rows = [(c, i, k) for i, (c, k) in enumerate(resolve_kinds(df).items())]
    return df.sparkSession.createDataFrame(rows, "name string, ordinal int, kind string")


def numeric_columns(df: DataFrame, columns: Iterable[str] | None = None, of_all_rows: bool = True) -> list[str]:
    """Columns whose values are numbers in at least 95 % of all rows (or of non-null ones). Booleans and dates aren't."""
    typed = {f.name: f.dataType for f in df.schema.fields}
    wanted = [c for c in existing(df, columns) if X.is_numeric(typed[c]) or X.is_string(typed[c])]
    if not wanted:
        return []
    whole = F.count(F.lit(1)) if of_all_rows else None
    rows = per_column(df, wanted, lambda c: {"ok": F.coalesce(F.try_divide(F.count(X.number(df, c)).cast("double"), (whole if whole is not None else F.count(X.value(df, c))).cast("double")) >= 0.95, F.lit(False))}).collect()
    good = {r.name for r in rows if r.ok}
    return [c for c in wanted if c in good]


def numeric_summary(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """count, missing, mean, std, min, exact q1, median, q3, max, skew and zeros of finite numbers.

    The quartiles are computed at once (ranks.quantile_values), the rest when asked for.
    """
    names = list(columns)
    quartiles = quantile_values(df.select(*(X.finite(X.number(df, c)).alias(c) for c in dict.fromkeys(names))))

    def stats(c: str) -> dict[str, Column]:
        v = X.finite(X.number(df, c))
        q = [F.lit(quartiles.get((c, at))).cast("double") for at in (0.25, 0.5, 0.75)]
        return {
            "count": F.count(v),
            "missing": F.count(F.lit(1)) - F.count(v),
            "mean": F.avg(v),
            "std": F.stddev_samp(v),
            "min": F.min(v),
            "q1": q[0],
            "median": q[1],
            "q3": q[2],
            "max": F.max(v),
            "skew": X.skew(v),
            "zeros": F.count_if(v == 0),
        }

    return per_column(df, names, stats)


def datetime_summary(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """count, missing, min, max and whole elapsed days between them."""

    def stats(c: str) -> dict[str, Column]:
        v = X.timestamp(df, c)
        return {"count": F.count(v), "missing": F.count(F.lit(1)) - F.count(v), "min": F.min(v), "max": F.max(v), "span_days": F.timestamp_diff("DAY", F.min(v), F.max(v))}

    return per_column(df, list(columns), stats)


def text_lengths(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """count and mean number of characters."""
    return per_column(df, list(columns), lambda c: {"count": F.count(X.col(c)), "avg_length": F.round(F.avg(F.char_length(X.col(c).cast("string"))), 2)})


def lexical_issues(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Values with edge white space, that aren't numbers, that are infinite, that aren't dates, and lexical classes (numbers, dates, other words) present."""

    def stats(c: str) -> dict[str, Column]:
        v, num, when = X.value(df, c), X.number(df, c), X.timestamp(df, c)
        text = v.cast("string")
        classes = [F.max(F.when(test, 1).otherwise(0)) for test in (num.isNotNull(), num.isNull() & when.isNotNull(), v.isNotNull() & num.isNull() & when.isNull())]
        return {
            "whitespace": F.count_if(text.rlike(X.EDGE_SPACE)),
            "non_numeric": F.count_if(v.isNotNull() & num.isNull()),
            "infinite": F.count_if(F.abs(num) == F.lit(X.INF)),
            "unparseable_dates": F.count_if(v.isNotNull() & when.isNull()),
            "lexical_classes": sum(classes[1:], classes[0]),
        }

    return per_column(df, list(columns), stats)


def consistency(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Share of a column's values that are of its dominant type; 1 for text and empty columns."""
    e = type_evidence(df, existing(df, columns))
    share = F.when(F.col("present") == 0, 1.0).when(_share("numbers") >= 0.5, _share("numbers")).when(_share("dates") >= 0.5, _share("dates")).otherwise(1.0)
    return e.select("name", "ordinal", share.alias("consistency"))

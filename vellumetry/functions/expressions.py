"""Column expressions: lenient parsing, null rules and statistics.

NaN counts as missing everywhere. Nothing here raises under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of a text file that mean "missing".
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: Words that mean a truth value.
BOOLEAN_WORDS = ["true", "false", "yes", "no", "y", "n", "0", "1", "t", "f"]

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY = r"^\s*[+-]?(?i:inf|infinity)\s*$"
EDGE_SPACE = r"^\s|\s$"

#: (guard, format); a guard keeps a format from strings it isn't for. None: a cast.
DATE_FORMATS = [
    (r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$", None),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}(:\d{2})?$", "M/d/y H:m[:s]"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, y"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, y"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM y"),
    (r"^\d{4}$", "y"),
]
INF = float("inf")


def type_of(df: DataFrame, name: str) -> T.DataType:
    return next(f.dataType for f in df.schema.fields if f.name == name)


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_datetime(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_string(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.CharType, T.VarcharType))


def is_complex(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN as null."""
    c = col(name)
    return F.when(~F.isnan(c), c) if isinstance(type_of(df, name), (T.FloatType, T.DoubleType)) else c


def number(df: DataFrame, name: str) -> Column:
    """The column as double; what isn't a number is null. Infinities stay."""
    t, c = type_of(df, name), value(df, name)
    if is_numeric(t) or isinstance(t, T.BooleanType):
        return c.cast("double")
    if is_string(t):
        infinite = F.when(F.startswith(F.trim(c), F.lit("-")), -INF).otherwise(INF)
        return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double")).when(c.rlike(INFINITY), infinite)
    return F.lit(None).cast("double")


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.abs(c) < F.lit(INF), c)


def timestamp(df: DataFrame, name: str) -> Column:
    """The column as time without zone; what isn't a date of 1678 to 2261 is null."""
    t, c = type_of(df, name), col(name)
    if is_datetime(t):
        return c.cast("timestamp_ntz")
    if not is_string(t):
        return F.lit(None).cast("timestamp_ntz")
    out = F.lit(None).cast("timestamp_ntz")
    for guard, form in reversed(DATE_FORMATS):
        parsed = c.try_cast("timestamp") if form is None else F.try_to_timestamp(c, F.lit(form))
        out = F.when(c.rlike(guard), parsed.cast("timestamp_ntz")).otherwise(out)
    return F.when(F.year(out).between(1678, 2261), out)


def boolean_like(df: DataFrame, name: str) -> Column:
    return F.lower(F.trim(col(name).cast("string"))).isin(BOOLEAN_WORDS)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded percentage; 0 of nothing is 0."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits), F.lit(0.0))


def skew(c: Column) -> Column:
    """Bias-corrected skewness; null for fewer than 3 values, 0 for constants."""
    n = F.count(c).cast("double")
    corrected = F.coalesce(F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)), F.lit(0.0))
    return F.when(n >= 3, corrected)


def pearson(x: Column, y: Column) -> Column:
    """Over rows in which both are finite; null where one is constant."""
    both = finite(x).isNotNull() & finite(y).isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))

"""Duplicate rows and duplicate columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vellumetry.functions import expressions as X
from vellumetry.operators import columns as C

ROW_ID = "__row_id"


def with_row_id(df: DataFrame) -> DataFrame:
    """Adds the 0-based position of each row. Ask for it only where positions are reported."""
    schema = T.StructType([*df.schema.fields, T.StructField(ROW_ID, T.LongType(), False)])
    return df.rdd.zipWithIndex().map(lambda r: (*r[0], r[1])).toDF(schema)


def _keys(df: DataFrame, subset: list[str] | None):
    """Grouping keys; a map can't be one, so its sorted entries stand for it."""
    names = subset or df.columns
    for c in names:
        C.require(df, c)
    own = lambda c: F.array_sort(F.map_entries(X.col(c))) if isinstance(X.type_of(df, c), T.MapType) else X.value(df, c)
    return [own(c).alias(f"k{i}") for i, c in enumerate(names)]


def duplicate_count(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """duplicate_rows: rows that repeat an earlier one; nulls equal nulls. Row hashes are grouped before rows are."""
    groups = df.select(*_keys(df, subset)).groupBy(*(f"k{i}" for i in range(len(subset or df.columns)))).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def duplicate_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """row_id of every row that repeats an earlier one; ``df`` has ROW_ID."""
    own = [c for c in (subset or df.columns) if c != ROW_ID]
    keyed = df.select(*_keys(df, own), ROW_ID)
    nth = F.row_number().over(Window.partitionBy(*(f"k{i}" for i in range(len(own)))).orderBy(ROW_ID))
    return keyed.withColumn("nth", nth).where("nth > 1").select(F.col(ROW_ID).alias("row_id"))


def auto_subset(df: DataFrame) -> list[str]:
    """Columns that have fewer distinct values than there are rows."""
    rows = C.column_profile(df).collect()
    n = df.count()
    return [r.name for r in sorted(rows, key=lambda r: r.ordinal) if n and (r.unique_count or 0) < n]


@dataclass
class DuplicateReport:
    full_duplicate_count: int
    full_duplicate_indices: list[int] = field(default_factory=list)
    partial_duplicate_subset: list[str] = field(default_factory=list)
    partial_duplicate_count: int = 0
    partial_duplicate_indices: list[int] = field(default_factory=list)


class DuplicateDetector:
    """Counts by default; indices, which need row positions, only if asked for."""

    def detect(self, df: DataFrame, partial_subset: list[str] | None = None, indices: bool = False) -> DuplicateReport:
        for c in partial_subset or []:
            C.require(df, c)
        subset = partial_subset or auto_subset(df)
        out = DuplicateReport(duplicate_count(df).first()[0], partial_duplicate_subset=subset)
        out.partial_duplicate_count = duplicate_count(df, subset).first()[0] if subset else 0
        if indices:
            rows = with_row_id(df)
            out.full_duplicate_indices = sorted(r[0] for r in duplicate_rows(rows).collect())
            out.partial_duplicate_indices = sorted(r[0] for r in duplicate_rows(rows, subset).collect()) if subset else []
        return out


def duplicate_columns(df: DataFrame, columns: list[str] | None = None) -> list[tuple[str, str]]:
    """(kept, dropped) for columns whose values, as strings, equal an earlier column's.

    One aggregation fingerprints all columns; one more confirms the candidates
    cell by cell. Both columns of a pair lie in the same row: no join.
    """
    names = C.existing(df, columns)
    if len(names) < 2:
        return []
    text = lambda c: F.to_json(F.struct(X.col(c).alias("v"))) if X.is_complex(X.type_of(df, c)) else X.value(df, c).cast("string")
    prints = {r.name: (r.n, r.x, r.a, r.z) for r in C.per_column(df, names, lambda c: {"n": F.count(text(c)), "x": F.bit_xor(F.xxhash64(text(c))), "a": F.min(text(c)), "z": F.max(text(c))}).collect()}
    pairs = [(a, b) for j, b in enumerate(names) for a in names[:j] if prints[a] == prints[b]]
    if not pairs:
        return []
    differ = df.agg(*(F.count_if(~text(a).eqNullSafe(text(b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs))).first()
    kept: dict[str, str] = {}
    for i, (a, b) in enumerate(pairs):
        if not differ[i] and b not in kept and a not in kept:
            kept[b] = a
    return [(kept[b], b) for b in names if b in kept]

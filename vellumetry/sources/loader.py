"""Loading a delimited or workbook file as a cleaned table with a profile of its columns."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumetry.functions import expressions as X
from vellumetry.operators import columns as C
from vellumetry.sources.errors import EmptyDatasetError, FileValidationError, UnsupportedFileTypeError
from vellumetry.sources.excel import read_sheet

DELIMITED = (".csv", ".tsv", ".txt")
WORKBOOKS = (".xlsx", ".xls", ".xlsm")
MAX_FILE_SIZE_MB = 500


@dataclass
class LoadedColumn:
    name: str
    original_dtype: str
    inferred_type: str
    null_count: int
    null_percentage: float
    unique_count: int
    sample_values: list[str] = field(default_factory=list)


@dataclass
class DatasetProfile:
    source_file: str
    file_type: str
    n_rows: int
    n_columns: int
    columns: list[LoadedColumn] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def clean_header(raw: list[str | None]) -> tuple[list[str], list[str]]:
    """Usable, distinct names and a warning for each change."""
    names: list[str] = []
    warnings: list[str] = []
    repeats: dict[str, int] = {}
    for i, cell in enumerate(raw, 1):
        name = (cell or "").strip()
        if not name or name.lower().startswith("unnamed:"):
            name = f"column_{i}"
            warnings.append(f"Column at position {i} had no header; auto-named '{name}'.")
        if name in repeats or name in names:
            new = name
            while new in names or new == name:  # a suffix may itself be taken
                repeats[name] = repeats.get(name, 0) + 1
                new = f"{name}_{repeats[name]}"
            warnings.append(f"Duplicate column name '{name}' renamed to '{new}'.")
            name = new
        names.append(name)
    return names, warnings


def drop_empty(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Without columns and rows that hold nothing; all-empty tables keep their columns."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *(F.count(X.value(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns))).first()
    empty = [c for i, c in enumerate(df.columns) if not counts[f"c{i}"]]
    warnings = []
    if empty and len(empty) < len(df.columns):
        warnings.append(f"Dropped fully-empty column(s): {empty}")
        df = df.drop(*(X.col(c) for c in empty))
    full = df.na.drop(how="all")
    if gone := counts["__n"] - full.count():
        warnings.append(f"Dropped {gone} fully-empty row(s).")
        df = full
    return df, warnings


def sniff_delimiter(sample: str) -> str:
    lines = [x for x in sample.splitlines() if x.strip()][:20]
    try:
        return csv.Sniffer().sniff("\n".join(lines), delimiters=",;\t|").delimiter
    except csv.Error:
        return max(",;\t|", key=lambda d: lines[0].count(d)) if lines else ","


class DatasetLoader:
    """``load(path)`` for files; ``profile(df)`` for any DataFrame.

    A file without a URI scheme is checked here (existence, suffix, size); the
    size limit does not apply to URIs, which only Spark reads.
    """

    def __init__(self, spark: SparkSession, max_file_size_mb: float | None = MAX_FILE_SIZE_MB):
        self.spark, self.max_mb = spark, max_file_size_mb

    def load(self, path: str | Path, sheet_name: int | str = 0) -> tuple[DataFrame, DatasetProfile]:
        kind = self._validate(str(path))
        try:
            df, header = self._workbook(str(path), sheet_name) if kind == "excel" else self._delimited(str(path))
            names, warnings = clean_header(header)
            df = df.toDF(*names)
            df, more = drop_empty(df)
            profile = self.profile(df, str(Path(str(path)).name), kind, warnings + more)
        except (ValueError, UnicodeDecodeError, PySparkException) as e:
            raise FileValidationError(f"Could not parse {path}: {e}") from e
        if not profile.n_rows or not profile.n_columns:
            raise EmptyDatasetError(f"{path} holds no data.")
        return df, profile

    def _validate(self, path: str) -> str:
        suffix = Path(path).suffix.lower()
        remote = "://" in path
        at = Path(path)
        if not remote and not at.is_file():
            raise FileValidationError(f"File not found: {path}")
        if suffix == ".xls" or suffix not in DELIMITED + WORKBOOKS:
            raise UnsupportedFileTypeError(f"Unsupported file type '{suffix}'.")
        if not remote:
            size = at.stat().st_size
            if not size:
                raise FileValidationError(f"File is empty (0 bytes): {path}")
            if self.max_mb is not None and size > self.max_mb * 1024 * 1024:
                raise FileValidationError(f"File is larger than {self.max_mb} MB: {path}")
        return "csv" if suffix in DELIMITED else "excel"

    def _delimited(self, path: str) -> tuple[DataFrame, list[str]]:
        lines = [r.value for r in self.spark.read.text(path).limit(50).collect()]
        head = "\n".join(lines).removeprefix("﻿")
        if not head.strip():
            raise EmptyDatasetError(f"{path} holds no data.")
        sep = sniff_delimiter(head)
        header = next(csv.reader(io.StringIO(head), delimiter=sep))
        # a line with an odd number of quotes is part of a cell of several lines; other files are read in parallel
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
        several = not self.spark.read.text(path).where(quotes % 2 == 1).isEmpty()
        schema = ", ".join(f"_c{i} string" for i in range(len(header) + 1))
        options = {"sep": sep, "header": True, "enforceSchema": True, "multiLine": several, "quote": '"', "escape": '"', "nullValue": "", "mode": "PERMISSIVE"}
        df = self.spark.read.options(**options).schema(schema).csv(path)
        if not df.where(F.col(f"_c{len(header)}").isNotNull()).isEmpty():
            raise ValueError(f"a row has more than the header's {len(header)} cells")
        df = df.drop(f"_c{len(header)}")
        return df.select(*(F.when(~F.col(c).isin(X.NA_TOKENS), F.col(c)).alias(c) for c in df.columns)), header

    def _workbook(self, path: str, sheet: int | str) -> tuple[DataFrame, list[str | None]]:
        rows = read_sheet(path, sheet)
        if not rows:
            raise EmptyDatasetError(f"{path} holds no data.")
        header, body = rows[0], rows[1:]
        df = self.spark.createDataFrame(body, ", ".join(f"_c{i} string" for i in range(len(header))))
        return df.select(*(F.when(~F.col(c).isin(X.NA_TOKENS), F.col(c)).alias(c) for c in df.columns)), header

    def profile(self, df: DataFrame, source_file: str = "unknown", file_type: str = "dataframe", warnings: list[str] | None = None) -> DatasetProfile:
        rows = C.column_profile(df).collect()
        types = {r.name: r.inferred_type for r in C.infer_column_types(df).collect()}
        sample: dict[str, list[str]] = {c: [] for c in df.columns}
        for r in df.limit(200).collect():
            for c in df.columns:
                if r[c] is not None and len(sample[c]) < C.SAMPLE_VALUES:
                    sample[c].append(str(r[c]))
        for c in (c for c in df.columns if len(sample[c]) < C.SAMPLE_VALUES):  # few values in the first rows
            sample[c] = [str(r[0]) for r in df.where(X.col(c).isNotNull()).select(X.col(c)).limit(C.SAMPLE_VALUES).collect()]
        columns = [LoadedColumn(r.name, r.dtype, types[r.name], r.missing_count, r.missing_percentage, r.unique_count, sample[r.name]) for r in sorted(rows, key=lambda r: r.ordinal)]
        return DatasetProfile(source_file, file_type, df.count(), len(df.columns), columns, warnings or [])

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vellumetry.functions import expressions as X
from vellumetry.operators import columns as C


def by_name(df):
    return {r.name: r for r in df.collect()}


def test_numbers_are_read_leniently(spark):
    cells = ["42", " 12 ", "1e3", "1d", "12f", "1_000", "", "abc", "-.5", "5.", "inf", "-Infinity", "+7", None]
    df = spark.createDataFrame([(c,) for c in cells], "s string")
    got = [r[0] for r in df.select(X.number(df, "s")).collect()]
    assert got == [42, 12, 1000, None, None, None, None, None, -0.5, 5, float("inf"), -float("inf"), 7, None]


def test_dates_are_read_leniently(spark):
    cells = ["2024-01-05", "2024-01-05 10:20:30", "20240105", "01/05/2024", "Jan 5, 2024", "2024", "1001", "nope", "99999999", None]
    df = spark.createDataFrame([(c,) for c in cells], "s string")
    got = [r[0] for r in df.select(X.timestamp(df, "s")).collect()]
    day = dt.datetime(2024, 1, 5)
    assert got == [day, dt.datetime(2024, 1, 5, 10, 20, 30), day, day, day, dt.datetime(2024, 1, 1), None, None, None, None]


def test_severity_buckets_and_worst_columns(spark):
    rows = [(1, 1 if i else None, None if i < 6 else i) for i in range(10)]
    m = C.missing_values(spark.createDataFrame(rows, "none int, low int, critical int"))
    got = by_name(m)
    assert [got[c].severity for c in ("none", "low", "critical")] == ["none", "moderate", "critical"]
    assert [r.name for r in C.worst_columns(m).collect()] == ["critical"]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert C.missing_values(df).first().null_count == 1


def test_classification(spark):
    rows = [(i, "north" if i % 2 else "south", f"free text number {i}", f"2024-01-{i + 1:02d}", True, "1,200") for i in range(20)]
    df = spark.createDataFrame(rows, "age int, region string, comment string, day string, active boolean, amount string")
    got = by_name(C.classify_columns(df))
    assert {k: v.category for k, v in got.items()} == {"age": "numerical", "region": "categorical", "comment": "text", "day": "datetime", "active": "categorical", "amount": "numerical"}
    assert got["region"].reason == "Only 2 distinct values (10.0% of rows) - a repeating label set."


def test_inference_of_text_columns(spark):
    rows = [(str(i), str(i / 2), ["yes", "no"][i % 2], f"2024-01-{i + 1:02d}", "ab"[i % 2], None, f"long text {i}") for i in range(28)]
    df = spark.createDataFrame(rows, "i string, f string, b string, d string, c string, n string, t string")
    got = {k: v.inferred_type for k, v in by_name(C.infer_column_types(df)).items()}
    assert got == {"i": "integer", "f": "float", "b": "boolean", "d": "datetime", "c": "categorical", "n": "unknown", "t": "text"}


def test_numeric_summary_equals_pandas(spark):
    x = np.random.default_rng(0).exponential(size=300)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    r, s = C.numeric_summary(df, ["x"]).first(), pd.Series(x)
    assert np.allclose([r["mean"], r["std"], r.q1, r.median, r.q3, r.skew], [s.mean(), s.std(), *s.quantile([0.25, 0.5, 0.75]), s.skew()])


def test_numeric_summary_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (float("inf"), 5.0, None)], "a double, b double, c double")
    got = by_name(C.numeric_summary(df, df.columns))
    assert (got["a"]["count"], got["a"]["skew"], got["b"]["skew"], got["b"]["std"], got["c"]["count"]) == (2, None, 0.0, 0.0, 0)


def test_span_is_elapsed_days(spark):
    df = spark.createDataFrame([("2024-01-01 13:00:00",), ("2024-01-02 12:00:00",)], "d string")
    assert C.datetime_summary(df, ["d"]).first().span_days == 0


def test_complex_columns_are_only_counted(spark):
    df = spark.createDataFrame([([1.0], {"a": 1}), (None, {"b": 2})], "v array<double>, m map<string,int>")
    got = by_name(C.column_profile(df))
    assert (got["v"].missing_count, got["m"].unique_count) == (1, None)
    assert {r.category for r in C.classify_columns(df).collect()} == {"text"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert {r.null_percentage for r in C.missing_values(df).collect()} == {0.0}
    assert C.numeric_columns(df) == []


def test_one_job_for_all_columns(spark):
    df = spark.range(10).select(*(F.col("id").alias(f"c{i}") for i in range(30)))
    plan = C.missing_values(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2


def test_require_names_the_column(spark):
    with pytest.raises(KeyError):
        C.require(spark.range(1), "nope")

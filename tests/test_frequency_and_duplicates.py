import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumetry.operators import duplicates as D
from vellumetry.operators import frequency as Q


@pytest.fixture(scope="module")
def regions(spark):
    return spark.createDataFrame([(v,) for v in ["n", "n", "n", "s", "s", "e", None]], "region string")


def test_percentages_are_of_all_rows(regions):
    got = {r.category: (r["count"], r.percentage) for r in Q.category_counts(regions, ["region"]).collect()}
    assert got == {"n": (3, 42.86), "s": (2, 28.57), "e": (1, 14.29)}


def test_percentages_of_values(regions):
    got = [(r.value, r.percentage) for r in Q.top_values(regions, ["region"]).orderBy("rank").collect()]
    assert got == [("n", 50.0), ("s", 33.33), ("e", 16.67)]


def test_long_tail_is_one_row(spark):
    df = spark.createDataFrame([(f"c{i:02d}",) for i in range(20)], "cat string")
    got = Q.category_counts(df, ["cat"], 5).orderBy("rank").collect()
    assert [r.category for r in got] == ["c00", "c01", "c02", "c03", "c04", "Other"]
    assert got[-1]["count"] == 15


def test_unknown_column(regions):
    with pytest.raises(KeyError):
        Q.category_counts(regions, ["nope"])


def test_empty_column_has_no_categories(spark):
    assert Q.category_counts(spark.createDataFrame([(None,)], "a string"), ["a"]).count() == 0


@pytest.mark.parametrize("bins", [None, 7, 30])
def test_histogram_equals_numpy(spark, bins):
    x = np.random.default_rng(1).normal(size=400).tolist()
    rows = Q.histogram(spark.createDataFrame([(v,) for v in x], "x double"), "x", bins=bins).orderBy("bin").collect()
    counts, edges = np.histogram(x, bins=bins or 10)
    assert [r["count"] for r in rows] == counts.tolist()
    assert np.allclose([r.lower for r in rows] + [rows[-1].upper], edges)


def test_constant_histogram(spark):
    r = Q.histogram(spark.createDataFrame([(3.0,)] * 4, "x double"), "x").collect()
    assert [(x.lower, x.upper, x["count"]) for x in r] == [(2.5, 3.5, 4)]


def test_density_integrates_to_one(spark):
    x = np.random.default_rng(2).normal(size=500).tolist()
    pts = sorted((r.x, r.density) for r in Q.density_curve(spark.createDataFrame([(v,) for v in x], "x double"), "x").collect())
    xs, ys = zip(*pts)
    assert abs(np.trapezoid(ys, xs) - 1) < 0.01
    w = np.std(x, ddof=1) * 500**-0.2
    at = np.array(xs[100])
    exact = np.exp(-(((at - np.array(x)) / w) ** 2) / 2).sum() / (500 * w * np.sqrt(2 * np.pi))
    assert abs(ys[100] - exact) < 1e-3


def test_density_of_a_heavy_tail_equals_brute_force(spark):
    """Where a bin of a fixed number over the range is wider than the bandwidth."""
    n, points = 200000, 4001
    i = np.arange(n)
    x = np.where(i == 0, 1e6, np.where(i % 1000 == 1, i * 0.5, i % 100 / 100))
    tail = F.when(F.col("id") == 0, 1e6).when(F.col("id") % 1000 == 1, F.col("id") * 0.5).otherwise(F.col("id") % 100 / 100)
    got = sorted((r.x, r.density) for r in Q.density_curve(spark.range(n).select(tail.alias("x")), "x", points).collect())
    xs, ys = map(np.array, zip(*got))
    values, counts = np.unique(x, return_counts=True)
    w = np.std(x, ddof=1) * n**-0.2
    exact = (np.exp(-(((xs[:, None] - values) / w) ** 2) / 2) * counts).sum(1) / (n * w * np.sqrt(2 * np.pi))
    assert len(xs) == points and exact.max() * w > 0.1
    assert np.allclose(ys, exact, rtol=0.01, atol=1e-5 * exact.max())


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (1, "a"), (3, None)], "id int, name string").coalesce(1)
    r = D.DuplicateDetector().detect(df, indices=True)
    assert (r.full_duplicate_count, r.full_duplicate_indices) == (2, [3, 4])
    r = D.DuplicateDetector().detect(df, ["name"])
    assert r.partial_duplicate_count == 2
    with pytest.raises(KeyError):
        D.DuplicateDetector().detect(df, ["nope"])


def test_auto_subset(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x")], "id int, name string, k string")
    assert D.auto_subset(df) == ["name", "k"]
    assert D.auto_subset(df.limit(0)) == []


def test_duplicate_columns(spark):
    df = spark.createDataFrame([(i, i, str(i), -i, None) for i in range(5)], "a int, b int, c string, d int, e int")
    assert D.duplicate_columns(df) == [("a", "b"), ("a", "c")]

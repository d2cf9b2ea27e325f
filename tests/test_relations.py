import numpy as np
import pandas as pd
import pytest

from vellumetry.operators import association as A
from vellumetry.operators import correlation as K
from vellumetry.operators import outliers as O
from vellumetry.operators import ranks as R
from vellumetry.operators.ranks import exact_quantiles, prefix_counts


def test_iqr_and_zscore(spark):
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate([10, 12, 11, 13, 12, 11, 500, 12])], "id int, amount int, category string").coalesce(1)
    r = O.OutlierDetector().detect(df, indices=True)
    assert {c.name: c.outlier_indices for c in r.columns} == {"id": [], "amount": [6]}
    assert r.total_outlier_rows == 1
    assert O.OutlierDetector(zscore_threshold=2).detect(df, "zscore", ["amount", "absent"]).columns[0].outlier_count == 1
    with pytest.raises(ValueError):
        O.OutlierDetector().detect(df, "nope")


def test_outlier_edges(spark):
    df = spark.createDataFrame([(5.0,)] * 6 + [(9.0,)], "x double")
    assert O.outliers(df, ["x"]).first().outlier_count == 1  # equal quartiles
    assert O.outliers(df, ["x"], guarded=True).first().outlier_count == 0
    assert O.outliers(df.where("x = 5"), ["x"], "zscore").first().outlier_count == 0
    assert O.outliers(spark.createDataFrame([(None,)], "x double"), ["x"]).count() == 0


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlations_equal_pandas(spark, method):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, 200).astype(float)
    pdf = pd.DataFrame({"x": x, "y": x + rng.normal(size=200) * 5, "z": np.where(rng.random(200) < 0.1, np.nan, rng.integers(0, 5, 200))})
    df = spark.createDataFrame(pdf)
    if method == "spearman":
        expect = lambda a, b: (lambda d: d.rank().corr().iloc[0, 1])(pdf[[a, b]].dropna())
    else:
        expect = lambda a, b: pdf.corr().loc[a, b]
    for r in K.correlations(df, ["x", "y", "z"], method).collect() if method == "pearson" else K.correlations(df.na.drop(), ["x", "y"], method).collect():
        want = expect(r.column_a, r.column_b) if method == "pearson" else pdf.dropna()[["x", "y"]].rank().corr().iloc[0, 1]
        assert abs(r.r - want) < 1e-9


def test_kendall_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
    i, j = np.triu_indices(60, 1)
    a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
    want = (a * b).sum() / np.sqrt((a != 0).sum() * (b != 0).sum())
    got = K.correlations(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), method="kendall").first().r
    assert abs(got - want) < 1e-9


def test_constants_and_too_few(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "a double, b double")
    assert K.correlations(df).first().r is None
    with pytest.raises(ValueError):
        K.correlations(df.select("a"))


def test_redundancy(spark):
    df = spark.createDataFrame([(i, i, 2 * i, (i * 7919) % 13, "l") for i in range(10)], "x int, x_copy int, y int, noise int, label string")
    r = K.FeatureCorrelationAnalyzer().analyze(df)
    assert r.recommended_drops == ["x_copy", "y"]
    assert r.redundant_columns[0]["reason"] == "exact_duplicate"
    for bad in ((0, 0.9), (0.9, 0.8), (0.5, 1.1)):
        with pytest.raises(ValueError):
            K.FeatureCorrelationAnalyzer(*bad)


def test_association_measures(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"c": rng.choice(list("abc"), 300), "d": rng.choice(list("xy"), 300), "v": rng.normal(size=300)})
    pdf["v"] += pdf.c.map({"a": 0, "b": 2, "c": 4})
    df = spark.createDataFrame(pdf)
    grand = pdf.v.mean()
    g = pdf.groupby("c").v
    eta = np.sqrt((g.count() * (g.mean() - grand) ** 2).sum() / ((pdf.v - grand) ** 2).sum())
    assert abs(A.correlation_ratio(df, "v", "c").first()[0] - eta) < 1e-9
    t = pd.crosstab(pdf.c, pdf.d).values.astype(float)
    e = np.outer(t.sum(1), t.sum(0)) / t.sum()
    v = np.sqrt(((t - e) ** 2 / e).sum() / (t.sum() * (min(t.shape) - 1)))
    assert abs(A.cramers_v(df, "c", "d").first()[0] - v) < 1e-9
    want = g.mean().var() / pdf.v.var()
    assert abs(A.between_group_variance(df, "c", ["v"]).first().score - want) < 1e-4


def test_constant_sides_have_no_association(spark):
    df = spark.createDataFrame([("a", "x", 1.0)] * 4, "c string, d string, v double")
    assert A.cramers_v(df, "c", "d").first()[0] == 0
    assert A.correlation_ratio(df, "v", "c").first()[0] == 0


def test_target_association_ranks_and_notes(spark):
    rows = [(i, float(i), ["a", "b"][i >= 20], f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "y int, leak double, half string, text string")
    kinds = {"y": "numeric", "leak": "numeric", "half": "categorical", "text": "text"}
    r = A.target_association(df, "y", kinds)
    assert [x["feature"] for x in r["rankings"]] == ["leak", "half"]
    assert r["rankings"][0]["possible_leakage"] and "note" not in r
    assert "not supported" in A.target_association(df, "text", kinds)["note"]
    assert "Small sample" in A.target_association(df.limit(10), "y", kinds)["note"]


def test_distributed_quantiles_equal_pandas(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": rng.normal(size=501), "b": rng.integers(0, 4, 501).astype(float), "c": [np.nan] * 500 + [3.0]})
    got = {(r.name, r.q): r.value for r in exact_quantiles(spark.createDataFrame(pdf), ["a", "b", "c"]).collect()}
    assert len(got) == 9 and all(abs(v - pdf[c].quantile(q)) < 1e-12 for (c, q), v in got.items())


def test_prefix_counts_over_ranges(spark):
    rows = [("x", float(i), i % 3 + 1) for i in range(1000)]
    got = {r.v: r.before for r in prefix_counts(spark.createDataFrame(rows, "name string, v double, m long"), 7).collect()}
    before = 0
    for _, v, m in rows:
        assert got[v] == before
        before += m


@pytest.mark.parametrize("case", ["random", "heavy", "few"])
def test_kendall_over_blocks_equals_brute_force(spark, monkeypatch, case):
    monkeypatch.setattr(K, "BLOCK_PAIRS", 20)
    rng = np.random.default_rng(8)
    x, y = {
        "random": (rng.normal(size=700), rng.normal(size=700)),
        "heavy": (np.where(rng.random(700) < 0.4, 0.0, rng.normal(size=700)), np.where(rng.random(700) < 0.3, 1.0, rng.normal(size=700))),
        "few": (rng.integers(0, 30, 700) * 1.0, rng.integers(0, 40, 700) * 1.0),
    }[case]
    y = y + 0.5 * np.round(x)
    i, j = np.triu_indices(700, 1)
    a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
    want = (a * b).sum() / np.sqrt((a != 0).sum() * (b != 0).sum())
    got = K.correlations(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), method="kendall").first().r
    assert abs(got - want) < 1e-9


def test_quantiles_of_misplaced_brackets_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.normal(size=3001), "b": rng.integers(0, 5, 3001) * 1.0, "c": np.exp(rng.normal(size=3001) * 4)})
    df, at = spark.createDataFrame(pdf), (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    for accuracy in (50_000, 20):  # the second brackets roughly
        monkeypatch.setattr(R, "ACCURACY", accuracy)
        got = R.quantile_values(df, at)
        assert len(got) == 18 and all(abs(v - pdf[c].quantile(q)) <= 1e-9 * abs(v) for (c, q), v in got.items())
    assert R.quantile_values(df.where("a > 1e9"), at) == {}

import csv
import json
import zipfile

import numpy as np
import pandas as pd
import pytest

from vellumetry.functions.jsonable import to_jsonable
from vellumetry.operators.recommend import FeatureInsightAnalyzer, FeatureRecommender
from vellumetry.operators.scores import DataQualityScorer, MLReadinessScorer, QualityAnalyzer, grade, readiness_level
from vellumetry.plans.eda import EDAAnalyzer
from vellumetry.plans.eda_report import EDAReportGenerator
from vellumetry.plans.report import DatasetProfiler, ReportStructuringEngine
from vellumetry.sources import charts
from vellumetry.sources.errors import EmptyDatasetError, FileValidationError, UnsupportedFileTypeError
from vellumetry.sources.export import ReportExporter, ReportGenerator
from vellumetry.sources.loader import DatasetLoader, clean_header
from vellumetry.streaming.profile import windowed_profile


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(0)
    n = 60
    income = rng.normal(50, 10, n)
    rows = [(i, int(20 + i % 40), float(income[i]), float(income[i]), float(income[i] * 0.3 + rng.normal()), "ns"[i % 2], f"2024-01-{i % 28 + 1:02d}", None if i % 3 == 0 else f"note {i % 7}", "k") for i in range(n)]
    rows.append(rows[-1])
    return spark.createDataFrame(rows, "customer_id long, age long, income double, income_copy double, spend double, region string, signup string, notes string, constant string").cache()


def test_grades_and_levels():
    assert [grade(x) for x in (90, 89.99, 70, 60, 59)] == ["A", "B", "C", "D", "F"]
    assert [readiness_level(x) for x in (85, 70, 50, 49)] == ["Ready for ML", "Needs Minor Cleanup", "Needs Significant Cleanup", "Not Ready"]


def test_quality_scores(spark, people):
    r = DataQualityScorer().score(people)
    by = {d.name: d for d in r.dimensions}
    assert by["uniqueness"].detail == "1 duplicate row(s) out of 61." and by["uniqueness"].score == 98.36
    assert by["completeness"].detail.startswith("20 missing cell(s) out of 549")
    with pytest.raises(ValueError):
        DataQualityScorer({"completeness": 0.9})
    with pytest.raises(ValueError):
        DataQualityScorer().score(spark.createDataFrame([], "a int"))


def test_quality_issues(spark):
    rows = [("oops" if i == 0 else str(i), None if i < 4 else "x", " pad", None) for i in range(8)]
    r = QualityAnalyzer().analyze(spark.createDataFrame(rows, "num string, half string, pad string, none string"), {"num": "numeric", "half": "categorical", "pad": "categorical", "none": "text"})
    found = {(i["severity"], i["column"], i["type"]) for i in r["issues"]}
    assert found == {("high", "none", "all_missing"), ("high", "half", "high_missing"), ("medium", "half", "constant_column"), ("medium", "pad", "constant_column"), ("low", "pad", "whitespace"), ("medium", "num", "non_numeric_values"), ("medium", "num", "mixed_types")}
    assert r["dimensions"]["consistency"] == 0 and [i["severity"] for i in r["issues"]] == sorted((i["severity"] for i in r["issues"]), key=["high", "medium", "low"].index)


def test_recommendations(people, spark):
    r = FeatureRecommender().recommend(people, "region")
    assert {d["column"]: d["reason"] for d in r.drop_columns} == {"constant": "Constant column (no variance).", "income_copy": "Duplicate of column 'income'."}
    assert r.important_features and not r.importance_is_heuristic
    assert {s["column"] for s in r.scale_columns} == {"customer_id", "age", "income", "spend"}
    assert FeatureRecommender().recommend(people, "income").important_features[0]["column"] == "income_copy"
    assert FeatureRecommender().recommend(people).importance_is_heuristic
    with pytest.raises(KeyError):
        FeatureRecommender().recommend(people, "nope")
    with pytest.raises(ValueError):
        FeatureRecommender().recommend(people.limit(0))


def test_listed_twice_counts_twice(spark):
    df = spark.createDataFrame([(f"k{i}", f"k{i}") for i in range(30)], "a_id string, b_id string")
    r = MLReadinessScorer().score(df)
    assert "3 of 2 feature column(s)" in {d.name: d for d in r.dimensions}["feature_quality"].detail


def test_readiness(people):
    r = MLReadinessScorer().score(people, "region")
    assert 0 <= r.overall_score <= 100 and any("Deduplicate the 1" in x for x in r.recommendations)


def test_roles(people):
    r = FeatureInsightAnalyzer().analyze(people)
    roles = {f["name"]: f["role"] for f in r["features"]}
    assert roles["customer_id"] == "identifier" and roles["constant"] == "constant" and roles["income"] == "numeric"
    assert {(p["feature_a"], p["feature_b"]) for p in r["redundant_pairs"]} >= {("income", "income_copy")}


def test_eda_section(people):
    e = EDAAnalyzer().analyze(people)
    num = {n["name"]: n for n in e["numeric_summary"]}
    x = people.toPandas().income
    counts, edges = np.histogram(x, bins=10)
    assert num["income"]["histogram"]["counts"] == counts.tolist() and np.allclose(num["income"]["histogram"]["bin_edges"], edges)
    assert e["correlations"]["strong_pairs"][0]["correlation"] == 1.0 and len(e["correlations"]["matrix"]["columns"]) == 5


def test_profile_and_files(people, tmp_path):
    r = DatasetProfiler().profile(people.coalesce(1), "p.csv", indices=None)
    assert (r.row_count, r.duplicate_row_count, r.duplicate_row_indices) == (61, 1, [60])
    assert json.loads(ReportGenerator().to_json(r, tmp_path / "a" / "p.json").read_text())["missing_values"]["notes"]["count"] == 20
    rows = list(csv.reader(ReportGenerator().to_csv(r, tmp_path / "p.csv").open()))
    assert rows[0] == ["Dataset Summary"] and rows[7] == ["Column Name", "Data Type", "Missing Count", "Missing Percentage"]


def test_structured_report(people, tmp_path, spark):
    r = ReportStructuringEngine().build(people.coalesce(1), "people.csv", target="region")
    assert {s.status for s in r.sections.values()} == {"ok"} and r.sections["profiling"].data["duplicate_row_indices"] == [60]
    assert r.summary["key_findings"][0].startswith("Data quality score")
    files = ReportExporter().export_all(r, tmp_path)
    assert set(files) == {"html", "json", "csv"} and files["json"].name == "people_report.json"
    assert json.loads(files["json"].read_text())["sections"]["eda"]["title"] == "Exploratory Data Analysis"
    text = files["csv"].read_text(encoding="utf-8-sig")
    assert all(t in text for t in ("Key Findings", "Section Status", "Quality: Issues", "EDA: Strong Correlations", "Features: Association with Target 'region'"))
    with pytest.raises(ValueError):
        ReportExporter().export_all(r, tmp_path, ["pdf"])
    with pytest.raises(ValueError):
        ReportStructuringEngine().build(people, target="nope")
    with pytest.raises(ValueError):
        ReportStructuringEngine().build(spark.createDataFrame([], "a int"))


def test_a_failing_section_stands_alone(people):
    class Broken:
        def analyze(self, *_, **__):
            raise RuntimeError("boom")

    r = ReportStructuringEngine(quality=Broken()).build(people, indices=0)
    assert r.sections["quality"].error == "RuntimeError: boom" and r.sections["eda"].status == "ok"
    assert r.summary["key_findings"][-1] == "Section 'Data Quality' failed: RuntimeError: boom"


def test_names_are_escaped(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "`<script>alert(1)</script>` string, n int")
    html = ReportExporter().to_html(ReportStructuringEngine().build(df), tmp_path / "r.html").read_text()
    assert "<script>" not in html and "&lt;script&gt;" in html


def test_exploratory_report(people, tmp_path):
    df = people.select("income", "spend", "region", "notes")
    r = EDAReportGenerator(max_distribution_charts=1, max_categorical_charts=1).generate(df)
    assert [c["kind"] for c in r.charts] == ["distribution", "categorical", "correlation"]
    assert r.insights[0].startswith("Dataset has 61 rows and 4 columns")
    assert "<figure>" in r.to_html(tmp_path / "e.html").read_text() and json.loads(r.to_json(tmp_path / "e.json").read_text())


def test_charts(spark, tmp_path):
    df = spark.createDataFrame([(float(i), "x") for i in range(50)], "a double, b string")
    c = charts.DistributionPlotter().histogram(df, "a")
    assert c.save(tmp_path / "c.svg").read_text().startswith("<svg") and c.stats["count"] == 50
    assert charts.DistributionPlotter().density(df, "a").data_uri.startswith("data:image/svg")
    for bad, error in (("b", ValueError), ("nope", KeyError)):
        with pytest.raises(error):
            charts.DistributionPlotter().histogram(df, bad)
    with pytest.raises(ValueError):
        charts.category_chart(df.where("b = 'y'"), "b")


def test_jsonable():
    assert to_jsonable({1: float("nan"), "s": {3, 1}, "t": pd.Timestamp("2024-01-02"), "n": np.float64(2.5), "d": pd.Timedelta("1D")}) == {"1": None, "s": [1, 3], "t": "2024-01-02T00:00:00", "n": 2.5, "d": "1 days 00:00:00"}


def test_header_repair():
    assert clean_header(["a", "a", "", "a_1", "Unnamed: 4"])[0] == ["a", "a_1", "column_3", "a_1_1", "column_5"]
    assert len(clean_header(["a", "a", ""])[1]) == 2


def test_loading(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('id;name;signup_date;is_active;score;empty\n1;"An; a";2024-01-01;yes;1.5;\n2;NA;2024-01-02;no;2.5;\n;;;;;\n3;"two\nlines";2024-01-03;yes;x;\n')
    df, p = DatasetLoader(spark).load(f)
    assert (p.n_rows, p.n_columns, p.file_type) == (3, 5, "csv") and len(p.warnings) == 2
    kinds = {c.name: c.inferred_type for c in p.columns}
    assert kinds["id"] == "integer" and kinds["signup_date"] == "datetime" and kinds["is_active"] == "boolean"
    assert {r.name for r in df.collect()} == {"An; a", None, "two\nlines"}
    for name, content, error in (("x.json", "{}", UnsupportedFileTypeError), ("gone.csv", None, FileValidationError), ("zero.csv", "", FileValidationError), ("head.csv", "a,b\n", EmptyDatasetError), ("x.xls", "x", UnsupportedFileTypeError)):
        if content is not None:
            (tmp_path / name).write_text(content)
        with pytest.raises(error):
            DatasetLoader(spark).load(tmp_path / name)
    with pytest.raises(FileValidationError):
        DatasetLoader(spark, max_file_size_mb=1e-6).load(f)


def test_workbook(spark, tmp_path):
    f = tmp_path / "b.xlsx"
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = "".join(f'<row r="{i + 2}"><c r="A{i + 2}"><v>{i}</v></c><c r="B{i + 2}" t="s"><v>{i % 2}</v></c><c r="C{i + 2}" s="1"><v>{45292 + i}</v></c></row>' for i in range(3))
    head = "".join(f'<c r="{c}1" t="inlineStr"><is><t>{n}</t></is></c>' for c, n in zip("ABC", ("id", "category", "day")))
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>x</t></si><si><t>y</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1">{head}</row>{cells}</sheetData></worksheet>')
    df, p = DatasetLoader(spark).load(f)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("0", "x", "2024-01-01"), ("1", "y", "2024-01-02"), ("2", "x", "2024-01-03")]
    with pytest.raises(FileValidationError):
        DatasetLoader(spark).load(f, sheet_name="nope")


def test_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:20:00", None), ("2024-01-01 01:10:00", 5.0)], "ts string, v double").selectExpr("cast(ts as timestamp) ts", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = windowed_profile(stream, "ts", ["v"]).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.sql("select * from windows order by start").collect()
    assert [(r.row_count, r.v_missing, r.v_mean) for r in rows] == [(2, 1, 1.0), (1, 0, 5.0)]


@pytest.mark.parametrize("accuracy", [50_000, 4])
def test_profile_quartiles_equal_counted_ones(people, monkeypatch, accuracy):
    """Against Spark's own exact percentile; rough sketches may cost time, not accuracy."""
    from pyspark.sql import functions as F

    from vellumetry.functions import expressions as X
    from vellumetry.operators import profile as P
    from vellumetry.operators import ranks

    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    got = P.TableProfile(people).numeric
    assert got
    for c, r in got.items():
        v = people.select(X.finite(X.number(people, c)).alias("v")).where("v IS NOT NULL")
        q = v.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
        assert all(abs(r[k] - x) < 1e-9 for k, x in zip(("q1", "median", "q3"), q))
        reach = 1.5 * (q[2] - q[0])
        beyond = v.where((F.col("v") < q[0] - reach) | (F.col("v") > q[2] + reach)).count()
        assert r["outliers"] == (beyond if r["count"] >= 4 and reach else 0)


def test_rows_wider_than_the_header_are_refused(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(FileValidationError):
        DatasetLoader(spark).load(path)
    path.write_text('a,b\n1,"two\nlines, and a comma"\n3\n')
    df, profile = DatasetLoader(spark).load(path)
    assert [tuple(r) for r in df.collect()] == [("1", "two\nlines, and a comma"), ("3", None)] and profile.n_rows == 2


def test_samples_come_from_the_whole_column_and_a_mb_is_binary(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_text("a,b\n" + "1,\n" * 400 + "2,late\n")
    columns = {c.name: c.sample_values for c in DatasetLoader(spark).load(path)[1].columns}
    assert columns == {"a": ["1"] * 5, "b": ["late"]}
    path.write_text("a\n" + "x\n" * ((1 << 19) - 100))
    assert DatasetLoader(spark, max_file_size_mb=1).load(path)[1].n_rows > 0
    with pytest.raises(FileValidationError):
        DatasetLoader(spark, max_file_size_mb=0.9).load(path)

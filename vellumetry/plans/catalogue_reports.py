"""Registered queries of loading, reports, sections and recommendations, with the SQL that checks them."""

from __future__ import annotations

import csv
import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumetry.operators import association as A
from vellumetry.operators import columns as C
from vellumetry.operators import correlation, duplicates, scores
from vellumetry.operators import recommend as R
from vellumetry.operators.outliers import OutlierDetector
from vellumetry.operators.profile import TableProfile
from vellumetry.plans.catalogue import IQR, LABELLED, LABELLED_COLUMNS, LINEITEM_NUMBERS, PCT, labelled, numeric_sql, outlier_sql, query, rows_of, table
from vellumetry.plans.eda import EDAAnalyzer
from vellumetry.plans.report import DatasetProfiler, ReportStructuringEngine
from vellumetry.sources.export import ReportExporter, ReportGenerator
from vellumetry.sources.loader import DatasetLoader

GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END"
STRENGTH = "CASE WHEN {0} < 0.1 THEN 'negligible' WHEN {0} < 0.3 THEN 'weak' WHEN {0} < 0.5 THEN 'moderate' ELSE 'strong' END"


def rows(spark: SparkSession, found: list, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in found], schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that executors can write to: in spark.checkpoint.dir, or where that is unset on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='vellumetry-')}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{root.rstrip('/')}/catalogue-{uuid.uuid4().hex}")
    whole = hadoop.FileSystem.get(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


# ---- loading ------------------------------------------------------------------------

HEADER = "id, label ,label,,Unnamed: 5,void,score"
#: The file's cells, NA tokens read as null; every tenth customer is followed by a line without any value.
CELLS = """(SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS label, c_mktsegment AS label_1, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a "quoted", cell' ELSE 'é' || (c_custkey % 3) END AS column_4,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'yes' END AS column_5, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS score FROM customer)"""


def loaded(spark: SparkSession, sf: str) -> tuple[DataFrame, object]:
    """Customers written as one CSV file with a poor header, NA tokens, quotes and empty lines, and loaded."""
    k = F.col("c_custkey")
    cells = [k.cast("string"), F.col("c_name"), F.col("c_mktsegment"), F.when(k % 4 == 0, "NA").when(k % 4 == 1, '"a ""quoted"", cell"').otherwise(F.concat(F.lit("é"), (k % 3).cast("string"))), F.when(k % 5 == 0, "n/a").otherwise("yes"), F.lit(""), F.when(k % 6 == 0, "null").otherwise(F.col("c_nationkey").cast("string"))]
    lines = table(spark, sf, "customer").select(F.concat_ws(",", *cells).alias("value"), k)
    lines = lines.select(F.explode(F.when(k % 10 == 0, F.array("value", F.lit(",,NULL,,,,"))).otherwise(F.array("value"))).alias("value"))
    path = f"{shared_folder(spark)}.csv"
    spark.createDataFrame([(HEADER,)], "value string").union(lines).coalesce(1).write.text(path)
    return DatasetLoader(spark).load(path)


LOADED = ["id", "label", "label_1", "column_4", "column_5", "score"]


@query(f"SELECT * FROM {CELLS}")
def load_csv_rows(spark, sf):
    return loaded(spark, sf)[0]


@query(rows_of(LOADED, lambda c, i: f"""count(*) AS n_rows, count(*) - count({c}) AS null_count, {PCT.format(f'(count(*) - count({c}))', 'count(*)')} AS null_percentage, count(DISTINCT {c}) AS unique_count,
  CASE '{c}' WHEN 'id' THEN 'integer' WHEN 'score' THEN 'integer' WHEN 'column_5' THEN 'boolean' WHEN 'label' THEN 'text' ELSE 'categorical' END AS inferred_type, least(5, count({c})) AS samples""", CELLS))
def load_csv_profile(spark, sf):
    p = loaded(spark, sf)[1]
    found = [(c.name, i, p.n_rows, c.null_count, c.null_percentage, c.unique_count, c.inferred_type, len(c.sample_values)) for i, c in enumerate(p.columns)]
    return rows(spark, found, "name string, ordinal int, n_rows long, null_count long, null_percentage double, unique_count long, inferred_type string, samples long")


@query("""SELECT * FROM (VALUES ('Duplicate column name ''label'' renamed to ''label_1''.'), ('Column at position 4 had no header; auto-named ''column_4''.'), ('Column at position 5 had no header; auto-named ''column_5''.'), ('Dropped fully-empty column(s): [''void'']')) v(warning)
UNION ALL SELECT 'Dropped ' || count(*) || ' fully-empty row(s).' FROM customer WHERE c_custkey % 10 = 0""")
def load_csv_warnings(spark, sf):
    return rows(spark, [(w,) for w in loaded(spark, sf)[1].warnings], "warning string")


# ---- profiles and reports written as files ---------------------------------------------------

CUSTOMER_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


def csv_table(path: Path, title: list[str]) -> list[list[str]]:
    """The rows below the line ``title`` up to the next empty one, without the headers if the title is a name."""
    lines = list(csv.reader(path.read_text(encoding="utf-8-sig").splitlines()))
    at = lines.index(title) + (2 if len(title) == 1 else 1)
    end = next((i for i in range(at, len(lines)) if not lines[i]), len(lines))
    return lines[at:end]


@query(rows_of(list(CUSTOMER_TYPES), lambda c, i: f"'{CUSTOMER_TYPES[c]}' AS dtype, count(*) - count({c}) AS missing_count, {PCT.format(f'(count(*) - count({c}))', 'count(*)')} AS missing_percentage, (SELECT count(*) FROM customer) AS row_count, (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) FROM customer) AS duplicate_rows", "customer"))
def exported_profile(spark, sf):
    """The profile of customers, read back from its CSV and JSON files."""
    report, folder = DatasetProfiler().profile(table(spark, sf, "customer"), "customer"), Path(tempfile.mkdtemp(prefix="vellumetry-"))
    j = json.loads(ReportGenerator().to_json(report, folder / "p.json").read_text(encoding="utf-8"))
    columns = csv_table(ReportGenerator().to_csv(report, folder / "p.csv"), ["Column Name", "Data Type", "Missing Count", "Missing Percentage"])
    found = [(name, i, dtype if j["data_types"][name] == dtype else None, int(n), float(pct), j["row_count"], j["duplicate_row_count"]) for i, (name, dtype, n, pct) in enumerate(columns)]
    return rows(spark, found, "name string, ordinal int, dtype string, missing_count long, missing_percentage double, row_count long, duplicate_rows long")


ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
OUTLYING = " + ".join(f"(SELECT CAST(count(*) > 0 AND any_value(lo < hi) AND count(*) FILTER (WHERE {c} < lo OR {c} > hi) > 0.05 * count({c}) AS INT) FROM orders, ({IQR.replace('$t', 'orders').replace('$c', c)}))" for c in ORDER_NUMBERS)


def ratio_sql(number: str, category: str) -> str:
    return f"(SELECT sqrt(b / t) FROM (SELECT sum(n * (m - g) * (m - g)) AS b FROM (SELECT {category}, count(*) AS n, avg({number}) AS m FROM orders GROUP BY 1), (SELECT avg({number}) AS g FROM orders)), (SELECT var_pop({number}) * count(*) AS t FROM orders))"


CRAMER = """(SELECT sqrt(sum(n) * (sum(n * n / (r * c)) - 1) / (sum(n) * (least(count(DISTINCT x), count(DISTINCT y)) - 1))) FROM (
  SELECT *, sum(n) OVER (PARTITION BY x) AS r, sum(n) OVER (PARTITION BY y) AS c FROM (SELECT o_orderstatus AS x, o_orderpriority AS y, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2)))"""
ID_LIKE = "(SELECT count(DISTINCT {0}) >= 0.95 * count({0}) AND count({0}) >= 20 FROM orders)"
REPORT = f"""WITH f AS (SELECT count(*) AS n, {' + '.join(f'count(*) - count({c})' for c in [*ORDER_NUMBERS, 'o_orderstatus', 'o_orderdate', 'o_orderpriority'])} AS missing, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS dup, {OUTLYING} AS low FROM orders),
best AS (SELECT feature, round(a, 4) AS a FROM (SELECT 'o_orderkey' AS feature, 0 AS i, {ratio_sql('o_orderkey', 'o_orderstatus')} AS a WHERE NOT {ID_LIKE.format('o_orderkey')} UNION ALL SELECT 'o_custkey', 1, {ratio_sql('o_custkey', 'o_orderstatus')} WHERE NOT {ID_LIKE.format('o_custkey')}
  UNION ALL SELECT 'o_totalprice', 3, {ratio_sql('o_totalprice', 'o_orderstatus')} UNION ALL SELECT 'o_orderpriority', 5, {CRAMER}) ORDER BY round(a, 4) DESC, i LIMIT 1),
s AS (SELECT *, round(100 * (0.5 * (1 - CAST(missing AS DOUBLE) / (n * 6)) + 0.3 * (1 - CAST(dup AS DOUBLE) / n) + 0.2), 1) AS score FROM f)"""


@query(f"""{REPORT} SELECT n AS rows, 6 AS columns, score AS quality_score, {GRADE.format('score')} AS quality_grade, 0 AS high, CAST(dup > 0 AS BIGINT) AS medium, CAST(low AS BIGINT) AS low, dup AS duplicate_rows,
  round(CAST(missing AS DOUBLE) / (n * 6) * 100, 2) AS missing_cells_percentage, CASE WHEN {ID_LIKE.format('o_orderkey')} THEN 'o_orderkey' ELSE '' END || CASE WHEN {ID_LIKE.format('o_custkey')} THEN 'o_custkey' ELSE '' END AS excluded,
  (SELECT feature FROM best) AS best_feature, (SELECT a FROM best) AS best_association, 'ok ok ok ok' AS sections FROM s""")
def structured_report(spark, sf):
    """Headline figures of the whole report on orders, read back from its JSON file."""
    report = ReportStructuringEngine().build(table(spark, sf, "orders"), "orders", target="o_orderstatus")
    files = ReportExporter().export_all(report, tempfile.mkdtemp(prefix="vellumetry-"))
    d = json.loads(files["json"].read_text(encoding="utf-8"))
    s, features = d["summary"], d["sections"]["feature_insights"]["data"]
    best = features["target_analysis"]["rankings"][0]
    tally = [s["issue_counts"][k] for k in ("high", "medium", "low")]
    found = s["rows"], s["columns"], s["quality_score"], s["quality_grade"], *tally, s["duplicate_rows"], s["missing_cells_percentage"], "".join(features["exclude_candidates"]), best["feature"], best["association"], " ".join(s["section_status"].values())
    return rows(spark, [found], "rows long, columns long, quality_score double, quality_grade string, high long, medium long, low long, duplicate_rows long, missing_cells_percentage double, excluded string, best_feature string, best_association double, sections string")


@query(rows_of(list(CUSTOMER_TYPES), lambda c, i: f"""'{CUSTOMER_TYPES[c]}' AS dtype, CASE WHEN '{c}' IN ('c_custkey', 'c_nationkey', 'c_acctbal') THEN 'numeric' WHEN count(DISTINCT {c}) <= 50 THEN 'categorical' ELSE 'text' END AS inferred_type, count(*) - count({c}) AS missing_count, (SELECT count(*) FROM customer) AS row_count""", "customer"))
def exported_report_columns(spark, sf):
    """The columns' table of the report on customers, read back from its CSV file; the HTML file names each column too."""
    report = ReportStructuringEngine().build(table(spark, sf, "customer"), "customer")
    files = ReportExporter().export_all(report, tempfile.mkdtemp(prefix="vellumetry-"), ["CSV", "html"])
    html = files["html"].read_text(encoding="utf-8")
    found = [(name, i, dtype, kind, int(n), report.summary["rows"]) for i, (name, dtype, kind, n, _) in enumerate(csv_table(files["csv"], ["Profiling: Columns"])) if f"<td>{name}</td>" in html]
    return rows(spark, found, "name string, ordinal int, dtype string, inferred_type string, missing_count long, row_count long")


# ---- exploratory sections ------------------------------------------------------------------


def section(spark: SparkSession, sf: str, name: str, **options) -> dict:
    return EDAAnalyzer(**options).analyze(table(spark, sf, name))


FIELDS = ["count", "missing", "mean", "std", "min", "q1", "median", "q3", "max", "skew", "zeros", "outlier_count", "outlier_percentage"]


@query(f"""SELECT name, count, missing, round(mean, 4) AS mean, round(std, 4) AS std, min, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, max, round(skew, 4) AS skew, zeros, outlier_count, outlier_percentage
FROM ({numeric_sql(['p_size', 'p_retailprice'], 'part')}) JOIN (SELECT name AS n, outlier_count, outlier_percentage FROM ({outlier_sql(['p_size', 'p_retailprice'], 'part', IQR.replace('$t', 'part'))})) ON name = n""")
def eda_numeric_section(spark, sf):
    found = [c for c in section(spark, sf, "part")["numeric_summary"] if c["name"] != "p_partkey"]
    value = lambda c, k: round(c[k], 4) if k in ("mean", "std", "q1", "median", "q3", "skew") else c[k]
    df = rows(spark, [(c["name"], *(float(value(c, k)) for k in FIELDS)) for c in found], "name string, " + ", ".join(f"{k} double" for k in FIELDS))
    return df.withColumns({k: F.col(k).cast("long") for k in ("count", "missing", "zeros", "outlier_count")})


@query(" UNION ALL ".join(f"""SELECT name, rank, value, count, {PCT.format('count', 'present')} AS percentage, distinct_values FROM (SELECT '{c}' AS name, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INT) AS rank, {c} AS value, count(*) AS count, sum(count(*)) OVER () AS present, count(*) OVER () AS distinct_values FROM orders GROUP BY {c}) WHERE rank <= 3""" for c in ("o_orderstatus", "o_orderpriority")))
def eda_categorical_section(spark, sf):
    found = [(c["name"], i, t["value"], t["count"], t["percentage"], c["unique"]) for c in section(spark, sf, "orders", top_n=3)["categorical_summary"] for i, t in enumerate(c["top_values"], 1)]
    return rows(spark, found, "name string, rank int, value string, count long, percentage double, distinct_values long")


PAIRS = [(a, b) for i, a in enumerate(LINEITEM_NUMBERS) for b in LINEITEM_NUMBERS[i + 1 :]]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 3) AS correlation FROM lineitem" for a, b in PAIRS) + ") WHERE abs(correlation) >= 0.0005")
def eda_strong_pairs(spark, sf):
    from vellumetry.plans.eda import strong_pairs

    found = strong_pairs(table(spark, sf, "lineitem"), LINEITEM_NUMBERS, 0.0005)[0]
    return rows(spark, [(r["feature_a"], r["feature_b"], round(r["correlation"], 3)) for r in found], "feature_a string, feature_b string, correlation double").where("abs(correlation) >= 0.0005")


# ---- scores ---------------------------------------------------------------------------------

SPACED = " + ".join(f"CAST(count(*) FILTER (WHERE regexp_matches({c}, '^\\s|\\s$')) > 0 OR count(DISTINCT {c}) <= 1 AS INT)" for c in ("text", "lang", "source"))
CONSTANT = " + ".join(f"CAST(count(DISTINCT {c}) <= 1 AS INT)" for c in ("doc_id", "n_chars", "quality", "toxic"))


@query(f"""WITH f AS (SELECT count(*) AS n, {' + '.join(f'count(*) - count({c})' for c in LABELLED_COLUMNS)} AS missing, (SELECT count(*) FROM (SELECT DISTINCT * FROM {LABELLED})) AS u, {SPACED} + {CONSTANT} AS bad FROM {LABELLED}),
s AS (SELECT 1 - CAST(missing AS DOUBLE) / (n * {len(LABELLED_COLUMNS)}) AS c, 1 - CAST(n - u AS DOUBLE) / n AS q, 1 - CAST(bad AS DOUBLE) / {len(LABELLED_COLUMNS)} AS e FROM f), r AS (SELECT *, round(100 * (0.5 * c + 0.3 * q + 0.2 * e), 1) AS score FROM s)
SELECT score, {GRADE.format('score')} AS grade, round(c * 100, 2) AS completeness, round(q * 100, 2) AS uniqueness, round(e * 100, 2) AS consistency FROM r""")
def quality_score_b(spark, sf):
    r = scores.QualityAnalyzer().analyze(labelled(spark, sf))
    return rows(spark, [(r["score"], r["grade"], *r["dimensions"].values())], "score double, grade string, completeness double, uniqueness double, consistency double")


UNIQUE_DATE = "(SELECT CAST(count(DISTINCT o_orderdate) = count(*) OR count(DISTINCT o_orderdate) <= 1 AS INT) + CAST(count(DISTINCT o_orderpriority) <= 1 AS INT) + CAST(count(DISTINCT o_totalprice) <= 1 AS INT) + CAST(count(DISTINCT o_custkey) <= 1 AS INT) + CAST(count(DISTINCT o_orderkey) <= 1 AS INT) FROM orders)"
HIT = " OR ".join(f"{c} < {c}_b.lo OR {c} > {c}_b.hi" for c in ORDER_NUMBERS)
READY = f"""WITH f AS (SELECT count(*) AS n, {' + '.join(f'count(*) - count({c})' for c in [*ORDER_NUMBERS, 'o_orderstatus', 'o_orderdate', 'o_orderpriority'])} AS missing, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS dup, {UNIQUE_DATE} AS drops FROM orders),
o AS (SELECT count(*) FILTER (WHERE {HIT}) AS hit FROM orders, {', '.join(f'({IQR.replace("$t", "orders").replace("$c", c)}) {c}_b' for c in ORDER_NUMBERS)}),
d AS (SELECT *, round((1 - CAST(missing AS DOUBLE) / (n * 6)) * 100, 2) AS complete, round((0.7 * (1 - CAST(drops AS DOUBLE) / 5) + 0.3 * least(1.0, n / 50.0)) * 100, 2) AS features, round(greatest(0, 0.4 * (1 - CAST(dup AS DOUBLE) / n) + 0.4 * (1 - CAST(hit AS DOUBLE) / n) + 0.2) * 100, 2) AS clean FROM f, o)"""


@query(f"""{READY} SELECT 'completeness' AS dimension, CAST(complete AS DOUBLE) AS score, CAST(0.40 AS DOUBLE) AS weight FROM d UNION ALL SELECT 'feature_quality', features, 0.35 FROM d UNION ALL SELECT 'noise_level', clean, 0.25 FROM d""")
def ml_readiness_dimensions(spark, sf):
    r = scores.MLReadinessScorer().score(table(spark, sf, "orders"), "o_orderstatus")
    return rows(spark, [(d.name, d.score, d.weight) for d in r.dimensions], "dimension string, score double, weight double")


ADVISED = "SELECT CASE WHEN {0} THEN {1} END AS advice FROM d"


@query(f"""{READY}, a AS ({' UNION ALL '.join(ADVISED.format(*x) for x in (
    ('complete < 90', "'Impute or drop columns with heavy missing data before training - ' || missing || ' missing cell(s) out of ' || (n * 6) || '.'"),
    ('n < 50', "'Low rows-per-feature ratio (' || n || ' rows, 5 features) - consider gathering more data or reducing dimensionality.'"),
    ('dup > 0', "'Deduplicate the ' || dup || ' exact duplicate row(s) before training.'"),
    ('hit > 0', "hit || ' row(s) contain outlier values - consider robust scaling, winsorizing, or reviewing them for data entry errors.'")))})
SELECT level, advice FROM (SELECT CASE WHEN t >= 85 THEN 'Ready for ML' WHEN t >= 70 THEN 'Needs Minor Cleanup' WHEN t >= 50 THEN 'Needs Significant Cleanup' ELSE 'Not Ready' END AS level FROM (SELECT 0.4 * complete + 0.35 * features + 0.25 * clean AS t FROM d)),
(SELECT advice FROM a WHERE advice IS NOT NULL UNION ALL SELECT 'Dataset looks ready for ML - no major issues detected.' WHERE NOT EXISTS (SELECT 1 FROM a WHERE advice IS NOT NULL))""")
def ml_readiness_advice(spark, sf):
    r = scores.MLReadinessScorer().score(table(spark, sf, "orders"), "o_orderstatus")
    return rows(spark, [(r.readiness_level, text) for text in r.recommendations], "level string, advice string")


@query(f"""SELECT feature, round(a, 4) AS association, method, {STRENGTH.format('a')} AS strength, a >= 0.95 AS possible_leakage FROM (
  SELECT 'o_orderkey' AS feature, abs(corr(o_orderkey, o_totalprice)) AS a, '|Pearson r|' AS method FROM orders UNION ALL SELECT 'o_custkey', abs(corr(o_custkey, o_totalprice)), '|Pearson r|' FROM orders
  UNION ALL SELECT 'o_orderstatus', {ratio_sql('o_totalprice', 'o_orderstatus')}, 'correlation ratio' UNION ALL SELECT 'o_orderpriority', {ratio_sql('o_totalprice', 'o_orderpriority')}, 'correlation ratio')""")
def target_association(spark, sf):
    o = table(spark, sf, "orders")
    found = A.target_association(o, "o_totalprice", C.resolve_kinds(o))["rankings"]
    return rows(spark, [(r["feature"], r["association"], r["method"], r["strength"], r["possible_leakage"]) for r in found], "feature string, association double, method string, strength string, possible_leakage boolean")


DIRTY = """(SELECT * FROM (SELECT CAST(NULL AS VARCHAR) AS void, 'x' AS same, CASE WHEN k % 3 = 0 THEN ' pad' || (k % 7) ELSE 'pad' || (k % 7) END AS pad, CASE WHEN k % 50 = 7 THEN 'oops' ELSE CAST(k AS VARCHAR) END AS num, CASE WHEN k % 100 = 9 THEN CAST('inf' AS DOUBLE) ELSE k + 0.5 END AS wide,
  CASE WHEN k % 16 = 0 THEN 1000000.0 ELSE k % 10 + 0.25 END AS spike, CASE WHEN k % 20 = 3 THEN 'someday' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day, CASE WHEN k % 10 < 4 THEN NULL ELSE k END AS gap, CASE WHEN k % 10 < 6 THEN NULL ELSE k END AS hole, CASE WHEN k % 10 < 1 THEN NULL ELSE k END AS nick, CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE 'w' || k END AS blend
  FROM (SELECT o_orderkey AS k, o_orderdate FROM orders UNION ALL SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 10 = 1)))"""


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Orders made to break every rule, with copies of some rows."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    day = F.when(k % 20 == 3, "someday").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    return o.union(o.where(k % 10 == 1)).select(
        F.lit(None).cast("string").alias("void"), F.lit("x").alias("same"), F.concat(F.when(k % 3 == 0, " pad").otherwise("pad"), (k % 7).cast("string")).alias("pad"), F.when(k % 50 == 7, "oops").otherwise(k.cast("string")).alias("num"),
        F.when(k % 100 == 9, float("inf")).otherwise(k + 0.5).alias("wide"), F.when(k % 16 == 0, 1000000.0).otherwise(k % 10 + 0.25).alias("spike"), day.alias("day"),
        *(F.when(k % 10 < least, None).otherwise(k).alias(name) for name, least in (("gap", 4), ("hole", 6), ("nick", 1))), F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.lit("w"), k.cast("string"))).alias("blend"),
    )


@query(f"""WITH t AS (SELECT * FROM {DIRTY}), q AS ({IQR.replace('$t', 't').replace('$c', 'spike')}), i AS (
  SELECT 'high' AS severity, 'void' AS "column", 'all_missing' AS type, count(*) AS count FROM t
  UNION ALL SELECT 'medium', 'same', 'constant_column', NULL UNION ALL SELECT 'low', 'pad', 'whitespace', count(*) FILTER (WHERE pad LIKE ' %') FROM t
  UNION ALL SELECT 'medium', 'num', 'mixed_types', NULL UNION ALL SELECT 'medium', 'num', 'non_numeric_values', count(*) FILTER (WHERE num = 'oops') FROM t
  UNION ALL SELECT 'medium', 'wide', 'infinite_values', count(*) FILTER (WHERE isinf(wide)) FROM t
  UNION ALL SELECT 'low', 'spike', 'outliers', count(*) FILTER (WHERE spike < lo OR spike > hi) FROM t, q
  UNION ALL SELECT 'medium', 'day', 'mixed_types', NULL UNION ALL SELECT 'medium', 'day', 'unparseable_dates', count(*) FILTER (WHERE day = 'someday') FROM t
  UNION ALL SELECT 'medium', 'gap', 'high_missing', count(*) - count(gap) FROM t UNION ALL SELECT 'high', 'hole', 'high_missing', count(*) - count(hole) FROM t UNION ALL SELECT 'low', 'nick', 'some_missing', count(*) - count(nick) FROM t
  UNION ALL SELECT 'medium', 'blend', 'mixed_types', NULL UNION ALL SELECT CASE WHEN d > 0.05 * n THEN 'high' ELSE 'medium' END, NULL, 'duplicate_rows', d FROM (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS d FROM t))
SELECT * FROM i""")
def issue_rules(spark, sf):
    """Every rule of score B on a table that breaks them all."""
    d = dirty(spark, sf)
    p = TableProfile(d, {r.name: r.inferred_type for r in C.infer_column_types(d).collect()})
    found = scores.QualityAnalyzer().analyze(d, profile=p)["issues"]
    return rows(spark, [(i["severity"], i["column"], i["type"], i["count"]) for i in found], "severity string, column string, type string, count long")


# ---- detectors and recommendations --------------------------------------------------------------


@query(f"""SELECT 'iqr' AS method, count(*) AS total, sum(CAST(l_extendedprice > hi OR l_extendedprice < lo AS BIGINT)) AS outliers, sum(CASE WHEN l_extendedprice > hi OR l_extendedprice < lo THEN l_orderkey ELSE 0 END)::BIGINT AS keys FROM lineitem, ({IQR.replace('$t', 'lineitem').replace('$c', 'l_extendedprice')})""")
def outlier_detector_positions(spark, sf):
    """The rows at the reported positions, told by the sum of their keys."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    r = OutlierDetector().detect(l, columns=["l_extendedprice"], indices=True)
    c = r.columns[0]
    at = next(v for v in vars(c).values() if isinstance(v, list))
    placed = duplicates.with_row_id(l).join(spark.createDataFrame([(i,) for i in at], "p long"), F.col(duplicates.ROW_ID) == F.col("p"))
    return placed.agg(F.lit("iqr").alias("method"), F.lit(r.row_count).cast("long").alias("total"), F.count("*").alias("outliers"), F.coalesce(F.sum("l_orderkey"), F.lit(0)).alias("keys"))


@query("""WITH r AS (SELECT 'c_custkey' AS name, count(DISTINCT c_custkey) AS u, count(c_custkey) AS n, 'numeric' AS kind, bool_and(c_custkey % 1 = 0) AS countable FROM customer
UNION ALL SELECT 'c_name', count(DISTINCT c_name), count(c_name), CASE WHEN count(DISTINCT c_name) <= 50 THEN 'categorical' ELSE 'text' END, true FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey), count(c_nationkey), 'numeric', true FROM customer
UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal), count(c_acctbal), 'numeric', bool_and(c_acctbal % 1 = 0) FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), count(c_mktsegment), CASE WHEN count(DISTINCT c_mktsegment) <= 50 THEN 'categorical' ELSE 'text' END, true FROM customer)
SELECT name, CASE WHEN n = 0 THEN 'empty' WHEN u <= 1 THEN 'constant' WHEN countable AND n >= 20 AND u >= 0.95 * n THEN 'identifier' ELSE kind END AS role FROM r""")
def feature_roles(spark, sf):
    found = R.FeatureInsightAnalyzer().analyze(table(spark, sf, "customer"))["features"]
    return rows(spark, [(f["name"], f["role"]) for f in found], "name string, role string")


@query(f"""SELECT 'c_custkey' AS name, 'Exclude from model inputs; keep only as a key / row label.' AS advice FROM customer HAVING count(*) >= 20 UNION ALL SELECT 'c_name', 'Exclude from model inputs; keep only as a key / row label.' FROM customer HAVING count(*) >= 20
UNION ALL SELECT 'c_mktsegment', CASE WHEN count(DISTINCT c_mktsegment) <= 10 THEN 'Low cardinality: one-hot encode.' ELSE count(DISTINCT c_mktsegment) || ' levels: group rare levels, then target/frequency encode.' END FROM customer
UNION ALL SELECT name, CASE WHEN abs(skew) < 1 AND outlier_percentage <= 5 THEN 'Standardize for linear / distance-based models.' ELSE '?' END FROM ({numeric_sql(['c_nationkey', 'c_acctbal'], 'customer')}) JOIN (SELECT name AS o, outlier_percentage FROM ({outlier_sql(['c_nationkey', 'c_acctbal'], 'customer', IQR.replace('$t', 'customer'))})) ON name = o""")
def feature_advice(spark, sf):
    found = R.FeatureInsightAnalyzer().analyze(table(spark, sf, "customer"))["features"]
    return rows(spark, [(f["name"], " | ".join(f["recommendations"])) for f in found], "name string, advice string")


@query(" UNION ALL ".join(f"SELECT '{a}' AS kept, '{b}' AS dropped FROM (SELECT *, p_size AS size_copy, CASE WHEN p_partkey = 1 THEN 0 ELSE p_size END AS near FROM part) HAVING bool_and({a} IS NOT DISTINCT FROM {b})" for a, b in (("p_size", "size_copy"), ("p_size", "near"), ("p_partkey", "p_size"), ("p_brand", "p_type"))))
def duplicate_columns(spark, sf):
    p = table(spark, sf, "part").withColumn("size_copy", F.col("p_size")).withColumn("near", F.when(F.col("p_partkey") == 1, 0).otherwise(F.col("p_size")))
    return rows(spark, duplicates.duplicate_columns(p), "kept string, dropped string")


@query("""WITH p AS (SELECT *, p_size AS size_copy, p_size * 2 AS twice FROM part) SELECT 'p_size' AS kept_column, 'size_copy' AS dropped_column, 'exact_duplicate' AS reason FROM p HAVING bool_and(p_size = size_copy)
UNION ALL SELECT 'p_size', 'twice', 'near_duplicate_correlation' FROM p HAVING abs(corr(p_size, twice)) >= 0.95 AND NOT bool_and(p_size = twice) UNION ALL SELECT 'p_partkey', 'p_size', 'near_duplicate_correlation' FROM p HAVING abs(corr(p_partkey, p_size)) >= 0.95
UNION ALL SELECT 'p_partkey', 'p_retailprice', 'near_duplicate_correlation' FROM p HAVING abs(corr(p_partkey, p_retailprice)) >= 0.95 UNION ALL SELECT 'p_size', 'p_retailprice', 'near_duplicate_correlation' FROM p HAVING abs(corr(p_size, p_retailprice)) >= 0.95 AND abs(corr(p_partkey, p_retailprice)) < 0.95""")
def redundant_features(spark, sf):
    p = table(spark, sf, "part").withColumns({"size_copy": F.col("p_size"), "twice": F.col("p_size") * 2})
    found = correlation.FeatureCorrelationAnalyzer().analyze(p).redundant_columns
    return rows(spark, [(r["kept_column"], r["dropped_column"], r["reason"]) for r in found], "kept_column string, dropped_column string, reason string")


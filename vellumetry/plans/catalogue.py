"""Registered queries of the profiling engine with the SQL that checks them.

The fixture tables have no nulls, copies or junk; queries that need such input
derive it with expressions that both engines share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumetry.operators import association as A
from vellumetry.operators import columns as C
from vellumetry.operators import correlation, duplicates, frequency, outliers, scores
from vellumetry.operators import recommend as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- inputs -----------------------------------------------------------------

LABELLED = "(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels; most have none."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels").withColumnRenamed("doc_id", "l_id")
    return d.join(l, d.doc_id == l.l_id, "left").select(*LABELLED_COLUMNS)


JUNK = """(SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 7 = 0 THEN 'oops' WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN ' 12 ' ELSE CAST(o_orderkey AS VARCHAR) END AS num,
  CASE WHEN o_orderkey % 5 = 0 THEN 'not a date' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day,
  CASE WHEN o_orderkey % 3 = 0 THEN ' ' || o_orderpriority ELSE o_orderpriority END AS pri,
  CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS flag FROM orders)"""


def junk(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as text with words among numbers, broken dates and stray spaces."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("id"),
        F.when(k % 7 == 0, "oops").when(k % 11 == 0, None).when(k % 13 == 0, " 12 ").otherwise(k.cast("string")).alias("num"),
        F.when(k % 5 == 0, "not a date").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("day"),
        F.when(k % 3 == 0, F.concat(F.lit(" "), "o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("pri"),
        F.when(k % 2 == 0, "yes").otherwise("no").alias("flag"),
    )


def rows_of(columns: list[str], select: Callable[[str, int], str], source: str) -> str:
    """UNION ALL of a row a column."""
    return " UNION ALL ".join(f"SELECT '{c}' AS name, {i} AS ordinal, {select(c, i)} FROM {source} t" for i, c in enumerate(columns))


PCT = "coalesce(round(CAST({0} AS DOUBLE) / nullif({1}, 0) * 100, 2), 0)"
LINEITEM_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LABELLED_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


# ---- missing values and profiles ----------------------------------------------

MISSING = f"""SELECT *, CASE WHEN null_percentage <= 0 THEN 'none' WHEN null_percentage <= 5 THEN 'low' WHEN null_percentage <= 20 THEN 'moderate' WHEN null_percentage <= 50 THEN 'high' ELSE 'critical' END AS severity
FROM ({rows_of(LABELLED_COLUMNS, lambda c, i: f"count(*) - count({c}) AS null_count, {PCT.format(f'(count(*) - count({c}))', 'count(*)')} AS null_percentage", LABELLED)})"""


@query(MISSING)
def missing_value_report(spark, sf):
    return C.missing_values(labelled(spark, sf))


@query(f"SELECT * FROM ({MISSING}) WHERE severity IN ('high', 'critical')")
def worst_columns(spark, sf):
    return C.worst_columns(C.missing_values(labelled(spark, sf)))


@query(f"""SELECT *, {PCT.format('missing_cells', '(row_count * column_count)')} AS missing_percentage FROM (
  SELECT count(*) AS row_count, {len(LABELLED_COLUMNS)} AS column_count, {' + '.join(f'count(*) - count({c})' for c in LABELLED_COLUMNS)} AS missing_cells FROM {LABELLED})""")
def dataset_profile_summary(spark, sf):
    return C.dataset_summary(labelled(spark, sf))


ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@query(rows_of(list(ORDER_TYPES), lambda c, i: f"'{ORDER_TYPES[c]}' AS dtype, count(*) - count({c}) AS missing_count, {PCT.format(f'(count(*) - count({c}))', 'count(*)')} AS missing_percentage, count(DISTINCT {c}) AS unique_count", "orders"))
def column_profile(spark, sf):
    return C.column_profile(table(spark, sf, "orders"))


NUM = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
EVIDENCE = rows_of(
    ["num", "day", "pri", "flag"],
    lambda c, i: rf"""count(*) AS rows, count({c}) AS present, count(*) FILTER (WHERE regexp_matches({c}, {NUM})) AS numbers,
  count(*) FILTER (WHERE regexp_matches({c}, {NUM}) AND TRY_CAST(trim({c}) AS DOUBLE) % 1 = 0) AS integers,
  count(*) FILTER (WHERE lower(trim({c})) IN ('true','false','yes','no','y','n','0','1','t','f')) AS booleans,
  count(*) FILTER (WHERE regexp_matches({c}, '^\d{{4}}-\d{{2}}-\d{{2}}$') OR (regexp_matches({c}, '^\d{{4}}$') AND TRY_CAST({c} AS INT) BETWEEN 1678 AND 2261)) AS dates,
  count(DISTINCT {c}) AS unique_count""",
    JUNK,
)


@query(f"""SELECT name, ordinal, CASE WHEN present = 0 THEN 'unknown' WHEN booleans >= 0.98 * present THEN 'boolean' WHEN numbers >= 0.95 * present THEN CASE WHEN integers = numbers THEN 'integer' ELSE 'float' END
  WHEN dates >= 0.9 * present THEN 'datetime' WHEN (unique_count <= 50 AND unique_count <= 0.25 * present) OR unique_count <= 10 THEN 'categorical' ELSE 'text' END AS inferred_type FROM ({EVIDENCE})""")
def infer_column_types(spark, sf):
    return C.infer_column_types(junk(spark, sf).drop("id"))


@query(f"""SELECT name, ordinal, CASE WHEN dates >= 0.9 * present THEN 'datetime' WHEN numbers >= 0.95 * present THEN 'numerical' WHEN unique_count <= 50 AND unique_count <= 0.2 * present THEN 'categorical' ELSE 'text' END AS category,
  CASE WHEN dates >= 0.9 * present THEN 'Over 90% of sampled values parse as dates.' WHEN numbers >= 0.95 * present THEN 'Over 95% of values parse as numbers.'
    WHEN unique_count <= 50 AND unique_count <= 0.2 * present THEN 'Only ' || unique_count || ' distinct values (' || printf('%.1f', unique_count / CAST(present AS DOUBLE) * 100) || '% of rows) - a repeating label set.'
    ELSE 'High-cardinality free-form string values.' END AS reason FROM ({EVIDENCE})""")
def classify_columns(spark, sf):
    return C.classify_columns(junk(spark, sf).drop("id"))


@query("""SELECT * FROM (VALUES ('event_id', 0, 'numeric'), ('ts', 1, 'datetime'), ('user_id', 2, 'numeric')) v(name, ordinal, kind)
UNION ALL SELECT 'event_type', 3, CASE WHEN count(DISTINCT event_type) <= 50 THEN 'categorical' ELSE 'text' END FROM events
UNION ALL SELECT 'value', 4, 'numeric'
UNION ALL SELECT 'props', 5, CASE WHEN count(DISTINCT props) <= 50 THEN 'categorical' ELSE 'text' END FROM events""")
def resolve_kinds(spark, sf):
    return C.column_kinds(table(spark, sf, "events"))


def numeric_sql(columns: list[str], source: str) -> str:
    return rows_of(
        columns,
        lambda c, i: f"count({c}) AS count, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3, CAST(max({c}) AS DOUBLE) AS max, round(skewness({c}), 6) AS skew, count(*) FILTER (WHERE {c} = 0) AS zeros",
        source,
    )


@query(numeric_sql(LINEITEM_NUMBERS, "lineitem"))
def numeric_summary(spark, sf):
    return C.numeric_summary(table(spark, sf, "lineitem"), LINEITEM_NUMBERS).withColumns({c: F.round(c, 6) for c in ("mean", "std", "skew")})


@query(numeric_sql(["value"], "events"))
def numeric_summary_events(spark, sf):
    return C.numeric_summary(table(spark, sf, "events"), ["value"]).withColumns({c: F.round(c, 6) for c in ("mean", "std", "skew")})


@query(rows_of(["ts"], lambda c, i: f"count({c}) AS count, count(*) - count({c}) AS missing, min({c}) AS min, max({c}) AS max, datesub('day', min({c}), max({c})) AS span_days", "events"))
def datetime_summary(spark, sf):
    return C.datetime_summary(table(spark, sf, "events"), ["ts"])


@query(rows_of(["text", "lang"], lambda c, i: f"count({c}) AS count, round(avg(length({c})), 2) AS avg_length", "documents"))
def text_length_summary(spark, sf):
    return C.text_lengths(table(spark, sf, "documents"), ["text", "lang"])


@query(rows_of(["num", "day", "pri"], lambda c, i: rf"""count(*) FILTER (WHERE regexp_matches({c}, '^\s|\s$')) AS whitespace, count(*) FILTER (WHERE NOT regexp_matches({c}, {NUM})) AS non_numeric,
  count(*) FILTER (WHERE NOT (regexp_matches({c}, '^\d{{4}}-\d{{2}}-\d{{2}}$') OR (regexp_matches({c}, '^\d{{4}}$') AND TRY_CAST({c} AS INT) BETWEEN 1678 AND 2261))) AS unparseable_dates""", JUNK))
def issue_counts(spark, sf):
    return C.lexical_issues(junk(spark, sf), ["num", "day", "pri"]).select("name", "ordinal", "whitespace", "non_numeric", "unparseable_dates")


@query(rows_of(["x"], lambda c, i: "count(*) FILTER (WHERE isinf(x)) AS infinite", "(SELECT CASE WHEN event_id % 9 = 0 THEN CAST('inf' AS DOUBLE) ELSE value END AS x FROM events)"))
def infinite_counts(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 9 == 0, float("inf")).otherwise(F.col("value")).alias("x"))
    return C.lexical_issues(e, ["x"]).select("name", "ordinal", "infinite")


@query(f"""SELECT name, ordinal, round(CASE WHEN present = 0 THEN 1 WHEN numbers >= 0.5 * present THEN numbers / CAST(present AS DOUBLE) WHEN dates >= 0.5 * present THEN dates / CAST(present AS DOUBLE) ELSE 1 END, 6) AS consistency FROM ({EVIDENCE})""")
def column_consistency(spark, sf):
    return C.consistency(junk(spark, sf).drop("id")).withColumn("consistency", F.round("consistency", 6))


# ---- frequencies -----------------------------------------------------------------


def counts_sql(columns: list[str], source: str, n: int) -> str:
    parts = []
    for c in columns:
        parts.append(f"""SELECT '{c}' AS name, CAST(rank AS INT) AS rank, category, count, {PCT.format('count', f'(SELECT count(*) FROM {source})')} AS percentage FROM (
  SELECT least(rn, {n + 1}) AS rank, CASE WHEN least(rn, {n + 1}) > {n} THEN 'Other' ELSE min(v) END AS category, CAST(sum(n) AS BIGINT) AS count FROM (
    SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS rn FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1)) GROUP BY 1)""")
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


@query(counts_sql(["p_brand", "p_type"], "part", 10))
def category_top_n_other(spark, sf):
    return frequency.category_counts(table(spark, sf, "part"), ["p_brand", "p_type"], 10)


@query(counts_sql(["event_type"], "events", 10))
def categorical_summary_all(spark, sf):
    e = table(spark, sf, "events")
    return frequency.category_counts(e, frequency.categorical_columns(e), 10)


def top_sql(columns: list[str], source: str, n: int) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS name, CAST(row_number() OVER (ORDER BY n DESC, v) AS INT) AS rank, v AS value, n AS count, {PCT.format('n', 'sum(n) OVER ()')} AS percentage FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1)) WHERE rank <= {n}" for c in columns
    )


@query(top_sql(["o_orderstatus", "o_orderpriority"], "orders", 3))
def top_values(spark, sf):
    return frequency.top_values(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], 3)


def histogram_sql(c: str, source: str, bins: int) -> str:
    return f"""WITH b AS (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, (CAST(max({c}) AS DOUBLE) - min({c})) / {bins} AS w, count({c}) AS total FROM {source}),
k AS (SELECT least(CAST(floor(({c} - lo) / w) AS INT), {bins - 1}) AS k, count(*) AS n FROM {source}, b WHERE {c} IS NOT NULL GROUP BY 1)
SELECT CAST(s.bin AS INT) AS bin, round(lo + s.bin * w, 6) AS lower, round(lo + (s.bin + 1) * w, 6) AS upper, coalesce(n, 0) AS count, round(coalesce(n, 0) / (total * w), 9) AS density
FROM b, (SELECT unnest(range({bins})) AS bin) s LEFT JOIN k ON s.bin = k.k"""


def _rounded(h: DataFrame) -> DataFrame:
    return h.withColumns({"lower": F.round("lower", 6), "upper": F.round("upper", 6), "density": F.round("density", 9)})


@query(histogram_sql("l_extendedprice", "lineitem", 10))
def histogram_10(spark, sf):
    return _rounded(frequency.histogram(table(spark, sf, "lineitem"), "l_extendedprice"))


@query(histogram_sql("value", "events", 30))
def histogram_30(spark, sf):
    return _rounded(frequency.histogram(table(spark, sf, "events"), "value", bins=30))


@query("SELECT count(value) AS count, round(avg(value), 6) AS mean, median(value) AS median, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max FROM events")
def distribution_stats(spark, sf):
    return frequency.distribution_stats(table(spark, sf, "events"), "value").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query()
def density_curve(spark, sf):
    return frequency.density_curve(table(spark, sf, "events"), "value")


# ---- duplicates --------------------------------------------------------------------


@query("WITH t AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 10 = 0) SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicate_rows FROM t")
def duplicate_rows_full(spark, sf):
    """Of all columns; the table has no copies, so rows are repeated."""
    l = table(spark, sf, "lineitem")
    return duplicates.duplicate_count(l.unionAll(l.where(F.col("l_orderkey") % 10 == 0)))


@query("SELECT count(*) - count(DISTINCT text) AS duplicate_rows FROM documents")
def duplicate_rows_partial(spark, sf):
    return duplicates.duplicate_count(table(spark, sf, "documents"), ["text"])


@query("SELECT doc_id AS row_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def duplicate_row_ids(spark, sf):
    """The id serves as the row's position."""
    return duplicates.duplicate_rows(table(spark, sf, "documents").withColumn(duplicates.ROW_ID, F.col("doc_id")), ["text"])


@query("SELECT name FROM (SELECT 'c_custkey' AS name, count(DISTINCT c_custkey) < count(*) AS ok FROM customer UNION ALL SELECT 'c_name', count(DISTINCT c_name) < count(*) FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) < count(*) FROM customer UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal) < count(*) FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) < count(*) FROM customer) WHERE ok")
def duplicate_auto_subset(spark, sf):
    return spark.createDataFrame([(c,) for c in duplicates.auto_subset(table(spark, sf, "customer"))], "name string")


# ---- outliers ----------------------------------------------------------------------


def outlier_sql(columns: list[str], source: str, bounds: str) -> str:
    return rows_of(
        columns,
        lambda c, i: f"count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outlier_count, {PCT.format(f'count(*) FILTER (WHERE {c} < lo OR {c} > hi)', f'count({c})')} AS outlier_percentage, round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound",
        "{}",
    ).replace("{}", f"(SELECT * FROM {source}, ({bounds}))") if len(columns) == 1 else " UNION ALL ".join(outlier_sql([c], source, bounds.replace("$c", c)).replace("0 AS ordinal", f"{i} AS ordinal") for i, c in enumerate(columns))


IQR = "SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont($c, 0.25) AS q1, quantile_cont($c, 0.75) AS q3 FROM $t)"
Z = "SELECT avg($c) - 3 * stddev_samp($c) AS lo, avg($c) + 3 * stddev_samp($c) AS hi FROM $t"


@query(outlier_sql(LINEITEM_NUMBERS, "lineitem", IQR.replace("$t", "lineitem")))
def outliers_iqr(spark, sf):
    return outliers.outliers(table(spark, sf, "lineitem"), LINEITEM_NUMBERS)


@query(outlier_sql(["value"], "events", Z.replace("$t", "events").replace("$c", "value")))
def outliers_zscore(spark, sf):
    return outliers.outliers(table(spark, sf, "events"), ["value"], "zscore")


@query(f"SELECT count(*) FILTER (WHERE l_extendedprice < a.lo OR l_extendedprice > a.hi OR l_quantity < b.lo OR l_quantity > b.hi) AS outlier_rows, count(*) AS row_count FROM lineitem, ({IQR.replace('$t', 'lineitem').replace('$c', 'l_extendedprice')}) a, ({IQR.replace('$t', 'lineitem').replace('$c', 'l_quantity')}) b")
def outlier_rows_any(spark, sf):
    return outliers.outlier_rows(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"])


# ---- correlation -------------------------------------------------------------------

PART = "(SELECT p_partkey, p_size, p_retailprice, p_size * 2 + CASE WHEN p_partkey % 10 = 0 THEN 5 ELSE 0 END AS near FROM part)"
PART_COLUMNS = ["p_partkey", "p_size", "p_retailprice", "near"]


def part_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").withColumn("near", F.col("p_size") * 2 + F.when(F.col("p_partkey") % 10 == 0, 5).otherwise(0))


def pairs_sql(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{columns[i]}' AS column_a, '{columns[j]}' AS column_b, {i} AS i, {j} AS j, corr({columns[i]}, {columns[j]}) AS r FROM {source}" for i in range(len(columns)) for j in range(i + 1, len(columns)))


@query(f"SELECT column_a, column_b, i, j, round(r, 6) AS r FROM ({pairs_sql(PART_COLUMNS, PART)})")
def correlation_pearson(spark, sf):
    return correlation.correlations(part_numbers(spark, sf)).withColumn("r", F.round("r", 6))


@query(f"SELECT column_a, column_b, round(r, 4) AS correlation, CASE WHEN abs(round(r, 4)) >= 0.7 THEN 'strong' ELSE 'moderate' END AS strength, i, j FROM ({pairs_sql(PART_COLUMNS, PART)}) WHERE abs(round(r, 4)) >= 0.4")
def notable_pairs(spark, sf):
    return correlation.notable_pairs(correlation.correlations(part_numbers(spark, sf)))


@query("""SELECT 'l_quantity' AS column_a, 'l_extendedprice' AS column_b, 0 AS i, 1 AS j, round(corr(x, y), 6) AS r FROM (
  SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem)""")
def correlation_spearman(spark, sf):
    return correlation.correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], "spearman").withColumn("r", F.round("r", 6))


@query("""WITH p AS (SELECT l_quantity AS x, l_discount AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT sum(sign(b.y - a.y) * a.n * b.n) AS s FROM p a JOIN p b ON a.x < b.x),
tx AS (SELECT sum(m * (m - 1) / 2) AS t FROM (SELECT sum(n) AS m FROM p GROUP BY x)), ty AS (SELECT sum(m * (m - 1) / 2) AS t FROM (SELECT sum(n) AS m FROM p GROUP BY y)), t AS (SELECT sum(n) * (sum(n) - 1) / 2 AS t FROM p)
SELECT 'l_quantity' AS column_a, 'l_discount' AS column_b, 0 AS i, 1 AS j, round(s.s / sqrt((t.t - tx.t) * (t.t - ty.t)), 6) AS r FROM s, tx, ty, t""")
def correlation_kendall(spark, sf):
    return correlation.correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "kendall").withColumn("r", F.round("r", 6))


# ---- association -------------------------------------------------------------------


@query("SELECT round(sqrt(b / t), 6) AS association FROM (SELECT sum(n * (m - g) * (m - g)) AS b FROM (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1), (SELECT avg(o_totalprice) AS g FROM orders)), (SELECT var_pop(o_totalprice) * count(*) AS t FROM orders)")
def correlation_ratio(spark, sf):
    return A.correlation_ratio(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority").withColumn("association", F.round("association", 6))


@query("""WITH o AS (SELECT o_orderstatus AS x, o_orderpriority AS y, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2),
e AS (SELECT *, sum(n) OVER (PARTITION BY x) AS r, sum(n) OVER (PARTITION BY y) AS c FROM o)
SELECT round(sqrt(sum(n) * (sum(n * n / (r * c)) - 1) / (sum(n) * (least(count(DISTINCT x), count(DISTINCT y)) - 1))), 6) AS association FROM e""")
def cramers_v(spark, sf):
    return A.cramers_v(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").withColumn("association", F.round("association", 6))


@query("SELECT o_orderstatus AS x, o_orderpriority AS y, count(*) AS n FROM orders GROUP BY 1, 2")
def contingency_table(spark, sf):
    return A.contingency(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query(f"SELECT name, ordinal, round(r, 4) AS r, round(abs(r), 4) AS score FROM ({rows_of(['l_quantity', 'l_discount', 'l_tax'], lambda c, i: f'corr({c}, l_extendedprice) AS r', 'lineitem')})")
def abs_corr_target(spark, sf):
    return A.abs_correlation_with(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, {i} AS ordinal, round((SELECT var_samp(m) FROM (SELECT avg({c}) AS m FROM lineitem GROUP BY l_returnflag)) / (SELECT var_samp({c}) FROM lineitem), 4) AS score" for i, c in enumerate(["l_quantity", "l_extendedprice"])))
def between_group_variance(spark, sf):
    return A.between_group_variance(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"])


@query(rows_of(LINEITEM_NUMBERS, lambda c, i: f"round(stddev_samp({c}) / abs(avg({c})), 4) AS score", "lineitem"))
def coefficient_of_variation(spark, sf):
    return A.coefficients_of_variation(table(spark, sf, "lineitem"), LINEITEM_NUMBERS)


# ---- scores and recommendations -----------------------------------------------------


@query(f"""WITH t AS (SELECT * FROM {LABELLED}), q AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3, quantile_cont(doc_id, 0.25) AS d1, quantile_cont(doc_id, 0.75) AS d3 FROM t),
v AS (SELECT count(*) FILTER (WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1) OR doc_id < d1 - 1.5 * (d3 - d1) OR doc_id > d3 + 1.5 * (d3 - d1)) AS o FROM t, q)
SELECT 'completeness' AS dimension, round(100 - CAST({' + '.join(f'count(*) - count({c})' for c in LABELLED_COLUMNS)} AS DOUBLE) / (count(*) * {len(LABELLED_COLUMNS)}) * 100, 2) AS score, CAST(0.35 AS DOUBLE) AS weight FROM t
UNION ALL SELECT 'uniqueness', round((1 - CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS DOUBLE) / count(*)) * 100, 2), CAST(0.25 AS DOUBLE) FROM t
UNION ALL SELECT 'validity', round((1 - CAST((SELECT o FROM v) AS DOUBLE) / count(*)) * 100, 2), CAST(0.20 AS DOUBLE) FROM t
UNION ALL SELECT 'consistency', CAST(100 AS DOUBLE), CAST(0.20 AS DOUBLE)""")
def quality_score_a(spark, sf):
    return scores.quality_dimensions(labelled(spark, sf))


def _issues(spark: SparkSession, df: DataFrame) -> DataFrame:
    found = scores.QualityAnalyzer().analyze(df)["issues"]
    return spark.createDataFrame([(i["severity"], i["column"], i["type"], i["count"]) for i in found], "severity string, column string, type string, count long")


@query(f"""SELECT 'high' AS severity, name AS "column", 'high_missing' AS type, null_count AS count FROM ({MISSING}) WHERE null_percentage >= 50
UNION ALL SELECT 'low', 'n_chars', 'outliers', o FROM (SELECT count(*) FILTER (WHERE n_chars < lo OR n_chars > hi) AS o, count(*) AS n FROM documents, ({IQR.replace('$t', 'documents').replace('$c', 'n_chars')})) WHERE o > 0.05 * n
UNION ALL SELECT 'low', name, 'outliers', o FROM (SELECT 'toxic' AS name, count(*) FILTER (WHERE toxic < lo OR toxic > hi) AS o, count(*) AS n, any_value(lo < hi) AS ok FROM labels, ({IQR.replace('$t', 'labels').replace('$c', 'toxic')})) WHERE ok AND o > 0.05 * n
UNION ALL SELECT 'low', name, 'outliers', o FROM (SELECT 'quality' AS name, count(*) FILTER (WHERE quality < lo OR quality > hi) AS o, count(*) AS n, any_value(lo < hi) AS ok FROM labels, ({IQR.replace('$t', 'labels').replace('$c', 'quality')})) WHERE ok AND o > 0.05 * n""")
def quality_issues(spark, sf):
    return _issues(spark, labelled(spark, sf))


@query("""SELECT * FROM (VALUES ('o_orderkey', 'drop', 'All values unique - looks like an identifier column.')) v("column", action, detail)""")
def feature_drop_recommendations(spark, sf):
    """With the key as text, so that it is told as an identifier by its values."""
    o = table(spark, sf, "orders").withColumn("o_orderkey", F.concat(F.lit("k"), F.col("o_orderkey").cast("string")))
    found = R.FeatureRecommender().recommend(o, "o_orderstatus").drop_columns
    return spark.createDataFrame([(r["column"], "drop", r["reason"]) for r in found], "column string, action string, detail string")


@query("""SELECT 'o_orderstatus' AS "column", CASE WHEN count(DISTINCT o_orderstatus) <= 2 THEN 'binary' WHEN count(DISTINCT o_orderstatus) <= 10 THEN 'one_hot' ELSE 'ordinal' END AS strategy, count(DISTINCT o_orderstatus) AS unique_count FROM orders
UNION ALL SELECT 'o_orderpriority', CASE WHEN count(DISTINCT o_orderpriority) <= 2 THEN 'binary' WHEN count(DISTINCT o_orderpriority) <= 10 THEN 'one_hot' ELSE 'ordinal' END, count(DISTINCT o_orderpriority) FROM orders""")
def feature_encode_recommendations(spark, sf):
    found = R.FeatureRecommender().recommend(table(spark, sf, "orders")).encode_columns
    return spark.createDataFrame([(r["column"], r["strategy"], r["unique_count"]) for r in found], "column string, strategy string, unique_count long")


@query(f"""SELECT name AS "column", CASE WHEN outlier_percentage >= 5 THEN 'robust' WHEN abs(skew) >= 1 THEN 'min_max' ELSE 'standard' END AS strategy
FROM ({outlier_sql([*LINEITEM_KEYS, *LINEITEM_NUMBERS], 'lineitem', IQR.replace('$t', 'lineitem'))}) o JOIN (SELECT name AS n, skew FROM ({numeric_sql([*LINEITEM_KEYS, *LINEITEM_NUMBERS], 'lineitem')})) s ON o.name = s.n""")
def feature_scale_recommendations(spark, sf):
    found = R.FeatureRecommender().recommend(table(spark, sf, "lineitem")).scale_columns
    return spark.createDataFrame([(r["column"], r["strategy"]) for r in found], "column string, strategy string")


__all__ = ["QUERIES", "SQL"]

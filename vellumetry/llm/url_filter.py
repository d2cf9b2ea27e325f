"""URL filter: rules first, then a path-template tree.

A url's host and path are judged by the longest rule that fits. Other urls are
judged by their template. The tree of a host's paths is generalised from the
root down, one level at a time:

1. digits and long hexadecimal runs are variable by their form;
2. a child of a node with more than ``max_children`` children that holds less
   than ``heavy_share`` of the node's pages is variable: it becomes ``*``;
3. siblings with at least ``min_labels`` labels each are put in order of their
   purity, and each is compared with the one before it (two-sided test of two
   proportions); runs that neither differ nor lie on both sides of
   ``max_purity`` become one branch ``~N``;
4. a node with fewer labels below it than ``min_labels`` is not split: all that
   lies below it is one branch ``**``.

A branch with enough labels has its own purity: its share of bad labels,
smoothed towards the corpus' as if ``smoothing`` more labels had that share. A
branch with fewer has its parent's. A template is bad if its purity reaches
``max_purity``: with a small share in the corpus it takes 4 bad labels of 4, 4
of 5, 6 of 8 and so on, so few labels alone don't reject a template.

Rows are aggregated to distinct paths per host before anything else; what is
repeated per level is the part of that table that is still split, written to
the shared storage. Joins deal the rows of a key out. Only DataFrame functions
are used.

Null urls and urls without ``://`` have an empty host and path. Null ids and
repeated rows are ordinary rows. Null labels don't count. Without labels every
url that no rule judges is allowed. Paths may be of any depth. An empty table
gives no rows. Columns other than id and url are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumetry.llm.common import materialise, read_table, salted_join

#: (rule, verdict); a rule is a host, then a path's beginning.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
SALTS = 8
#: Levels of paths that the SQL follows; deeper branches in it need fewer labels than are looked for.
SQL_DEPTH = 8


@dataclass(frozen=True)
class Params:
    max_children: int = 20
    heavy_share: float = 0.05
    #: labels below which a branch isn't told from its parent
    min_labels: int = 4
    #: 95 % quantile of chi squared with one degree of freedom
    different: float = 3.841458820694124
    smoothing: float = 4.0
    max_purity: float = 0.5


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(slash + p))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """A path's segments without their variable runs."""
    parts = F.split(F.regexp_replace(path, "[0-9A-Fa-f]{16,}|[0-9]+", "#"), "/", -1)
    return F.slice(parts, 2, F.size(parts))


def _names(at: DataFrame, base: float, p: Params) -> DataFrame:
    """host, template and child of open nodes -> the child's name in its template, the purity there, and whether that is split."""
    child = at.where("child IS NOT NULL").groupBy("host", "template", "child").agg(F.max("purity").alias("purity"), *(F.sum(c).alias(c) for c in ("n", "labelled", "bad")))
    node = child.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("n").alias("total"), F.sum("labelled").alias("below"))
    rare = (F.col("children") > p.max_children) & (F.col("n") < p.heavy_share * F.col("total"))
    general = F.when(F.col("below") < p.min_labels, F.lit("**")).when(rare, F.lit("*")).otherwise(F.col("child"))
    child = salted_join(child, node, ["host", "template"], SALTS, F.col("child")).withColumn("general", general)
    # at most max_children + 1 / heavy_share branches a node from here on
    branch = child.groupBy("host", "template", "general").agg(F.max("purity").alias("purity"), F.max("below").alias("below"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    branch = branch.withColumn("known", (F.col("labelled") >= p.min_labels) & (F.col("below") >= p.min_labels))
    own = F.try_divide("bad", "labelled")
    branch = branch.withColumn("alone", (F.col("bad") + p.smoothing * base) / (F.col("labelled") + p.smoothing))
    order = Window.partitionBy("host", "template", "known").orderBy("alone", "general")
    l, b = F.lag("labelled").over(order), F.lag("bad").over(order)
    other_side = (F.col("alone") >= p.max_purity) != (F.lag("alone").over(order) >= p.max_purity)
    pooled = (F.col("bad") + b) / (F.col("labelled") + l)
    spread = pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), l))
    off = own - F.try_divide(b, l)
    branch = branch.withColumn("differs", F.when(F.col("known"), F.coalesce(F.try_divide(off * off, spread) > p.different, F.lit(False)) | F.coalesce(other_side, F.lit(False))).otherwise(False).cast("int"))
    branch = branch.withColumn("run", F.sum("differs").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    alike = F.count("*").over(Window.partitionBy("host", "template", "known", "run"))
    name = F.when(F.col("known") & (alike > 1), F.concat(F.lit("~"), F.col("run").cast("string"))).otherwise(F.col("general"))
    branch = branch.withColumn("name", name)
    of = Window.partitionBy("host", "template", "name")
    labelled, bad = F.sum("labelled").over(of), F.sum("bad").over(of)
    purity = F.when(F.col("known"), (bad + p.smoothing * base) / (labelled + p.smoothing)).otherwise(F.col("purity"))
    branch = branch.select("host", "template", "general", "name", purity.alias("child_purity"), (F.col("general") != "**").alias("split"))
    return salted_join(child.select("host", "template", "child", "general"), branch, ["host", "template", "general"], SALTS, F.col("child")).drop("general")


def templates(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """pages (host, segs, bad: 1, 0 or null) -> host, segs, template and its purity."""
    tree = pages.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = materialise(tree, "tree")
    every = tree.agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l")).first()
    base = (every.b or 0) / every.l if every.l else 0.0
    host = tree.groupBy("host").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l"))
    host = host.select("host", F.when(F.col("l") >= p.min_labels, (F.col("b") + p.smoothing * base) / (F.col("l") + p.smoothing)).otherwise(F.lit(base)).alias("purity"))
    tree = salted_join(tree, host, ["host"], SALTS, F.col("segs")).withColumns({"template": F.lit(""), "open": F.lit(True)})
    tree, done, level = materialise(tree, "tree"), [], 0
    while not tree.where("open").isEmpty():
        done.append(tree.where("NOT open"))
        at = tree.where("open").withColumn("child", F.get("segs", F.lit(level)))
        at = salted_join(at, _names(at, base, p), ["host", "template", "child"], SALTS, F.col("segs"), "left")
        new = {
            "template": F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name")),
            "purity": F.coalesce("child_purity", "purity"),
            "open": F.coalesce(F.col("split") & (F.size("segs") > level + 1), F.lit(False)),
        }
        tree = materialise(at.withColumns(new).select(*tree.columns), "tree")
        level += 1
    for part in done:
        tree = tree.union(part)
    return tree.select("host", "segs", "template", "purity")


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, p: Params = Params(), *, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """pages with labels (key, bad), joined by the last number of a path -> page_id, host, path, rule, verdict, template, purity."""
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumns({"segs": segments(F.col("path")), "number": F.expr(r"try_cast(nullif(regexp_extract(path, '([0-9]+)[^0-9]*$', 1), '') AS long)")})
    labels = labels.where("key IS NOT NULL").groupBy("key").agg(F.max("bad").alias("bad")).withColumnRenamed("key", "number")
    labelled = salted_join(rows, labels, ["number"], SALTS, F.xxhash64("page_id", "path"), "left")
    scored = templates(labelled, p)
    judged = salted_join(rows, scored, ["host", "segs"], 4 * SALTS, F.xxhash64("page_id", "path"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    by_rule = F.lit(None).cast("string")
    for r, v in rules:
        by_rule = F.when(F.col("rule") == r, F.lit(v)).otherwise(by_rule)
    judged = judged.withColumn("rule", rule)
    by_tree = F.when(F.col("purity") >= p.max_purity, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_tree).alias("verdict"), "template", "purity")


def document_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality, toxic) -> key, bad: 1 for a document of low quality or toxic, else 0."""
    return labels.select(F.col("doc_id").alias("key"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a page's path is the document that it shows; that one's label is the page's."""
    return judge_urls(read_table(spark, sf_dir, "pages"), document_labels(read_table(spark, sf_dir, "labels")))


def op6_sql(p: Params = Params()) -> str:
    host = r"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = r"coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    rule = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{q}') THEN '{r}'" for r, h, q in sorted(((r, *r.split("/", 1)) for r, _ in RULES), key=lambda x: -len(x[0])))
    k = f"{p.smoothing}::DOUBLE"
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES)
    sql = f"""
WITH lab AS (SELECT doc_id AS key, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
u AS (SELECT page_id, {host} AS host, {path} AS path FROM pages),
w AS (SELECT *, string_split(regexp_replace(path, '[0-9A-Fa-f]{{16,}}|[0-9]+', '#', 'g'), '/')[2:] AS segs, TRY_CAST(nullif(regexp_extract(path, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) AS number FROM u),
x AS (SELECT host, segs, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM w LEFT JOIN lab ON number = key GROUP BY 1, 2),
e AS (SELECT coalesce(CAST(sum(bad) AS DOUBLE) / nullif(sum(labelled), 0), 0) AS base FROM x),
t0 AS (SELECT *, '' AS template, true AS open, CASE WHEN sum(labelled) OVER o >= {p.min_labels} THEN (sum(bad) OVER o + {k} * (SELECT base FROM e)) / (sum(labelled) OVER o + {k}) ELSE (SELECT base FROM e) END AS purity
  FROM x WINDOW o AS (PARTITION BY host))"""
    for i in range(SQL_DEPTH):
        sql += f""",
a{i} AS (SELECT *, CASE WHEN open THEN segs[{i + 1}] END AS child FROM t{i}),
c{i} AS (SELECT host, template, child, max(purity) AS purity, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM a{i} WHERE child IS NOT NULL GROUP BY 1, 2, 3),
g{i} AS (SELECT *, sum(labelled) OVER o AS below, CASE WHEN sum(labelled) OVER o < {p.min_labels} THEN '**' WHEN count(*) OVER o > {p.max_children} AND n < {p.heavy_share}::DOUBLE * sum(n) OVER o THEN '*' ELSE child END AS general FROM c{i} WINDOW o AS (PARTITION BY host, template)),
b{i} AS (SELECT host, template, general, max(purity) AS purity, CAST(sum(labelled) AS DOUBLE) AS labelled, CAST(sum(bad) AS DOUBLE) AS bad, sum(labelled) >= {p.min_labels} AND max(below) >= {p.min_labels} AS known FROM g{i} GROUP BY 1, 2, 3),
q{i} AS (SELECT *, (bad + {k} * (SELECT base FROM e)) / (labelled + {k}) AS alone FROM b{i}),
o{i} AS (SELECT *, lag(labelled) OVER o AS l, lag(bad) OVER o AS b, lag(alone) OVER o AS before FROM q{i} WINDOW o AS (PARTITION BY host, template, known ORDER BY alone, general)),
p{i} AS (SELECT *, (bad + b) / (labelled + l) AS pooled FROM o{i}),
d{i} AS (SELECT *, CASE WHEN known AND (bad / nullif(labelled, 0) - b / nullif(l, 0)) ^ 2 / nullif(pooled * (1 - pooled) * (1 / nullif(labelled, 0) + 1 / nullif(l, 0)), 0) > {p.different}::DOUBLE THEN 1 WHEN known AND (alone >= {p.max_purity}) <> (before >= {p.max_purity}) THEN 1 ELSE 0 END AS differs FROM p{i}),
r{i} AS (SELECT *, sum(differs) OVER (PARTITION BY host, template, known ORDER BY alone, general ROWS UNBOUNDED PRECEDING) AS run FROM d{i}),
m{i} AS (SELECT *, CASE WHEN known AND count(*) OVER (PARTITION BY host, template, known, run) > 1 THEN '~' || CAST(CAST(run AS BIGINT) AS VARCHAR) ELSE general END AS name FROM r{i}),
n{i} AS (SELECT *, CASE WHEN known THEN (sum(bad) OVER o + {k} * (SELECT base FROM e)) / (sum(labelled) OVER o + {k}) ELSE purity END AS child_purity FROM m{i} WINDOW o AS (PARTITION BY host, template, name)),
t{i + 1} AS (SELECT a.host, a.segs, a.n, a.labelled, a.bad, CASE WHEN m.name IS NULL THEN a.template ELSE a.template || '/' || m.name END AS template,
    coalesce(m.general <> '**' AND len(a.segs) > {i + 1}, false) AS open, coalesce(m.child_purity, a.purity) AS purity
  FROM a{i} a LEFT JOIN g{i} g ON a.host = g.host AND a.template = g.template AND a.child = g.child LEFT JOIN n{i} m ON g.host = m.host AND g.template = m.template AND g.general = m.general)"""
    return (
        sql
        + f""",
y AS (SELECT page_id, host, path, segs, CASE {rule} END AS rule FROM w)
SELECT page_id, y.host, path, rule, CASE {verdict} WHEN purity >= {p.max_purity} THEN 'block' ELSE 'allow' END AS verdict, template, purity
FROM y JOIN t{SQL_DEPTH} t ON y.host = t.host AND y.segs = t.segs
"""
    )

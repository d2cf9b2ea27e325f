"""Mixing sources to target weights.

Sources in code-point order, null last, take the weights in turn. Their
targets share the corpus' size by weight; a target stops at ``MOST_EPOCHS``
times its source's size and the excess is shared anew by weight until none is
above (``targets``, over the sources' totals).

Each document gets a hash-random key of its id and text. The keys' range is cut
into buckets, so (source, bucket, key) is a range sort within each source whose
parts are bounded however many rows a source has. Totals of the buckets are
summed up in a small table, which names the bucket in which a source's budget
ends; only that bucket of each source is sorted by key and summed up row by
row. So every other document is taken or left by its bucket alone, and no text
is shuffled. A source repeats whole epochs and cuts the last one at its budget:
the document at the cut is taken if most of it lies before the cut. So a
source's words differ from its target by half a document at most.

Null texts have size 0 and are taken 0 times, as are empty ones. Null sources
are one source, the last. Null and repeated ids are ordinary rows. Rows of
equal id and text share a key; if the cut falls among them, as many of them are
taken as fit. A source without words has target 0. An empty table gives no
rows. Only DataFrame functions are used on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vellumetry.llm.common import WORD, fresh, materialise, n_words, read_table

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
#: Rows of a bucket, about, if all sources were one.
BUCKET_ROWS = 8192
#: Keys are integers below this.
KEYS = 1 << 60


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> source, source_size, target, a row a source.

    Sources are ordered by their ratio of cap to weight. If those before one are
    capped, the rest has a level (words a unit of weight); sources whose ratio
    is below the final level are capped.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("i") % len(weights) + 1)
    rows = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = rows.withColumn("weight", weight).withColumn("ratio", most * F.col("source_size").cast("double") / F.col("weight"))
    order, every = Window.orderBy("ratio", "i"), Window.partitionBy()
    before = F.coalesce(F.sum(most * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(every) - before) / upto)
    rows = rows.withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every))
    target = F.when(F.col("ratio") < F.col("level"), most * F.col("source_size").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return rows.select("source", "source_size", target.alias("target"))


def random_key(doc_id: Column, text: Column, seed: int = 0) -> Column:
    """Below 2**60, from the first 15 hexadecimal digits of an md5."""
    of = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}:"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(of.cast("binary")), 1, 15), 16, 10).cast("long")


class Mix:
    """What each source takes: ``plan`` has a row a source, ``light`` the documents' source, id, size, key and bucket."""

    def __init__(self, df: DataFrame, weights: tuple, most: int, seed: int, doc_id: str, text: str, source: str):
        self.columns = {"source": F.col(f"`{source}`").cast("string"), "id": F.col(f"`{doc_id}`"), "key": random_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), seed)}
        light = materialise(df.select(*(c.alias(k) for k, c in self.columns.items()), n_words(F.col(f"`{text}`")).alias("size")), "mix")
        self.buckets = max(1, light.count() // BUCKET_ROWS)
        self.light = light.withColumn("bucket", self.bucket(F.col("key")))
        totals = materialise(self.light.groupBy("source", "bucket").agg(F.sum("size").alias("total")), "totals")
        sources = targets(totals.groupBy("source").agg(F.sum("total").alias("source_size")), weights, most)
        epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
        sources = sources.withColumn("epochs", epochs).withColumn("cut", F.col("target") - F.col("epochs") * F.col("source_size"))
        sources = materialise(sources.withColumnsRenamed({"source": "s"}), "targets")
        # the first bucket that ends beyond the cut
        upto = F.sum("total").over(Window.partitionBy("source").orderBy("bucket"))
        ends = totals.withColumn("end", upto).join(sources, F.col("source").eqNullSafe(F.col("s")))
        first = ends.where("end > cut").groupBy("s").agg(F.min_by(F.struct("bucket", (F.col("end") - F.col("total")).alias("start"), "cut"), "bucket").alias("at"))
        first = materialise(first.select("s", F.col("at.bucket").alias("b"), F.col("at.start").alias("start"), F.col("at.cut").alias("cut")), "cuts")
        # its rows, those of equal id and text together, up to the first that isn't taken whole
        inside = self.light.join(first, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        inside = inside.groupBy("s", "b", "start", "cut", "key", "id", "size").agg(F.count("*").alias("n"))
        order = Window.partitionBy("s").orderBy("key", F.col("id").asc_nulls_first())
        sofar = F.coalesce(F.sum(F.col("n") * F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        fit = F.ceil(F.try_divide(F.col("cut") - F.col("start") - F.col("before"), F.col("size")) - 0.5)
        fit = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(fit, F.col("n")))).otherwise(F.col("n"))
        inside = inside.withColumn("before", sofar).withColumn("fit", fit)
        cut = inside.where("fit < n").groupBy("s").agg(F.min(F.struct("key", "id", "fit", "n")).alias("at"))
        cut = first.select("s", "b").join(cut.withColumnsRenamed({"s": "z"}), F.col("s").eqNullSafe(F.col("z")), "left").drop("z")
        cut = cut.withColumnsRenamed({"s": "z"})
        plan = sources.drop("cut").join(cut, F.col("s").eqNullSafe(F.col("z")), "left").drop("z")
        self.plan = materialise(plan, "plan")

    def bucket(self, key: Column) -> Column:
        return F.floor(key / F.lit(KEYS / self.buckets)).cast("long")

    def placed(self, rows: DataFrame, source: str, key: str, id_: str) -> DataFrame:
        """``rows`` with the plan's columns (renamed ``names``) and the number of times a row is taken.

        The plan is a row a source; Spark broadcasts it if its files are small enough.
        """
        names = fresh(rows.columns, *self.plan.columns, "times", "nth")
        new = dict(zip([*self.plan.columns, "times", "nth"], names))
        col = {k: F.col(v) for k, v in new.items()}
        rows = rows.join(self.plan.withColumnsRenamed(new), F.col(source).eqNullSafe(col["s"]))
        bucket, at = self.bucket(F.col(key)), col["at"]
        own, cut = F.struct(F.col(key).alias("key"), F.col(id_).alias("id")), F.struct(at["key"].alias("key"), at["id"].alias("id"))
        inside = bucket == col["b"]
        last = col["b"].isNull() | (bucket < col["b"]) | (inside & (at.isNull() | (own < cut)))
        shared = F.coalesce(inside & own.eqNullSafe(cut) & (at["fit"] > 0), F.lit(False))
        once = F.coalesce(last, F.lit(False)).cast("long")
        alone = rows.where(~shared).withColumn(new["times"], col["epochs"] + once)
        if self.plan.where("at.fit > 0").isEmpty():  # no cut falls among equal rows
            return alone, new
        nth = Window.partitionBy(new["s"]).orderBy(*(F.col(f"`{f.name}`") for f in rows.schema if isinstance(f.dataType, T.AtomicType)))
        tied = rows.where(shared).withColumn(new["nth"], F.row_number().over(nth))
        tied = tied.withColumn(new["times"], col["epochs"] + (col["nth"] <= at["fit"]).cast("long")).drop(new["nth"])
        return alone.unionByName(tied), new


def mix(df: DataFrame, weights: tuple = WEIGHTS, *, most: int = MOST_EPOCHS, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document."""
    m = Mix(df, weights, most, seed, doc_id, text, source)
    rows, new = m.placed(m.light, "source", "key", "id")
    return rows.select(F.col("id").alias("doc_id"), "size", F.col(new["source_size"]).alias("source_size"), F.col(new["target"]).alias("target"), (F.col(new["times"]) * F.col("size")).alias("taken"))


def mixed_documents(df: DataFrame, weights: tuple = WEIGHTS, *, most: int = MOST_EPOCHS, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each document with all its columns, as often as it is taken."""
    m = Mix(df, weights, most, seed, doc_id, text, source)
    names = dict(zip(m.columns, fresh(df.columns, *m.columns)))
    rows = df.where(F.col(f"`{text}`").rlike(WORD)).withColumns({names[k]: c for k, c in m.columns.items()})
    rows, new = m.placed(rows, names["source"], names["key"], names["id"])
    copies = F.explode(F.array_repeat(F.lit(1), F.col(new["times"]).cast("int"))).alias(new["nth"])
    return rows.where(F.col(new["times"]) > 0).select(*(F.col(f"`{c}`") for c in df.columns), copies).drop(new["nth"])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


#: Water filling in closed rounds: with three weights and a cap in proportion to size, a source is capped when its ratio of size to weight is below the level that the rest reaches.
OP8_SQL = rf"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST(concat('0x', substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':0:', coalesce(text, ''))), 1, 15)) AS BIGINT) AS key
  FROM documents),
src AS (
  SELECT source, sum(size) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM base GROUP BY source),
w AS (
  SELECT source, CAST(size AS DOUBLE) AS size, i, CASE i % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM src),
r AS (SELECT *, {MOST_EPOCHS} * size / weight AS ratio FROM w),
-- sources by ratio: the level if all before are capped
lv AS (
  SELECT *, ((SELECT sum(size) FROM w) - coalesce(sum({MOST_EPOCHS} * size) OVER before, 0)) / (sum(weight) OVER upto) AS level
  FROM r
  WINDOW before AS (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         upto AS (ORDER BY ratio, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fin AS (SELECT max(level) FILTER (WHERE ratio >= level) AS level FROM lv),
t AS (SELECT source, size AS source_size, CASE WHEN ratio < (SELECT level FROM fin) THEN {MOST_EPOCHS} * size ELSE weight * (SELECT level FROM fin) END AS target FROM r),
p AS (
  SELECT b.doc_id, b.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
    coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.doc_id NULLS FIRST, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM base b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(epochs * size + CASE WHEN before + size / 2.0 < target - epochs * source_size THEN size ELSE 0 END AS BIGINT) AS taken
FROM p
"""

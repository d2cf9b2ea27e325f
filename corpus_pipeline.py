"""A training corpus from raw documents, in five stages.

toxic documents go; documents of low quality go; one document of each group of
near duplicates stays; the sources are mixed to their weights; what is left is
encoded. A stage takes the documents that its predecessor kept and returns
documents with the columns it was given, whatever their names; the last returns
their token ids.

Null and empty texts are not toxic, but have too few words for the quality
rules, so they go there. Null sources are a source, null languages a language.
Rows with null or repeated ids are ordinary rows; of equal texts one stays,
that with the least id. Very long texts are judged and encoded whole. Empty
tables give no rows; without labels of both classes nothing is toxic.

The stages bound the bytes of rows that a Python worker gets at a time, which
is a setting of the session and stays (``common.bound_batches``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumetry.llm import bpe, divergence, mixing, near_duplicates, toxicity
from vellumetry.llm.common import bound_batches, fresh, materialise, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    p, score = toxicity.Params(), fresh(docs.columns, "score")[0]
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), p)
    return toxicity.score_documents(docs, model, p, name=score).where(F.col(score) < p.threshold).drop(score)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return divergence.filter_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return near_duplicates.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes more than once is there as often."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and decoded bytes, and the ids (little-endian, 32 bits)."""
    import public_tokenizers

    bound_batches(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The toxicity model can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

import importlib
import os

import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline")

import corpus_pipeline as P  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, odd_docs, words, tmp_path_factory):
    """Documents with odd rows, copies, junk and toxic texts, and labels for some."""
    rows = []
    for i in range(100, 260):
        t = words(60 + i % 90, f"pipe{i % 150}")
        if i % 5 == 0:
            t += " grobnik plurgh zastard"
        if i % 9 == 0:
            t = "the same line again\n" * 30
        rows.append((i, t, "en", f"s{i % 3}", len(t), "x", i, i, "s", i, True, "t", i, i, i))
    docs = odd_docs.union(spark.createDataFrame(rows, odd_docs.schema)).withColumns({n: F.lit(1) for n in ("s", "b", "__old")})
    path = str(tmp_path_factory.mktemp("pipe"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(100, 260, 2)] + [(None, None, None), (100, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def bag(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_run_is_its_stages_one_after_the_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = P.materialise(stage(spark, before, folder), "stage")
        assert after.columns == docs.columns, name
        own, all_ = bag(after), set(bag(before))
        assert set(own) <= all_, name  # rows are kept as they were
        if name != "mixing":
            assert len(own) <= before.count(), name
        before = after
    last = P.STAGES[-1][1](spark, before, folder)
    got = P.run(spark, folder)
    assert bag(got.drop("ids")) == bag(last.drop("ids")) and got.count() == before.count() > 0


def test_stages_decide_by_their_operators(spark, folder):
    from vellumetry.llm import bpe, divergence, mixing, near_duplicates, toxicity

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages, n = dict(P.STAGES), lambda df: sorted(map(repr, (r[:2] for r in df.select("doc_id", "text").collect())))
    p = toxicity.Params()
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), p)
    calm = [r for r in toxicity.score_documents(docs, model, p, name="own").collect() if r.own < p.threshold]
    assert n(stages["toxicity"](spark, docs, folder)) == sorted(repr((r.doc_id, r.text)) for r in calm)
    good = sorted(repr(r.doc_id) for r in divergence.judge(docs).collect() if r.kept)
    assert sorted(repr(r.doc_id) for r in stages["quality rules"](spark, docs, folder).collect()) == good
    classes = near_duplicates.near_duplicate_classes(docs).select("component").distinct().count()
    assert stages["near duplicates"](spark, docs, folder).count() == classes
    taken = sum(r.taken // r["size"] for r in mixing.mix(docs).collect() if r["size"])
    assert stages["mixing"](spark, docs, folder).count() == taken
    assert stages["encoding"](spark, docs, folder).count() == docs.count()
    coder = bpe.Bpe(importlib.import_module("public_tokenizers").path("byte_bpe_multi_50k.tiktoken"), importlib.import_module("public_tokenizers").PATTERN)
    for r in stages["encoding"](spark, docs.where("doc_id IN (8, 9, 101)"), folder).collect():
        text = docs.where(F.col("doc_id") == r.doc_id).first().text
        assert len(coder.encode_one(text)) == r.n_tokens and coder.decode(r.ids) == text.encode()


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    assert os.path.isdir(tmp_path)


def test_stages_bound_what_python_workers_and_files_take(spark, folder):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    for _, stage in P.STAGES:
        if stage is P.mix_sources:  # no Python in it
            continue
        spark.conf.set(key, "64m")
        stage(spark, spark.read.parquet(f"{folder}/documents.parquet").limit(0), folder)
        assert spark.conf.get(key).rstrip("b") == str(4 << 20)
    spark.conf.set(key, "1m")
    P.bound_batches(spark)
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)


def test_few_links_make_few_files(spark):
    from vellumetry.llm.graph import connected_components

    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        found = connected_components(spark.range(400).selectExpr("id a", "id - id % 4 b"))
        assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism < 64
        assert {(r.node, r.component) for r in found.collect()} == {(i, i - i % 4) for i in range(400)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

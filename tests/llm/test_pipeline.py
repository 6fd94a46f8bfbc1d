"""The pipeline against its stages in plain Python where those are exact, and that each stage decides."""

import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from lakesignal.llm import packing, quality_cnn

from .test_operators import brute_components


def test_stages_and_result(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
        if name == "near_dedup":
            rows = before.collect()
            place = {i: r.doc_id for i, r in enumerate(sorted(rows, key=lambda r: r.doc_id))}
            texts = [r.text for r in sorted(rows, key=lambda r: r.doc_id)]
            want = {place[i] for i, (_, _, kept) in brute_components(texts, 5, 80).items() if kept}
            assert {r.doc_id for r in docs.collect()} == want
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert all(r.seq_len in packing.LENGTHS for r in packed if r.n_tokens)


def test_run_equals_the_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, docs.collect()))


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_classifier_stage_rejects_bad_documents_that_slip_past_the_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = corpus_pipeline.rules_stage(spark, docs, sf_dir)
    bad = docs.join(labels.where("quality = 0"), "doc_id", "left_semi").where(~quality_cnn.is_held_out(F.col("doc_id")))
    planted = bad.withColumn("doc_id", F.col("doc_id") + 10**9).select(docs.columns)  # no label of their own
    before = kept.union(planted).cache()
    left = {r.doc_id for r in corpus_pipeline.classifier_stage(spark, before, sf_dir).collect()}
    ids = {r.doc_id for r in before.collect()}
    assert sum(i >= 10**9 for i in ids) > 0 and not any(i >= 10**9 for i in left)
    good = {r.doc_id for r in kept.join(labels.where("quality = 1"), "doc_id", "left_semi").collect()}
    assert len(good & left) >= 0.9 * len(good)


def test_network_is_fitted_on_labels_that_have_a_document_and_on_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_cnn, "CLASS_ROWS", 5)
    monkeypatch.setattr(quality_cnn, "train", lambda texts, labels: seen.append((texts, labels)))
    docs = spark.createDataFrame([(i, "w " * 10_000 + str(i)) for i in range(990, 1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, quality int")
    quality_cnn.fit(docs, labels)
    texts, ys = seen[0]
    held = {i for i in range(990, 1000) if zlib.crc32(str(i).encode()) % 5 == 0}
    want = [i for i in range(990, 1000) if i not in held]
    assert texts == ["w " * 10_000 + str(i) for i in want] and ys == [i % 2 for i in want]

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from brute import classes
from plumbline.llm import mixing
from plumbline.llm.common import saved

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        out = saved(stage(spark, at, SF), name)
        assert out.columns == docs.columns
        before, after = {r.doc_id for r in at.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        long_enough = {r.doc_id for r in at.collect() if len(r.text.split()) >= 60}
        assert after <= before and len(good & before & long_enough - after) <= 0.02 * len(good)
        at = out
    one = saved(corpus_pipeline.drop_near_duplicates(spark, at, SF), "one")
    expected = classes([(r.doc_id, r.text) for r in at.collect()])
    assert Counter(r.doc_id for r in one.collect()) == Counter({least for _, _, least in expected}) and one.columns == docs.columns
    mixed = saved(corpus_pipeline.mix_sources(spark, one, SF), "mixed")
    copies = {r.doc_id: r.copies for r in mixing.mix(one).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(copies) and mixed.columns == docs.columns
    packed = corpus_pipeline.pack_sequences(spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(copies)


def test_edge_rows_pass_every_stage(spark):
    rows = [(1, None, None, None, None, 1), (None, "", "en", "s", 0, 2), (3, "a word " * 3000, "en", None, 1, 3), (3, "a word " * 3000, "en", None, 1, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int").withColumnRenamed("score", "copies")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, SF).select(*docs.columns).count() <= table.count() * 2
        corpus_pipeline.pack_sequences(spark, table, SF).collect()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_predicted_languages_reach_the_quality_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hidden = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.col("lang")))
    out = saved(corpus_pipeline.keep_known_languages(spark, hidden, SF), "known").collect()
    own, hidden_ids = {r.doc_id: r.lang for r in docs.collect()}, {r.doc_id for r in hidden.filter("lang IS NULL").collect()}
    assert hidden_ids & {r.doc_id for r in out} and all(r.lang is not None for r in out)
    assert sum(r.lang != own[r.doc_id] for r in out) <= 0.02 * len(hidden_ids)

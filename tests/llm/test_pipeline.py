"""The stages: what goes, what stays, and that the whole is their composition."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fotolake.llm import decontamination, pii
from tests.conftest import SF
from tests.llm.test_near_copies import _kept


def test_stages_decide(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(900001, "12345 !!!", "en", "x", 9), (900002, None, None, None, None), (900003, "", "en", "x", 0)]
    docs, columns = source.unionByName(spark.createDataFrame(extra, source.schema)), source.columns
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if i < 4:
            assert docs.columns == columns, name
    assert kept[0] == {r.doc_id for r in source.select("doc_id").collect()}
    assert kept[1] == set(_kept(source.orderBy("doc_id").collect()))
    assert kept[1] - kept[2] == {r.doc_id for r in decontamination.contained(source, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()} & kept[1]
    assert kept[4] == kept[3] == kept[2]
    masked = spark.read.parquet(str(tmp_path / "3"))
    assert pii.digest(pii.find(masked.select("doc_id", "text"))).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert masked.filter(F.col("n_chars") != F.char_length("text")).count() == 0
    assert docs.filter("NOT round_trip OR n_tokens < 2").count() == 0


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]
    assert got.filter("round_trip").count() == got.count() == got.select("doc_id").distinct().count() > 150


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, stage):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert stage[1](spark, empty, SF).count() == 0


def test_arrow_stages_keep_batches_small(spark):
    """Also for the frame that a stage returns, which runs later; what is smaller already stays."""
    name, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.read.parquet(f"{SF}/documents.parquet")
    before = spark.conf.get(name)
    try:
        for stage in (corpus_pipeline.language, corpus_pipeline.tokens):
            for value, wanted in (("10000", "1000"), ("0", "1000"), ("200", "200")):
                spark.conf.set(name, value)
                stage(spark, docs.limit(20), SF)
                assert spark.conf.get(name) == wanted
    finally:
        spark.conf.set(name, before)

"""The pipeline leaves out no row and no span: rows without an id, rows that repeat one, spans that overlap."""

from pyspark.sql import functions as F

import corpus_pipeline
from fotolake.llm import language_id, pii
from fotolake.llm.common import table
from tests.conftest import SF


def test_rows_are_cleaned_whatever_their_id(spark):
    docs = table(spark, SF, "documents")
    item = table(spark, SF, "benchmark").orderBy("item_id").first().text
    rows = [(None, f"before {item} after", "a"), (None, "nothing to see here", "b"), (7, item, "c"), (7, "a clean text with an id that is taken", "d"), (8, None, "e"), (None, None, "f"), (9, "", "g")]
    odd = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], docs.schema)
    kept = corpus_pipeline.benchmark(spark, odd, SF)
    assert kept.columns == docs.columns
    assert sorted(r.source for r in kept.collect()) == ["b", "d", "e", "f", "g"]


def _masked(spark, text, *spans):
    found = spark.createDataFrame([(text, [(k, a, b) for k, a, b in spans])], "t string, s array<struct<kind:string,start:bigint,end:bigint>>")
    return found.select(pii.masked(F.col("t"), F.col("s"))).first()[0]


def test_no_part_of_a_span_stays(spark):
    assert _masked(spark, "a 10.0.0.4 111 b", ("ip", 2, 10), ("card", 9, 14)) == "a [IP][CARD] b"
    assert _masked(spark, "a 10.0.0.4 111 b", ("card", 2, 14), ("ip", 2, 10)) == "a [CARD] b"
    assert _masked(spark, "0123456789", ("ip", 0, 4), ("card", 2, 6), ("phone", 5, 8)) == "[IP][CARD][PHONE]89"
    assert _masked(spark, "0123456789", ("ip", 0, 4), ("card", 4, 6)) == "[IP][CARD]6789"


def test_an_address_that_runs_into_a_card(spark):
    docs = spark.createDataFrame([(1, "from 10.0.0.41 1111 1111 0009 today", "en", "x", 0)], table(spark, SF, "documents").schema)
    assert corpus_pipeline.personal_data(spark, docs, SF).first().text == "from [IP][CARD] today"


def test_counting_holds_few_texts_at_a_time():
    assert language_id.CHUNK <= 1 << 18

"""Tables in which no document has a language."""

from pyspark.sql import functions as F

from pulsegrid.llm import langid


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, "123"), (3, None)], "doc_id bigint, text string").withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in langid.filter_languages(docs).collect()} == {1, 2, 3}

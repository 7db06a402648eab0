"""Toxic documents by language, on labels that training has not seen."""

from pyspark.sql import functions as F

from lumenfold.llm import common, quality


def test_toxic_documents_of_every_language_go(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2))
    model = quality.train(docs, labels.filter(half == 0))
    told = labels.filter((half == 1) & (F.col("quality") == 1)).select("doc_id", F.col("toxic").alias("told"))
    got = quality.classify(docs, model).join(told, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    by = {(r["lang"], r["told"]): r for r in got.groupBy("lang", "told").agg(F.count("*").alias("n"), F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert {lang for lang, told in by if told} == {"en", "de", "fr", "es"}
    assert all(r["kept"] <= 0.15 if told else r["kept"] >= 0.97 for (_, told), r in by.items())


def test_the_list_is_one_labeller(spark):
    """Without human labels of toxicity the list teaches the scorer; a human label outweighs it."""
    docs = spark.createDataFrame([(i, "plain words of a plain text" + " you idiot" * (i == 3)) for i in range(6)], "doc_id long, text string")
    for labels, expected in ((None, [3]), (spark.createDataFrame([(0, 1)], "doc_id long, quality int"), [3]), (spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int"), [])):
        got = quality.classify(docs, quality.train(docs, labels)).collect()
        assert [r["doc_id"] for r in got if r["toxic"]] == expected

"""Bounded samples are taken over the whole table."""

from pyspark.sql import functions as F

from factgraph.llm import language_id, pii
from factgraph.llm.common import least_hashed


def test_languages_that_stand_late_in_the_table_are_learned(spark):
    docs = spark.range(0, 12_000, 1, 6).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") < 10_000, "en").when(F.col("id") < 11_970, "fr").otherwise("is").alias("lang"),
    )
    rows = language_id.training_rows(docs, 300)
    n = {lang: sum(x == lang for _, x in rows) for lang in ("en", "fr", "is")}
    late = docs.where("lang = 'is'").where(~language_id.held_out()).count()
    assert n["is"] == late and len(rows) == 300 and abs(n["en"] - n["fr"]) <= 1
    assert rows == language_id.training_rows(docs.repartition(9), 300)
    texts = pii.sample_texts(docs, 600)
    assert len(texts) == 600 and 200 < sum(int(t.split()[1]) >= 6_000 for t in texts) < 400


def test_least_hashed_counts_equal_rows_once(spark):
    rows = spark.createDataFrame([(i % 5, (i % 5) * 1000 - 2500) for i in range(1000)], "n long, draw long")
    assert [r["n"] for r in least_hashed(rows, 3)] == [0, 1, 2]
    assert [r["n"] for r in least_hashed(rows, 50)] == [0, 1, 2, 3, 4] and least_hashed(rows.limit(0), 3) == []

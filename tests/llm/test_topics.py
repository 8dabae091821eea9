"""Topics of the whole table."""

from pyspark.sql import functions as F


def test_topics_come_from_the_whole_table_in_any_order(spark):
    from factgraph.llm import mixing

    # two topics of the first rows, and six that stand behind 30,000 rows
    topic = F.when(F.col("id") < 30_000, F.col("id") % 2).otherwise(2 + F.col("id") % 6)
    docs = spark.range(0, 36_000, 1, 4).select(
        F.col("id").alias("doc_id"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.format_string("t%dw%d", topic, F.pmod(F.xxhash64("id", i), F.lit(12)))), " ").alias("text"),
        F.lit("en").alias("lang"),
        F.lit("s").alias("source"),
        topic.alias("made"),
    )
    bags = mixing.with_bags(docs).cache()
    centres = mixing.train_topics(bags)
    found = mixing.with_topics(bags, centres).join(docs.select("doc_id", "made"), "doc_id").groupBy("made").agg(F.collect_set("topic").alias("t")).collect()
    assert len(found) == 8 and all(len(r["t"]) == 1 for r in found) and len({r["t"][0] for r in found}) == 8
    assert (mixing.train_topics(bags.repartition(7)) == centres).all()

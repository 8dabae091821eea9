"""The pipeline as a whole, and each stage's decisions on its own input."""

import corpus_pipeline as P
from factgraph.llm import decontamination, ngram_join
from pyspark.sql import functions as F


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    extra = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars").withColumn("more", F.lit(1))
    docs = docs.withColumn("more", F.lit(1)).unionByName(extra)
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == P.COLUMNS
        pairs = [(r["doc_id"], r["text"]) for r in before.collect()]
        kept = {r["doc_id"] for r in docs.collect()}
        if name == "language":
            assert None not in kept and len(kept) >= 0.97 * (len(pairs) - 1)
        elif name == "near_copies":
            assert kept == {c for _, _, c in ngram_join.brute_force(pairs, P.SHINGLE_WORDS, P.SIMILARITY_PERCENT)}
        elif name == "decontamination":
            assert kept == {r[0] for r in decontamination.brute_force(pairs, bench) if not r[5]}
        else:
            assert 0.4 * len(pairs) < len(kept) <= len(pairs)
    last = P.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in last.collect()} == kept
    assert P.STAGES[0][1](spark, docs.limit(0), sf_dir).count() == 0

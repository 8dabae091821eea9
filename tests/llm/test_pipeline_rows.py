"""Stages judge each row by itself, also where rows share a doc_id or have none."""

import corpus_pipeline as P
from pyspark.sql import functions as F


def _texts(df):
    return sorted(r["text"] or "" for r in df.collect())


def test_rows_without_an_id_and_rows_that_repeat_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*P.COLUMNS)
    clean = [r["text"] for r in docs.where("lang = 'en' and n_chars between 400 and 2000").orderBy("doc_id").limit(4).collect()]
    passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first()["text"]
    rows = [(None, clean[0]), (None, "12 34 !"), (None, None), (7_000_001, clean[1]), (7_000_001, "56 78 ?")]
    odd = spark.createDataFrame([(i, t, "en", "s0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    added = [t for t in _texts(P.language(spark, docs.unionByName(odd.select(*P.COLUMNS)), sf_dir).where("doc_id is null or doc_id = 7000001"))]
    assert added == sorted(clean[:2])
    rows = [(None, clean[0]), (None, f"{clean[1]} {passage} {clean[1]}"), (8, clean[2]), (8, f"{passage} {clean[3]}")]
    odd = spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in rows], odd.schema)
    from factgraph.llm.decontamination import decontaminate

    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = [t for i, t in rows if not decontaminate(odd.where(F.col("text") == t), bench).first()["hits"]]
    assert _texts(P.decontamination(spark, odd, sf_dir)) == sorted(want) and set(want) <= {clean[0], clean[2]} and want


def test_rows_without_an_id_are_drawn_each_by_itself(spark, sf_dir):
    from factgraph.llm.mixing import mix_sources

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*P.COLUMNS).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    selected = {r["mark"] for r in mix_sources(docs).where("selected").collect()}
    kept = P.mixing(spark, docs, sf_dir).select(P.mark().alias("mark")).collect()
    assert {r["mark"] for r in kept} == selected and len(kept) < docs.count()

"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to the shared
folder and read again as the next stage's documents.  All stages but the last return the columns of
``documents``.  The other stages judge each row by itself, also where rows share a doc_id or have
none.  Near duplicates take rows that repeat a doc_id as one document and keep one row of it.

Defined results: a text without a letter is rejected by the first stage, so null and empty texts
end there; rows with a null doc_id pass the second stage each by itself; an empty table passes all
stages; columns beyond those of ``documents`` are dropped at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import materialize, table
from factgraph.llm.decontamination import decontaminate
from factgraph.llm.language_id import identify
from factgraph.llm.mixing import category, mark, mix_sources
from factgraph.llm.ngram_join import near_duplicates
from factgraph.llm.token_output import token_output

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: shingles of five words and a similarity of 0.8.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the model rejects."""
    docs = docs.select(*COLUMNS)
    return identify(docs, carry=COLUMNS).where(~F.col("rejected")).select("carried.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies, once."""
    found = near_duplicates(docs, SHINGLE_WORDS, SIMILARITY_PERCENT).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.join(found, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return named.unionByName(docs.where(F.col("doc_id").isNull()).select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS)
    return found.where(F.size("hits") == 0).select("carried.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents to the target weights of sources, languages and topics."""
    # rows that agree on all of these are drawn alike, as the mark is a hash of id and text
    key = [F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), category("source"), category("lang"), mark()]
    names = [f"_{i}" for i in range(len(key))]
    drawn = mix_sources(docs).where("selected")
    drawn = drawn.select(*[c.alias(n) for c, n in zip([*key[:4], F.col("mark")], names)]).distinct()
    return docs.select("*", *[c.alias(n) for c, n in zip(key, names)]).join(drawn, names, "left_semi").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold of each document."""
    return token_output(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids)]

#: Trained models, graph components and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A text is split at ``\\n``.  Each line is hashed, a rolling hash runs over every two neighbouring
line hashes, and a chunk starts at the first line and wherever the rolling hash falls in a quarter
of its range.  So boundaries move with the text and a shared run of lines is cut alike wherever it
stands.  A chunk of two lines or more, one of them not blank, that occurs in several places keeps
its first place (least doc_id, then least place) and goes elsewhere, after its bytes were compared
with those of the first place.

Shuffles: chunk hashes without text (counted before the shuffle, so for the count a chunk in a third
of all documents is a row per task), then texts once by doc_id.  Only the bytes of repeated chunks
travel by hash.  Both joins on a chunk's hash read written tables on both sides, with one row a chunk
on the right, so that Spark splits the partition of a hot chunk or broadcasts a small right side.

Defined results: a null or empty text is one blank line and stays; rows that repeat a doc_id with
another text are documents of their own, in order of the text's hash; rows that repeat both are one
document, of which all copies are cut alike; each row with a null doc_id is a document of its own, after all
others, in an arbitrary but fixed order (such rows are written once, and go by their place there); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: First hexadecimal digits of a rolling hash that start a chunk: a quarter of all.
BOUNDARY = ("0", "1", "2", "3")
MIN_LINES = 2


def with_chunks(df: DataFrame) -> DataFrame:
    """``df`` (with text) and its chunks, an array of line arrays, and n_lines."""
    names = df.columns
    df = df.withColumn("lines", F.split("text", "\n"))
    df = df.withColumn("hashes", F.transform("lines", lambda x: F.md5(x)))
    n = F.size("lines")
    rolled = F.zip_with("hashes", F.slice("hashes", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.md5(F.concat(a, b)))
    # rolled[i] stands for the line after i; the last has no successor and is null
    starts = F.filter(F.transform(rolled, lambda h, i: F.when(F.substring(h, 1, 1).isin(*BOUNDARY), i + 1)), lambda x: x.isNotNull())
    df = df.withColumn("starts", F.concat(F.array(F.lit(0)), starts))
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array(n))
    return df.select(*names, F.zip_with("starts", ends, lambda a, b: F.slice("lines", a + 1, b - a)).alias("chunks"), n.cast("long").alias("n_lines"))


def chunk_digest(chunk: Column) -> Column:
    """The hash of a chunk that may be removed, else null."""
    text = F.array_join(chunk, "\n")
    return F.when((F.size(chunk) >= MIN_LINES) & text.rlike("[^ \\t-\\r]"), F.md5(text))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, n_removed and kept_text of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    loose = materialize(docs.where("key is null"), "unnamed")
    docs = docs.where("key is not null").select(F.lit(False).alias("unnamed"), "key", F.xxhash64("text").alias("mark"), "text").unionByName(
        loose.select(F.lit(True).alias("unnamed"), F.lit(0).cast("long").alias("key"), F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("mark"), "text")
    )
    name = ["unnamed", "key", "mark"]
    # where each repeated chunk stands first
    placed = materialize(with_chunks(docs).select(*name, F.posexplode(F.transform("chunks", chunk_digest)).alias("place", "digest")).where(F.col("digest").isNotNull()), "chunks")
    firsts = materialize(placed.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*name, "place")).alias("first")).where("n > 1").select("digest", "first"), "firsts")
    marked = placed.join(firsts, "digest").groupBy(*name).agg(F.collect_set(F.struct("place", "digest", "first")).alias("repeats"))
    # texts are dealt by doc_id once: both joins below read the same exchange
    texts = docs.repartition(*name)
    bytes_of = materialize(
        with_chunks(texts.join(marked, name))
        .select(*name, F.explode("repeats").alias("r"), "chunks")
        .select(*name, "r.*", F.expr("array_join(try_element_at(chunks, r.place + 1), '\n')").alias("bytes"))
        .where(F.md5("bytes") == F.col("digest")),
        "repeats",
    )
    is_first = F.struct(*name, "place") == F.col("first")
    heads = materialize(bytes_of.where(is_first).groupBy("digest").agg(F.min("bytes").alias("head")), "heads")
    repeated = bytes_of.where(~is_first).join(heads, "digest").where(F.col("bytes") == F.col("head"))
    removed = repeated.groupBy(*name).agg(F.collect_set(F.struct("place", "digest")).alias("gone"))
    out = with_chunks(texts.join(removed, name, "left"))
    kept = F.when(F.col("gone").isNull(), F.col("chunks")).otherwise(
        F.filter("chunks", lambda c, i: ~F.exists("gone", lambda g: (g["place"] == i) & (g["digest"] == F.md5(F.array_join(c, "\n")))))
    )
    out = out.withColumn("kept", kept)
    return out.select(
        F.when(~F.col("unnamed"), F.col("key")).alias("doc_id"),
        "text",
        "n_lines",
        (F.col("n_lines") - F.aggregate("kept", F.lit(0).cast("long"), lambda s, c: s + F.size(c))).alias("n_removed"),
        F.array_join(F.flatten("kept"), "\n").alias("kept_text"),
    )


def line_dedup_query(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_SPLIT = "SELECT doc_id, i, line, md5(line) AS h FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))"
ORACLE_SQL = f"""
WITH l AS ({_SPLIT}),
b AS (SELECT *, CASE WHEN i = 0 OR substr(md5(lag(h) OVER w || h), 1, 1) IN ('0', '1', '2', '3') THEN 1 ELSE 0 END AS cut
      FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS chunk FROM b),
c AS (SELECT doc_id, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk_text FROM k GROUP BY doc_id, chunk),
r AS (SELECT *, n >= {MIN_LINES} AND regexp_matches(chunk_text, '[^ \\x09-\\x0D]')
             AND row_number() OVER (PARTITION BY chunk_text ORDER BY doc_id, chunk) > 1 AS gone FROM c)
SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(chunk_text, chr(10) ORDER BY chunk) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""

"""Extensions on Structured Streaming; the reference's operators themselves are not streams.

``follow_sources`` derives facts again for source files as they arrive.  ``severity_windows``
counts diagnostics by severity in event-time windows with a watermark for late rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import source_kind
from ..sources import csharp, lexer

SOURCE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def follow_sources(spark: SparkSession, root: str, checkpoint: str, sink: Callable[[dict[str, DataFrame], int], None], once: bool = False) -> StreamingQuery:
    """Facts of each batch of arriving files, given to ``sink(facts, batch_id)``.

    A file that changes under a new name replaces nothing here: the sink merges by document_id.
    """
    files = spark.readStream.format("binaryFile").schema(SOURCE_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.cs").load(root)

    def handle(batch: DataFrame, batch_id: int) -> None:
        docs = batch.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode("content", "UTF-8").alias("text"))
        docs = docs.select(F.col("path").alias("document_id"), "path", "text", source_kind(F.col("path")).alias("source_kind"), F.lit(None).cast("string").alias("project_id"))
        words = lexer.tokens(docs)
        rows = csharp.statements(words)
        types = csharp.type_declarations(rows)
        members = csharp.member_declarations(rows, types)
        functions = csharp.local_functions(rows, members)
        sink({"documents": docs, "symbols": csharp.symbols(types, members), "metrics": csharp.metrics(words, members, functions, rows)}, batch_id)

    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def severity_windows(diagnostics: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window, code and severity of a stream (ts, code, severity); late rows up to ``late`` count."""
    return diagnostics.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "code", "severity").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "code", "severity", "n")

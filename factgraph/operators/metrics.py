"""Code metrics, hotspots and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import profile_name, same_ignoring_case, severity

HOTSPOTS = {"quick": 3, "standard": 5, "deep": 10}


def text_metrics(documents: DataFrame, pattern: str) -> DataFrame:
    """Line count and 1 + decision points of each document."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.col("document_id").alias("symbol_id"), (F.regexp_count(text, F.lit(pattern)) + 1).cast("int").alias("complexity"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int").alias("line_count"))


def hotspots(metrics: DataFrame, symbols: DataFrame | None, profile: str | None = None) -> DataFrame:
    """The most complex symbols, chosen by complexity, then shown by complexity + lines."""
    k = HOTSPOTS[profile_name(profile)]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    chosen = metrics.orderBy(zero("complexity").desc(), zero("line_count").desc(), "symbol_id").limit(k)
    if symbols is not None:
        chosen = chosen.join(symbols.select("symbol_id", "display_min"), "symbol_id", "left")
    else:
        chosen = chosen.withColumn("display_min", F.lit(None).cast("string"))
    score = (zero("complexity") + zero("line_count")).cast("int")
    return chosen.select("symbol_id", F.coalesce("display_min", "symbol_id").alias("display_name"), "complexity", "line_count", score.alias("score")).orderBy(F.desc("score"), "symbol_id")


def diagnostic_summary(diagnostics: DataFrame) -> DataFrame:
    kind = severity(F.col("severity"))
    n = lambda c: F.count_if(c).cast("int")
    return diagnostics.agg(n(kind == "error").alias("errors"), n(kind == "warning").alias("warnings"), n(kind == "info").alias("infos"), F.count(F.lit(1)).cast("int").alias("total"))


def diagnostics_in(diagnostics: DataFrame, scope: str = "solution", path: str | None = None, project_id: str | None = None) -> DataFrame:
    """Diagnostics of a document, a project or all; a scope without a path or project means all."""
    df = diagnostics
    if scope == "document" and path:
        df = df.where(same_ignoring_case(F.col("file"), path))
    if scope == "project" and project_id is not None:
        df = df.where(F.col("project_id") == project_id)
    return df.select("code", severity(F.col("severity")).alias("severity"), "message", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(1)).alias("line"), F.coalesce("col", F.lit(1)).alias("col"))


def diagnostic_order() -> list:
    return [F.col("file"), F.col("line"), F.col("col"), F.col("code"), F.col("message")]

"""Symbol lookup: by id, by position, by qualified name, and by search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.shapes import keep_first, range_join


def by_id(symbols: DataFrame, symbol: str) -> DataFrame:
    return keep_first(symbols.where(F.col("symbol_id") == symbol), ["symbol_id"], [F.col("project_id")])


def by_name(symbols: DataFrame, name: str) -> DataFrame:
    """Candidates for a qualified name, with their match tier.

    Exact qualified names come first; a short name falls back to equal names.  Only the best tier
    is returned.
    """
    name = S.qualified_name(name)
    short = name.rsplit(".", 1)[-1]
    found = symbols.where(F.col("name") == short)
    strict = (F.col("display_fq") == name) | (F.col("display_err") == name)
    tier = F.when(strict, 0).when(F.lit("." not in name), 1)
    found = keep_first(found.withColumn("tier", tier).where(F.col("tier").isNotNull()), ["symbol_id"], [F.col("project_id")])
    # one row: the best tier there is
    best = found.agg(F.min("tier").alias("best"))
    return found.join(best, F.col("tier") == F.col("best"), "left_semi")


def search(symbols: DataFrame, query: str, kind: str | None = None, accessibility: str | None = None, project_id: str | None = None, path: str | None = None) -> DataFrame:
    """Symbols whose name equals the query in any case."""
    df = symbols.where(S.same_ignoring_case(F.col("name"), query))
    if kind:
        df = df.where(S.same_ignoring_case(F.col("kind"), kind))
    if accessibility:
        df = df.where(S.same_ignoring_case(F.col("accessibility"), accessibility))
    if project_id is not None:
        df = df.where(F.col("project_id") == project_id)
    if path:
        df = df.where(S.same_ignoring_case(F.col("file"), path))
    return keep_first(df, ["symbol_id"], [F.col("project_id")])


def at_position(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """For each point (document_id, at) the innermost node that holds it."""
    inside = range_join(points, nodes, "document_id", "at", "span_start", "span_len")
    return keep_first(inside, ["document_id", "at"], [F.col("span_len"), F.col("node_id")])


def descriptor(symbols: DataFrame) -> DataFrame:
    """Descriptors: a missing location is ("", 1, 1)."""
    none = F.col("file").isNull()
    return symbols.select(
        "symbol_id", "name", "kind", F.col("containing_type_fq").alias("containing_type"), F.col("containing_namespace").alias("namespace"),
        F.coalesce("file", F.lit("")).alias("file"), F.when(none, 1).otherwise(F.col("line")).alias("line"), F.when(none, 1).otherwise(F.col("col")).alias("col"),
    )


def descriptor_order() -> list:
    return [F.upper("name"), F.col("name"), F.col("kind"), F.coalesce("namespace", F.lit("")), F.coalesce("containing_type", F.lit("")), F.col("file"), F.col("line"), F.col("col"), F.col("symbol_id")]

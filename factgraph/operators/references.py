"""References: usages by scope, impact by file, key references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.scalars import base_name, same_ignoring_case

LOCATION = ["file", "line", "col"]


def usages(refs: DataFrame, symbol: str, scope: str = "solution", path: str | None = None, project_id: str | None = None) -> DataFrame:
    """Distinct locations in the solution, the owner's project, or one document."""
    if scope not in ("solution", "project", "document"):
        raise QueryError("invalid_input", "scope must be document, project or solution", parameter="scope", value=scope)
    df = refs.where(F.col("symbol_id") == symbol)
    if scope == "document":
        if not path:
            raise QueryError("invalid_path", "a document scope needs a path", parameter="path")
        df = df.where(same_ignoring_case(F.col("file"), path))
    if scope == "project":
        df = df.where(F.col("project_id") == project_id)
    return df.select(*LOCATION).distinct()


def impact_hints(refs: DataFrame, symbol: str, top: int = 3) -> DataFrame:
    """Files, by base name in any case, with most references; the first spelling is shown."""
    at = usages(refs, symbol).withColumn("name", base_name(F.col("file")))
    grouped = at.groupBy(F.upper("name").alias("key")).agg(F.count(F.lit(1)).cast("int").alias("count"), F.min_by("name", F.struct(*LOCATION)).alias("name"))
    return grouped.orderBy(F.desc("count"), "key").limit(top).select("name", "count")


def key_references(refs: DataFrame, symbol: str, top: int = 5) -> DataFrame:
    return usages(refs, symbol).orderBy(*LOCATION).limit(top)

"""Projects: dependencies, module fan-in and fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import scalars as S


def dependencies(projects: DataFrame, project_refs: DataFrame, project_id: str, direction: str | None = "both") -> DataFrame:
    """Distinct edges one step out of or into a project; dangling references are dropped."""
    direction = S.one_of(direction, S.DIRECTIONS, "direction") or "both"
    out, into = F.col("src_project_id") == project_id, F.col("dst_project_id") == project_id
    edges = project_refs.where({"outgoing": out, "incoming": into, "both": out | into}[direction]).distinct()
    name = projects.select("project_id", "name").distinct()
    source = name.select(F.col("project_id").alias("src_project_id"), F.col("name").alias("source_name"))
    target = name.select(F.col("project_id").alias("dst_project_id"), F.col("name").alias("target_name"))
    return edges.join(source, "src_project_id").join(target, "dst_project_id").select("src_project_id", "source_name", "dst_project_id", "target_name")


def module_fan(projects: DataFrame, project_refs: DataFrame) -> DataFrame:
    """Outgoing and incoming references of each project, 0 where there are none."""
    edges = project_refs.distinct()
    ends = edges.select(F.explode(F.array(F.struct(F.col("src_project_id").alias("project_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst_project_id").alias("project_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    sums = ends.groupBy("e.project_id").agg(F.sum("e.o").cast("int").alias("outgoing"), F.sum("e.i").cast("int").alias("incoming"))
    return projects.join(sums, "project_id", "left").select("project_id", "name", F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("incoming", F.lit(0)).alias("incoming"))


def select_project(projects: DataFrame, path: str | None = None, name: str | None = None, project_id: str | None = None) -> str:
    """The one project that all given selectors match."""
    df = projects
    for column, value in (("path", path), ("name", name), ("project_id", project_id)):
        if S.text_or_none(value):
            df = df.where(S.same_ignoring_case(F.col(column), value.strip()))
    rows = df.select("project_id").distinct().limit(2).collect()
    if not rows:
        raise QueryError("invalid_input", "no project matches the selector", scope="snapshot-local")
    if len(rows) > 1:
        raise QueryError("ambiguous_symbol", "several projects match the selector")
    return rows[0][0]

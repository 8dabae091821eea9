"""Call graph: bounded traces up and down the call multigraph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import flow_direction, is_visible
from ..plans.shapes import reach, single_row

EDGE = ["from_id", "to_id", "file", "line", "col"]
MAX_BOTH_DEPTH = 4


def callers(calls: DataFrame, symbol: str) -> DataFrame:
    return calls.where(F.col("to_id") == symbol).select(*EDGE).distinct()


def callees(calls: DataFrame, symbol: str) -> DataFrame:
    return calls.where(F.col("from_id") == symbol).select(*EDGE).distinct()


def _one_way(calls: DataFrame, symbol: str, depth: int, near: str, far: str) -> DataFrame:
    """All edges of nodes that are expanded: those less than ``depth`` steps away."""
    steps = calls.select(F.col(near).alias("src"), F.col(far).alias("dst"))
    expanded = reach(steps, single_row(calls.sparkSession, id=symbol), depth - 1)
    return calls.join(expanded, calls[near] == expanded["id"], "left_semi").select(*EDGE).distinct()


def trace(calls: DataFrame, symbol: str, direction: str | None = "both", depth: int | None = 2) -> DataFrame:
    """Edges of a trace.  Depth is at least 1; in both directions together at most 4."""
    direction, depth = flow_direction(direction), max(2 if depth is None else depth, 1)
    if direction == "both":
        depth = min(depth, MAX_BOTH_DEPTH)
    ways = []
    if direction != "downstream":
        ways.append(_one_way(calls, symbol, depth, "to_id", "from_id"))
    if direction != "upstream":
        ways.append(_one_way(calls, symbol, depth, "from_id", "to_id"))
    return ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1]).distinct()


def visible_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges whose call site and both declarations are visible, with the projects of both ends.

    Hidden nodes were walked through before, so what lies behind them stays.
    """
    ends = symbols.where(is_visible(F.col("file"))).groupBy("symbol_id").agg(F.min("project_id").alias("project"))
    shown = edges.where(is_visible(F.col("file")))
    source = ends.select(F.col("symbol_id").alias("from_id"), F.col("project").alias("from_project"))
    target = ends.select(F.col("symbol_id").alias("to_id"), F.col("project").alias("to_project"))
    return shown.join(source, "from_id").join(target, "to_id").select(*EDGE, "from_project", "to_project")


def transitions(edges: DataFrame) -> DataFrame:
    """Calls from project to project."""
    name = lambda c: F.coalesce(F.col(c), F.lit("unknown")).alias(c)
    return edges.select(name("from_project"), name("to_project")).groupBy("from_project", "to_project").agg(F.count(F.lit(1)).cast("int").alias("count"))


def graph_counts(edges: DataFrame, symbol: str) -> DataFrame:
    """Nodes, the root among them, and edges of a trace."""
    ends = edges.select(F.explode(F.array("from_id", "to_id", F.lit(None))).alias("id")).union(single_row(edges.sparkSession, id=symbol))
    # each edge gives one null next to its ends
    return ends.agg(F.countDistinct("id").cast("int").alias("node_count"), F.count_if(F.col("id").isNull()).cast("int").alias("edge_count"))

"""Type hierarchy: bases, interfaces, derived types and implementations over direct type edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shapes import reach, single_row


def _root(df: DataFrame, symbol: str) -> DataFrame:
    return single_row(df.sparkSession, id=symbol)


def _up(type_edges: DataFrame, kind: str | None = None) -> DataFrame:
    df = type_edges if kind is None else type_edges.where(F.col("edge_kind") == kind)
    return df.select(F.col("type_id").alias("src"), F.col("parent_id").alias("dst"))


def _down(type_edges: DataFrame) -> DataFrame:
    return type_edges.select(F.col("parent_id").alias("src"), F.col("type_id").alias("dst"))


def bases(type_edges: DataFrame, symbol: str, transitive: bool = True) -> DataFrame:
    """Base types with their distance: the whole chain, or one step."""
    return reach(_up(type_edges, "base"), _root(type_edges, symbol), None if transitive else 1).where("distance > 0")


def interfaces(type_edges: DataFrame, symbol: str, transitive: bool = True) -> DataFrame:
    """Interfaces of a type: all of its bases and interfaces, or those it names itself."""
    direct = type_edges.where(F.col("edge_kind") == "interface")
    if not transitive:
        return direct.where(F.col("type_id") == symbol).select(F.col("parent_id").alias("id")).distinct()
    above = reach(_up(type_edges), _root(type_edges, symbol), None)
    return direct.join(above, direct["type_id"] == above["id"], "left_semi").select(F.col("parent_id").alias("id")).distinct()


def derived(type_edges: DataFrame, symbol: str, transitive: bool = True, most: int | None = 200) -> DataFrame:
    """Derived and implementing types.  The cap is taken in order of id, so it is the same each time."""
    below = reach(_down(type_edges), _root(type_edges, symbol), None if transitive else 1).where("distance > 0")
    return below if most is None else below.orderBy("id").limit(max(most, 0))


def ancestry(type_edges: DataFrame, symbol: str) -> DataFrame:
    """The type (rank 0), its bases by distance (rank 1) and all interfaces (rank 2): id, owner_rank, distance."""
    chain = bases(type_edges, symbol)
    return (
        _root(type_edges, symbol).select("id", F.lit(0).alias("owner_rank"), F.lit(0).alias("distance"))
        .unionByName(chain.select("id", F.lit(1).alias("owner_rank"), "distance"))
        .unionByName(interfaces(type_edges, symbol).select("id", F.lit(2).alias("owner_rank"), F.lit(0).alias("distance")))
        .groupBy("id").agg(F.min(F.struct("owner_rank", "distance")).alias("least")).select("id", "least.*")
    )


def implementations(type_edges: DataFrame, impl_edges: DataFrame, symbols: DataFrame, symbol: str) -> DataFrame:
    """Types that implement an interface, however far down, or members that implement its member.

    Abstract and virtual members of classes have none.
    """
    known = symbols.where(F.col("symbol_id") == symbol).select(F.col("type_kind").alias("root_kind"))
    below = derived(type_edges, symbol, most=None).select("id")
    types = symbols.join(below, symbols["symbol_id"] == below["id"], "left_semi").where(F.coalesce("type_kind", F.lit("")) != "interface")
    direct = impl_edges.where(F.col("symbol_id") == symbol).select(F.col("impl_id").alias("id")).distinct()
    members = symbols.join(direct, symbols["symbol_id"] == direct["id"], "left_semi").where(F.col("member_kind").isNotNull())
    is_interface = known.where(F.col("root_kind") == "interface").limit(1)
    return types.join(is_interface.select(F.lit("interface").alias("_k")), F.lit("interface") == F.col("_k"), "left_semi").unionByName(members).dropDuplicates(["symbol_id"])

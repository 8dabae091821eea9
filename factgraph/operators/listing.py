"""Listings: types of a project, members of a type, outlines, projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.shapes import keep_first, page
from .hierarchy import ancestry


def types(symbols: DataFrame, project_id: str | None = None, namespace_prefix: str | None = None, kind: str | None = None, accessibility: str | None = None) -> DataFrame:
    """Source-declared, visible types; the namespace prefix is a plain string prefix."""
    kind = S.one_of(kind, S.TYPE_KINDS, "kind")
    accessibility = S.one_of(accessibility, S.ACCESSIBILITIES, "accessibility", dashes=True)
    df = symbols.where(F.col("in_source") & F.col("type_kind").isin(*S.TYPE_KINDS) & S.is_visible(F.col("file")))
    if project_id is not None:
        df = df.where(F.col("project_id") == project_id)
    if S.text_or_none(namespace_prefix):
        df = df.where(F.col("containing_namespace").startswith(namespace_prefix))
    if kind:
        df = df.where(F.col("type_kind") == kind)
    if accessibility:
        df = df.where(F.col("accessibility") == accessibility)
    return df.select("symbol_id", F.col("display_min").alias("display_name"), F.col("containing_namespace").alias("namespace"), F.col("type_kind").alias("kind"), "accessibility", F.nullif("arity", F.lit(0)).alias("arity"), "file", "line", "col", "project_id")



def type_order() -> list:
    return [F.col("kind"), F.col("display_name"), F.coalesce("arity", F.lit(0)), F.col("symbol_id")]


def types_page(symbols: DataFrame, limit: int | None = None, offset: int | None = None, **filters) -> DataFrame:
    limit, offset = S.page_bounds(limit, offset)
    return page(types(symbols, **filters), type_order(), limit, offset)


def total(df: DataFrame) -> DataFrame:
    """Rows before paging."""
    return df.agg(F.count(F.lit(1)).cast("int").alias("total"))


def members(symbols: DataFrame, type_edges: DataFrame, type_id: str, kind: str | None = None, accessibility: str | None = None, binding: str | None = None, inherited: bool = False) -> DataFrame:
    """Members of a type; with ``inherited`` also those of its base chain and of all interfaces.

    A member id counts once: from the type itself, else its nearest base, else an interface by name.
    """
    kind = S.one_of(kind, S.MEMBER_KINDS, "kind")
    accessibility = S.one_of(accessibility, S.ACCESSIBILITIES, "accessibility", dashes=True)
    binding = S.one_of(binding, S.BINDINGS, "binding")
    df = symbols.where(F.col("member_kind").isin(*S.MEMBER_KINDS) & ~((F.col("member_kind") == "field") & F.coalesce("is_implicit", F.lit(False))))
    if kind:
        df = df.where(F.col("member_kind") == kind)
    if accessibility:
        df = df.where(F.col("accessibility") == accessibility)
    if binding:
        df = df.where(F.coalesce("is_static", F.lit(False)) == F.lit(binding == "static"))
    owned = F.col("containing_type_id") == type_id
    if not inherited:
        df = df.where(owned).withColumn("is_inherited", F.lit(False))
    else:
        owners = ancestry(type_edges, type_id)
        df = df.join(owners, df["containing_type_id"] == owners["id"])
        df = keep_first(df, ["symbol_id"], [F.col("owner_rank"), F.col("distance"), F.col("id")])
        df = df.withColumn("is_inherited", ~owned)
    name = F.when(F.col("member_kind") == "ctor", F.element_at(F.split("containing_type_fq", "\\."), -1)).otherwise(F.col("name"))
    return df.select("symbol_id", name.alias("name"), F.col("display_min").alias("signature"), F.col("member_kind").alias("kind"), "accessibility", "is_static", "is_inherited", "file", "line", "col")


def member_order() -> list:
    return [F.col("kind"), F.col("name"), F.col("signature"), F.col("symbol_id")]


def members_page(*args, limit: int | None = None, offset: int | None = None, **filters) -> DataFrame:
    limit, offset = S.page_bounds(limit, offset)
    return page(members(*args, **filters), member_order(), limit, offset)


def member_shape(symbols: DataFrame) -> DataFrame:
    """Members of each type by kind."""
    n = lambda k: F.count_if(F.col("member_kind") == k).cast("int")
    return symbols.where(F.col("containing_type_id").isNotNull()).groupBy(F.col("containing_type_id").alias("type_id")).agg(n("method").alias("methods"), n("property").alias("properties"), n("field").alias("fields"))


def outline(symbols: DataFrame, nesting: DataFrame, root: str, depth: int = 1) -> DataFrame:
    """Distinct outline rows of the members in types nested up to ``depth`` (1 to 3).

    ``nesting`` is (type_id, parent_id).  Implicit members and accessors are left out.
    """
    depth = min(max(depth, 1), 3)
    level = nesting.where(F.col("type_id") == root).select(F.col("type_id").alias("id")).union(nesting.where(F.col("parent_id") == root).select(F.lit(root))).distinct()
    owners = level
    for _ in range(depth - 1):
        level = nesting.join(level, nesting["parent_id"] == level["id"], "left_semi").select(F.col("type_id").alias("id"))
        owners = owners.unionByName(level)
    shown = symbols.where(F.col("member_kind").isNotNull() & ~F.coalesce("is_implicit", F.lit(False)) & ~F.coalesce("is_accessor", F.lit(False)))
    return shown.join(owners.distinct(), F.col("containing_type_id") == F.col("id"), "left_semi").select("name", F.col("member_kind").alias("kind"), F.col("display_min").alias("signature"), "accessibility", "is_static").distinct()

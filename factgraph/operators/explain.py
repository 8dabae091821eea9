"""Explanation text of symbols, put together from facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

COLLABORATORS = 3


def _plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def collaborators(members: DataFrame) -> DataFrame:
    """type_id and the first three distinct types that each type works with, joined by commas.

    Types of constructor parameters come first, then those of fields, then those of properties, each
    in order of place; types without a name are left out.
    """
    kind = F.col("member_kind")
    rank = F.when((kind == "ctor") & ~F.coalesce("is_static", F.lit(False)), 0).when(kind == "field", 1).when(kind == "property", 2)
    written = F.when(kind == "ctor", F.col("param_types")).otherwise(F.array("return_type"))
    rows = members.where(rank.isNotNull() & F.col("containing_type_id").isNotNull()).select(F.col("containing_type_id").alias("type_id"), rank.alias("rank"), "file", "line", "col", "symbol_id", F.posexplode(written).alias("at", "written"))
    named = rows.withColumn("name", S.type_name(F.col("written"))).where(F.trim("name") != "")
    first = named.groupBy("type_id", "name").agg(F.min(F.struct("rank", "file", "line", "col", "symbol_id", "at")).alias("place"))
    top = first.withColumn("n", F.row_number().over(Window.partitionBy("type_id").orderBy("place"))).where(F.col("n") <= COLLABORATORS)
    in_order = F.sort_array(F.collect_list(F.struct("n", "name")))
    return top.groupBy("type_id").agg(F.array_join(F.transform(in_order, lambda r: r["name"]), ", ").alias("collaborators"))


def role_text(symbols: DataFrame, shape: DataFrame, reference_counts: DataFrame, partners: DataFrame | None = None) -> DataFrame:
    """symbol_id and a short text on what the symbol is and how much depends on it.

    ``shape`` has methods, properties and fields by type_id; ``reference_counts`` has n by symbol_id;
    ``partners`` are ``collaborators``.
    Symbols may tell is_abstract, has_setter, is_const and is_readonly.  The sentences are fixed values.
    """
    tells = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in symbols.columns else F.lit(False)
    df = symbols.join(shape.withColumnRenamed("type_id", "symbol_id"), "symbol_id", "left").join(reference_counts, "symbol_id", "left")
    works_with = F.lit("")
    if partners is not None:
        df = df.join(partners.withColumnRenamed("type_id", "symbol_id"), "symbol_id", "left")
        works_with = F.coalesce(F.concat(F.lit("Key collaborators: "), "collaborators", F.lit(". ")), F.lit(""))
    n = F.coalesce("n", F.lit(0))
    responsibility = (
        F.when(F.col("type_kind") == "interface", "defines the contract")
        .when((F.col("type_kind") == "class") & tells("is_abstract"), "provides a reusable base abstraction")
        .when(F.col("type_kind") == "class", "owns the runtime behavior")
        .when(F.col("type_kind") == "struct", "packages value-oriented state")
        .when(F.col("type_kind") == "enum", "declares the allowed value set")
        .otherwise("represents the symbol's primary abstraction")
    )
    members = F.coalesce(F.col("methods") + F.col("properties") + F.col("fields"), F.lit(0))
    has = F.when(members == 0, "It has no top-level members").otherwise(F.concat(F.lit("It exposes "), F.col("methods"), F.lit(" methods, "), F.col("properties"), F.lit(" properties, and "), F.col("fields"), F.lit(" fields")))
    impact = F.when(n == 0, "It currently has no discovered incoming references.").otherwise(F.concat(F.lit("Edits likely affect "), n, F.lit(" referencing location"), _plural(n), F.lit(".")))
    of_type = F.concat("name", F.lit(" is a "), "type_kind", F.lit(" in "), F.coalesce("containing_namespace", F.lit("the global namespace")), F.lit(" that "), responsibility, F.lit(". "), has, F.lit(". "), works_with, impact)
    used = F.concat(F.lit("is referenced from "), n, F.lit(" location"), _plural(n), F.lit("."))
    owner = F.coalesce(F.element_at(F.split("containing_type_fq", "\\."), -1), F.lit("its containing type"))
    takes = F.coalesce(F.nullif(F.array_join(F.transform("param_types", S.type_name), ", "), F.lit("")), F.lit("no parameters"))
    called = F.when(n == 0, "No discovered call sites reference it yet.").otherwise(F.concat(F.lit("It "), used))
    of_method = F.concat("name", F.lit(" is a method on "), owner, F.lit(" that returns "), F.coalesce(S.type_name(F.col("return_type")), F.lit("Void")), F.lit(" and works with "), takes, F.lit(". "), called)
    kind = F.coalesce(S.type_name(F.col("return_type")), F.lit("Object"))
    access = F.when(tells("has_setter"), "read/write").otherwise("read-only")
    of_property = F.concat("name", F.lit(" is a "), access, F.lit(" property on "), owner, F.lit(" exposing "), kind, F.lit(". It "), used)
    storage = F.when(tells("is_const"), "constant value").when(tells("is_readonly"), "read-only state").otherwise("mutable state")
    of_field = F.concat("name", F.lit(" is "), storage, F.lit(" on "), owner, F.lit(" with type "), kind, F.lit(". It "), used)
    of_rest = F.concat(F.coalesce("member_kind", "kind"), F.lit(" '"), "name", F.lit("' "), used)
    return df.select("symbol_id", F.when(F.col("type_kind").isNotNull(), of_type).when(F.col("member_kind") == "method", of_method).when(F.col("member_kind") == "property", of_property).when(F.col("member_kind") == "field", of_field).otherwise(of_rest).alias("role"))

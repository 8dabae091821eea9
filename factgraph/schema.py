"""Schemas of the fact tables: ten core tables and four helpers, one set of rows per snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "i": T.IntegerType(), "b": T.BooleanType(), "a": T.ArrayType(T.StringType())}


def _schema(**kinds: str) -> T.StructType:
    """Fields by kind: each keyword lists the names of one kind."""
    return T.StructType([T.StructField(name, _TYPES[kind[0]]) for kind, names in kinds.items() for name in names.split()])


FACTS: dict[str, T.StructType] = {
    "projects": _schema(s="project_id name path", i="snapshot_version"),
    "project_refs": _schema(s="src_project_id dst_project_id"),
    "documents": _schema(s="document_id project_id path text source_kind"),
    "symbols": _schema(
        s="symbol_id name kind type_kind member_kind containing_type_id containing_type_fq containing_namespace accessibility display_min display_fq display_err return_type project_id file",
        b="is_static is_partial is_abstract is_implicit is_accessor in_source has_setter is_const is_readonly",
        i="arity line col end_line end_col",
        a="param_types",
    ),
    "type_edges": _schema(s="type_id parent_id edge_kind"),
    "impl_edges": _schema(s="symbol_id impl_id"),
    "refs": _schema(s="symbol_id document_id project_id file", i="line col"),
    "calls": _schema(s="from_id to_id file", i="line col"),
    "diagnostics": _schema(s="code severity message category file project_id document_id", i="line col span_start span_len"),
    "metrics": _schema(s="symbol_id", i="complexity line_count"),
    "nodes": _schema(s="document_id node_kind", i="node_id parent_id start_line start_col end_line end_col span_start span_len"),
    "actions": _schema(s="title category origin provider_key file diagnostic_id refactoring_id", i="span_start span_len line col"),
    "words": _schema(s="name document_id"),
    "usings": _schema(s="document_id project_id alias target", b="everywhere"),
}


def conform(name: str, df: DataFrame) -> DataFrame:
    """The columns of a fact table, missing ones as null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in FACTS[name].fields])

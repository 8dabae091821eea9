"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, filter_audit, importance, licenses, line_dedup, ngram_join, quality, substring_dedup
from .byte_dedup import byte_dedup_query
from .common import table
from .decontamination import decontamination_query
from .language_id import identify
from .mixing import mix_sources
from .ngram_join import near_duplicates
from .pii import pii_query
from .substring_dedup import substring_dedup_query
from .token_output import token_output


def op1_pii(spark, sf_dir):
    return pii_query(table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    return quality.quality_query(table(spark, sf_dir, "documents"))


def op3_byte_dedup(spark, sf_dir):
    return byte_dedup_query(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).drop("mark")


def op5_substring_dedup(spark, sf_dir):
    return substring_dedup_query(table(spark, sf_dir, "documents"))


def op6_token_output(spark, sf_dir):
    return token_output(table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return decontamination_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup_query(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_licenses(spark, sf_dir):
    return licenses.license_query(table(spark, sf_dir, "documents"))


def op12_importance(spark, sf_dir):
    return importance.importance_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_quality, op3_byte_dedup, op4_mixing, op5_substring_dedup, op6_token_output, op7_decontamination, op8_language_id, op9_line_dedup, op10_ngram_join,
        op11_licenses, op12_importance, op13_filter_audit,
    )
}
ORACLE_SQL = {
    "op2_quality": quality.ORACLE_SQL,
    "op5_substring_dedup": substring_dedup.ORACLE_SQL,
    "op7_decontamination": decontamination.ORACLE_SQL,
    "op9_line_dedup": line_dedup.ORACLE_SQL,
    "op10_ngram_join": ngram_join.ORACLE_SQL,
    "op11_licenses": licenses.ORACLE_SQL,
    "op12_importance": importance.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}

"""Code smells: anchors joined with action spans, policy, filters, dedup; and code fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions import scalars as S
from ..plans.shapes import keep_first, range_join

MAX_ANCHORS = 500


def anchors(diagnostics: DataFrame, nodes: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Anchor positions: diagnostics first, then syntax nodes; the first per place."""
    df = diagnostics.select("file", F.col("line").alias("line"), F.col("col").alias("col"), F.col("span_start").alias("at"), F.lit(0).alias("block"), F.col("code").alias("anchor"))
    if nodes is not None:
        df = df.unionByName(nodes.select(F.col("document_id").alias("file"), F.col("start_line").alias("line"), F.col("start_col").alias("col"), F.col("span_start").alias("at"), F.lit(1).alias("block"), F.col("node_kind").alias("anchor")))
    df = keep_first(df, [F.upper("file"), "line", "col"], [F.col("block"), F.col("anchor"), F.col("at")])
    return df if most is None else first_anchors(df, most)


def first_anchors(anchor_rows: DataFrame, most: int = MAX_ANCHORS) -> DataFrame:
    return anchor_rows.orderBy("block", "file", "line", "col", "anchor").limit(most)


def matches(anchor_rows: DataFrame, actions: DataFrame, profile: str | None = None) -> DataFrame:
    """Smell matches: each action at each anchor that its span holds, with normal category and risk."""
    spans = actions.select("file", "title", "category", "origin", "provider_key", "diagnostic_id", "span_start", "span_len")
    hit = range_join(anchor_rows, spans, "file", "at", "span_start", "span_len")
    verdict = S.policy(F.col("provider_key"), F.col("origin"), F.col("category"), F.col("diagnostic_id"), profile)
    hit = hit.withColumn("policy", verdict)
    kind = S.category(F.col("category"), F.col("origin"))
    return hit.select("file", "line", "col", "block", "title", kind.alias("category"), "origin", S.risk(F.col("policy.risk"), F.col("origin"), F.col("category")).alias("risk"), F.col("policy.decision").alias("decision"))


def unanswered(anchor_rows: DataFrame, found: DataFrame) -> DataFrame:
    """A match of its own for each diagnostic anchor at which no action was found."""
    alone = anchor_rows.where("block = 0").join(found.select("file", "line", "col").distinct(), ["file", "line", "col"], "left_anti")
    kind, origin = F.lit("analyzer"), F.lit(S.DIAGNOSTIC_ORIGIN)
    return alone.select("file", "line", "col", "block", F.concat(F.lit("Diagnostic: "), "anchor").alias("title"), S.category(kind, origin).alias("category"), origin.alias("origin"), S.risk(F.lit("info"), origin, kind).alias("risk"), F.lit("allow").alias("decision"))


def chosen(found: DataFrame, risks: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    df = found
    if risks is not None:
        df = df.where(F.lower("risk").isin(*[r.lower() for r in risks]))
    if categories is not None:
        df = df.where(F.lower("category").isin(*[c.lower() for c in categories]))
    return df


def first_found(found: DataFrame, most: int) -> DataFrame:
    """The first matches in order of discovery, cut before the dedup."""
    order = [F.col("block"), F.col("file"), F.col("line"), F.col("col"), F.when(F.col("decision") == "allow", 0).otherwise(1), S.risk_rank(F.col("risk")), F.col("title"), F.col("category"), F.col("origin"), F.col("risk")]
    return found.orderBy(*order).limit(max(most, 0))


def dedup(found: DataFrame) -> DataFrame:
    """One match per file, line, title, category, origin and risk: the leftmost."""
    kept = keep_first(found, [F.upper("file"), "line", "title", "category", "origin", "risk"], [F.col("col"), F.col("file")])
    return kept.select("file", "line", "col", "title", "category", "origin", "risk")


def policy_decisions(actions: DataFrame, profile: str | None = None) -> DataFrame:
    verdict = S.policy(F.col("provider_key"), F.col("origin"), F.col("category"), F.col("diagnostic_id"), profile)
    return actions.select("file", "span_start", "origin", "category", "diagnostic_id", verdict.alias("p")).select("file", "span_start", "origin", "category", "diagnostic_id", "p.decision", "p.risk", "p.reason")


def action_ids(actions: DataFrame, version: int = 1, profile: str = "default") -> DataFrame:
    return actions.withColumn("action_id", codecs.action_id(version, profile, {c: F.col(c) for c in actions.columns}))


def parsed_action_ids(ids: DataFrame) -> DataFrame:
    """action_id and its fields ``a``; ids that aren't any are left out."""
    parts = ids.select("action_id", codecs.split_id(F.col("action_id")).alias("parts")).withColumn("texts", codecs.decoded(F.col("parts")))
    # exploded, and not filtered: a filter would go below the steps and have each id split and decoded again for it
    known = F.filter(F.array(codecs.parse_action_id(F.col("parts"), F.col("texts"))), lambda a: a.isNotNull())
    return parts.select("action_id", F.explode(known).alias("a"))


def code_fixes(diagnostics: DataFrame, version: int = 1, ids: list[str] | None = None, category: str | None = None) -> DataFrame:
    """Distinct fixes of supported diagnostics in scope."""
    df = diagnostics.where(F.upper("code").isin(*S.SUPPORTED_FIXES))
    if ids:
        df = df.where(F.upper("code").isin(*[i.strip().upper() for i in ids]))
    kind = F.coalesce(S.normalize_optional(F.lower("category")), F.lit(S.FIX_CATEGORY))
    df = df.withColumn("fix_category", kind)
    if category:
        df = df.where(F.col("fix_category") == category.strip().lower())
    ident = codecs.fix_id(version, F.col("code"), F.col("span_start"), F.col("span_len"), F.col("file"))
    return df.select(ident.alias("fix_id"), F.concat(F.lit("Remove unused local ("), F.col("code"), F.lit(")")).alias("title"), F.col("code").alias("diagnostic_id"), F.col("fix_category").alias("category"), "file", "line", "col").distinct()


def stale(ids: DataFrame, version: int) -> DataFrame:
    """Action ids with whether another snapshot made them; ids that aren't any are left out."""
    parsed = parsed_action_ids(ids)
    return parsed.select("action_id", F.col("a.version").alias("version"), (F.col("a.version") != version).alias("is_stale"))

"""Refactorings and cleanup: actions at a position, text rewrites of whole documents, and their sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import codecs
from ..functions import scalars as S
from ..plans.shapes import cut_lineage
from ..sources import csharp, lexer, rules
from .rewrite import apply_edits

UNUSED_USING = "CS8019"
#: The steps of a cleanup, in order.
STEPS = ("remove_unused_usings", "organize_usings", "remove_unused_locals")
#: Fixed value: how often the rules of a step run again.
PASSES = 3


def actions_at(actions: DataFrame, path: str, position: int, selection: tuple[int, int] | None = None, version: int = 1, profile: str = "default") -> DataFrame:
    """Distinct actions whose span holds the position and meets the selection, with policy and id."""
    if position < 0:
        raise QueryError("invalid_input", "the position must not be negative", parameter="position")
    start, end = F.col("span_start"), F.col("span_start") + F.col("span_len")
    df = actions.where(S.same_ignoring_case(F.col("file"), path) & (start <= position) & (end > position))
    if selection is not None:
        a, b = selection[0], selection[0] + selection[1]
        overlaps = (F.greatest(start, F.lit(a)) < F.least(end, F.lit(b))) | ((start >= a) & (start < b)) | ((start <= a) & (end > a))
        df = df.where(overlaps)
    df = df.dropDuplicates(["file", "span_start", "span_len", "title", "category", "provider_key"])
    verdict = S.policy(F.col("provider_key"), F.col("origin"), F.col("category"), F.col("diagnostic_id"), profile)
    ident = codecs.action_id(version, profile, {c: F.col(c) for c in actions.columns})
    return df.withColumn("p", verdict).select(ident.alias("action_id"), "file", "span_start", "span_len", "title", "category", "provider_key", "origin", "p.decision", "p.risk")


def parsed_id(spark: SparkSession, action_id: str) -> Row:
    """The fields of an action's id."""
    fields = spark.range(1).select(codecs.split_id(F.lit(action_id)).alias("parts")).select(codecs.parse_action_id(F.col("parts")).alias("a")).first()["a"]
    if fields is None:
        raise QueryError("action_not_found", "the id is no action id", actionId=action_id)
    return fields


def found_again(actions: DataFrame, old: Row, start: int, version: int) -> str:
    """The id of the action at a place that is the old one: of the same key, else about the same diagnostic or refactoring."""
    same = lambda c: F.col(c).eqNullSafe(F.lit(old[c]))
    there = actions.where(same("file") & (F.col("span_start") == start) & same("span_len") & same("origin") & same("category"))
    rank = F.when(same("provider_key"), 0).when(same("diagnostic_id") & same("refactoring_id") & F.coalesce("diagnostic_id", "refactoring_id").isNotNull(), 1)
    ident = codecs.action_id(version, old["profile"], {c: F.col(c) for c in actions.columns})
    row = there.where(rank.isNotNull()).orderBy(rank, "title", "provider_key").select(ident.alias("id")).first()
    if row is None:
        raise QueryError("action_not_found", "the action isn't offered any more", file=old["file"])
    return row["id"]


def require_action(actions: DataFrame, action_id: str, version: int) -> DataFrame:
    """The action of an id on the current snapshot; ids of other snapshots and blocked ones are errors."""
    fields = parsed_id(actions.sparkSession, action_id)
    if fields["version"] != version:
        raise QueryError("workspace_changed", "the action is of another snapshot", expected=str(version), actual=str(fields["version"]))
    found = actions.where((F.col("file") == fields["file"]) & (F.col("span_start") == fields["span_start"]) & (F.col("span_len") == fields["span_len"]) & (F.col("provider_key") == fields["provider_key"]) & (F.col("origin") == fields["origin"]))
    if found.isEmpty():
        raise QueryError("action_not_found", "the action is gone", actionId=action_id)
    return found.limit(1)


def statements_of(documents: DataFrame) -> DataFrame:
    """Statements of documents (path, text), see ``csharp.statements``."""
    return csharp.statements(lexer.grouped(_whole(documents), whole=False))


def _whole(documents: DataFrame) -> DataFrame:
    """Documents with all columns that parsing needs."""
    return documents if "project_id" in documents.columns else documents.withColumn("project_id", F.lit(None).cast("string"))


def organize_usings_edits(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Edits that sort the using directives of each block of a document in the places where they stand.

    Aliases come first, static ones last, then the order is by name.  Directives of one namespace
    block never move to another, as places and directives meet by document, block and rank.
    """
    plain, aliased = F.col("header").rlike(csharp.USING), (F.col("ender") == "=") & F.col("header").rlike("^(?:global )?using \\S+$")
    found = rows.where((plain | aliased) & (F.col("line") == F.col("end_line"))).join(documents.select("document_id", "text"), "document_id")
    written = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    target = F.when(aliased, F.coalesce("value", F.lit(""))).otherwise(F.regexp_extract("header", csharp.USING, 4))
    alias = F.when(aliased, F.regexp_extract("header", "(\\S+)$", 1)).otherwise("")
    keyed = found.select("document_id", "path", "owner", "head", "line", "col", written.alias("written"), F.struct((~aliased).alias("a"), (F.regexp_extract("header", csharp.USING, 2) != "").alias("b"), F.replace(target, F.lit(" "), F.lit("")).alias("c"), alias.alias("d"), F.col("head").alias("e")).alias("key"))
    block = ["document_id", "owner"]
    places = keyed.select("document_id", "path", "owner", "line", "col", F.col("written").alias("old_text"), F.row_number().over(W.partitionBy(*block).orderBy("head")).alias("n"))
    ranked = keyed.select("document_id", "owner", F.col("written").alias("new_text"), F.row_number().over(W.partitionBy(*block).orderBy("key")).alias("n"))
    moved = places.join(ranked, [*block, "n"]).where("old_text <> new_text")
    return moved.select("path", "line", "col", F.length("old_text").cast("int").alias("length"), "new_text", "old_text")


def _removals(rows: DataFrame) -> DataFrame:
    """Edits that take out whole statements."""
    return rows.select("path", "line", "col", (F.col("end") - F.col("start")).cast("int").alias("length"), F.lit("").alias("new_text"), F.lit(None).cast("string").alias("old_text")).distinct()


def unused_using_edits(rows: DataFrame, diagnostics: DataFrame) -> DataFrame:
    at = diagnostics.where(F.upper("code") == UNUSED_USING).select(F.col("file").alias("path"), "line").distinct()
    return _removals(rows.where(F.col("header").rlike("^(?:global )?using ")).join(at, ["path", "line"]))


def unused_local_edits(rows: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Edits that take out the declarations of unused locals, wherever they stand."""
    at = diagnostics.where(F.upper("code").isin(*S.SUPPORTED_FIXES)).select(F.col("file").alias("path"), "line").distinct()
    return _removals(rows.where(F.col("header").rlike(csharp.LOCAL) & F.col("ender").isin("=", ";")).join(at, ["path", "line"]))


def use_var_edits(chosen: DataFrame) -> DataFrame:
    """Edits of actions (file, line, col, span_len) that write ``var`` for a type."""
    return chosen.select(F.col("file").alias("path"), "line", "col", F.col("span_len").alias("length"), F.lit("var").alias("new_text"))


def _applied(documents: DataFrame, todo: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All documents after edits to those of ``todo``, and the documents that changed."""
    done = apply_edits(todo, edits).where("edit_count > 0").select("document_id", F.col("text").alias("new_text"))
    changed = cut_lineage(todo.join(done, "document_id").where("text <> new_text").withColumn("text", F.col("new_text")).select(*documents.columns))
    return documents.join(changed.select("document_id"), "document_id", "left_anti").unionByName(changed), changed


def cleanup(documents: DataFrame, diagnostics: DataFrame, version: int, expected_version: int | None = None, profile: str | None = None, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """Documents after the cleanup steps, and the paths whose text changed.

    Unused usings go by the diagnostics given, once.  Unused locals go by the diagnostics given and
    then, as long as documents change and for ``passes`` passes at most, by the rules run again on the documents that
    the pass before changed, as one local may have been read by another only.  Usings are sorted last.
    A version that isn't the expected one is an error before any step; only the balanced profile is known.
    """
    if (profile or "balanced").strip().lower() != "balanced":
        raise QueryError("invalid_request", "the cleanup profile must be balanced", profile=profile)
    if expected_version is not None and expected_version != version:
        raise QueryError("workspace_changed", "the snapshot isn't the expected one", expected=str(expected_version), actual=str(version))
    before = documents
    rows = cut_lineage(statements_of(documents))
    edits = unused_using_edits(rows, diagnostics).unionByName(unused_local_edits(rows, diagnostics))
    documents, _ = _applied(documents, documents, edits)
    todo = documents = cut_lineage(documents)
    for _ in range(passes):
        parsed = csharp.parse(_whole(todo))
        found, _ = rules.run(parsed)
        after, todo = _applied(documents, todo, unused_local_edits(parsed["statements"], found))
        if todo.isEmpty():
            break
        documents = cut_lineage(after)
    documents = cut_lineage(_applied(documents, documents, organize_usings_edits(statements_of(documents), documents))[0])
    changed = documents.join(before.select("document_id", F.col("text").alias("old_text")), "document_id").where(~F.col("text").eqNullSafe(F.col("old_text")))
    return documents, changed.select("path")


def missing_files(documents: DataFrame, listing: DataFrame) -> DataFrame:
    """Rooted paths of documents that a file listing (path) lacks, without regard to case."""
    rooted = documents.where(F.col("path").rlike("^(/|[A-Za-z]:[\\\\/])")).select("path", F.upper("path").alias("key"))
    return rooted.join(listing.select(F.upper("path").alias("key")).distinct(), "key", "left_anti").groupBy("key").agg(F.min("path").alias("path")).select("path")

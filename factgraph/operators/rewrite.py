"""Rewrites: rename with conflict check, text edits, and what they change."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import QueryError

#: Documents whose edits are Python objects at a time.
EDITED_ROWS = 64
IDENTIFIER = re.compile(r"@?[^\W\d]\w*\Z")
#: The reserved words of C#, which are names only behind an at sign.
RESERVED = frozenset(
    """abstract as base bool break byte case catch char checked class const continue decimal default delegate do double
    else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is
    lock long namespace new null object operator out override params private protected public readonly ref return sbyte
    sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe
    ushort using virtual void volatile while""".split()
)


def check_identifier(name: str | None) -> str:
    if name is None or not IDENTIFIER.match(name) or name in RESERVED:
        raise QueryError("invalid_new_name", "the new name isn't an identifier", value=name)
    return name


def conflicts(symbols: DataFrame, renames: DataFrame) -> DataFrame:
    """Renames (symbol_id, new_name) that clash with a sibling.

    A sibling has the same container, the new name and the same kind; methods clash only with
    equal parameter types.
    """
    named = symbols.select(
        "symbol_id", "name", F.coalesce("member_kind", "kind").alias("what"), F.coalesce("containing_type_id", "containing_namespace", F.lit("")).alias("container"),
        F.when(F.col("member_kind") == "method", F.array_join(F.coalesce("param_types", F.array().cast("array<string>")), ",")).otherwise("").alias("shape"),
    )
    moved = named.join(renames, "symbol_id").select(F.col("symbol_id").alias("renamed_id"), F.col("new_name").alias("name"), "what", "container", "shape")
    met = moved.join(named, ["container", "name", "what", "shape"]).where(F.col("symbol_id") != F.col("renamed_id"))
    return met.select(F.col("renamed_id").alias("symbol_id"), F.col("symbol_id").alias("conflict_id"), "name").distinct()


def affected(symbols: DataFrame, refs: DataFrame, symbol: str) -> DataFrame:
    """Distinct places of a symbol's declaration and of its references."""
    own = symbols.where((F.col("symbol_id") == symbol) & F.col("file").isNotNull()).select("file", "line", "col")
    return own.unionByName(refs.where(F.col("symbol_id") == symbol).select("file", "line", "col")).distinct()


def rename_edits(places: DataFrame, old: str, new: str) -> DataFrame:
    """Edits (path, line, col, length, new_text, old_text) of a rename; a verbatim name keeps its at sign."""
    return places.select(F.col("file").alias("path"), "line", "col", F.lit(len(old)).alias("length"), F.lit(new).alias("new_text"), F.lit(old).alias("old_text"))


def _applied(text: str, todo: list[tuple]) -> tuple[str, int]:
    """A text after its edits (line, col, length, new_text, old_text) and their number; -1 if one doesn't meet its old text or another edit."""
    starts = [0]
    for row in text.split("\n"):
        starts.append(starts[-1] + len(row) + 1)
    spans = sorted((starts[line - 1] + col - 1, length, new, old) if line < len(starts) else (len(text) + 1, 0, "", "") for line, col, length, new, old in todo)
    out, at = [], 0
    for start, length, new, old in spans:
        if start < at or start + length > len(text) or (old is not None and text[start : start + length] != old):
            return text, -1
        out += [text[at:start], new]
        at = start + length
        if not new and not "".join(out).rpartition("\n")[2].strip() and text[at : at + 1] in ("", "\n"):
            # a line of which nothing is left but blanks loses these
            kept = "".join(out)
            out = [kept[: len(kept) - len(kept.rpartition("\n")[2])]]
    return "".join(out) + text[at:], len(todo)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (document_id, path, text, edits) -> (document_id, path, text, edit_count); few rows at a time are Python objects, as each edit takes some hundred bytes."""
    for batch in batches:
        for a in range(0, batch.num_rows, EDITED_ROWS):
            part = batch.slice(a, EDITED_ROWS)
            done = [_applied(text or "", [(e["line"], e["col"], e["length"], e["new_text"], e["old_text"]) for e in todo]) for text, todo in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            texts, counts = pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1).cast(pa.string()), texts, counts], names=["document_id", "path", "text", "edit_count"])


def apply_edits(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """Documents with their edits applied and the number of edits; unchanged ones as they are.

    Edits are gathered per document (never more than its places) and must not overlap.  Where one has an
    ``old_text`` that doesn't stand at its place, or two overlap, the document stays as it is and edit_count is -1.
    Texts without an edit don't pass through Python.
    """
    if "old_text" not in edits.columns:
        edits = edits.withColumn("old_text", F.lit(None).cast("string"))
    per_document = edits.groupBy("path").agg(F.collect_set(F.struct("line", "col", "length", "new_text", "old_text")).alias("edits"))

    edited = documents.join(per_document, "path").select("document_id", "path", "text", "edits").mapInArrow(_edited, "document_id string, path string, text string, edit_count int")
    untouched = documents.join(edits.select("path").distinct(), "path", "left_anti").select("document_id", "path", F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("edit_count"))
    return edited.unionByName(untouched)


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose text differs, with their edit counts."""
    old = before.select("document_id", F.col("text").alias("old_text"))
    return after.join(old, "document_id").where(~F.col("text").eqNullSafe(F.col("old_text"))).select("path", "edit_count")


def document_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents that differ between two versions: document_id, path, change (added, removed, changed).  Hashes of the texts are joined, not the texts."""
    known = lambda df, name: df.select("document_id", F.col("path").alias(f"{name}_path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias(name))
    met = known(before, "old").join(known(after, "new"), "document_id", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return met.select("document_id", F.coalesce("new_path", "old_path").alias("path"), change.alias("change"))


def line_moves(texts: DataFrame) -> DataFrame:
    """Where the lines of changed texts (document_id, old, new) stand now: document_id, line, new_line, start, new_start, length.

    Lines before the first difference and behind the last one keep their order; between these a line
    is found again if its text stands there once in each version.  Both sides have one row a key (place in
    the common head, place in the common tail, or the line itself), so the join forms no pairs of repeated lines.
    """
    old, new = F.split("old", "\n"), F.split("new", "\n")
    alike = lambda a, b: (F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False) - 1).cast("int")
    cut = texts.where("old <> new").select("document_id", old.alias("old"), new.alias("new"), alike(old, new).alias("head"), alike(F.reverse(old), F.reverse(new)).alias("tail"))
    cut = cut.withColumn("tail", F.least("tail", F.least(F.size("old"), F.size("new")) - F.col("head")))

    def side(name: str, line: str, start: str) -> DataFrame:
        rows = cut.select("document_id", "head", "tail", F.size(name).alias("n"), F.posexplode(name).alias("at", "text"))
        upto = F.sum(F.length("text") + 1).over(W.partitionBy("document_id").orderBy("at"))
        place = lambda zone, at, text: F.struct(F.lit(zone).alias("zone"), at.cast("int").alias("place"), text.alias("text"))
        key = F.when(F.col("at") < F.col("head"), place(0, F.col("at"), F.lit("")))
        key = key.when(F.col("at") >= F.col("n") - F.col("tail"), place(1, F.col("n") - F.col("at"), F.lit(""))).otherwise(place(2, F.lit(0), F.col("text")))
        keyed = rows.select("document_id", key.alias("key"), (F.col("at") + 1).alias(line), (upto - F.length("text") - 1).cast("int").alias(start), F.length("text").alias("length"))
        once = keyed.groupBy("document_id", "key").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in (line, start, "length")])
        return once.where("n = 1").drop("n")

    return side("old", "line", "start").join(side("new", "new_line", "new_start").drop("length"), ["document_id", "key"]).drop("key")


def carried(spans: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Spans (file, line, span_start, span_len and more) of one version's documents, with their new_line and new_start in another's.

    Left out are spans whose document is gone, whose line changed or isn't told from others, and
    spans that reach beyond their line in a changed document.
    """
    there = after.select("path").distinct()
    changes = document_changes(before, after).where("change <> 'added'").select("document_id", "path")
    text = lambda df, name: df.join(changes.select("document_id"), "document_id", "left_semi").select("document_id", "path", F.coalesce("text", F.lit("")).alias(name))
    texts = text(before, "old").dropDuplicates(["path"]).join(text(after, "new").select("document_id", "new"), "document_id")
    moves = line_moves(texts.select("document_id", "old", "new")).join(texts.select("document_id", F.col("path").alias("file")), "document_id").drop("document_id")
    stay = spans.join(there.select(F.col("path").alias("file")), "file", "left_semi").join(changes.select(F.col("path").alias("file")), "file", "left_anti")
    stay = stay.select(*spans.columns, F.col("line").alias("new_line"), F.col("span_start").alias("new_start"))
    offset = F.col("span_start") - F.col("start")
    went = spans.join(moves, ["file", "line"]).where((offset >= 0) & (offset + F.col("span_len") <= F.col("length")))
    return stay.unionByName(went.select(*spans.columns, "new_line", (F.col("new_start") + offset).alias("new_start")))

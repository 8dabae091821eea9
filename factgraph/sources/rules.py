"""Rules over parsed documents: each gives diagnostics, and a given one that fails doesn't take the others with it.

A rule is a function of the tables of ``csharp.parse`` that returns rows of the diagnostics table.
``RULES`` has those of this front end by name; their failures are raised. More can be given to ``run``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shapes import cut_lineage
from ..schema import FACTS, conform

Rule = Callable[[dict[str, DataFrame]], DataFrame]
CONSTANT = '^(?:""|-? ?[0-9][\\w.]*|true|false|null)$'
COPIED = "^@?[\\p{L}_][\\p{L}\\p{N}_]*$"
#: Code of the rule for catch blocks that hold nothing; of our own, as no compiler reports it.
EMPTY_CATCH = "FG0001"


def _found(rows: DataFrame, code: Column, message: Column, place: Column, length: Column, category: str = "compiler", severity: str = "warning") -> DataFrame:
    return rows.select(code.alias("code"), F.lit(severity).alias("severity"), message.alias("message"), F.lit(category).alias("category"), F.col("path").alias("file"), "project_id", "document_id", place["line"].alias("line"), place["col"].alias("col"), place["start"].alias("span_start"), length.alias("span_len"))


def unread(parsed: dict[str, DataFrame]) -> DataFrame:
    """Locals with no, a constant or another variable's value that are named nowhere else in their member."""
    from .csharp import locals_of

    rows = locals_of(parsed["statements"], parsed["places"]).where((F.col("ender") == ";") | F.col("value").rlike(CONSTANT) | F.col("value").rlike(COPIED))
    where = parsed["places"].where("member_head is not null").select("document_id", "head", "member_head")
    # words of a member are counted if one of its locals is asked about, and only those that such a local is called by
    asked = rows.groupBy("document_id", "member_head").agg(F.collect_set("name").alias("names"))
    asked = where.join(asked, ["document_id", "member_head"])
    times = parsed["tokens"].where(F.col("kind") == "word").select("document_id", "head", F.col("text").alias("name")).join(asked, ["document_id", "head"]).where(F.array_contains("names", F.col("name")))
    times = times.groupBy("document_id", "member_head", "name").agg(F.count(F.lit(1)).alias("times"))
    return rows.join(times.where("times = 1"), ["document_id", "member_head", "name"])


def unused_locals(parsed: dict[str, DataFrame]) -> DataFrame:
    """Locals without a value, or with a constant one, that are never read."""
    rows = parsed["unread"].where((F.col("ender") == ";") | F.col("value").rlike(CONSTANT))
    assigned = F.col("ender") == "="
    message = F.concat(F.lit("The variable '"), "name", F.when(assigned, "' is assigned but its value is never used").otherwise("' is declared but never used"))
    return _found(rows, F.when(assigned, "CS0219").otherwise("CS0168"), message, F.element_at("places", -1), F.length("name"))


def unused_copies(parsed: dict[str, DataFrame]) -> DataFrame:
    """Locals that take over another variable's value and are never read."""
    rows = parsed["unread"].where((F.col("ender") == "=") & F.col("value").rlike(COPIED) & ~F.col("value").rlike(CONSTANT))
    return _found(rows, F.lit("IDE0059"), F.concat(F.lit("Unnecessary assignment of a value to '"), "name", F.lit("'")), F.element_at("places", -1), F.length("name"), "style", "info")


def empty_catches(parsed: dict[str, DataFrame]) -> DataFrame:
    """Catch clauses without a statement in their block."""
    rows = parsed["statements"].where(F.col("header").rlike("^catch( |$)") & (F.col("last") == F.col("body_at") + 1))
    return _found(rows, F.lit(EMPTY_CATCH), F.lit("The catch block is empty"), F.element_at("places", 1), F.lit(5), "style", "info")


RULES: dict[str, Rule] = {"unused_locals": unused_locals, "unused_copies": unused_copies, "empty_catches": empty_catches}


def run(parsed: dict[str, DataFrame], more: Mapping[str, Rule] = {}) -> tuple[DataFrame, dict[str, str]]:
    """Diagnostics of all rules, and what went wrong by the name of each rule of ``more`` that failed.

    Every rule's rows are written before the next one runs, so a failure is known to be that rule's.  A rule of
    the front end that fails, or whose rows can't be written, is an error: fewer rows would look like the result.
    """
    found, failed = [], {}
    spark = parsed["tokens"].sparkSession
    parsed["places"]  # what it and the rules need is written here, as no rule is to blame for it
    for name, rule in {**RULES, **more}.items():
        try:
            found.append(cut_lineage(conform("diagnostics", rule(parsed))))
        except Exception as e:  # a rule may fail in any way
            if name not in more:
                raise
            failed[name] = f"{type(e).__name__}: {e}"[:500]
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], FACTS["diagnostics"])), failed

"""Facts from C# source text: tokens from one pass over each text, everything else by joins.

``lexer.tokens`` gives tokens and statements with true offsets.  Declarations are patterns over a
statement's header, in which tokens stand apart by one blank, so line ends, comments and strings play
no part; names of enclosing namespaces and types come from the statements around it.

Names are bound from the nearest scope outwards: locals (which are no symbols), members of the
enclosing types and of what these derive from, types by namespace and using.  Only types of the own project and
of the projects that it refers to, however far, are seen.  A receiver's type is that of a local,
parameter or member, or a type's name; members behind other receivers are bound if their name and number of arguments is that of one
symbol of the file, the project or all.  What several symbols could be gives no rows.

Lookups are asked once for all tokens of a scope with the same name, and each joins a table that has
one row a key, or one a key and overload; no join goes over a name alone.

What this doesn't do: conversions between argument types, type inference beyond ``new``, extension methods.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import FIX_CATEGORY, FIX_ORIGIN, SUPPORTED_FIXES, USE_VAR_KEY, source_kind
from ..plans.shapes import cut_lineage, keep_first
from ..schema import conform
from . import lexer, rules

#: Modifiers, and words that are no names.
_MODIFIERS = "public|internal|private|protected|static|abstract|sealed|partial|virtual|override|async|readonly|const|extern|unsafe|new|file|required|volatile"
KEYWORDS = tuple(
    f"""abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int
    interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true
    try typeof uint ulong unchecked unsafe ushort using virtual void volatile while var await yield when where get set init add remove nameof record global partial async required file""".split()
)
_NAME = "@?[\\p{L}_][\\p{L}\\p{N}_]*"
_ANGLE = "(?: < (?:[^<>()]|< (?:[^<>()]|< [^<>()]* >)* >)* >)?"
_TYPE = f"(?:ref (?:readonly )?)?(?:\\( [^()]+ \\)|{_NAME}(?: (?:\\.|::) {_NAME})*{_ANGLE}(?: \\. {_NAME}{_ANGLE})*)(?: \\?)?(?: \\[ [, ]*\\])*(?: \\?)?"
_MODS = f"(?:(?:{_MODIFIERS}) )*"
_NOT = "(?!(?:return|throw|await|yield|goto|case|else|using|new|in|is|as|delegate|event|operator|this|base|where|when|out|lock|if|for|foreach|while|switch|namespace|class|struct|interface|enum|get|set|add|remove|global|extern) )"
#: Patterns over headers: what stands before the name, the name, and what a declaration has behind it.
TYPE_DECL = f"^({_MODS}(class|interface|struct|enum|record(?: class| struct)?) )({_NAME})({_ANGLE})(?: \\( (.*?)\\))?(?: : (.*?))?(?: where .*)?$"
#: A type's header has one of these.
TYPE_WORDS = ("class ", "interface ", "struct ", "enum ", "record ", "delegate ")
DELEGATE = f"^({_MODS}delegate {_TYPE} )({_NAME})({_ANGLE}) \\( (.*?)\\)(?: where .*)?$"
NAMESPACE = f"^namespace ({_NAME}(?: \\. {_NAME})*)$"
USING = f"^(global )?using (?:(static) )?(?:({_NAME}) = )?((?:global :: )?{_NAME}(?: \\. {_NAME})*)$"
METHOD = f"^({_MODS}{_NOT}{_TYPE} (?:{_NAME}{_ANGLE} \\. )*)({_NAME})({_ANGLE}) \\( (.*?)\\)(?: where .*)?$"
CTOR = f"^({_MODS})({_NAME})() \\( (.*?)\\)(?: : (?:base|this) \\(.*\\))?$"
PROPERTY = f"^({_MODS}{_NOT}{_TYPE} (?:{_NAME}{_ANGLE} \\. )*)({_NAME})$"
FIELD = f"^({_MODS}{_NOT}{_TYPE} )({_NAME})(?: , .*)?$"
EVENT = f"^({_MODS}event {_TYPE} )({_NAME})(?: , .*)?$"
ENUM_MEMBER = f"^()({_NAME})$"
LOCAL = f"^(?:const )?{_NOT}({_TYPE}) ({_NAME})$"
#: Variables that a header brings: of loops, catches, usings and patterns.
BROUGHT = f"(?:^for(?:each)? \\(|^using \\(|^fixed \\(|^catch \\(|\\bout|\\bis|^using|^await using) ((?:var|{_TYPE})) ({_NAME})(?= |$)"
PARAMETER = f"^(?:\\[ [^\\]]* \\] )*(?:(?:this|ref|out|in|params|scoped|readonly) )*({_TYPE}) ({_NAME})"
#: Words, marks and roles that add one to complexity.
DECISION_WORDS, DECISION_MARKS, DECISION_ROLES = ("if", "for", "foreach", "while", "do", "catch"), ("&&", "||"), ("conditional", "label", "arm")
#: A list's commas that stand outside of brackets.
_COMMA = " , (?![^<]*>)(?![^(]*\\))"
_AT = ["document_id", "head"]
#: Edges of a closure that are followed on the driver, at most.
LOCAL_EDGES = 2000


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Solution files under ``root``, in order of path without regard to case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sln*").load(root).select("path")
    return files.where(F.lower("path").rlike("\\.slnx?$")).select(F.regexp_replace("path", "^file:/*", "/").alias("path")).orderBy(F.upper("path"))


def listed_projects(spark: SparkSession, solution: str) -> DataFrame:
    """Paths of the project files that a solution file lists, in order of place."""
    text = spark.read.format("binaryFile").load(solution).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode("content", "UTF-8").alias("text"))
    found = text.select(F.regexp_replace("path", "[^/]+$", "").alias("folder"), F.explode(F.regexp_extract_all("text", F.lit('"([^"]+\\.csproj)"'), F.lit(1))).alias("listed"))
    return found.select(_joined_path(F.col("folder"), F.col("listed")).alias("path")).distinct()


def _joined_path(folder: Column, listed: Column) -> Column:
    """A path relative to a folder, with its parent steps taken."""
    path = F.concat(folder, F.translate(listed, "\\", "/"))
    for _ in range(8):
        path = F.regexp_replace(F.regexp_replace(path, "/\\./", "/"), "/(?!\\.\\./)[^/]+/\\.\\./", "/")
    return path


def projects(spark: SparkSession, root: str, version: int = 1, solution: str | None = None) -> tuple[DataFrame, DataFrame]:
    """projects and project_refs from the project files under ``root``.

    With a solution that lists projects, only these and what they refer to, however far.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csproj").load(root)
    files = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode("content", "UTF-8").alias("xml"))
    name = F.regexp_extract("path", "([^/]+)\\.csproj$", 1)
    rows = files.select(F.sha2("path", 256).substr(1, 16).alias("project_id"), name.alias("name"), "path", F.lit(version).alias("snapshot_version"), F.regexp_extract_all("xml", F.lit('<ProjectReference\\s+Include="([^"]+)"'), F.lit(1)).alias("refs"))
    folder = F.regexp_replace("path", "[^/]+$", "")
    asked = rows.select(F.col("project_id").alias("src_project_id"), folder.alias("folder"), F.explode("refs").alias("ref")).select("src_project_id", F.upper(_joined_path(F.col("folder"), F.col("ref"))).alias("key"))
    refs = asked.join(rows.select(F.col("project_id").alias("dst_project_id"), F.upper("path").alias("key")), "key").select("src_project_id", "dst_project_id").distinct()
    if solution is not None:
        listed = listed_projects(spark, solution).select(F.upper("path").alias("key"))
        chosen = rows.join(listed, F.upper("path") == F.col("key"), "left_semi").select("project_id")
        if not chosen.isEmpty():
            kept = chosen.unionByName(closure(refs.toDF("type_id", "parent_id")).join(chosen, F.col("type_id") == F.col("project_id"), "left_semi").select(F.col("parent_id").alias("project_id"))).distinct()
            rows = rows.join(kept, "project_id", "left_semi")
            refs = refs.join(kept, F.col("src_project_id") == F.col("project_id"), "left_semi").join(kept, F.col("dst_project_id") == F.col("project_id"), "left_semi")
    return rows.drop("refs"), refs


def documents(spark: SparkSession, root: str, project_rows: DataFrame | None = None) -> DataFrame:
    """Source files under ``root``, each with the project whose folder holds it (the deepest)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.cs").load(root)
    df = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode("content", "UTF-8").alias("text"))
    df = df.select(F.col("path").alias("document_id"), "path", F.regexp_replace("text", "^\\ufeff|\\r", "").alias("text"), source_kind(F.col("path")).alias("source_kind"))
    if project_rows is None:
        return df.withColumn("project_id", F.lit(None).cast("string"))
    folders = project_rows.select("project_id", F.regexp_replace("path", "[^/]+$", "").alias("folder"))
    # every folder above a file is a key, so this is an equi-join
    parts = F.split("path", "/")
    above = df.select("document_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))).alias("folder"))
    owner = above.join(folders, "folder").groupBy("document_id").agg(F.max_by("project_id", F.length("folder")).alias("project_id"))
    return df.join(owner, "document_id", "left")


def closure(edges: DataFrame, most: int = 32, local: int = LOCAL_EDGES) -> DataFrame:
    """(type_id, parent_id, distance) of all that is reached over edges (type_id, parent_id).

    Few edges (``local`` at most, checked) are followed on the driver.  Beyond that the reach doubles
    in each round, which is written; ``most`` rounds are far more than anything is deep.
    """
    edges = edges.select("type_id", "parent_id")
    few = edges.limit(local + 1).collect()
    if len(few) <= local:
        return edges.sparkSession.createDataFrame(_followed(few), "type_id string, parent_id string, distance int")
    reached = edges.select("type_id", "parent_id", F.lit(1).alias("distance")).distinct()
    n = -1
    for _ in range(most):
        reached = cut_lineage(reached)
        before, n = n, reached.count()
        if n == before:
            break
        further = reached.select("type_id", F.col("parent_id").alias("by"), "distance").join(reached.select(F.col("type_id").alias("by"), "parent_id", F.col("distance").alias("more")), "by")
        further = further.where("type_id <> parent_id").select("type_id", "parent_id", (F.col("distance") + F.col("more")).alias("distance"))
        reached = reached.unionByName(further).groupBy("type_id", "parent_id").agg(F.min("distance").alias("distance"))
    return reached


def _followed(edges: list) -> list[tuple[str, str, int]]:
    """What a bounded list of edges reaches, with the least distance."""
    up: dict = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    out = []
    for a in up:
        known, newest, distance = set(), {a}, 0
        while newest:
            distance += 1
            newest = {c for b in newest for c in up.get(b, ())} - known
            known |= newest
            out += [(a, b, distance) for b in sorted(newest) if b != a]
    return out


# --- declarations ------------------------------------------------------------------------------


def _group(pattern: str, i: int) -> Column:
    return F.regexp_extract("header", pattern, i)


def compact(c: Column) -> Column:
    """A type's text without the blanks between its tokens."""
    return F.regexp_replace(F.trim(c), "\\s*([<>\\[\\].?,:()])\\s*", "$1")


def _holds(text: Column) -> Callable[[str], Column]:
    """Whether words stand in a text of tokens, with a blank behind each; ``|`` stands between words of which one is enough."""
    padded = F.concat(F.lit(" "), text)
    return lambda words: reduce(Column.__or__, [padded.contains(f" {w} ") for w in words.split("|")])


def _access(modifiers: Column, default: str | Column) -> Column:
    has = _holds(modifiers)
    return (
        F.when(has("protected") & has("internal"), "protected_internal").when(has("private") & has("protected"), "private_protected").when(has("public"), "public").when(has("internal"), "internal")
        .when(has("protected"), "protected").when(has("private"), "private").otherwise(default)
    )


def statements(rows: DataFrame) -> DataFrame:
    """Statements and declarations: rows of ``lexer.grouped``, or those of first tokens."""
    return rows.where(F.col("header").isNotNull()).select(
        "document_id", "project_id", "path", "head", "owner", "last", "header", "ender", "body_at", "made_type", "value", "scopes", "places", "start", "end", "line", "col", "end_line", "end_col", "role", "in_type"
    )


def _name_place(before: Column) -> Column:
    """The place of the token behind ``before``."""
    return F.element_at("places", F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))) + 1)


def _parameters(listed: Column, group: int) -> Column:
    parts = F.transform(F.split(listed, _COMMA), lambda p: F.regexp_extract(F.trim(p), PARAMETER, group))
    return F.filter(F.transform(parts, compact), lambda p: p != "")


def type_declarations(rows: DataFrame) -> DataFrame:
    """Types with the names of what is around them; their statement's columns stay."""
    # few statements are declarations, and the tests on all of them are costly, so they are done once
    rows = cut_lineage(rows.where((F.col("header").startswith("namespace ") & F.col("header").rlike(NAMESPACE)) | _is_type(F.col("header"))))
    is_delegate = F.col("header").rlike(DELEGATE)
    by = lambda i, j: F.when(is_delegate, _group(DELEGATE, j)).otherwise(_group(TYPE_DECL, i))
    spaces = rows.where(F.col("header").rlike(NAMESPACE)).select("document_id", "head", "ender", F.replace(_group(NAMESPACE, 1), F.lit(" "), F.lit("")).alias("name"))
    types = rows.where(F.col("header").rlike(TYPE_DECL) | is_delegate)
    angle = by(4, 3)
    types = types.withColumn("before", by(1, 1)).withColumn("name", by(3, 2)).withColumn("params", compact(angle)).withColumn("arity", F.when(angle == "", 0).otherwise(F.size(F.split(angle, ","))))
    types = types.withColumn("type_kind", F.when(is_delegate, "delegate").otherwise(F.regexp_extract(_group(TYPE_DECL, 2), "^\\w+", 0))).withColumn("bases", F.when(is_delegate, "").otherwise(_group(TYPE_DECL, 6)))
    around = types.select("document_id", F.col("head").alias("inner"), F.explode("scopes").alias("head"))
    named = spaces.select("document_id", "head", "name", F.lit(True).alias("space")).unionByName(types.select("document_id", "head", "name", F.lit(False).alias("space")))
    outer = around.join(named, _AT).groupBy("document_id", F.col("inner").alias("head")).agg(F.array_sort(F.collect_list(F.struct("head", "name", "space"))).alias("outer"))
    filewide = spaces.where("ender = ';'").groupBy("document_id").agg(F.min("name").alias("filewide"))
    types = types.join(outer, _AT, "left").join(filewide, "document_id", "left")
    names = lambda space: F.transform(F.filter(F.coalesce("outer", F.array().cast("array<struct<head: int, name: string, space: boolean>>")), lambda x: x["space"] == space), lambda x: x["name"])
    types = types.withColumn("namespace", F.nullif(F.concat_ws(".", "filewide", names(True)), F.lit(""))).withColumn("outer_types", names(False))
    fq = F.concat_ws(".", "namespace", "outer_types", "name")
    return types.withColumn("type_fq", fq).withColumn("type_id", F.concat(F.lit("T:"), fq, F.when(F.col("arity") > 0, F.concat(F.lit("`"), "arity")).otherwise(""))).drop("outer", "filewide")


def _is_type(header: Column) -> Column:
    """Whether a header declares a type; the costly patterns are asked about headers with a type's word alone."""
    word = reduce(Column.__or__, [header.contains(w) for w in TYPE_WORDS])
    return word & (header.rlike(TYPE_DECL) | header.rlike(DELEGATE))


def member_declarations(rows: DataFrame, types: DataFrame) -> DataFrame:
    """Members with their type; their statement's columns stay."""
    return members_among(tested_members(rows, types))


def members_among(tested: DataFrame) -> DataFrame:
    return tested.where(F.col("member_kind").isNotNull())


def tested_members(rows: DataFrame, types: DataFrame) -> DataFrame:
    """Statements within types as members; those that are none have no kind, and are left out once this is written.

    A filter on the kind in the same job would do all its tests again.
    """
    holders = types.select("document_id", F.col("head").alias("owner"), "type_id", "type_fq", "namespace", "outer_types", F.col("name").alias("type_name"), F.col("type_kind").alias("holder_kind"))
    # the lexer knows which statements stand in what looks like a type; no other is a member
    inner = rows.where("in_type").where(~_is_type(F.col("header"))).join(holders, ["document_id", "owner"])
    is_enum, body = F.col("holder_kind") == "enum", F.col("ender").isin("{", "=>")
    has = F.col("header").contains
    # a pattern's groups at once; a header that doesn't match has no mark
    groups = lambda pattern, n: F.regexp_replace("header", pattern, "\x01".join(f"${i}" for i in range(1, n + 1)))
    inner = inner.withColumn("_method", F.when(has(" ( "), groups(METHOD, 4)))
    kind = (
        F.when(is_enum, F.when(F.col("header").rlike(ENUM_MEMBER), "field")).when(has("event ") & F.col("header").rlike(EVENT), "event").when(has(F.concat("type_name", F.lit(" ( "))) & F.col("header").rlike(CTOR) & (_group(CTOR, 2) == F.col("type_name")), "ctor")
        .when(F.col("_method").contains("\x01"), "method").when(body & F.col("header").rlike(PROPERTY), "property").when(~body & F.col("header").rlike(FIELD), "field")
    )
    inner = inner.withColumn("member_kind", kind)
    parts = F.when(is_enum, groups(ENUM_MEMBER, 2)).when(F.col("member_kind") == "event", groups(EVENT, 2)).when(F.col("member_kind") == "ctor", groups(CTOR, 4)).when(F.col("member_kind") == "method", F.col("_method")).when(F.col("member_kind") == "property", groups(PROPERTY, 2)).otherwise(groups(FIELD, 2))
    inner = inner.withColumn("_parts", F.split(parts, "\x01"))
    of = lambda i: F.coalesce(F.get("_parts", F.lit(i - 1)), F.lit(""))
    inner = inner.withColumn("before", of(1)).withColumn("name", of(2)).withColumn("param_types", _parameters(of(4), 1)).withColumn("param_names", _parameters(of(4), 2))
    angle = of(3)
    inner = inner.withColumn("arity", F.when(angle == "", 0).otherwise(F.size(F.split(angle, ","))))
    inner = inner.withColumn("return_type", F.when(is_enum, F.col("type_name")).otherwise(F.nullif(compact(F.regexp_replace("before", f"^{_MODS}(?:event )?", "")), F.lit(""))))
    shown = F.when(F.col("member_kind").isin("method", "ctor"), F.concat("name", F.lit("("), F.array_join("param_types", ", "), F.lit(")"))).otherwise(F.col("name"))
    setters = rows.where(F.col("header").isin("set", "init") | F.col("header").endswith(" set") | F.col("header").endswith(" init")).select("document_id", F.col("owner").alias("head"), F.lit(True).alias("sets")).distinct()
    return inner.drop("_parts", "_method").withColumn("shown", shown).withColumn("symbol_id", F.concat(F.lit("M:"), "type_fq", F.lit("."), "shown")).join(setters, _AT, "left")


def symbols(types: DataFrame, members: DataFrame) -> DataFrame:
    """Declared types and members in the shape of the symbols table; a type in several parts is listed at its first."""
    none, place = F.lit(None).cast("string"), _name_place(F.col("before"))
    has = _holds(F.col("before"))
    common = ["project_id", F.col("path").alias("file"), place["line"].alias("line"), place["col"].alias("col"), "end_line", "end_col"]
    flags = [has("abstract").alias("is_abstract"), has("partial").alias("is_partial"), F.lit(False).alias("is_implicit"), F.lit(False).alias("is_accessor"), F.lit(True).alias("in_source"), F.col("arity").cast("int").alias("arity")]
    outer = F.array_join("outer_types", ".")
    type_rows = types.select(
        F.col("type_id").alias("symbol_id"), "name", F.lit("NamedType").alias("kind"), "type_kind", none.alias("member_kind"), none.alias("containing_type_id"),
        F.when(outer != "", F.concat_ws(".", "namespace", outer)).alias("containing_type_fq"), F.col("namespace").alias("containing_namespace"), _access(F.col("before"), F.when(outer != "", "private").otherwise("internal")).alias("accessibility"),
        has("static").alias("is_static"), F.concat("name", "params").alias("display_min"), F.concat("type_fq", "params").alias("display_fq"), F.col("type_fq").alias("display_err"),
        F.array().cast("array<string>").alias("param_types"), none.alias("return_type"), F.lit(False).alias("has_setter"), F.lit(False).alias("is_const"), F.lit(False).alias("is_readonly"), *flags, *common,
    )
    fq = F.concat("type_fq", F.lit("."), "shown")
    member_rows = members.select(
        "symbol_id", "name", F.initcap("member_kind").alias("kind"), none.alias("type_kind"), "member_kind", F.col("type_id").alias("containing_type_id"), F.col("type_fq").alias("containing_type_fq"),
        F.col("namespace").alias("containing_namespace"), _access(F.col("before"), F.when(F.col("holder_kind").isin("interface", "enum"), "public").otherwise("private")).alias("accessibility"),
        (has("static|const") | (F.col("holder_kind") == "enum")).alias("is_static"), F.col("shown").alias("display_min"), fq.alias("display_fq"), fq.alias("display_err"), "param_types", "return_type",
        F.coalesce("sets", F.lit(False)).alias("has_setter"), (has("const") | (F.col("holder_kind") == "enum")).alias("is_const"), has("readonly").alias("is_readonly"), *flags, *common,
    )
    return keep_first(type_rows.unionByName(member_rows), ["symbol_id", "project_id"], [F.col("file"), F.col("line"), F.col("col")])


# --- scopes ------------------------------------------------------------------------------------


def local_functions(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Functions declared within a member: the statement's columns, name and the member's head and id."""
    found = rows.where(F.col("ender").isin("{", "=>") & (F.size("scopes") > 0) & F.col("header").contains(" ( ")).where(F.col("header").rlike(METHOD)).withColumn("name", _group(METHOD, 2))
    within = found.select("document_id", "head", F.explode("scopes").alias("member_head")).join(members.select("document_id", F.col("head").alias("member_head"), "symbol_id"), ["document_id", "member_head"])
    types = _parameters(_group(METHOD, 4), 1)
    return found.join(within, _AT).withColumn("symbol_id", F.concat("symbol_id", F.lit("/"), "name", F.lit("("), F.array_join(types, ", "), F.lit(")"))).withColumn("param_names", _parameters(_group(METHOD, 4), 2)).withColumn("param_types", types)


def places(rows: DataFrame, types: DataFrame, members: DataFrame) -> DataFrame:
    """For each statement: its innermost type (type_id, scope: the name to look from) and member (member_head, member_id)."""
    holders = types.select("document_id", "head", "type_id", F.col("type_fq").alias("scope"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("member_id")).unionByName(
        members.select("document_id", "head", "type_id", F.col("type_fq").alias("scope"), F.lit(1).alias("rank"), F.col("symbol_id").alias("member_id"))
    )
    spread = rows.select("document_id", F.col("head").alias("inner"), F.explode(F.array_append("scopes", F.col("head"))).alias("head"))
    best = spread.join(holders, _AT).groupBy("document_id", F.col("inner").alias("head")).agg(F.max(F.struct(F.col("head").alias("at"), "type_id", "scope", "member_id")).alias("x"))
    # a type's own header stands outside of it
    return best.select("document_id", "head", F.when((F.col("x.at") < F.col("head")) | F.col("x.member_id").isNotNull(), F.col("x.type_id")).alias("type_id"), "x.scope", F.when(F.col("x.member_id").isNotNull(), F.col("x.at")).alias("member_head"), "x.member_id")


def usings(rows: DataFrame) -> DataFrame:
    """Using directives: document_id, project_id, everywhere (for the whole project), alias and target namespace or type."""
    found = rows.where(F.col("header").rlike(USING) & F.col("ender").isin(";", "=", "")).where(_group(USING, 2) == "")
    aliased = rows.where((F.col("ender") == "=") & F.col("header").rlike(f"^(?:global )?using {_NAME}$") & F.col("value").isNotNull())
    clean = lambda c: F.regexp_replace(F.replace(c, F.lit(" "), F.lit("")), "^global::", "")
    plain = found.where("ender <> '='").select("document_id", "project_id", (_group(USING, 1) != "").alias("everywhere"), F.lit(None).cast("string").alias("alias"), clean(_group(USING, 4)).alias("target"))
    return plain.unionByName(aliased.select("document_id", "project_id", F.col("header").startswith("global ").alias("everywhere"), F.regexp_extract("header", f"({_NAME})$", 1).alias("alias"), clean(F.col("value")).alias("target")))


def visible(project_refs: DataFrame, docs: DataFrame) -> DataFrame:
    """(project, seen) for each project and what it refers to, however far, itself included; no project is a project of its own."""
    own = docs.select(F.coalesce("project_id", F.lit("")).alias("project")).distinct()
    far = closure(project_refs.select(F.col("src_project_id").alias("type_id"), F.col("dst_project_id").alias("parent_id")))
    return own.select("project", F.col("project").alias("seen")).unionByName(far.select(F.col("type_id").alias("project"), F.col("parent_id").alias("seen"))).distinct()


def resolve_types(needs: DataFrame, using_rows: DataFrame, types: DataFrame, seen: DataFrame) -> DataFrame:
    """needs (document_id, project, scope, asked, arity: -1 if not told) with type_id, of those that one type answers.

    ``asked`` is tried below ``scope`` and each of its parents, then as an alias, then below the usings.
    """
    needs = needs.where("asked <> ''").distinct()
    known = types.select(F.col("type_fq").alias("fq"), "arity", F.coalesce("project_id", F.lit("")).alias("seen"), "type_id").distinct()
    # what no type is called needs no scopes
    needs = needs.withColumn("last", F.substring_index("asked", ".", -1)).join(known.select(F.substring_index("fq", ".", -1).alias("last")).unionByName(using_rows.where("alias is not null").select(F.col("alias").alias("last"))).distinct(), "last", "left_semi").drop("last")
    parts = F.split("scope", "\\.")
    depth = F.when(F.coalesce("scope", F.lit("")) == "", 0).otherwise(F.size(parts))
    up = F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(k.alias("tier"), F.concat_ws(".", F.nullif(F.array_join(F.slice(parts, 1, F.greatest(depth - k, F.lit(0))), "."), F.lit("")), "asked").alias("fq")))
    own = using_rows.where("not everywhere").groupBy("document_id").agg(F.collect_set(F.struct("alias", "target")).alias("own"))
    wide = using_rows.where("everywhere").groupBy(F.coalesce("project_id", F.lit("")).alias("project")).agg(F.collect_set(F.struct("alias", "target")).alias("wide"))
    empty = F.array().cast("array<struct<alias: string, target: string>>")
    needs = needs.join(own, "document_id", "left").join(wide, "project", "left").withColumn("used", F.concat(F.coalesce("own", empty), F.coalesce("wide", empty)))
    first, rest = F.substring_index("asked", ".", 1), F.expr("substring(asked, length(substring_index(asked, '.', 1)) + 1)")
    meant = F.transform(F.filter("used", lambda u: u["alias"].isNull() | (u["alias"] == first)), lambda u: F.struct(F.when(u["alias"].isNull(), 1001).otherwise(1000).alias("tier"), F.when(u["alias"].isNull(), F.concat_ws(".", u["target"], "asked")).otherwise(F.concat(u["target"], rest)).alias("fq")))
    tried = needs.select("document_id", "project", "scope", "asked", F.col("arity").alias("told"), F.explode(F.concat(up, meant)).alias("x")).select("*", "x.tier", "x.fq").drop("x")
    met = tried.join(known.select("fq").distinct(), "fq", "left_semi").join(seen, "project").join(known, ["seen", "fq"]).where("told = arity or told = -1")
    # the nearest tier counts; within one, the own project comes before others
    key = ["document_id", "project", "scope", "asked", "told"]
    rank = F.struct("tier", "foreign")
    best = met.groupBy(*key, "tier", (F.col("seen") != F.col("project")).alias("foreign")).agg(F.count_distinct("type_id").alias("n"), F.min("type_id").alias("type_id"))
    best = best.groupBy(*key).agg(F.min_by(F.struct("n", "type_id"), rank).alias("x"))
    return best.where("x.n = 1").select("document_id", "project", "scope", "asked", F.col("told").alias("arity"), "x.type_id")


def _asked(c: Column) -> tuple[Column, Column]:
    """The name and the number of type arguments of a type's text; arrays and nullable types count as what they are of."""
    bare = F.regexp_replace(compact(c), "(?:\\[,*\\]|\\?)+$", "")
    inner = F.regexp_extract(bare, "^[^<]*<(.*)>$", 1)
    flat = inner
    for _ in range(4):
        flat = F.regexp_replace(flat, "<[^<>]*>", "")
    return F.regexp_replace(F.regexp_replace(bare, "<.*$", ""), "^global::", ""), F.when(inner == "", 0).otherwise(F.size(F.split(flat, ",")))


def type_edges(declared: DataFrame, using_rows: DataFrame, seen: DataFrame, types: DataFrame) -> DataFrame:
    """Direct base and interface edges from the lists after declarations, with names bound in their scope among ``types``."""
    project = F.coalesce("project_id", F.lit("")).alias("project")
    listed = declared.where("type_kind <> 'enum' and bases <> ''").select("document_id", project, "type_id", F.concat_ws(".", "namespace", "outer_types").alias("scope"), F.explode(F.split("bases", _COMMA)).alias("raw"))
    asked, arity = _asked(F.regexp_replace("raw", " \\(.*$", ""))
    listed = listed.select("document_id", "project", "type_id", "scope", asked.alias("asked"), arity.alias("arity"))
    found = resolve_types(listed.drop("type_id"), using_rows, types, seen).withColumnRenamed("type_id", "parent_id")
    kinds = types.select(F.col("type_id").alias("parent_id"), F.when(F.col("type_kind") == "interface", "interface").otherwise("base").alias("edge_kind")).distinct()
    return listed.join(found, ["document_id", "project", "scope", "asked", "arity"]).where("type_id <> parent_id").join(kinds, "parent_id").select("type_id", "parent_id", "edge_kind").distinct()


# --- binding -----------------------------------------------------------------------------------


def variables(rows: DataFrame, where: DataFrame, members: DataFrame, functions: DataFrame) -> DataFrame:
    """Parameters, locals and local functions by member: document_id, member_head, name and the text of their type (null if not told)."""
    told = lambda c: F.when(~F.col(c).isin("var", ""), F.col(c))
    listed = lambda df, at: df.select("document_id", F.col(at).alias("member_head"), F.explode(F.arrays_zip("param_names", "param_types")).alias("p")).select("document_id", "member_head", F.col("p.param_names").alias("name"), F.col("p.param_types").alias("told"))
    inside = rows.join(where.where("member_head is not null").select("document_id", "head", "member_head"), _AT)
    own = inside.where(F.col("head") != F.col("member_head")).where(F.col("header").rlike(LOCAL) & F.col("ender").isin("=", ";"))
    own = own.select("document_id", "member_head", _group(LOCAL, 2).alias("name"), F.coalesce(F.when(_group(LOCAL, 1) != "var", _group(LOCAL, 1)), "made_type").alias("told"))
    pairs = lambda i: F.regexp_extract_all("header", F.lit(BROUGHT), F.lit(i))
    brought = inside.where(F.col("header").rlike(BROUGHT)).select("document_id", "member_head", F.explode(F.arrays_zip(pairs(2).alias("n"), pairs(1).alias("t"))).alias("p")).select("document_id", "member_head", F.col("p.n").alias("name"), F.col("p.t").alias("told"))
    called = functions.select("document_id", "member_head", "name", F.lit(None).cast("string").alias("told"))
    every = reduce(DataFrame.unionByName, [listed(members, "head"), listed(functions, "member_head"), own, brought, called]).withColumn("told", told("told"))
    return every.where("name <> ''").groupBy("document_id", "member_head", "name").agg(F.first("told", ignorenulls=True).alias("told"))


def _one(found: DataFrame, key: list, order: list[str]) -> DataFrame:
    """The symbol of each key that is alone among the best by ``order``."""
    best = found.groupBy(*key, *order).agg(F.count_distinct("symbol_id").alias("n"), F.min("symbol_id").alias("symbol_id"))
    best = best.groupBy(*key).agg(F.min_by(F.struct("n", "symbol_id"), F.struct(*order)).alias("x"))
    return best.where("x.n = 1").select(*key, "x.symbol_id")


def find_members(needs: DataFrame, reach: DataFrame, members: DataFrame, kinds: str = "member_kind <> 'ctor'") -> DataFrame:
    """needs (type_id, name, argc: -1 if it's no call) with symbol_id: the nearest member, by number of arguments."""
    own = members.where(kinds).select(F.col("type_id").alias("parent_id"), "name", "symbol_id", "member_kind", F.size("param_types").alias("n_params"))
    met = needs.distinct().join(reach, "type_id").join(own, ["parent_id", "name"])
    other = ((F.col("argc") >= 0) & F.col("member_kind").isin("method", "ctor") & (F.col("n_params") != F.col("argc"))).cast("int")
    return _one(met.withColumn("other", other), ["type_id", "name", "argc"], ["distance", "other"])


def bind(parsed: dict[str, DataFrame], types: DataFrame, members: DataFrame, using_rows: DataFrame, seen: DataFrame, above: DataFrame) -> DataFrame:
    """Names in parsed documents bound to symbols: symbol_id, the place, whether it is a call, and the member that holds it.

    ``types``, ``members`` and ``using_rows`` are those of all documents, ``above`` what types derive from.
    """
    token_rows, rows, functions, where = (parsed[k] for k in ("tokens", "statements", "functions", "places"))
    reach = above.unionByName(types.select("type_id", F.col("type_id").alias("parent_id"), F.lit(0).alias("distance")).distinct())
    # types around a type come after all that it derives from
    out_of = types.where(F.size("outer_types") > 0).select("type_id", "document_id", "project_id", F.concat_ws(".", "namespace", "outer_types").alias("around"))
    around = out_of.join(types.select(F.col("type_fq").alias("around"), "project_id", F.col("type_id").alias("outer_id")), ["around", "project_id"]).select("type_id", "outer_id").distinct()
    outward = closure(around.withColumnRenamed("outer_id", "parent_id")).select("type_id", F.col("parent_id").alias("by"), (F.col("distance") * 1000).alias("far"))
    wide = cut_lineage(reach.unionByName(outward.join(reach.withColumnRenamed("type_id", "by"), "by").select("type_id", "parent_id", (F.col("distance") + F.col("far")).alias("distance"))))
    project = F.coalesce("project_id", F.lit("")).alias("project")
    named = parsed["types"].select("document_id", _name_place(F.col("before"))["start"].alias("start")).unionByName(parsed["members"].select("document_id", _name_place(F.col("before"))["start"].alias("start")))
    # a word that no symbol and no alias is called by is bound to nothing, and most words are such
    called = reduce(DataFrame.unionByName, [members.select("name"), types.select("name"), using_rows.select(F.col("alias").alias("name"))]).where("name is not null").distinct()
    words = token_rows.where((F.col("kind") == "word") & ~F.col("text").isin(*KEYWORDS)).join(called.withColumnRenamed("name", "text"), "text", "left_semi")
    words = words.join(named, ["document_id", "start"], "left_anti")
    words = words.join(where, _AT, "left").select("document_id", project, "path", "i", "line", "col", F.col("text").alias("name"), "receiver", "argc", F.coalesce("arity", F.lit(-1)).alias("arity"), "made", "type_id", F.coalesce("scope", F.lit("")).alias("scope"), "member_head", "member_id")
    local = cut_lineage(variables(rows, where, parsed["members"], functions))
    words = cut_lineage(words.join(local.select("document_id", "member_head", "name", F.lit(True).alias("is_local")), ["document_id", "member_head", "name"], "left"))
    # the types of variables, fields, properties and calls without arguments
    scoped = where.select("document_id", F.col("head").alias("member_head"), "scope", "type_id")
    asked, arity = _asked(F.col("told"))
    projected = rows.select("document_id", project).distinct()
    typed = local.where("told is not null").join(scoped.select("document_id", "member_head", "scope"), ["document_id", "member_head"]).join(projected, "document_id").withColumn("asked", asked).withColumn("arity", arity)
    m_asked, m_arity = _asked(F.col("return_type"))
    valued = members.where(F.col("member_kind").isin("field", "property", "event") & F.col("return_type").isNotNull()).select("document_id", project, F.col("type_fq").alias("scope"), m_asked.alias("asked"), m_arity.alias("arity"), "symbol_id")
    direct = words.where("is_local is null and receiver is null")
    received = words.where("receiver is not null and receiver <> '' and receiver not in ('this', 'base')")
    need = ["document_id", "project", "scope", "asked", "arity"]
    plain = direct.where("argc < 0 or made").select("document_id", "project", "scope", F.col("name").alias("asked"), "arity")
    static = received.select("document_id", "project", "scope", F.col("receiver").alias("asked"), F.lit(-1).alias("arity"))
    # a name without type arguments is that of a type without parameters
    exact = lambda df: df.withColumn("arity", F.when(F.col("arity") < 0, 0).otherwise(F.col("arity")))
    known = cut_lineage(resolve_types(reduce(DataFrame.unionByName, [typed.select(*need), valued.select(*need), exact(plain), exact(static)]), using_rows, types, seen).withColumnRenamed("type_id", "found"))
    local_types = typed.join(known, need).select("document_id", "member_head", F.col("name").alias("receiver"), F.col("found").alias("local_type"))
    value_types = valued.join(known, need).groupBy("symbol_id").agg(F.min("found").alias("value_type"))
    # receivers: a variable, else a member, else a type
    received = received.join(local_types, ["document_id", "member_head", "receiver"], "left").join(local.select("document_id", "member_head", F.col("name").alias("receiver"), F.lit(True).alias("shadowed")), ["document_id", "member_head", "receiver"], "left")
    holders = find_members(received.where("shadowed is null and type_id is not null").select("type_id", F.col("receiver").alias("name"), F.lit(-1).alias("argc")), wide, members).join(value_types, "symbol_id", "left")
    received = received.join(holders.select("type_id", F.col("name").alias("receiver"), F.col("symbol_id").alias("held"), "value_type"), ["type_id", "receiver"], "left")
    received = received.join(known.where("arity = 0").select("document_id", "project", "scope", F.col("asked").alias("receiver"), F.col("found").alias("static_type")), ["document_id", "project", "scope", "receiver"], "left")
    of = F.when(F.col("shadowed"), F.col("local_type")).when(F.col("held").isNotNull(), F.coalesce("value_type", F.when(F.substring_index(F.substring_index("static_type", ".", -1), ":", -1) == F.col("receiver"), F.col("static_type")))).otherwise(F.col("static_type"))
    received = cut_lineage(received.withColumn("of", of).drop("local_type", "shadowed", "held", "value_type", "static_type"))
    shape = ["document_id", "project", "path", "i", "line", "col", "name", "argc", "member_id"]
    # members of the enclosing types
    here = direct.where("not made and type_id is not null").unionByName(words.where("receiver = 'this' and type_id is not null"))
    in_reach = find_members(here.select("type_id", "name", "argc"), wide, members)
    from_here = here.join(in_reach, ["type_id", "name", "argc"])
    in_bases = find_members(words.where("receiver = 'base' and type_id is not null").select("type_id", "name", "argc"), reach.where("distance > 0"), members)
    from_base = words.where("receiver = 'base'").join(in_bases, ["type_id", "name", "argc"])
    # members of the receiver's type
    in_type = find_members(received.where("of is not null").select(F.col("of").alias("type_id"), "name", "argc"), reach, members).withColumnRenamed("type_id", "of")
    from_type = received.join(in_type, ["of", "name", "argc"])
    # type names, and constructors behind new
    as_type = direct.where("argc < 0 or made").withColumn("arity", F.when(F.col("arity") < 0, 0).otherwise(F.col("arity"))).withColumnRenamed("name", "asked").join(known, need).withColumnRenamed("asked", "name")
    as_type = as_type.join(from_here.select("document_id", "i"), ["document_id", "i"], "left_anti")
    made = as_type.where("made").select(*shape, F.col("found").alias("of"))
    ctor_of = find_members(made.select(F.col("of").alias("type_id"), "name", F.greatest("argc", F.lit(0)).alias("argc")), types.select("type_id", F.col("type_id").alias("parent_id"), F.lit(0).alias("distance")).distinct(), members, "member_kind = 'ctor'")
    from_made = made.withColumn("argc", F.greatest("argc", F.lit(0))).join(ctor_of.withColumnRenamed("type_id", "of"), ["of", "name", "argc"])
    # receivers of unknown type: a name and number of arguments that one member of the file, the project or all has
    unknown = received.where("of is null").drop("of").unionByName(words.where("receiver = ''"))
    candidates = members.where("member_kind <> 'ctor'").select("name", F.when(F.col("member_kind") == "method", F.size("param_types")).otherwise(-1).alias("argc"), "symbol_id", "path", project)
    sole = lambda *key: candidates.groupBy(*key).agg(F.count_distinct("symbol_id").alias("n"), F.min("symbol_id").alias("symbol_id")).where("n = 1").drop("n")
    for level, extra in (("s0", ["path"]), ("s1", ["project"]), ("s2", [])):
        unknown = unknown.join(sole("name", "argc", *extra).withColumnRenamed("symbol_id", level), ["name", "argc", *extra], "left")
    from_sole = unknown.withColumn("symbol_id", F.coalesce("s0", "s1", "s2")).where("symbol_id is not null")
    parts = [from_here, from_base, from_type, from_made, from_sole, as_type.withColumn("symbol_id", F.col("found")).withColumn("argc", F.lit(-1))]
    bound = reduce(DataFrame.unionByName, [p.select(*shape, "symbol_id") for p in parts])
    kinds = members.select("symbol_id", "member_kind").distinct()
    bound = bound.join(kinds, "symbol_id", "left").withColumn("is_call", (F.col("argc") >= 0) & F.col("member_kind").isin("method", "ctor"))
    return bound.select("symbol_id", "document_id", F.nullif("project", F.lit("")).alias("project_id"), F.col("path").alias("file"), "line", "col", F.coalesce("is_call", F.lit(False)).alias("is_call"), "member_kind", "member_id", "i").distinct()


def refs(bound: DataFrame) -> DataFrame:
    return bound.select("symbol_id", "document_id", "project_id", "file", "line", "col").distinct()


def calls(bound: DataFrame) -> DataFrame:
    """Call edges from the member that holds the call."""
    return bound.where("is_call and member_id is not null").select(F.col("member_id").alias("from_id"), F.col("symbol_id").alias("to_id"), "file", "line", "col").distinct()


def metrics(token_rows: DataFrame, members: DataFrame, functions: DataFrame, rows: DataFrame) -> DataFrame:
    """Complexity and lines of methods, constructors and local functions; complexity is null without a body.

    A decision counts for each unit whose body holds it, so a member has those of its local functions, too.
    """
    shape = ["document_id", "head", "symbol_id", "body_at", "line", "end_line"]
    units = members.where(F.col("member_kind").isin("method", "ctor")).select(*shape).unionByName(functions.select(*shape))
    weighty = (F.col("text").isin(*DECISION_WORDS) & ~F.coalesce(F.col("role") == "tail", F.lit(False)) & (F.col("kind") == "word")) | F.col("text").isin(*DECISION_MARKS) | F.col("role").isin(*DECISION_ROLES)
    at = token_rows.where(weighty).groupBy("document_id", "head", "i").agg(F.count(F.lit(1)).alias("w"))
    around = rows.select("document_id", "head", F.array_append("scopes", F.col("head")).alias("around"))
    spread = at.join(around, _AT).select("document_id", "i", "w", F.explode("around").alias("head"))
    found = spread.join(units.where("body_at is not null"), _AT).where("i > body_at").groupBy("symbol_id").agg(F.sum("w").alias("w"))
    sized = units.groupBy("symbol_id").agg(F.min_by(F.struct("line", "end_line", "body_at"), F.struct("document_id", "head")).alias("x"))
    complexity = F.when(F.col("x.body_at").isNotNull(), F.coalesce("w", F.lit(0)) + 1)
    return sized.join(found, "symbol_id", "left").select("symbol_id", complexity.cast("int").alias("complexity"), (F.col("x.end_line") - F.col("x.line") + 1).cast("int").alias("line_count"))


def impl_edges(symbol_rows: DataFrame, above: DataFrame) -> DataFrame:
    """Interface members and the members of implementing types with the same name, kind and parameter types.

    A type implements the interfaces above it, however far.
    """
    shape = F.concat_ws("|", "name", "member_kind", F.array_join("param_types", ","))
    members = symbol_rows.where("member_kind is not null").select("symbol_id", "containing_type_id", shape.alias("shape"))
    contracts = symbol_rows.where("type_kind = 'interface'").select(F.col("symbol_id").alias("parent_id")).distinct()
    asked = above.join(contracts, "parent_id").join(members.select(F.col("containing_type_id").alias("parent_id"), "shape", "symbol_id"), "parent_id")
    own = members.select(F.col("containing_type_id").alias("type_id"), "shape", F.col("symbol_id").alias("impl_id"))
    return asked.join(own, ["type_id", "shape"]).select("symbol_id", "impl_id").distinct()


# --- diagnostics, nodes, actions ---------------------------------------------------------------


def locals_of(rows: DataFrame, where: DataFrame) -> DataFrame:
    """Declarations of one local each, with their member."""
    found = rows.where(F.col("header").rlike(LOCAL) & F.col("ender").isin("=", ";") & ~F.col("header").startswith("const "))
    return found.join(where.where("member_head is not null").select("document_id", "head", "member_head"), _AT).where(F.col("head") != F.col("member_head")).withColumn("type_text", _group(LOCAL, 1)).withColumn("name", _group(LOCAL, 2))


#: Statements that are told apart by their first word.
STATEMENT_WORDS = ("if", "for", "foreach", "while", "do", "switch", "try", "catch", "finally", "using", "lock", "return", "throw", "yield", "break", "continue", "goto", "else", "case", "default", "fixed", "checked", "unchecked", "namespace")


def nodes(token_rows: DataFrame, rows: DataFrame, types: DataFrame, members: DataFrame, functions: DataFrame) -> DataFrame:
    """Declarations, statements, blocks, argument lists, calls, creations, names and literals as nested intervals, in order of place."""
    declared = reduce(DataFrame.unionByName, [types.select("document_id", "head", F.col("type_kind").alias("declared")), members.select("document_id", "head", F.col("member_kind").alias("declared")), functions.select("document_id", "head", F.lit("local_function").alias("declared"))])
    word = F.regexp_extract("header", "^\\S+", 0)
    kind = F.coalesce("declared", F.when(word.isin(*STATEMENT_WORDS), word), F.when(F.col("header").rlike(LOCAL) & F.col("ender").isin("=", ";"), "local"), F.lit("expression"))
    large = rows.join(declared, _AT, "left").select("document_id", kind.alias("node_kind"), F.col("line").alias("start_line"), F.col("col").alias("start_col"), "end_line", "end_col", F.col("start").alias("span_start"), (F.col("end") - F.col("start")).alias("span_len"))
    bracket = token_rows.where(F.col("match").isNotNull()).select("document_id", F.col("match").alias("i"), F.when(F.col("text") == "{", "block").when(F.col("text") == "(", "argument_list").otherwise("bracketed").alias("node_kind"), F.col("line").alias("start_line"), F.col("col").alias("start_col"), F.col("start").alias("span_start"))
    ends = token_rows.where(F.col("text").isin(")", "]", "}")).select("document_id", "i", F.col("line").alias("end_line"), (F.col("col") + 1).alias("end_col"), (F.col("start") + 1).alias("end"))
    bracket = bracket.join(ends, ["document_id", "i"]).withColumn("span_len", F.col("end") - F.col("span_start")).drop("i", "end")
    is_name = (F.col("kind") == "word") & ~F.col("text").isin(*KEYWORDS)
    small = F.when(F.col("made"), "creation").when(is_name & (F.col("argc") >= 0), "call").when(is_name, "name").when(F.col("kind").isin("number", "string") | F.col("text").isin("true", "false", "null"), "literal").when(F.col("role") == "conditional", "conditional")
    leaves = token_rows.withColumn("node_kind", small).where("node_kind is not null").select("document_id", "node_kind", F.col("line").alias("start_line"), F.col("col").alias("start_col"), F.col("line").alias("end_line"), (F.col("col") + F.col("length")).alias("end_col"), F.col("start").alias("span_start"), F.col("length").alias("span_len"))
    every = large.unionByName(bracket).unionByName(leaves)
    # a place and a length tell an outer node from an inner one, so they number nodes without a sort of a document
    number = F.col("span_start") * 2 + F.when(F.col("node_kind").isin("block", "argument_list", "bracketed"), 1).otherwise(0)
    return every.withColumn("node_id", number.cast("int"))


def actions(diagnostic_rows: DataFrame, rows: DataFrame, where: DataFrame) -> DataFrame:
    """What can be done at places: taking out unused locals, and writing ``var`` for a local's type."""
    none = F.lit(None).cast("string")
    fixes = diagnostic_rows.where(F.col("code").isin(*SUPPORTED_FIXES)).select(
        F.concat(F.lit("Remove unused local ("), "code", F.lit(")")).alias("title"), F.lit(FIX_CATEGORY).alias("category"), F.lit(FIX_ORIGIN).alias("origin"), F.lit("remove_unused_local").alias("provider_key"), "file",
        F.col("code").alias("diagnostic_id"), none.alias("refactoring_id"), "span_start", "span_len", "line", "col",
    )
    typed = locals_of(rows, where).where("ender = '=' and type_text <> 'var'")
    name_at, before = F.element_at("places", -1), F.element_at("places", -2)
    last_token = F.regexp_extract("type_text", "\\S+$", 0)
    var = typed.select(
        F.lit("Use 'var'").alias("title"), F.lit("refactoring").alias("category"), F.lit("native").alias("origin"), F.lit(USE_VAR_KEY).alias("provider_key"), F.col("path").alias("file"), none.alias("diagnostic_id"), F.lit(USE_VAR_KEY).alias("refactoring_id"),
        F.col("start").alias("span_start"), (before["start"] + F.length(last_token) - F.col("start")).alias("span_len"), "line", "col", name_at["line"].alias("_line"),
    )
    return fixes.unionByName(var.where("line = _line").drop("_line"))


# --- all facts ---------------------------------------------------------------------------------


class Tables(dict):
    """Tables by name, each made and written once to the shared folder, when it is first asked for; views are of written tables."""

    def __init__(self, views: dict[str, Callable[[Tables], DataFrame]], steps: dict[str, Callable[[Tables], DataFrame]]):
        super().__init__()
        self.views, self.steps = views, steps

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.views[name](self) if name in self.views else cut_lineage(self.steps[name](self))
        return self[name]


def parse(docs: DataFrame, whole: bool = True) -> Tables:
    """What documents say by themselves: tokens, statements, types, members, functions and places.

    Cutting the texts gives tokens and statements, which are views of one table.  Without ``whole`` it gives statements
    alone, and texts are cut again if tokens are asked for.
    """

    def cut(tables: Tables, name: str, whole: bool) -> DataFrame:
        rows = cut_lineage(lexer.grouped(docs, whole))
        tables["statements"] = statements(rows)
        if whole:
            tables["tokens"] = lexer.flat(rows)
        return tables[name]

    views = {"tokens": lambda t: cut(t, "tokens", True), "statements": lambda t: cut(t, "statements", whole), "members": lambda t: members_among(t["tested"])}
    return Tables(views, {
        "types": lambda t: type_declarations(t["statements"]), "tested": lambda t: tested_members(t["statements"], t["types"]),
        "functions": lambda t: local_functions(t["statements"], t["members"]), "places": lambda t: places(t["statements"], t["types"], t["members"]), "unread": rules.unread,
    })


def _own_facts(parsed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Fact tables that need one document at a time."""
    words, rows, types, members, functions, where = (parsed[k] for k in ("tokens", "statements", "types", "members", "functions", "places"))
    problems = cut_lineage(rules.run(parsed)[0])
    return {
        "symbols": cut_lineage(symbols(types, members)), "usings": usings(rows), "words": words.where("kind = 'word'").select(F.col("text").alias("name"), "document_id").distinct(),
        "metrics": metrics(words, members, functions, rows), "diagnostics": problems, "nodes": nodes(words, rows, types, members, functions), "actions": actions(problems, rows, where),
    }


def facts_of(project_rows: DataFrame, ref_rows: DataFrame, docs: DataFrame) -> dict[str, DataFrame]:
    """All fact tables of documents, which may differ from what stands in the source folder."""
    parsed = parse(docs)
    own = _own_facts(parsed)
    using_rows, seen = cut_lineage(own["usings"]), cut_lineage(visible(ref_rows, docs))
    edges = cut_lineage(type_edges(parsed["types"], using_rows, seen, parsed["types"]))
    above = cut_lineage(closure(edges))
    bound = cut_lineage(bind(parsed, parsed["types"], parsed["members"], using_rows, seen, above))
    return {**own, "projects": project_rows, "project_refs": ref_rows, "documents": docs, "type_edges": edges, "impl_edges": impl_edges(own["symbols"], above), "refs": refs(bound), "calls": calls(bound)}


# --- facts after an edit -----------------------------------------------------------------------


def _as_types(symbol_rows: DataFrame) -> DataFrame:
    """Types of a symbols table, as ``bind`` and ``resolve_types`` want them."""
    outer = F.when(F.col("containing_type_fq").isNull(), F.array().cast("array<string>")).otherwise(F.split(F.expr("substring(containing_type_fq, coalesce(length(containing_namespace) + 2, 1))"), "\\."))
    return symbol_rows.where("type_kind is not null").select(F.col("symbol_id").alias("type_id"), F.col("display_err").alias("type_fq"), "name", "arity", "project_id", F.col("containing_namespace").alias("namespace"), outer.alias("outer_types"), "type_kind", F.col("file").alias("document_id"))


def _as_members(symbol_rows: DataFrame) -> DataFrame:
    return symbol_rows.where("member_kind is not null").select("symbol_id", F.col("containing_type_id").alias("type_id"), F.col("containing_type_fq").alias("type_fq"), "name", "member_kind", "param_types", "return_type", F.col("file").alias("path"), "project_id", F.col("file").alias("document_id"))


def facts_after(old: dict[str, DataFrame], changed: DataFrame) -> tuple[dict[str, DataFrame], DataFrame] | None:
    """All fact tables after ``changed`` documents got new texts, and the documents that were derived again.

    Derived again are the changed documents and those that hold a name (``words``, an inverted index)
    whose meaning may have changed: names of symbols that came, went or look different, of members whose type
    has such a name, and of members of types whose bases changed.  What these derivations change may
    bring further names, so that is repeated until no document is added.  All other rows are taken over.
    None if a directive for a whole project changed: then everything is to be derived.
    """
    spark = changed.sparkSession
    paths = lambda df: df.select("document_id").distinct()
    out_of = lambda df, docs, column="document_id": df.join(docs.select(F.col("document_id").alias(column)), column, "left_anti")
    within = lambda df, docs, column="document_id": df.join(docs.select(F.col("document_id").alias(column)), column, "left_semi")
    docs = cut_lineage(out_of(old["documents"], paths(changed)).unionByName(changed.select(*old["documents"].columns)))
    seen = cut_lineage(visible(old["project_refs"], docs))
    told = ["symbol_id", "project_id", "name", "type_kind", "member_kind", "containing_type_id", "accessibility", "is_static", "is_abstract", "return_type", "arity", "param_types"]
    again, names = cut_lineage(paths(changed)), None
    while True:
        parsed = parse(within(docs, again))
        own = _own_facts(parsed)
        using_rows = cut_lineage(out_of(old["usings"], again).unionByName(own["usings"]))
        if names is None:
            wide = lambda df: df.where("everywhere").select("project_id", "alias", "target")
            before, now = wide(within(old["usings"], again)), wide(own["usings"])
            if not before.exceptAll(now).isEmpty() or not now.exceptAll(before).isEmpty():
                return None
        symbol_rows = cut_lineage(keep_first(out_of(old["symbols"], again, "file").select(*own["symbols"].columns).unionByName(own["symbols"]), ["symbol_id", "project_id"], [F.col("file"), F.col("line"), F.col("col")]))
        all_types, all_members = _as_types(symbol_rows), _as_members(symbol_rows)
        owners = old["symbols"].where("type_kind is not null").select(F.col("symbol_id").alias("type_id"), F.col("file").alias("document_id"))
        gone = within(owners, again).select("type_id").distinct()
        new_edges = cut_lineage(type_edges(parsed["types"], using_rows, seen, all_types))
        edges = cut_lineage(old["type_edges"].join(gone, "type_id", "left_anti").unionByName(new_edges).distinct())
        before, now = within(old["symbols"], again, "file").select(*told), own["symbols"].select(*told)
        differ = cut_lineage(before.exceptAll(now).unionByName(now.exceptAll(before)))
        parts = own["symbols"].where("is_partial and type_kind is not null").select("name").unionByName(within(old["symbols"], again, "file").where("is_partial and type_kind is not null").select("name"))
        old_edges = old["type_edges"].join(gone, "type_id", "left_semi")
        moved = old_edges.exceptAll(new_edges.select(*old_edges.columns)).unionByName(new_edges.select(*old_edges.columns).exceptAll(old_edges)).select("type_id", "parent_id")
        touched = moved.select("type_id").unionByName(moved.select(F.col("parent_id").alias("type_id")))
        touched = cut_lineage(touched.unionByName(closure(moved).select(F.col("parent_id").alias("type_id"))).distinct())
        inherited = cut_lineage(closure(edges)).join(touched, "type_id", "left_semi").select(F.col("parent_id").alias("type_id")).unionByName(touched).distinct()
        of_moved = symbol_rows.join(inherited, F.col("containing_type_id") == F.col("type_id"), "left_semi").select("name")
        type_names = differ.where("type_kind is not null").select("name").distinct()
        mentioned = symbol_rows.where("return_type is not null").select("name", F.explode(F.array_distinct(F.split("return_type", "[^\\p{L}\\p{N}_]+"))).alias("part")).join(type_names.withColumnRenamed("name", "part"), "part", "left_semi").select("name")
        names = cut_lineage(reduce(DataFrame.unionByName, [differ.select("name"), parts, of_moved, mentioned]).distinct())
        further = cut_lineage(paths(old["words"].join(names, "name", "left_semi")).join(again, "document_id", "left_anti").join(docs.select("document_id"), "document_id", "left_semi"))
        if further.isEmpty():
            break
        again = cut_lineage(again.unionByName(further))
    above = cut_lineage(closure(edges))
    bound = cut_lineage(bind(parsed, cut_lineage(all_types), cut_lineage(all_members), using_rows, seen, above))
    stays = lambda name, column, new: out_of(old[name], again, column).unionByName(conform(name, new))
    # metrics name a symbol, that of a local function its member's before the stroke
    files = old["symbols"].select("symbol_id", F.col("file").alias("document_id")).distinct()
    measured = within(files, again).select(F.col("symbol_id").alias("member_id")).distinct()
    kept_metrics = old["metrics"].withColumn("member_id", F.substring_index("symbol_id", "/", 1)).join(measured, "member_id", "left_anti").select("symbol_id", "complexity", "line_count")
    facts = {
        "projects": old["projects"], "project_refs": old["project_refs"], "documents": docs, "symbols": symbol_rows, "type_edges": edges, "impl_edges": impl_edges(symbol_rows, above),
        "refs": stays("refs", "document_id", refs(bound)), "calls": stays("calls", "file", calls(bound)), "metrics": kept_metrics.unionByName(conform("metrics", own["metrics"])),
        "usings": using_rows, **{n: stays(n, c, own[n]) for n, c in (("words", "document_id"), ("diagnostics", "document_id"), ("nodes", "document_id"), ("actions", "file"))},
    }
    return facts, again


def facts(spark: SparkSession, root: str, version: int = 1, solution: str | None = None) -> dict[str, DataFrame]:
    """All fact tables of a source folder, or of the projects that a solution in it lists."""
    project_rows, ref_rows = projects(spark, root, version, solution)
    docs = documents(spark, root, project_rows)
    if solution is not None:  # files below a project that isn't loaded are left out
        docs = docs.where(F.col("project_id").isNotNull())
    return facts_of(project_rows, ref_rows, docs)

"""Scalar functions as column expressions, and the same normal forms for request parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

#: File name endings of generated sources.
GENERATED_SUFFIXES = (".g.cs", ".g.i.cs", ".generated.cs", ".designer.cs", ".AssemblyAttributes.cs", ".AssemblyInfo.cs")
#: Names that filters accept.
TYPE_KINDS = ("class", "interface", "struct", "enum", "record")
MEMBER_KINDS = ("method", "property", "field", "event", "ctor")
ACCESSIBILITIES = ("public", "internal", "private", "protected", "protected_internal", "private_protected")
BINDINGS = ("static", "instance")
DIRECTIONS = ("incoming", "outgoing", "both")
SUPPORTED_FIXES = ("CS0168", "CS0219", "IDE0059")
USE_VAR_KEY, FIX_ORIGIN, FIX_CATEGORY, DIAGNOSTIC_ORIGIN = "use_var_for_local", "pack_codefix", "compiler", "pack_diagnostic"


# --- columns -----------------------------------------------------------------------------------


def normalize_optional(c: Column) -> Column:
    """Trimmed, blank as null."""
    return F.nullif(F.trim(c), F.lit(""))


def same_ignoring_case(a: Column, b: Column | str) -> Column:
    return F.upper(a) == (F.lit(b.upper()) if isinstance(b, str) else F.upper(b))


def source_kind(path: Column) -> Column:
    """HandWritten, Generated, Intermediate or, for a blank path, Unknown."""
    slashed = F.translate(path, "\\", "/")
    suffix = "|".join(s.replace(".", "\\.") for s in GENERATED_SUFFIXES)
    return (
        F.when(path.isNull() | (F.trim(path) == ""), "Unknown")
        .when(slashed.rlike("(?i)/(obj|bin)/"), "Intermediate")
        .when(slashed.rlike(f"(?i)({suffix})$"), "Generated")
        .otherwise("HandWritten")
    )


def is_visible(path: Column) -> Column:
    return source_kind(path).isin("HandWritten", "Unknown")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


#: The runtime's names of the language's built-in types.
BUILT_IN_TYPES = {
    "bool": "Boolean", "byte": "Byte", "sbyte": "SByte", "char": "Char", "decimal": "Decimal", "double": "Double", "float": "Single", "int": "Int32", "uint": "UInt32",
    "nint": "IntPtr", "nuint": "UIntPtr", "long": "Int64", "ulong": "UInt64", "short": "Int16", "ushort": "UInt16", "void": "Void", "string": "String", "object": "Object",
}


def type_name(written: Column) -> Column:
    """The short name of a type as written in source; blank for arrays and tuples, which have none."""
    bare = F.trim(written)
    core = F.element_at(F.split(F.regexp_replace(F.regexp_replace(bare, "\\?$", ""), "<.*>$", ""), "\\."), -1)
    built_in = F.create_map(*[F.lit(x) for pair in BUILT_IN_TYPES.items() for x in pair])
    named = F.coalesce(F.try_element_at(built_in, core), core)
    a_value = F.try_element_at(built_in, core).isNotNull() & ~core.isin("string", "object")
    return F.when(bare.rlike("(?:[\\]\\)]\\??)$"), "").when(bare.endswith("?") & a_value, "Nullable").otherwise(named)


def severity(raw: Column) -> Column:
    """error and warning as they are, all else info."""
    lowered = F.lower(raw)
    return F.when(lowered.isin("error", "warning"), lowered).otherwise("info")


def category(raw: Column, origin: Column) -> Column:
    """Lower-case and trimmed; a blank one is analyzer or unknown by its origin."""
    lowered = normalize_optional(F.lower(raw))
    return F.coalesce(lowered, F.when(F.lower(origin).contains("analyzer"), "analyzer").otherwise("unknown"))


def risk(raw: Column, origin: Column, category_: Column) -> Column:
    lowered = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    by_analyzer = F.lower(origin).contains("analyzer") | (F.lower(category_) == "analyzer")
    return (
        F.when(F.coalesce(by_analyzer, F.lit(False)) | (lowered == ""), "info")
        .when(lowered.isin("safe", "low"), "low")
        .when(lowered.isin("review_required", "medium"), "review_required")
        .when(lowered.isin("blocked", "high"), "high")
        .otherwise(lowered)
    )


def risk_rank(risk_: Column) -> Column:
    return F.when(risk_ == "low", 0).when(risk_.isin("review_required", "medium"), 1).otherwise(2)


def policy(provider_key: Column, origin: Column, category_: Column, diagnostic: Column, profile: str | None = "default") -> Column:
    """struct(decision, risk, reason) of an action under a policy profile."""
    verdict = lambda d, r, why: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("risk"), F.lit(why).alias("reason"))
    if (profile or "").strip().lower() not in ("", "default"):
        return verdict("block", "blocked", "unknown_profile")
    allowed = (origin == FIX_ORIGIN) & (category_ == FIX_CATEGORY) & diagnostic.isin(*SUPPORTED_FIXES)
    return (
        F.when(provider_key == USE_VAR_KEY, verdict("review_required", "review_required", "manual_review_required"))
        .when(F.coalesce(allowed, F.lit(False)), verdict("allow", "safe", "allowlisted"))
        .otherwise(verdict("block", "blocked", "not_allowlisted"))
    )


# --- parameters --------------------------------------------------------------------------------


def text_or_none(value: str | None) -> str | None:
    return (value or "").strip() or None


def one_of(value: str | None, allowed: tuple[str, ...], name: str, dashes: bool = False) -> str | None:
    """The lower-case value if allowed, None if blank."""
    value = text_or_none(value)
    if value is None:
        return None
    value = value.lower().replace("-", "_") if dashes else value.lower()
    if value not in allowed:
        raise QueryError("invalid_input", f"{name} must be one of {', '.join(allowed)}", parameter=name, value=value)
    return value


def page_bounds(limit: int | None, offset: int | None) -> tuple[int, int]:
    """Page size in 0..500, 100 unless given, and an offset of at least 0."""
    return min(max(100 if limit is None else limit, 0), 500), max(offset or 0, 0)


def flow_direction(value: str | None) -> str:
    value = (value or "").strip().lower()
    named = {"": "both", "both": "both", "up": "upstream", "upstream": "upstream", "down": "downstream", "downstream": "downstream"}
    if value not in named:
        raise QueryError("invalid_input", "direction must be upstream, downstream or both", parameter="direction", value=value)
    return named[value]


def profile_name(value: str | None) -> str:
    value = (value or "").strip().lower()
    return value if value in ("quick", "standard", "deep") else "standard"


def qualified_name(value: str) -> str:
    value = value.strip()
    return value.removeprefix("global::")

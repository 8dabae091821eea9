"""Ids of actions, fixes and providers: fields joined by pipes, texts in base64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIX_OPERATION = "remove_unused_local"


def encode_text(c: Column) -> Column:
    return F.base64(F.encode(F.coalesce(c, F.lit("")), "UTF-8"))


def decode_text(c: Column) -> Column:
    """The text of a base64 field; null if it isn't one."""
    return F.try_validate_utf8(F.try_to_binary(c, F.lit("base64")).cast("string"))


def action_id(version: int | Column, profile: str, a: dict[str, Column]) -> Column:
    """An action's id; ``a`` has its fields by name."""
    version = F.lit(version) if isinstance(version, int) else version
    return F.concat_ws(
        "|", F.lit("v1"), version.cast("string"), encode_text(F.lit(profile)), encode_text(a["origin"]), encode_text(a["category"]), encode_text(a["provider_key"]),
        a["span_start"].cast("string"), a["span_len"].cast("string"), encode_text(a["file"]), encode_text(a["diagnostic_id"]), encode_text(a["refactoring_id"]), a["line"].cast("string"), a["col"].cast("string"),
    )


def split_id(c: Column) -> Column:
    """The fields of an id as texts.  Keep them in a column of their own: parsing reads them often."""
    return F.split(c, "\\|")


def decoded(parts: Column) -> Column:
    """The texts of base64 fields, null for those that aren't any.  A column of its own, like ``split_id``."""
    return F.transform(parts, decode_text)


def parse_action_id(parts: Column, texts: Column | None = None) -> Column:
    """struct of the fields from ``split_id`` (and ``decoded``), or null where the text is no action id."""
    texts = decoded(parts) if texts is None else texts
    text = lambda i: F.get(texts, F.lit(i))
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    optional = lambda i: F.when(F.trim(text(i)) != "", text(i))
    names = [("version", number(1)), ("profile", F.coalesce(optional(2), F.lit("default"))), ("origin", text(3)), ("category", text(4)), ("provider_key", text(5)), ("span_start", number(6)), ("span_len", number(7))]
    names += [("file", text(8)), ("diagnostic_id", optional(9)), ("refactoring_id", optional(10)), ("line", number(11)), ("col", number(12))]
    fine = (F.size(parts) == 13) & (F.get(parts, F.lit(0)) == "v1")
    for i in (1, 6, 7, 11, 12):
        fine &= number(i).isNotNull()
    for i in (3, 4, 5, 8):  # a base64 field is blank only if it is empty or encodes white space
        fine &= F.trim(text(i)) != ""
    return F.when(fine, F.struct(*[c.alias(n) for n, c in names]))


def fix_id(version: int | Column, diagnostic: Column, start: Column, length: Column, file: Column) -> Column:
    version = F.lit(version) if isinstance(version, int) else version
    return F.concat_ws("|", F.lit("v1"), version.cast("string"), F.lit(FIX_OPERATION), diagnostic, start.cast("string"), length.cast("string"), encode_text(file))


def parse_fix_id(parts: Column) -> Column:
    """struct of the fields from ``split_id``, or null where the text is no fix id."""
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    fields = F.struct(number(1).alias("version"), F.get(parts, F.lit(3)).alias("diagnostic_id"), number(4).alias("span_start"), number(5).alias("span_len"), decode_text(F.get(parts, F.lit(6))).alias("file"))
    fine = (F.size(parts) == 7) & (F.get(parts, F.lit(0)) == "v1") & (F.get(parts, F.lit(2)) == FIX_OPERATION)
    return F.when(fine & number(1).isNotNull() & number(4).isNotNull() & number(5).isNotNull() & decode_text(F.get(parts, F.lit(6))).isNotNull(), fields)


def provider_fix_key(provider: Column, diagnostic: Column, equivalence: Column, title: Column) -> Column:
    return F.concat_ws("|", F.lit("cf"), *[encode_text(c) for c in (provider, diagnostic, equivalence, title)])


def provider_refactoring_key(provider: Column, equivalence: Column, title: Column) -> Column:
    return F.concat_ws("|", F.lit("rf"), *[encode_text(c) for c in (provider, equivalence, title)])
